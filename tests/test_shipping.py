"""The package reaches workers that cannot import it otherwise."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from tallymast.session import local_session, ship
spark = ship(local_session(2, "1g", **{"spark.executorEnv.PYTHONPATH": ""}))

def where(batches):
    sys.path[:] = [p for p in sys.path if p != sys.argv[1]]
    import pandas as pd
    import tallymast.tables
    for pdf in batches:
        yield pd.DataFrame({"at": [tallymast.tables.__file__] * len(pdf)})

print("FOUND", {r[0] for r in spark.range(4).mapInPandas(where, "at string").collect()})
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, REPO], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "tallymast.zip" in out.stdout, out.stdout + out.stderr[-2000:]
