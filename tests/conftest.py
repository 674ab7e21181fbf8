import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallymast.session import local_session  # noqa: E402

DATA = os.environ.get("TALLYMAST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "8g", **{"spark.sql.shuffle.partitions": "2"})


@pytest.fixture(scope="session")
def views(spark):
    from tallymast.fixtures import Views

    return Views(spark, DATA)
