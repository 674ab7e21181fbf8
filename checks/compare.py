"""Compare Spark results with the SQL statements: python -m checks.compare [folder] [name ...]"""

from __future__ import annotations

import math
import sys
import time


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v) + 0.0:.4f}"
        return str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def connect(folder):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        table = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def main(argv):
    import checks
    from tallymast.session import local_session

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    checks.load_all()
    names = [n for n in checks.QUERIES if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    spark = local_session()
    con = connect(folder)
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = checks.QUERIES[name](spark, folder)
            got = canon([tuple(r) for r in df.collect()], df.columns)
            spent = time.time() - t
            if name not in checks.ORACLES:
                print(f"rows  {name} {len(got)} {spent:.1f}s", flush=True)
                continue
            cur = con.execute(checks.ORACLES[name])
            cols = [d[0] for d in cur.description]
            want = canon(cur.fetchall(), cols)
            if sorted(cols) != sorted(df.columns):
                bad += 1
                print(f"COLS  {name} spark={sorted(df.columns)} sql={sorted(cols)}", flush=True)
            elif got != want:
                bad += 1
                a, b = set(got), set(want)
                print(f"DIFF  {name} spark={len(got)} sql={len(want)} only_spark={sorted(a - b)[:2]} "
                      f"only_sql={sorted(b - a)[:2]} cols={sorted(cols)}", flush=True)
            else:
                empty = "" if got else " EMPTY"
                print(f"ok    {name} {len(got)}{empty} {spent:.1f}s sql {time.time() - t - spent:.1f}s", flush=True)
        except Exception as e:  # report and go on
            bad += 1
            print(f"FAIL  {name} {type(e).__name__} {str(e)[:600]}", flush=True)
    print(f"{len(names)} checked, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
