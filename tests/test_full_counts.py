"""Counts that stop at the length of a list have the whole count beside them."""

from datetime import datetime, timedelta

import pytest

import checks
from checks.compare import canon, connect
from tallymast.operators import cdr, location

from .conftest import DATA

checks.load_all()


@pytest.fixture(scope="module")
def busy(spark):
    """13 bursts of 5 calls, an hour and five degrees apart, with seven durations and changing cells."""
    start, rows = datetime(2024, 1, 1), []
    for n in range(65):
        burst, k = divmod(n, 5)
        at = start + timedelta(hours=burst, minutes=k)
        rows.append((n, "s", "s", f"b{n}", False, at, "CALL-OUT", n % 7, "i", "m", f"c{k % 2}", f"c{k % 2}", 10.0 + 5 * burst, 20.0))
    columns = "event_id long, subject string, a_party string, b_party string, is_provider_message boolean, datetime timestamp, call_type string, duration_seconds long, imei string, imsi string, first_cell string, last_cell string, lat double, lon double"
    return spark.createDataFrame(rows, columns)


def test_call_counts(spark, busy):
    row = cdr.cdr_patterns(busy, full=True).first()
    assert (row["all_bursts"], row["all_repeated_durations"], row["all_rapid_changes"]) == (13, 7, 52)
    short = cdr.cdr_patterns(busy).first()
    assert all((r["bursts"], r["repeated_durations"], r["rapid_changes"]) == (10, 5, 10) for r in (row, short))
    row = cdr.communication_profile(busy, spark.createDataFrame([], "members array<string>"), full=True).first()
    assert (row["all_repeated_durations"], row["repeated_durations"]) == (7, 3)


def test_location_counts(busy):
    row = location.location_profile(busy, full=True).first()
    assert (row["all_impossible"], row["impossible"], row["all_clusters"], row["clusters"]) == (12, 5, 13, 10)


@pytest.mark.parametrize("name", [n for n in checks.ORACLES if n.endswith("_full")])
def test_same_as_sql(spark, name):
    df = checks.QUERIES[name](spark, DATA)
    cur = connect(DATA).execute(checks.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), cols)
