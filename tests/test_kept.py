"""What many parts of an analysis read is computed once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallymast.operators import cdr, compose, correlate, ipdr, risk
from tallymast.session import kept

CALLS = ("event_id long, subject string, a_party string, b_party string, is_provider_message boolean, datetime timestamp, call_type string, duration_seconds long, "
         "imei string, imsi string, first_cell string, last_cell string, lat double, lon double")
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def calls(spark):
    """Three subjects, a call every three hours, ``a`` by night as well and with two devices; ``c`` has no sessions."""
    rows = [(n, s, s, f"b{n % 4}", False, START + timedelta(hours=3 * n, minutes=k), "CALL-OUT", 60, f"i{n % 2 if s == 'a' else 0}", "m", "t1", "t2", 10.0, 20.0)
            for k, s in enumerate("abc") for n in range(20)]
    return spark.createDataFrame(rows, CALLS)


@pytest.fixture(scope="module")
def sessions(spark):
    """For ``a``, ``b`` and ``d`` a session half a minute after each call, and one in each silence."""
    rows = [(2 * n + j, s, at, at + timedelta(minutes=5), 5222, "TCP", 1000, 2000)
            for k, s in enumerate("abd") for n in range(20) for j, at in enumerate((START + timedelta(hours=3 * n, minutes=k + 1, seconds=30), START + timedelta(hours=3 * n + 2)))]
    return ipdr.with_session_features(spark.createDataFrame(
        rows, "event_id long, subject string, start_time timestamp, end_time timestamp, destination_port long, protocol string, data_volume_up long, data_volume_down long"))


def counted(df, column):
    """``df`` and an accumulator of how often ``column`` was computed."""
    times = df.sparkSession.sparkContext.accumulator(0)

    def same(x):
        times.add(1)
        return x

    kind = df.schema[column].dataType
    return df.withColumn(column, F.udf(same, kind).asNondeterministic()(column)), times


def test_kept_has_the_columns_asked_for(calls):
    got = kept(calls, ["subject", "datetime", "subject", "event_id"])
    assert got.columns == ["subject", "datetime", "event_id"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, calls.select("subject", "datetime", "event_id").collect()))


def test_kept_empty(calls):
    got = kept(calls.filter("false"), ["subject", "lat"])
    assert got.dtypes == [("subject", "string"), ("lat", "double")] and got.isEmpty()


def test_integrated_risk_reads_its_sources_once(calls, sessions):
    towers = calls.select(F.col("a_party").alias("mobile_number"), F.col("datetime").alias("timestamp"), F.col("first_cell").alias("tower_id"), "imei")
    c, of_calls = counted(calls, "b_party")
    i, of_sessions = counted(sessions, "destination_port")
    got = {r["party"]: r for r in compose.integrated_risk(c, i, towers).collect()}
    assert (of_calls.value, of_sessions.value) == (60, 120)
    assert sorted(got) == ["a", "b", "c", "d"]
    assert got["c"]["session_score"] is None and got["c"]["correlation_score"] is None and got["d"]["call_score"] is None
    counts = {r["subject"]: r for r in correlate.correlate(calls, sessions)["counts"].collect()}
    assert sorted(counts) == ["a", "b"]
    assert (counts["a"]["call_to_data"], counts["a"]["encrypted_after_call"], counts["a"]["critical_encrypted"], counts["a"]["silences"]) == (20, 20, 20, 19)
    assert got["a"]["correlation_score"] == pytest.approx(min(100.0, 1.5 * (25 + 30 + 5)))


def test_flag_rows_reads_the_calls_once(spark, calls):
    c, times = counted(calls, "call_type")
    none = spark.createDataFrame([], "members array<string>")
    got = [tuple(r) for r in risk.flag_rows(c, none).collect()]
    assert times.value == 60
    assert len(got) == len(set(got))
    assert ("device", "DEVICE_LEVEL", "MEDIUM", "a") in got and ("communication", "VOICE_ONLY", "NONE", "b") in got
    assert {r[3] for r in got if r[1] == "CLUSTERS"} == {"a", "b", "c"}


def test_cycles_compute_the_links_once(spark):
    links, times = counted(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b")], "src string, dst string"), "dst")
    assert [tuple(r) for r in cdr.call_cycles(links).collect()] == [(["a", "b", "c"], ["a", "b", "c"], 3)]
    assert times.value <= 5


def test_counts_with_and_without_the_encrypted_rows(calls, sessions):
    k2 = correlate.call_to_data(calls, sessions)
    k3, k6 = correlate.call_silences(calls), correlate.channel_shifts(calls, sessions)
    k4 = correlate.data_in_silence(k3, sessions)
    pair = [sorted(map(tuple, correlate.subject_counts(calls, k2, k5, k4, k6).collect())) for k5 in (correlate.encrypted_after_call(k2), None)]
    assert pair[0] == pair[1] and len(pair[0]) == 3


def test_correlations_are_of_subjects_in_both_sources(calls, sessions):
    k = correlate.correlate(calls, sessions)
    for name in ("call_to_data", "encrypted_after_call", "call_silences", "data_in_silence", "timeline"):
        assert {r[0] for r in k[name].select("subject").distinct().collect()} == {"a", "b"}, name
    assert k["channel_shifts"].isEmpty()


def test_integrated_report_reads_its_sources_once(calls, sessions):
    towers = calls.select("event_id", F.col("a_party").alias("mobile_number"), F.col("datetime").alias("timestamp"), F.col("first_cell").alias("tower_id"),
                          "imei", "imsi", "lat", "lon", F.col("duration_seconds").alias("duration"), F.lit("D1").alias("dump_id"))
    c, of_calls = counted(calls, "b_party")
    i, of_sessions = counted(sessions, "destination_port")
    t, of_towers = counted(towers, "tower_id")
    report = compose.integrated_report(c, i, t, lon="lon")
    assert report["tower.summary"].count() == 2
    links = {tuple(r) for r in report["links"].filter("kind = 'COORDINATED_ENCRYPTION'").collect()}
    assert (of_calls.value, of_sessions.value, of_towers.value) == (60, 120, 60)
    pairs = correlate.correlate(calls, sessions)["coordinated"].select(F.explode(F.array("a", "b")).alias("s")).groupBy("s").count().collect()
    assert links == {(r["s"], "COORDINATED_ENCRYPTION", r["count"]) for r in pairs} and links
