"""Scalar functions, scores and small operators at their boundaries."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymast import normalize, registry
from tallymast.functions import geo, scalar as S
from tallymast.operators import cdr, correlate, geofence, ipdr, movement, risk


def one(spark, fn, *args, ddl):
    df = spark.createDataFrame([args], ddl)
    return df.select(fn(*df.columns).alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [
    ("+919876543210", "9876543210"), ("919876543210", "9876543210"), ("9198765432", "9198765432"), (" 98765 43210 ", "9876543210"), ("12345", None), (None, None), ("9876543210.0", None)])
def test_msisdn(spark, raw, want):
    assert one(spark, S.msisdn, raw, ddl="a string") == want


def test_identifier_undoes_floats(spark):
    df = spark.createDataFrame([("9876543210.0",), ("9.87654321E9",), ("35000000000001",), ("AD-X",)], "a string")
    assert [r[0] for r in df.select(normalize.identifier("a")).collect()] == ["9876543210", "9876543210", "35000000000001", "AD-X"]


@pytest.mark.parametrize("raw,want", [("ad-sbi", "ad-sbi"), ("98-76", "9876"), (None, ""), (" VM-X ", "VM-X"), ("ZZ-1", "ZZ-1")])
def test_clean_phone(spark, raw, want):
    assert one(spark, S.clean_phone, raw, ddl="a string") == want


@pytest.mark.parametrize("date,time,want", [
    ("2024-01-02", "03:04:05", datetime(2024, 1, 2, 3, 4, 5)), ("2024-01-02 00:00:00", "3:04:05", datetime(2024, 1, 2, 3, 4, 5)), ("02/01/2024", "03:04:05", datetime(2024, 1, 2, 3, 4, 5)),
    ("2024-01-02", "24:00:00", None), ("", "03:04:05", None), (None, "03:04:05", None), ("2024-01-02", None, None)])
def test_cdr_timestamp(spark, date, time, want):
    assert one(spark, S.cdr_timestamp, date, time, ddl="a string, b string") == want


def test_serial_day(spark):
    assert one(spark, S.tower_date_time, "45292", "14:30:00", ddl="a string, b string") == datetime(2024, 1, 1, 14, 30)


@pytest.mark.parametrize("port,proto,want", [
    (443, "TCP", "whatsapp"), (443, "UDP", "signal"), (443, None, "signal"), (5222, "tcp", "whatsapp"), (5222, "UDP", "threema"), (8443, "TCP", "banking"), (500, "UDP", "vpn"), (9050, "TCP", "tor"), (81, "TCP", None), (None, "TCP", None)])
def test_fingerprint(spark, port, proto, want):
    assert one(spark, S.fingerprint_app, port, proto, ddl="a int, b string") == want


@pytest.mark.parametrize("seconds,want", [(0.0, None), (0.5, "brief"), (10.0, "brief"), (10.1, "short"), (60.0, "short"), (300.0, "normal"), (301.0, "long"), (None, None)])
def test_connection_type(spark, seconds, want):
    assert one(spark, S.connection_type, seconds, ddl="a double") == want


@pytest.mark.parametrize("kmh,want", [(0.9, "stationary"), (1.0, "walking"), (5.0, "bicycle"), (25.0, "vehicle"), (500.0, "vehicle"), (500.1, "impossible"), (None, None)])
def test_movement_class(spark, kmh, want):
    assert one(spark, S.movement_class, kmh, ddl="a double") == want


def test_clean_text(spark):
    text = "a\u2028b\u2029c\u2003d\u00e9\u0905e"
    assert one(spark, S.clean_text, text, ddl="a string") == "a\nb\n\nc d\u00e9?e"


def test_haversine_quarter_of_the_equator(spark):
    assert one(spark, geo.haversine_km, 0.0, 0.0, 0.0, 90.0, ddl="a double, b double, c double, d double") == pytest.approx(6371 * 3.141592653589793 / 2)


def frame(spark, rows, ddl, ts="datetime"):
    df = spark.createDataFrame(rows, ddl)
    return df.withColumn(ts, F.timestamp_micros((F.col("s") * 1_000_000).cast("bigint"))).drop("s")


def test_silence_is_longer_than_the_threshold(spark):
    h = 3600
    df = frame(spark, [("a", 0, 1), ("a", 48 * h, 2), ("a", 97 * h, 3), ("a", 169 * h + 1, 4), ("b", 0, 5)], "subject string, s bigint, event_id bigint").withColumn("is_provider_message", F.lit(False))
    assert [(r["gap_hours"], r["severity"]) for r in cdr.silent_periods(df).orderBy("silent_from").collect()] == [(49.0, "MEDIUM"), (pytest.approx(72 + 1 / 3600), "HIGH")]


def test_device_changes_pass_over_nulls(spark):
    rows = [("a", n, n, i) for n, i in enumerate(["X", None, "X", "Y", None, "X"])]
    df = frame(spark, rows, "subject string, s bigint, event_id bigint, imei string").withColumn("is_provider_message", F.lit(False))
    assert [(r["from_imei"], r["to_imei"]) for r in cdr.device_changes(df).orderBy("change_no").collect()] == [("X", "Y"), ("Y", "X")]


@pytest.mark.parametrize("as_zero,want", [(True, 3), (False, 2)])
def test_one_ring_null_duration(spark, as_zero, want):
    rows = [("a", n, n, "p", d, k) for n, (d, k) in enumerate([(3, "CALL-IN"), (4, "CALL-IN"), (None, "CALL-OUT"), (0, "CALL-OUT"), (1, "SMS-IN")])]
    df = frame(spark, rows, "subject string, s bigint, event_id bigint, b_party string, duration_seconds bigint, call_type string").withColumn("is_provider_message", F.lit(False))
    assert cdr.one_ring(df, null_duration_as_zero=as_zero).first()["one_rings"] == want


def sessions(spark, rows):
    df = frame(spark, rows, "subject string, s bigint, e bigint, event_id bigint", "start_time")
    df = df.withColumn("end_time", F.timestamp_seconds("e")).drop("e")
    return df.withColumns({"destination_port": F.lit(443), "protocol": F.lit("TCP"), "data_volume_up": F.lit(1), "data_volume_down": F.lit(1)})


def test_overlaps_must_exceed_sixty_seconds(spark):
    i = ipdr.with_session_features(sessions(spark, [
        ("a", 0, 1000, 1), ("a", 940, 2000, 2), ("a", 939, 1900, 3), ("b", 0, 100000, 4), ("b", 50, 111, 5), ("b", 200, None, 6), ("c", 0, 60, 7), ("c", 0, 61, 8), ("c", 0, 61, 9)]))
    pairs = {(r["subject"], r["a_id"], r["b_id"]) for r in ipdr.concurrent_sessions(i).collect()}
    assert pairs == {("a", 1, 3), ("a", 3, 2), ("b", 4, 5), ("c", 8, 9)}
    assert {r["subject"]: r["pairs"] for r in ipdr.concurrent_counts(i).collect()} == {"a": 2, "b": 1, "c": 1}


def test_rapid_sessions_bounds(spark):
    i = ipdr.with_session_features(sessions(spark, [("a", 0, 10, 1), ("a", 40, 50, 2), ("a", 81, 90, 3), ("a", 85, 99, 4)]))
    assert [r["event_id"] for r in ipdr.rapid_sessions(i).collect()] == [2]


def test_call_to_data_bounds(spark):
    c = frame(spark, [("a", 0, 10, 1, "p")], "subject string, s bigint, duration_seconds bigint, event_id bigint, b_party string")
    i = ipdr.with_session_features(sessions(spark, [("a", 9, 20, 1), ("a", 10, 20, 2), ("a", 69, 70, 3), ("a", 70, 80, 4), ("a", 310, 320, 5), ("a", 311, 320, 6)]))
    assert {r["session_event_id"]: r["risk"] for r in correlate.call_to_data(c, i).collect()} == {2: "HIGH", 3: "HIGH", 4: "LOW", 5: "LOW"}
    k5 = correlate.encrypted_after_call(correlate.call_to_data(c, i))
    assert {r["session_event_id"]: r["risk"] for r in k5.collect()} == {2: "CRITICAL", 3: "CRITICAL", 4: "HIGH", 5: "MEDIUM"}


def test_coordinated_encryption_blocks(spark):
    k5 = frame(spark, [(s, t, "x") for t, s in enumerate("abcdefgh" * 5)] + [("z", 10_000, "x")], "subject string, s bigint, app string", "data_start")
    one_block = correlate.coordinated_encryption(k5, 10).collect()
    assert sorted(map(tuple, one_block)) == sorted(map(tuple, correlate.coordinated_encryption(k5, 10, block_rows=3).collect()))
    assert len(one_block) == sum(1 for i in range(40) for j in range(40) if "abcdefgh"[i % 8] < "abcdefgh"[j % 8] and abs(i - j) < 10)


def test_coordinated_pairs_need_no_shuffle_of_pairs(spark, monkeypatch):
    names = [("abcdefgh" * 5)[t] for t in range(40)]
    k5 = frame(spark, [(s, t, "x") for t, s in enumerate(names)] + [("a", 3, "x"), ("z", 10_000, "x"), (None, 5, "x"), ("h", None, "x")],
               "subject string, s bigint, app string", "data_start")
    plain = correlate.coordinated_encryption(k5, 10)
    want = sorted(map(tuple, correlate.coordinated_pairs(plain).collect()))
    for meetings, batch in ((10_000_000, 1 << 20), (20, 1 << 20), (10_000_000, 3)):  # one cell, many, and batches smaller than a member
        monkeypatch.setattr(correlate, "CELL_MEETINGS", meetings)
        monkeypatch.setattr(correlate._meetings, "__defaults__", (batch,))
        listed = correlate.coordinated_encryption(k5, 10, by_pair=True)
        assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, plain.select("a", "b", "gap_seconds").collect()))
        pairs = correlate.coordinated_pairs(listed, by_pair=True)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        above = plan[:plan.rindex("MapInArrow")]
        assert above.count("MapInArrow") == 1 and "HashAggregate" not in above and "Exchange" not in above
        assert sorted(map(tuple, pairs.collect())) == want
    none = correlate.coordinated_encryption(k5.limit(0), 10, by_pair=True)
    assert correlate.coordinated_pairs(none, by_pair=True).collect() == []


def moves(spark, rows):
    return frame(spark, rows, "mobile_number string, s bigint, tower_id string, lat double, long double, event_id bigint", "timestamp")


def test_speed_needs_time_and_other_tower(spark):
    t = moves(spark, [("a", 0, "A", 0.0, 0.0, 1), ("a", 0, "B", 1.0, 0.0, 2), ("a", 10, "B", 5.0, 0.0, 3), ("a", 20, "C", 6.0, 0.0, 4), ("a", 30, "D", None, 0.0, 5)])
    assert [(r["from_tower"], r["to_tower"]) for r in movement.impossible_travel(t).collect()] == [("B", "C")]


def test_circular_route(spark):
    t = moves(spark, [("a", n, x, 0.0, 0.0, n) for n, x in enumerate("ABAC")] + [("b", n, x, 0.0, 0.0, n) for n, x in enumerate("ABCA")])
    got = {r["mobile_number"]: r["circular"] for r in movement.trajectory_classes(movement.trajectories(t)).collect()}
    assert got == {"a": False, "b": True}


def test_dwell_bounds(spark):
    m = 60
    rows = [("a", 0, "A"), ("a", 10 * m, "A"), ("b", 0, "A"), ("b", 10 * m - 1, "A"), ("c", 0, "A"), ("c", 30 * m, "A"), ("d", 0, "A"), ("d", 29 * m, "A"), ("d", 45 * m, "A")]
    t = frame(spark, [(*r, n) for n, r in enumerate(rows)], "mobile_number string, s bigint, tower_id string, event_id bigint", "timestamp")
    assert {(r["mobile_number"], r["kind"], r["continuous"]) for r in geofence.dwell(t).collect()} == {("a", "SHORT", False), ("d", "MEDIUM", False)}


def test_area_visits(spark):
    t = moves(spark, [("a", 0, "X", 0.0, 0.0, 0), ("a", 3600, "A", 0.0, 0.0, 1), ("a", 7200, "A", 0.0, 0.0, 2), ("a", 9000, "X", 0.0, 0.0, 3), ("a", 9001, "A", 0.0, 0.0, 4)])
    got = [(r["kind"], r["visit_hours"]) for r in movement.area_visits(t, ["A"]).orderBy("timestamp").collect()]
    assert got == [("ENTRY", None), ("EXIT", 0.5), ("ENTRY", None)]


BASE = dict(subject="a", imei_count=1, imsi_count=1, sim_swap=False, device_switching=False, odd_pct=0.0, bursts=0, voice_pct=50.0, voice_only=False, repeated_durations=0,
            high_frequency_contacts=0, tower_hopping=False, rapid_changes=0, activity_change="NONE")


@pytest.mark.parametrize("change,score,level", [
    ({}, 0, "LOW"), ({"imei_count": 2}, 25, "MEDIUM"), ({"imei_count": 3, "odd_pct": 4.01}, 45, "MEDIUM"), ({"imei_count": 3, "odd_pct": 4.0}, 40, "MEDIUM"), ({"sim_swap": True, "odd_pct": 2.0}, 20, "LOW"),
    ({"odd_pct": 2.01, "bursts": 4}, 20, "LOW"), ({"odd_pct": 1.0}, 0, "LOW"), ({"voice_only": True, "voice_pct": 100.0}, 20, "LOW"), ({"voice_pct": 90.1}, 15, "LOW"),
    ({"imei_count": 3, "odd_pct": 5.0, "voice_only": True, "high_frequency_contacts": 4}, 80, "CRITICAL"),
    ({"imei_count": 3, "odd_pct": 5.0, "tower_hopping": True}, 55, "HIGH"), ({"activity_change": "SPIKE", "high_frequency_contacts": 1}, 20, "LOW"), ({"repeated_durations": 3, "rapid_changes": 9}, 0, "LOW")])
def test_component_score(spark, change, score, level):
    r = risk.cdr_risk_components(spark.createDataFrame([{**BASE, **change}])).first()
    assert (r["score"], r["level"]) == (score, level)


def test_documented_terms(spark):
    row = {**BASE, "repeated_durations": 1, "rapid_changes": 3, "direct_links": 0, "common_contacts": 3}
    assert risk.cdr_risk_components(spark.createDataFrame([row]), "documented").first()["score"] == 5 + 8 + 5


def test_session_risk_cuts_and_caps(spark):
    row = lambda e, d, s, a: ("x", 10, 0.0, 0, e, lv(e), 0, 0.0, d, lv(d), 0, 0, s, lv(s), 0, 0, a, lv(a))
    lv = lambda n: "HIGH" if n >= 70 else "MEDIUM" if n >= 40 else "LOW"
    ddl = ("subject string, sessions int, encrypted_pct double, odd_encrypted int, encryption_score int, encryption_level string, large_uploads int, ratio double, data_score int, data_level string, "
           "marathons int, concurrent_pairs int, session_score int, session_level string, high_risk_apps int, unknown_ports int, app_score int, app_level string")
    got = lambda *x: tuple(ipdr.ipdr_risk(None, spark.createDataFrame([row(*x)], ddl)).select("weighted", "score", "level").first())
    assert got(10, 10, 10, 15) == (11, 11, "MEDIUM")
    assert got(70, 70, 0, 0) == (38, 49, "HIGH")
    assert got(90, 90, 90, 90) == (90, 100, "CRITICAL")


def test_registry(views):
    assert len(registry.operators()) > 200
    assert registry.run("odd_hours", views.cdr).columns == ["subject", "total", "odd_calls", "odd_pct", "level"]
    with pytest.raises(KeyError):
        registry.find("impossible_travel")
    assert registry.find("movement.impossible_travel") is movement.impossible_travel
