"""Tower dumps against call and session records.

Tower rows carry ``mobile_number``, calls ``a_party``/``b_party``, sessions ``subject`` (the
number the identity was resolved to, see :func:`resolve_identity`).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import count_if, seconds_between, us
from ..plans.joins import band_join
from .cdr import TIE
from .geofence import busiest_towers


def parties(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("party")).filter(F.col("party").isNotNull()).distinct()


def presence(t: DataFrame, c: DataFrame, i: DataFrame) -> DataFrame:
    """(party, in_tower, in_cdr, in_ipdr): one aggregate over one union answers every set question."""
    marks = [("in_tower", t, "mobile_number"), ("in_cdr", c, "a_party"), ("in_ipdr", i, "subject")]
    rows = [parties(df, col).select("party", *[F.lit(n == name).alias(n) for n, _, _ in marks]) for name, df, col in marks]
    both = reduce(DataFrame.unionByName, rows)
    return both.groupBy("party").agg(*[F.bool_or(n).alias(n) for n, _, _ in marks])


def silent_devices(t: DataFrame, c: DataFrame, i: DataFrame) -> DataFrame:
    """In a dump, in neither calls nor sessions; brief: under an hour and fewer than five records."""
    rows = t.join(parties(c, "a_party").withColumnRenamed("party", "mobile_number"), "mobile_number", "left_anti")
    rows = rows.join(parties(i, "subject").withColumnRenamed("party", "mobile_number"), "mobile_number", "left_anti")
    out = rows.groupBy("mobile_number").agg(F.count(F.lit(1)).alias("records"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    hours = seconds_between("last_seen", "first_seen") / 3600
    return out.select("*", hours.alias("hours"), ((hours < 1) & (F.col("records") < 5)).alias("brief"))


def channel_only(t: DataFrame, c: DataFrame, i: DataFrame) -> DataFrame:
    """Parties seen at a tower that use only data, or only voice."""
    p = presence(t, c, i).filter("in_tower AND in_cdr <> in_ipdr")
    return p.select("party", F.when(F.col("in_ipdr"), "DATA_ONLY").otherwise("VOICE_ONLY").alias("channel"))


def link_calls(t: DataFrame, c: DataFrame, minutes: float = 5) -> DataFrame:
    """Tower record and call of the same number at most ``minutes`` apart."""
    span = int(minutes * 60e6)
    left = t.select("mobile_number", F.col("timestamp").alias("tower_time"), "tower_id")
    right = c.select(F.col("a_party").alias("mobile_number"), F.col("datetime").alias("call_time"), "b_party", "duration_seconds", "call_type")
    out = band_join(left, right, ["mobile_number"], "tower_time", "call_time", -span, span)
    return out.withColumn("gap_seconds", F.abs(seconds_between("call_time", "tower_time")))


def link_summary(links: DataFrame) -> DataFrame:
    return links.groupBy("mobile_number").agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct("tower_id").alias("towers"), F.count_distinct("b_party").alias("contacts"))


def unseen_callers(t: DataFrame, c: DataFrame) -> DataFrame:
    """Callers that are in no dump."""
    calls = c.groupBy("a_party").agg(F.count(F.lit(1)).alias("calls"))
    return calls.join(parties(t, "mobile_number").withColumnRenamed("party", "a_party"), "a_party", "left_anti")


def link_sessions(t: DataFrame, i: DataFrame, minutes: float = 5) -> DataFrame:
    """Tower record and session start of the same number at most ``minutes`` apart."""
    span = int(minutes * 60e6)
    left = t.select("mobile_number", F.col("timestamp").alias("tower_time"), "tower_id")
    right = i.select(F.col("subject").alias("mobile_number"), F.col("start_time").alias("session_start"), "detected_app", "is_encrypted", "total_data_volume")
    return band_join(left, right, ["mobile_number"], "tower_time", "session_start", -span, span)


def encrypted_at_towers(links: DataFrame) -> DataFrame:
    return links.filter("is_encrypted").groupBy(F.col("detected_app").alias("app"), "tower_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_distinct("mobile_number").alias("numbers"))


def volume_at_towers(links: DataFrame, over: int = 10_485_760) -> DataFrame:
    return links.filter(F.col("total_data_volume") > over).groupBy("tower_id").agg(
        F.count(F.lit(1)).alias("sessions"), (F.sum("total_data_volume") / 1048576.0).alias("mb"))


def unplaced_sessions(t: DataFrame, i: DataFrame, minutes: float = 5, same_party: bool = True, tie: Sequence[str] = TIE) -> DataFrame:
    """Encrypted sessions without a tower record within ``minutes``.

    Deviation F13: by default of the same number; ``same_party=False`` accepts any device, as
    observed, and then only the occupied time cells of the dump enter the join."""
    span = int(minutes * 60e6)
    left = i.filter("is_encrypted").select("subject", "start_time", "detected_app", "total_data_volume", *tie)
    if same_party:
        right = t.select(F.col("mobile_number").alias("subject"), F.col("timestamp").alias("tower_time"))
        return band_join(left, right, ["subject"], "start_time", "tower_time", -span, span, "left_anti")
    # nearest records on both sides of a session lie in its own cell or in the cells beside it,
    # so the extremes of each cell decide
    cells = t.groupBy(F.floor(us("timestamp") / span).alias("_c")).agg(F.min(us("timestamp")).alias("lo"), F.max(us("timestamp")).alias("hi"))
    near = cells.select(F.col("_c").alias("_s"), F.lit(True).alias("own"))
    before = cells.select((F.col("_c") + 1).alias("_s"), F.col("hi").alias("_hi"))
    after = cells.select((F.col("_c") - 1).alias("_s"), F.col("lo").alias("_lo"))
    at = us("start_time")
    rows = left.withColumn("_s", F.floor(at / span))
    out = rows.join(near, "_s", "left").join(before, "_s", "left").join(after, "_s", "left")
    seen = F.coalesce("own", F.lit(False)) | F.coalesce(at - F.col("_hi") <= span, F.lit(False)) | F.coalesce(F.col("_lo") - at <= span, F.lit(False))
    return out.filter(~seen).select(*left.columns)


def profiles(t: DataFrame, c: DataFrame, i: DataFrame) -> DataFrame:
    """One row per party of any source with indicator codes; two or more are high.

    The timeline of a profile is :func:`party_events`, a table and not a nested list."""
    tower = t.groupBy(F.col("mobile_number").alias("party")).agg(
        F.count(F.lit(1)).alias("tower_records"), F.count_distinct("tower_id").alias("towers"), F.count_distinct("imei").alias("imeis"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    calls = c.groupBy(F.col("a_party").alias("party")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct("b_party").alias("contacts"), F.sum("duration_seconds").alias("call_seconds"),
        count_if(F.hour("datetime") <= 5).alias("odd_calls"))
    sessions = i.groupBy(F.col("subject").alias("party")).agg(F.count(F.lit(1)).alias("sessions"))
    out = tower.join(calls, "party", "full_outer").join(sessions, "party", "full_outer")
    number = ["tower_records", "towers", "imeis", "calls", "contacts", "call_seconds", "odd_calls", "sessions"]
    out = out.fillna(0, number)
    codes = F.array_compact(F.array(
        F.when(F.col("imeis") > 1, "SEVERAL_IMEIS"), F.when(F.col("tower_records") == 1, "ONE_TIME_VISITOR"), F.when(F.col("odd_calls") > 0, "ODD_HOUR_CALLS"),
        F.when(F.col("calls") > 50, "MANY_CALLS"), F.when((F.col("tower_records") > 0) & (F.col("calls") == 0), "SILENT")))
    return out.select("party", *number, "first_seen", "last_seen", codes.alias("indicators"), (F.size(codes) >= 2).alias("high"))


def party_events(t: DataFrame, c: DataFrame, i: DataFrame | None = None) -> DataFrame:
    """Long timeline (party, at, source, detail) of the sources; order it by party and time."""
    parts = [
        t.select(F.col("mobile_number").alias("party"), F.col("timestamp").alias("at"), F.lit("tower").alias("source"), F.col("tower_id").alias("detail")),
        c.select(F.col("a_party").alias("party"), F.col("datetime").alias("at"), F.lit("call").alias("source"), F.col("b_party").alias("detail"))]
    if i is not None:
        parts.append(i.select(F.col("subject").alias("party"), F.col("start_time").alias("at"), F.lit("session").alias("source"), F.col("detected_app").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def scene_calls(t: DataFrame, c: DataFrame, towers: DataFrame | None = None, k: int = 3) -> DataFrame:
    """Per scene tower (the ``k`` busiest unless given): devices, those that call, and calls
    between devices of the scene."""
    towers = busiest_towers(t, k) if towers is None else towers
    members = t.join(towers.select("tower_id"), "tower_id", "left_semi").select("tower_id", "mobile_number").distinct()
    calls = c.groupBy(F.col("a_party").alias("mobile_number"), "b_party").agg(F.count(F.lit(1)).alias("n"))
    placed = members.join(calls, "mobile_number")
    inner = placed.join(members.select("tower_id", F.col("mobile_number").alias("b_party")), ["tower_id", "b_party"], "left_semi")
    devices = members.groupBy("tower_id").agg(F.count(F.lit(1)).alias("devices"))
    callers = placed.groupBy("tower_id").agg(F.count_distinct("mobile_number").alias("callers"), F.sum("n").alias("calls"))
    between = inner.groupBy("tower_id").agg(F.count(F.lit(1)).alias("inner_links"), F.sum("n").alias("inner_calls"))
    return devices.join(callers, "tower_id", "left").join(between, "tower_id", "left").fillna(0)


def post_arrival_calls(t: DataFrame, c: DataFrame, minutes: float = 10) -> DataFrame:
    """Calls within ``minutes`` after a number was first seen at a tower."""
    first = t.groupBy("mobile_number", "tower_id").agg(F.min("timestamp").alias("arrived"))
    right = c.select(F.col("a_party").alias("mobile_number"), F.col("datetime").alias("call_time"))
    out = band_join(first, right, ["mobile_number"], "arrived", "call_time", 0, int(minutes * 60e6))
    return out.groupBy("mobile_number", "tower_id", "arrived").agg(
        F.count(F.lit(1)).alias("calls"), (F.min(us("call_time") - us("arrived")) / 60e6).alias("first_delay_minutes"))


def silent_zones(t: DataFrame, c: DataFrame, devices: int = 5, share: float = 0.7) -> DataFrame:
    """Towers with more than ``devices`` devices of which more than ``share`` never call.

    Deviation F13: computed over all towers."""
    members = t.select("tower_id", "mobile_number").distinct()
    calling = parties(c, "a_party").select(F.col("party").alias("mobile_number"), F.lit(1).alias("_c"))
    out = members.join(calling, "mobile_number", "left").groupBy("tower_id").agg(F.count(F.lit(1)).alias("devices"), F.count("_c").alias("callers"))
    silent = F.col("devices") - F.col("callers")
    return out.select("tower_id", "devices", silent.alias("silent"), (silent / F.col("devices")).alias("silent_share")).filter(
        (F.col("devices") > devices) & (F.col("silent_share") > share))


def source_coverage(t: DataFrame, c: DataFrame, i: DataFrame) -> DataFrame:
    """Number of parties in every combination of the three sources."""
    return presence(t, c, i).groupBy("in_tower", "in_cdr", "in_ipdr").agg(F.count(F.lit(1)).alias("parties"))


def resolve_identity(cdr_keys: DataFrame, ipdr_keys: DataFrame, cdr_key: str = "cdr_key", ipdr_key: str = "ipdr_key") -> DataFrame:
    """Match keys of both sources over the ten-digit number inside them; session keys usually
    carry the country code 91 in front."""
    c = cdr_keys.select(F.col(cdr_key).alias("cdr_key"), F.regexp_extract(cdr_key, r"(\d{10})", 1).alias("msisdn")).distinct()
    coded = F.regexp_extract(ipdr_key, r"91(\d{10})", 1)
    plain = F.regexp_extract(ipdr_key, r"(\d{10})", 1)
    i = ipdr_keys.select(F.col(ipdr_key).alias("ipdr_key"), F.when(coded != "", coded).otherwise(plain).alias("msisdn")).distinct()
    return c.filter("msisdn <> ''").join(i.filter("msisdn <> ''"), "msisdn")
