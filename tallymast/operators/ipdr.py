"""Data sessions: encryption, volumes, session behaviour, applications, risk.

Input is one row per session with ``subject, start_time, end_time, destination_port, protocol,
data_volume_up, data_volume_down``; call :func:`with_session_features` first.  Thresholds are
tested on raw values (F23).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions.scalar import (
    app_risk, count_if, day_name, fingerprint_app, is_encrypted, level, odd_hour, pct, points, port_service,
    seconds_between, us,
)
from ..plans.joins import point_in_interval
from ..plans.shards import neighbours, running_sum
from .cdr import TIE, top_k

MB = 1048576.0
LARGE_UPLOAD = 10_485_760


def with_session_metrics(df: DataFrame) -> DataFrame:
    """Duration in seconds and total volume; either stays null if a part is null."""
    seconds = seconds_between("end_time", "start_time")
    if "session_duration" in df.columns:
        seconds = F.coalesce(F.col("session_duration").cast("double"), seconds)
    return df.withColumns({
        "session_duration": seconds,
        "total_data_volume": F.col("data_volume_up") + F.col("data_volume_down"),
    })


def with_session_features(df: DataFrame, odd: tuple[int, int] = (0, 5)) -> DataFrame:
    app = fingerprint_app("destination_port", "protocol")
    return with_session_metrics(df).withColumns({
        "detected_app": app, "app_risk": app_risk(app), "is_encrypted": is_encrypted(app),
        "hour": F.hour("start_time"), "day": F.to_date("start_time"), "day_of_week": day_name("start_time"),
        "is_odd_hour": odd_hour("start_time", *odd),
    })


def _levels(score):
    return level((score >= 70, "HIGH"), (score >= 40, "MEDIUM"))


def _join(parts: Sequence[DataFrame], how: str = "left") -> DataFrame:
    return reduce(lambda a, b: a.join(b, "subject", how), parts)


def ipdr_summary(df: DataFrame) -> DataFrame:
    """Sessions, volumes, encrypted and odd-hour shares, time range per subject."""
    out = df.groupBy("subject").agg(
        F.count(F.lit(1)).alias("sessions"), (F.sum("total_data_volume") / MB).alias("total_mb"),
        (F.sum("data_volume_up") / MB).alias("up_mb"), (F.sum("data_volume_down") / MB).alias("down_mb"),
        count_if(F.col("is_encrypted")).alias("encrypted"), F.count_distinct("detected_app").alias("apps"),
        count_if(F.col("is_odd_hour")).alias("odd_sessions"),
        F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start"),
    )
    return out.select("*", pct(F.col("encrypted"), F.col("sessions")).alias("encrypted_pct"),
                      pct(F.col("odd_sessions"), F.col("sessions")).alias("odd_pct"))


# -- encryption --------------------------------------------------------------------------

def encryption_profile(df: DataFrame) -> DataFrame:
    out = df.groupBy("subject").agg(
        F.count(F.lit(1)).alias("sessions"), count_if(F.col("is_encrypted")).alias("encrypted"),
        count_if(F.col("is_encrypted") & F.col("is_odd_hour")).alias("odd_encrypted"),
        F.count_distinct(F.when(F.col("is_encrypted") & F.col("app_risk").isin("HIGH", "CRITICAL"), F.col("detected_app")))
        .alias("high_risk_apps"),
    )
    return out.withColumn("encrypted_pct", pct(F.col("encrypted"), F.col("sessions")))


def encryption_by_app(df: DataFrame) -> DataFrame:
    per = df.filter("is_encrypted").groupBy("subject", F.col("detected_app").alias("app"), F.col("app_risk").alias("risk")).agg(
        F.count(F.lit(1)).alias("sessions"))
    whole = F.sum("sessions").over(Window.partitionBy("subject"))
    return per.withColumn("share_pct", pct(F.col("sessions"), whole))


def _spikes(days: DataFrame, value: str, more_than: int, sigmas: float = 2.0) -> DataFrame:
    """Days above mean + ``sigmas`` sample deviations of a subject with more than ``more_than``
    days.  One row per active day comes in, so the subject window is small."""
    w = Window.partitionBy("subject")
    out = days.withColumns({
        "_m": F.avg(value).over(w), "_s": F.stddev_samp(value).over(w), "_n": F.count(F.lit(1)).over(w)})
    return out.filter((F.col("_n") > more_than) & (F.col(value) > F.col("_m") + sigmas * F.col("_s")))


def encryption_spikes(df: DataFrame) -> DataFrame:
    days = df.filter("is_encrypted").groupBy("subject", "day").agg(F.count(F.lit(1)).alias("sessions"))
    return _spikes(days, "sessions", 3).select("subject", "day", "sessions")


def encryption_flags(df: DataFrame, odd_share: float = 30, bytes_over: int = LARGE_UPLOAD * 100, long_over: int = 10) -> DataFrame:
    enc = df.filter("is_encrypted").groupBy("subject").agg(
        pct(count_if(F.col("is_odd_hour")), F.count(F.lit(1))).alias("odd_encrypted_pct"),
        (F.sum("total_data_volume") > bytes_over).alias("large_transfer"),
        count_if(F.col("session_duration") > 3600).alias("long_sessions"),
    )
    spikes = encryption_spikes(df).groupBy("subject").agg(F.count(F.lit(1)).alias("spike_days"))
    return enc.join(spikes, "subject", "left").select(
        "subject", "odd_encrypted_pct", (F.col("odd_encrypted_pct") > odd_share).alias("high_odd_hour"),
        F.coalesce("spike_days", F.lit(0)).alias("spike_days"), F.coalesce("large_transfer", F.lit(False)).alias("large_transfer"),
        "long_sessions", (F.col("long_sessions") > long_over).alias("long_encrypted"))


def encryption_score(df: DataFrame) -> DataFrame:
    out = encryption_profile(df).join(encryption_flags(df), "subject", "left")
    odd = F.coalesce("odd_encrypted_pct", F.lit(0.0))
    high = F.coalesce("high_odd_hour", F.lit(False)).cast("int") + F.coalesce("large_transfer", F.lit(False)).cast("int")
    share = F.col("encrypted_pct")
    score = F.least(
        points((share >= 80, 30), (share >= 60, 20), (share >= 40, 10)) + F.least(F.col("high_risk_apps") * 10, F.lit(20))
        + points((odd > 30, 20), (odd > 15, 10)) + F.least(high * 15, F.lit(30)), F.lit(100)).cast("int")
    return out.select("subject", "sessions", "encrypted_pct", "odd_encrypted", "high_risk_apps",
                      score.alias("score"), _levels(score).alias("level"))


# -- volumes -----------------------------------------------------------------------------

def volume_profile(df: DataFrame) -> DataFrame:
    out = df.groupBy("subject").agg(
        (F.coalesce(F.sum("data_volume_up"), F.lit(0)) / MB).alias("up_mb"), (F.coalesce(F.sum("data_volume_down"), F.lit(0)) / MB).alias("down_mb"))
    return out.select("*", (F.col("up_mb") + F.col("down_mb")).alias("total_mb"),
                      F.when(F.col("down_mb") > 0, F.col("up_mb") / F.col("down_mb")).otherwise(0.0).alias("ratio"))


def large_uploads(df: DataFrame, over: int = LARGE_UPLOAD, tie: Sequence[str] = TIE) -> DataFrame:
    return df.filter(F.col("data_volume_up") > over).select(
        "subject", "start_time", *tie, (F.col("data_volume_up") / MB).alias("up_mb"), "detected_app", "session_duration")


def upload_days(df: DataFrame, days: Sequence[str] = tables.PATTERN_DAYS) -> DataFrame:
    """Sessions and share of the uploaded bytes on each pattern day."""
    up = F.coalesce("data_volume_up", F.lit(0))
    per = df.groupBy("subject", "day_of_week").agg(F.count(F.lit(1)).alias("sessions"), F.sum(up).alias("_up"))
    whole = F.sum("_up").over(Window.partitionBy("subject"))
    per = per.withColumn("upload_pct", pct(F.col("_up"), whole))
    return per.filter(F.col("day_of_week").isin(list(days))).select(
        "subject", "day_of_week", "sessions", (F.col("_up") / MB).alias("up_mb"), "upload_pct")


def upload_spikes(df: DataFrame) -> DataFrame:
    days = df.groupBy("subject", "day").agg(F.sum("data_volume_up").alias("_up"))
    hits = _spikes(days, "_up", 5)
    return hits.select("subject", "day", (F.col("_up") / MB).alias("up_mb"),
                       level((F.col("_up") > F.col("_m") + 3 * F.col("_s"), "HIGH"), default="MEDIUM").alias("severity"))


def upload_flags(df: DataFrame, over: int = LARGE_UPLOAD) -> DataFrame:
    big = F.col("data_volume_up") > over
    counts = df.groupBy("subject").agg(
        count_if(big).alias("large_uploads"),
        count_if(big & F.col("detected_app").isin(tables.MESSENGER_APPS)).alias("messenger_uploads"))
    share = upload_days(df).groupBy("subject").agg(F.sum("upload_pct").alias("pattern_day_pct"))
    out = _join([counts, volume_profile(df), share])
    return out.select(
        "subject", "large_uploads", "messenger_uploads", F.coalesce("pattern_day_pct", F.lit(0.0)).alias("pattern_day_pct"),
        (F.col("large_uploads") > 5).alias("frequent_large_uploads"),
        (F.coalesce("pattern_day_pct", F.lit(0.0)) > 40).alias("day_concentration"),
        ((F.col("ratio") > 2.0) & (F.col("up_mb") > 100)).alias("high_upload_ratio"),
        (F.col("messenger_uploads") > 3).alias("media_via_messenger"), "up_mb", "ratio")


def data_score(df: DataFrame) -> DataFrame:
    spikes = upload_spikes(df).groupBy("subject").agg(count_if(F.col("severity") == "HIGH").alias("high_spikes"))
    out = upload_flags(df).join(spikes, "subject", "left")
    n, mb, share = F.col("large_uploads"), F.col("up_mb"), F.col("pattern_day_pct")
    high = sum((F.col(c).cast("int") for c in ("day_concentration", "media_via_messenger")), F.col("frequent_large_uploads").cast("int"))
    score = F.least(
        points((n >= 10, 25), (n >= 5, 15), (n >= 3, 10)) + points((mb >= 1000, 20), (mb >= 500, 10))
        + points((share > 40, 20), (share > 25, 10)) + F.least(F.coalesce("high_spikes", F.lit(0)) * 10, F.lit(20))
        + F.least(high * 15, F.lit(30)), F.lit(100)).cast("int")
    return out.select("subject", "large_uploads", "up_mb", "ratio", "pattern_day_pct", score.alias("score"), _levels(score).alias("level"))


# -- sessions ----------------------------------------------------------------------------

def session_stats(df: DataFrame, marathon: int = 7200) -> DataFrame:
    long = count_if(F.col("session_duration") > marathon)
    return df.groupBy("subject").agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("session_duration").alias("mean_seconds"),
        F.max("session_duration").alias("max_seconds"), long.alias("marathons"), (long > 5).alias("frequent_marathons"))


def marathon_sessions(df: DataFrame, seconds: int = 7200, tie: Sequence[str] = TIE) -> DataFrame:
    return df.filter(F.col("session_duration") > seconds).select(
        "subject", "start_time", *tie, (F.col("session_duration") / 3600).alias("hours"), "detected_app",
        (F.col("total_data_volume") / MB).alias("mb"))


def session_bursts(df: DataFrame) -> DataFrame:
    days = df.groupBy("subject", "day").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("subject")
    high = F.col("n") > F.avg("n").over(w) + 2 * F.stddev_samp("n").over(w)
    return days.withColumn("_high", F.coalesce(high, F.lit(False))).groupBy("subject").agg(
        F.avg("n").alias("mean_daily"), F.max("n").alias("max_daily"), F.min("n").alias("min_daily"),
        count_if(F.col("_high")).alias("burst_days"), F.bool_or("_high").alias("burst"))


def rapid_sessions(df: DataFrame, seconds: float = 30, tie: Sequence[str] = TIE) -> DataFrame:
    """Session that starts within ``seconds`` after the previous one (by start) ended."""
    rows = df.select("subject", "start_time", "end_time", "detected_app", *tie)
    steps = neighbours(rows, ["subject"], "start_time", prev={"prev_end": "end_time", "prev_app": "detected_app"}, tie=tie)
    gap = seconds_between("start_time", "prev_end")
    return steps.filter((gap >= 0) & (gap <= seconds)).select(
        "subject", "start_time", *tie, gap.alias("gap_seconds"), "prev_app", F.col("detected_app").alias("app"))


def rapid_counts(df: DataFrame, seconds: float = 30, more_than: int = 10, tie: Sequence[str] = TIE) -> DataFrame:
    return rapid_sessions(df, seconds, tie).groupBy("subject").agg(
        F.count(F.lit(1)).alias("rapid"), (F.count(F.lit(1)) > more_than).alias("rapid_switching"))


def _long_enough(df: DataFrame, seconds: int, tie: Sequence[str]) -> DataFrame:
    """A pair can only overlap by more than ``seconds`` if both sessions last longer than that."""
    rows = df.select("subject", "start_time", "end_time", "detected_app", *tie)
    return rows.filter(us("end_time") - us("start_time") > seconds * 1_000_000)


def concurrent_counts(df: DataFrame, seconds: int = 60, more_than: int = 5, tie: Sequence[str] = TIE) -> DataFrame:
    """Number of session pairs that overlap by more than ``seconds``.

    Counted by a sweep and not by building pairs: a session that starts meets every earlier
    one that is still open ``seconds`` later, which is a running sum of starts minus ends.
    """
    rows = _long_enough(df, seconds, tie)
    start, close = us("start_time"), us("end_time") - seconds * 1_000_000
    marks = rows.select("subject", F.inline(F.array(
        F.struct(F.timestamp_micros(close).alias("at"), F.lit(0).alias("kind"), F.col(tie[0]).alias("id"), F.lit(-1).alias("inc")),
        F.struct(F.timestamp_micros(start).alias("at"), F.lit(1).alias("kind"), F.col(tie[0]).alias("id"), F.lit(1).alias("inc")),
    )))
    swept = running_sum(marks, ["subject"], "at", ["at", "kind", "id"], "inc", "open")
    total = F.sum(F.when(F.col("kind") == 1, F.col("open") - 1))
    out = swept.groupBy("subject").agg(total.cast("bigint").alias("pairs"))
    return out.filter("pairs > 0").withColumn("concurrent", F.col("pairs") > more_than)


def concurrent_sessions(df: DataFrame, seconds: int = 60, limit: int = 10, tie: Sequence[str] = TIE) -> DataFrame:
    """The first ``limit`` overlapping pairs of a subject, in order of start.

    Only the first ``limit`` sessions that have a partner can supply them, so at most that
    many sessions per subject enter the point-in-interval join.
    """
    rows = _long_enough(df, seconds, tie)
    t = tie[0]
    steps = neighbours(rows, ["subject"], "start_time", next={"next_start": "start_time"}, tie=tie)
    openers = steps.filter(us("next_start") < us("end_time") - seconds * 1_000_000)
    first = top_k(openers, ["subject"], ["start_time", t], limit, "_n").select(
        "subject", F.col("start_time").alias("a_start"), F.col("end_time").alias("a_end"),
        F.col("detected_app").alias("a_app"), F.col(t).alias("a_id"))
    first = first.withColumn("_until", F.timestamp_micros(us("a_end") - seconds * 1_000_000 - 1))
    pairs = point_in_interval(rows, first, ["subject"], "start_time", "a_start", "_until")
    after = (F.col("start_time") > F.col("a_start")) | ((F.col("start_time") == F.col("a_start")) & (F.col(t) > F.col("a_id")))
    pairs = pairs.filter(after)
    kept = top_k(pairs, ["subject"], ["a_start", "a_id", "start_time", t], limit, "pair_no")
    return kept.select(
        "subject", "pair_no", "a_id", F.col(t).alias("b_id"), F.col("start_time").alias("overlap_start"),
        seconds_between(F.least("a_end", "end_time"), F.col("start_time")).alias("overlap_seconds"), "a_app",
        F.col("detected_app").alias("b_app"))


def session_calendar(df: DataFrame, days: Sequence[str] = tables.PATTERN_DAYS) -> DataFrame:
    """Night share (hours 0-5, F3) and pattern-day share of the sessions."""
    out = df.groupBy("subject").agg(
        F.count(F.lit(1)).alias("sessions"), count_if(F.col("hour") < 6).alias("_n"),
        count_if(F.col("day_of_week").isin(list(days))).alias("_p"))
    night, share = pct(F.col("_n"), F.col("sessions")), pct(F.col("_p"), F.col("sessions"))
    return out.select("subject", "sessions", night.alias("night_pct"), share.alias("pattern_day_pct"),
                      (night > 30).alias("night_owl"), (share > 40).alias("day_concentration"))


def session_histogram(df: DataFrame) -> DataFrame:
    """(subject, hour, day_of_week) counts; both histograms are sums of it."""
    return df.groupBy("subject", "hour", "day_of_week").agg(F.count(F.lit(1)).alias("sessions"))


def session_score(df: DataFrame, tie: Sequence[str] = TIE, full: bool = False) -> DataFrame:
    """The pair list stops at ten, so the count that enters the score does too; ``full`` adds
    ``all_concurrent_pairs``."""
    out = _join([
        session_stats(df).select("subject", "marathons", "frequent_marathons"), session_bursts(df).select("subject", "max_daily"),
        rapid_counts(df, tie=tie), concurrent_counts(df, tie=tie), session_calendar(df).select("subject", "day_concentration")])
    rapid, every = F.coalesce("rapid", F.lit(0)), F.coalesce("pairs", F.lit(0))
    pairs = F.least(every, F.lit(10))
    m = F.col("marathons")
    high = (F.col("frequent_marathons").cast("int") + (rapid > 10).cast("int") + (pairs > 5).cast("int")
            + F.col("day_concentration").cast("int"))
    score = F.least(
        points((m >= 10, 20), (m >= 5, 10)) + points((rapid >= 20, 25), (rapid >= 10, 15))
        + points((pairs >= 10, 25), (pairs >= 5, 15)) + F.least(high * 15, F.lit(30))
        + points((F.col("max_daily") > 100, 10)), F.lit(100)).cast("int")
    return out.select("subject", "marathons", rapid.alias("rapid"), pairs.alias("concurrent_pairs"), "max_daily",
                      score.alias("score"), _levels(score).alias("level"), *([every.alias("all_concurrent_pairs")] if full else []))


# -- applications ------------------------------------------------------------------------

def app_usage(df: DataFrame) -> DataFrame:
    """Sessions per identified application, with the share of all sessions of the subject."""
    per = df.groupBy("subject", F.col("detected_app").alias("app"), F.col("app_risk").alias("risk")).agg(F.count(F.lit(1)).alias("sessions"))
    share = pct(F.col("sessions"), F.sum("sessions").over(Window.partitionBy("subject")))
    return per.withColumn("share_pct", share).filter(F.col("app").isNotNull()).withColumn(
        "high_risk", F.col("risk").isin("HIGH", "CRITICAL"))


def unknown_ports(df: DataFrame, least: int = 5) -> DataFrame:
    per = df.filter(F.col("detected_app").isNull() & F.col("destination_port").isNotNull()).groupBy("subject", "destination_port").agg(
        F.count(F.lit(1)).alias("sessions"), (F.avg("total_data_volume") / MB).alias("mean_mb"))
    return per.filter(F.col("sessions") >= least)


def unknown_share(df: DataFrame, over: float = 30) -> DataFrame:
    out = df.groupBy("subject").agg(pct(count_if(F.col("detected_app").isNull()), F.count(F.lit(1))).alias("unknown_pct"))
    return out.withColumn("high_unknown", F.col("unknown_pct") > over)


def app_transitions(df: DataFrame, least: int = 5, tie: Sequence[str] = TIE) -> DataFrame:
    """Adjacent sessions that both have an application; a session without one breaks the chain."""
    rows = df.select("subject", "start_time", "detected_app", *tie)
    steps = neighbours(rows, ["subject"], "start_time", prev={"from_app": "detected_app"}, tie=tie)
    per = steps.filter(F.col("from_app").isNotNull() & F.col("detected_app").isNotNull()).groupBy(
        "subject", "from_app", F.col("detected_app").alias("to_app")).agg(F.count(F.lit(1)).alias("times"))
    a, b = F.col("from_app"), F.col("to_app")
    kind = F.when(a.isin(tables.MESSENGER_APPS) & b.isin(tables.MESSENGER_APPS) & (a != b), "APP_SWITCHING").when(
        a.isin("tor", "vpn") | b.isin("tor", "vpn"), "ANONYMIZATION")
    return per.filter(F.col("times") >= least).withColumn("kind", kind).filter(F.col("kind").isNotNull())


def app_behaviour(df: DataFrame, more_than: int = 10, k: int = 3) -> DataFrame:
    rows = df.filter(F.col("detected_app").isNotNull())
    key = ["subject", "detected_app"]
    stats = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("session_duration").alias("mean_seconds"), count_if(F.col("is_odd_hour")).alias("_odd"),
        F.avg("total_data_volume").alias("_m"), F.stddev_samp("total_data_volume").alias("_s")).filter(F.col("sessions") > more_than)
    hours = top_k(rows.groupBy(*key, "hour").agg(F.count(F.lit(1)).alias("n")), key, [F.desc("n"), "hour"], k).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("rank", "hour"))).alias("_h"))
    return stats.join(hours, key).select(
        *key, "sessions", F.col("_h.hour").alias("top_hours"), "mean_seconds",
        F.when(F.col("_s") > F.col("_m") * 2, "HIGHLY_VARIABLE").when(F.col("_odd") / F.col("sessions") > 0.5, "ODD_HOURS")
        .otherwise("NORMAL").alias("pattern"))


def port_profile(df: DataFrame, k: int = 10) -> DataFrame:
    per = df.groupBy("subject", "destination_port").agg(F.count(F.lit(1)).alias("sessions"))
    share = pct(F.col("sessions"), F.sum("sessions").over(Window.partitionBy("subject")))
    per = per.withColumn("share_pct", share).filter(F.col("destination_port").isNotNull())
    return top_k(per, ["subject"], [F.desc("sessions"), "destination_port"], k).withColumn("service", port_service("destination_port"))


def nonstandard_share(df: DataFrame, over: float = 50) -> DataFrame:
    """Share of sessions off the standard ports; a missing port counts as non-standard."""
    standard = F.coalesce(F.col("destination_port").isin(tables.STANDARD_PORTS), F.lit(False))
    out = df.groupBy("subject").agg(pct(count_if(~standard), F.count(F.lit(1))).alias("nonstandard_pct"))
    return out.withColumn("nonstandard", F.col("nonstandard_pct") > over)


def p2p(df: DataFrame, high_ports: int = 20, cv: float = 0.5, known: int = 10) -> DataFrame:
    """Evenly used high ports (coefficient of variation by sample deviation), or else many
    sessions on known peer-to-peer ports."""
    per = df.filter(F.col("destination_port").isNotNull()).groupBy("subject", "destination_port").agg(F.count(F.lit(1)).alias("n"))
    high = F.col("destination_port") > 10000
    out = per.groupBy("subject").agg(
        count_if(high).alias("high_ports"),
        (F.stddev_samp(F.when(high, F.col("n"))) / F.avg(F.when(high, F.col("n")))).alias("variation"),
        F.coalesce(F.sum(F.when(F.col("destination_port").isin(tables.P2P_PORTS), F.col("n"))), F.lit(0)).alias("p2p_sessions"))
    spread = F.coalesce((F.col("high_ports") > high_ports) & (F.col("variation") < cv), F.lit(False))
    return out.select(
        "subject", "high_ports", "p2p_sessions", F.when(spread, "DISTRIBUTED_HIGH_PORTS").when(F.col("p2p_sessions") > known, "KNOWN_PORTS").alias("reason"),
        F.when(spread, 80).when(F.col("p2p_sessions") > known, 90).otherwise(0).alias("confidence"))


def app_score(df: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    base = df.select("subject").distinct()
    risky = app_usage(df).filter("high_risk").groupBy("subject").agg(F.count(F.lit(1)).alias("high_risk_apps"))
    unknown = unknown_ports(df).groupBy("subject").agg(F.count(F.lit(1)).alias("unknown_ports"))
    combos = app_transitions(df, tie=tie).groupBy("subject").agg(F.count(F.lit(1)).alias("combos"))
    odd = app_behaviour(df).groupBy("subject").agg(count_if(F.col("pattern") == "ODD_HOURS").alias("odd_apps"))
    peers = p2p(df).select("subject", (F.col("confidence") > 0).alias("is_p2p"))
    out = _join([base, risky, unknown, combos, odd, peers]).fillna(0, ["high_risk_apps", "unknown_ports", "combos", "odd_apps"]).fillna(False, ["is_p2p"])
    r, u, c = F.col("high_risk_apps"), F.col("unknown_ports"), F.col("combos")
    high = (c > 0).cast("int") + F.col("is_p2p").cast("int")
    score = F.least(
        points((r >= 3, 25), (r >= 1, 15)) + points((u >= 10, 20), (u >= 5, 10)) + F.least(c * 10, F.lit(20))
        + F.least(F.col("odd_apps") * 5, F.lit(15)) + F.least(high * 15, F.lit(30)), F.lit(100)).cast("int")
    return out.select("*", score.alias("score"), _levels(score).alias("level"))


# -- risk --------------------------------------------------------------------------------

WEIGHTS = {"encryption": 0.30, "data": 0.25, "session": 0.25, "app": 0.20}


def ipdr_components(df: DataFrame, tie: Sequence[str] = TIE, full: bool = False) -> DataFrame:
    """Score, level and the figures behind them for the four components; ``full`` adds
    ``all_concurrent_pairs``, as ``concurrent_pairs`` stops at ten.

    Same results as the four score operators, with shared passes: one over the sessions of a
    subject, one over its days, one over its applications and ports, and those that need an
    order.
    """
    c = F.col
    enc, big = c("is_encrypted"), c("data_volume_up") > LARGE_UPLOAD
    up, pattern_day = F.coalesce("data_volume_up", F.lit(0)), c("day_of_week").isin(tables.PATTERN_DAYS)
    base = df.groupBy("subject").agg(
        F.count(F.lit(1)).alias("sessions"), count_if(enc).alias("_enc"), count_if(enc & c("is_odd_hour")).alias("odd_encrypted"),
        F.coalesce(F.sum(F.when(enc, c("total_data_volume"))), F.lit(0)).alias("_enc_bytes"),
        F.sum(up).alias("_up"), F.coalesce(F.sum("data_volume_down"), F.lit(0)).alias("_down"), F.sum(F.when(pattern_day, up).otherwise(0)).alias("_day_up"),
        count_if(big).alias("large_uploads"), count_if(big & c("detected_app").isin(tables.MESSENGER_APPS)).alias("_messenger"),
        count_if(c("session_duration") > 7200).alias("marathons"), count_if(pattern_day).alias("_day_sessions"))
    days = df.groupBy("subject", "day").agg(F.count(F.lit(1)).alias("_n"), F.sum("data_volume_up").alias("_day_bytes"))
    w = Window.partitionBy("subject")
    spike = (F.count(F.lit(1)).over(w) > 5) & (c("_day_bytes") > F.avg("_day_bytes").over(w) + 3 * F.stddev_samp("_day_bytes").over(w))
    days = days.withColumn("_spike", spike).groupBy("subject").agg(F.max("_n").alias("max_daily"), count_if(c("_spike")).alias("_spikes"))
    apps = df.groupBy("subject", "detected_app", "app_risk", "destination_port").agg(
        F.count(F.lit(1)).alias("n"), count_if(c("is_odd_hour")).alias("odd"))
    named = apps.groupBy("subject", "detected_app", "app_risk").agg(F.sum("n").alias("n"))
    risky = named.groupBy("subject").agg(
        count_if(c("app_risk").isin("HIGH", "CRITICAL") & c("detected_app").isNotNull()).alias("high_risk_apps"),
        count_if(c("app_risk").isin("HIGH", "CRITICAL") & c("detected_app").isin(tables.ENCRYPTED_APPS)).alias("_enc_apps"))
    unknown = apps.filter(c("detected_app").isNull() & c("destination_port").isNotNull()).groupBy("subject", "destination_port").agg(
        F.sum("n").alias("n")).groupBy("subject").agg(count_if(c("n") >= 5).alias("unknown_ports"))
    combos = app_transitions(df, tie=tie).groupBy("subject").agg(F.count(F.lit(1)).alias("_combos"))
    odd_apps = df.filter(c("detected_app").isNotNull()).groupBy("subject", "detected_app").agg(
        F.count(F.lit(1)).alias("n"), count_if(c("is_odd_hour")).alias("odd"), F.avg("total_data_volume").alias("m"), F.stddev_samp("total_data_volume").alias("s"))
    odd_apps = odd_apps.filter((c("n") > 10) & ~F.coalesce(c("s") > c("m") * 2, F.lit(False)) & (c("odd") / c("n") > 0.5)).groupBy("subject").agg(F.count(F.lit(1)).alias("_odd_apps"))
    peers = p2p(df).select("subject", (c("confidence") > 0).cast("int").alias("_p2p"))
    out = _join([base, days, risky, unknown, combos, odd_apps, peers, rapid_counts(df, tie=tie).select("subject", "rapid"), concurrent_counts(df, tie=tie).select("subject", "pairs")])
    out = out.fillna(0, ["unknown_ports", "_combos", "_odd_apps", "_p2p", "rapid", "pairs"])

    share, odd = pct(c("_enc"), c("sessions")), pct(c("odd_encrypted"), c("_enc"))
    flag = lambda *conds: reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(False)).cast("int") for x in conds])
    cap = lambda x, most=100: F.least(x, F.lit(most))
    encryption = cap(points((share >= 80, 30), (share >= 60, 20), (share >= 40, 10)) + cap(c("_enc_apps") * 10, 20) + points((odd > 30, 20), (odd > 15, 10))
                     + cap(flag(odd > 30, c("_enc_bytes") > LARGE_UPLOAD * 100) * 15, 30))
    mb, day_up, n = c("_up") / MB, pct(c("_day_up"), c("_up")), c("large_uploads")
    ratio = F.when(c("_down") > 0, c("_up") / c("_down")).otherwise(0.0)
    data = cap(points((n >= 10, 25), (n >= 5, 15), (n >= 3, 10)) + points((mb >= 1000, 20), (mb >= 500, 10)) + points((day_up > 40, 20), (day_up > 25, 10))
               + cap(c("_spikes") * 10, 20) + cap(flag(n > 5, day_up > 40, c("_messenger") > 3) * 15, 30))
    m, rapid, pairs = c("marathons"), c("rapid"), cap(c("pairs"), 10)
    session = cap(points((m >= 10, 20), (m >= 5, 10)) + points((rapid >= 20, 25), (rapid >= 10, 15)) + points((pairs >= 10, 25), (pairs >= 5, 15))
                  + cap(flag(m > 5, rapid > 10, pairs > 5, pct(c("_day_sessions"), c("sessions")) > 40) * 15, 30) + points((c("max_daily") > 100, 10)))
    r, u = c("high_risk_apps"), c("unknown_ports")
    app = cap(points((r >= 3, 25), (r >= 1, 15)) + points((u >= 10, 20), (u >= 5, 10)) + cap(c("_combos") * 10, 20) + cap(c("_odd_apps") * 5, 15)
              + cap(flag(c("_combos") > 0, c("_p2p") > 0) * 15, 30))
    scored = out.select(
        "subject", "sessions", share.alias("encrypted_pct"), "odd_encrypted", "large_uploads", ratio.alias("ratio"), "marathons", pairs.alias("concurrent_pairs"), *([c("pairs").alias("all_concurrent_pairs")] if full else []),
        "high_risk_apps", "unknown_ports", *[x.cast("int").alias(f"{k}_score") for k, x in (("encryption", encryption), ("data", data), ("session", session), ("app", app))])
    return scored.select("*", *[_levels(c(f"{k}_score")).alias(f"{k}_level") for k in ("encryption", "data", "session", "app")])


def ipdr_risk(df: DataFrame, components: DataFrame | None = None, high: int = 70, medium: int = 40, low: int = 0,
              tie: Sequence[str] = TIE) -> DataFrame:
    """Weighted sum cut to a whole number, then multipliers for combinations, capped at 100.

    As observed (F7) the default thresholds make LOW impossible; they are parameters.
    """
    c = ipdr_components(df, tie) if components is None else components
    weighted = F.floor(reduce(lambda a, b: a + b, [F.col(f"{n}_score") * F.lit(w) for n, w in WEIGHTS.items()])).cast("int")
    is_high = lambda n: F.col(f"{n}_level") == "HIGH"
    sharing, opsec = is_high("encryption") & is_high("data"), is_high("session") & is_high("app")
    raised = sum((F.col(f"{n}_level").isin("MEDIUM", "HIGH").cast("int") for n in ("data", "session", "app")),
                 F.col("encryption_level").isin("MEDIUM", "HIGH").cast("int"))
    many = raised >= 3
    factor = F.when(sharing, 1.3).otherwise(1.0) * F.when(opsec, 1.2).otherwise(1.0) * F.when(many, 1.25).otherwise(1.0)
    score = F.when(factor > 1.0, F.least(F.floor(weighted * factor), F.lit(100))).otherwise(weighted).cast("int")
    return c.select(
        "subject", "encryption_score", "data_score", "session_score", "app_score", "encryption_level", "data_level",
        "session_level", "app_level", weighted.alias("weighted"), factor.alias("multiplier"),
        F.array_compact(F.array(F.when(sharing, "ENCRYPTION_AND_UPLOADS"), F.when(opsec, "SESSIONS_AND_APPS"),
                                F.when(many, "SEVERAL_COMPONENTS"))).alias("reasons"),
        score.alias("score"),
        level((score >= high, "CRITICAL"), (score >= medium, "HIGH"), (score >= low, "MEDIUM")).alias("level"))


def ipdr_risk_factors(df: DataFrame, components: DataFrame | None = None, tie: Sequence[str] = TIE) -> DataFrame:
    """Factor codes of each component and at most five note codes."""
    c = ipdr_components(df, tie) if components is None else components
    risk = ipdr_risk(df, c).select("subject", "level", "reasons", "score")
    codes = lambda *pairs: F.array_compact(F.array(*[F.when(cond, name) for cond, name in pairs]))
    is_high = lambda n: F.col(f"{n}_level") == "HIGH"
    critical = F.col("level") == "CRITICAL"
    notes = codes(
        (critical, "REVIEW_FIRST"), (critical, "REVIEW_BY_SECOND_PERSON"), (is_high("encryption"), "CHECK_ENCRYPTION"),
        (is_high("data"), "CHECK_UPLOADS"), (is_high("session"), "CHECK_LONG_SESSIONS"), (is_high("app"), "CHECK_APPS"),
        (F.array_contains("reasons", "ENCRYPTION_AND_UPLOADS"), "COMPARE_UPLOAD_TIMES"),
        (F.array_contains("reasons", "SESSIONS_AND_APPS"), "COMPARE_SESSIONS_AND_APPS"))
    return c.join(risk, "subject").select(
        "subject", "score",
        codes((F.col("encrypted_pct") > 60, "ENCRYPTED_SHARE"), (F.col("odd_encrypted") > 20, "ODD_HOUR_ENCRYPTED")).alias("encryption_factors"),
        codes((F.col("large_uploads") > 5, "LARGE_UPLOADS"), (F.col("ratio") > 2.0, "UPLOAD_RATIO")).alias("data_factors"),
        codes((F.col("marathons") > 5, "MARATHONS"), (F.col("concurrent_pairs") > 5, "CONCURRENT")).alias("session_factors"),
        codes((F.col("high_risk_apps") > 0, "HIGH_RISK_APPS"), (F.col("unknown_ports") > 10, "UNKNOWN_APPS")).alias("app_factors"),
        F.slice(notes, 1, 5).alias("notes"))


def ipdr_overview(df: DataFrame, components: DataFrame | None = None, tie: Sequence[str] = TIE) -> DataFrame:
    """Totals across subjects in long form ``(section, item, value)``."""
    c = ipdr_components(df, tie) if components is None else components
    row = lambda section, item, value: (F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    apps = app_usage(df).groupBy("app").agg(F.sum("sessions").alias("n"))
    ports = unknown_ports(df).groupBy("destination_port").agg(F.sum("sessions").alias("n")).orderBy(F.desc("n"), "destination_port").limit(5)
    names = list(WEIGHTS)
    means = c.agg(*[F.avg(f"{n}_score").alias(n) for n in names], *[count_if(F.col(f"{n}_level") == "HIGH").alias(f"{n}_high") for n in names])
    stack = lambda suffix: F.inline(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n + suffix).cast("double").alias("value")) for n in names]))
    spiking = encryption_spikes(df).agg(F.count_distinct("subject").alias("n"))
    spikes = upload_spikes(df).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    volume = df.agg((F.sum(F.col("data_volume_up").cast("double")) / F.sum(F.col("data_volume_down").cast("double"))).alias("v"))
    longest = marathon_sessions(df, tie=tie).orderBy(F.desc("hours"), "subject", *tie).limit(5)
    parts = [
        apps.select(*row("app_sessions", F.col("app"), F.col("n"))),
        ports.select(*row("unknown_port_sessions", F.col("destination_port"), F.col("n"))),
        means.select(F.lit("component_mean").alias("section"), stack("")),
        means.select(F.lit("component_high").alias("section"), stack("_high")),
        spiking.filter("n > 2").select(*row("co_spiking_subjects", F.lit("all"), F.col("n"))),
        spikes.select(*row("upload_spikes", F.col("day"), F.col("n"))),
        volume.select(*row("up_down_ratio", F.lit("all"), F.col("v"))),
        longest.select(*row("longest_hours", F.concat_ws("/", "subject", F.col(tie[0]).cast("string")), F.col("hours"))),
    ]
    return reduce(DataFrame.unionByName, parts)
