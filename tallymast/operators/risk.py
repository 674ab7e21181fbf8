"""Rule-based scores over the indicator table of :func:`tallymast.operators.cdr.cdr_patterns`.

The scores are unvalidated heuristics to be looked at by people; no automatic decision should
rest on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import count_if, level, points
from ..session import kept


def _codes(*pairs):
    return F.array_compact(F.array(*[F.when(cond, name) for cond, name in pairs]))


def cdr_risk_weighted(p: DataFrame, odd_over: float = 3.0) -> DataFrame:
    """Weighted score: device switching .40, odd hours .25 per ten percent above the threshold,
    voice only .20, any burst .15; times 100, at most 100."""
    odd = F.col("odd_pct") > odd_over
    raw = (F.when(F.col("device_switching"), 0.40).otherwise(0.0) + F.when(odd, F.lit(0.25) * F.col("odd_pct") / 10).otherwise(0.0)
           + F.when(F.col("voice_only"), 0.20).otherwise(0.0) + F.when(F.col("bursts") > 0, 0.15).otherwise(0.0))
    score = F.least(raw * 100, F.lit(100.0))
    return p.select("subject", score.alias("score"), level((score >= 70, "HIGH"), (score >= 40, "MEDIUM")).alias("level"),
                    _codes((F.col("device_switching"), "SEVERAL_DEVICES"), (odd, "ODD_HOURS"), (F.col("voice_only"), "VOICE_ONLY"), (F.col("bursts") > 0, "BURSTS")).alias("factors"))


def cdr_risk_components(p: DataFrame, mode: str = "as_coded") -> DataFrame:
    """Seven-component score.

    ``as_coded`` keeps the terms that can never be reached at zero (F8); ``documented`` adds
    them: repeated durations, rapid cell changes without hopping, and the network terms from
    ``direct_links`` and ``common_contacts`` where the input has these columns.
    """
    c = F.col
    device = points((c("imei_count") >= 2, 25), (c("sim_swap"), 10))
    temporal = points((c("odd_pct") > 4, 20), (c("odd_pct") > 2, 15), (c("odd_pct") > 1, 10)) + points((c("bursts") > 3, 5))
    talk = points((c("voice_only"), 20), (c("voice_pct") > 90, 15))
    frequency = points((c("high_frequency_contacts") > 3, 15), (c("high_frequency_contacts") > 0, 10))
    place = points((c("tower_hopping"), 10))
    network = F.lit(0)
    extra = []
    if mode == "documented":
        talk = talk + points((c("repeated_durations") > 0, 5))
        place = points((c("tower_hopping"), 10), (c("rapid_changes") > 2, 8))
        extra = [(c("repeated_durations") > 0, "REPEATED_DURATIONS")]
        if {"direct_links", "common_contacts"} <= set(p.columns):
            network = points((c("direct_links") > 0, 10), (c("common_contacts") >= 3, 5))
            extra += [(c("direct_links") > 0, "DIRECT_LINKS"), (c("common_contacts") >= 3, "COMMON_CONTACTS")]
    elif mode != "as_coded":
        raise ValueError(f"unknown mode {mode!r}")
    habit = points((c("activity_change") != "NONE", 10))
    parts = {"device": device, "temporal": temporal, "communication": talk, "frequency": frequency, "location": place, "behaviour": habit, "network": network}
    score = reduce(lambda a, b: a + b, parts.values())
    base = level((score >= 70, "CRITICAL"), (score >= 50, "HIGH"), (score >= 30, "MEDIUM"))
    lifted = (c("imei_count") >= 2) & (base == "LOW")
    return p.select(
        "subject", *[v.alias(f"{k}_risk") for k, v in parts.items()], score.alias("score"), F.when(lifted, "MEDIUM").otherwise(base).alias("level"),
        _codes((lifted, "LIFTED_BY_DEVICES"), (c("imei_count") >= 3, "MANY_DEVICES"), (c("imei_count") == 2, "TWO_DEVICES"), ((c("imei_count") < 2) & c("sim_swap"), "SIM_SWAP"),
               (c("odd_pct") > 1, "ODD_HOURS"), (c("bursts") > 3, "BURSTS"), (c("voice_only"), "VOICE_ONLY"), (~c("voice_only") & (c("voice_pct") > 90), "VOICE_HEAVY"),
               (c("high_frequency_contacts") > 0, "FREQUENT_CONTACTS"), (c("tower_hopping"), "TOWER_HOPPING"), (c("activity_change") != "NONE", "ACTIVITY_CHANGE"), *extra).alias("factors"))


def cdr_risk_report(p: DataFrame) -> DataFrame:
    """Report score: device 40/25, odd hours 25/15, voice 20/10, frequency 15."""
    c = F.col
    score = (points((c("imei_count") >= 3, 40), (c("imei_count") == 2, 25)) + points((c("odd_pct") > 3, 25), (c("odd_pct") > 1, 15))
             + points((c("voice_only"), 20), (c("voice_pct") > 90, 10)) + points((c("high_frequency_contacts") > 0, 15)))
    base = level((score >= 70, "HIGH"), (score >= 40, "MEDIUM"))
    lifted = (c("imei_count") >= 2) & (base == "LOW")
    codes = _codes((lifted, "LIFTED_BY_DEVICES"), (c("imei_count") >= 3, "MANY_DEVICES"), (c("imei_count") == 2, "TWO_DEVICES"), (c("odd_pct") > 3, "ODD_HOURS_HIGH"),
                   (c("odd_pct").between(1.0000001, 3), "ODD_HOURS"), (c("voice_only"), "VOICE_ONLY"), (~c("voice_only") & (c("voice_pct") > 90), "VOICE_HEAVY"),
                   (c("high_frequency_contacts") > 0, "FREQUENT_CONTACTS"))
    return p.select("subject", score.alias("score"), F.when(lifted, "MEDIUM").otherwise(base).alias("level"), F.slice(codes, 1, 3).alias("primary_indicators"))


def critical_anomalies(p: DataFrame, odd_over: float = 3.0, odd_high: float = 4.0) -> DataFrame:
    """(subject, anomaly, value, risk) rows."""
    c = F.col
    row = lambda name, value, risk: F.struct(F.lit(name).alias("anomaly"), value.cast("double").alias("value"), risk.alias("risk"))
    return p.select("subject", F.explode(F.array_compact(F.array(
        F.when(c("imei_count") >= 2, row("DEVICE_SWITCHING", c("imei_count"), F.when(c("imei_count") >= 3, "HIGH").otherwise("MEDIUM"))),
        F.when(c("odd_pct") > odd_over, row("ODD_HOUR_ACTIVITY", c("odd_pct"), F.when(c("odd_pct") > odd_high, "HIGH").otherwise("MEDIUM"))),
        F.when(c("voice_only"), row("VOICE_ONLY", F.lit(100), F.lit("HIGH")))))).alias("r")).select("subject", "r.*")


def rank_subjects(r: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` highest scores in order; a top-k, so no global sort of all subjects."""
    top = r.orderBy(F.desc("score"), "subject").limit(k)
    w = Window.orderBy(F.desc("score"), "subject")  # over at most k rows
    return top.select(F.row_number().over(w).alias("rank"), "subject", "score", "level")


def priority_list(r: DataFrame, k: int = 3) -> DataFrame:
    """The first ``k`` HIGH subjects with follow-up codes from their indicators."""
    top = r.filter("level = 'HIGH'").orderBy(F.desc("score"), "subject").limit(k)
    has = lambda *names: reduce(lambda a, b: a | b, [F.array_contains("primary_indicators", n) for n in names])
    return top.select("subject", "score", _codes((has("MANY_DEVICES", "TWO_DEVICES"), "CHECK_DEVICES"), (has("ODD_HOURS_HIGH", "ODD_HOURS"), "CHECK_NIGHT_ACTIVITY"),
                                                 (has("VOICE_ONLY", "VOICE_HEAVY"), "CHECK_CALLS"), (has("FREQUENT_CONTACTS"), "CHECK_CONTACTS")).alias("follow_up"))


def risk_distribution(r: DataFrame) -> DataFrame:
    return r.groupBy("level").agg(F.count(F.lit(1)).alias("subjects"), F.avg("score").alias("mean_score"))


def risk_details(r: DataFrame, from_score: float = 30) -> DataFrame:
    return r.filter((F.col("score") >= from_score) | (F.col("level") != "LOW"))


def correlation_summary(counts: DataFrame, pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """Report table of the correlations: scores with counts, and totals of the cross-subject ones."""
    from .correlate import correlation_score

    s = correlation_score(counts).select("subject", F.col("score").cast("double").alias("score"), "encrypted_after_call", "silent_mb")
    rows = s.select(F.lit("subject").alias("section"), F.col("subject").alias("item"), "score", F.col("encrypted_after_call").cast("double").alias("encrypted_after_call"), "silent_mb")
    none = F.lit(None).cast("double")
    total = lambda df, name: df.agg(F.count(F.lit(1)).cast("double").alias("score")).select(F.lit("total").alias("section"), F.lit(name).alias("item"), "score", none.alias("encrypted_after_call"), none.alias("silent_mb"))
    high = s.agg(count_if(F.col("score") >= 70).cast("double").alias("score")).select(F.lit("total").alias("section"), F.lit("high_risk").alias("item"), "score", none.alias("encrypted_after_call"), none.alias("silent_mb"))
    return rows.unionByName(total(pairs, "coordinated_events")).unionByName(total(chains, "chains")).unionByName(high)


def load_summary(c: DataFrame, i: DataFrame, t: DataFrame) -> DataFrame:
    """Records, parties and range of every source."""
    one = lambda name, df, party, ts: df.agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(party).alias("parties"), F.min(ts).alias("first_record"), F.max(ts).alias("last_record")).select(
        F.lit(name).alias("source"), "records", "parties", "first_record", "last_record")
    return one("cdr", c, "subject", "datetime").unionByName(one("ipdr", i, "subject", "start_time")).unionByName(one("tower", t, "mobile_number", "timestamp"))


def flag_rows(c: DataFrame, cycles: DataFrame | None = None, sync: DataFrame | None = None, areas: DataFrame | None = None) -> DataFrame:
    """(family, flag, level, subject) for the concerns of every call-record family.

    The calls are read by many parts, so what these need is kept; the flags of one table come from one
    pass over it."""
    from . import cdr, location

    c = kept(c, ["subject", "a_party", "b_party", "datetime", "duration_seconds", "call_type", "imei", "imsi", "lat", "lon", "is_provider_message", *cdr.TIE], "calls")

    def flags(df, family, *pairs):
        """Of a table with a row per subject: (flag, condition, level column if there is one)."""
        each = [F.when(F.expr(cond), F.struct(F.lit(flag).alias("flag"), F.col(lvl[0]).alias("level") if lvl else F.lit("NONE").alias("level"))) for flag, cond, *lvl in pairs]
        return df.select("subject", F.inline(F.array_compact(F.array(*each)))).select(F.lit(family).alias("family"), "flag", "level", "subject")

    any_row = lambda df, family, flag: df.select("subject").distinct().select(F.lit(family).alias("family"), F.lit(flag).alias("flag"), F.lit("NONE").alias("level"), "subject")
    bursts = cdr.call_bursts(c, mode="skip").groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        flags(cdr.device_profile(c), "device", ("DEVICE_LEVEL", "level <> 'LOW'", "level"), ("SIM_SWAP", "sim_swap")),
        flags(cdr.odd_hours(c), "temporal", ("ODD_HOURS", "level <> 'LOW'", "level")),
        flags(cdr.pattern_days(c), "temporal", ("DAY_CONCENTRATION", "concentration <> 'LOW'", "concentration")),
        flags(bursts, "temporal", ("MANY_BURSTS", "n > 3")), any_row(cdr.silent_periods(c, limit=None), "temporal", "SILENCE"),
        flags(cdr.communication_profile(c, cycles), "communication", ("COMMUNICATION_LEVEL", "level <> 'LOW'", "level"), ("VOICE_ONLY", "voice_only"),
              ("REPEATED_DURATIONS", "repeated_durations > 0"), ("DOMINANT_CONTACT", "dominant_contact"), ("LOOPS", "cycles > 0"), ("SIGNALLING", "signalling")),
        any_row(location.impossible_travel(c, limit=None), "location", "IMPOSSIBLE_TRAVEL"), any_row(location.near_areas(c, areas), "location", "NEAR_AREA"),
        any_row(location.location_clusters(c, k=None), "location", "CLUSTERS")]
    if sync is not None:
        parts.append(any_row(sync.filter("subjects >= 3").withColumnRenamed("anchor", "subject"), "network", "COORDINATED"))
    return reduce(DataFrame.unionByName, parts)


def flag_summary(flags: DataFrame) -> DataFrame:
    """How many subjects carry each flag; the subjects themselves are in :func:`flag_rows`."""
    return flags.groupBy("family", "flag", "level").agg(F.count(F.lit(1)).alias("subjects"))
