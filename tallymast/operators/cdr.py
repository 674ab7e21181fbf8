"""Call records: devices, time of day, communication, frequency, behaviour.

All operators leave provider messages out first and return one row per subject unless said
otherwise.  The levels are heuristics over behaviour, not findings about people.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions.scalar import count_if, day_name, is_weekend, level, mask_last4, odd_hour, pct, seconds_between, us
from ..plans.folds import keep_skipping, keep_spaced
from ..plans.joins import band_join
from ..plans.shards import count_ahead, neighbours, row_numbers
from ..session import cut_lineage

TIE = ("event_id",)


def people(df: DataFrame) -> DataFrame:
    """Records between people: provider messages removed."""
    return df.filter(~F.col("is_provider_message"))


def voice(df: DataFrame) -> DataFrame:
    return people(df).filter(F.col("call_type").isin(tables.VOICE_TYPES))


def top_k(df: DataFrame, key: Sequence[str], order: Sequence, k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark limits each map partition before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


# -- devices -----------------------------------------------------------------------------

def device_profile(df: DataFrame, switching: int = 3) -> DataFrame:
    """Distinct IMEI and IMSI per subject; HIGH from ``switching`` IMEIs, MEDIUM at two."""
    return (
        people(df).groupBy("subject")
        .agg(F.array_sort(F.collect_set("imei")).alias("imeis"), F.array_sort(F.collect_set("imsi")).alias("imsis"))
        .select(
            "subject", "imeis", "imsis",
            F.size("imeis").alias("imei_count"), F.size("imsis").alias("imsi_count"),
            (F.size("imeis") >= switching).alias("device_switching"),
            (F.size("imsis") > 1).alias("sim_swap"),
            level((F.size("imeis") >= switching, "HIGH"), (F.size("imeis") == 2, "MEDIUM")).alias("level"),
        )
    )


def device_changes(df: DataFrame, limit: int = 10, tie: Sequence[str] = TIE) -> DataFrame:
    """First ``limit`` changes of the last known IMEI (null readings are passed over)."""
    known = people(df).filter(F.col("imei").isNotNull()).select("subject", "datetime", "imei", *tie)
    steps = neighbours(known, ["subject"], "datetime", prev={"from_imei": "imei"}, tie=tie)
    changed = steps.filter(F.col("from_imei") != F.col("imei"))
    return top_k(changed, ["subject"], ["datetime", *tie], limit, "change_no").select(
        "subject", "change_no", "datetime", "from_imei", F.col("imei").alias("to_imei")
    )


# -- time of day -------------------------------------------------------------------------

def odd_hours(df: DataFrame, odd: tuple[int, int] = (0, 5), high: float = 3.0, medium: float = 1.0) -> DataFrame:
    out = people(df).groupBy("subject").agg(
        F.count(F.lit(1)).alias("total"), count_if(odd_hour("datetime", *odd)).alias("odd_calls")
    )
    share = pct(F.col("odd_calls"), F.col("total"))
    return out.select("*", share.alias("odd_pct"), level((share > high, "HIGH"), (share > medium, "MEDIUM")).alias("level"))


def pattern_days(df: DataFrame, days: Sequence[str] = tables.PATTERN_DAYS, high: float = 40, medium: float = 25) -> DataFrame:
    """Share of the given weekdays, summed into a concentration level."""
    out = people(df).groupBy("subject").agg(
        F.count(F.lit(1)).alias("total"),
        *[count_if(day_name("datetime") == d).alias(f"{d.lower()}_calls") for d in days],
    )
    both = sum((F.col(f"{d.lower()}_calls") for d in days[1:]), F.col(f"{days[0].lower()}_calls"))
    share = pct(both, F.col("total"))
    return out.select(
        "*", *[pct(F.col(f"{d.lower()}_calls"), F.col("total")).alias(f"{d.lower()}_pct") for d in days],
        share.alias("pattern_pct"),
        level((share > high, "HIGH"), (share > medium, "MEDIUM")).alias("concentration"),
    )


def hourly_profile(df: DataFrame) -> DataFrame:
    """(subject, hour) counts; ``peak_rank`` 1-3 are the peak hours, ties to the lower hour."""
    hours = people(df).groupBy("subject", F.hour("datetime").alias("hour")).agg(F.count(F.lit(1)).alias("calls"))
    w = Window.partitionBy("subject").orderBy(F.desc("calls"), "hour")
    return hours.withColumn("peak_rank", F.row_number().over(w))


def burst_candidates(df: DataFrame, minutes: int = 15, least: int = 5, tie: Sequence[str] = TIE) -> DataFrame:
    """Every call with at least ``least`` calls of the subject in the ``minutes`` from it on."""
    rows = people(df).select("subject", "datetime", *tie)
    return count_ahead(rows, ["subject"], "datetime", minutes * 60_000_000, "calls").filter(F.col("calls") >= least)


def _burst_contacts(bursts: DataFrame, df: DataFrame, span_us: int, listed: int) -> DataFrame:
    """Distinct contacts inside each kept burst, the first ``listed`` by appearance.  There are
    only a few kept bursts per subject, so the join adds few rows."""
    rows = people(df).select("subject", F.col("datetime").alias("call_time"), "b_party")
    inside = band_join(bursts.select("subject", "datetime"), rows, ["subject"], "datetime", "call_time", 0, span_us)
    firsts = inside.groupBy("subject", "datetime", "b_party").agg(F.min("call_time").alias("seen"))
    w = Window.partitionBy("subject", "datetime").orderBy("seen", "b_party")
    ranked = firsts.withColumn("_n", F.row_number().over(w))
    lists = ranked.groupBy("subject", "datetime").agg(
        F.count("b_party").alias("unique_contacts"),
        F.array_sort(F.collect_list(F.when(F.col("_n") <= listed, F.struct("_n", "b_party")))).alias("_list"),
    )
    lists = lists.select("subject", "datetime", "unique_contacts", F.col("_list.b_party").alias("contacts"))
    return bursts.join(lists, ["subject", "datetime"], "left")


def call_bursts(
    df: DataFrame, mode: str = "spaced", minutes: int = 15, least: int = 5, limit: int | None = None,
    tie: Sequence[str] = TIE,
) -> DataFrame:
    """Call bursts in one of the two definitions in use (F4).

    ``spaced``: a burst is kept if it starts at least 300 s after every kept one; first 10.
    ``skip``: after a burst of n calls the scan goes on n calls later; first 5; ``suspicious``
    if it has one contact only.
    """
    span = minutes * 60_000_000
    if mode == "spaced":
        found = burst_candidates(df, minutes, least, tie)
        kept = keep_spaced(found, "subject", "datetime", 300_000_000, limit or 10, tie)
    elif mode == "skip":
        numbered = row_numbers(people(df).select("subject", "datetime", *tie), ["subject"], "datetime", tie)
        found = count_ahead(numbered, ["subject"], "datetime", span, "calls").filter(F.col("calls") >= least)
        kept = keep_skipping(found, "subject", "datetime", "rn", "calls", span, limit or 5)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    kept = kept.select("subject", "datetime", "calls")
    return _burst_contacts(kept, df, span, 5).select(
        "subject", F.col("datetime").alias("start"), "calls", "unique_contacts", "contacts",
        (F.col("unique_contacts") == 1).alias("suspicious"),
    )


def silent_periods(df: DataFrame, hours: float = 48, high: float = 72, limit: int | None = 5, tie: Sequence[str] = TIE) -> DataFrame:
    """Gaps to the next record longer than ``hours``; the first ``limit`` of a subject."""
    rows = people(df).select("subject", "datetime", *tie)
    steps = neighbours(rows, ["subject"], "datetime", next={"resumed": "datetime"}, tie=tie)
    gap = seconds_between("resumed", "datetime") / 3600
    gaps = steps.filter(gap > hours).select(
        "subject", F.col("datetime").alias("silent_from"), F.col("resumed").alias("silent_to"),
        gap.alias("gap_hours"), level((gap > high, "HIGH"), default="MEDIUM").alias("severity"),
    )
    return gaps if limit is None else top_k(gaps, ["subject"], ["silent_from"], limit, "_n").drop("_n")


# -- communication -----------------------------------------------------------------------

def voice_sms_profile(df: DataFrame, min_voice: int = 0) -> DataFrame:
    """Voice/SMS split.  ``min_voice`` 0 and 10 are the two voice-only definitions in use (F4)."""
    kind = F.col("call_type")
    is_voice, is_sms = kind.isin(tables.VOICE_TYPES), kind.isin(tables.SMS_TYPES)
    out = people(df).groupBy("subject").agg(
        F.count(F.lit(1)).alias("total"), count_if(is_voice).alias("voice_calls"), count_if(is_sms).alias("sms"),
        *[count_if(kind == t).alias(t.lower().replace("-", "_")) for t in tables.CALL_TYPES],
        F.avg(F.when(is_voice, F.col("duration_seconds"))).alias("avg_voice_seconds"),
    )
    both = F.col("voice_calls") + F.col("sms")
    share = pct(F.col("voice_calls"), both)
    only = (F.col("sms") == 0) & (F.col("voice_calls") > min_voice)
    return out.select(
        "*", share.alias("voice_pct"), pct(F.col("sms"), both).alias("sms_pct"), only.alias("voice_only"),
        level((only, "HIGH"), (share > 90, "MEDIUM")).alias("level"),
    )


def repeated_durations(df: DataFrame, more_than: int = 3, k: int | None = 5) -> DataFrame:
    """Voice durations that occur more than ``more_than`` times, top ``k`` of a subject (F4:
    3 and 5, or 5 and 3) or all of them, without rank."""
    counts = voice(df).filter(F.col("duration_seconds").isNotNull()).groupBy("subject", "duration_seconds").agg(
        F.count(F.lit(1)).alias("times")
    )
    often = counts.filter(F.col("times") > more_than)
    return often if k is None else top_k(often, ["subject"], [F.desc("times"), "duration_seconds"], k)


def listed(df: DataFrame, counts: dict[str, int], full: bool) -> DataFrame:
    """Cuts count columns at the length of the reference's lists; ``full`` adds the whole counts as
    ``all_...``."""
    every = {c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
    whole = {f"all_{c}": n for c, n in every.items()} if full else {}
    return df.withColumns(whole | {c: F.least(n, F.lit(counts[c])) for c, n in every.items()})


def contact_counts(df: DataFrame) -> DataFrame:
    """Calls per (subject, contact)."""
    return people(df).filter(F.col("b_party").isNotNull()).groupBy("subject", "b_party").agg(
        F.count(F.lit(1)).alias("calls")
    )


def contact_frequency(df: DataFrame, frequent: int = 20, k: int = 10) -> DataFrame:
    """Contact statistics, the top ``k`` contacts and the number with more than ``frequent`` calls."""
    per = contact_counts(df)
    stats = per.groupBy("subject").agg(
        F.count(F.lit(1)).alias("contacts"), F.max("calls").alias("max_calls"), F.avg("calls").alias("mean_calls"),
        count_if(F.col("calls") > frequent).alias("high_frequency_contacts"),
        count_if(F.col("calls") == 1).alias("single_call_contacts"),
    )
    top = top_k(per, ["subject"], [F.desc("calls"), "b_party"], k).groupBy("subject").agg(
        F.array_sort(F.collect_list(F.struct("rank", "b_party"))).alias("_top")
    )
    return stats.join(top, "subject").select(*stats.columns, F.col("_top.b_party").alias("top_contacts"))


def top_contacts(df: DataFrame, k: int = 5, dominant: float = 30.0) -> DataFrame:
    """Top ``k`` contacts with their share of all records of the subject, masked to four digits."""
    per = contact_counts(df)
    totals = people(df).groupBy("subject").agg(F.count(F.lit(1)).alias("total"))
    share = pct(F.col("calls"), F.col("total"))
    return (
        top_k(per, ["subject"], [F.desc("calls"), "b_party"], k).join(totals, "subject")
        .select("subject", "rank", mask_last4("b_party").alias("contact"), "calls", share.alias("share_pct"),
                ((F.col("rank") == 1) & (share > dominant)).alias("dominant"))
    )


def one_ring(df: DataFrame, seconds: int = 3, k: int = 5, signals: int = 3, within: int = 300,
             null_duration_as_zero: bool = True, tie: Sequence[str] = TIE) -> DataFrame:
    """Very short voice calls: how many, whether one of the top contacts got at least
    ``signals`` of them, and how many follow each other in less than ``within`` seconds.

    Deviation F24: whether a missing duration counts as zero is a parameter.
    """
    length = F.coalesce("duration_seconds", F.lit(0)) if null_duration_as_zero else F.col("duration_seconds")
    short = voice(df).filter(length <= seconds).select("subject", "datetime", "b_party", *tie)
    totals = people(df).groupBy("subject").agg(F.count(F.lit(1)).alias("total"))
    per = short.groupBy("subject", "b_party").agg(F.count(F.lit(1)).alias("n"))
    contacts = top_k(per, ["subject"], [F.desc("n"), "b_party"], k).groupBy("subject").agg(
        count_if(F.col("n") >= signals).alias("signal_contacts")
    )
    steps = neighbours(short, ["subject"], "datetime", next={"after": "datetime"}, tie=tie)
    pairs = steps.groupBy("subject").agg(
        F.count(F.lit(1)).alias("one_rings"),
        count_if(seconds_between("after", "datetime") < within).alias("rapid_pairs"),
    )
    out = totals.join(pairs, "subject", "left").join(contacts, "subject", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "subject", "total", zero("one_rings").alias("one_rings"), pct(zero("one_rings"), F.col("total")).alias("one_ring_pct"),
        zero("signal_contacts").alias("signal_contacts"), zero("rapid_pairs").alias("rapid_pairs"),
        (zero("signal_contacts") > 0).alias("signalling"),
    )


def distinct_links(df: DataFrame, min_calls: int = 1) -> DataFrame:
    """Directed caller -> callee links with at least ``min_calls`` calls; self-links and provider
    messages left out."""
    links = people(df).select(F.col("a_party").alias("src"), F.col("b_party").alias("dst")).filter("src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("calls")).filter(F.col("calls") >= min_calls).drop("calls")


def call_cycles(links: DataFrame, shortest: int = 3, longest: int = 5) -> DataFrame:
    """Directed simple cycles of ``shortest`` to ``longest`` parties, one per party set.

    Every cycle is found from its smallest party only.  Before the joins, links that cannot
    lie on a cycle (an end without an outgoing or an incoming link) fall away.
    """
    e = cut_lineage(links.select("src", "dst").filter("src <> dst").distinct())
    e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    e = cut_lineage(e)  # read for every step of the paths
    hop = e.select(F.col("src").alias("tail"), F.col("dst").alias("nxt"))
    closing = e.select(F.col("src").alias("tail"), F.col("dst").alias("anchor"))
    paths = e.filter("src < dst").select(F.array("src", "dst").alias("path"), F.col("src").alias("anchor"), F.col("dst").alias("tail"))
    found = None
    for length in range(3, longest + 1):
        paths = (
            paths.join(hop, "tail").filter((F.col("nxt") > F.col("anchor")) & ~F.array_contains("path", F.col("nxt")))
            .select(F.array_append("path", F.col("nxt")).alias("path"), "anchor", F.col("nxt").alias("tail"))
        )
        if length >= shortest:
            closed = paths.join(closing, ["tail", "anchor"], "left_semi").select("path")
            found = closed if found is None else found.unionByName(closed)
    return (
        found.groupBy(F.array_sort("path").alias("members")).agg(F.min("path").alias("path"))
        .select("members", "path", F.size("path").alias("length"))
    )


def communication_profile(df: DataFrame, cycles: DataFrame | None = None, min_voice: int = 10, full: bool = False) -> DataFrame:
    """Level from voice-only use, cycles, voice share, dominant contact and signalling.

    ``repeated_durations`` stops at 3 as the reference's list does; ``full`` adds
    ``all_repeated_durations``.
    ``cycles`` may be passed in (from :func:`call_cycles`) because they are costly on a dense graph.
    """
    split = voice_sms_profile(df, min_voice).select("subject", "total", "voice_calls", "sms", "voice_pct", "voice_only")
    repeated = repeated_durations(df, 5, None).groupBy("subject").agg(F.count(F.lit(1)).alias("repeated_durations"))
    dominant = top_contacts(df, 1).filter("dominant").select("subject", F.lit(True).alias("dominant_contact"))
    signals = one_ring(df).filter("signalling").select("subject", F.lit(True).alias("signalling"))
    cycles = call_cycles(distinct_links(df)) if cycles is None else cycles
    looped = cycles.select(F.explode("members").alias("subject")).groupBy("subject").agg(F.count(F.lit(1)).alias("cycles"))
    out = split
    for part in (repeated, dominant, signals, looped):
        out = out.join(part, "subject", "left")
    out = listed(out, {"repeated_durations": 3}, full)
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        *split.columns, "repeated_durations", no("dominant_contact").alias("dominant_contact"),
        no("signalling").alias("signalling"), zero("cycles").alias("cycles"),
        level(
            (F.col("voice_only") | (zero("cycles") > 0), "HIGH"),
            ((F.col("voice_pct") > 90) | no("dominant_contact") | no("signalling"), "MEDIUM"),
        ).alias("level"),
        *(["all_repeated_durations"] if full else []),
    )


# -- behaviour ---------------------------------------------------------------------------

def daily_counts(df: DataFrame) -> DataFrame:
    return people(df).groupBy("subject", F.to_date("datetime").alias("day")).agg(F.count(F.lit(1)).alias("calls"))


def daily_activity(df: DataFrame, recent: int = 7, spike: float = 2.0, drop: float = 0.5) -> DataFrame:
    """Calls per active day, and the mean of the last ``recent`` active days against the whole."""
    days = daily_counts(df)
    w = Window.partitionBy("subject").orderBy(F.desc("day"))
    out = days.withColumn("_n", F.row_number().over(w)).groupBy("subject").agg(
        F.count(F.lit(1)).alias("active_days"), F.avg("calls").alias("mean_daily"), F.max("calls").alias("max_daily"),
        F.min("calls").alias("min_daily"), F.stddev_samp("calls").alias("sd_daily"),
        F.avg(F.when(F.col("_n") <= recent, F.col("calls"))).alias("recent_mean"),
    )
    long_enough = F.col("active_days") > recent
    return out.select("*", F.when(long_enough & (F.col("recent_mean") > F.col("mean_daily") * spike), "SPIKE")
                      .when(long_enough & (F.col("recent_mean") < F.col("mean_daily") * drop), "DROP")
                      .otherwise("NONE").alias("change"))


def weekend_split(df: DataFrame) -> DataFrame:
    out = people(df).groupBy("subject").agg(
        F.count(F.lit(1)).alias("total"), count_if(is_weekend("datetime")).alias("weekend_calls")
    )
    return out.select("subject", "weekend_calls", (F.col("total") - F.col("weekend_calls")).alias("weekday_calls"),
                      pct(F.col("weekend_calls"), F.col("total")).alias("weekend_pct"))


def cdr_patterns(df: DataFrame, tie: Sequence[str] = TIE, full: bool = False) -> DataFrame:
    """All pattern indicators of a subject in one row: the input of the risk scores.

    The indicators that are plain aggregates come from one pass over the records; only those
    with another grouping or an order have passes of their own.  ``bursts``, ``repeated_durations``
    and ``rapid_changes`` stop at 10, 5 and 10 as the reference's lists do, which the scores
    need; ``full`` adds ``all_bursts``, ``all_repeated_durations`` and ``all_rapid_changes``.
    """
    from .location import rapid_cell_changes

    kind, when = F.col("call_type"), "datetime"
    rows = people(df)
    base = rows.groupBy("subject").agg(
        F.count_distinct("imei").alias("imei_count"), F.count_distinct("imsi").alias("imsi_count"), F.count_distinct("first_cell").alias("tower_count"),
        F.count(F.lit(1)).alias("total"), count_if(odd_hour(when)).alias("_odd"), count_if(day_name(when).isin(tables.PATTERN_DAYS)).alias("_days"),
        count_if(kind.isin(tables.VOICE_TYPES)).alias("_voice"), count_if(kind.isin(tables.SMS_TYPES)).alias("_sms"), count_if(is_weekend(when)).alias("_weekend"),
        F.coalesce(F.bool_or(F.col("first_cell") != F.col("last_cell")), F.lit(False)).alias("tower_hopping"))
    share = lambda c, name: pct(F.col(c), F.col("total")).alias(name)
    base = base.select(
        "subject", "imei_count", "imsi_count", (F.col("imei_count") >= 3).alias("device_switching"), (F.col("imsi_count") > 1).alias("sim_swap"), "total",
        share("_odd", "odd_pct"), share("_days", "pattern_pct"), share("_weekend", "weekend_pct"), pct(F.col("_voice"), F.col("_voice") + F.col("_sms")).alias("voice_pct"),
        ((F.col("_sms") == 0) & (F.col("_voice") > 0)).alias("voice_only"), "tower_count", "tower_hopping")
    bursts = keep_spaced(burst_candidates(df, tie=tie), "subject", "datetime", 300_000_000, None if full else 10, tie).groupBy("subject").agg(F.count(F.lit(1)).alias("bursts"))
    repeated = repeated_durations(df, k=None).groupBy("subject").agg(F.count(F.lit(1)).alias("repeated_durations"))
    freq = contact_counts(df).groupBy("subject").agg(
        F.count(F.lit(1)).alias("contacts"), count_if(F.col("calls") > 20).alias("high_frequency_contacts"), count_if(F.col("calls") == 1).alias("single_call_contacts"))
    rapid = rapid_cell_changes(df, limit=None, tie=tie).groupBy("subject").agg(F.count(F.lit(1)).alias("rapid_changes"))
    daily = daily_activity(df).select("subject", "active_days", F.col("change").alias("activity_change"))
    out = base
    for part in (bursts, repeated, freq, rapid, daily):
        out = out.join(part, "subject", "left")
    out = out.fillna(0, ["high_frequency_contacts", "single_call_contacts", "contacts"])
    return listed(out, {"bursts": 10, "repeated_durations": 5, "rapid_changes": 10}, full)
