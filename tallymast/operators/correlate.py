"""Calls against data sessions of the same subject.

Calls carry ``subject, datetime, duration_seconds, b_party``; sessions are the output of
:func:`tallymast.operators.ipdr.with_session_features`."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import count_if, level, seconds_between, us
from ..plans.joins import band_join, made_in_tasks, one_after_other, point_in_interval
from ..plans.shards import neighbours
from ..session import cut_lineage
from .cdr import TIE

MB = 1048576.0


def with_call_end(c: DataFrame) -> DataFrame:
    return c.withColumn("call_end", F.timestamp_micros(us("datetime") + F.col("duration_seconds") * 1_000_000))


def _sessions(i: DataFrame, tie: Sequence[str]) -> DataFrame:
    return i.select("subject", F.col("start_time").alias("data_start"), F.col("detected_app").alias("app"), "is_encrypted", "session_duration",
                    (F.col("total_data_volume") / MB).alias("mb"), *[F.col(t).alias(f"session_{t}") for t in tie])


def call_to_data(c: DataFrame, i: DataFrame, seconds: int = 300, tie: Sequence[str] = TIE) -> DataFrame:
    """Sessions that start from the end of a call to ``seconds`` after it."""
    calls = with_call_end(c).filter(F.col("call_end").isNotNull()).select("subject", F.col("datetime").alias("call_time"), "call_end", "b_party", *[F.col(t).alias(f"call_{t}") for t in tie])
    out = band_join(calls, _sessions(i, tie), ["subject"], "call_end", "data_start", 0, seconds * 1_000_000)
    gap = us("data_start") - us("call_end")
    return out.select("*", (gap / 1e6).alias("gap_seconds"), level((F.col("is_encrypted") & (gap < 60_000_000), "HIGH"), (F.col("mb") > 10, "MEDIUM")).alias("risk"))


def _encrypted_risk() -> Column:
    gap = us("data_start") - us("call_end")
    return level((gap < 60_000_000, "CRITICAL"), (gap < 180_000_000, "HIGH"), default="MEDIUM")


def encrypted_after_call(k2: DataFrame) -> DataFrame:
    """The encrypted ones among :func:`call_to_data` (five minutes), with their own levels."""
    return k2.filter("is_encrypted").drop("risk").withColumn("risk", _encrypted_risk())


def call_silences(c: DataFrame, hours: float = 2, tie: Sequence[str] = TIE) -> DataFrame:
    """From the end of a call to the start of the next, if longer than ``hours``."""
    rows = with_call_end(c).select("subject", "datetime", "call_end", "b_party", *tie)
    steps = neighbours(rows, ["subject"], "datetime", next={"silent_to": "datetime", "next_party": "b_party"}, tie=tie)
    gap = us("silent_to") - us("call_end")
    return steps.filter(gap > int(hours * 3600e6)).select(
        "subject", F.col("call_end").alias("silent_from"), "silent_to", (gap / 3600e6).alias("hours"), F.col("b_party").alias("last_party"), "next_party")


def data_in_silence(s: DataFrame, i: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    """Session activity inside each silence: a point-in-interval join on cells of six hours, as a silence lasts longer
    than two: few rows each, and few silences in a cell."""
    inside = point_in_interval(_sessions(i, tie), s.select("subject", "silent_from", "silent_to", "hours"), ["subject"], "data_start", "silent_from", "silent_to", 6 * 3_600_000_000)
    out = inside.groupBy("subject", "silent_from", "silent_to", "hours").agg(
        F.count(F.lit(1)).alias("sessions"), count_if(F.col("is_encrypted")).alias("encrypted"), F.coalesce(F.sum("mb"), F.lit(0.0)).alias("mb"),
        F.array_sort(F.collect_set("app")).alias("apps"))
    return out.withColumn("risk", level(((F.col("encrypted") > 5) | (F.col("mb") > 50), "HIGH"), default="MEDIUM"))


def channel_shifts(c: DataFrame, i: DataFrame, more_than: int = 20) -> DataFrame:
    """Days with many sessions and no call, or many calls and no session."""
    calls = c.groupBy("subject", F.to_date("datetime").alias("day")).agg(F.count(F.lit(1)).alias("calls"))
    data = i.groupBy("subject", F.to_date("start_time").alias("day")).agg(F.count(F.lit(1)).alias("sessions"))
    both = calls.join(data, ["subject", "day"], "full_outer").fillna(0, ["calls", "sessions"])
    kind = F.when((F.col("calls") == 0) & (F.col("sessions") > more_than), "VOICE_TO_DATA_SHIFT").when(
        (F.col("calls") > more_than) & (F.col("sessions") == 0), "DATA_TO_VOICE_SHIFT")
    return both.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def subject_counts(subjects: DataFrame, k2: DataFrame, k5: DataFrame | None, k4: DataFrame, k6: DataFrame) -> DataFrame:
    """What the score, the indicators and the amplifiers need, one row per subject.  Without ``k5`` it is counted with
    ``k2``, whose encrypted rows it is: the join behind both is made once."""
    own = [] if k5 is None else [
        k5.groupBy("subject").agg(F.count(F.lit(1)).alias("encrypted_after_call"), count_if(F.col("risk") == "CRITICAL").alias("critical_encrypted"))]
    within = [count_if(F.col("is_encrypted")).alias("encrypted_after_call"), count_if(F.col("is_encrypted") & (_encrypted_risk() == "CRITICAL")).alias("critical_encrypted")]
    parts = [
        k2.groupBy("subject").agg(F.count(F.lit(1)).alias("call_to_data"), count_if(F.col("risk").isin("HIGH", "CRITICAL")).alias("high_call_to_data"), *([] if own else within)),
        *own,
        k4.groupBy("subject").agg(F.count(F.lit(1)).alias("silences"), count_if(F.col("risk") == "HIGH").alias("high_silences"), F.sum("mb").alias("silent_mb")),
        k6.groupBy("subject").agg(F.count(F.lit(1)).alias("shifts"), count_if(F.col("kind") == "VOICE_TO_DATA_SHIFT").alias("voice_to_data"))]
    out = reduce(lambda a, b: a.join(b, "subject", "left"), parts, subjects.select("subject").distinct())
    counts = ("call_to_data", "high_call_to_data", "encrypted_after_call", "critical_encrypted", "silences", "high_silences", "silent_mb", "shifts", "voice_to_data")
    return out.select("subject", *counts).fillna(0)


def correlation_indicators(counts: DataFrame) -> DataFrame:
    """(subject, indicator, risk) rows."""
    return counts.select("subject", F.explode(F.array_compact(F.array(
        F.when(F.col("encrypted_after_call") > 10, F.struct(F.lit("FREQUENT_CALL_TO_ENCRYPTION").alias("indicator"), F.lit("HIGH").alias("risk"))),
        F.when(F.col("silent_mb") > 100, F.struct(F.lit("HEAVY_DATA_DURING_SILENCE").alias("indicator"), F.lit("HIGH").alias("risk"))),
        F.when(F.col("voice_to_data") > 0, F.struct(F.lit("COMMUNICATION_SHIFT").alias("indicator"), F.lit("MEDIUM").alias("risk")))))).alias("i")).select("subject", "i.*")


def correlation_score(counts: DataFrame) -> DataFrame:
    n = lambda c, each, most: F.least(F.col(c) * each, F.lit(most))
    high = (F.col("encrypted_after_call") > 10).cast("int") + (F.col("silent_mb") > 100).cast("int")
    score = F.least(n("high_call_to_data", 5, 25) + n("critical_encrypted", 10, 30) + n("high_silences", 8, 20) + n("shifts", 5, 15) + F.least(high * 5, F.lit(10)), F.lit(100)).cast("int")
    return counts.select("*", score.alias("score"), level((score >= 70, "HIGH"), (score >= 40, "MEDIUM")).alias("level"))


#: Rows of a block and meetings of a cell at most, about, where coincidences are listed pair by pair.
BLOCK_ROWS, CELL_MEETINGS = 500_000, 4_000_000


def _meetings(span: int, batch: int = 1 << 20, *, plain: bool = True):
    """A task's function: from rows (_i, _j, _high, subject, at) cell by cell, the rows (a, b, gap_seconds) of two
    subjects at most ``span`` apart, those that are not ``_high`` against those that are, or in cells of one block
    all among themselves.  Rows of a pair come one after another; some ``batch`` are looked at together.  If not
    ``plain``, subjects come as dictionary arrays.  Nothing of this module is imported in the task."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def pieces(near, far, who, at):
        """(near row, far row) of meetings; ``near`` is in order of subject and time, ``far`` of time."""
        first = np.searchsorted(at[far], at[near] - span, "left")
        count = np.searchsorted(at[far], at[near] + span, "right") - first
        total = int(count.sum())
        if not total:
            return
        if total > batch:
            if who[near[0]] != who[near[-1]]:
                half = int(np.searchsorted(who[near], who[near[len(near) // 2]], "left"))
                half = half or int(np.searchsorted(who[near], who[near[0]], "right"))
                yield from pieces(near[:half], far, who, at)
                yield from pieces(near[half:], far, who, at)
                return
            others = np.unique(who[far])
            if len(others) > 1:
                low = who[far] < others[len(others) // 2]
                yield from pieces(near, far[low], who, at)
                yield from pieces(near, far[~low], who, at)
                return
        until, start = np.cumsum(count), 0
        while start < len(near):  # once, unless one pair alone has more than a batch
            stop = max(start + 1, int(np.searchsorted(until, (until[start - 1] if start else 0) + batch, "right")))
            some = count[start:stop]
            other = far[np.arange(some.sum()) + np.repeat(first[start:stop] - (np.cumsum(some) - some), some)]
            yield np.repeat(near[start:stop], some), other
            start = stop

    def cell(table, alone):
        members = table["subject"].combine_chunks().dictionary_encode()
        order = pc.sort_indices(members.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        people, who = members.dictionary.take(pa.array(order)), place[members.indices.to_numpy(zero_copy_only=False)]
        at, high = table["at"].to_numpy(), table["_high"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        by = np.lexsort((at, who))
        near = by if alone else by[~high[by]]
        far = np.argsort(at, kind="stable")
        far = far if alone else far[high[far]]
        for x, y in pieces(near, far, who, at):
            keep = who[x] < who[y] if alone else who[x] != who[y]
            a, b, gap = who[x[keep]], who[y[keep]], np.abs(at[x[keep]] - at[y[keep]])
            pair = np.minimum(a, b) * len(people) + np.maximum(a, b)
            together = np.argsort(pair)
            pair = pair[together]
            ends = [pa.array(x.astype(np.int32)) for x in (pair // len(people), pair % len(people))]
            a, b = [people.take(x) if plain else pa.DictionaryArray.from_arrays(x, people) for x in ends]
            t = pa.table({"a": a, "b": b, "gap_seconds": gap[together] / 1e6})
            yield from t.to_batches(max_chunksize=100_000)

    def run(batches):
        here, held = None, []
        for batch in batches:
            i, j = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            ends = [*(((i[1:] != i[:-1]) | (j[1:] != j[:-1])).nonzero()[0] + 1), len(i)] if len(i) else []
            start = 0
            for end in ends:
                if held and here != (i[start], j[start]):
                    yield from cell(pa.Table.from_batches(held), here[0] == here[1])
                    held = []
                here = i[start], j[start]
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield from cell(pa.Table.from_batches(held), here[0] == here[1])

    return run


def _by_pair(k5: DataFrame, span: int) -> DataFrame:
    """(a, b, gap_seconds) of what :func:`coordinated_encryption` lists, the rows of two subjects one after another in
    one task.

    Subjects are cut into blocks by hash and each goes to the cells of its block with every other, as many that a
    cell has some ``CELL_MEETINGS`` at most.  What is shuffled is rows times blocks, never a meeting.
    """
    rows = k5.select("subject", us("data_start").alias("at")).filter("subject IS NOT NULL AND at IS NOT NULL")
    rows = cut_lineage(rows)
    near = rows.groupBy(F.floor(F.col("at") / span).alias("_c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # two rows that meet are in one of these stretches of time or in neighbouring ones
    pairs = near.alias("x").join(near.select((F.col("_c") - 1).alias("_c"), F.col("n").alias("_next")), "_c", "left")
    total, meetings = pairs.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * (F.col("n") / 2 + F.coalesce("_next", F.lit(0.0)))), F.lit(0.0))).first()
    blocks = max(1, math.ceil(total / BLOCK_ROWS), math.ceil(math.sqrt(2 * meetings / CELL_MEETINGS)))
    own = F.pmod(F.xxhash64("subject"), F.lit(blocks)).cast("int")
    placed = rows.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = placed.select(F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), (F.col("_b") > F.col("_o")).alias("_high"), "subject", "at")
    cells = cells.repartition(min(blocks * (blocks + 1) // 2, 10_000), "_i", "_j").sortWithinPartitions("_i", "_j")
    out = cells.mapInArrow(_meetings(span), "a string, b string, gap_seconds double")
    return made_in_tasks(out, lambda run, layout: cells.mapInArrow(one_after_other(_meetings(span, plain=False), run), layout))


def coordinated_encryption(k5: DataFrame, seconds: float = 300, block_rows: int = 2_000, by_pair: bool = False) -> DataFrame:
    """Encrypted-after-call starts of two subjects less than ``seconds`` apart.

    There is no party to join on, only time, so the time bucket is the key; a bucket with many
    events is cut into blocks on the left and every block meets the whole right side, which
    bounds the work on one join key.  Nothing is left out.  With ``by_pair`` the same rows are made pair by
    pair, with ``a``, ``b`` and ``gap_seconds`` only, which :func:`coordinated_pairs` sums without a shuffle.
    """
    span = int(seconds * 1e6) - 1
    if by_pair:
        return _by_pair(k5, span)
    rows = k5.select("subject", "data_start", "app")
    buckets = rows.groupBy(F.floor(us("data_start") / (2 * span)).alias("_b")).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_blocks"))
    many = buckets.filter("_blocks > 1")
    left = rows.select(F.col("subject").alias("a"), F.col("data_start").alias("a_start"), F.col("app").alias("a_app"), F.floor(us("data_start") / (2 * span)).alias("_b"))
    left = left.join(many, "_b", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    left = left.withColumn("_s", F.pmod(F.xxhash64("a", "a_start"), F.col("_blocks")).cast("int")).drop("_blocks")
    low, high = F.floor((us("data_start") - span) / (2 * span)), F.floor((us("data_start") + span) / (2 * span))
    right = rows.select(F.col("subject").alias("b"), F.col("data_start").alias("b_start"), F.col("app").alias("b_app"), F.explode(F.sequence(low, high)).alias("_b"))
    right = right.join(many, "_b", "left").withColumn("_s", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))).drop("_blocks")
    gap = F.abs(us("b_start") - us("a_start"))
    return left.join(right, ["_b", "_s"]).filter((F.col("a") < F.col("b")) & (gap <= span)).select(
        "a", "b", "a_start", "b_start", "a_app", "b_app", (gap / 1e6).alias("gap_seconds"))


def _sums_of_runs():
    """A task's function: number and smallest gap of rows (a, b, gap_seconds) that follow each other with one pair.
    Nothing of this module is imported in the task."""
    import numpy as np
    import pyarrow as pa

    names = ["a", "b", "coincidences", "closest_seconds"]

    def run(batches):
        last = None  # the run that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            a, b = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            x, y, gap = a.indices.to_numpy(), b.indices.to_numpy(), batch.column(2).to_numpy()
            starts = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            count, least = np.diff(np.r_[starts, len(x)]), np.minimum.reduceat(gap, starts)
            if last is not None:
                if last[:2] == (a[0].as_py(), b[0].as_py()):
                    count[0], least[0] = count[0] + last[2], min(least[0], last[3])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in last], names=names)
            at = pa.array(starts[:-1])
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(count[:-1]), pa.array(least[:-1])], names=names)
            last = a[len(x) - 1].as_py(), b[len(x) - 1].as_py(), int(count[-1]), float(least[-1])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in last], names=names)

    return run


def coordinated_pairs(k9: DataFrame, by_pair: bool = False) -> DataFrame:
    """Coincidences of two subjects and the closest; ``by_pair`` if :func:`coordinated_encryption` listed them so:
    then they are summed as they come, and no table of pairs is held or shuffled."""
    if by_pair:
        return k9.select("a", "b", "gap_seconds").mapInArrow(_sums_of_runs(), "a string, b string, coincidences bigint, closest_seconds double")
    return k9.groupBy("a", "b").agg(F.count(F.lit(1)).alias("coincidences"), F.min("gap_seconds").alias("closest_seconds"))


def timeline(c: DataFrame, i: DataFrame) -> DataFrame:
    """Calls and sessions of a subject in one table; order by subject and time where shown."""
    calls = c.select("subject", F.col("datetime").alias("at"), F.lit("call").alias("source"), F.col("b_party").alias("detail"), F.col("duration_seconds").cast("double").alias("seconds"))
    data = i.select("subject", F.col("start_time").alias("at"), F.lit("session").alias("source"), F.col("detected_app").alias("detail"), F.col("session_duration").cast("double").alias("seconds"))
    return calls.unionByName(data)


def _amplifiers() -> tuple[Column, Column, Column]:
    return F.col("critical_encrypted") > 5, F.col("silent_mb") > 200, F.col("shifts") > 3


def multiplier() -> Column:
    """The factor of the amplifiers, from the columns of :func:`subject_counts`."""
    many, heavy, shifts = _amplifiers()
    return F.when(many, 1.5).otherwise(1.0) * F.when(heavy, 1.3).otherwise(1.0) * F.when(shifts, 1.2).otherwise(1.0)


def risk_amplifiers(counts: DataFrame) -> DataFrame:
    many, heavy, shifts = _amplifiers()
    return counts.select("subject", multiplier().alias("multiplier"), F.array_compact(F.array(
        F.when(many, "IMMEDIATE_ENCRYPTION"), F.when(heavy, "SILENT_DATA"), F.when(shifts, "CHANNEL_SHIFTS"))).alias("reasons"))


def event_chains(k2: DataFrame, k5: DataFrame, seconds: float = 60, tie: Sequence[str] = TIE) -> DataFrame:
    """High-risk call-to-data events and encrypted sessions of the subject that start less than
    ``seconds`` apart."""
    t = tie[0]
    left = k2.filter(F.col("risk").isin("HIGH", "CRITICAL")).select("subject", "call_time", "b_party", "data_start", "gap_seconds", f"call_{t}", f"session_{t}")
    right = k5.select("subject", F.col("data_start").alias("encrypted_start"), F.col("app").alias("encrypted_app"), F.col("mb").alias("encrypted_mb"),
                      F.col(f"call_{t}").alias("encrypted_call_id"), F.col(f"session_{t}").alias("encrypted_session_id"))
    span = int(seconds * 1e6) - 1
    return band_join(left, right, ["subject"], "data_start", "encrypted_start", -span, span)


def correlate(c: DataFrame, i: DataFrame, tie: Sequence[str] = TIE) -> dict[str, DataFrame]:
    """All correlations for subjects in both sources; the call-to-data join is described once.

    What comes of a call and a session is of such subjects as it is; the rest is cut to them when it is made, where it
    has fewer rows than the sources."""
    both = c.select("subject").distinct().join(i.select("subject").distinct(), "subject", "left_semi")
    k2 = call_to_data(c, i, tie=tie)
    k5 = encrypted_after_call(k2)
    every = call_silences(c, tie=tie)
    k3, k4 = every.join(both, "subject", "left_semi"), data_in_silence(every, i, tie)
    k6 = channel_shifts(c, i).join(both, "subject", "left_semi")
    counts = subject_counts(both, k2, None, k4, k6)
    return {
        "call_to_data": k2, "encrypted_after_call": k5, "call_silences": k3, "data_in_silence": k4, "channel_shifts": k6, "counts": counts,
        "indicators": correlation_indicators(counts), "score": correlation_score(counts), "amplifiers": risk_amplifiers(counts),
        "coordinated": coordinated_encryption(k5), "chains": event_chains(k2, k5, tie=tie), "timeline": timeline(c, i).join(both, "subject", "left_semi")}
