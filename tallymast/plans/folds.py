"""Order-dependent choices as chains: every row points at the row that is chosen next if it is.

A greedy scan keeps the rows on the chain from the first row of its key.  Chains are followed by
pointer doubling: after k rounds of joins all rows within 2**k choices are known, so a key of any
length is spread over tasks and no row waits for the one before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import us
from ..session import cut_lineage
from .joins import asof_next
from .shards import HOT_ROWS


def first_buckets(df: DataFrame, key: str, ts: str, bucket_us: int, n: int) -> DataFrame:
    """Rows in the first ``n`` non-empty time buckets of their key."""
    at = F.floor(us(ts) / bucket_us)
    rows = df.withColumn("_bucket", at)
    w = Window.partitionBy(key).orderBy("_bucket")
    keep = (
        rows.select(key, "_bucket").distinct()
        .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    )
    return rows.join(keep, [key, "_bucket"], "left_semi").drop("_bucket")


def chain(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """(_key, _at) on the chain that starts at the smallest ``_at`` of each ``_key`` and follows ``_next``
    (larger than ``_at``; null at the end); with ``limit`` the first so many of each."""
    reached = nodes.groupBy("_key").agg(F.min("_at").alias("_at")).withColumn("_hop", F.lit(0))
    jump, hops = nodes.filter(F.col("_next").isNotNull()).select("_key", "_at", "_next"), 1
    while limit is None or hops < limit:
        step = reached.join(jump, ["_key", "_at"]).select("_key", F.col("_next").alias("_at"), (F.col("_hop") + hops).alias("_hop"))
        if limit is None:
            step = cut_lineage(step.repartition("_key", "_at"))  # as many parts as its size asks for
            if step.isEmpty():
                break
        reached, hops = reached.unionByName(step), 2 * hops
        if limit is None or hops < limit:
            ahead = jump.select("_key", F.col("_at").alias("_next"), F.col("_next").alias("_then"))
            jump = cut_lineage(jump.join(ahead, ["_key", "_next"]).select("_key", "_at", F.col("_then").alias("_next")))
    return (reached if limit is None else reached.filter(F.col("_hop") < limit)).select("_key", "_at")


def chosen(rows: DataFrame, keys: Sequence[str], at: Column, reach: Column, limit: int | None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows that a scan of each key in the order of ``at`` (unique in a key) takes, going on after a taken
    row at ``at + reach``."""
    placed = cut_lineage(rows.select("*", F.struct(*keys).alias("_key"), at.alias("_at"), (at + reach - 1).alias("_until")))
    probes, hits = placed.select("_key", "_at", "_until"), placed.select("_key", F.col("_at").alias("_hit"))
    nodes = cut_lineage(asof_next(probes, hits, ["_key"], "_until", "_hit", {"_next": "_hit"}, hot_rows=hot_rows))
    return placed.join(chain(nodes, limit), ["_key", "_at"], "left_semi").select(*rows.columns)


def keep_spaced(df: DataFrame, key: str, ts: str, gap_us: int, limit: int | None, tie: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Greedy thinning: keep a row only if it is at least ``gap_us`` after the last kept one; of rows of one
    time the first by ``tie``.  Rows without a time are left out.

    Two neighbouring non-empty buckets of ``gap_us`` always hold a pick, so the first
    ``limit`` picks lie in the first ``2 * limit`` non-empty buckets.  Without a limit the rows
    are cut where a gap is longer than ``gap_us``, as the row behind it is always kept: chains are as
    long as the longest stretch without such a gap.
    """
    keys = [key] if limit is not None else [key, "island"]
    timed = df.filter(F.col(ts).isNotNull())
    near = first_buckets(timed, key, ts, gap_us, 2 * limit) if limit is not None else with_island(timed, ts, gap_us, [key])
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, ts).orderBy(*(tie or [ts])))).filter("_n = 1")
    return chosen(first.drop("_n"), keys, us(ts), F.lit(gap_us), limit, hot_rows).drop(*keys[1:])


def keep_skipping(df: DataFrame, key: str, ts: str, number: str, size: str, span_us: int, limit: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Greedy scan: after a kept row with number ``n`` and size ``s`` go on at number ``n + s``.

    A pick blocks only rows within ``span_us`` after it, so two neighbouring non-empty
    buckets of that width hold a pick.
    """
    near = first_buckets(df, key, ts, span_us, 2 * limit)
    return chosen(near, [key], F.col(number).cast("long"), F.col(size).cast("long"), limit, hot_rows)


def with_island(df: DataFrame, ts: str, gap_us: int, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``island``, shared by rows of a key with no gap longer than ``gap_us`` between them.

    Rows in one time cell of width ``gap_us`` are always one island, so islands are unions of
    whole cells and are found on one row per occupied cell (about 100,000 a year for five
    minutes, however many rows there are).
    """
    keys = list(keys)
    cell = F.floor(us(ts) / gap_us)
    cells = df.groupBy(*keys, cell.alias("_cell")).agg(F.min(us(ts)).alias("_lo"), F.max(us(ts)).alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("_cell")
    breaks = cells.withColumn("_new", (F.col("_lo") - F.lag("_hi").over(w) > gap_us).cast("int"))
    numbered = breaks.select(*keys, "_cell", F.sum(F.coalesce("_new", F.lit(0))).over(w).alias("island"))
    return df.withColumn("_cell", cell).join(numbered, [*keys, "_cell"]).drop("_cell")
