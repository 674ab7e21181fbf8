"""Ordered analytics per key that survive a key holding a third of the data.

``Window.partitionBy(key)`` puts all rows of a key into one task.  The helpers below first
count rows per key (map-side combined, one narrow column).  Without *hot* keys a plain window
follows.  Hot keys are cut into shards of about ``hot_rows`` rows at quantiles of their times: a
burst of a second gets as many shards as its rows ask for, a tail of years as few.  What crosses
a shard boundary is carried by one seam row per shard.

The count is a job of its own, run when the plan is made; of its result the driver sees whether
any key is hot and how many cuts there are.  Any cuts give right results, so nothing depends on the
data staying as they were.  There are at most ``2 * rows / hot_rows`` cuts and seams; they are broadcast
if they are few, and joined by a shuffle of the hot keys otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.scalar import us
from ..session import cut_lineage

HOT_ROWS = 4_000_000
#: Instants weighed per shard when quantiles are looked for.
WEIGHED = 64
#: A key has fewer than ``2 ** MOST_BITS`` shards, as its cuts go with each of its rows to the search; the
#: shards of a key of more than some ten billion rows are larger.
MOST_BITS = 12
#: Rows of cuts or seams that are broadcast at most.
BROADCAST_ROWS = 500_000


def moment(df: DataFrame, ts: str) -> Column:
    """A time column in microseconds; a whole number is taken as it is."""
    return F.col(ts) if isinstance(df.schema[ts].dataType, LongType) else us(ts)


@dataclass
class Cuts:
    """Hot keys (``_hot_<key>``) with ``_cuts``, the first instants of their shards but the first, rising."""

    keys: list[str]
    table: DataFrame
    rows: int

    def small(self, df: DataFrame) -> DataFrame:
        """``df``, which has a row a cut or fewer, marked for broadcast if that is few."""
        return F.broadcast(df) if self.rows <= BROADCAST_ROWS else df

    def add(self, df: DataFrame) -> DataFrame:
        """Adds ``_cuts``: null for cold keys."""
        same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in self.keys]
        return df.join(self.small(self.table), same, "left").drop(*[f"_hot_{k}" for k in self.keys])

    def shard(self, df: DataFrame, at: Column, name: str = "_shard") -> DataFrame:
        """Adds the number of the shard: null for cold keys; a missing time is in the first."""
        return shard_of(self.add(df), at, name).drop("_cuts")


def hot_cuts(df: DataFrame, keys: Sequence[str], instants: Sequence[Column], hot_rows: int | None) -> Cuts | None:
    """Cuts of the keys of more than ``hot_rows`` rows, None if there are none or ``hot_rows`` is None.

    Rows of a hot key are counted per instant.  An instant of many rows is always weighed; one of few
    is weighed with a probability in proportion, by its hash, for all of its kind: unbiased, the same
    however often it is evaluated, and about ``WEIGHED`` instants a shard.  A running weight cuts at every
    ``hot_rows``.  One instant is never parted.
    """
    if hot_rows is None:
        return None
    names = [f"_hot_{k}" for k in keys]
    sizes = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > hot_rows)
    if hot.isEmpty():
        return None
    hot = cut_lineage(hot)
    few = hot.count() <= BROADCAST_ROWS
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    at = df.join(F.broadcast(hot) if few else hot, same).select(*names, "_n", F.explode(F.array(*instants)).alias("_at"))
    share = max(hot_rows // WEIGHED, 1)
    counts = at.filter(F.col("_at").isNotNull()).groupBy(*names, "_n", "_at").agg(F.count(F.lit(1)).alias("_c"))
    weighed = counts.filter((F.col("_c") >= share) | (F.pmod(F.xxhash64(*names, "_at"), F.lit(share)) < F.col("_c")))
    along = Window.partitionBy(*names).orderBy("_at")
    before = F.coalesce(F.sum(F.greatest("_c", F.lit(share))).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.greatest(F.lit(hot_rows), F.ceil(F.lit(len(instants)) * F.col("_n") / 2 ** (MOST_BITS - 1)))
    parts = weighed.withColumn("_part", F.floor(before / size)).withColumn("_last", F.lag("_part").over(along))
    cuts = parts.filter(F.col("_part") > F.col("_last")).groupBy(*names).agg(F.array_sort(F.collect_list("_at")).alias("_cuts"))
    table = cut_lineage(cuts)
    return Cuts(list(keys), table, table.agg(F.sum(F.size("_cuts") + 1)).first()[0] or 0)


def shard_of(df: DataFrame, at: Column, name: str) -> DataFrame:
    """Adds the number of ``_cuts`` that are not behind ``at``, null without cuts: a binary search."""
    steps = F.array(*[F.lit(2**k) for k in range(MOST_BITS - 1, -1, -1)])
    passed = lambda n, step: F.when(F.get("_cuts", n + step - 1) <= at, n + step).otherwise(n)
    return df.withColumn(name, F.when(F.col("_cuts").isNotNull(), F.aggregate(steps, F.lit(0), passed)))


def at_seams(df: DataFrame, cuts: Cuts, seams: DataFrame) -> DataFrame:
    """Adds the columns of ``seams``, a row of ``_seam_<key>`` and ``_seam_shard`` per shard; null for cold keys."""
    same = [F.col(k).eqNullSafe(F.col(f"_seam_{k}")) for k in cuts.keys]
    return df.join(cuts.small(seams), [*same, F.col("_shard") == F.col("_seam_shard")], "left")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    prev: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
    tie: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Columns of the previous and next row of the same key.

    ``prev`` and ``next`` map a new column name to the source column.  Order is ``ts`` and
    then ``tie``; give a tie column that makes the order total.  ``hot_rows`` None: no key is hot.
    """
    keys = list(keys)
    prev, next = dict(prev or {}), dict(next or {})
    order = [ts, *tie]
    behind = F.struct(F.lit(1).alias("_there"), *[F.col(c).alias(n) for n, c in prev.items()])
    ahead = F.struct(F.lit(1).alias("_there"), *[F.col(c).alias(n) for n, c in next.items()])
    cuts = hot_cuts(df, keys, [moment(df, ts)], hot_rows)
    sharded = cuts.shard(df, moment(df, ts)) if cuts else df
    within = Window.partitionBy(*keys, *(["_shard"] if cuts else [])).orderBy(*order)
    out = sharded.withColumns({"_p": F.lag(behind).over(within), "_x": F.lead(ahead).over(within)})
    if not cuts:
        return out.select(*df.columns, *[F.col("_p")[n].alias(n) for n in prev], *[F.col("_x")[n].alias(n) for n in next])

    along = Window.partitionBy(*keys).orderBy("_shard")
    position = F.struct(*[F.col(c) for c in order])
    seams = (
        sharded.filter(F.col("_shard").isNotNull())
        .groupBy(*keys, "_shard")
        .agg(F.max_by(behind, position).alias("_last"), F.min_by(ahead, position).alias("_first"))
        .select(
            *[F.col(k).alias(f"_seam_{k}") for k in keys],
            F.col("_shard").alias("_seam_shard"),
            F.lag("_last").over(along).alias("_before"),
            F.lead("_first").over(along).alias("_after"),
        )
    )
    return at_seams(out, cuts, seams).select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(F.col("_p"), F.col("_before"))[n].alias(n) for n in prev],
        *[F.coalesce(F.col("_x"), F.col("_after"))[n].alias(n) for n in next],
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], ts: str, order: Sequence, value: str, name: str, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including this one.

    ``order`` must start with ``ts``; the sum of the earlier shards of a hot key is added as
    one number per shard.
    """
    keys = list(keys)
    cuts = hot_cuts(df, keys, [moment(df, ts)], hot_rows)
    sharded = cuts.shard(df, moment(df, ts)) if cuts else df
    within = Window.partitionBy(*keys, *(["_shard"] if cuts else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = sharded.withColumn("_sum", F.sum(value).over(within))
    if not cuts:
        return summed.select(*df.columns, F.col("_sum").alias(name))
    along = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sharded.filter(F.col("_shard").isNotNull())
        .groupBy(*keys, "_shard").agg(F.sum(value).alias("_part"))
        .select(
            *[F.col(k).alias(f"_seam_{k}") for k in keys], F.col("_shard").alias("_seam_shard"),
            F.coalesce(F.sum("_part").over(along), F.lit(0)).alias("_offset"),
        )
    )
    total = F.col("_sum") + F.coalesce(F.col("_offset"), F.lit(0))
    return at_seams(summed, cuts, offsets).select(*df.columns, total.alias(name))


def row_numbers(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (), name: str = "rn",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``row_number`` per key in time order, hot keys numbered shard by shard."""
    ones = df.withColumn("_one", F.lit(1))
    return running_sum(ones, keys, ts, [ts, *tie], "_one", name, hot_rows).drop("_one")


def count_ahead(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    span_us: int,
    name: str,
    distinct: str | None = None,
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For each row: rows (or distinct values) of its key in ``[ts, ts + span]``, both ends in; 0 without a
    time.  Without keys all rows are one key, cut into cells of time.

    A sweep instead of a sliding frame.  Row *r* is seen by the anchors in
    ``(max(previous r of the same value, ts_r - span - 1), ts_r]``, so it adds one at the
    start of that stretch and takes it away after the end; the running sum at an anchor is
    the count.  Linear in the rows however crowded a window is, and no set is ever built.

    The marks of a hot key are cut into shards by their own times, so a row reaches two shards at
    most however long the span is; the sum of the shards before is added as one number.
    """
    own = df.columns
    df = df.withColumn("_at", moment(df, ts))
    if not keys:
        # cells of twice the span, each with what its rows see of the next one
        home = F.floor(F.col("_at") / (2 * span_us + 2))
        near = F.col("_at") - home * (2 * span_us + 2) <= span_us
        keys, df = ["_cell"], df.withColumn("_home", home).withColumn("_cell", F.explode(F.when(near, F.array(home, home - 1)).otherwise(F.array(home))))
        seen = count_ahead(df.drop("_at"), keys, ts, span_us, name, distinct, tie, hot_rows)
        return seen.filter(F.col("_home").eqNullSafe(F.col("_cell"))).select(*own, name)
    at = F.col("_at")
    cuts = hot_cuts(df, keys, [at, at - span_us], hot_rows)
    first = at - span_us
    if distinct is not None:
        # a value of a cold key is cold
        df = neighbours(df, [*keys, distinct], ts, prev={"_seen": "_at"}, tie=tie, hot_rows=hot_rows if cuts else None)
        first = F.greatest(first, F.col("_seen") + 1)
    df = df.withColumn("_first", first)

    row = F.struct(*[F.col(c) for c in own])
    mark = lambda when, kind, inc, payload: F.struct(when.alias("at"), F.lit(kind).alias("kind"), F.lit(inc).alias("inc"), payload.alias("row"))
    none = F.lit(None).cast(df.select(*own).schema)
    opens, alone = mark(F.col("_first"), 0, 1, none), F.array(mark(at, 1, 0, row))
    rest = F.concat(alone, F.array(mark(at, 2, -1, none)))
    part = [f"_k_{k}" for k in keys]
    named = lambda placed, *more: placed.select(*[F.col(k).alias(n) for k, n in zip(keys, part)], *more)
    sweep = lambda marked, by: marked.select(*by, F.inline("_marks")).withColumn(
        "_sum", F.sum("inc").over(Window.partitionBy(*by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("row").isNotNull())
    if not cuts:
        marks = F.when(at.isNull(), alone).otherwise(F.concat(F.array(opens), rest)).alias("_marks")
        swept = sweep(named(df, marks).repartition(*part), part)
        return swept.select("row.*", F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.col("_sum")).cast("bigint").alias(name))

    placed = shard_of(shard_of(cuts.add(df), F.col("_first"), "_from"), at, "_to")
    parcel = lambda shard, marks: F.struct(F.col(shard).alias("_shard"), marks.alias("_marks"))
    parcels = (
        F.when(at.isNull(), F.array(parcel("_to", alone)))
        .when(F.col("_from").eqNullSafe(F.col("_to")), F.array(parcel("_to", F.concat(F.array(opens), rest))))
        .otherwise(F.array(parcel("_from", F.array(opens)), parcel("_to", rest)))
    )
    packed, by = named(placed, F.inline(parcels)), [*part, "_shard"]
    along = Window.partitionBy(*part).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    change = F.aggregate("_marks", F.lit(0), lambda a, m: a + m["inc"])
    offsets = packed.filter(F.col("_shard").isNotNull()).groupBy(*by).agg(F.sum(change).alias("_part")).select(
        *[F.col(c).alias(f"_seam_{c}") for c in part], F.col("_shard").alias("_seam_shard"), F.coalesce(F.sum("_part").over(along), F.lit(0)).alias("_offset"))
    out = at_seams(sweep(packed.repartition(*by), by), Cuts(part, cuts.table, 2 * cuts.rows), offsets)
    total = F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.col("_sum") + F.coalesce("_offset", F.lit(0)))
    return out.select("row.*", total.cast("bigint").alias(name))
