"""Band, interval and as-of joins as equi-joins on a time bucket plus an exact test.

The bucket is part of the join key, so a hot party is split by time before the shuffle,
and adaptive skew handling can split what is left.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.scalar import us
from ..session import cut_lineage
from .shards import HOT_ROWS, at_seams, hot_cuts, moment


def band_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    lo_us: int,
    hi_us: int,
    how: str = "inner",
) -> DataFrame:
    """Rows with equal ``on`` and ``lo <= right_ts - left_ts <= hi`` (microseconds, both ends in).

    The left row keeps one bucket and the right row is placed in every bucket that can see
    it (two or three), so each pair meets exactly once and outer, semi and anti joins hold.
    Apart from ``on`` the two sides must not share column names.
    """
    width = max(hi_us - lo_us, 1)
    l = left.withColumn("_bucket", F.floor(us(left_ts) / width))
    seen_from = F.floor((us(right_ts) - hi_us) / width)
    seen_to = F.floor((us(right_ts) - lo_us) / width)
    r = right.filter(F.col(right_ts).isNotNull()).select(
        *[F.col(k).alias(f"_r_{k}") for k in on],
        *[c for c in right.columns if c not in on],
        F.explode(F.sequence(seen_from, seen_to)).alias("_r_bucket"),
    )
    gap = us(right_ts) - us(left_ts)
    cond = [F.col(k) == F.col(f"_r_{k}") for k in on]
    cond += [F.col("_bucket") == F.col("_r_bucket"), gap >= lo_us, gap <= hi_us]
    out = l.join(r, cond, how)
    return out.drop("_bucket", "_r_bucket", *[f"_r_{k}" for k in on])


#: Cells of one level in a cell of the next, and the last level: with cells of an hour at first, twice the
#: longest interval that times can have.
FAN, TOP = 16, 7


def interval_cells(intervals: DataFrame, start: str, end: str, width_us: int) -> DataFrame:
    """``intervals`` (none ends before it starts) with ``_level`` and ``_cell``, a row for every time cell they
    touch.  Cells are ``FAN`` times as wide from level to level, and an interval is cut at the first level
    where it is no longer than ``FAN`` cells: at most ``FAN + 1`` rows each, however long it lasts."""
    length = us(end) - us(start)
    level = F.lit(TOP)
    for k in range(TOP - 1, -1, -1):
        level = F.when(length <= width_us * FAN ** (k + 1), k).otherwise(level)
    leveled = intervals.withColumn("_level", level)
    width = F.element_at(F.array(*[F.lit(width_us * FAN**k) for k in range(TOP + 1)]), F.col("_level") + 1)
    return leveled.withColumn("_cell", F.explode(F.sequence(F.floor(us(start) / width), F.floor(us(end) / width))))


def point_in_interval(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    at: str,
    start: str,
    end: str,
    width_us: int = 3_600_000_000,
) -> DataFrame:
    """Points inside the intervals of the same key, both ends in.  A point has one cell of every level that
    intervals are cut at (one level, if all are short; a job of its own finds the levels), and meets an
    interval at that one's level only, so no pair is met twice."""
    cells = interval_cells(intervals.filter(F.col(end) >= F.col(start)), start, end, width_us)
    levels = sorted(r["_level"] for r in cells.select("_level").distinct().collect()) or [0]
    cell = lambda k: F.struct(F.lit(k).alias("_at_level"), F.floor(us(at) / (width_us * FAN**k)).alias("_at_cell"))
    p = points.withColumn("_at", F.explode(F.array(*[cell(k) for k in levels])) if len(levels) > 1 else cell(levels[0]))
    p = p.select(*points.columns, "_at.*")
    i = cells.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in intervals.columns if c not in on], "_level", "_cell")
    cond = [F.col(k) == F.col(f"_r_{k}") for k in on]
    cond += [F.col("_at_level") == F.col("_level"), F.col("_at_cell") == F.col("_cell"), F.col(at) >= F.col(start), F.col(at) <= F.col(end)]
    return p.join(i, cond).drop("_at_level", "_at_cell", "_level", "_cell", *[f"_r_{k}" for k in on])


def asof_next(
    probes: DataFrame,
    rows: DataFrame,
    on: Sequence[str],
    probe_ts: str,
    row_ts: str,
    take: Mapping[str, str],
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """For each probe, columns of the first row of the same key strictly later than it.

    Both sides go through one union and one ordered pass per key.  ``tie`` orders rows of
    equal time.  Hot keys are sharded; the first row of the next shard that has one is the seam.
    Times may be whole numbers on both sides.
    """
    on = list(on)
    hit = F.struct(*[F.col(c).alias(n) for n, c in take.items()])
    tie_struct = F.struct(F.lit(0).alias("_t"), *[F.col(c) for c in tie])
    p = probes.select(*on, F.col(probe_ts).alias("_at"), F.struct(*probes.columns).alias("_probe"))
    r = rows.select(*on, F.col(row_ts).alias("_at"), hit.alias("_hit"), tie_struct.alias("_tie"))
    both = p.unionByName(r, allowMissingColumns=True)
    at = both.withColumn("_us", moment(both, "_at"))
    cuts = hot_cuts(at, on, [F.col("_us")], hot_rows)
    both = (cuts.shard(at, F.col("_us")) if cuts else at).drop("_us")
    # descending time: at equal time the probe comes first, so it sees strictly later rows only
    w = (
        Window.partitionBy(*on, *(["_shard"] if cuts else []))
        .orderBy(F.desc("_at"), F.col("_hit").isNotNull(), F.desc("_tie"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = both.withColumn("_near", F.last("_hit", ignorenulls=True).over(w)).filter(F.col("_probe").isNotNull())
    if not cuts:
        return found.select("_probe.*", *[F.col("_near")[n].alias(n) for n in take])
    along = Window.partitionBy(*on).orderBy("_shard").rowsBetween(1, Window.unboundedFollowing)
    seams = (
        both.filter(F.col("_shard").isNotNull())
        .groupBy(*on, "_shard")
        .agg(F.min_by(F.col("_hit"), F.when(F.col("_hit").isNotNull(), F.struct("_at", "_tie"))).alias("_first"))
        .select(*[F.col(k).alias(f"_seam_{k}") for k in on], F.col("_shard").alias("_seam_shard"),
                F.first("_first", ignorenulls=True).over(along).alias("_after"))
    )
    out = at_seams(found, cuts, seams).withColumn("_got", F.coalesce("_near", "_after"))
    return out.select("_probe.*", *[F.col("_got")[n].alias(n) for n in take])


def block_pairs(
    rows: DataFrame,
    group: Sequence[str],
    member: str,
    block_rows: int = 2_000,
) -> DataFrame:
    """Unordered pairs ``(a, b)`` with ``a < b`` of distinct members of a group.

    ``rows`` must hold each (group, member) once.  A group of k members is cut into
    ceil(k / block_rows) hash blocks and joined block against block, so the work on one
    join key stays near block_rows squared however large the group is.  Small groups have
    one block and are not copied at all.  Nothing is dropped.
    """
    group = list(group)
    sizes = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_blocks"))
    sized = rows.join(
        sizes.filter(F.col("_blocks") > 1).select(*[F.col(g).alias(f"_g_{g}") for g in group], "_blocks"),
        [F.col(g) == F.col(f"_g_{g}") for g in group], "left",
    ).select(*rows.columns, F.coalesce("_blocks", F.lit(1)).alias("_blocks"))
    block = F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int")
    sized = sized.select(*group, F.col(member).alias("_m"), block.alias("_b"), "_blocks")
    low = sized.select(*group, F.col("_b").alias("_i"), "_m", F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1)).alias("_j"))
    high = sized.select(*group, F.col("_b").alias("_j"), F.col("_m").alias("_o"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"))
    # every two members meet once, in the cell of their blocks with the smaller number first
    return (
        low.join(high, [*group, "_i", "_j"])
        .filter((F.col("_i") < F.col("_j")) | (F.col("_m") < F.col("_o")))
        .select(*group, F.least("_m", "_o").alias("a"), F.greatest("_m", "_o").alias("b"))
    )


#: Pairs per copied row from which on pairs are counted in tasks; rows of a block and pairs of a cell at most, about.
CROWDED, BLOCK_ROWS, CELL_PAIRS = 4, 1_500_000, 50_000_000
#: Blocks that are cut for the pairs' sake at most: every block more is another copy of all rows.
MOST_BLOCKS = 64
#: Groups of a member from which on its list may be cut into as many parts, each with this many at most, about.
LISTED, PARTS = 10_000, 16


def crowded_blocks(rows: DataFrame, group: Sequence[str]) -> int:
    """How many blocks ``packed_pairs`` should cut the members into; 0 where groups are so small that listing
    their pairs moves less."""
    n = F.col("_n").cast("double")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    total, pairs = sizes.agg(F.coalesce(F.sum(n), F.lit(0.0)), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()
    blocks = max(1, math.ceil(total / BLOCK_ROWS), min(MOST_BLOCKS, math.ceil(math.sqrt(2 * pairs / CELL_PAIRS))))
    return blocks if pairs > CROWDED * total * blocks else 0


def packed_pairs(rows: DataFrame, group: Sequence[str], member: str, blocks: int, least: int = 1, name: str = "common", samples: int = 0) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of members that share at least ``least`` groups, with how many and, for one
    group column, the first ``samples`` of them.

    Members are cut into ``blocks`` by hash and each goes, with the list of its groups, to the cells of its block
    with every other.  A cell counts the pairs of its two blocks in batches of bounded size, so what is shuffled
    is rows times blocks and never a row per pair and group.  Exact; nothing is dropped.  Members are of a plain
    type, not structs.
    """
    group = list(group)
    rows = rows.select(*group, member).dropna()

    def packed(listed):
        # lists of a member of very many groups are parted
        many = listed.groupBy("_m", F.pmod(F.xxhash64("_g"), F.lit(PARTS)).alias("_part")).agg(F.collect_list("_g").alias("_gs"))
        many = many.groupBy("_m", F.when(F.size("_gs") > LISTED, F.col("_part"))).agg(F.flatten(F.collect_list("_gs")).alias("_gs"))
        return cut_lineage(many.select(F.pmod(F.xxhash64("_m"), F.lit(blocks)).cast("int").alias("_b"), "_m", "_gs"))

    @functools.cache
    def numbered():
        numbers = cut_lineage(rows.select(*group).distinct().withColumn("_g", F.monotonically_increasing_id()))
        return packed(rows.join(numbers, group).select(F.col(member).alias("_m"), "_g"))

    who = rows.schema[member].dataType
    fields = [StructField("a", who), StructField("b", who), StructField(name, LongType())]
    if samples:
        fields.append(StructField("samples", ArrayType(rows.schema[group[0]].dataType)))
    names = [f.name for f in fields]
    made = packed(rows.select(F.col(member).alias("_m"), F.col(group[0]).alias("_g"))) if samples else numbered()
    out = _cells(made, blocks).mapInArrow(pair_counter(least, samples, names), StructType(fields))
    coded = pair_counter(least, 0, names[:3], plain=False)
    out.__dict__["_members"] = numbered, blocks, least, names[:3]  # for ``numbered_pairs_in_tasks``
    return made_in_tasks(out, lambda run, layout: _cells(numbered(), blocks).mapInArrow(one_after_other(coded, run), layout))


def _cells(packed: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, member, groups), a copy for every cell of two blocks, cell by cell."""
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cells = packed.withColumn("_o", other).select(
        F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), (F.col("_b") > F.col("_o")).alias("_high"), "_m", "_gs")
    count = blocks * (blocks + 1) // 2
    return cells.repartition(min(count, 10_000), "_i", "_j").sortWithinPartitions("_i", "_j")


def made_in_tasks(pairs: DataFrame, read) -> DataFrame:
    """``pairs``, which remember how a task's function can read them in the tasks that make them: ``read(run, layout)``,
    their ends as dictionary arrays.  What is derived from them forgets it."""
    pairs.__dict__["_made"] = read
    return pairs


def pairs_in_tasks(pairs: DataFrame, run, layout) -> DataFrame:
    """``pairs.select("a", "b").mapInArrow(run, layout)``.  Pairs that were ``made_in_tasks`` are read by ``run`` there, and
    no row per pair leaves the task."""
    made = pairs.__dict__.get("_made")
    return made(run, layout) if made else pairs.select("a", "b").mapInArrow(run, layout)


def pair_members(pairs: DataFrame) -> DataFrame | None:
    """(node, _b): members that pairs of ``packed_pairs`` were looked for among, with their blocks; None for other pairs."""
    made = pairs.__dict__.get("_members")
    return None if made is None else made[0]().select(F.col("_m").alias("node"), "_b").distinct()


def numbered_pairs_in_tasks(pairs: DataFrame, numbers: DataFrame, run, layout) -> DataFrame:
    """``pairs_in_tasks`` of pairs of ``packed_pairs``, with ``numbers`` (node, id) in place of the members."""
    packed, blocks, least, names = pairs.__dict__["_members"]
    packed = packed().join(numbers.withColumnRenamed("node", "_m"), "_m").select("_b", F.col("id").alias("_m"), "_gs")
    return _cells(packed, blocks).mapInArrow(one_after_other(pair_counter(least, 0, names), run), layout)


def _lengths():
    """A task's function: how many rows it has.  Nothing of this module is imported in the task."""
    import pyarrow as pa

    return lambda batches: iter([pa.RecordBatch.from_pydict({"rows": [sum(len(batch) for batch in batches)]})])


def row_count(df: DataFrame) -> DataFrame:
    """``df.agg(count(*) AS rows)``; pairs that were ``made_in_tasks`` are counted there."""
    if "_made" not in df.__dict__:
        return df.agg(F.count(F.lit(1)).alias("rows"))
    return pairs_in_tasks(df, _lengths(), "rows bigint").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def one_after_other(first, then):
    """A task's function: ``then`` of what ``first`` makes."""
    return lambda batches: then(first(batches))


def pair_counter(least: int, samples: int, names: Sequence[str], batch: int = 1 << 22, plain: bool = True):
    """What a task of ``packed_pairs`` does with its rows, which come cell by cell; it looks at ``batch`` meetings
    together.  If not ``plain``, members come as dictionary arrays.  Nothing of this module is imported in the task."""
    import numpy as np
    import pyarrow as pa

    at_most = 100_000 if plain else 1_000_000  # rows of a batch

    def first_groups(pair, group, size, keep, shown):
        """The first ``samples`` groups of each kept pair as lists; groups of a pair come in rising order."""
        picked = np.full((samples, size), -1, np.int64)
        for n in range(samples):
            picked[n][pair[::-1]] = group[::-1]  # the first in order is written last
            more = group > picked[n][pair]
            pair, group = pair[more], group[more]
        chosen = picked[:, keep].T
        there = chosen >= 0
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(there.sum(axis=1))].astype(np.int32)), shown.take(pa.array(chosen[there])))

    def products(near_group, near_who, far_group, far_who, far, groups):
        """(near member, far places, counts) of members whose groups are so dense that products of tables count best."""
        there = np.zeros((groups, far), np.float32)
        there[far_group, far_who] = 1
        members, at = np.unique(near_who, return_inverse=True)
        starts = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)]
        step = max(1, batch // max(far, groups))
        for k in range(0, len(members), step):
            some = members[k:k + step]
            part = slice(starts[k], starts[k + len(some)])
            has = np.zeros((len(some), groups), np.float32)
            has[at[part] - k, near_group[part]] = 1
            times = has @ there
            for n, who in enumerate(some):
                found = np.flatnonzero(times[n] >= least)
                yield who, found, times[n][found].astype(np.int64)

    def one_by_one(near_group, near_who, far_who, first, size, seen, alone):
        """(near member, far places, counts), each counted in a table of the far members that stays in the cache."""
        lists = [far_who[at:at + n] for at, n in zip(first.tolist(), size.tolist())]
        starts = np.flatnonzero(np.r_[True, near_who[1:] != near_who[:-1]])
        groups, begun = near_group.tolist(), [0] * len(lists)
        for k, end in zip(starts.tolist(), [*starts[1:].tolist(), len(groups)]):
            own = groups[k:end]
            if alone:  # lists are in the order of members, who are passed one by one
                for g in own:
                    begun[g] += 1
                met = np.concatenate([lists[g][begun[g]:] for g in own])
            else:
                met = np.concatenate([lists[g] for g in own])
            times = np.bincount(met, minlength=len(seen))
            found = np.flatnonzero(times >= least)
            yield near_who[k], found, times[found]

    def coded_batches(a, b, common, people):
        for start in range(0, len(a), at_most):
            here = slice(start, start + at_most)
            ends = [pa.array(x[here].astype(np.int32)) for x in (a, b)]
            ends = [people.take(x) if plain else pa.DictionaryArray.from_arrays(x, people) for x in ends]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(common[here])], names=names)

    def shown_pairs(rows, seen, people, alone):
        """Record batches of (near member, far places, counts)."""
        held, n = [], 0

        def batches():
            a = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) for x in held])
            b, common = seen[np.concatenate([x[1] for x in held])], np.concatenate([x[2] for x in held])
            keep = (a < b if alone else a != b) & (common > 0)
            if not keep.all():
                a, b, common = a[keep], b[keep], common[keep]
            yield from coded_batches(np.minimum(a, b), np.maximum(a, b), common, people)

        for row in rows:
            held.append(row)
            n += len(row[1])
            if n >= at_most:
                yield from batches()
                held, n = [], 0
        if n:
            yield from batches()

    def cell_pairs(table, alone):
        """Members that are not ``_high`` against those that are, or (``alone``) all among themselves."""
        lists = table["_gs"].combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        order = np.array(sorted(range(len(coded.dictionary)), key=(found := coded.dictionary.to_pylist()).__getitem__), np.int64) if samples else np.arange(len(coded.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        group = rank[coded.indices.to_numpy(zero_copy_only=False)]
        shown = pa.array([found[k] for k in order], lists.type.value_type) if samples else None
        members = table["_m"].combine_chunks().dictionary_encode()
        people = members.dictionary.to_pylist()
        sorted_to = np.array(sorted(range(len(people)), key=people.__getitem__), np.int64)
        place = np.empty(len(people), np.int64)
        place[sorted_to] = np.arange(len(people))
        people = members.dictionary.take(pa.array(sorted_to))
        who = np.repeat(place[members.indices.to_numpy(zero_copy_only=False)], lengths)
        high = np.repeat(table["_high"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool), lengths)
        near, far = (slice(None), slice(None)) if alone else (~high, high)
        # the far side by group, the near side by member and group
        far_group, far_who = group[far], who[far]
        by = np.lexsort((far_who, far_group))
        far_group, far_who = far_group[by], far_who[by]
        size = np.bincount(far_group, minlength=len(order))
        first = np.cumsum(size) - size
        seen, far_who = np.unique(far_who, return_inverse=True) if len(far_who) else (np.empty(0, np.int64), far_who)
        by = np.lexsort((group[near], who[near]))
        near_group, near_who = group[near][by], who[near][by]
        if not samples and len(seen):
            members_near, meetings = len(np.unique(near_who)), int(size[near_group].sum())
            cells = members_near * len(seen)
            if meetings * 64 > cells * len(order) and len(seen) * len(order) <= 1 << 23:
                yield from shown_pairs(products(near_group, near_who, far_group, far_who, len(seen), len(order)), seen, people, alone)
                return
            if meetings > max(500 * members_near, cells // 10):
                yield from shown_pairs(one_by_one(near_group, near_who, far_who, first, size, seen, alone), seen, people, alone)
                return
        meets = size[near_group]
        near_group, near_who, meets = near_group[meets > 0], near_who[meets > 0], meets[meets > 0]
        if not len(near_who):
            return
        starts = np.flatnonzero(np.r_[True, near_who[1:] != near_who[:-1]])
        until = np.r_[0, np.cumsum(meets)]
        ends, k, held, n = np.r_[starts[1:], len(near_who)], 0, [], 0
        while k < len(starts):
            # as many members of the near side as fit a batch, one at least
            last = max(k + 1, min(int(np.searchsorted(until[ends], until[starts[k]] + batch, "right")), k + max(1, 4 * batch // len(seen))))
            part = slice(starts[k], ends[last - 1])
            times = meets[part]
            local = np.repeat(np.arange(last - k), ends[k:last] - starts[k:last])
            at = np.arange(times.sum()) + np.repeat(first[near_group[part]] - (np.cumsum(times) - times), times)
            pair = np.repeat(local * len(seen), times) + far_who[at]
            if (last - k) * len(seen) > 4 * len(pair):
                found_pairs, pair = np.unique(pair, return_inverse=True)
            else:
                found_pairs = np.arange((last - k) * len(seen))
            common = np.bincount(pair, minlength=len(found_pairs))
            a, b = near_who[starts[k:last]][found_pairs // len(seen)], seen[found_pairs % len(seen)]
            keep = np.flatnonzero((common >= least) & ((a < b) if alone else True) & (common > 0))
            if not len(keep):
                k = last
                continue
            if not samples:
                held.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], common[keep]))
                n += len(keep)
                if n >= at_most:  # not a batch, with its dictionary, for some few
                    yield from coded_batches(*map(np.concatenate, zip(*held)), people)
                    held, n = [], 0
                k = last
                continue
            columns = [people.take(pa.array(np.minimum(a, b)[keep])), people.take(pa.array(np.maximum(a, b)[keep])), pa.array(common[keep])]
            columns.append(first_groups(pair, np.repeat(near_group[part], times), len(found_pairs), keep, shown))
            k = last
            for start in range(0, len(keep), at_most):
                yield pa.RecordBatch.from_arrays([c.slice(start, at_most) for c in columns], names=names)
        if n:
            yield from coded_batches(*map(np.concatenate, zip(*held)), people)

    def run(batches):
        at, held = None, []
        for batch in batches:
            i, j = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            ends = [*(((i[1:] != i[:-1]) | (j[1:] != j[:-1])).nonzero()[0] + 1), len(i)] if len(i) else []
            start = 0
            for end in ends:
                here = int(i[start]), int(j[start])
                if here != at and held:
                    yield from cell_pairs(pa.Table.from_batches(held), at[0] == at[1])
                    held = []
                at = here
                held.append(batch.slice(start, end - start))
                start = end
        if held:
            yield from cell_pairs(pa.Table.from_batches(held), at[0] == at[1])

    return run


def counted_pairs(rows: DataFrame, group: Sequence[str], member: str, least: int = 1, name: str = "common", block_rows: int = 2_000) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of members that share at least ``least`` groups, with how many.

    Where groups are crowded, pairs are counted in tasks (``packed_pairs``); else they are listed and summed.
    ``rows`` must hold each (group, member) once.  Groups are ordered by size.  Two members with ``least``
    groups in common share one that is not among the ``least - 1`` largest groups of either, so only these
    remaining, smaller groups are paired: a group so large that it is among the largest of all its members
    (a placeholder, a hub) makes no pair.  What the pairs so found share in the groups set aside is looked
    up group by group afterwards, at most ``2 * (least - 1)`` a pair.  Without any group of more than
    ``block_rows`` members all are paired at once.  Counts are exact either way.
    """
    group = list(group)
    rows = cut_lineage(rows.select(*group, member).dropna())  # read several times below
    counted = lambda some, as_: block_pairs(some, group, member, block_rows).groupBy("a", "b").agg(F.count(F.lit(1)).alias(as_))
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    if least <= 1 or sizes.filter(F.col("_size") > block_rows).isEmpty():
        if blocks := crowded_blocks(rows, group):
            return packed_pairs(rows, group, member, blocks, least, name)
        return counted(rows, name).filter(F.col(name) >= least)
    sized = rows.join(sizes, group)
    largest = Window.partitionBy(member).orderBy(F.desc("_size"), *[F.desc(g) for g in group])
    aside = cut_lineage(sized.withColumn("_n", F.row_number().over(largest)).filter(F.col("_n") < least).select(*group, member))
    rest = rows.join(aside, [*group, member], "left_anti")
    if crowded_blocks(rest, group) and (blocks := crowded_blocks(rows, group)):
        return packed_pairs(rows, group, member, blocks, least, name)  # many groups are large
    found = counted(rest, "_found")
    # groups set aside by a that b has, and groups set aside by b that a has and has not set aside itself
    of_a = found.select("a", "b").join(aside.withColumnRenamed(member, "a"), "a").join(rows.withColumnRenamed(member, "b"), [*group, "b"], "left_semi")
    of_b = found.select("a", "b").join(aside.withColumnRenamed(member, "b"), "b").join(rest.withColumnRenamed(member, "a"), [*group, "a"], "left_semi")
    more = of_a.select("a", "b").unionByName(of_b.select("a", "b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("_more"))
    total = F.col("_found") + F.coalesce("_more", F.lit(0))
    return found.join(more, ["a", "b"], "left").select("a", "b", total.alias(name)).filter(F.col(name) >= least)
