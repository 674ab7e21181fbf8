"""Co-location and call graphs.

Undirected edges are ``(a, b, weight)`` with ``a < b``; directed ones ``(src, dst, weight)``.
Iterative operators keep their state in DataFrames and cut lineage by reliable checkpoints;
the driver only ever sees a row count or a checksum, and of few nodes' eigenvectors the values.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.scalar import bin_start, pct
from ..plans.joins import counted_pairs, numbered_pairs_in_tasks, pair_members, pairs_in_tasks
from ..session import cut_lineage


def _one_row(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach a one-row table of totals to every row."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(totals.withColumn("_k", F.lit(1))), "_k").drop("_k")


# -- edges -------------------------------------------------------------------------------

def colocation_edges(df: DataFrame, seconds: int = 300, least: int = 3) -> DataFrame:
    """Numbers at the same tower in the same tumbling bin; weight = number of such bins.

    Exact pruning first: a number seen in fewer than ``least`` bins cannot have an edge, and an edge needs
    a common bin besides the ``least - 1`` most crowded of either number (``counted_pairs``).  What is left
    of a crowded bin is paired block by block; no bin is left out.
    """
    cells = df.select("tower_id", bin_start("timestamp", seconds).alias("bin"), "mobile_number").distinct()
    enough = cells.groupBy("mobile_number").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("mobile_number")
    cells = cells.join(enough, "mobile_number", "left_semi")
    return counted_pairs(cells, ["tower_id", "bin"], "mobile_number", least, "weight")


def call_edges(df: DataFrame) -> DataFrame:
    """Directed call counts."""
    rows = df.filter(F.col("a_party").isNotNull() & F.col("b_party").isNotNull())
    return rows.groupBy(F.col("a_party").alias("src"), F.col("b_party").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))


def _ends(rows: int = 1_000_000, both: bool = True):
    """A task's function: how often every node is an end (or, if not ``both``, the first end) of ``rows`` edges (a, b)
    at a time.  Nothing of this module is imported in the task."""
    import numpy as np
    import pyarrow as pa

    def counted(held):
        t = pa.Table.from_batches(held)
        ends = pa.chunked_array(t["a"].chunks + (t["b"].chunks if both else []))
        if pa.types.is_dictionary(ends.type):
            ends = ends.unify_dictionaries().combine_chunks()
            times = np.bincount(ends.indices.to_numpy(zero_copy_only=False), minlength=len(ends.dictionary))
            seen = np.flatnonzero(times)
            found = pa.table({"node": ends.dictionary.take(pa.array(seen)), "degree": pa.array(times[seen])})
        else:
            times = ends.value_counts()
            found = pa.table({"node": times.field("values"), "degree": times.field("counts")})
        return found.to_batches(max_chunksize=100_000)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= rows:
                yield from counted(held)
                held, n = [], 0
        if n:
            yield from counted(held)

    return run


def degrees(e: DataFrame, both: bool = True) -> DataFrame:
    """Neighbours of every node (if not ``both``, edges it is the ``a`` of), counted where the edges are made: of a million
    edges a row per node is shuffled."""
    layout = StructType([StructField("node", e.schema["a"].dataType), StructField("degree", LongType())])
    return pairs_in_tasks(e, _ends(both=both), layout).groupBy("node").agg(F.sum("degree").alias("degree"))


def _few_neighbours(listed: int, rows: int = 1_000_000):
    """A task's function: of every ``rows`` edges (a, b), for every node its ``degree`` in them and its first
    ``listed`` neighbours.  Nothing of this module is imported in the task."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def ends(held):
        t = pa.Table.from_batches(held)
        both = pa.chunked_array(t["a"].chunks + t["b"].chunks).unify_dictionaries().combine_chunks().dictionary_encode()
        names = pa.concat_arrays([both.dictionary, pa.nulls(1, both.dictionary.type)])  # the last is no name
        order = pc.sort_indices(names, null_placement="at_start").to_numpy()
        names, rank = names.take(pa.array(order)), np.argsort(order)
        code = rank[both.indices.fill_null(len(order) - 1).to_numpy(zero_copy_only=False)]
        a, b = code[:len(t)], code[len(t):]
        pairs = np.sort(np.r_[a, b] * len(order) + np.r_[b, a])
        u, v = pairs // len(order), pairs % len(order)
        starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        degree = np.diff(np.r_[starts, len(u)])
        shown = np.minimum(degree, listed)
        until = np.cumsum(shown)
        at = np.arange(until[-1]) + np.repeat(starts - (until - shown), shown)
        few = pa.ListArray.from_arrays(pa.array(np.r_[0, until].astype(np.int32)), names.take(pa.array(v[at])))
        return pa.table({"node": names.take(pa.array(u[starts])), "degree": pa.array(degree), "few": few}).to_batches(max_chunksize=100_000)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= rows:
                yield from ends(held)
                held, n = [], 0
        if n:
            yield from ends(held)

    return run


def degree_centrality(e: DataFrame, hub: int = 10, listed: int = 5) -> DataFrame:
    """Degree, degree / (n - 1), whether a hub, and the first few neighbours.

    Edges are counted where they are made, a million at a time, so no edge is shuffled or sorted.
    """
    who = e.schema["a"].dataType
    layout = StructType([StructField("node", who), StructField("degree", LongType()), StructField("few", ArrayType(who))])
    parts = pairs_in_tasks(e, _few_neighbours(listed), layout)
    few = F.array_compact(F.slice(F.sort_array(F.flatten(F.collect_list("few"))), 1, listed))
    d = cut_lineage(parts.groupBy("node").agg(F.sum("degree").alias("degree"), few.alias("neighbours")))  # read twice below
    out = _one_row(d, d.agg(F.count(F.lit(1)).alias("_nodes"))).filter(F.col("node").isNotNull())
    return out.select("node", "degree", F.when(F.col("_nodes") > 1, F.col("degree") / (F.col("_nodes") - 1)).otherwise(0.0).alias("centrality"),
                      (F.col("degree") >= hub).alias("hub"), "neighbours")


def in_out_degree(e: DataFrame) -> DataFrame:
    """Distinct partners in both directions per party of a directed graph."""
    ends = e.select(F.inline(F.array(
        F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
    return ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def top_degrees(e: DataFrame, k: int = 3) -> DataFrame:
    d = in_out_degree(e)
    top = lambda c, name: d.orderBy(F.desc(c), "node").limit(k).select(F.lit(name).alias("kind"), "node", F.col(c).alias("partners"))
    return top("in_degree", "RECEIVER").unionByName(top("out_degree", "CALLER"))


def hub_traits(df: DataFrame, hubs: DataFrame, towers: int = 5) -> DataFrame:
    """Mobile if some dump has more than ``towers`` towers; odd-hour if any record is at hours 0-5."""
    rows = df.join(hubs.select(F.col("node").alias("mobile_number")), "mobile_number", "left_semi")
    per = rows.groupBy("mobile_number", "dump_id").agg(F.count_distinct("tower_id").alias("t"), F.bool_or(F.hour("timestamp") <= 5).alias("o"))
    return per.groupBy("mobile_number").agg((F.max("t") > towers).alias("mobile"), F.bool_or("o").alias("odd_hour"))


# -- components --------------------------------------------------------------------------

def _forest(rows: int = 1_000_000):
    """A task's function: of every ``rows`` edges (a, b), as many of stars as connect the same nodes, one per node
    at most.  Nothing of this module is imported in the task."""
    import numpy as np
    import pyarrow as pa

    def stars(held):
        t = pa.Table.from_batches(held)
        ends = pa.chunked_array(t["a"].chunks + t["b"].chunks).unify_dictionaries().combine_chunks().dictionary_encode()
        code = ends.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        a, b, low = code[:len(t)], code[len(t):], np.arange(len(ends.dictionary))
        while True:
            of_a, of_b = low[a], low[b]
            if (of_a == of_b).all():
                break
            least = np.minimum(of_a, of_b)
            np.minimum.at(low, of_a, least)
            np.minimum.at(low, of_b, least)
            while not np.array_equal(nearer := low[low], low):
                low = nearer
        own = np.flatnonzero(low != np.arange(len(low)))
        out = pa.table({"a": ends.dictionary.take(pa.array(low[own])), "b": ends.dictionary.take(pa.array(own))})
        return out.to_batches(max_chunksize=100_000)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= rows:
                yield from stars(held)
                held, n = [], 0
        if n:
            yield from stars(held)

    return run


def components(e: DataFrame) -> DataFrame:
    """(node, component) by alternating large-star and small-star steps (Kiveris et al. 2014).

    Edges are first thinned where they are made: a million of them, or a partition's, become stars of the same nodes.
    Each step is one aggregate and one join on the node, so a hub is split like any skewed join
    key; the number of rounds grows with the logarithm of the longest path.  The component is
    named by its smallest node.
    """
    layout = StructType([StructField(c, e.schema[c].dataType) for c in ("a", "b")])
    links = cut_lineage(pairs_in_tasks(e if "_made" in e.__dict__ else e.filter("a <> b"), _forest(), layout).distinct())
    before = None
    while True:
        # large star: every larger neighbour of u goes to the smallest node around u
        around = links.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        links = around.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u")
        links = moved.select(F.inline(F.array(
            F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b"))))).filter("a <> b").distinct()
        links = cut_lineage(links)
        state = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)


def cluster_stats(e: DataFrame, c: DataFrame, least: int = 3) -> DataFrame:
    """Size, density and mean degree of components with at least ``least`` members."""
    sizes = c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    per = degrees(e, both=False).select(F.col("node").alias("a"), F.col("degree").alias("_n"))  # nodes are joined, not edges
    edges = per.join(c.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.sum("_n").alias("edges"))
    n = F.col("size")
    return sizes.join(edges, "component").select(
        "component", "size", "edges", (2.0 * F.col("edges") / (n * (n - 1))).alias("density"), (2.0 * F.col("edges") / n).alias("mean_degree"))


def cluster_traits(df: DataFrame, c: DataFrame, least: int = 3, hour_share: float = 30, tower_share: float = 40) -> DataFrame:
    """Dominant hour and tower of a component's records, where concentrated enough."""
    big = c.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least).select("component")
    rows = df.join(c.join(big, "component", "left_semi").select(F.col("node").alias("mobile_number"), "component"), "mobile_number")
    per = rows.groupBy("component", F.hour("timestamp").alias("hour"), "tower_id").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("component").agg(F.sum("n").alias("records"))
    hours = per.groupBy("component", "hour").agg(F.sum("n").alias("n")).groupBy("component").agg(F.max(F.struct("n", (-F.col("hour")).alias("neg"))).alias("h"))
    towers = per.groupBy("component", "tower_id").agg(F.sum("n").alias("n"))
    towers = towers.groupBy("component").agg(F.max("n").alias("tn"), F.min_by("tower_id", F.struct((-F.col("n")).alias("m"), "tower_id")).alias("tower"))
    out = total.join(hours, "component").join(towers, "component")
    return out.select("component", "records", F.when(pct(F.col("h.n"), F.col("records")) > hour_share, -F.col("h.neg")).alias("dominant_hour"),
                      F.when(pct(F.col("tn"), F.col("records")) > tower_share, F.col("tower")).alias("dominant_tower"))


# -- centralities ------------------------------------------------------------------------

def pivots(nodes: DataFrame, n: int, error: float, risk: float = 0.05, seed: int = 0) -> DataFrame:
    """Sources from which normalized betweenness is within ``error`` for all ``n`` nodes at once, but for a
    chance of ``risk``: a source adds at most n / (n - 1) times the mean's unit, so Hoeffding's bound over all
    nodes asks for ln(2 n / risk) / (2 error^2) of them.  They are those of the smallest hash; all nodes, if
    the bound asks for as many."""
    k = math.ceil(math.log(2 * n / risk) * (n / (n - 1)) ** 2 / (2 * error**2)) if n > 1 else n
    return nodes if k >= n else nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(k)


#: Nodes whose values, and edges whose lists are broadcast at most.
FEW_NODES, FEW_EDGES = 2_000_000, 4_000_000


#: Sources that a task follows together, and entries of its tables (nodes times sources) at most.
TOGETHER, TOGETHER_ENTRIES = 64, 1 << 23


def _path_shares(at_once: int = 1 << 21):
    """A task's function: from rows (group, sources, u, vs), whole graphs by node number one after another, each with
    the list of its sources, (id, share): what the shortest paths from these sources put on every node between
    their ends.  Levels are tables of nodes by sources; a level looks at the neighbours of the one before it
    only, and gathers some ``at_once`` entries together.  Nothing of this module is imported in the task."""
    import numpy as np
    import pyarrow as pa

    def shares(sources, us, lists):
        count = np.concatenate([vs.value_lengths().to_numpy(zero_copy_only=False) for vs in lists]).astype(np.int64)
        u, v = np.repeat(np.concatenate(us), count), np.concatenate([vs.flatten().to_numpy() for vs in lists])
        ids, u = np.unique(u, return_inverse=True)
        sources = sources[np.isin(sources, ids)]
        near = np.searchsorted(ids, v)[np.argsort(u, kind="stable")].astype(np.int32)
        size = np.bincount(u, minlength=len(ids))
        first = np.cumsum(size) - size
        n, k = len(ids), len(sources)
        del u, v, us, lists
        if not k:
            return pa.RecordBatch.from_pydict({"id": pa.array([], pa.int64()), "share": pa.array([], pa.float64())})

        def neighbours(rows):
            some = size[rows]
            return near[np.arange(some.sum()) + np.repeat(first[rows] - (np.cumsum(some) - some), some)]

        def pull(table, rows):
            """Sums of ``table`` over the neighbours of ``rows``."""
            out, start, until, step = np.empty((len(rows), k)), 0, np.cumsum(size[rows]), max(1, at_once // k)
            while start < len(rows):
                stop = max(start + 1, int(np.searchsorted(until, (until[start - 1] if start else 0) + step, "right")))
                some = size[rows[start:stop]]
                if some.sum() < 16 * (stop - start):
                    out[start:stop] = np.add.reduceat(table[neighbours(rows[start:stop])], np.cumsum(some) - some, axis=0)
                else:  # long lists are summed one by one, which is several times faster
                    for i in range(start, stop):
                        at, end = first[rows[i]], first[rows[i]] + size[rows[i]]
                        np.add.reduce(table.take(near[at:min(at + step, end)], axis=0), axis=0, out=out[i])
                        for more in range(at + step, end, step):
                            out[i] += np.add.reduce(table.take(near[more:min(more + step, end)], axis=0), axis=0)
                start = stop
            return out

        start = np.searchsorted(ids, sources)
        table, sigma, depth = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), -1, np.int32)
        table[start, np.arange(k)] = sigma[start, np.arange(k)] = 1
        depth[start, np.arange(k)] = 0
        levels, marked = [np.unique(start)], np.zeros(n, bool)
        while True:
            ahead = levels[-1]
            marked[neighbours(ahead)] = True
            rows = np.flatnonzero(marked)
            marked[rows] = False
            rows = rows[(depth[rows] < 0).any(axis=1)]
            reached = pull(table, rows)
            reached[depth[rows] >= 0] = 0
            there = reached.any(axis=1)
            rows, reached = rows[there], reached[there]
            table[ahead] = 0
            if not len(rows):
                break
            table[rows] = reached
            sigma[rows] += reached
            found = depth[rows]
            found[reached > 0] = len(levels)
            depth[rows] = found
            levels.append(rows)
        delta = np.zeros((n, k))
        for at in range(len(levels) - 1, 0, -1):
            rows, above = levels[at], levels[at - 1]
            here = depth[rows] == at
            table[rows] = np.where(here, (1 + delta[rows]) / np.where(here, sigma[rows], 1), 0)
            pulled = pull(table, above) * sigma[above]
            delta[above] = np.where(depth[above] == at - 1, pulled, delta[above])
            table[rows] = 0
        delta[start, np.arange(k)] = 0
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(delta.sum(axis=1))], names=["id", "share"])

    def run(batches):
        at, us, lists = None, [], []
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            ends = [*((group[1:] != group[:-1]).nonzero()[0] + 1), len(group)] if len(group) else []
            start = 0
            for end in ends:
                if at is not None and group[start] != at:
                    yield shares(sources, us, lists)
                    at, us, lists = None, [], []
                if at is None:
                    at, sources = group[start], np.array(batch.column(1)[start].as_py(), np.int64)
                us.append(batch.column(2).slice(start, end - start).to_numpy())
                lists.append(batch.column(3).slice(start, end - start))
                start = end
        if at is not None:
            yield shares(sources, us, lists)

    return run


def _packed_path_sums(e: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """(node, _sum) for a graph of few edges: its packed lists go to every task, sources are dealt to tasks."""
    nodes, lists, _ = neighbour_lists(e)
    sources = cut_lineage(starts.join(nodes, "node").select(F.col("id").alias("_s")))
    groups = max(1, math.ceil(sources.count() / max(1, min(TOGETHER, TOGETHER_ENTRIES // max(n, 1)))))
    dealt = sources.groupBy(F.pmod(F.xxhash64("_s"), F.lit(groups)).cast("bigint").alias("_g")).agg(F.collect_list("_s").alias("sources"))
    tasks = e.sparkSession.range(0, groups, 1, min(groups, 10_000)).withColumnRenamed("id", "_g")
    sent = tasks.join(F.broadcast(dealt), "_g").select("_g", "sources").crossJoin(F.broadcast(lists.select("u", "vs")))
    sums = sent.mapInArrow(_path_shares(), "id bigint, share double").groupBy("id").agg(F.sum("share").alias("_sum"))
    return nodes.join(sums, "id").select("node", "_sum")


def _path_sums(step: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, _sum) with a row per source and node and level."""
    frontier = starts.select(F.col("node").alias("source"), "node", F.lit(1.0).alias("sigma"))
    seen = frontier.select("source", "node")
    levels = [cut_lineage(frontier)]
    while True:
        reached = levels[-1].join(step, levels[-1]["node"] == step["u"]).groupBy("source", F.col("v").alias("node")).agg(F.sum("sigma").alias("sigma"))
        fresh = cut_lineage(reached.join(seen, ["source", "node"], "left_anti"))
        if fresh.isEmpty():
            break
        levels.append(fresh)
        seen = seen.unionByName(fresh.select("source", "node"))
    gathered = None
    below = None  # (source, node, sigma, delta) one level further out
    for level in reversed(levels):
        if below is None:
            here = level.withColumn("delta", F.lit(0.0))
        else:
            pulled = below.join(step, below["node"] == step["u"]).select("source", F.col("v").alias("node"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
            shares = pulled.groupBy("source", "node").agg(F.sum("share").alias("share"))
            here = level.join(shares, ["source", "node"], "left").select("source", "node", "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta"))
            here = cut_lineage(here)
        part = here.filter("source <> node").select("node", "delta")
        gathered = part if gathered is None else gathered.unionByName(part)
        below = here
    return gathered.groupBy("node").agg(F.sum("delta").alias("_sum"))


def betweenness(e: DataFrame, sources: DataFrame | None = None, error: float | None = None, risk: float = 0.05, seed: int = 0) -> DataFrame:
    """Normalized betweenness by level-synchronous shortest-path counting and back-propagation.

    All nodes are sources, so the result is exact, which means nodes squared.  Only who names ``sources`` (column
    ``node``) or an ``error`` gets an estimate, from these or from as many as ``pivots`` asks for, scaled to all
    nodes.  A graph of at most ``FEW_EDGES`` edges is sent to the tasks, which follow their sources in it; in a
    larger one state is a row per (source, node).
    """
    e = cut_lineage(e.select("a", "b"))
    step = both_ways(e)
    nodes = step.select(F.col("u").alias("node")).distinct()
    size = nodes.count()
    if sources is not None:
        starts = sources.select("node").distinct()
    else:
        starts = nodes if error is None else cut_lineage(pivots(nodes, size, error, risk, seed))
    sums = _packed_path_sums(e, starts, size) if size <= FEW_NODES and e.count() <= FEW_EDGES else _path_sums(cut_lineage(step), starts)
    n = nodes.agg(F.count(F.lit(1)).alias("_n"))
    used = starts.agg(F.count(F.lit(1)).alias("_used"))
    out = _one_row(_one_row(nodes.join(sums, "node", "left"), n), used)
    scale = F.when(F.col("_n") > 2, F.col("_n") / F.col("_used") / ((F.col("_n") - 1) * (F.col("_n") - 2))).otherwise(0.0)
    return out.select("node", (F.coalesce("_sum", F.lit(0.0)) * scale).alias("betweenness"))


def _neighbour_lists(rows: int = 1_000_000):
    """A task's function: of every ``rows`` edges (a, b), node numbers, lists of the neighbours ``vs`` of every node
    ``u`` in them, both ways.  Nothing of this module is imported in the task."""
    import numpy as np
    import pyarrow as pa

    def lists(held):
        t = pa.Table.from_batches(held)
        a, b = t["a"].to_numpy(), t["b"].to_numpy()
        u, v = np.r_[a, b], np.r_[b, a]
        by = np.argsort(u, kind="stable")
        u, v = u[by], v[by]
        starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        vs = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(u)].astype(np.int32)), pa.array(v))
        return pa.table({"u": pa.array(u[starts]), "vs": vs}).to_batches(max_chunksize=2_000)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= rows:
                yield from lists(held)
                held, n = [], 0
        if n:
            yield from lists(held)

    return run


def neighbour_lists(e: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Edges packed for many readings: nodes with their numbers ``id``, rows (u, vs) of numbers that hold every
    neighbour once (a node may have several rows), and whether nodes are few enough to be broadcast."""
    nodes = cut_lineage(degrees(e).select("node", F.monotonically_increasing_id().alias("id")))
    few = nodes.count() <= FEW_NODES
    small = F.broadcast if few else lambda df: df
    numbered = e.select("a", "b").join(small(nodes.select(F.col("node").alias("a"), F.col("id").alias("_a"))), "a").join(
        small(nodes.select(F.col("node").alias("b"), F.col("id").alias("_b"))), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return nodes, cut_lineage(numbered.mapInArrow(_neighbour_lists(), "u bigint, vs array<bigint>")), few


def _adjacent(rows: int = 1_000_000):
    """A task's function: of every ``rows`` edges (a, b), numbers below 2^31, rows (u, high, vs): the neighbours of u
    whose numbers are high * 65536 and two bytes more, both ways.  Nothing of this module is imported in the task."""
    import numpy as np
    import pyarrow as pa

    def lists(held):
        t = pa.Table.from_batches(held)
        a, b = t["a"].to_numpy().astype(np.int64), t["b"].to_numpy().astype(np.int64)
        pairs = np.sort(np.r_[a << 32 | b, b << 32 | a])
        at = np.flatnonzero(np.r_[True, pairs[1:] >> 16 != pairs[:-1] >> 16])
        low = pa.py_buffer((pairs & 65535).astype("<u2").tobytes())
        vs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.r_[at, len(pairs)] * 2).astype(np.int32).tobytes()), low])
        out = pa.table({"u": pa.array(pairs[at] >> 32), "high": pa.array((pairs[at] >> 16 & 65535).astype(np.int32)), "vs": vs})
        return out.to_batches(max_chunksize=10_000)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= rows:
                yield from lists(held)
                held, n = [], 0
        if n:
            yield from lists(held)

    return run


def _products(sent):
    """A task's function: rows (u, high, vs) of ``_adjacent`` to (id, x), the sums of the broadcast values over
    neighbours, those of a batch of rows together.  Nothing of this module is imported in the task."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        values = sent.value
        for batch in batches:
            if not len(batch):
                continue
            u, high, vs = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            vs = vs.cast(pa.large_binary())
            ends = np.frombuffer(vs.buffers()[1], np.int64)[vs.offset:vs.offset + len(vs) + 1] // 2
            low = np.frombuffer(vs.buffers()[2], "<u2")[ends[0]:ends[-1]]
            sums = np.add.reduceat(values[low + np.repeat(high << 16, np.diff(ends))], ends[:-1] - ends[0])
            ids, at = np.unique(u, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(at, sums))], names=["id", "x"])

    return run


def _few_powers(e: DataFrame, nodes: DataFrame, iters: int, tol: float, per_round: int) -> DataFrame:
    """``eigenvector`` of few nodes: packed lists stay in the tasks of their nodes, values are sent to them and back."""
    import numpy as np

    context = e.sparkSession.sparkContext
    if "_members" in e.__dict__:
        step = numbered_pairs_in_tasks(e, nodes.select("node", "id"), _adjacent(), "u bigint, high int, vs binary")
    else:
        number = lambda c: F.broadcast(nodes.select(F.col("node").alias(c), F.col("id").alias(f"_{c}")))
        step = e.select("a", "b").join(number("a"), "a").join(number("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        step = step.mapInArrow(_adjacent(), "u bigint, high int, vs binary")
    step = cut_lineage(step.repartition("u"))  # a node's lists are in one task
    inside = np.sort(np.array([r["u"] for r in step.select("u").distinct().collect()], np.int64))
    x = np.zeros(int(inside[-1]) + 1 if len(inside) else 0)
    x[inside] = 1
    done, converged = 0, False
    while done < iters and not converged:
        y = x
        for _ in range(per_round):
            sent = context.broadcast(y)
            sums = step.mapInArrow(_products(sent), "id bigint, x double").groupBy("id").agg(F.sum("x").alias("x")).toArrow()
            z = y.copy()  # A + I
            np.add.at(z, sums["id"].to_numpy(), sums["x"].to_numpy())
            sent.destroy()
            y = z
        y = y / (np.sqrt((y * y).sum()) or 1.0)
        done += per_round
        change = np.abs(y - x).sum()
        x, converged = y, bool(not len(inside) or change < len(inside) * tol)
    import pyarrow as pa

    found = e.sparkSession.createDataFrame(pa.table({"id": pa.array(inside), "centrality": pa.array(x[inside])}))
    return nodes.join(F.broadcast(found), "id").select("node", "centrality", F.lit(converged).alias("converged"))


def eigenvector(e: DataFrame, iters: int = 100, tol: float = 1e-6, per_round: int = 4) -> DataFrame:
    """Eigenvector centrality by power iteration on A + I with unit length.

    ``per_round`` multiplications come before the length and the change are tested, because the direction alone
    matters until then.  ``converged`` (the same for all nodes)
    says whether the last round changed the entries by less than ``tol`` on average; where the two
    largest eigenvalues are close, as in long paths, ``iters`` may end before.  Up to ``FEW_NODES`` nodes, edges are
    packed to two bytes each way and stay in tasks; only values of nodes are sent.
    """
    members = pair_members(e)
    nodes = (degrees(e).select("node", F.lit(0).alias("_b")) if members is None else members).filter("node IS NOT NULL")
    nodes = cut_lineage(nodes)
    if nodes.count() <= FEW_NODES:
        # dense numbers, those of a block together
        nodes = cut_lineage(nodes.coalesce(1).sortWithinPartitions("_b", "node").select("node", F.monotonically_increasing_id().alias("id")))
        return _few_powers(e, nodes, iters, tol, per_round)
    nodes, step, few = neighbour_lists(e)
    small = F.broadcast if few else lambda df: df
    step = step.unionByName(nodes.select(F.col("id").alias("u"), F.array("id").alias("vs")))  # A + I
    x = cut_lineage(nodes.select("id", F.lit(1.0).alias("x")))
    done, converged = 0, False
    while done < iters and not converged:
        y = x
        for _ in range(per_round):
            sent = step.join(small(y.withColumnRenamed("id", "u")), "u").select(F.explode("vs").alias("id"), "x")
            y = sent.groupBy("id").agg(F.sum("x").alias("x"))
        y = cut_lineage(y)
        norm = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_norm"))
        y = cut_lineage(_one_row(y, norm).select("id", (F.col("x") / F.col("_norm")).alias("x")))
        done += per_round
        change = y.join(x.withColumnRenamed("x", "_old"), "id").agg(F.sum(F.abs(F.col("x") - F.col("_old"))).alias("d"), F.count(F.lit(1)).alias("n")).first()
        x, converged = y, change["n"] == 0 or change["d"] < change["n"] * tol
    return nodes.join(x, "id").select("node", F.col("x").alias("centrality"), F.lit(converged).alias("converged"))


def peripheral(centrality: DataFrame, below: float = 0.5, more_than: int = 10) -> DataFrame:
    """Nodes under ``below`` times the mean, in graphs of more than ``more_than`` nodes."""
    stats = centrality.agg(F.avg("centrality").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    out = _one_row(centrality, stats)
    return out.filter((F.col("_n") > more_than) & (F.col("centrality") < F.col("_mean") * below)).select("node", "centrality")


# -- cliques -----------------------------------------------------------------------------

def maximal_cliques(e: DataFrame, least: int = 3) -> DataFrame:
    """All maximal cliques with at least ``least`` members.

    Edges point from the lower to the higher degree, so a neighbourhood to be searched in one
    task has at most sqrt(2 * edges) nodes, however large a hub is.  With each of its nodes come the neighbours it
    shares with the root, as a list: those of higher degree may join a clique, those of lower degree shut it, as it
    is not maximal or found there.
    """
    e = cut_lineage(e.select("a", "b"))
    d = degrees(e)
    ranked = e.join(d.select(F.col("node").alias("a"), F.col("degree").alias("_da")), "a").join(d.select(F.col("node").alias("b"), F.col("degree").alias("_db")), "b")
    a, b = F.struct(F.col("_da").alias("d"), F.col("a").alias("id")), F.struct(F.col("_db").alias("d"), F.col("b").alias("id"))
    out = ranked.select(F.when(a < b, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(a < b, F.col("b")).otherwise(F.col("a")).alias("v"))
    around = cut_lineage(both_ways(e).groupBy("u").agg(F.collect_list("v").alias("vs")))
    small = F.broadcast if e.count() <= FEW_EDGES else lambda df: df
    local = out.join(small(around.select("u", F.col("vs").alias("_us"))), "u").join(small(around.select(F.col("u").alias("v"), F.col("vs").alias("_vs"))), "v")
    local = local.select("u", "v", F.array_intersect("_us", "_vs").alias("ws"))

    def search(pdf):
        import pandas as pd

        near: dict[str, set] = {v: set() for v in pdf["v"]}
        higher = set(near)
        for v, ws in zip(pdf["v"], pdf["ws"]):
            for w in ws:
                near[v].add(w)
                near.setdefault(w, set()).add(v)
        root, found = pdf["u"].iloc[0], []
        stack = [(frozenset(), higher, set(near) - higher)]
        while stack:
            chosen, open_, shut = stack.pop()
            if not open_ and not shut:
                if len(chosen) + 1 >= least:
                    found.append((root, sorted([root, *chosen])))
                continue
            pivot = max(open_ | shut, key=lambda n: len(near[n] & open_))
            for n in sorted(open_ - near[pivot]):
                stack.append((chosen | {n}, open_ & near[n], shut & near[n]))
                open_ = open_ - {n}
                shut = shut | {n}
        return pd.DataFrame(found, columns=["root", "members"])

    found = local.groupBy("u").applyInPandas(search, "root string, members array<string>")
    return found.select("members", F.size("members").alias("size"))


# -- over time, isolated, roles ----------------------------------------------------------

def network_evolution(df: DataFrame, seconds: int = 300, change: float = 0.5, least: int = 1) -> DataFrame:
    """Per day: nodes (lone devices too), edges, density, components, growth against the first
    day and whether the number of nodes jumped.  An edge is ``least`` common bins of a day; with more than
    one, crowded bins make no pairs of their own (``counted_pairs``)."""
    cells = df.select(F.to_date("timestamp").alias("day"), "tower_id", bin_start("timestamp", seconds).alias("bin"), "mobile_number").distinct()
    # a member is a number on a day, so bins of other days are not in common
    daily = cut_lineage(cells.select("tower_id", "bin", F.concat_ws("|", F.col("day").cast("string"), "mobile_number").alias("m")))
    pairs = counted_pairs(daily, ["tower_id", "bin"], "m", least)
    nodes = cells.select("day", "mobile_number").distinct().groupBy("day").agg(F.count(F.lit(1)).alias("nodes"))
    day = lambda c: F.to_date(F.substring_index(c, "|", 1)).alias("day")
    edges = degrees(pairs, both=False).groupBy(day("node")).agg(F.sum("degree").alias("edges"))
    if least <= 1:  # who shares a bin is connected by its first member
        firsts = daily.groupBy("tower_id", "bin").agg(F.min("m").alias("a"))
        pairs = daily.withColumnRenamed("m", "b").join(firsts, ["tower_id", "bin"]).filter("a <> b").select("a", "b")
    comps = components(pairs)
    linked = comps.select(day("node"), "node", "component").groupBy("day").agg(
        F.count(F.lit(1)).alias("_linked"), F.count_distinct("component").alias("_groups"))
    out = nodes.join(edges, "day", "left").join(linked, "day", "left").fillna(0, ["edges", "_linked", "_groups"])
    n = F.col("nodes")
    w = Window.orderBy("day")  # one row per day
    first = lambda c: F.first(c).over(w)
    return out.select(
        "day", "nodes", "edges", F.when(n > 1, 2.0 * F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"),
        (F.col("_groups") + n - F.col("_linked")).alias("components"),
        ((n - first("nodes")) * 100.0 / first("nodes")).alias("node_growth_pct"),
        F.when(first("edges") > 0, (F.col("edges") - first("edges")) * 100.0 / first("edges")).otherwise(0.0).alias("edge_growth_pct"),
        F.coalesce(F.abs(n - F.lag("nodes").over(w)) / F.lag("nodes").over(w) > change, F.lit(False)).alias("sudden_change"))


def isolated_devices(df: DataFrame, e: DataFrame) -> DataFrame:
    """Devices outside the graph with an activity class."""
    per = df.groupBy("mobile_number").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("tower_id").alias("towers"))
    inside = degrees(e).select(F.col("node").alias("mobile_number"))
    return per.join(inside, "mobile_number", "left_anti").withColumn(
        "activity", F.when(F.col("towers") == 1, "STATIONARY").when(F.col("records") < 5, "MINIMAL").otherwise("MOBILE_ISOLATED"))


def weak_devices(e: DataFrame, most: int = 2) -> DataFrame:
    return degrees(e).filter(F.col("degree") <= most)


def call_roles(e: DataFrame, factor: float = 1.5, least_nodes: int = 5) -> DataFrame:
    """Outgoing, balanced and incoming parties by distinct partners against the mean."""
    d = in_out_degree(e)
    out = _one_row(d, d.agg(F.avg("in_degree").alias("_i"), F.avg("out_degree").alias("_o"), F.count(F.lit(1)).alias("_n")))
    i, o = F.col("in_degree"), F.col("out_degree")
    high_in, high_out = i > F.col("_i") * factor, o > F.col("_o") * factor
    role = (F.when(high_out & (i < F.col("_i")), "OUTGOING").when(high_in & high_out, "BALANCED").when(high_in & (o < F.col("_o")), "INCOMING"))
    ratio = F.when(role == "OUTGOING", o / (i + 1)).when(role == "INCOMING", i / (o + 1)).otherwise((i + o).cast("double"))
    return out.filter(F.col("_n") >= least_nodes).select("node", "in_degree", "out_degree", role.alias("role"), ratio.alias("ratio")).filter(F.col("role").isNotNull())


def role_pairs(roles: DataFrame, k: int = 2) -> DataFrame:
    """The ``k`` strongest outgoing parties against the ``k`` strongest incoming ones."""
    def top(role, name):
        w = Window.partitionBy("role").orderBy(F.desc("ratio"), "node")
        return roles.filter(F.col("role") == role).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).select(F.col("node").alias(name), F.lit(1).alias("_k"))

    return top("OUTGOING", "source").join(top("INCOMING", "target"), "_k").drop("_k")


def shortest_paths(e: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Shortest directed paths of more than one hop between the given pairs; among equally short
    ones the first in node order.  A breadth-first search from the few sources, one join per hop, until nothing new is reached (or for
    ``max_hops`` hops, where that is given)."""
    hop = cut_lineage(e.select(F.col("src").alias("_u"), F.col("dst").alias("_v")).filter("_u <> _v"))
    pairs = cut_lineage(pairs.select("source", "target").distinct())
    frontier = pairs.select("source").distinct().select("source", F.col("source").alias("node"), F.array("source").alias("path"))
    frontier = cut_lineage(frontier)
    seen, found = frontier.select("source", "node"), None
    for _ in range(max_hops) if max_hops is not None else itertools.count():
        reached = frontier.join(hop, frontier["node"] == hop["_u"]).select("source", F.col("_v").alias("node"), F.array_append("path", F.col("_v")).alias("path"))
        frontier = cut_lineage(reached.groupBy("source", "node").agg(F.min("path").alias("path")).join(seen, ["source", "node"], "left_anti"))
        hits = frontier.join(pairs.withColumnRenamed("target", "node"), ["source", "node"], "left_semi")
        found = hits if found is None else found.unionByName(hits)
        seen = seen.unionByName(frontier.select("source", "node"))
        if frontier.isEmpty():
            break
    return found.filter(F.size("path") > 2).select("source", F.col("node").alias("target"), "path", (F.size("path") - 1).alias("hops"))


def network_summary(e: DataFrame, c: DataFrame | None = None) -> DataFrame:
    """Nodes, edges, density, components and mean degree."""
    c = components(e) if c is None else c
    groups = c.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("component").alias("components"))
    edges = degrees(e, both=False).agg(F.coalesce(F.sum("degree"), F.lit(0)).alias("edges"))
    n = F.col("nodes")
    return _one_row(groups, edges).select(
        "nodes", "edges", F.when(n > 1, 2.0 * F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"), "components",
        F.when(n > 0, 2.0 * F.col("edges") / n).otherwise(0.0).alias("mean_degree"))
