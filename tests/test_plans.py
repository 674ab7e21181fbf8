"""Shared plan shapes: skew-safe windows, sweeps, band and interval joins, block pairs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallymast.plans import joins, shards

US = 1_000_000


@pytest.fixture(scope="module")
def events(spark):
    """One key holds two thirds of the rows; times repeat."""
    rng = random.Random(7)
    rows = []
    for n in range(900):
        key = "hot" if n % 3 else rng.choice(["a", "b", None])
        rows.append((key, rng.randrange(0, 4000), n, rng.choice("vwxyz")))
    df = spark.createDataFrame(rows, "k string, s bigint, id bigint, v string")
    return df.select("k", F.timestamp_micros(F.col("s") * US).alias("ts"), "id", "v").repartition(7).cache()


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("hot_rows", [40, 10**9])
def test_neighbours_equal_plain_window(events, hot_rows):
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = events.select("k", "ts", "id", "v", F.lag("v").over(w).alias("p"), F.lead("id").over(w).alias("n"))
    got = shards.neighbours(events, ["k"], "ts", prev={"p": "v"}, next={"n": "id"}, tie=["id"], hot_rows=hot_rows)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("hot_rows", [40, 10**9])
def test_row_numbers_and_running_sum(events, hot_rows):
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = events.select("k", "ts", "id", "v", F.row_number().over(w).cast("bigint").alias("rn"))
    assert rows(shards.row_numbers(events, ["k"], "ts", ["id"], hot_rows=hot_rows).withColumn("rn", F.col("rn").cast("bigint"))) == rows(want)
    want = events.select("k", "ts", "id", "v", F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t"))
    assert rows(shards.running_sum(events, ["k"], "ts", ["ts", "id"], "id", "t", hot_rows)) == rows(want)


@pytest.mark.parametrize("hot_rows", [40, 10**9])
@pytest.mark.parametrize("distinct", [None, "v"])
def test_count_ahead_equals_brute_force(events, hot_rows, distinct):
    data = [tuple(r) for r in events.select("k", F.unix_micros("ts"), "id", "v").collect()]
    want = {}
    for k, t, i, _ in data:
        near = [(x[3] if distinct else x[2]) for x in data if x[0] == k and t <= x[1] <= t + 60 * US]
        want[i] = len(set(near))
    got = shards.count_ahead(events, ["k"], "ts", 60 * US, "n", distinct=distinct, tie=["id"], hot_rows=hot_rows)
    assert {r["id"]: r["n"] for r in got.collect()} == want


@pytest.mark.parametrize("hot_rows", [40, 10**9])
def test_count_ahead_over_all_rows(events, hot_rows):
    data = [tuple(r) for r in events.select(F.unix_micros("ts"), "id", "v").collect()]
    want = {i: len({x[2] for x in data if t <= x[0] <= t + 30 * US}) for t, i, _ in data}
    got = shards.count_ahead(events, [], "ts", 30 * US, "n", distinct="v", tie=["id"], hot_rows=hot_rows)
    assert {r["id"]: r["n"] for r in got.collect()} == want


def test_a_burst_has_as_many_shards_as_its_rows_ask_for(spark):
    """A key with a burst of a second and a tail of years: no shard has twice ``hot_rows`` rows."""
    tail = spark.range(1_000).select(F.lit("hot").alias("k"), (F.col("id") * 100_000 * US).alias("at"))
    burst = spark.range(60_000).select(F.lit("hot").alias("k"), (50_000_000 * US + F.pmod(F.xxhash64("id"), F.lit(US))).alias("at"))
    instant = spark.range(9_000).select(F.lit("hot").alias("k"), F.lit(70_000_000 * US).alias("at"))
    cold = spark.range(900).select(F.lit("cold").alias("k"), F.col("id").alias("at"))
    df = tail.union(burst).union(instant).union(cold).withColumn("ts", F.timestamp_micros("at"))
    shards_of = shards.hot_cuts(df, ["k"], [F.col("at")], 1_000).shard(df, F.col("at"))
    assert shards_of.filter("k = 'cold' and _shard is not null").count() == 0
    sizes = shards_of.filter("k = 'hot'").groupBy("_shard").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.max_by("at", "at").alias("x"), (F.max("at") == 70_000_000 * US).alias("heavy")).orderBy("_shard").collect()
    assert len(sizes) > 50 and all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))
    assert all(r["n"] < 2_000 for r in sizes if not r["lo"] <= 70_000_000 * US <= r["hi"])
    assert sum(r["n"] for r in sizes) == 70_000


@pytest.mark.parametrize("distinct", [None, "v"])
def test_count_ahead_in_a_burst_narrower_than_the_span(spark, distinct):
    rng = random.Random(21)
    data = [("hot", rng.choice([rng.randrange(3), rng.randrange(5000)]), n, rng.choice("vwxyz")) for n in range(400)] + [("hot", None, 900, "v")]
    df = spark.createDataFrame(data, "k string, s bigint, id bigint, v string").select("k", F.timestamp_micros(F.col("s") * US).alias("ts"), "id", "v")
    want = {i: len({(y[3] if distinct else y[2]) for y in data if y[1] is not None and s <= y[1] <= s + 60}) if s is not None else 0 for _, s, i, _ in data}
    got = shards.count_ahead(df, ["k"], "ts", 60 * US, "n", distinct=distinct, tie=["id"], hot_rows=10)
    assert {r["id"]: r["n"] for r in got.collect()} == want


@pytest.mark.parametrize("lo,hi", [(0, 300), (-300, 300), (1, 599), (0, 0)])
def test_band_join(spark, lo, hi):
    rng = random.Random(lo + hi)
    left = [(rng.choice("ab"), rng.randrange(0, 3000), n) for n in range(120)]
    right = [(rng.choice("ab"), rng.randrange(0, 3000), n) for n in range(120)] + [("a", left[0][1] + hi, 900), ("a", left[0][1] + hi + 1, 901)]
    l = spark.createDataFrame(left, "k string, s bigint, l bigint").select("k", F.timestamp_micros(F.col("s") * US).alias("lt"), "l")
    r = spark.createDataFrame(right, "k string, s bigint, r bigint").select("k", F.timestamp_micros(F.col("s") * US).alias("rt"), "r")
    want = {(x[2], y[2]) for x in left for y in right if x[0] == y[0] and lo <= y[1] - x[1] <= hi}
    got = [(x["l"], x["r"]) for x in joins.band_join(l, r, ["k"], "lt", "rt", lo * US, hi * US).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    alone = {x["l"] for x in joins.band_join(l, r, ["k"], "lt", "rt", lo * US, hi * US, "left_anti").collect()}
    assert alone == {x[2] for x in left} - {a for a, _ in want}


def test_point_in_interval_crosses_buckets(spark):
    rng = random.Random(3)
    spans = [("a", s := rng.randrange(0, 9000), s + rng.choice([0, 5, 700, 20000]), n) for n in range(60)]
    points = [("a", rng.randrange(0, 20000), n) for n in range(200)]
    i = spark.createDataFrame(spans, "k string, s bigint, e bigint, i bigint").select(
        "k", F.timestamp_micros(F.col("s") * US).alias("st"), F.timestamp_micros(F.col("e") * US).alias("en"), "i")
    p = spark.createDataFrame(points, "k string, s bigint, p bigint").select("k", F.timestamp_micros(F.col("s") * US).alias("at"), "p")
    got = [(x["p"], x["i"]) for x in joins.point_in_interval(p, i, ["k"], "at", "st", "en", 600 * US).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(y[2], x[3]) for x in spans for y in points if x[1] <= y[1] <= x[2]}


def test_an_endless_interval_has_few_cells(spark):
    """Intervals of all lengths, up to one that ends in the year 9999, against every pair."""
    rng = random.Random(5)
    lengths = [0, 1, 10, 60, 3600, 10**5, 10**6, 10**7, 10**8, 10**9]
    spans = [("a", s := rng.randrange(10**9), s + rng.choice(lengths), n) for n in range(60)] + [("a", 0, 253_402_300_799, 60), ("b", -62_135_596_800, 253_402_300_799, 61)]
    points = [(rng.choice("ab"), rng.randrange(-100, 2 * 10**9), n) for n in range(200)]
    i = spark.createDataFrame(spans, "k string, s bigint, e bigint, i bigint").select("k", F.timestamp_seconds("s").alias("st"), F.timestamp_seconds("e").alias("en"), "i")
    p = spark.createDataFrame(points, "k string, s bigint, p bigint").select("k", F.timestamp_seconds("s").alias("at"), "p")
    most = joins.interval_cells(i, "st", "en", 3600 * US).groupBy("i").count().agg(F.max("count")).first()[0]
    assert most <= joins.FAN + 1
    got = [(x["p"], x["i"]) for x in joins.point_in_interval(p, i, ["k"], "at", "st", "en").select("p", "i").collect()]
    assert len(got) == len(set(got)) and set(got) == {(y[2], x[3]) for x in spans for y in points if x[0] == y[0] and x[1] <= y[1] <= x[2]}
    assert joins.point_in_interval(p, i.limit(0), ["k"], "at", "st", "en").count() == 0


@pytest.mark.parametrize("hot_rows", [40, 10**9])
def test_asof_next(spark, events, hot_rows):
    probes = spark.createDataFrame([("hot", n * 97, n) for n in range(45)] + [("a", 10, 90), ("none", 5, 91)], "k string, s bigint, p bigint").select(
        "k", F.timestamp_micros(F.col("s") * US).alias("pt"), "p")
    data = [tuple(r) for r in events.select("k", F.unix_micros("ts"), "id").collect()]
    want = {}
    for r in probes.select("k", F.unix_micros("pt").alias("t"), "p").collect():
        later = sorted((x[1], x[2]) for x in data if x[0] == r["k"] and x[1] > r["t"])
        want[r["p"]] = later[0][1] if later else None
    got = joins.asof_next(probes, events, ["k"], "pt", "ts", {"nid": "id"}, tie=["id"], hot_rows=hot_rows)
    assert {r["p"]: r["nid"] for r in got.collect()} == want


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_block_pairs(spark, block_rows):
    members = [("big", f"m{n}") for n in range(25)] + [("small", "x"), ("small", "y"), ("one", "z")]
    df = spark.createDataFrame(members, "g string, m string")
    got = [tuple(r) for r in joins.block_pairs(df, ["g"], "m", block_rows).collect()]
    want = {(g, a, b) for g, a in members for h, b in members if g == h and a < b}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("block_rows", [3, 1000])
@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_counted_pairs_against_all_pairs(spark, least, block_rows):
    rng = random.Random(least)
    links = {(g, f"m{m}") for g in range(30) for m in rng.sample(range(25), rng.randrange(1, 9))} | {(99, f"m{m}") for m in range(25)} | {(98, f"m{m}") for m in range(20)}
    df = spark.createDataFrame(sorted(links), "g int, m string")
    groups = {}
    for g, m in links:
        groups.setdefault(m, set()).add(g)
    want = {(a, b, len(groups[a] & groups[b])) for a in groups for b in groups if a < b and len(groups[a] & groups[b]) >= least}
    got = [tuple(r) for r in joins.counted_pairs(df, ["g"], "m", least, block_rows=block_rows).collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("batch", [1, 40, 1 << 22])
@pytest.mark.parametrize("blocks", [1, 4])
@pytest.mark.parametrize("least", [1, 3])
def test_packed_pairs_against_all_pairs(spark, least, blocks, batch):
    rng = random.Random(least)
    links = {(f"g{g}", f"m{m}") for g in range(30) for m in rng.sample(range(25), rng.randrange(1, 9))} | {("all", f"m{m}") for m in range(25)}
    df = spark.createDataFrame([*sorted(links), (None, "m1"), (None, "m2"), ("g1", None)], "g string, m string")
    groups = {}
    for g, m in links:
        groups.setdefault(m, set()).add(g)
    want = {(a, b, tuple(sorted(groups[a] & groups[b]))) for a in groups for b in groups if a < b and len(groups[a] & groups[b]) >= least}
    got = joins.packed_pairs(df, ["g"], "m", blocks, least).collect()
    assert sorted(tuple(r) for r in got) == sorted((a, b, len(c)) for a, b, c in want)
    got = joins.packed_pairs(df, ["g"], "m", blocks, least, samples=2).collect()
    assert sorted((r["a"], r["b"], r["common"], tuple(r["samples"])) for r in got) == sorted((a, b, len(c), c[:2]) for a, b, c in want)
    # the same on the rows of a cell, in batches of other sizes
    import pyarrow as pa

    who = sorted(groups)
    cell = pa.record_batch({"_i": [0] * len(who), "_j": [0] * len(who), "_high": [False] * len(who), "_m": who, "_gs": [sorted(groups[m]) for m in who]})
    found = [tuple(r.values()) for b in joins.pair_counter(least, 2, ["a", "b", "n", "s"], batch)([cell]) for r in b.to_pylist()]
    assert sorted((a, b, n, tuple(s)) for a, b, n, s in found) == sorted((a, b, len(c), c[:2]) for a, b, c in want)


def test_crowded_groups_make_no_row_per_pair_and_group(spark):
    """1,200 members in each of 12 groups: 8.6 million meetings of 719,400 pairs."""
    df = spark.range(12 * 1200).selectExpr("id % 12 as g", "concat('m', id div 12) as m")
    out = joins.counted_pairs(df, ["g"], "m", 3)
    assert "MapInArrow" in _plan(out) and "Join" not in _plan(out)
    assert [tuple(r) for r in out.groupBy("common").count().collect()] == [(12, 1200 * 1199 // 2)]


def test_a_placeholder_makes_no_pairs(spark):
    """A device that 200,000 numbers show, some of which share two real ones besides."""
    from tallymast.operators import identity

    shown = spark.range(200_000).select(F.lit("000000000000000").alias("imei"), F.concat(F.lit("n"), "id").alias("mobile_number"))
    real = spark.createDataFrame([(d, f"n{n}") for d, ns in (("A", (1, 2, 3)), ("B", (1, 2)), ("C", (5, 6))) for n in ns], "imei string, mobile_number string")
    df = shown.union(real)
    assert sorted(tuple(r) for r in identity.device_pairs(df, 2).collect()) == [("n1", "n2", 3), ("n1", "n3", 2), ("n2", "n3", 2), ("n5", "n6", 2)]
    assert sorted(tuple(r) for r in identity.device_pairs(df, 3).collect()) == [("n1", "n2", 3)]


def test_pairwise_common_with_a_bound(spark):
    from tallymast.operators import network

    rng = random.Random(2)
    links = sorted({(f"s{rng.randrange(12)}", f"c{rng.randrange(20)}") for _ in range(120)})
    edges = spark.createDataFrame([(s, c, 1) for s, c in links], "subject string, contact string, calls int")
    own = {}
    for s, c in links:
        own.setdefault(s, set()).add(c)
    for least in (1, 3):
        want = {(a, b, len(own[a] & own[b]), tuple(sorted(own[a] & own[b])[:3])) for a in own for b in own if a < b and len(own[a] & own[b]) >= least}
        assert {(r["a"], r["b"], r["common"], tuple(r["samples"])) for r in network.pairwise_common(edges, least=least).collect()} == want


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_no_cartesian_product_and_pruned_scan(views):
    from tallymast.operators import correlate, graph, ipdr, network

    for df in (graph.colocation_edges(views.tower_dump), network.pairwise_common(network.contact_edges(views.cdr)),
               correlate.call_to_data(views.cdr, ipdr.with_session_features(views.ipdr)), network.synchronized(views.cdr)):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark, tmp_path, views):
    from tallymast.normalize import filter_window
    from tallymast.operators.tower_time import window_towers

    path = str(tmp_path / "t")
    views.tower_dump.write.parquet(path)
    t = spark.read.parquet(path)
    plan = _plan(window_towers(t, "2024-01-10", "2024-01-11"))
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThanOrEqual(timestamp" in plan
    assert "ReadSchema: struct<timestamp:timestamp,tower_id:string>" in plan
    assert filter_window(t, "2024-01-10", "2024-01-11").count() == t.filter("timestamp BETWEEN '2024-01-10' AND '2024-01-11'").count()


def test_results_do_not_depend_on_input_order(views):
    from tallymast.operators import cdr, movement

    for make in (lambda d: cdr.device_changes(d), lambda d: cdr.call_bursts(d)):
        assert rows(make(views.cdr_dense.repartition(1))) == rows(make(views.cdr_dense.orderBy(F.rand(5)).repartition(9)))
    t = views.tower_dump_dense
    assert rows(movement.trajectories(t, lon="lon").select("mobile_number", "moves", "stops")) == rows(
        movement.trajectories(t.orderBy(F.rand(6)).repartition(5), lon="lon").select("mobile_number", "moves", "stops"))


@pytest.mark.parametrize(("groups", "share"), [(400, 0.08), (30, 0.5)])
def test_crowded_cells_are_counted_member_by_member_or_by_products(groups, share):
    """Cells of two blocks of 700 and 800 members, in groups that hold few or many of them."""
    import numpy as np
    import pyarrow as pa

    has = np.random.default_rng(3).random((1500, groups)) < share
    common, order = has.astype(int) @ has.T.astype(int), random.Random(1).sample(range(1500), 1500)
    low, high = order[:700], order[700:]
    layout = pa.schema([("_i", pa.int32()), ("_j", pa.int32()), ("_high", pa.bool_()), ("_m", pa.string()), ("_gs", pa.list_(pa.int64()))])
    cells = [(0, 0, low, []), (0, 1, low, high), (1, 1, high, [])]
    rows = [{"_i": i, "_j": j, "_high": m in set(far), "_m": f"m{m:04}", "_gs": np.flatnonzero(has[m]).tolist()} for i, j, near, far in cells for m in near + far]
    batches = pa.Table.from_pylist(rows, schema=layout).to_batches(max_chunksize=400)
    for least, plain in ((1, True), (3, False)):
        got = {}
        for b in joins.pair_counter(least, 0, ["a", "b", "n"], plain=plain)(batches):
            for x, y, n in zip(*(c.to_pylist() for c in b.columns)):
                assert x < y and (x, y) not in got
                got[x, y] = n
        assert got == {(f"m{i:04}", f"m{j:04}"): common[i, j] for i in range(1500) for j in range(i + 1, 1500) if common[i, j] >= least}


def test_pairs_are_read_in_the_tasks_that_count_them(spark, monkeypatch):
    """No row per pair leaves the task that counts it; what is derived from the pairs is read as it is."""
    from tallymast.operators import graph

    df = spark.createDataFrame([(g, f"m{m:02}") for g in range(4) for m in range(40) if (m + g) % 5], "g int, m string")
    pairs = joins.packed_pairs(df, ["g"], "m", 2, 3)
    listed = [tuple(r)[:2] for r in pairs.collect()]
    ends = {m: sum(m in p for p in listed) for m in {x for p in listed for x in p}}
    for e in (pairs, pairs.select("*")):
        assert joins.row_count(e).first()["rows"] == len(listed)
        assert {r["node"]: r["degree"] for r in graph.degrees(e).collect()} == ends
        assert {r["node"]: r["degree"] for r in graph.degree_centrality(e).collect()} == ends
        assert {r["component"] for r in graph.components(e).collect()} == {min(ends)}
        assert {r["node"] for r in graph.eigenvector(e, iters=8).collect()} == set(ends)
        assert tuple(graph.network_summary(e).first())[:2] == (len(ends), len(listed))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert (plan(graph.degrees(pairs)), plan(graph.degrees(pairs.select("*")))) == (1, 2)
    assert joins.row_count(joins.packed_pairs(df, ["g"], "m", 2, 3, samples=2)).first()["rows"] == len(listed)
    assert joins.row_count(joins.packed_pairs(df.limit(0), ["g"], "m", 1)).first()["rows"] == 0
    assert graph.eigenvector(joins.packed_pairs(df.limit(0), ["g"], "m", 1)).collect() == []


def test_blocks_for_the_sake_of_pairs_are_few(spark, monkeypatch):
    """Every block is a copy of all rows: however many pairs there are, no more than ``MOST_BLOCKS`` are cut for them."""
    monkeypatch.setattr(joins, "CELL_PAIRS", 1)
    monkeypatch.setattr(joins, "CROWDED", 0)
    df = spark.createDataFrame([("g", f"m{m}") for m in range(200)], "g string, m string")
    assert joins.crowded_blocks(df, ["g"]) == joins.MOST_BLOCKS
