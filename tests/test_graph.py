"""Graph operators against brute force on small graphs."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tallymast.operators import cdr, graph

CASES = {
    "path": [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")],
    "star": [("a", x) for x in "bcdefg"],
    "two": [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")],
    "clique_tail": [*itertools.combinations("abcd", 2), ("d", "e"), ("e", "f")],
}
rng = random.Random(11)
CASES["random"] = sorted({tuple(sorted(rng.sample("abcdefghijklmnopq", 2))) for _ in range(45)})


def near(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set()).add(a)
    return out


@pytest.fixture(params=list(CASES))
def case(request, spark):
    edges = CASES[request.param]
    return near(edges), spark.createDataFrame([(a, b, 3) for a, b in edges], "a string, b string, weight bigint").repartition(3)


def bfs(adj, s):
    dist, count, todo = {s: 0}, {s: 1}, deque([s])
    while todo:
        u = todo.popleft()
        for v in adj[u]:
            if v not in dist:
                dist[v], count[v] = dist[u] + 1, 0
                todo.append(v)
            if dist[v] == dist[u] + 1:
                count[v] += count[u]
    return dist, count


def test_components(case):
    adj, e = case
    want = {n: min(bfs(adj, n)[0]) for n in adj}
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == want


def test_long_path_components(spark):
    names = [f"n{i:03d}" for i in range(64)]
    random.Random(5).shuffle(names)
    e = spark.createDataFrame([(*sorted(p), 1) for p in zip(names, names[1:])], "a string, b string, weight bigint")
    assert {r["component"] for r in graph.components(e).collect()} == {"n000"}


def test_betweenness(case):
    adj, e = case
    info = {n: bfs(adj, n) for n in adj}
    n = len(adj)
    want = {}
    for v in adj:
        total = 0
        for s in adj:
            for t in adj:
                if len({s, t, v}) == 3 and t in info[s][0] and v in info[s][0] and t in info[v][0]:
                    if info[s][0][v] + info[v][0][t] == info[s][0][t]:
                        total += info[s][1][v] * info[v][1][t] / info[s][1][t]
        want[v] = total / ((n - 1) * (n - 2))
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    assert got == pytest.approx(want)


def test_maximal_cliques(case):
    adj, e = case
    cliques = []
    for size in range(1, len(adj) + 1):
        found = [c for c in itertools.combinations(sorted(adj), size) if all(b in adj[a] for a, b in itertools.combinations(c, 2))]
        if not found:
            break
        cliques += found
    want = {c for c in cliques if len(c) >= 3 and not any(all(m in adj[x] for m in c) for x in adj if x not in c)}
    assert {tuple(r["members"]) for r in graph.maximal_cliques(e).collect()} == want


def test_eigenvector_direction(case):
    adj, e = case
    x = {n: 1.0 for n in adj}
    for _ in range(400):
        y = {n: x[n] + sum(x[m] for m in adj[n]) for n in adj}
        size = sum(v * v for v in y.values()) ** 0.5
        x = {n: v / size for n, v in y.items()}
    got = {r["node"]: r["centrality"] for r in graph.eigenvector(e, iters=80, tol=1e-9).collect()}
    assert got == pytest.approx(x, abs=5e-3)


def test_shortest_paths(spark):
    rng = random.Random(9)
    edges = sorted({(rng.choice("abcdefgh"), rng.choice("abcdefgh")) for _ in range(20)})
    adj = {n: sorted(b for a, b in edges if a == n and b != n) for n in "abcdefgh"}

    def best(s, t):
        layer, seen = [[s]], {s}
        while layer:
            hits = [p for p in layer if p[-1] == t]
            if hits:
                return min(hits)
            layer = [p + [v] for p in layer for v in adj[p[-1]] if v not in seen]
            seen |= {p[-1] for p in layer}
        return None

    pairs = [(s, t) for s in "ab" for t in "ghf"]
    e = spark.createDataFrame([(a, b, 1) for a, b in edges], "src string, dst string, weight bigint")
    got = {(r["source"], r["target"]): r["path"] for r in graph.shortest_paths(e, spark.createDataFrame(pairs, "source string, target string")).collect()}
    want = {(s, t): best(s, t) for s, t in pairs}
    assert got == {k: v for k, v in want.items() if v and len(v) > 2}


def test_call_cycles_boundaries(spark):
    make = lambda *es: spark.createDataFrame([tuple(x) for x in es], "src string, dst string")
    triangle = cdr.call_cycles(make("ab", "bc", "ca", "ac", "cb", "ba", "aa", "xy", "yx")).collect()
    assert [(r["members"], r["path"]) for r in triangle] == [(["a", "b", "c"], ["a", "b", "c"])]
    five = cdr.call_cycles(make("ab", "bc", "cd", "de", "ea")).collect()
    assert [r["length"] for r in five] == [5]
    assert cdr.call_cycles(make("ab", "bc", "cd", "de", "ef", "fa")).count() == 0


def test_weight_threshold_and_crowded_bin(spark):
    from pyspark.sql import functions as F

    rows = [("T", 300 * b + 1, f"d{n:02d}") for b in range(3) for n in range(30)] + [("T", 9000, "d00"), ("T", 9001, "late")]
    t = spark.createDataFrame(rows, "tower_id string, s bigint, mobile_number string").withColumn("timestamp", F.timestamp_seconds("s"))
    e = graph.colocation_edges(t)
    assert e.count() == 30 * 29 // 2 and {r["weight"] for r in e.collect()} == {3}


def test_eigenvector_says_whether_it_converged(spark):
    """A long path mixes slowly; a star does not."""
    path = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(150)], "a string, b string")
    slow = graph.eigenvector(path, iters=8, tol=1e-9).collect()
    assert len(slow) == 151 and {r["converged"] for r in slow} == {False}
    star = graph.eigenvector(spark.createDataFrame([("hub", f"n{k}") for k in range(6)], "a string, b string"), iters=80, tol=1e-9).collect()
    assert {r["converged"] for r in star} == {True}
    assert {round(r["centrality"], 4) for r in star if r["node"] == "hub"} == {0.7071}


def test_sampled_betweenness_is_within_its_bound(spark):
    rng = random.Random(31)
    edges = {tuple(sorted((f"n{k:03d}", f"n{rng.randrange(max(1, k - 30), k + 1) - 1:03d}"))) for k in range(1, 160)}
    e = spark.createDataFrame(sorted(edges), "a string, b string").cache()
    nodes = graph.both_ways(e).select(F.col("u").alias("node")).distinct()
    n = nodes.count()
    k = graph.pivots(nodes, n, 0.25).count()
    assert k < n and graph.pivots(nodes, n, 0.05).count() == n
    exact = {r["node"]: r["betweenness"] for r in graph.betweenness(e, error=None).collect()}
    sampled = {r["node"]: r["betweenness"] for r in graph.betweenness(e, error=0.25).collect()}
    assert exact.keys() == sampled.keys() and exact != sampled
    assert max(abs(exact[v] - sampled[v]) for v in exact) <= 0.25


def test_edges_are_thinned_and_packed_in_tasks():
    """All pairs of 300 nodes and a path beside them."""
    import pyarrow as pa

    from tallymast.operators import graph

    pairs = [(f"n{i}", f"n{j}") for i in range(300) for j in range(i + 1, 300)] + [(f"p{i}", f"p{i + 1}") for i in range(50)]
    batches = pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}).to_batches(max_chunksize=7_000)
    stars = [tuple(r.values()) for b in graph._forest()(batches) for r in b.to_pylist()]
    assert len(stars) == 299 + 50 and len({a for a, _ in stars}) == 2

    numbers = pa.table({"a": [1, 1, 2], "b": [2, 3, 3]}).to_batches()
    assert {r["u"]: sorted(r["vs"]) for b in graph._neighbour_lists()(numbers) for r in b.to_pylist()} == {1: [2, 3], 2: [1, 3], 3: [1, 2]}


def test_cliques_without_a_row_per_wedge(spark):
    """Four pairs of nodes that are each tied to all but their own: members of cliques are not spread to rows."""
    from tallymast.operators import graph

    e = spark.createDataFrame([(f"n{i:02}", f"n{j:02}") for i in range(8) for j in range(i + 1, 8) if i // 2 != j // 2], "a string, b string")
    found = graph.maximal_cliques(e)
    assert {tuple(r["members"]) for r in found.collect()} == {tuple(f"n{2 * k + (n >> k & 1):02}" for k in range(4)) for n in range(16)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Join" not in plan.partition("FlatMapGroupsInPandas")[0]


def test_betweenness_in_tasks_equals_rows_per_source(case, monkeypatch):
    """Sources are followed in tasks, ever so many together; the rows of larger graphs give the same."""
    adj, e = case
    want = {r["node"]: r["betweenness"] for r in graph.betweenness(e, error=None).collect()}
    for name, value in (("TOGETHER", 2), ("FEW_EDGES", 0)):
        monkeypatch.setattr(graph, name, value)
        assert {r["node"]: r["betweenness"] for r in graph.betweenness(e, error=None).collect()} == pytest.approx(want)


def test_path_shares_of_a_path_and_strangers():
    """A path 0 - 1 - 2 - 3 by two groups of sources, one of them not in the graph."""
    import pyarrow as pa

    lists = [(0, [1]), (1, [0, 2]), (2, [1]), (2, [3]), (3, [2])]
    rows = pa.table({"g": [g for g in (0, 1) for _ in lists], "sources": [s for s in ([0, 3, 9], [9]) for _ in lists],
                     "u": [u for u, _ in lists] * 2, "vs": [vs for _, vs in lists] * 2})
    found = [b.to_pydict() for b in graph._path_shares(at_once=1)(rows.to_batches(max_chunksize=3))]
    assert found == [{"id": [0, 1, 2, 3], "share": [0.0, 3.0, 3.0, 0.0]}, {"id": [], "share": []}]


def test_degrees_and_few_neighbours_are_counted_in_tasks(spark):
    """All pairs of 40 nodes and a pair without a name: a row per node and task, no row per end of an edge."""
    import pyarrow as pa

    pairs = [(f"n{i:02}", f"n{j:02}") for i in range(40) for j in range(i + 1, 40)] + [("n00", None)]
    batches = pa.table({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}).to_batches(max_chunksize=100)
    rows = [r for b in graph._few_neighbours(3)(batches) for r in b.to_pylist()]
    assert len(rows) == 41 and {r["node"]: r["few"] for r in rows}["n02"] == ["n00", "n01", "n03"]
    got = {r["node"]: (r["degree"], r["centrality"], r["neighbours"]) for r in graph.degree_centrality(spark.createDataFrame(pairs, "a string, b string"), listed=3).collect()}
    assert len(got) == 40 and got["n00"] == (40, 1.0, ["n01", "n02"]) and got["n39"] == (39, 39 / 40, ["n00", "n01", "n02"])


def test_degrees_are_counted_where_edges_are_made(spark):
    e = spark.createDataFrame([(f"n{i:03}", f"n{j:03}", 1) for i in range(60) for j in range(i + 1, 60) if (i + j) % 3], "a string, b string, weight long").repartition(3)
    want = {}
    for r in e.collect():
        for n in (r["a"], r["b"]):
            want[n] = want.get(n, 0) + 1
    got = graph.degrees(e)
    assert {r["node"]: r["degree"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan  # no row per end of an edge
    assert {r["node"] for r in graph.weak_devices(e, most=39).collect()} == {n for n, d in want.items() if d <= 39}
    assert graph.degrees(e.limit(0)).collect() == []


def test_betweenness_of_large_graphs_takes_all_sources(spark):
    """A hub of 3,000 is between all of its nodes; a sample of sources, scaled, would say a little more."""
    e = spark.createDataFrame([("hub", f"n{k:04}") for k in range(3000)], "a string, b string")
    assert graph.pivots(graph.degrees(e).select("node"), 3001, 0.05).count() < 3001
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(e).filter("betweenness > 0").collect()}
    assert got == {"hub": pytest.approx(1.0, abs=1e-9)}


def test_path_shares_of_long_lists():
    """All pairs of 40 nodes but of the even ones, whose lists are summed in pieces of different lengths."""
    import pyarrow as pa

    adj = {u: [v for v in range(40) if v != u and (u + v) % 2] + ([] if u % 2 else [41]) for u in range(40)} | {41: list(range(0, 40, 2))}
    want = {v: sum(bfs(adj, s)[1][v] * bfs(adj, v)[1][t] / bfs(adj, s)[1][t] for s in (0, 1, 41) for t in adj
                   if len({s, t, v}) == 3 and bfs(adj, s)[0][v] + bfs(adj, v)[0][t] == bfs(adj, s)[0][t]) for v in adj}
    for at_once in (3, 30, 1 << 21):
        rows = pa.table({"g": [0] * len(adj), "sources": [[0, 1, 41]] * len(adj), "u": list(adj), "vs": list(adj.values())})
        found = [b.to_pydict() for b in graph._path_shares(at_once)(rows.to_batches(max_chunksize=7))]
        assert dict(zip(found[0]["id"], found[0]["share"])) == pytest.approx(want)
