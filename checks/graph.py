"""Co-location and call graphs."""

from tallymast.operators import graph

from . import check

CELLS = "cell AS (SELECT DISTINCT tower_id, us - us % 300000000 AS bin, mobile_number AS n FROM tower_dump_dense)"
CO = f"{CELLS}, co AS (SELECT x.n AS a, y.n AS b, count(*) AS weight FROM cell x JOIN cell y USING (tower_id, bin) WHERE x.n < y.n GROUP BY 1, 2 HAVING count(*) >= 3)"
BI = "bi AS (SELECT a AS u, b AS v FROM co UNION ALL SELECT b, a FROM co), dg AS (SELECT u AS node, count(*) AS degree FROM bi GROUP BY 1)"
CALL = "ce AS (SELECT a_party AS src, b_party AS dst, count(*) AS weight FROM cdr GROUP BY 1, 2)"
IO = "io AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM ce UNION ALL SELECT dst, 1, 0 FROM ce) GROUP BY 1)"
# components: the smallest node that can be reached; UNION removes repeats, so the recursion ends
COMP = "reach(node, x) AS (SELECT u, u FROM bi UNION SELECT r.node, bi.v FROM reach r JOIN bi ON bi.u = r.x), comp AS (SELECT node, min(x) AS component FROM reach GROUP BY 1)"


def co(v):
    return graph.colocation_edges(v.tower_dump_dense)


@check("Q1_colocation_edges", f"WITH {CO} SELECT * FROM co")
def _(v):
    return co(v)


@check("Q2_call_edges", f"WITH {CALL} SELECT * FROM ce")
def _(v):
    return graph.call_edges(v.cdr)


@check("Q3_degree_centrality", f"""WITH {CO}, {BI}, nb AS (SELECT u AS node, string_agg(v, '|' ORDER BY v) AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY v) AS k FROM bi) WHERE k <= 5 GROUP BY 1)
SELECT node, degree, round(degree * 1.0 / ((SELECT count(*) FROM dg) - 1), 4) AS centrality, degree >= 10 AS hub, neighbours FROM dg JOIN nb USING (node)""")
def _(v):
    return graph.degree_centrality(co(v))


LEVELS = 7


def bfs(levels=LEVELS):
    """Shortest-path counts level by level as a chain of common table expressions."""
    parts = ["l0 AS MATERIALIZED (SELECT DISTINCT u AS s, u AS n, CAST(1 AS DOUBLE) AS sg FROM bi)"]
    for i in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT s, n FROM l{j}" for j in range(i))
        parts.append(f"l{i} AS MATERIALIZED (SELECT s, v AS n, sum(sg) AS sg FROM l{i - 1} JOIN bi ON u = n WHERE (s, v) NOT IN (SELECT (s, n) FROM ({seen})) GROUP BY 1, 2)")
    parts.append("sp AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT s, n, {i} AS d, sg FROM l{i}" for i in range(levels + 1)) + ")")
    return ", ".join(parts)


@check("Q4_betweenness", f"""WITH {CO}, {BI}, {bfs()}, dep AS (SELECT a.n AS node, sum(a.sg * b.sg / c.sg) AS x FROM sp a JOIN sp b ON a.n = b.s JOIN sp c ON c.s = a.s AND c.n = b.n AND c.d = a.d + b.d
 WHERE a.s <> a.n AND b.n <> a.n AND a.s <> b.n GROUP BY 1), nn AS (SELECT count(*) AS n FROM dg)
SELECT node, round(coalesce(x, 0) / ((n - 1) * (n - 2)), 4) AS betweenness FROM dg LEFT JOIN dep USING (node), nn""")
def _(v):
    return graph.betweenness(co(v))


@check("Q5_in_out_degree", f"WITH {CALL}, {IO} SELECT * FROM io")
def _(v):
    return graph.in_out_degree(graph.call_edges(v.cdr))


@check("Q5_top_degrees", f"""WITH {CALL}, {IO} SELECT * FROM (SELECT 'RECEIVER' AS kind, node, in_degree AS partners FROM io ORDER BY 3 DESC, 2 LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'CALLER', node, out_degree FROM io ORDER BY 3 DESC, 2 LIMIT 3)""")
def _(v):
    return graph.top_degrees(graph.call_edges(v.cdr))


@check("Q6_hub_traits", f"""WITH {CO}, {BI}, p AS (SELECT mobile_number, dump_id, count(DISTINCT tower_id) AS t, bool_or(hour(timestamp) <= 5) AS o FROM dumps WHERE mobile_number IN (SELECT node FROM dg WHERE degree >= 10) GROUP BY 1, 2)
SELECT mobile_number, max(t) > 15 AS mobile, bool_or(o) AS odd_hour FROM p GROUP BY 1""")
def _(v):
    return graph.hub_traits(v.dumps, graph.degree_centrality(co(v)).filter("hub"), towers=15)


@check("Q7_components", f"WITH RECURSIVE {CO}, {BI}, {COMP} SELECT node, component FROM comp")
def _(v):
    return graph.components(co(v))


STATS = """cs AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) >= 3), ed AS (SELECT component, count(*) AS edges FROM co JOIN comp ON a = node GROUP BY 1)"""


@check("Q7_cluster_stats", f"""WITH RECURSIVE {CO}, {BI}, {COMP}, {STATS} SELECT component, size, edges, round(2.0 * edges / (size * (size - 1)), 4) AS density, round(2.0 * edges / size, 4) AS mean_degree FROM cs JOIN ed USING (component)""")
def _(v):
    e = co(v)
    return graph.cluster_stats(e, graph.components(e))


@check("Q8_cluster_traits", f"""WITH RECURSIVE {CO}, {BI}, {COMP}, {STATS}, r AS (SELECT component, hour(timestamp) AS h, tower_id FROM tower_dump_dense JOIN comp ON mobile_number = node JOIN cs USING (component)),
h AS (SELECT component, h, count(*) AS n, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, h) AS k, sum(count(*)) OVER (PARTITION BY component) AS t FROM r GROUP BY 1, 2),
w AS (SELECT component, tower_id, count(*) AS n, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, tower_id) AS k FROM r GROUP BY 1, 2)
SELECT component, CAST(t AS BIGINT) AS records, CASE WHEN h.n * 100.0 / t > 4.5 THEN h.h END AS dominant_hour, CASE WHEN w.n * 100.0 / t > 5 THEN tower_id END AS dominant_tower FROM h JOIN w USING (component) WHERE h.k = 1 AND w.k = 1""")
def _(v):
    return graph.cluster_traits(v.tower_dump_dense, graph.components(co(v)), hour_share=4.5, tower_share=5)


@check("Q9_maximal_cliques", f"""WITH RECURSIVE {CO}, {BI}, ad AS (SELECT u, list(v) AS nb FROM bi GROUP BY 1),
cl(m, last) AS (SELECT [u], u FROM ad UNION ALL SELECT list_append(m, ad.u), ad.u FROM cl JOIN bi ON bi.u = cl.last AND bi.v > cl.last JOIN ad ON ad.u = bi.v WHERE list_has_all(ad.nb, cl.m))
SELECT array_to_string(m, '|') AS members, len(m) AS size FROM cl WHERE len(m) >= 3 AND NOT EXISTS (SELECT 1 FROM ad WHERE list_has_all(ad.nb, cl.m))""")
def _(v):
    return graph.maximal_cliques(co(v))


EVO = """cd AS (SELECT DISTINCT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, tower_id, us - us % 300000000 AS bin, mobile_number AS n FROM tower_dump),
pr AS (SELECT DISTINCT x.day, x.n AS a, y.n AS b FROM cd x JOIN cd y USING (day, tower_id, bin) WHERE x.n < y.n),
bi AS (SELECT day || '|' || a AS u, day || '|' || b AS v FROM pr UNION ALL SELECT day || '|' || b, day || '|' || a FROM pr)"""


@check("Q10_network_evolution", f"""WITH RECURSIVE {EVO}, {COMP}, nd AS (SELECT day, count(DISTINCT n) AS nodes FROM cd GROUP BY 1), eg AS (SELECT day, count(*) AS edges FROM pr GROUP BY 1),
lk AS (SELECT split_part(node, '|', 1) AS day, count(*) AS l, count(DISTINCT component) AS g FROM comp GROUP BY 1),
j AS (SELECT day, nodes, coalesce(edges, 0) AS edges, coalesce(g, 0) + nodes - coalesce(l, 0) AS components FROM nd LEFT JOIN eg USING (day) LEFT JOIN lk USING (day))
SELECT day, nodes, edges, round(CASE WHEN nodes > 1 THEN 2.0 * edges / (nodes * (nodes - 1)) ELSE 0 END, 4) AS density, components, round((nodes - first(nodes) OVER w) * 100.0 / first(nodes) OVER w, 4) AS node_growth_pct,
 round(CASE WHEN first(edges) OVER w > 0 THEN (edges - first(edges) OVER w) * 100.0 / first(edges) OVER w ELSE 0 END, 4) AS edge_growth_pct, coalesce(abs(nodes - lag(nodes) OVER w) * 1.0 / lag(nodes) OVER w > 0.05, false) AS sudden_change
FROM j WINDOW w AS (ORDER BY day)""")
def _(v):
    return graph.network_evolution(v.tower_dump, change=0.05)


@check("Q11_isolated_devices", f"""WITH {CO}, {BI} SELECT mobile_number, count(*) AS records, count(DISTINCT tower_id) AS towers, CASE WHEN count(DISTINCT tower_id) = 1 THEN 'STATIONARY' WHEN count(*) < 5 THEN 'MINIMAL' ELSE 'MOBILE_ISOLATED' END AS activity
FROM tower_dump_dense WHERE mobile_number NOT IN (SELECT node FROM dg) GROUP BY 1""")
def _(v):
    return graph.isolated_devices(v.tower_dump_dense, co(v))


@check("Q11_weak_devices", f"WITH {CO}, {BI} SELECT * FROM dg WHERE degree <= 2")
def _(v):
    return graph.weak_devices(co(v))


def power(rounds=48):
    parts = ["x0 AS MATERIALIZED (SELECT node, CAST(1 AS DOUBLE) AS x FROM dg)"]
    for i in range(1, rounds + 1):
        parts.append(f"y{i} AS MATERIALIZED (SELECT node, sum(x) AS x FROM (SELECT v AS node, x FROM x{i - 1} JOIN bi ON u = node UNION ALL SELECT node, x FROM x{i - 1}) GROUP BY 1), "
                     f"x{i} AS MATERIALIZED (SELECT node, x / (SELECT sqrt(sum(x * x)) FROM y{i}) AS x FROM y{i})")
    return ", ".join(parts)


@check("Q12_eigenvector", f"WITH {CO}, {BI}, {power()} SELECT node, round(x, 3) AS centrality, FALSE AS converged FROM x48")
def _(v):
    from pyspark.sql import functions as F

    return graph.eigenvector(co(v), iters=48, tol=0).withColumn("centrality", F.round("centrality", 3))


@check("Q12_peripheral", f"WITH {CO}, {BI}, {power()} SELECT node, round(x, 3) AS centrality FROM x48 WHERE x < (SELECT avg(x) FROM x48) * 0.5")
def _(v):
    from pyspark.sql import functions as F

    return graph.peripheral(graph.eigenvector(co(v), iters=48, tol=0)).withColumn("centrality", F.round("centrality", 3))


FREQ = "ce AS (SELECT a_party AS src, b_party AS dst, count(*) AS weight FROM cdr GROUP BY 1, 2)"
ROLES = """rl AS (SELECT *, CASE WHEN out_degree > ao * 1.5 AND in_degree < ai THEN 'OUTGOING' WHEN in_degree > ai * 1.5 AND out_degree > ao * 1.5 THEN 'BALANCED'
 WHEN in_degree > ai * 1.5 AND out_degree < ao THEN 'INCOMING' END AS role FROM io, (SELECT avg(in_degree) AS ai, avg(out_degree) AS ao FROM io)),
ro AS (SELECT node, in_degree, out_degree, role, CASE role WHEN 'OUTGOING' THEN out_degree * 1.0 / (in_degree + 1) WHEN 'INCOMING' THEN in_degree * 1.0 / (out_degree + 1) ELSE in_degree + out_degree END AS ratio FROM rl WHERE role IS NOT NULL)"""


def freq(v):
    return graph.call_edges(v.cdr)


@check("Q13_call_roles", f"WITH {FREQ}, {IO}, {ROLES} SELECT node, in_degree, out_degree, role, round(ratio, 4) AS ratio FROM ro")
def _(v):
    return graph.call_roles(freq(v))


def paths(levels=6):
    parts = ["p0 AS MATERIALIZED (SELECT DISTINCT source AS s, source AS n, [source] AS p FROM rp)"]
    for i in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT s, n FROM p{j}" for j in range(i))
        parts.append(f"p{i} AS MATERIALIZED (SELECT s, dst AS n, min(list_append(p, dst)) AS p FROM p{i - 1} JOIN ce ON src = n AND src <> dst WHERE (s, dst) NOT IN (SELECT (s, n) FROM ({seen})) GROUP BY 1, 2)")
    return ", ".join(parts) + ", pall AS (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(levels + 1)) + ")"


@check("Q14_shortest_paths", f"""WITH {FREQ}, {IO}, {ROLES}, tk AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY ratio DESC, node) AS k FROM ro),
rp AS (SELECT a.node AS source, b.node AS target FROM tk a, tk b WHERE a.role = 'OUTGOING' AND a.k <= 10 AND b.role = 'INCOMING' AND b.k <= 10), {paths()}
SELECT source, target, array_to_string(p, '|') AS path, len(p) - 1 AS hops FROM rp JOIN pall ON s = source AND n = target WHERE len(p) > 2""")
def _(v):
    e = freq(v)
    return graph.shortest_paths(e, graph.role_pairs(graph.call_roles(e), k=10))


@check("Q15_network_summary", f"""WITH RECURSIVE {CO}, {BI}, {COMP}, s AS (SELECT (SELECT count(*) FROM dg) AS nodes, (SELECT count(*) FROM co) AS edges, (SELECT count(DISTINCT component) FROM comp) AS components)
SELECT nodes, edges, round(2.0 * edges / (nodes * (nodes - 1)), 4) AS density, components, round(2.0 * edges / nodes, 4) AS mean_degree FROM s""")
def _(v):
    return graph.network_summary(co(v))
