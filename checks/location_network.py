"""Call records: cells, coordinates and the network across subjects."""

from pyspark.sql import functions as F

from tallymast.operators import location, network

from . import check
from .cdr import km


@check("L1_cell_profile", """
WITH c AS (SELECT subject, first_cell, count(*) AS n FROM calls WHERE first_cell IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY first_cell) AS a,
  row_number() OVER (PARTITION BY subject ORDER BY n DESC, first_cell) AS u FROM c),
l AS (SELECT subject, count(*) AS tower_count, string_agg(first_cell, '|' ORDER BY a) FILTER (a <= 20) AS towers,
  string_agg(first_cell, '|' ORDER BY u) FILTER (u <= 10) AS top_towers FROM r GROUP BY 1)
SELECT subject, tower_count, towers, top_towers, hop AS tower_hopping, loc AS has_location
FROM (SELECT subject, bool_or(first_cell <> last_cell) AS hop, bool_or(lat IS NOT NULL) AS loc FROM calls GROUP BY 1) JOIN l USING (subject)""")
def _(v):
    return location.cell_profile(v.cdr)


@check("L2_rapid_cell_changes", """
WITH s AS (SELECT subject, us, event_id, first_cell, lag(coalesce(last_cell, first_cell)) OVER w AS f, lag(us) OVER w AS pu
  FROM calls_dense WINDOW w AS (PARTITION BY subject ORDER BY us, event_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY us, event_id) AS n FROM s WHERE us - pu <= 300000000 AND f <> first_cell)
SELECT subject, pu AS from_time, us AS to_time, f AS from_cell, first_cell AS to_cell, round((us - pu) / 60e6, 4) AS minutes FROM r WHERE n <= 10""")
def _(v):
    return location.rapid_cell_changes(v.cdr_dense)


_STEPS = f"""st AS (SELECT *, {km('lat', 'lon', 'tlat', 'tlon')} AS km, (tus - us) / 1e6 AS sec FROM (
  SELECT subject, us, event_id, lat, lon, lead(lat) OVER w AS tlat, lead(lon) OVER w AS tlon, lead(us) OVER w AS tus
  FROM calls_dense WINDOW w AS (PARTITION BY subject ORDER BY us, event_id)))"""


@check("L3_impossible_travel", f"""
WITH {_STEPS}, r AS (SELECT *, km * 3600 / sec AS kmh, row_number() OVER (PARTITION BY subject ORDER BY us, event_id) AS n
  FROM st WHERE sec > 0 AND km > 0.1 AND km * 3600 / sec > 200)
SELECT subject, us AS from_time, tus AS to_time, round(lat, 4) AS lat, round(lon, 4) AS lon, round(tlat, 4) AS to_lat, round(tlon, 4) AS to_lon,
  round(km, 4) AS km, round(sec / 3600, 4) AS hours, round(kmh, 4) AS kmh FROM r WHERE n <= 5""")
def _(v):
    return location.impossible_travel(v.cdr_dense)


_CLUST = """h AS (SELECT subject, round(lat, 3) AS lat, round(lon, 3) AS lon, hour(datetime) AS hour, count(*) AS n FROM calls GROUP BY ALL),
hp AS (SELECT *, row_number() OVER (PARTITION BY subject, lat, lon ORDER BY n DESC, hour) AS k,
  sum(n) OVER (PARTITION BY subject, lat, lon) AS calls, sum(n) OVER (PARTITION BY subject) AS total FROM h),
cl AS (SELECT subject, lat, lon, CAST(calls AS BIGINT) AS calls, round(calls * 100.0 / total, 4) AS share_pct,
  CASE WHEN calls * 100.0 / total > 20 THEN 'HOTSPOT' ELSE 'FREQUENT_LOCATION' END AS kind, CASE WHEN n > calls * 0.5 THEN hour END AS dominant_hour,
  row_number() OVER (PARTITION BY subject ORDER BY calls DESC, lat, lon) AS rank FROM hp WHERE k = 1 AND calls >= 5)"""


@check("L4_location_clusters", f"WITH {_CLUST} SELECT * FROM cl WHERE rank <= 10")
def _(v):
    return location.location_clusters(v.cdr)


def _areas(v):
    return v.spark.createDataFrame([("A", 17.1, 82.05), ("B", 17.4, 82.1), ("C", 32.5, 74.5)], "area string, area_lat double, area_lon double")


_NEAR = f"""ar(area, alat, alon) AS (VALUES ('A', 17.1, 82.05), ('B', 17.4, 82.1), ('C', 32.5, 74.5)),
nr AS (SELECT subject, area, us, lat, lon, {km('lat', 'lon', 'alat', 'alon')} AS km FROM calls, ar),
nb AS (SELECT subject, area, count(*) AS records, min(km) AS km, arg_min(us, (round(km, 9), us)) AS at FROM nr WHERE km <= 12 GROUP BY 1, 2)"""


@check("L5_near_areas", f"""
WITH {_NEAR} SELECT subject, area, records, round(km, 4) AS km, CASE WHEN km < 4 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM nb""")
def _(v):
    return location.near_areas(v.cdr, _areas(v), km=12, high_km=4).drop("at")


@check("L6_movement_stats", f"""
WITH {_STEPS}, a AS (SELECT subject, round(avg(km), 4) AS mean_km, round(max(km), 4) AS max_km,
  round(count(*) FILTER (km < 0.1) * 100.0 / count(km), 4) AS stationary_pct FROM st GROUP BY 1)
SELECT subject, unique_locations, fixes, mean_km, max_km, stationary_pct FROM a JOIN
 (SELECT subject, count(DISTINCT (lat, lon)) AS unique_locations, count(*) AS fixes FROM calls_dense GROUP BY 1) USING (subject)""")
def _(v):
    return location.movement_stats(v.cdr_dense)


@check("L7_location_spread", """
SELECT subject, count(*) AS fixes, round(sqrt(var_samp(lat) + var_samp(lon)), 4) AS spread, sqrt(var_samp(lat) + var_samp(lon)) > 0.12 AS wide_area
FROM calls GROUP BY 1""")
def _(v):
    return location.location_spread(v.cdr, wide=0.12)


@check("L8_location_profile", f"""
WITH {_STEPS}, {_CLUST.replace('FROM calls', 'FROM calls_dense')},
t AS (SELECT subject, least(count(*), 5) AS impossible FROM st WHERE sec > 0 AND km > 0.1 AND km * 3600 / sec > 2000 GROUP BY 1),
c AS (SELECT subject, count(*) AS clusters FROM cl WHERE rank <= 10 GROUP BY 1),
b AS (SELECT subject, count(*) AS fixes, sqrt(var_samp(lat) + var_samp(lon)) AS spread FROM calls_dense GROUP BY 1)
SELECT subject, fixes, round(spread, 4) AS spread, spread > 0.12 AS wide_area, coalesce(impossible, 0) AS impossible, 0 AS areas,
  coalesce(clusters, 0) AS clusters, CASE WHEN coalesce(impossible, 0) > 0 THEN 'HIGH' WHEN spread > 0.12 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM b LEFT JOIN t USING (subject) LEFT JOIN c USING (subject) WHERE fixes >= 2""")
def _(v):
    return location.location_profile(v.cdr_dense, kmh=2000, wide=0.12)


@check("L8_location_full", f"""
WITH {_STEPS}, {_CLUST.replace('FROM calls', 'FROM calls_dense')},
t AS (SELECT subject, count(*) AS n FROM st WHERE sec > 0 AND km > 0.1 AND km * 3600 / sec > 2000 GROUP BY 1),
c AS (SELECT subject, count(*) AS m FROM cl GROUP BY 1),
b AS (SELECT subject, count(*) AS fixes FROM calls_dense GROUP BY 1)
SELECT subject, fixes, coalesce(n, 0) AS all_impossible, least(coalesce(n, 0), 5) AS impossible, coalesce(m, 0) AS all_clusters, least(coalesce(m, 0), 10) AS clusters
FROM b LEFT JOIN t USING (subject) LEFT JOIN c USING (subject) WHERE fixes >= 2""")
def _(v):
    profile = location.location_profile(v.cdr_dense, kmh=2000, wide=0.12, full=True)
    return profile.select("subject", "fixes", "all_impossible", "impossible", "all_clusters", "clusters")


def _ids(v):
    return v.cdr.select("subject", F.col("a_party").alias("msisdn")).distinct()


E_ = "e AS (SELECT subject, b_party AS contact, count(*) AS calls FROM calls GROUP BY ALL)"
_LINK = f"{E_}, ids AS (SELECT DISTINCT a_party AS s FROM cdr), dl AS (SELECT subject, contact AS to_subject, calls FROM e JOIN ids ON s = contact WHERE subject <> contact)"


@check("N1_contact_edges", f"WITH {E_} SELECT * FROM e")
def _(v):
    return network.contact_edges(v.cdr)


@check("N2_direct_links", f"WITH {_LINK} SELECT * FROM dl")
def _(v):
    return network.direct_links(network.contact_edges(v.cdr), _ids(v))


@check("N3_isolated_subjects", f"""
WITH {_LINK}, fr AS (SELECT * FROM dl)
SELECT s AS subject FROM ids WHERE s NOT IN (SELECT subject FROM fr UNION ALL SELECT to_subject FROM fr)""")
def _(v):
    return network.isolated_subjects(network.contact_edges(v.cdr), _ids(v))


_SHARED = "sh AS (SELECT contact, count(*) AS sharers, CAST(sum(calls) AS BIGINT) AS calls, count(*) >= 3 AS intermediary FROM e GROUP BY 1 HAVING count(*) > 1)"


@check("N4_shared_contacts", f"WITH {E_}, {_SHARED} SELECT * FROM sh")
def _(v):
    return network.shared_contacts(network.contact_edges(v.cdr))


@check("N4_sharers", f"WITH {E_}, {_SHARED} SELECT e.contact, e.subject, e.calls FROM e JOIN sh USING (contact)")
def _(v):
    edges = network.contact_edges(v.cdr)
    return network.sharers(edges, network.shared_contacts(edges))


@check("N5_pairwise_common", f"""
WITH {E_}, p AS (SELECT x.subject AS a, y.subject AS b, contact, row_number() OVER (PARTITION BY x.subject, y.subject ORDER BY contact) AS n
  FROM e x JOIN e y USING (contact) WHERE x.subject < y.subject)
SELECT a, b, count(*) AS common, string_agg(contact, '|' ORDER BY contact) FILTER (n <= 3) AS samples FROM p GROUP BY 1, 2""")
def _(v):
    return network.pairwise_common(network.contact_edges(v.cdr))


@check("N6_central_subjects", f"""
WITH {E_} SELECT subject, count(*) AS contacts, CAST(sum(calls) AS BIGINT) AS calls, round(sum(calls) / count(*), 4) AS calls_per_contact
FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(v):
    return network.central_subjects(network.contact_edges(v.cdr))


@check("N7_fan_out", f"""
WITH {E_}, f AS (SELECT subject, count(*) AS contacts, count(*) FILTER (calls = 1) AS single FROM e GROUP BY 1)
SELECT *, round(single * 100.0 / contacts, 4) AS single_pct FROM f WHERE contacts > 30 AND single * 100.0 / contacts > 40""")
def _(v):
    return network.fan_out(network.contact_edges(v.cdr), more_than=30, share=40)


_SYNC = """sync AS (SELECT us, event_id, subject AS anchor, len(list_distinct(list(subject) OVER (ORDER BY us
  RANGE BETWEEN CURRENT ROW AND 300000000 FOLLOWING))) AS subjects FROM calls_dense)"""


@check("N8_synchronized", f"""
WITH {_SYNC} SELECT us AS start, event_id, anchor, subjects, CASE WHEN subjects >= 3 THEN 'COORDINATED' ELSE 'SYNCHRONIZED' END AS kind
FROM sync WHERE subjects >= 2""")
def _(v):
    return network.synchronized(v.cdr_dense)


@check("N8_synchronized_greedy")
def _(v):
    return network.synchronized_greedy(v.cdr)


@check("N9_coordination_windows", f"""
WITH {_SYNC.replace('calls_dense', 'calls')}, n AS (SELECT us, lead(us) OVER (ORDER BY us, event_id) AS nx FROM sync WHERE subjects >= 3)
SELECT us AS start, nx AS "end" FROM n WHERE nx - us <= 3600000000""")
def _(v):
    return network.coordination_windows(network.synchronized(v.cdr).filter("subjects >= 3")).drop("gap_seconds")
