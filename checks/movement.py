"""Tower dumps: movement and geofence."""

from pyspark.sql import functions as F

from tallymast.operators import geofence, movement

from . import check
from .cdr import km

STEP = f"""st0 AS (SELECT *, lag(tower_id) OVER w AS ft, lag(us) OVER w AS fu, lag(lat) OVER w AS fl, lag(lon) OVER w AS fo FROM {{v}} WINDOW w AS (PARTITION BY mobile_number ORDER BY us, event_id)),
st AS (SELECT *, coalesce(ft <> tower_id, false) AS ch, {km('fl', 'fo', 'lat', 'lon')} AS km, (us - fu) / 1e6 AS sec FROM st0),
sp AS (SELECT *, CASE WHEN sec > 0 THEN km * 3600 / sec END AS kmh FROM st)"""
D = STEP.format(v="tower_dump_dense")
S30 = STEP.format(v="tower_dump")
L = {"lon": "lon"}

TRAJ = """tj AS (SELECT mobile_number, count(*) AS records, count(DISTINCT tower_id) AS towers, count(*) FILTER (ch) AS moves, coalesce(sum(km) FILTER (ch AND sec > 0), 0) AS km,
 coalesce(avg(kmh) FILTER (ch AND sec > 0), 0) AS mean_kmh, coalesce(max(kmh) FILTER (ch AND sec > 0), 0) AS max_kmh, min(us) AS start, max(us) AS stop FROM sp GROUP BY 1 HAVING count(*) >= 3),
sq AS (SELECT mobile_number, list(tower_id ORDER BY us, event_id) AS s FROM (SELECT *, row_number() OVER (PARTITION BY mobile_number ORDER BY us, event_id) AS n FROM sp WHERE ch OR ft IS NULL) WHERE n <= 10 GROUP BY 1)"""


@check("M1_trajectories", f"""WITH {S30}, {TRAJ} SELECT mobile_number, records, towers, moves, round(km, 4) AS km, round(mean_kmh, 4) AS mean_kmh, round(max_kmh, 4) AS max_kmh, start, stop,
 round((stop - start) / 3600e6, 4) AS span_hours, array_to_string(s, '|') AS stops FROM tj JOIN sq USING (mobile_number)""")
def _(v):
    return movement.trajectories(v.tower_dump, **L)


@check("M2_trajectory_classes", f"""WITH {S30}, {TRAJ} SELECT mobile_number, round(km, 4) AS km, moves, km > 500 AS long_distance, len(s) >= 4 AND list_contains(s[4:], s[1]) AS circular
 FROM tj JOIN sq USING (mobile_number)""")
def _(v):
    return movement.trajectory_classes(movement.trajectories(v.tower_dump, **L), long_km=500)


@check("M3_impossible_travel", f"""WITH {D} SELECT mobile_number, ft AS from_tower, tower_id AS to_tower, fu AS from_time, us AS to_time, round(km, 4) AS km, round(kmh, 4) AS kmh FROM sp WHERE ch AND kmh > 500""")
def _(v):
    return movement.impossible_travel(v.tower_dump_dense, **L).drop("seconds")


@check("M3_impossible_subjects", f"WITH {D} SELECT mobile_number, count(*) AS events, round(max(kmh), 4) AS max_kmh FROM sp WHERE ch AND kmh > 500 GROUP BY 1 HAVING count(*) >= 2")
def _(v):
    return movement.impossible_subjects(v.tower_dump_dense, **L)


TM = "tm AS (SELECT *, row_number() OVER (PARTITION BY mobile_number ORDER BY us, event_id) AS n FROM sp WHERE ch AND sec > 0 AND sec < 7200 AND kmh BETWEEN 20 AND 200)"


@check("M4_vehicle_moves", f"WITH {D}, {TM} SELECT mobile_number, ft AS from_tower, tower_id AS to_tower, us AS timestamp, round(km, 4) AS km, round(kmh, 4) AS kmh, event_id FROM tm")
def _(v):
    return movement.vehicle_moves(movement.timed_moves(v.tower_dump_dense, **L)).drop("seconds")


@check("M4_vehicle_users", f"WITH {D}, {TM} SELECT mobile_number, count(*) AS moves, round(avg(kmh), 4) AS mean_kmh, round(max(kmh), 4) AS max_kmh, round(sum(km), 4) AS km FROM tm GROUP BY 1 HAVING count(*) >= 3")
def _(v):
    return movement.vehicle_users(movement.vehicle_moves(movement.timed_moves(v.tower_dump_dense, **L)))


@check("M4_fast_moves", f"WITH {D} SELECT mobile_number, ft AS from_tower, tower_id AS to_tower, us AS timestamp, round(kmh, 4) AS kmh FROM sp WHERE ch AND sec > 0 AND sec < 7200 AND kmh > 100")
def _(v):
    return movement.fast_moves(movement.timed_moves(v.tower_dump_dense, **L)).select("mobile_number", "from_tower", "to_tower", "timestamp", "kmh")


@check("M5_common_routes", f"""WITH {D}, {TM}, u AS (SELECT mobile_number FROM tm GROUP BY 1 HAVING count(*) >= 3)
SELECT ft AS from_tower, tower_id AS to_tower, count(*) AS trips FROM tm WHERE n <= 5 AND kmh > 60 AND mobile_number IN (SELECT mobile_number FROM u) GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(v):
    moves = movement.vehicle_moves(movement.timed_moves(v.tower_dump_dense, **L))
    return movement.common_routes(moves, movement.vehicle_users(moves))


CR = """cr AS (SELECT ft AS tower, 'EXIT' AS kind, tower_id AS other, mobile_number, us, event_id, timestamp FROM st WHERE ch UNION ALL SELECT tower_id, 'ENTRY', ft, mobile_number, us, event_id, timestamp FROM st WHERE ch)"""


@check("M6_tower_traffic", f"""WITH {S30}, {CR}, h AS (SELECT tower, hour(timestamp) AS hour, row_number() OVER (PARTITION BY tower ORDER BY count(*) DESC, hour(timestamp)) AS n FROM cr WHERE kind = 'ENTRY' GROUP BY 1, 2),
hh AS (SELECT tower, string_agg(hour, '|' ORDER BY n) AS peak_hours FROM h WHERE n <= 3 GROUP BY 1)
SELECT tower AS tower_id, count(*) FILTER (kind = 'ENTRY') AS entries, count(*) FILTER (kind = 'EXIT') AS exits, count(DISTINCT mobile_number) FILTER (kind = 'ENTRY') AS visitors, any_value(peak_hours) AS peak_hours
FROM cr LEFT JOIN hh USING (tower) GROUP BY 1 HAVING count(*) > 50""")
def _(v):
    return movement.tower_traffic(v.tower_dump)


QV = """qv AS (SELECT e.tower AS tower_id, e.mobile_number, e.us AS entered, x.us AS left_at, e.other AS from_tower, x.other AS to_tower FROM cr e JOIN cr x ON e.kind = 'ENTRY' AND x.kind = 'EXIT'
 AND e.tower = x.tower AND e.mobile_number = x.mobile_number AND x.us - e.us > 0 AND x.us - e.us < 600000000)"""


@check("M7_quick_visits", f"WITH {D}, {CR}, {QV} SELECT * FROM qv")
def _(v):
    return movement.quick_visits(v.tower_dump_dense).drop("minutes")


@check("M7_quick_visit_towers", f"WITH {D}, {CR}, {QV} SELECT tower_id, count(*) AS visits FROM qv GROUP BY 1 HAVING count(*) >= 3")
def _(v):
    return movement.quick_visit_towers(movement.quick_visits(v.tower_dump_dense))


CONV = """w AS (SELECT event_id AS window_id, tower_id, us, len(list_distinct(list(mobile_number) OVER (PARTITION BY tower_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 300000000 FOLLOWING))) AS c FROM tower_dump_dense),
mem AS (SELECT DISTINCT w.window_id, w.tower_id, w.us, w.c, r.mobile_number FROM w JOIN tower_dump_dense r ON r.tower_id = w.tower_id AND r.us BETWEEN w.us AND w.us + 300000000 WHERE w.c >= 3),
nx AS (SELECT m.*, n.tower_id AS to_tower, n.us AS to_us FROM (SELECT *, us + 300000001 AS t FROM mem) m ASOF JOIN tower_dump_dense n ON n.mobile_number = m.mobile_number AND m.t <= n.us),
cv AS (SELECT window_id, tower_id AS from_tower, to_tower, us AS start, string_agg(mobile_number, '|' ORDER BY mobile_number) AS members, count(*) AS members_count, round(count(*) * 1.0 / c, 4) AS score
 FROM nx WHERE to_tower <> tower_id GROUP BY 1, 2, 3, 4, c HAVING count(*) >= 2 AND max(to_us) - min(to_us) <= 600000000)"""


@check("M8_convoys", f"WITH {CONV} SELECT * FROM cv")
def _(v):
    return movement.convoys(v.tower_dump_dense)


@check("M9_merge_convoys")
def _(v):
    return movement.merge_convoys(movement.convoys(v.tower_dump_dense))


@check("M9_convoy_members")
def _(v):
    return movement.convoy_members(movement.merge_convoys(movement.convoys(v.tower_dump_dense)))


@check("M10_edge_towers", """
WITH d AS (SELECT mobile_number, us, CASE WHEN CAST(mobile_number AS BIGINT) % 9 = 0 THEN 'E' || CAST(substr(tower_id, 2) AS INT) % 3 ELSE tower_id END AS t FROM tower_dump),
vs AS (SELECT DISTINCT mobile_number, t FROM d), p AS (SELECT DISTINCT x.t AS a, y.t AS b FROM vs x JOIN vs y USING (mobile_number) WHERE x.t <> y.t),
g AS (SELECT a AS t, count(*) AS n FROM p GROUP BY 1),
u AS (SELECT t, mobile_number, count(*) AS c, max(us) - min(us) AS s FROM d GROUP BY 1, 2)
SELECT g.t AS tower_id, n AS neighbours, count(*) AS devices, count(*) FILTER (c > 1 AND s < 36000000000) AS brief_visits FROM g JOIN u USING (t) WHERE n < (SELECT avg(n) FROM g) * 0.5 GROUP BY 1, 2""")
def _(v):
    far = F.expr("concat('E', CAST(substr(tower_id, 2) AS INT) % 3)")
    d = v.tower_dump.withColumn("tower_id", F.when(F.expr("CAST(mobile_number AS BIGINT) % 9 = 0"), far).otherwise(F.col("tower_id")))
    return movement.edge_towers(d, minutes=600)


@check("M11_movement_totals", f"WITH {S30} SELECT CAST(count(*) FILTER (ch) AS BIGINT) AS moves, count(DISTINCT mobile_number) FILTER (ch) AS movers FROM st")
def _(v):
    return movement.movement_totals(v.tower_dump)


NEXT = f"""n0 AS (SELECT *, lead(tower_id) OVER w AS tt, lead(us) OVER w AS tu, lead(lat) OVER w AS tl, lead(lon) OVER w AS tlo FROM {{v}} WINDOW w AS (PARTITION BY mobile_number ORDER BY us, event_id)),
n1 AS (SELECT *, CASE WHEN tu IS NULL THEN 0 ELSE {km('lat', 'lon', 'tl', 'tlo')} END AS km, coalesce((tu - us) / 1e6, 0) AS sec FROM n0),
nn AS (SELECT *, CASE WHEN sec > 0 THEN km * 3600 / sec ELSE 0 END AS kmh FROM n1)"""


def mclass(c):
    return f"CASE WHEN {c} < 1 THEN 'stationary' WHEN {c} < 5 THEN 'walking' WHEN {c} < 25 THEN 'bicycle' WHEN {c} < 200 THEN 'vehicle' WHEN {c} > 500 THEN 'impossible' ELSE 'vehicle' END"


@check("M12_steps", f"""WITH {NEXT.format(v='tower_dump_dense')} SELECT mobile_number, us AS timestamp, event_id, tower_id, tt AS to_tower, tu AS to_time, round(km, 4) AS km, round(kmh, 4) AS kmh,
 {mclass('kmh')} AS movement, sec > 1800 AS long_dwell FROM nn""")
def _(v):
    return movement.steps(v.tower_dump_dense, **L).drop("seconds", "dwell_minutes")


MET = f"""mt AS (SELECT mobile_number, count(*) AS records, sum(km) AS km, avg(kmh) AS mean_kmh, max(kmh) AS max_kmh, count(DISTINCT tower_id) AS towers, count(*) FILTER (kmh < 1) * 100.0 / count(*) AS stationary_pct,
 count(*) FILTER (kmh > 25) * 100.0 / count(*) AS vehicle_pct FROM nn GROUP BY 1 HAVING count(*) > 1)"""


@check("M13_movement_metrics", f"""WITH {NEXT.format(v='tower_dump_dense')}, {MET} SELECT mobile_number, records, round(km, 4) AS km, round(mean_kmh, 4) AS mean_kmh, round(max_kmh, 4) AS max_kmh, towers,
 round(stationary_pct, 4) AS stationary_pct, round(vehicle_pct, 4) AS vehicle_pct, {mclass('mean_kmh')} AS movement FROM mt""")
def _(v):
    return movement.movement_metrics(v.tower_dump_dense, **L)


@check("M13_movement_distribution", f"WITH {NEXT.format(v='tower_dump')}, {MET} SELECT {mclass('mean_kmh')} AS movement, count(*) AS devices FROM mt GROUP BY 1")
def _(v):
    return movement.movement_distribution(movement.movement_metrics(v.tower_dump, **L))


def corr_sql(columns, table):
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS correlation FROM {table}" for i, a in enumerate(columns) for b in columns[i + 1:])


@check("M13_correlations", f"WITH {NEXT.format(v='tower_dump')}, {MET} {corr_sql(movement.METRICS, 'mt')}")
def _(v):
    return movement.correlations(movement.movement_metrics(v.tower_dump, **L), movement.METRICS)


DEV = [str(9000000000 + i) for i in range(50)]


@check("M14_co_movement", """
SELECT us - us % 300000000 AS bin, string_agg(DISTINCT mobile_number, '|' ORDER BY mobile_number) AS devices, string_agg(DISTINCT tower_id, '|' ORDER BY tower_id) AS towers, round(avg(lat), 4) AS center_lat,
 round(avg(lon), 4) AS center_lon FROM tower_dump WHERE mobile_number BETWEEN '9000000000' AND '9000000049' GROUP BY 1 HAVING count(DISTINCT mobile_number) >= 2 AND count(DISTINCT tower_id) <= 2""")
def _(v):
    return movement.co_movement(v.tower_dump, DEV, **L)


@check("M15_area_visits", """
WITH i AS (SELECT *, tower_id IN ('T1', 'T2', 'T3', 'T4') AS ins FROM tower_dump), l AS (SELECT *, coalesce(lag(ins) OVER w, false) AS was, lag(us) OVER w AS pu FROM i WINDOW w AS (PARTITION BY mobile_number ORDER BY us, event_id))
SELECT mobile_number, us AS timestamp, event_id, tower_id, CASE WHEN ins THEN 'ENTRY' ELSE 'EXIT' END AS kind, CASE WHEN NOT ins THEN round((us - pu) / 3600e6, 4) END AS visit_hours, hour(timestamp) AS hour FROM l WHERE was <> ins""")
def _(v):
    return movement.area_visits(v.tower_dump, ["T1", "T2", "T3", "T4"])


# -- geofence ----------------------------------------------------------------------------

@check("G1_busiest_towers", "SELECT tower_id, count(*) AS records FROM tower_dump GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def _(v):
    return geofence.busiest_towers(v.tower_dump)


DA = """da AS (SELECT tower_id, mobile_number, min(us) AS first_seen, max(us) AS last_seen, count(*) AS connections, count(DISTINCT CAST(timestamp AS DATE)) AS days, (max(us) - min(us)) / 60e6 AS minutes,
 min(timestamp) AS f FROM tower_dump WHERE tower_id IN (SELECT tower_id FROM tower_dump GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) GROUP BY 1, 2)"""


@check("G2_devices_at", f"WITH {DA} SELECT tower_id, mobile_number, first_seen, last_seen, connections, days, round(minutes, 4) AS minutes FROM da")
def _(v):
    return geofence.devices_at(v.tower_dump, geofence.busiest_towers(v.tower_dump))


@check("G3_categorize_devices", f"""WITH {DA} SELECT tower_id, mobile_number, CASE WHEN days >= 3 THEN 'RESIDENT' WHEN connections = 1 THEN 'ONE_TIME' WHEN minutes < 10 THEN 'BRIEF' ELSE 'OTHER' END AS category,
 hour(f) <= 5 AS odd_hour FROM da""")
def _(v):
    return geofence.categorize_devices(geofence.devices_at(v.tower_dump, geofence.busiest_towers(v.tower_dump)))


def sets(view, minutes):
    return f"""ts AS (SELECT mobile_number, us - us % {minutes * 60000000} AS bin, list_sort(list(DISTINCT tower_id)) AS t FROM {view} GROUP BY 1, 2)"""


@check("G4_overlap_zones", f"""WITH {sets('tower_dump_dense', 10)}, z AS (SELECT DISTINCT t, mobile_number FROM ts WHERE len(t) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY mobile_number) AS n FROM z)
SELECT array_to_string(t, '|') AS towers, count(*) AS devices, string_agg(mobile_number, '|' ORDER BY mobile_number) FILTER (n <= 5) AS samples FROM r GROUP BY t HAVING count(*) >= 3""")
def _(v):
    return geofence.overlap_zones(v.tower_dump_dense)


@check("G5_triangulable", f"WITH {sets('tower_dump_dense', 5)} SELECT mobile_number, bin, array_to_string(t, '|') AS towers, CASE WHEN len(t) >= 4 THEN 'HIGH' ELSE 'MEDIUM' END AS precision FROM ts WHERE len(t) >= 3")
def _(v):
    return geofence.triangulable(v.tower_dump_dense)


def _halved(v):
    return v.tower_dump.withColumn("tower_id", F.when(F.expr("CAST(mobile_number AS BIGINT) % 4 = 0"), F.lit("T0")).otherwise(F.col("tower_id")))


@check("G6_stationary", """WITH ts AS (SELECT mobile_number, us - us % 300000000 AS bin, list_sort(list(DISTINCT CASE WHEN CAST(mobile_number AS BIGINT) % 4 = 0 THEN 'T0' ELSE tower_id END)) AS t FROM tower_dump GROUP BY 1, 2)
SELECT mobile_number, array_to_string(min(t), '|') AS towers, count(*) * 5 AS minutes FROM ts GROUP BY 1 HAVING count(*) >= 3 AND min(t) = max(t)""")
def _(v):
    return geofence.stationary(geofence.triangulable(_halved(v), least=1))


DW = """dl AS (SELECT *, us - lag(us) OVER (PARTITION BY mobile_number, tower_id ORDER BY us, event_id) AS g FROM {v}),
dw AS (SELECT mobile_number, tower_id, count(*) AS connections, min(us) AS start, max(us) AS stop, max(g) AS g, min(timestamp) AS f FROM dl GROUP BY 1, 2
 HAVING count(*) >= 2 AND max(us) - min(us) >= 600000000 AND max(g) < {gap})"""


@check("G7_dwell", f"""WITH {DW.format(v='tower_dump_dense', gap=5400000000)} SELECT mobile_number, tower_id, connections, start, stop, round((stop - start) / 60e6, 4) AS minutes,
 CASE WHEN (stop - start) / 60e6 < 30 THEN 'SHORT' WHEN (stop - start) / 60e6 < 120 THEN 'MEDIUM' ELSE 'EXTENDED' END AS kind, g < 600000000 AS continuous, hour(f) >= 22 OR hour(f) <= 5 AS night_start FROM dw""")
def _(v):
    return geofence.dwell(v.tower_dump_dense, max_gap=90)


PER = f"""{S30}, co AS (SELECT tower_id FROM tower_dump GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5),
pe AS (SELECT mobile_number, CASE WHEN tower_id IN (FROM co) THEN 'ENTRY' ELSE 'EXIT' END AS direction, ft AS from_tower, tower_id AS to_tower, us AS timestamp, event_id FROM st
 WHERE ft IS NOT NULL AND (ft IN (FROM co)) <> (tower_id IN (FROM co)))"""


@check("G8_perimeter", f"WITH {PER} SELECT * FROM pe")
def _(v):
    return geofence.perimeter(v.tower_dump)


@check("G8_perimeter_devices", f"WITH {PER} SELECT mobile_number, count(*) AS crossings, count(*) FILTER (direction = 'ENTRY') AS entries FROM pe GROUP BY 1 HAVING count(*) >= 3")
def _(v):
    return geofence.perimeter_devices(geofence.perimeter(v.tower_dump))


DEN = """dh AS (SELECT tower_id, hour(timestamp) AS hour, count(*) AS n, row_number() OVER (PARTITION BY tower_id ORDER BY count(*) DESC, hour(timestamp)) AS k FROM tower_dump GROUP BY 1, 2),
de AS (SELECT t.*, hour AS peak_hour, n AS peak_connections, connections * 1.0 / devices AS r FROM (SELECT tower_id, count(*) AS connections, count(DISTINCT mobile_number) AS devices,
 (max(us) - min(us)) / 3600e6 AS hours FROM tower_dump GROUP BY 1) t JOIN dh USING (tower_id) WHERE k = 1),
dx AS (SELECT *, CASE WHEN r > 10 THEN 'HIGH_REPEAT' WHEN r < 1.5 AND devices > 20 THEN 'TRANSIENT' ELSE 'NORMAL' END AS anomaly FROM de)"""


@check("G9_tower_density", f"""WITH {DEN} SELECT tower_id, connections, devices, round(hours, 4) AS hours, round(connections / hours, 4) AS per_hour, peak_hour, peak_connections, round(r, 4) AS repeat_ratio, anomaly FROM dx""")
def _(v):
    return geofence.tower_density(v.tower_dump)


@check("G10_towers_within", f"SELECT tower_id, round(lat, 4) AS lat, round(lon, 4) AS lon, coverage_radius, round({km('lat', 'lon', '17.2', '82.05')}, 4) AS km FROM towers WHERE {km('lat', 'lon', '17.2', '82.05')} <= 12")
def _(v):
    return geofence.towers_within(v.towers, 17.2, 82.05, 12, "lon")


NB = f"nb AS (SELECT a.tower_id, b.tower_id AS other_tower_id, {km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM towers a JOIN towers b ON a.tower_id <> b.tower_id)"


@check("G10_neighbours_of", f"WITH {NB} SELECT tower_id, other_tower_id, round(km, 4) AS km FROM nb WHERE km <= 9")
def _(v):
    return geofence.neighbours_of(v.towers, 9, "lon").select("tower_id", "other_tower_id", "km")


@check("G11_enrich", "SELECT d.event_id, d.tower_id, round(t.lat, 4) AS lat, round(t.lon, 4) AS long, t.coverage_radius FROM tower_dump d LEFT JOIN (SELECT * FROM towers WHERE tower_id <> 'T3') t USING (tower_id)")
def _(v):
    return geofence.enrich(v.tower_dump.select("event_id", "tower_id"), v.towers.filter("tower_id <> 'T3'"), "lon")


@check("G12_coverage_overlap", f"""WITH {NB}, r AS (SELECT *, 1.0 + CAST(substr(tower_id, 2) AS INT) % 4 AS r1, 1.0 + CAST(substr(other_tower_id, 2) AS INT) % 4 AS r2 FROM nb WHERE km <= 12)
SELECT tower_id, other_tower_id, round(km, 4) AS km, round(CASE WHEN km > r1 + r2 THEN 0 WHEN km <= abs(r1 - r2) THEN 100 ELSE 100 * (1 - km / (r1 + r2)) END, 4) AS overlap_pct FROM r""")
def _(v):
    wide = v.towers.withColumn("coverage_radius", F.expr("1.0D + CAST(substr(tower_id, 2) AS INT) % 4"))
    return geofence.coverage_overlap(geofence.neighbours_of(wide, 12, "lon"))


@check("G13_tower_info", "SELECT tower_id, round(lat, 4) AS lat, round(lon, 4) AS lon, coverage_radius FROM towers WHERE tower_id IN ('T2', 'T5')")
def _(v):
    return geofence.tower_info(v.towers, ["T2", "T5"])


@check("G14_geofence_overview", f"""WITH {sets('tower_dump_dense', 5)}, {DW.format(v='tower_dump_dense', gap=1800000000)}, {DEN.replace('FROM tower_dump ', 'FROM tower_dump_dense ')}
SELECT 'towers' AS item, count(DISTINCT tower_id) AS value FROM tower_dump_dense UNION ALL SELECT 'devices', count(DISTINCT mobile_number) FROM tower_dump_dense
UNION ALL SELECT 'triangulable_instants', count(*) FROM ts WHERE len(t) >= 3 UNION ALL SELECT 'extended_dwell', count(*) FROM dw WHERE stop - start >= 7200000000
UNION ALL SELECT 'density_anomalies', count(*) FROM dx WHERE anomaly <> 'NORMAL'""")
def _(v):
    return geofence.geofence_overview(v.tower_dump_dense)
