"""Tower dumps: time, behaviour, identity."""

from pyspark.sql import functions as F

from tallymast.operators import behaviour, identity, tower_time

from . import check
from .cdr import km

T0, T1 = "2024-01-10 00:00:00", "2024-01-12 12:00:00"
U0, U1 = 1704844800000000, 1705060800000000
IN = f"us BETWEEN {U0} AND {U1}"


@check("W1_window_activity", f"SELECT count(*) AS records, count(DISTINCT mobile_number) AS devices, count(DISTINCT tower_id) AS towers FROM tower_dump WHERE {IN}")
def _(v):
    return tower_time.window_activity(v.tower_dump, T0, T1)


@check("W1_window_towers", f"SELECT tower_id, count(*) AS records FROM tower_dump WHERE {IN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(v):
    return tower_time.window_towers(v.tower_dump, T0, T1)


@check("W2_window_devices", """
SELECT mobile_number, min(us) AS first_seen, max(us) AS last_seen, count(*) AS records, CASE WHEN count(*) = 1 THEN 'SINGLE_PING' WHEN max(us) = min(us) THEN 'STATIONARY'
 WHEN max(us) - min(us) < 300000000 THEN 'BRIEF_PRESENCE' ELSE 'ACTIVE_MOVEMENT' END AS presence FROM tower_dump_dense WHERE us BETWEEN 1704099600000000 AND 1704101400000000 GROUP BY 1""")
def _(v):
    return tower_time.window_devices(v.tower_dump_dense, "2024-01-01 09:00:00", "2024-01-01 09:30:00")


@check("W3_window_only", "SELECT mobile_number, count(*) AS records FROM tower_dump GROUP BY 1 HAVING bool_and(us BETWEEN 1704153600000000 AND 1706572800000000)")
def _(v):
    return tower_time.window_only(v.tower_dump, "2024-01-02 00:00:00", "2024-01-30 00:00:00")


@check("W4_odd_hour_devices", """
WITH a AS (SELECT mobile_number, count(*) AS records, array_to_string(list_sort(list(DISTINCT hour(timestamp))), '|') AS hours, count(DISTINCT CAST(timestamp AS DATE)) AS days, count(DISTINCT tower_id) AS towers
 FROM tower_dump WHERE hour(timestamp) < 5 GROUP BY 1),
s AS (SELECT *, CASE WHEN records > 10 THEN 3 WHEN records > 5 THEN 2 ELSE 1 END + CASE WHEN days > 3 THEN 2 WHEN days > 1 THEN 1 ELSE 0 END
 + CASE WHEN towers > 3 THEN 2 WHEN towers > 1 THEN 1 ELSE 0 END AS score FROM a)
SELECT *, CASE WHEN score >= 6 THEN 'HIGH' WHEN score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""")
def _(v):
    return tower_time.odd_hour_devices(v.tower_dump)


AROUND = """ar AS (SELECT mobile_number, bool_or(us < 1704110400000000 AND us >= 1704110400000000 - 3600000000) AS before, bool_or(abs(us - 1704110400000000) <= 5000000) AS during,
 bool_or(us > 1704110400000000 AND us <= 1704110400000000 + 3600000000) AS after FROM tower_dump_dense WHERE us BETWEEN 1704110400000000 - 3600000000 AND 1704110400000000 + 3600000000 GROUP BY 1)"""


@check("W5_around", f"""WITH {AROUND} SELECT *, CASE WHEN before AND after THEN 'THROUGHOUT' WHEN before THEN 'LEFT' WHEN after THEN 'ARRIVED' ELSE 'DURING_ONLY' END AS change FROM ar
 WHERE before OR during OR after""")
def _(v):
    return tower_time.around(v.tower_dump_dense, "2024-01-01 12:00:00", during_seconds=5)


@check("W6_activity_bursts", """
SELECT us - us % 300000000 AS bin, count(*) AS records, count(DISTINCT mobile_number) AS devices, count(DISTINCT tower_id) AS towers, CASE WHEN count(*) > 40 THEN 'HIGH' ELSE 'MEDIUM' END AS level
FROM tower_dump_dense GROUP BY 1 HAVING count(*) >= 10""")
def _(v):
    return tower_time.activity_bursts(v.tower_dump_dense, high=40)


@check("W7_device_silence", """
WITH g AS (SELECT mobile_number, us, lag(us) OVER (PARTITION BY mobile_number ORDER BY us, event_id) AS p FROM tower_dump),
h AS (SELECT *, row_number() OVER (PARTITION BY mobile_number ORDER BY us - p DESC, p DESC) AS n, count(*) OVER (PARTITION BY mobile_number) AS silences FROM g WHERE us - p > 7200000000)
SELECT mobile_number, silences, round((us - p) / 60e6, 4) AS longest_minutes, p AS silent_from, us AS silent_to FROM h WHERE n = 1""")
def _(v):
    return tower_time.device_silence(v.tower_dump)


@check("W8_hourly_activity", "SELECT h AS hour, count(event_id) AS records FROM range(24) r(h) LEFT JOIN tower_dump ON hour(timestamp) = h GROUP BY 1")
def _(v):
    return tower_time.hourly_activity(v.tower_dump)


@check("W8_weekday_activity", "SELECT dayname(timestamp) AS day_of_week, count(*) AS records FROM tower_dump GROUP BY 1")
def _(v):
    return tower_time.weekday_activity(v.tower_dump)


@check("W8_temporal_profile", """
WITH h AS (SELECT h AS hour, count(event_id) AS n FROM range(24) r(h) LEFT JOIN tower_dump ON hour(timestamp) = h GROUP BY 1)
SELECT (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS peak_hour, (SELECT hour FROM h ORDER BY n, hour LIMIT 1) AS low_hour, CAST(sum(n) AS BIGINT) AS records,
 round(sum(n) FILTER (hour < 6) * 100.0 / sum(n), 4) AS odd_pct, CASE WHEN sum(n) FILTER (hour < 6) * 100.0 / sum(n) > 20 THEN 'HIGH'
 WHEN sum(n) FILTER (hour < 6) * 100.0 / sum(n) > 10 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM h""")
def _(v):
    return tower_time.temporal_profile(v.tower_dump)


# -- behaviour ---------------------------------------------------------------------------

FV = "fv AS (SELECT tower_id, mobile_number, count(*) AS visits, count(DISTINCT CAST(timestamp AS DATE)) AS days FROM {v} GROUP BY 1, 2 HAVING count(DISTINCT CAST(timestamp AS DATE)) >= 3 OR count(*) >= 5)"


@check("H1_frequent_visitors", f"""WITH {FV.format(v='tower_dump')} SELECT *, round(visits * 1.0 / days, 4) AS visits_per_day,
 CASE WHEN visits * 1.0 / days BETWEEN 0.8 AND 2.5 THEN 'COMMUTER' WHEN visits * 1.0 / days > 5 THEN 'HIGH_FREQUENCY' ELSE 'REGULAR' END AS kind FROM fv""")
def _(v):
    return behaviour.frequent_visitors(v.tower_dump)


def _split(v):
    """Dumps by two-hour slot of the dense day, so that numbers with one record in a dump exist."""
    slot = F.concat(F.lit("D"), F.floor(F.col("us") / 7_200_000_000).cast("string"))
    return v.tower_dump_dense.withColumn("dump_id", slot)


@check("H2_one_time_visitors", """
WITH d AS (SELECT *, 'D' || (us // 7200000000) AS d FROM tower_dump_dense), c AS (SELECT d, mobile_number FROM d GROUP BY 1, 2 HAVING count(*) = 1)
SELECT d AS dump_id, mobile_number, 1 AS records, us AS timestamp, tower_id, duration, imei, hour(timestamp) < 6 AS odd_hour FROM d JOIN c USING (d, mobile_number)""")
def _(v):
    return behaviour.one_time_visitors(_split(v))


RECON = """rt AS (SELECT mobile_number, tower_id, count(*) AS n, min(us) AS first FROM {v} GROUP BY 1, 2),
ra AS (SELECT mobile_number, CAST(sum(n) AS BIGINT) AS records, count(*) AS towers, count(*) FILTER (n <= 3) AS brief_towers, (max(first) - min(first)) // 86400000000 AS span_days FROM rt GROUP BY 1),
rb AS (SELECT mobile_number, count(*) FILTER (duration < 300) AS sh, count(DISTINCT hour(timestamp)) AS hours FROM {v} GROUP BY 1),
rs AS (SELECT *, CASE WHEN brief_towers >= 3 THEN 2 ELSE 0 END + CASE WHEN towers >= 3 AND span_days BETWEEN 3 AND 7 THEN 3 ELSE 0 END
 + CASE WHEN sh > records * 0.7 THEN 2 ELSE 0 END + CASE WHEN hours <= 3 THEN 1 ELSE 0 END AS score FROM ra JOIN rb USING (mobile_number) WHERE records <= 100)"""


@check("H3_recon_score", f"WITH {RECON.format(v='tower_dump')} SELECT mobile_number, records, towers, brief_towers, span_days, hours, score FROM rs WHERE score >= 3")
def _(v):
    return behaviour.recon_score(v.tower_dump)


@check("H4_group_candidates", """
WITH w AS (SELECT tower_id, us AS timestamp, mobile_number, event_id, len(list_distinct(list(mobile_number) OVER (PARTITION BY tower_id ORDER BY us RANGE BETWEEN CURRENT ROW AND 300000000 FOLLOWING))) AS numbers
 FROM tower_dump_dense) SELECT * FROM w WHERE numbers >= 3""")
def _(v):
    return behaviour.group_candidates(v.tower_dump_dense)


@check("H4_group_windows")
def _(v):
    return behaviour.group_windows(v.tower_dump_dense)


@check("H5_recurring_pairs")
def _(v):
    return behaviour.recurring_pairs(behaviour.group_windows(v.tower_dump_dense))


BURN = """bf AS (SELECT mobile_number, count(*) AS records, min(us) AS first_seen, (max(us) - min(us)) // 86400000000 AS span_days, count(*) FILTER (hour(timestamp) < 6) AS o, count(DISTINCT tower_id) AS towers,
 count(DISTINCT imei) AS imeis FROM {v} GROUP BY 1),
bs AS (SELECT *, CASE WHEN span_days <= 7 AND records <= {r} THEN 3 ELSE 0 END + CASE WHEN o > records * 0.5 THEN 2 ELSE 0 END + CASE WHEN towers <= 2 THEN 1 ELSE 0 END
 + CASE WHEN imeis = 0 THEN 1 WHEN imeis > 1 THEN 2 ELSE 0 END AS score FROM bf),
bk AS (SELECT *, CASE WHEN score >= 4 THEN 'SUSPECT' WHEN span_days <= 7 THEN 'NEW_SIM' END AS kind FROM bs)"""


@check("H6_burner_score", f"WITH {BURN.format(v='tower_dump_dense', r=60)} SELECT mobile_number, records, first_seen, span_days, towers, imeis, score, kind FROM bk WHERE kind IS NOT NULL")
def _(v):
    return behaviour.burner_score(v.tower_dump_dense, records=60)


@check("H7_bulk_activation", f"""WITH {BURN.format(v='tower_dump_dense', r=60)} SELECT CAST(CAST(make_timestamp(first_seen) AS DATE) AS VARCHAR) AS day, count(*) AS new_sims FROM bk
 WHERE kind = 'NEW_SIM' GROUP BY 1 HAVING count(*) >= 3""")
def _(v):
    return behaviour.bulk_activation(behaviour.burner_score(v.tower_dump_dense, records=60))


IRR = """il AS (SELECT *, lag(tower_id) OVER w AS pt, lag(us) OVER w AS pu FROM {v} WINDOW w AS (PARTITION BY mobile_number ORDER BY us, event_id)),
ia AS (SELECT mobile_number, count(*) AS records, count(*) FILTER (hour(timestamp) < 6) AS o, count(*) FILTER (duration < 60) AS b, count(*) FILTER (pt IS NULL OR pt <> tower_id) AS changes,
 count(*) FILTER (us - pu > 86400000000) AS long_gaps FROM il GROUP BY 1),
irr AS (SELECT *, CASE WHEN o * 1.0 / records > 0.3 THEN 2 ELSE 0 END + CASE WHEN b > records * 0.5 THEN 1 ELSE 0 END + CASE WHEN records > 10 AND changes > records * 0.7 THEN 2 ELSE 0 END
 + CASE WHEN long_gaps > 0 THEN 1 ELSE 0 END AS score FROM ia)"""


@check("H8_irregularity_score", f"WITH {IRR.format(v='tower_dump')} SELECT mobile_number, records, changes, long_gaps, score, CASE WHEN score >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM irr WHERE score >= 3")
def _(v):
    return behaviour.irregularity_score(v.tower_dump)


@check("H9_behaviour_overview", f"""WITH {FV.format(v='tower_dump')}, {RECON.format(v='tower_dump')}, {BURN.format(v='tower_dump', r=10)}, {IRR.format(v='tower_dump')}
SELECT 'numbers' AS finding, count(DISTINCT mobile_number) AS hits FROM tower_dump UNION ALL SELECT 'frequent_visitors', count(*) FROM fv
UNION ALL SELECT 'one_time_visitors', count(*) FROM (SELECT mobile_number FROM tower_dump GROUP BY 1 HAVING count(*) <= 1)
UNION ALL SELECT 'recon', count(*) FROM rs WHERE score >= 3 UNION ALL SELECT 'burner_suspects', count(*) FROM bk WHERE kind = 'SUSPECT'
UNION ALL SELECT 'new_sims', count(*) FROM bk WHERE kind = 'NEW_SIM' UNION ALL SELECT 'irregular', count(*) FROM irr WHERE score >= 3""")
def _(v):
    return behaviour.behaviour_overview(v.tower_dump).filter("finding <> 'group_windows'")


# -- identity ----------------------------------------------------------------------------

@check("E1_imei_timeline", """
WITH p AS (SELECT mobile_number, imei, min(us) AS first_seen, max(us) AS last_seen, count(*) AS records FROM tower_dump GROUP BY 1, 2)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY mobile_number) AS imei_count, count(*) OVER (PARTITION BY mobile_number) >= 3 AS high_risk FROM p) WHERE imei_count > 1""")
def _(v):
    return identity.imei_timeline(v.tower_dump)


@check("E1_imei_mean", "SELECT count(*) AS numbers, round(avg(n), 4) AS mean_imeis FROM (SELECT count(DISTINCT imei) AS n FROM tower_dump GROUP BY mobile_number HAVING count(DISTINCT imei) > 1)")
def _(v):
    return identity.imei_mean(v.tower_dump)


@check("E2_rapid_imei", """
WITH p AS (SELECT mobile_number, imei || dump_id AS imei, min(us) AS f, max(us) AS l FROM dumps GROUP BY 1, 2),
q AS (SELECT *, lag(imei) OVER w AS fi, f - lag(l) OVER w AS g FROM p WINDOW w AS (PARTITION BY mobile_number ORDER BY f, imei))
SELECT mobile_number, fi AS from_imei, imei AS to_imei, f AS changed_at, round(g / 3600e6, 4) AS gap_hours FROM q WHERE g BETWEEN 0 AND 24 * 3600000000""")
def _(v):
    return identity.rapid_imei(v.dumps.withColumn("imei", F.concat("imei", "dump_id")))


@check("E3_device_sharing", """SELECT imei, count(DISTINCT imsi) AS sims, count(DISTINCT mobile_number) AS numbers, count(*) AS records, count(DISTINCT imsi) >= 3 AS many_sims,
 count(DISTINCT mobile_number) > count(DISTINCT imsi) AS more_numbers_than_sims FROM tower_dump GROUP BY 1 HAVING count(DISTINCT imsi) > 1 OR count(DISTINCT mobile_number) > 1""")
def _(v):
    return identity.device_sharing(v.tower_dump, many_sims=3)


@check("E3_sim_timeline", """SELECT imei, imsi, min(us) AS first_seen, max(us) AS last_seen, count(DISTINCT mobile_number) AS numbers FROM tower_dump
 WHERE imei IN (SELECT imei FROM tower_dump GROUP BY 1 HAVING count(DISTINCT imsi) > 1 OR count(DISTINCT mobile_number) > 1) GROUP BY 1, 2""")
def _(v):
    return identity.sim_timeline(v.tower_dump)


@check("E4_sim_swap", """
WITH p AS (SELECT mobile_number, imsi, min(us) AS f, max(us) AS l FROM (SELECT * REPLACE (imsi || dump_id AS imsi) FROM dumps) GROUP BY 1, 2),
q AS (SELECT *, f - lag(l) OVER (PARTITION BY mobile_number ORDER BY f, imsi) AS g, count(*) OVER (PARTITION BY mobile_number) AS imsi_count FROM p)
SELECT mobile_number, imsi_count, bool_or(g >= 0 AND g < 2 * 86400000000) AS rapid FROM q WHERE imsi_count > 1 GROUP BY 1, 2""")
def _(v):
    return identity.sim_swap(v.dumps.withColumn("imsi", F.concat("imsi", "dump_id")))


@check("E5_imei_simultaneous", f"""
WITH s AS (SELECT *, lead(us) OVER w AS tu, lead(tower_id) OVER w AS tt, lead(mobile_number) OVER w AS tn, lead(lat) OVER w AS tl, lead(lon) OVER w AS tlo FROM tower_dump_dense
 WINDOW w AS (PARTITION BY imei ORDER BY us, event_id))
SELECT imei, us AS timestamp, tu AS to_time, tower_id AS from_tower, tt AS to_tower, mobile_number AS from_number, tn AS to_number, round({km('lat', 'lon', 'tl', 'tlo')}, 4) AS km FROM s
WHERE tu - us <= 300000000 AND tt <> tower_id""")
def _(v):
    return identity.imei_simultaneous(v.tower_dump_dense, lon="lon")


@check("E6_imei_impossible", f"""
WITH s AS (SELECT *, lag(tower_id) OVER w AS ft, lag(us) OVER w AS fu, lag(lat) OVER w AS fl, lag(lon) OVER w AS fo FROM tower_dump_dense WINDOW w AS (PARTITION BY imei ORDER BY us, event_id)),
t AS (SELECT *, {km('fl', 'fo', 'lat', 'lon')} AS km, (us - fu) / 1e6 AS sec FROM s WHERE ft <> tower_id AND us > fu)
SELECT imei, ft AS from_tower, tower_id AS to_tower, fu AS from_time, us AS to_time, round(km, 4) AS km, round(km * 3600 / sec, 4) AS kmh FROM t WHERE km * 3600 / sec > 500""")
def _(v):
    return identity.imei_impossible(v.tower_dump_dense, lon="lon").drop("seconds")


HAND = """hp AS (SELECT imei, mobile_number, min(us) AS f, max(us) AS l, count(*) AS n FROM tower_dump GROUP BY 1, 2),
hq AS (SELECT *, row_number() OVER w AS no, count(*) OVER (PARTITION BY imei) AS c, lag(mobile_number) OVER w AS o, (lag(l) OVER w - lag(f) OVER w) // 86400000000 AS used, lag(n) OVER w AS un,
 CAST(floor((f - lag(l) OVER w) / 86400000000) AS BIGINT) AS gap FROM hp WINDOW w AS (PARTITION BY imei ORDER BY f, mobile_number)),
hx AS (SELECT *, row_number() OVER (PARTITION BY imei ORDER BY no DESC) AS k FROM hq WHERE used >= 5 AND un >= 10 AND gap BETWEEN 0 AND 30)"""


@check("E7_device_handover", f"WITH {HAND} SELECT imei, o AS original, used AS used_days, un AS used_records, mobile_number AS successor, gap AS gap_days, c - no + 1 AS later_users FROM hx WHERE k = 1")
def _(v):
    return identity.device_handover(v.tower_dump, min_days=5, min_records=10)


@check("E8_identity_maps", """SELECT 'numbers_per_imei' AS kind, imei AS key, count(DISTINCT mobile_number) AS partners FROM tower_dump GROUP BY 2 HAVING count(DISTINCT mobile_number) > 1
UNION ALL SELECT 'imeis_per_number', mobile_number, count(DISTINCT imei) FROM tower_dump GROUP BY 2 HAVING count(DISTINCT imei) > 1
UNION ALL SELECT 'imsis_per_imei', imei, count(DISTINCT imsi) FROM tower_dump GROUP BY 2 HAVING count(DISTINCT imsi) > 1""")
def _(v):
    return identity.identity_maps(v.tower_dump)


@check("E9_device_pairs", """WITH l AS (SELECT DISTINCT imei, mobile_number AS n FROM tower_dump) SELECT x.n AS a, y.n AS b, count(*) AS devices FROM l x JOIN l y USING (imei) WHERE x.n < y.n GROUP BY 1, 2""")
def _(v):
    return identity.device_pairs(v.tower_dump)


@check("E10_identity_totals", "SELECT count(DISTINCT imei) AS imeis, count(DISTINCT imsi) AS imsis, count(DISTINCT mobile_number) AS numbers FROM tower_dump")
def _(v):
    return identity.identity_totals(v.tower_dump)


@check("E11_identity_overview", f"""WITH {HAND}, sim AS (SELECT count(*) AS c FROM (SELECT us, tower_id, lead(us) OVER w AS tu, lead(tower_id) OVER w AS tt FROM tower_dump WINDOW w AS (PARTITION BY imei ORDER BY us, event_id))
 WHERE tu - us <= 300000000 AND tt <> tower_id)
SELECT 'imeis' AS item, count(DISTINCT imei) AS value FROM tower_dump UNION ALL SELECT 'imsis', count(DISTINCT imsi) FROM tower_dump UNION ALL SELECT 'numbers', count(DISTINCT mobile_number) FROM tower_dump
UNION ALL SELECT 'numbers_with_several_imeis', count(*) FROM (SELECT 1 FROM tower_dump GROUP BY mobile_number HAVING count(DISTINCT imei) > 1)
UNION ALL SELECT 'shared_devices', count(*) FROM (SELECT 1 FROM tower_dump GROUP BY imei HAVING count(DISTINCT imsi) > 1 OR count(DISTINCT mobile_number) > 1)
UNION ALL SELECT 'simultaneous_use', c FROM sim UNION ALL SELECT 'handovers', count(*) FROM hx WHERE k = 1""")
def _(v):
    return identity.identity_overview(v.tower_dump, lon="lon", min_days=5, min_records=10)
