"""Composite analyses."""

from tallymast.operators import compose

from . import check
from .cdr import PATTERNS
from .cross import ALL, CE, COUNTS, DENSE, K2, K4, K6, K9, K12, PROF, SIL, _late, dense, sess
from .graph import BI, CO
from .ipdr import RISK_SQL, feat
from .location_network import E_
from .movement import NEXT, STEP, TRAJ
from .risk import R2C, R3
from .tower import BURN

PARTY = "9000000020"
AT = 1704110400000000


@check("J1_incident_scene", f"""WITH {feat('ipdr_dense')}, sc AS (SELECT * FROM tower_dump_dense WHERE tower_id IN ('T1', 'T2', 'T3') AND abs(us - {AT}) <= 3600000000),
a AS (SELECT mobile_number, bool_or(us < {AT}) AS b, bool_or(us > {AT}) AS f, count(*) AS records, min(us) AS first_seen, max(us) AS last_seen FROM sc GROUP BY 1),
cc AS (SELECT a_party, count(*) AS calls FROM cdr_dense WHERE abs(us - {AT}) <= 3600000000 GROUP BY 1), ii AS (SELECT subject, count(*) AS sessions, count(*) FILTER (enc) AS encrypted FROM f WHERE abs(us - {AT}) <= 3600000000 GROUP BY 1)
SELECT mobile_number, CASE WHEN b AND f THEN 'THROUGHOUT' WHEN b THEN 'LEFT' ELSE 'ARRIVED' END AS change, records, first_seen, last_seen, coalesce(calls, 0) AS calls, coalesce(sessions, 0) AS sessions, coalesce(encrypted, 0) AS encrypted,
 mobile_number NOT IN (SELECT a_party FROM cdr_dense) AND mobile_number NOT IN (SELECT subject FROM ipdr_dense) AS silent, records + coalesce(calls, 0) + coalesce(sessions, 0) AS activity
FROM a LEFT JOIN cc ON a_party = mobile_number LEFT JOIN ii ON subject = mobile_number""")
def _(v):
    return compose.incident_scene(v.tower_dump_dense, v.cdr_dense, dense(v), "2024-01-01 12:00:00", towers=["T1", "T2", "T3"], lon="lon")


@check("J2_journey", f"""WITH {feat('ipdr_dense')}, {NEXT.format(v="tower_dump_dense")}
SELECT us AS at, 'step' AS source, concat_ws(' > ', tower_id, tt) AS detail, round(kmh, 4) AS kmh, CASE WHEN kmh < 1 THEN 'stationary' WHEN kmh < 5 THEN 'walking' WHEN kmh < 25 THEN 'bicycle' WHEN kmh < 200 THEN 'vehicle'
 WHEN kmh > 500 THEN 'impossible' ELSE 'vehicle' END AS movement FROM nn WHERE mobile_number = '{PARTY}'
UNION ALL SELECT us, 'call', b_party, NULL, NULL FROM cdr_dense WHERE subject = '{PARTY}' UNION ALL SELECT us, 'session', app, NULL, NULL FROM f WHERE subject = '{PARTY}'""")
def _(v):
    return compose.journey(v.tower_dump_dense, v.cdr_dense, dense(v), PARTY, "2024-01-01", lon="lon")


@check("J3_party_network", f"""WITH {feat('ipdr_dense')}, c AS (SELECT DISTINCT tower_id, us // 300000000 AS b, mobile_number AS n FROM tower_dump_dense)
SELECT 'contact' AS kind, b_party AS other, count(*) AS weight FROM calls_dense WHERE subject = '{PARTY}' GROUP BY 2 UNION ALL SELECT 'app', app, count(*) FROM f WHERE subject = '{PARTY}' AND app IS NOT NULL GROUP BY 2
UNION ALL SELECT 'colocated', y.n, count(*) FROM c x JOIN c y USING (tower_id, b) WHERE x.n = '{PARTY}' AND y.n <> x.n GROUP BY 2 HAVING count(*) >= 2""")
def _(v):
    return compose.party_network(v.tower_dump_dense, v.cdr_dense, dense(v), PARTY, least=2)


EV = f"""{feat()}, {BURN.format(v='tower_dump', r=10)}, {STEP.format(v='tower_dump')}, gp AS (SELECT subject, us, lead(us) OVER (PARTITION BY subject ORDER BY us, event_id) AS nx FROM calls),
evi AS (SELECT subject AS party, 'CALL_DEVICES' AS indicator FROM calls GROUP BY 1 HAVING count(DISTINCT imei) >= 3 UNION ALL SELECT mobile_number, 'TOWER_DEVICES' FROM tower_dump GROUP BY 1 HAVING count(DISTINCT imei) >= 3
 UNION ALL SELECT subject, 'MOSTLY_ENCRYPTED' FROM f GROUP BY 1 HAVING count(*) FILTER (enc) * 100.0 / count(*) >= 60 UNION ALL SELECT DISTINCT subject, 'CALL_SILENCE' FROM gp WHERE nx - us > 48 * 3600000000
 UNION ALL SELECT mobile_number, 'SHORT_LIVED' FROM bk WHERE kind = 'SUSPECT' UNION ALL SELECT mobile_number, 'IMPOSSIBLE_TRAVEL' FROM sp WHERE ch AND kmh > 500 GROUP BY 1 HAVING count(*) >= 2)"""


def _ev(v):
    return compose.evasion_indicators(v.tower_dump, v.cdr, sess(v), lon="lon")


@check("J4_evasion_indicators", f"WITH {EV} SELECT * FROM evi")
def _(v):
    return _ev(v)


@check("J4_evasion_summary", f"WITH {EV} SELECT party, count(*) AS indicators, string_agg(indicator, '|' ORDER BY indicator) AS codes FROM evi GROUP BY 1")
def _(v):
    return compose.evasion_summary(_ev(v))


@check("J5_device_snapshot", f"""WITH {feat()}, e AS (SELECT 'call' AS source, us AS at, b_party AS detail FROM cdr WHERE subject = '{PARTY}' AND us <= 1705708800000000 UNION ALL SELECT 'session', us, app FROM f WHERE subject = '{PARTY}' AND us <= 1705708800000000)
SELECT source, "at", detail FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "at" DESC, detail) AS n FROM e) WHERE n <= 5
UNION ALL SELECT * FROM (SELECT 'tower', us, tower_id FROM tower_dump WHERE mobile_number = '{PARTY}' AND us <= 1705708800000000 ORDER BY us DESC LIMIT 1)""")
def _(v):
    return compose.device_snapshot(v.tower_dump, v.cdr, sess(v), PARTY, "2024-01-20 00:00:00")


@check("J6_device_patterns", f"""WITH {STEP.format(v='tower_dump_dense')}, c AS (SELECT DISTINCT tower_id, us // 300000000 AS b, mobile_number AS n FROM tower_dump_dense), o AS (SELECT * FROM sp WHERE mobile_number = '{PARTY}')
SELECT 'movement' AS section, unnest(['records', 'towers', 'moves', 'km']) AS item, round(unnest([count(*), count(DISTINCT tower_id), count(*) FILTER (ch), sum(km) FILTER (ch AND sec > 0)]), 4) AS value FROM o
UNION ALL SELECT 'hour', CAST(hour(timestamp) AS VARCHAR), CAST(count(*) AS DOUBLE) FROM o GROUP BY 2 UNION ALL SELECT 'device', imei, CAST(count(*) AS DOUBLE) FROM o GROUP BY 2
UNION ALL SELECT 'colocated', y.n, CAST(count(*) AS DOUBLE) FROM c x JOIN c y USING (tower_id, b) WHERE x.n = '{PARTY}' AND y.n <> x.n GROUP BY 2 HAVING count(*) >= 3""")
def _(v):
    return compose.device_patterns(v.tower_dump_dense, PARTY, lon="lon")


@check("J7_day_timeline", f"""WITH {DENSE}, r AS (SELECT subject, data_start, coalesce(app, '') AS d, max(CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS r FROM k2r GROUP BY 1, 2, 3)
SELECT subject, us AS at, 'call' AS source, b_party AS detail, CAST(duration_seconds AS DOUBLE) AS seconds, NULL AS after_call FROM cdr_dense WHERE CAST(datetime AS DATE) = DATE '2024-01-01'
UNION ALL SELECT f.subject, f.us, 'session', app, dur, CASE r WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' END FROM f LEFT JOIN r ON r.subject = f.subject AND r.data_start = f.us AND r.d = coalesce(app, '') WHERE f.day = DATE '2024-01-01'""")
def _(v):
    return compose.day_timeline(v.cdr_dense, dense(v), "2024-01-01")


def _risk(v):
    return compose.integrated_risk(v.cdr, sess(v), v.tower_dump)


# the parts are checked on their own; here they are joined
JR = f"""{PATTERNS}, {R2C}, {RISK_SQL}, {CE.format(v='cdr')}, {K2}, {SIL}, {K4}, {K6.format(c='cdr', n=20)}, {COUNTS}, {PROF.replace('cdr_part', 'cdr').replace('ipdr_part', 'ipdr')},
jl AS (SELECT subject AS party, CAST(least(100, score * CASE WHEN critical_encrypted > 5 THEN 1.5 ELSE 1 END * CASE WHEN silent_mb > 200 THEN 1.3 ELSE 1 END * CASE WHEN shifts > 3 THEN 1.2 ELSE 1 END) AS DOUBLE) AS correlation_score FROM kscore),
jj AS (SELECT party, CAST(a.score AS DOUBLE) AS call_score, CAST(b.score AS DOUBLE) AS session_score, correlation_score, coalesce(len(ind), 0) AS indicators
 FROM (SELECT subject AS party, score FROM r2l) a FULL JOIN (SELECT subject AS party, score FROM risk) b USING (party) FULL JOIN jl USING (party) FULL JOIN pf USING (party)),
jk AS (SELECT *, least(100, (coalesce(call_score, 0) + coalesce(session_score, 0) + coalesce(correlation_score, 0)) / greatest(1, (call_score IS NOT NULL)::INT + (session_score IS NOT NULL)::INT + (correlation_score IS NOT NULL)::INT)
 + 5 * indicators) AS combined FROM jj), jz AS (SELECT *, CASE WHEN combined >= 70 THEN 'HIGH' WHEN combined >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM jk)"""


def _risk(v):
    return compose.integrated_risk(v.cdr, sess(v), v.tower_dump)


@check("J8_integrated_risk", f"WITH RECURSIVE {JR} SELECT party, call_score, session_score, round(correlation_score, 4) AS correlation_score, indicators, round(combined, 4) AS combined, level FROM jz")
def _(v):
    return _risk(v)


@check("J9_priority_list", f"WITH RECURSIVE {JR} SELECT party, round(combined, 4) AS combined, level, indicators FROM jz WHERE combined >= 40 ORDER BY jz.combined DESC, party LIMIT 50")
def _(v):
    return compose.priority_list(_risk(v))


@check("J10_coordination", f"""WITH {DENSE}, {K9}, s AS (SELECT len(list_distinct(list(subject) OVER (ORDER BY us RANGE BETWEEN CURRENT ROW AND 300000000 FOLLOWING))) AS n FROM calls_dense)
SELECT 'synchronized_calls' AS section, count(*) AS rows FROM s WHERE n >= 2 UNION ALL SELECT 'coordinated_encryption', count(*) FROM (SELECT DISTINCT a, b FROM k9) UNION ALL SELECT 'channel_shifts', 0
UNION ALL SELECT 'pattern_days', count(*) FROM (SELECT 1 FROM calls_dense GROUP BY subject HAVING count(*) FILTER (dayname(datetime) IN ('Tuesday', 'Friday')) * 100.0 / count(*) > 25)""")
def _(v):
    return compose.report_sizes(compose.coordination(v.cdr_dense, dense(v)))


def melt(section, table, columns, names=None):
    cells = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"SELECT '{section}' AS section, unnest({list(names or columns)}) AS item, unnest([{cells}]) AS value FROM {table} WHERE subject = '{PARTY}'"


@check("J11_dossier", f"WITH RECURSIVE {JR} " + " UNION ALL ".join([
    melt("calls", "patterns", ["total", "imei_count", "bursts", "voice_only", "contacts", "tower_count", "activity_change"]), melt("call_risk", "r2l", ["score", "level"]),
    melt("sessions", "riskl", ["es", "ds", "ss", "sa", "score", "level"], ["encryption_score", "data_score", "session_score", "app_score", "score", "level"]),
    melt("correlation", "kscore", ["call_to_data", "encrypted_after_call", "silences", "shifts", "score", "CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"],
         ["call_to_data", "encrypted_after_call", "silences", "shifts", "score", "level"])]))
def _(v):
    return compose.dossier(v.cdr, sess(v), PARTY)


@check("J12_evidence_links", f"""WITH {ALL}, {K9}, {K12} SELECT subject, 'CHAIN' AS kind, count(*) AS links FROM k12 GROUP BY 1 UNION ALL SELECT subject, 'DATA_IN_SILENCE', count(*) FROM k4 WHERE encrypted > 5 OR mb > 50 GROUP BY 1
UNION ALL SELECT subject, 'COORDINATED_ENCRYPTION', count(*) FROM (SELECT a AS subject FROM k9 UNION ALL SELECT b FROM k9) GROUP BY 1""")
def _(v):
    return compose.evidence_links(v.cdr_dense, dense(v))


@check("J13_group_activity")
def _(v):
    return compose.report_sizes(compose.group_activity(v.tower_dump_dense, "2024-01-01 12:00:00"))


@check("J14_movement_patterns", f"""WITH {STEP.format(v='tower_dump_dense')}, tm AS (SELECT * FROM sp WHERE ch AND sec > 0 AND sec < 7200), q AS (SELECT mobile_number, tower_id, ch, km, sec, row_number() OVER (PARTITION BY mobile_number ORDER BY us, event_id) AS n
 FROM sp WHERE ch OR ft IS NULL), sq AS (SELECT mobile_number, list(tower_id ORDER BY n) FILTER (n <= 10) AS s, sum(km) FILTER (ch AND sec > 0) AS km FROM q GROUP BY 1)
SELECT 'vehicle_users' AS section, count(*) AS rows FROM (SELECT 1 FROM tm WHERE kmh BETWEEN 20 AND 200 GROUP BY mobile_number HAVING count(*) >= 3) UNION ALL SELECT 'fast_moves', count(*) FROM tm WHERE kmh > 100
UNION ALL SELECT 'impossible', count(*) FROM (SELECT 1 FROM sp WHERE ch AND kmh > 500 GROUP BY mobile_number HAVING count(*) >= 2) UNION ALL SELECT 'traffic', count(*) FROM (SELECT t FROM (SELECT ft AS t FROM sp WHERE ch UNION ALL SELECT tower_id FROM sp WHERE ch) GROUP BY 1 HAVING count(*) > 50)
UNION ALL SELECT 'circular', count(*) FROM sq WHERE km > 50 OR (len(s) >= 4 AND list_contains(s[4:], s[1]))""")
def _(v):
    return compose.report_sizes(compose.movement_patterns(v.tower_dump_dense, lon="lon"))


@check("J15_cross_reference", f"""WITH {PROF}, {feat('ipdr_part')}, g AS (SELECT *, us + (event_id % 7200) * 1000000 AS su FROM f WHERE enc)
SELECT 'silent_devices' AS section, count(*) AS rows FROM (SELECT DISTINCT mobile_number FROM tower_dump WHERE mobile_number NOT IN (SELECT a_party FROM cdr_part) AND mobile_number NOT IN (SELECT subject FROM ipdr_part))
UNION ALL SELECT 'call_links', count(DISTINCT t.mobile_number) FROM tower_dump t JOIN cdr_part c ON c.a_party = t.mobile_number AND abs(c.us - t.us) <= 300000000
UNION ALL SELECT 'unplaced_sessions', count(*) FROM g WHERE NOT EXISTS (SELECT 1 FROM tower_dump t WHERE t.mobile_number = g.subject AND abs(t.us - g.su) <= 300000000)
UNION ALL SELECT 'high_profiles', count(*) FROM pf WHERE len(ind) >= 2""")
def _(v):
    return compose.report_sizes(compose.cross_reference(v.tower_dump, v.cdr_part, _late(v)))


@check("J16_tower_report", f"""WITH {STEP.format(v='tower_dump_dense')}, {TRAJ}, {CO}, {BI}, {BURN.format(v='tower_dump_dense', r=10)}
SELECT 'summary' AS section, 2 AS rows UNION ALL SELECT 'one_time_visitors', count(*) FROM (SELECT 1 FROM tower_dump_dense GROUP BY mobile_number HAVING count(*) = 1) UNION ALL SELECT 'burner', count(*) FROM bk WHERE kind = 'SUSPECT'
UNION ALL SELECT 'trajectories', count(*) FROM tj UNION ALL SELECT 'impossible', count(*) FROM (SELECT 1 FROM sp WHERE ch AND kmh > 500 GROUP BY mobile_number HAVING count(*) >= 2) UNION ALL SELECT 'identity', 1
UNION ALL SELECT 'device_sharing', count(*) FROM (SELECT 1 FROM tower_dump_dense GROUP BY imei HAVING count(DISTINCT imsi) > 1 OR count(DISTINCT mobile_number) > 1) UNION ALL SELECT 'hubs', count(*) FROM dg WHERE degree >= 10
UNION ALL SELECT 'isolated', count(DISTINCT mobile_number) FROM tower_dump_dense WHERE mobile_number NOT IN (SELECT node FROM dg)""")
def _(v):
    return compose.report_sizes(compose.tower_report(v.tower_dump_dense, lon="lon"))


@check("J17_ipdr_report", f"""WITH {RISK_SQL}, n AS (SELECT count(DISTINCT subject) AS n FROM f)
SELECT unnest(['summary', 'encryption', 'data', 'sessions', 'apps', 'risk']) AS section, n AS rows FROM n UNION ALL SELECT 'encrypted_apps', count(*) FROM (SELECT DISTINCT subject, app FROM f WHERE enc)
UNION ALL SELECT 'upload_spikes', count(*) FROM usp UNION ALL SELECT 'marathons', count(*) FROM f WHERE dur > 7200 UNION ALL SELECT 'app_usage', count(*) FROM au""")
def _(v):
    return compose.report_sizes(compose.ipdr_report(sess(v)))


@check("J18_cdr_report", f"""WITH RECURSIVE {PATTERNS}, {R3}, {E_} SELECT 'anomalies' AS section, count(*) FILTER (imei_count >= 2) + count(*) FILTER (odd_pct > 3) + count(*) FILTER (voice_only) AS rows FROM patterns
UNION ALL SELECT 'ranking', least(20, count(*)) FROM patterns UNION ALL SELECT 'common_contacts', count(*) FROM (SELECT DISTINCT x.subject, y.subject AS o FROM e x JOIN e y USING (contact) WHERE x.subject < y.subject)
UNION ALL SELECT 'priorities', least(3, count(*)) FROM r3l WHERE level = 'HIGH'""")
def _(v):
    return compose.report_sizes(compose.cdr_report(v.cdr))


@check("J19_integrated_report")
def _(v):
    return compose.report_sizes(compose.integrated_report(v.cdr, sess(v), v.tower_dump, lon="lon"))


_TQ = ", ".join(f"('{n}', count(*) FILTER ({c}))" for n, c in [
    ("timestamp.NULL", "timestamp IS NULL"), ("mobile_number.NULL", "mobile_number IS NULL"), ("tower_id.NULL", "tower_id IS NULL"), ("mobile_number.PATTERN", "length(mobile_number) <> 10"),
    ("imei.PATTERN", "length(imei) <> 15"), ("imsi.PATTERN", "length(imsi) <> 15"), ("lat.RANGE", "lat NOT BETWEEN -90 AND 90"), ("lon.RANGE", "lon NOT BETWEEN -180 AND 180")])
_FILLED = " + ".join(f"count({c})" for c in ("subject", "start_time", "end_time", "destination_port", "protocol", "data_volume_up", "data_volume_down"))


@check("J20_load_report", f"""WITH {feat()}, g AS (SELECT count(*) AS n FROM ipdr GROUP BY subject, start_time, end_time, destination_port, protocol, data_volume_up, data_volume_down),
q AS (SELECT 'ipdr' AS source, unnest([('encrypted', count(*) FILTER (enc)), ('quality.complete_pct', round(({_FILLED}) * 100.0 / (8 * count(*)), 4)), ('quality.duplicates', (SELECT sum(n - 1) FROM g)),
 ('quality.duplicate_pct', round((SELECT sum(n - 1) * 100.0 / sum(n) FROM g), 4)), ('quality.ends_before_start', count(*) FILTER (end_us < us)), ('time.span_days', (max(us) - min(us)) // 86400000000),
 ('time.future_rows', count(*) FILTER (us > 1706745600000000)), ('time.old_rows', count(*) FILTER (us < 1706745600000000 - 365 * 86400000000)), ('network.bad_ports', count(*) FILTER (destination_port NOT BETWEEN 1 AND 65535)),
 ('network.bad_ips', 0), ('volume.data_volume_up_negatives', count(*) FILTER (data_volume_up < 0)), ('volume.data_volume_down_negatives', count(*) FILTER (data_volume_down < 0)),
 ('records', count(*)), ('parties', count(DISTINCT subject))]) AS r FROM f),
t AS (SELECT 'tower' AS source, unnest([('records', count(*)), ('parties', count(DISTINCT mobile_number)), {_TQ}]) AS r FROM tower_dump),
c AS (SELECT 'cdr' AS source, unnest([('records', count(*)), ('parties', count(DISTINCT subject)), ('provider_messages', count(*) FILTER (is_provider_message))]) AS r FROM cdr)
SELECT source, r[1] AS item, CAST(r[2] AS DOUBLE) AS value FROM q UNION ALL SELECT source, r[1], CAST(r[2] AS DOUBLE) FROM t UNION ALL SELECT source, r[1], CAST(r[2] AS DOUBLE) FROM c""")
def _(v):
    return compose.load_report(v.cdr, sess(v), v.tower_dump, "2024-02-01 00:00:00", lon="lon")
