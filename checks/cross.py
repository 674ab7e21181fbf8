"""Tower, call and session records together."""

from pyspark.sql import functions as F

from tallymast.operators import correlate, crossref, ipdr

from . import check
from .ipdr import feat


def sess(v):
    return ipdr.with_session_features(v.ipdr)


def part(v):
    return ipdr.with_session_features(v.ipdr_part)


PRES = """pres AS (SELECT party, bool_or(t) AS in_tower, bool_or(c) AS in_cdr, bool_or(i) AS in_ipdr FROM (SELECT DISTINCT mobile_number AS party, true AS t, false AS c, false AS i FROM tower_dump
 UNION ALL SELECT DISTINCT a_party, false, true, false FROM cdr_part UNION ALL SELECT DISTINCT subject, false, false, true FROM ipdr_part) GROUP BY 1)"""


@check("X1_silent_devices", """SELECT mobile_number, count(*) AS records, min(us) AS first_seen, max(us) AS last_seen, round((max(us) - min(us)) / 3600e6, 4) AS hours, max(us) - min(us) < 3600000000 AND count(*) < 5 AS brief
FROM tower_dump WHERE mobile_number NOT IN (SELECT a_party FROM cdr_part) AND mobile_number NOT IN (SELECT subject FROM ipdr_part) GROUP BY 1""")
def _(v):
    return crossref.silent_devices(v.tower_dump, v.cdr_part, part(v))


@check("X2_channel_only", f"WITH {PRES} SELECT party, CASE WHEN in_ipdr THEN 'DATA_ONLY' ELSE 'VOICE_ONLY' END AS channel FROM pres WHERE in_tower AND in_cdr <> in_ipdr")
def _(v):
    return crossref.channel_only(v.tower_dump, v.cdr_part, part(v))


def _shifted(v):
    """Calls a little after the tower record they come from, so that links are not all at zero."""
    return v.cdr.withColumn("datetime", F.timestamp_micros(F.col("us") + (F.col("event_id") % 700) * 1_000_000))


LINK = """lk AS (SELECT t.mobile_number, t.us AS tower_time, t.tower_id, c.cu AS call_time, c.b_party, c.duration_seconds, c.call_type FROM tower_dump t
 JOIN (SELECT *, us + (event_id % 700) * 1000000 AS cu FROM cdr) c ON c.a_party = t.mobile_number AND c.cu - t.us BETWEEN -300000000 AND 300000000)"""


@check("X3_link_calls", f"WITH {LINK} SELECT * FROM lk")
def _(v):
    return crossref.link_calls(v.tower_dump, _shifted(v)).drop("gap_seconds")


@check("X3_link_summary", f"WITH {LINK} SELECT mobile_number, count(*) AS links, count(DISTINCT tower_id) AS towers, count(DISTINCT b_party) AS contacts FROM lk GROUP BY 1")
def _(v):
    return crossref.link_summary(crossref.link_calls(v.tower_dump, _shifted(v)))


@check("X4_unseen_callers", "SELECT a_party, count(*) AS calls FROM cdr_part WHERE a_party NOT IN (SELECT mobile_number FROM tower_dump) GROUP BY 1")
def _(v):
    return crossref.unseen_callers(v.tower_dump, v.cdr_part)


SL = f"""{feat()}, sl AS (SELECT t.mobile_number, t.us AS tower_time, t.tower_id, f.us AS session_start, f.app, f.enc, f.vol FROM tower_dump t JOIN f ON f.subject = t.mobile_number AND f.us - t.us BETWEEN -300000000 AND 300000000)"""


@check("X5_link_sessions", f"WITH {SL} SELECT mobile_number, tower_time, tower_id, session_start, app AS detected_app, enc AS is_encrypted, vol AS total_data_volume FROM sl")
def _(v):
    return crossref.link_sessions(v.tower_dump, sess(v))


@check("X5_encrypted_at_towers", f"WITH {SL} SELECT app, tower_id, count(*) AS sessions, count(DISTINCT mobile_number) AS numbers FROM sl WHERE enc GROUP BY 1, 2")
def _(v):
    return crossref.encrypted_at_towers(crossref.link_sessions(v.tower_dump, sess(v)))


@check("X5_volume_at_towers", f"WITH {SL} SELECT tower_id, count(*) AS sessions, round(sum(vol) / 1048576.0, 4) AS mb FROM sl WHERE vol > 10485760 GROUP BY 1")
def _(v):
    return crossref.volume_at_towers(crossref.link_sessions(v.tower_dump, sess(v)))


def _late(v):
    """Sessions moved by up to two hours, so that some have no record near them."""
    return part(v).withColumn("start_time", F.timestamp_micros(F.col("us") + (F.col("event_id") % 7200) * 1_000_000))


@check("X6_unplaced_sessions", f"""WITH {feat('ipdr_part')}, g AS (SELECT *, us + (event_id % 7200) * 1000000 AS su FROM f WHERE enc)
SELECT subject, su AS start_time, app AS detected_app, vol AS total_data_volume, event_id FROM g WHERE NOT EXISTS (SELECT 1 FROM tower_dump t WHERE t.mobile_number = g.subject AND abs(t.us - g.su) <= 300000000)""")
def _(v):
    return crossref.unplaced_sessions(v.tower_dump, _late(v))


@check("X6_unplaced_sessions_any", f"""WITH {feat('ipdr_part')}, g AS (SELECT *, us + (event_id % 7200) * 1000000 AS su FROM f WHERE enc)
SELECT subject, su AS start_time, app AS detected_app, vol AS total_data_volume, event_id FROM g WHERE NOT EXISTS (SELECT 1 FROM tower_dump t WHERE abs(t.us - g.su) <= 20000000)""")
def _(v):
    return crossref.unplaced_sessions(v.tower_dump, _late(v), minutes=1 / 3, same_party=False)


PROF = """pt AS (SELECT mobile_number AS party, count(*) AS tower_records, count(DISTINCT tower_id) AS towers, count(DISTINCT imei) AS imeis, min(us) AS first_seen, max(us) AS last_seen FROM tower_dump GROUP BY 1),
pc AS (SELECT a_party AS party, count(*) AS calls, count(DISTINCT b_party) AS contacts, CAST(sum(duration_seconds) AS BIGINT) AS call_seconds, count(*) FILTER (hour(datetime) <= 5) AS odd_calls FROM cdr_part GROUP BY 1),
ps AS (SELECT subject AS party, count(*) AS sessions FROM ipdr_part GROUP BY 1),
pj AS (SELECT party, coalesce(tower_records, 0) AS tower_records, coalesce(towers, 0) AS towers, coalesce(imeis, 0) AS imeis, coalesce(calls, 0) AS calls, coalesce(contacts, 0) AS contacts, coalesce(call_seconds, 0) AS call_seconds,
 coalesce(odd_calls, 0) AS odd_calls, coalesce(sessions, 0) AS sessions, first_seen, last_seen FROM pt FULL JOIN pc USING (party) FULL JOIN ps USING (party)),
pf AS (SELECT *, list_filter([CASE WHEN imeis > 1 THEN 'SEVERAL_IMEIS' END, CASE WHEN tower_records = 1 THEN 'ONE_TIME_VISITOR' END, CASE WHEN odd_calls > 0 THEN 'ODD_HOUR_CALLS' END, CASE WHEN calls > 50 THEN 'MANY_CALLS' END,
 CASE WHEN tower_records > 0 AND calls = 0 THEN 'SILENT' END], lambda x: x IS NOT NULL) AS ind FROM pj)"""


@check("X7_profiles", f"WITH {PROF} SELECT party, tower_records, towers, imeis, calls, contacts, call_seconds, odd_calls, sessions, first_seen, last_seen, array_to_string(ind, '|') AS indicators, len(ind) >= 2 AS high FROM pf")
def _(v):
    return crossref.profiles(v.tower_dump, v.cdr_part, part(v))


EVENTS = f"""ev3 AS (SELECT mobile_number AS party, us AS at, 'tower' AS source, tower_id AS detail FROM tower_dump UNION ALL SELECT a_party, us, 'call', b_party FROM cdr_part UNION ALL SELECT subject, us, 'session', app FROM f)"""


@check("X7_party_events", f"WITH {feat('ipdr_part')}, {EVENTS} SELECT * FROM ev3")
def _(v):
    return crossref.party_events(v.tower_dump, v.cdr_part, part(v))


@check("X8_scene_calls", """WITH tw AS (SELECT tower_id FROM tower_dump GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), m AS (SELECT DISTINCT tower_id, mobile_number AS n FROM tower_dump WHERE tower_id IN (FROM tw)),
c AS (SELECT a_party, b_party, count(*) AS k FROM cdr_part GROUP BY 1, 2), p AS (SELECT m.tower_id, c.* FROM m JOIN c ON c.a_party = m.n), i AS (SELECT p.* FROM p JOIN m ON m.tower_id = p.tower_id AND m.n = p.b_party),
d AS (SELECT tower_id, count(*) AS devices FROM m GROUP BY 1), a AS (SELECT tower_id, count(DISTINCT a_party) AS callers, CAST(sum(k) AS BIGINT) AS calls FROM p GROUP BY 1),
b AS (SELECT tower_id, count(*) AS inner_links, CAST(sum(k) AS BIGINT) AS inner_calls FROM i GROUP BY 1)
SELECT tower_id, devices, coalesce(callers, 0) AS callers, coalesce(calls, 0) AS calls, coalesce(inner_links, 0) AS inner_links, coalesce(inner_calls, 0) AS inner_calls FROM d LEFT JOIN a USING (tower_id) LEFT JOIN b USING (tower_id)""")
def _(v):
    return crossref.scene_calls(v.tower_dump, v.cdr_part)


@check("X9_post_arrival_calls", """WITH f AS (SELECT mobile_number, tower_id, min(us) AS arrived FROM tower_dump_dense GROUP BY 1, 2)
SELECT mobile_number, tower_id, arrived, count(*) AS calls, round(min(c.us - arrived) / 60e6, 4) AS first_delay_minutes FROM f JOIN (SELECT a_party, us FROM calls_dense) c ON c.a_party = mobile_number AND c.us - arrived BETWEEN 0 AND 600000000 GROUP BY 1, 2, 3""")
def _(v):
    return crossref.post_arrival_calls(v.tower_dump_dense, v.calls_dense)


@check("X10_silent_zones", """WITH m AS (SELECT DISTINCT tower_id, mobile_number AS n FROM tower_dump), c AS (SELECT DISTINCT a_party FROM cdr_part)
SELECT tower_id, count(*) AS devices, count(*) - count(a_party) AS silent, round((count(*) - count(a_party)) * 1.0 / count(*), 4) AS silent_share FROM m LEFT JOIN c ON a_party = n GROUP BY 1 HAVING count(*) > 5 AND (count(*) - count(a_party)) * 1.0 / count(*) > 0.25""")
def _(v):
    return crossref.silent_zones(v.tower_dump, v.cdr_part, share=0.25)


@check("X11_source_coverage", f"WITH {PRES} SELECT in_tower, in_cdr, in_ipdr, count(*) AS parties FROM pres GROUP BY 1, 2, 3")
def _(v):
    return crossref.source_coverage(v.tower_dump, v.cdr_part, part(v))


@check("X12_resolve_identity", """WITH c AS (SELECT DISTINCT 'Name_' || a_party AS cdr_key, a_party AS msisdn FROM cdr_part), i AS (SELECT DISTINCT 'IPDR_91' || subject AS ipdr_key, subject AS msisdn FROM ipdr_part)
SELECT cdr_key, ipdr_key, msisdn FROM c JOIN i USING (msisdn)""")
def _(v):
    c = v.cdr_part.select(F.concat(F.lit("Name_"), "a_party").alias("cdr_key"))
    i = v.ipdr_part.select(F.concat(F.lit("IPDR_91"), "subject").alias("ipdr_key"))
    return crossref.resolve_identity(c, i)


# -- calls and sessions ------------------------------------------------------------------

def dense(v):
    return ipdr.with_session_features(v.ipdr_dense)


CE = "ce AS (SELECT *, us + duration_seconds * 1000000 AS ce FROM {v})"
K2 = """k2 AS (SELECT ce.subject, ce.us AS call_time, ce.ce AS call_end, ce.b_party, ce.event_id AS call_event_id, f.us AS data_start, f.app, f.enc, f.dur, f.vol / 1048576.0 AS mb, f.event_id AS session_event_id, f.us - ce.ce AS g
 FROM ce JOIN f ON f.subject = ce.subject AND f.us - ce.ce BETWEEN 0 AND 300000000),
k2r AS (SELECT *, CASE WHEN enc AND g < 60000000 THEN 'HIGH' WHEN mb > 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM k2),
k5 AS (SELECT *, CASE WHEN g < 60000000 THEN 'CRITICAL' WHEN g < 180000000 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM k2 WHERE enc)"""
DENSE = f"{feat('ipdr_dense')}, {CE.format(v='cdr_dense')}, {K2}"
SIL = """k3 AS (SELECT subject, ce AS silent_from, nx AS silent_to, (nx - ce) / 3600e6 AS hours, b_party AS last_party, np AS next_party FROM (SELECT *, lead(us) OVER w AS nx, lead(b_party) OVER w AS np FROM ce
 WINDOW w AS (PARTITION BY subject ORDER BY us, event_id)) WHERE nx - ce > 7200000000)"""
K4 = """k4 AS (SELECT k3.subject, silent_from, silent_to, hours, count(*) AS sessions, count(*) FILTER (enc) AS encrypted, sum(vol) / 1048576.0 AS mb, array_to_string(list_sort(list(DISTINCT app) FILTER (app IS NOT NULL)), '|') AS apps
 FROM k3 JOIN f ON f.subject = k3.subject AND f.us BETWEEN silent_from AND silent_to GROUP BY 1, 2, 3, 4)"""
K6 = """k6 AS (SELECT * FROM (SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.day, b.day) AS day, coalesce(calls, 0) AS calls, coalesce(sessions, 0) AS sessions,
 CASE WHEN coalesce(calls, 0) = 0 AND coalesce(sessions, 0) > {n} THEN 'VOICE_TO_DATA_SHIFT' WHEN coalesce(calls, 0) > {n} AND coalesce(sessions, 0) = 0 THEN 'DATA_TO_VOICE_SHIFT' END AS kind
 FROM (SELECT subject, CAST(datetime AS DATE) AS day, count(*) AS calls FROM {c} GROUP BY 1, 2) a FULL JOIN (SELECT subject, day, count(*) AS sessions FROM f GROUP BY 1, 2) b ON a.subject = b.subject AND a.day = b.day) WHERE kind IS NOT NULL)"""


@check("K1_call_end", "SELECT event_id, us + duration_seconds * 1000000 AS call_end FROM cdr")
def _(v):
    return correlate.with_call_end(v.cdr).select("event_id", "call_end")


@check("K2_call_to_data", f"WITH {DENSE} SELECT subject, call_time, call_end, b_party, call_event_id, data_start, app, enc AS is_encrypted, round(dur, 4) AS session_duration, round(mb, 4) AS mb, session_event_id, risk FROM k2r")
def _(v):
    return correlate.call_to_data(v.cdr_dense, dense(v)).drop("gap_seconds")


@check("K3_call_silences", f"WITH {CE.format(v='cdr')}, {SIL} SELECT subject, silent_from, silent_to, round(hours, 4) AS hours, last_party, next_party FROM k3")
def _(v):
    return correlate.call_silences(v.cdr)


@check("K4_data_in_silence", f"""WITH {feat('ipdr')}, {CE.format(v='cdr')}, {SIL}, {K4} SELECT subject, silent_from, silent_to, round(hours, 4) AS hours, sessions, encrypted, round(mb, 4) AS mb, coalesce(apps, '') AS apps,
 CASE WHEN encrypted > 5 OR mb > 50 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM k4""")
def _(v):
    return correlate.data_in_silence(correlate.call_silences(v.cdr), sess(v))


@check("K5_encrypted_after_call", f"WITH {DENSE} SELECT subject, call_event_id, session_event_id, data_start, app, round(mb, 4) AS mb, risk FROM k5")
def _(v):
    return correlate.encrypted_after_call(correlate.call_to_data(v.cdr_dense, dense(v))).select("subject", "call_event_id", "session_event_id", "data_start", "app", "mb", "risk")


@check("K6_channel_shifts", f"WITH {feat('ipdr_part')}, {K6.format(c='cdr', n=4)} SELECT subject, CAST(day AS VARCHAR) AS day, calls, sessions, kind FROM k6")
def _(v):
    return correlate.channel_shifts(v.cdr, part(v), more_than=4)


COUNTS = """kc AS (SELECT subject, count(*) AS call_to_data, count(*) FILTER (risk = 'HIGH') AS high_call_to_data FROM k2r GROUP BY 1), ke AS (SELECT subject, count(*) AS encrypted_after_call, count(*) FILTER (risk = 'CRITICAL') AS critical_encrypted FROM k5 GROUP BY 1),
ks AS (SELECT subject, count(*) AS silences, count(*) FILTER (encrypted > 5 OR mb > 50) AS high_silences, sum(mb) AS silent_mb FROM k4 GROUP BY 1), kh AS (SELECT subject, count(*) AS shifts, count(*) FILTER (kind = 'VOICE_TO_DATA_SHIFT') AS voice_to_data FROM k6 GROUP BY 1),
kn AS (SELECT s.subject, coalesce(call_to_data, 0) AS call_to_data, coalesce(high_call_to_data, 0) AS high_call_to_data, coalesce(encrypted_after_call, 0) AS encrypted_after_call, coalesce(critical_encrypted, 0) AS critical_encrypted,
 coalesce(silences, 0) AS silences, coalesce(high_silences, 0) AS high_silences, coalesce(silent_mb, 0) AS silent_mb, coalesce(shifts, 0) AS shifts, coalesce(voice_to_data, 0) AS voice_to_data
 FROM (SELECT DISTINCT subject FROM ce SEMI JOIN f USING (subject)) s LEFT JOIN kc USING (subject) LEFT JOIN ke USING (subject) LEFT JOIN ks USING (subject) LEFT JOIN kh USING (subject)),
kscore AS (SELECT *, least(100, least(high_call_to_data * 5, 25) + least(critical_encrypted * 10, 30) + least(high_silences * 8, 20) + least(shifts * 5, 15) + least(10, 5 * (CAST(encrypted_after_call > 10 AS INT) + CAST(silent_mb > 100 AS INT)))) AS score FROM kn)"""


def corr(calls, sessions):
    return f"{feat(sessions)}, {CE.format(v=calls)}, {K2}, {SIL}, {K4}, {K6.format(c=calls, n=20)}, {COUNTS}"


ALL = corr("cdr_dense", "ipdr_dense")
PART = corr("cdr", "ipdr_part")


def both(v):
    return correlate.correlate(v.cdr_dense, dense(v))


@check("K7_correlation_indicators", f"""WITH {ALL} SELECT subject, 'FREQUENT_CALL_TO_ENCRYPTION' AS indicator, 'HIGH' AS risk FROM kn WHERE encrypted_after_call > 10
UNION ALL SELECT subject, 'HEAVY_DATA_DURING_SILENCE', 'HIGH' FROM kn WHERE silent_mb > 100 UNION ALL SELECT subject, 'COMMUNICATION_SHIFT', 'MEDIUM' FROM kn WHERE voice_to_data > 0""")
def _(v):
    return both(v)["indicators"]


LV = "CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"


@check("K8_correlation_score", f"WITH {ALL} SELECT * REPLACE (round(silent_mb, 4) AS silent_mb), {LV} AS level FROM kscore")
def _(v):
    return both(v)["score"]


K9 = "k9 AS (SELECT x.subject AS a, y.subject AS b, x.data_start AS a_start, y.data_start AS b_start, x.app AS a_app, y.app AS b_app FROM k5 x JOIN k5 y ON x.subject < y.subject AND abs(x.data_start - y.data_start) < 300000000)"


@check("K9_coordinated_encryption", f"WITH {DENSE}, {K9} SELECT * FROM k9")
def _(v):
    return correlate.coordinated_encryption(correlate.encrypted_after_call(correlate.call_to_data(v.cdr_dense, dense(v)))).drop("gap_seconds")


@check("K9_coordinated_pairs", f"WITH {DENSE}, {K9} SELECT a, b, count(*) AS coincidences FROM k9 GROUP BY 1, 2")
def _(v):
    k5 = correlate.encrypted_after_call(correlate.call_to_data(v.cdr_dense, dense(v)))
    return correlate.coordinated_pairs(correlate.coordinated_encryption(k5, by_pair=True), by_pair=True).drop("closest_seconds")


@check("K10_timeline", f"WITH {feat()} SELECT subject, us AS at, 'call' AS source, b_party AS detail, CAST(duration_seconds AS DOUBLE) AS seconds FROM cdr UNION ALL SELECT subject, us, 'session', app, dur FROM f")
def _(v):
    return correlate.timeline(v.cdr, sess(v))


@check("K11_risk_amplifiers", f"""WITH {ALL} SELECT subject, round(CAST(CASE WHEN critical_encrypted > 5 THEN 1.5 ELSE 1 END * CASE WHEN silent_mb > 200 THEN 1.3 ELSE 1 END * CASE WHEN shifts > 3 THEN 1.2 ELSE 1 END AS DOUBLE), 4) AS multiplier,
 concat_ws('|', CASE WHEN critical_encrypted > 5 THEN 'IMMEDIATE_ENCRYPTION' END, CASE WHEN silent_mb > 200 THEN 'SILENT_DATA' END, CASE WHEN shifts > 3 THEN 'CHANNEL_SHIFTS' END) AS reasons FROM kn""")
def _(v):
    return both(v)["amplifiers"]


K12 = """k12 AS (SELECT a.subject, a.call_event_id, a.session_event_id, b.call_event_id AS encrypted_call_id, b.session_event_id AS encrypted_session_id, a.call_time, b.data_start AS encrypted_start FROM k2r a JOIN k5 b ON a.subject = b.subject
 AND a.risk = 'HIGH' AND abs(a.data_start - b.data_start) < 60000000)"""


@check("K12_event_chains", f"WITH {DENSE}, {K12} SELECT * FROM k12")
def _(v):
    return both(v)["chains"].select("subject", "call_event_id", "session_event_id", "encrypted_call_id", "encrypted_session_id", "call_time", "encrypted_start")


@check("K13_correlate", f"""WITH {PART} SELECT subject, call_to_data, encrypted_after_call, silences, shifts, score, {LV} AS level FROM kscore""")
def _(v):
    return correlate.correlate(v.cdr, part(v))["score"].select("subject", "call_to_data", "encrypted_after_call", "silences", "shifts", "score", "level")
