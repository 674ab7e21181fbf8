"""Scores, report tables and chart data sets."""

from pyspark.sql import functions as F

from tallymast.operators import cdr, charts, correlate, network, risk

from . import check
from .cdr import _CAND, _CYCLES, _RING, PATTERNS
from .cross import ALL, DENSE, K9, K12, both, sess
from .ipdr import feat
from .location_network import _CLUST, _STEPS
from .movement import corr_sql

R3 = """r3 AS (SELECT *, CASE WHEN imei_count >= 3 THEN 40 WHEN imei_count = 2 THEN 25 ELSE 0 END + CASE WHEN odd_pct > 3 THEN 25 WHEN odd_pct > 1 THEN 15 ELSE 0 END + CASE WHEN voice_only THEN 20 WHEN voice_pct > 90 THEN 10 ELSE 0 END
 + CASE WHEN high_frequency_contacts > 0 THEN 15 ELSE 0 END AS score FROM patterns),
r3l AS (SELECT *, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' WHEN imei_count >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level,
 list_filter([CASE WHEN score < 40 AND imei_count >= 2 THEN 'LIFTED_BY_DEVICES' END, CASE WHEN imei_count >= 3 THEN 'MANY_DEVICES' END, CASE WHEN imei_count = 2 THEN 'TWO_DEVICES' END, CASE WHEN odd_pct > 3 THEN 'ODD_HOURS_HIGH' END,
 CASE WHEN odd_pct > 1 AND odd_pct <= 3 THEN 'ODD_HOURS' END, CASE WHEN voice_only THEN 'VOICE_ONLY' END, CASE WHEN NOT voice_only AND voice_pct > 90 THEN 'VOICE_HEAVY' END,
 CASE WHEN high_frequency_contacts > 0 THEN 'FREQUENT_CONTACTS' END], lambda x: x IS NOT NULL)[1:3] AS ind FROM r3)"""


def p(v):
    return cdr.cdr_patterns(v.cdr)


@check("R1_cdr_risk_weighted", f"""WITH RECURSIVE {PATTERNS}, r AS (SELECT subject, least(100, 100 * (CASE WHEN imei_count >= 3 THEN 0.4 ELSE 0 END + CASE WHEN odd_pct > 20 THEN 0.25 * odd_pct / 10 ELSE 0 END + CASE WHEN voice_only THEN 0.2 ELSE 0 END
 + CASE WHEN bursts > 0 THEN 0.15 ELSE 0 END)) AS score, concat_ws('|', CASE WHEN imei_count >= 3 THEN 'SEVERAL_DEVICES' END, CASE WHEN odd_pct > 20 THEN 'ODD_HOURS' END, CASE WHEN voice_only THEN 'VOICE_ONLY' END,
 CASE WHEN bursts > 0 THEN 'BURSTS' END) AS factors FROM patterns)
SELECT subject, round(score, 4) AS score, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level, factors FROM r""")
def _(v):
    return risk.cdr_risk_weighted(p(v), odd_over=20)


R2 = """r2 AS (SELECT subject, imei_count, CASE WHEN imei_count >= 2 THEN 25 WHEN imsi_count > 1 THEN 10 ELSE 0 END AS device_risk,
 CASE WHEN odd_pct > 4 THEN 20 WHEN odd_pct > 2 THEN 15 WHEN odd_pct > 1 THEN 10 ELSE 0 END + CASE WHEN bursts > 3 THEN 5 ELSE 0 END AS temporal_risk, CASE WHEN voice_only THEN 20 WHEN voice_pct > 90 THEN 15 ELSE 0 END {talk} AS communication_risk,
 CASE WHEN high_frequency_contacts > 3 THEN 15 WHEN high_frequency_contacts > 0 THEN 10 ELSE 0 END AS frequency_risk, CASE WHEN tower_hopping THEN 10 ELSE 0 END AS location_risk, CASE WHEN activity_change <> 'NONE' THEN 10 ELSE 0 END AS behaviour_risk,
 {network} AS network_risk FROM patterns {joined}), r2s AS (SELECT *, device_risk + temporal_risk + communication_risk + frequency_risk + location_risk + behaviour_risk + network_risk AS score FROM r2),
r2l AS (SELECT * EXCLUDE (imei_count), CASE WHEN score >= 70 THEN 'CRITICAL' WHEN score >= 50 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' WHEN imei_count >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r2s)"""
R2C = R2.format(talk="", network="0", joined="")


@check("R2_cdr_risk_components", f"WITH RECURSIVE {PATTERNS}, {R2C} SELECT * FROM r2l")
def _(v):
    return risk.cdr_risk_components(p(v)).drop("factors")


NET = """e AS (SELECT subject, b_party AS contact, count(*) AS calls FROM calls GROUP BY ALL), dl AS (SELECT subject, count(*) AS direct_links FROM e WHERE contact IN (SELECT a_party FROM cdr) AND contact <> subject GROUP BY 1),
sh AS (SELECT subject, count(*) AS common_contacts FROM e WHERE contact IN (SELECT contact FROM e GROUP BY 1 HAVING count(*) > 1) GROUP BY 1)"""


@check("R2_cdr_risk_documented", f"""WITH RECURSIVE {PATTERNS}, {NET}, {R2.format(talk="+ CASE WHEN repeated_durations > 0 THEN 5 ELSE 0 END", network="CASE WHEN coalesce(direct_links, 0) > 0 THEN 10 WHEN coalesce(common_contacts, 0) >= 3 THEN 5 ELSE 0 END",
                                                            joined="LEFT JOIN dl USING (subject) LEFT JOIN sh USING (subject)").replace("CASE WHEN tower_hopping THEN 10 ELSE 0 END", "CASE WHEN tower_hopping THEN 10 WHEN rapid_changes > 2 THEN 8 ELSE 0 END")} SELECT * FROM r2l""")
def _(v):
    edges = network.contact_edges(v.cdr)
    ids = v.cdr.select("subject", F.col("a_party").alias("msisdn")).distinct()
    direct = network.direct_links(edges, ids).groupBy("subject").agg(F.count(F.lit(1)).alias("direct_links"))
    common = network.sharers(edges, network.shared_contacts(edges)).groupBy("subject").agg(F.count(F.lit(1)).alias("common_contacts"))
    full = p(v).join(direct, "subject", "left").join(common, "subject", "left").fillna(0, ["direct_links", "common_contacts"])
    return risk.cdr_risk_components(full, "documented").drop("factors")


@check("R3_cdr_risk_report", f"WITH RECURSIVE {PATTERNS}, {R3} SELECT subject, score, level, array_to_string(ind, '|') AS primary_indicators FROM r3l")
def _(v):
    return risk.cdr_risk_report(p(v))


@check("R4_critical_anomalies", f"""WITH RECURSIVE {PATTERNS} SELECT subject, 'DEVICE_SWITCHING' AS anomaly, CAST(imei_count AS DOUBLE) AS value, CASE WHEN imei_count >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM patterns WHERE imei_count >= 2
UNION ALL SELECT subject, 'ODD_HOUR_ACTIVITY', round(odd_pct, 4), CASE WHEN odd_pct > 25 THEN 'HIGH' ELSE 'MEDIUM' END FROM patterns WHERE odd_pct > 20 UNION ALL SELECT subject, 'VOICE_ONLY', 100.0, 'HIGH' FROM patterns WHERE voice_only""")
def _(v):
    return risk.critical_anomalies(p(v), odd_over=20, odd_high=25)


@check("R5_rank_subjects", f"WITH RECURSIVE {PATTERNS}, {R3} SELECT row_number() OVER (ORDER BY score DESC, subject) AS rank, subject, score, level FROM r3l ORDER BY 1 LIMIT 20")
def _(v):
    return risk.rank_subjects(risk.cdr_risk_report(p(v)))


@check("R5_priority_list", f"""WITH RECURSIVE {PATTERNS}, {R3} SELECT subject, score, concat_ws('|', CASE WHEN list_has_any(ind, ['MANY_DEVICES', 'TWO_DEVICES']) THEN 'CHECK_DEVICES' END,
 CASE WHEN list_has_any(ind, ['ODD_HOURS_HIGH', 'ODD_HOURS']) THEN 'CHECK_NIGHT_ACTIVITY' END, CASE WHEN list_has_any(ind, ['VOICE_ONLY', 'VOICE_HEAVY']) THEN 'CHECK_CALLS' END,
 CASE WHEN list_contains(ind, 'FREQUENT_CONTACTS') THEN 'CHECK_CONTACTS' END) AS follow_up FROM r3l WHERE level = 'HIGH' ORDER BY score DESC, subject LIMIT 3""")
def _(v):
    return risk.priority_list(risk.cdr_risk_report(p(v)))


@check("R6_risk_distribution", f"WITH RECURSIVE {PATTERNS}, {R2C} SELECT level, count(*) AS subjects, round(avg(score), 4) AS mean_score FROM r2l GROUP BY 1")
def _(v):
    return risk.risk_distribution(risk.cdr_risk_components(p(v)))


@check("R6_risk_details", f"WITH RECURSIVE {PATTERNS}, {R2C} SELECT subject, score, level FROM r2l WHERE score >= 30 OR level <> 'LOW'")
def _(v):
    return risk.risk_details(risk.cdr_risk_components(p(v))).select("subject", "score", "level")


@check("R7_correlation_summary", f"""WITH {ALL}, {K9}, {K12} SELECT 'subject' AS section, subject AS item, CAST(score AS DOUBLE) AS score, CAST(encrypted_after_call AS DOUBLE) AS encrypted_after_call, round(silent_mb, 4) AS silent_mb FROM kscore
UNION ALL SELECT 'total', 'coordinated_events', count(*), NULL, NULL FROM k9 UNION ALL SELECT 'total', 'chains', count(*), NULL, NULL FROM k12 UNION ALL SELECT 'total', 'high_risk', count(*) FILTER (score >= 70), NULL, NULL FROM kscore""")
def _(v):
    k = both(v)
    return risk.correlation_summary(k["counts"], k["coordinated"], k["chains"])


@check("R8_load_summary", """SELECT 'cdr' AS source, count(*) AS records, count(DISTINCT subject) AS parties, min(us) AS first_record, max(us) AS last_record FROM cdr UNION ALL SELECT 'ipdr', count(*), count(DISTINCT subject), min(us), max(us) FROM ipdr
UNION ALL SELECT 'tower', count(*), count(DISTINCT mobile_number), min(us), max(us) FROM tower_dump""")
def _(v):
    return risk.load_summary(v.cdr, v.ipdr, v.tower_dump)


def _flags(v):
    return risk.flag_rows(v.cdr, cycles=cdr.call_cycles(v.call_links), sync=network.synchronized(v.cdr))


_on_calls = lambda text: text.replace("calls_dense", "calls")
FLAGS = f"""{_CYCLES}, {_on_calls(_RING)}, {_on_calls(_STEPS)}, {_CLUST}, {_on_calls(_CAND)}, picks AS (
  SELECT c.subject, c.rn, c.calls, 1 AS n FROM cand c WHERE c.rn = (SELECT min(rn) FROM cand x WHERE x.subject = c.subject)
  UNION ALL SELECT c.subject, c.rn, c.calls, p.n + 1 FROM picks p JOIN cand c ON c.subject = p.subject AND p.n < 5 AND c.rn = (SELECT min(rn) FROM cand x WHERE x.subject = p.subject AND x.rn >= p.rn + p.calls)),
sy AS (SELECT subject, len(list_distinct(list(subject) OVER (ORDER BY us RANGE BETWEEN CURRENT ROW AND 300000000 FOLLOWING))) AS n FROM calls),
gp AS (SELECT subject, us, lead(us) OVER (PARTITION BY subject ORDER BY us, event_id) AS nx FROM calls),
d AS (SELECT subject, count(DISTINCT imei) AS i, count(DISTINCT imsi) AS m, count(*) FILTER (hour(datetime) < 5) * 100.0 / count(*) AS o, count(*) FILTER (dayname(datetime) IN ('Tuesday', 'Friday')) * 100.0 / count(*) AS w,
 count(*) FILTER (call_type LIKE 'CALL%') AS vc, count(*) FILTER (call_type LIKE 'SMS%') AS sm FROM calls GROUP BY 1),
rp AS (SELECT DISTINCT subject FROM (SELECT subject, duration_seconds FROM calls WHERE call_type LIKE 'CALL%' GROUP BY ALL HAVING count(*) > 5)),
dm AS (SELECT DISTINCT subject FROM (SELECT subject, b_party, count(*) AS n FROM calls GROUP BY ALL) JOIN tot USING (subject) WHERE n * 100.0 / total > 30), lo AS (SELECT DISTINCT unnest(m) AS subject FROM cyc),
tl AS (SELECT d.subject, sm = 0 AND vc > 10 AS vo, d.subject IN (FROM lo) AS lp, vc * 100.0 / (vc + sm) > 90 AS vh, d.subject IN (FROM dm) AS dc, signalling AS sg FROM d JOIN ring USING (subject)),
fl AS (SELECT 'device' AS family, 'DEVICE_LEVEL' AS flag, CASE WHEN i >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS level, subject FROM d WHERE i >= 2 UNION ALL SELECT 'device', 'SIM_SWAP', 'NONE', subject FROM d WHERE m > 1
 UNION ALL SELECT 'temporal', 'ODD_HOURS', CASE WHEN o > 3 THEN 'HIGH' ELSE 'MEDIUM' END, subject FROM d WHERE o > 1 UNION ALL SELECT 'temporal', 'DAY_CONCENTRATION', CASE WHEN w > 40 THEN 'HIGH' ELSE 'MEDIUM' END, subject FROM d WHERE w > 25
 UNION ALL SELECT 'temporal', 'MANY_BURSTS', 'NONE', subject FROM picks GROUP BY 4 HAVING count(*) > 3 UNION ALL SELECT DISTINCT 'temporal', 'SILENCE', 'NONE', subject FROM gp WHERE nx - us > 48 * 3600000000
 UNION ALL SELECT 'communication', 'COMMUNICATION_LEVEL', CASE WHEN vo OR lp THEN 'HIGH' ELSE 'MEDIUM' END, subject FROM tl WHERE vo OR lp OR vh OR dc OR sg UNION ALL SELECT 'communication', 'VOICE_ONLY', 'NONE', subject FROM tl WHERE vo
 UNION ALL SELECT 'communication', 'REPEATED_DURATIONS', 'NONE', subject FROM rp UNION ALL SELECT 'communication', 'DOMINANT_CONTACT', 'NONE', subject FROM tl WHERE dc
 UNION ALL SELECT 'communication', 'LOOPS', 'NONE', subject FROM tl WHERE lp UNION ALL SELECT 'communication', 'SIGNALLING', 'NONE', subject FROM tl WHERE sg
 UNION ALL SELECT DISTINCT 'location', 'IMPOSSIBLE_TRAVEL', 'NONE', subject FROM st WHERE sec > 0 AND km > 0.1 AND km * 3600 / sec > 200 UNION ALL SELECT DISTINCT 'location', 'CLUSTERS', 'NONE', subject FROM cl
 UNION ALL SELECT DISTINCT 'network', 'COORDINATED', 'NONE', subject FROM sy WHERE n >= 3)"""


@check("R9_flag_rows", f"WITH RECURSIVE {FLAGS} SELECT * FROM fl")
def _(v):
    return _flags(v)


@check("R9_flag_summary", f"WITH RECURSIVE {FLAGS} SELECT family, flag, level, count(*) AS subjects FROM fl GROUP BY 1, 2, 3")
def _(v):
    return risk.flag_summary(_flags(v))


# -- chart data sets ---------------------------------------------------------------------

@check("Z1_tower_heat", """WITH t AS (SELECT tower_id, count(*) AS records FROM tower_dump GROUP BY 1), x AS (SELECT *, records * 1.0 / max(records) OVER () AS i FROM t)
SELECT tower_id, records, round(i, 4) AS intensity, CASE WHEN i > 0.8 THEN 'HIGH' WHEN i > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM x""")
def _(v):
    return charts.tower_heat(v.tower_dump)


_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@check("Z2_hour_week_matrix", "SELECT hour(timestamp) AS hour, " + ", ".join(f"""count(*) FILTER (dayname(timestamp) = '{d}') AS "{d}" """ for d in _DAYS) + " FROM tower_dump GROUP BY 1")
def _(v):
    return charts.hour_week_matrix(v.tower_dump)


@check("Z3_device_density", """WITH d AS (SELECT tower_id, us - us % 3600000000 AS bin, count(DISTINCT mobile_number) AS devices FROM tower_dump_dense GROUP BY 1, 2) SELECT *, round(devices * 1.0 / max(devices) OVER (), 4) AS density FROM d""")
def _(v):
    return charts.device_density(v.tower_dump_dense)


@check("Z4_risk_by_tower", f"WITH RECURSIVE {PATTERNS}, {R3} SELECT tower_id, round(avg(coalesce(score, 0)), 4) AS mean_risk, CAST(max(coalesce(score, 0)) AS DOUBLE) AS max_risk, CAST(sum(coalesce(score, 0)) AS DOUBLE) AS total_risk, count(DISTINCT mobile_number) AS devices FROM tower_dump LEFT JOIN r3l ON subject = mobile_number GROUP BY 1")
def _(v):
    return charts.risk_by_tower(v.tower_dump, risk.cdr_risk_report(p(v)))


@check("Z4_risk_by_hour", f"WITH RECURSIVE {PATTERNS}, {R3} SELECT hour(timestamp) AS hour, round(avg(coalesce(score, 0)), 4) AS mean_risk, count(*) AS records FROM tower_dump LEFT JOIN r3l ON subject = mobile_number GROUP BY 1")
def _(v):
    return charts.risk_by_hour(v.tower_dump, risk.cdr_risk_report(p(v)))


@check("Z5_metric_correlation", f"""WITH m AS (SELECT mobile_number, count(*) AS records, count(DISTINCT tower_id) AS towers, count(DISTINCT CAST(timestamp AS DATE)) AS days, count(*) FILTER (hour(timestamp) <= 5) AS odd_records, count(DISTINCT imei) AS imeis,
 count(*) FILTER (hour(timestamp) <= 5) * 100.0 / count(*) AS odd_pct, count(DISTINCT tower_id) * 100.0 / count(*) AS mobility FROM tower_dump GROUP BY 1) {corr_sql(charts.DEVICE_METRICS, 'm')}""")
def _(v):
    return charts.metric_correlation(v.tower_dump)


@check("Z6_call_matrix", """WITH e AS (SELECT a_party, b_party, count(*) AS calls FROM cdr GROUP BY 1, 2), t AS (SELECT * FROM (SELECT a_party FROM e GROUP BY 1 ORDER BY sum(calls) DESC, 1 LIMIT 20) UNION SELECT * FROM (SELECT b_party FROM e GROUP BY 1 ORDER BY sum(calls) DESC, 1 LIMIT 20))
SELECT * FROM e WHERE a_party IN (FROM t) AND b_party IN (FROM t)""")
def _(v):
    return charts.call_matrix(v.cdr)


@check("Z7_activity_series", "SELECT us - us % 300000000 AS bin, tower_id, count(*) AS records, count(DISTINCT mobile_number) AS devices FROM tower_dump_dense GROUP BY 1, 2")
def _(v):
    return charts.activity_series(v.tower_dump_dense)


AP = """ap AS (SELECT mobile_number, min(us) AS first_seen, max(us) AS last_seen, count(*) AS records FROM tower_dump_dense WHERE abs(us - 1704110400000000) <= 7200000000 GROUP BY 1),
ak AS (SELECT *, CASE WHEN abs(first_seen - 1704110400000000) < 1800000000 THEN 'NEW' WHEN abs(last_seen - 1704110400000000) < 1800000000 THEN 'LEAVING' WHEN last_seen - first_seen < 3600000000 THEN 'TRANSIENT' ELSE 'PERSISTENT' END AS kind FROM ap)"""


@check("Z8_appearance_classes", f"WITH {AP} SELECT * FROM ak")
def _(v):
    return charts.appearance_classes(v.tower_dump_dense, "2024-01-01 12:00:00")


@check("Z8_appearance_series", f"WITH {AP} SELECT us - us % 300000000 AS bin, kind, count(DISTINCT mobile_number) AS devices FROM tower_dump_dense JOIN ak USING (mobile_number) WHERE abs(us - 1704110400000000) <= 7200000000 GROUP BY 1, 2")
def _(v):
    return charts.appearance_series(v.tower_dump_dense, charts.appearance_classes(v.tower_dump_dense, "2024-01-01 12:00:00"), "2024-01-01 12:00:00")


W0, W1 = 1704108600000000, 1704112200000000
REL = f"""wr AS (SELECT mobile_number, min(us) AS a, max(us) AS b, count(*) AS records, count(DISTINCT tower_id) AS towers FROM tower_dump_dense WHERE us BETWEEN {W0} - 7200000000 AND {W1} + 7200000000 GROUP BY 1),
wk AS (SELECT *, CASE WHEN a >= {W0} AND b <= {W1} THEN 'ONLY_DURING' WHEN a BETWEEN {W0} AND {W1} THEN 'ARRIVED' WHEN b BETWEEN {W0} AND {W1} THEN 'LEFT' WHEN a < {W0} AND b > {W1} THEN 'THROUGHOUT' ELSE 'OTHER' END AS relation FROM wr)"""


def _rel(v):
    return charts.window_relation(v.tower_dump_dense, "2024-01-01 11:30:00", "2024-01-01 12:30:00")


@check("Z9_window_relation", f"WITH {REL} SELECT mobile_number, a AS first_seen, b AS last_seen, records, towers, relation FROM wk")
def _(v):
    return _rel(v).drop("minutes")


@check("Z9_relation_series", f"WITH {REL} SELECT bin * 300000000 AS bin, relation, count(*) AS devices FROM (SELECT relation, unnest(range(a // 300000000, b // 300000000 + 1)) AS bin FROM wk) GROUP BY 1, 2")
def _(v):
    return charts.relation_series(_rel(v))


@check("Z9_key_devices", f"WITH {REL} SELECT mobile_number, relation, records FROM wk WHERE relation <> 'OTHER' ORDER BY b - a DESC, mobile_number LIMIT 10")
def _(v):
    return charts.key_devices(_rel(v)).select("mobile_number", "relation", "records")
