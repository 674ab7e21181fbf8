"""Data sessions."""

from tallymast.operators import ipdr

from . import check

APP = """CASE WHEN destination_port IN (443, 5222) AND protocol = 'TCP' THEN 'whatsapp'
 WHEN destination_port = 443 THEN 'signal' WHEN destination_port = 5222 THEN 'threema' WHEN destination_port = 8443 THEN 'banking'
 WHEN destination_port IN (3478, 19302) THEN 'video_call' WHEN destination_port IN (1194, 1723, 500) THEN 'vpn'
 WHEN destination_port IN (9001, 9050) THEN 'tor' END"""
RISK = """CASE WHEN app IN ('whatsapp', 'telegram', 'signal', 'threema', 'vpn') THEN 'HIGH' WHEN app IN ('banking', 'video_call') THEN 'MEDIUM'
 WHEN app = 'tor' THEN 'CRITICAL' ELSE 'LOW' END"""


def feat(view="ipdr"):
    return f"""f0 AS (SELECT *, {APP} AS app, (end_us - us) / 1e6 AS dur, data_volume_up + data_volume_down AS vol, hour(start_time) AS hour,
  CAST(start_time AS DATE) AS day, dayname(start_time) AS dow FROM {view}),
f AS (SELECT *, {RISK} AS risk, coalesce(app IN ('whatsapp', 'telegram', 'signal', 'threema'), false) AS enc, hour < 5 AS odd FROM f0)"""


def S(v, dense=False):
    return ipdr.with_session_features(v.ipdr_dense if dense else v.ipdr)


@check("A2_ipdr_summary", f"""WITH {feat()}
SELECT subject, count(*) AS sessions, round(sum(vol) / 1048576.0, 4) AS total_mb, round(sum(data_volume_up) / 1048576.0, 4) AS up_mb,
 round(sum(data_volume_down) / 1048576.0, 4) AS down_mb, count(*) FILTER (enc) AS encrypted, count(DISTINCT app) AS apps,
 count(*) FILTER (odd) AS odd_sessions, min(us) AS first_start, max(us) AS last_start, round(count(*) FILTER (enc) * 100.0 / count(*), 4) AS encrypted_pct,
 round(count(*) FILTER (odd) * 100.0 / count(*), 4) AS odd_pct FROM f GROUP BY 1""")
def _(v):
    return ipdr.ipdr_summary(S(v))


_ENC = """ep AS (SELECT subject, count(*) AS sessions, count(*) FILTER (enc) AS encrypted, count(*) FILTER (enc AND odd) AS odd_encrypted,
 count(DISTINCT app) FILTER (enc) AS high_risk_apps, count(*) FILTER (enc) * 100.0 / count(*) AS encrypted_pct FROM f GROUP BY 1)"""
_ESP = """ed AS (SELECT subject, day, count(*) AS n FROM f WHERE enc GROUP BY ALL),
es AS (SELECT subject, day, n FROM (SELECT *, avg(n) OVER w AS m, stddev_samp(n) OVER w AS s, count(*) OVER w AS c FROM ed WINDOW w AS (PARTITION BY subject))
 WHERE c > 3 AND n > m + 2 * s)"""
_EFL = """ef AS (SELECT subject, count(*) FILTER (odd) * 100.0 / count(*) AS op, sum(vol) > 1048576000 AS large_transfer, count(*) FILTER (dur > 3600) AS long_sessions
 FROM f WHERE enc GROUP BY 1), ec AS (SELECT subject, count(*) AS spike_days FROM es GROUP BY 1)"""


@check("I1_encryption_profile", f"WITH {feat()}, {_ENC} SELECT * REPLACE (round(encrypted_pct, 4) AS encrypted_pct) FROM ep")
def _(v):
    return ipdr.encryption_profile(S(v))


@check("I1_encryption_by_app", f"""WITH {feat()}
SELECT subject, app, risk, count(*) AS sessions, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY subject), 4) AS share_pct FROM f WHERE enc GROUP BY 1, 2, 3""")
def _(v):
    return ipdr.encryption_by_app(S(v))


@check("I2_encryption_spikes", f"WITH {feat()}, {_ESP} SELECT subject, CAST(day AS VARCHAR) AS day, n AS sessions FROM es")
def _(v):
    return ipdr.encryption_spikes(S(v))


@check("I2_encryption_flags", f"""WITH {feat()}, {_ESP}, {_EFL}
SELECT subject, round(op, 4) AS odd_encrypted_pct, op > 30 AS high_odd_hour, coalesce(spike_days, 0) AS spike_days, large_transfer, long_sessions,
 long_sessions > 10 AS long_encrypted FROM ef LEFT JOIN ec USING (subject)""")
def _(v):
    return ipdr.encryption_flags(S(v))


_ESC = f"""{_ENC}, {_ESP}, {_EFL}, escore AS (SELECT ep.*, least(100,
 CASE WHEN encrypted_pct >= 80 THEN 30 WHEN encrypted_pct >= 60 THEN 20 WHEN encrypted_pct >= 40 THEN 10 ELSE 0 END + least(high_risk_apps * 10, 20)
 + CASE WHEN op > 30 THEN 20 WHEN op > 15 THEN 10 ELSE 0 END
 + 15 * (CASE WHEN op > 30 THEN 1 ELSE 0 END + CASE WHEN large_transfer THEN 1 ELSE 0 END)) AS score FROM ep LEFT JOIN ef USING (subject))"""
LV = "CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END"


@check("I3_encryption_score", f"""WITH {feat()}, {_ESC}
SELECT subject, sessions, round(encrypted_pct, 4) AS encrypted_pct, odd_encrypted, high_risk_apps, score, {LV} AS level FROM escore""")
def _(v):
    return ipdr.encryption_score(S(v))


_VOL = """vp AS (SELECT subject, sum(data_volume_up) / 1048576.0 AS up_mb, sum(data_volume_down) / 1048576.0 AS down_mb FROM f GROUP BY 1)"""


@check("I4_volume_profile", f"""WITH {feat()}, {_VOL} SELECT subject, round(up_mb, 4) AS up_mb, round(down_mb, 4) AS down_mb, round(up_mb + down_mb, 4) AS total_mb,
 round(up_mb / down_mb, 4) AS ratio FROM vp""")
def _(v):
    return ipdr.volume_profile(S(v))


@check("I5_large_uploads", f"""WITH {feat()} SELECT subject, us AS start_time, event_id, round(data_volume_up / 1048576.0, 4) AS up_mb, app AS detected_app,
 round(dur, 4) AS session_duration FROM f WHERE data_volume_up > 10485760""")
def _(v):
    return ipdr.large_uploads(S(v))


_UD = """ud AS (SELECT subject, dow, count(*) AS sessions, sum(data_volume_up) AS up, sum(data_volume_up) * 100.0 / sum(sum(data_volume_up)) OVER (PARTITION BY subject) AS p
 FROM f GROUP BY 1, 2)"""


@check("I6_upload_days", f"""WITH {feat()}, {_UD} SELECT subject, dow AS day_of_week, sessions, round(up / 1048576.0, 4) AS up_mb, round(p, 4) AS upload_pct
 FROM ud WHERE dow IN ('Tuesday', 'Friday')""")
def _(v):
    return ipdr.upload_days(S(v))


_US = """dy AS (SELECT subject, day, sum(data_volume_up) AS up FROM f GROUP BY ALL),
usp AS (SELECT * FROM (SELECT *, avg(up) OVER w AS m, stddev_samp(up) OVER w AS s, count(*) OVER w AS c FROM dy WINDOW w AS (PARTITION BY subject))
 WHERE c > 5 AND up > m + 2 * s)"""


@check("I7_upload_spikes", f"""WITH {feat()}, {_US} SELECT subject, CAST(day AS VARCHAR) AS day, round(up / 1048576.0, 4) AS up_mb,
 CASE WHEN up > m + 3 * s THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM usp""")
def _(v):
    return ipdr.upload_spikes(S(v))


_UF = f"""{_VOL}, {_UD}, uc AS (SELECT subject, count(*) FILTER (data_volume_up > 10485760) AS large_uploads,
 count(*) FILTER (data_volume_up > 10485760 AND app IN ('whatsapp', 'telegram', 'signal')) AS messenger_uploads FROM f GROUP BY 1),
up2 AS (SELECT subject, sum(p) AS pp FROM ud WHERE dow IN ('Tuesday', 'Friday') GROUP BY 1),
uf AS (SELECT subject, large_uploads, messenger_uploads, coalesce(pp, 0) AS pp, large_uploads > 5 AS frequent_large_uploads, coalesce(pp, 0) > 40 AS day_concentration,
 up_mb / down_mb > 2 AND up_mb > 100 AS high_upload_ratio, messenger_uploads > 3 AS media_via_messenger, up_mb, up_mb / down_mb AS ratio
 FROM uc JOIN vp USING (subject) LEFT JOIN up2 USING (subject))"""


@check("I8_upload_flags", f"""WITH {feat()}, {_UF} SELECT subject, large_uploads, messenger_uploads, round(pp, 4) AS pattern_day_pct, frequent_large_uploads,
 day_concentration, high_upload_ratio, media_via_messenger, round(up_mb, 4) AS up_mb, round(ratio, 4) AS ratio FROM uf""")
def _(v):
    return ipdr.upload_flags(S(v))


_DSC = f"""{_UF}, {_US}, hs AS (SELECT subject, count(*) FILTER (up > m + 3 * s) AS h FROM usp GROUP BY 1),
dscore AS (SELECT uf.*, least(100, CASE WHEN large_uploads >= 10 THEN 25 WHEN large_uploads >= 5 THEN 15 WHEN large_uploads >= 3 THEN 10 ELSE 0 END
 + CASE WHEN up_mb >= 1000 THEN 20 WHEN up_mb >= 500 THEN 10 ELSE 0 END + CASE WHEN pp > 40 THEN 20 WHEN pp > 25 THEN 10 ELSE 0 END
 + least(20, 10 * coalesce(h, 0)) + least(30, 15 * (CAST(frequent_large_uploads AS INT) + CAST(day_concentration AS INT) + CAST(media_via_messenger AS INT)))) AS score
 FROM uf LEFT JOIN hs USING (subject))"""


@check("I9_data_score", f"""WITH {feat()}, {_DSC} SELECT subject, large_uploads, round(up_mb, 4) AS up_mb, round(ratio, 4) AS ratio, round(pp, 4) AS pattern_day_pct,
 score, {LV} AS level FROM dscore""")
def _(v):
    return ipdr.data_score(S(v))


@check("I10_session_stats", f"""WITH {feat()} SELECT subject, count(*) AS sessions, round(avg(dur), 4) AS mean_seconds, max(dur) AS max_seconds,
 count(*) FILTER (dur > 7200) AS marathons, count(*) FILTER (dur > 7200) > 5 AS frequent_marathons FROM f GROUP BY 1""")
def _(v):
    return ipdr.session_stats(S(v))


@check("I10_marathon_sessions", f"""WITH {feat()} SELECT subject, us AS start_time, event_id, round(dur / 3600, 4) AS hours, app AS detected_app,
 round(vol / 1048576.0, 4) AS mb FROM f WHERE dur > 7200""")
def _(v):
    return ipdr.marathon_sessions(S(v))


_SB = """sd AS (SELECT subject, day, count(*) AS n FROM f GROUP BY ALL),
sb AS (SELECT subject, avg(n) AS mean_daily, max(n) AS max_daily, min(n) AS min_daily, count(*) FILTER (n > m + 2 * s) AS burst_days
 FROM (SELECT *, avg(n) OVER w AS m, stddev_samp(n) OVER w AS s FROM sd WINDOW w AS (PARTITION BY subject)) GROUP BY 1)"""


@check("I11_session_bursts", f"WITH {feat()}, {_SB} SELECT subject, round(mean_daily, 4) AS mean_daily, max_daily, min_daily, burst_days, burst_days > 0 AS burst FROM sb")
def _(v):
    return ipdr.session_bursts(S(v))


_RS = """rs AS (SELECT *, us - pe AS gap FROM (SELECT *, lag(end_us) OVER w AS pe, lag(app) OVER w AS prev_app FROM f
 WINDOW w AS (PARTITION BY subject ORDER BY us, event_id)) WHERE us - pe BETWEEN 0 AND 30000000)"""


@check("I12_rapid_sessions", f"WITH {feat('ipdr_dense')}, {_RS} SELECT subject, us AS start_time, event_id, prev_app, app FROM rs")
def _(v):
    return ipdr.rapid_sessions(S(v, True)).drop("gap_seconds")


@check("I12_rapid_counts", f"WITH {feat('ipdr_dense')}, {_RS} SELECT subject, count(*) AS rapid, count(*) > 10 AS rapid_switching FROM rs GROUP BY 1")
def _(v):
    return ipdr.rapid_counts(S(v, True))


_CP = """cp AS (SELECT a.subject, a.us AS au, a.event_id AS a_id, b.event_id AS b_id, b.us AS bu, least(a.end_us, b.end_us) - b.us AS ov, a.app AS a_app, b.app AS b_app
 FROM f a JOIN f b ON a.subject = b.subject AND (b.us > a.us OR (b.us = a.us AND b.event_id > a.event_id)) AND least(a.end_us, b.end_us) - b.us > 60000000)"""


@check("I13_concurrent_sessions", f"""WITH {feat()}, {_CP}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY au, a_id, bu, b_id) AS pair_no FROM cp)
SELECT subject, pair_no, a_id, b_id, bu AS overlap_start, a_app, b_app FROM r WHERE pair_no <= 10""")
def _(v):
    return ipdr.concurrent_sessions(S(v)).drop("overlap_seconds")


@check("I13_concurrent_counts", f"WITH {feat()}, {_CP} SELECT subject, count(*) AS pairs, count(*) > 5 AS concurrent FROM cp GROUP BY 1")
def _(v):
    return ipdr.concurrent_counts(S(v))


_SC = """sc AS (SELECT subject, count(*) AS sessions, count(*) FILTER (hour < 6) * 100.0 / count(*) AS np,
 count(*) FILTER (dow IN ('Tuesday', 'Friday')) * 100.0 / count(*) AS pd FROM f GROUP BY 1)"""


@check("I14_session_calendar", f"""WITH {feat()}, {_SC} SELECT subject, sessions, round(np, 4) AS night_pct, round(pd, 4) AS pattern_day_pct, np > 30 AS night_owl,
 pd > 40 AS day_concentration FROM sc""")
def _(v):
    return ipdr.session_calendar(S(v))


@check("I14_session_histogram", f"WITH {feat()} SELECT subject, hour, dow AS day_of_week, count(*) AS sessions FROM f GROUP BY ALL")
def _(v):
    return ipdr.session_histogram(S(v))


_SSC = f"""{_SB}, {_RS}, {_CP}, {_SC}, rsc AS (SELECT subject, count(*) AS rapid FROM rs GROUP BY 1), cc AS (SELECT subject, least(count(*), 10) AS pairs FROM cp GROUP BY 1),
mm AS (SELECT subject, count(*) FILTER (dur > 7200) AS marathons FROM f GROUP BY 1),
sj AS (SELECT subject, marathons, coalesce(rapid, 0) AS rapid, coalesce(pairs, 0) AS pairs, max_daily, pd FROM mm JOIN sb USING (subject) JOIN sc USING (subject)
 LEFT JOIN rsc USING (subject) LEFT JOIN cc USING (subject)),
sscore AS (SELECT *, least(100, CASE WHEN marathons >= 10 THEN 20 WHEN marathons >= 5 THEN 10 ELSE 0 END + CASE WHEN rapid >= 20 THEN 25 WHEN rapid >= 10 THEN 15 ELSE 0 END
 + CASE WHEN pairs >= 10 THEN 25 WHEN pairs >= 5 THEN 15 ELSE 0 END
 + least(30, 15 * (CAST(marathons > 5 AS INT) + CAST(rapid > 10 AS INT) + CAST(pairs > 5 AS INT) + CAST(pd > 40 AS INT)))
 + CASE WHEN max_daily > 100 THEN 10 ELSE 0 END) AS score FROM sj)"""


@check("I15_session_score", f"WITH {feat()}, {_SSC} SELECT subject, marathons, rapid, pairs AS concurrent_pairs, max_daily, score, {LV} AS level FROM sscore")
def _(v):
    return ipdr.session_score(S(v))


_ALL_PAIRS = f"""WITH {feat()}, {_CP}, cc AS (SELECT subject, count(*) AS n FROM cp GROUP BY 1)
SELECT subject, coalesce(n, 0) AS all_concurrent_pairs, least(coalesce(n, 0), 10) AS concurrent_pairs
FROM (SELECT DISTINCT subject FROM f) LEFT JOIN cc USING (subject)"""


@check("I15_session_score_full", _ALL_PAIRS)
def _(v):
    return ipdr.session_score(S(v), full=True).select("subject", "all_concurrent_pairs", "concurrent_pairs")


@check("I23_components_full", _ALL_PAIRS)
def _(v):
    return ipdr.ipdr_components(S(v), full=True).select("subject", "all_concurrent_pairs", "concurrent_pairs")


_AU = "au AS (SELECT * FROM (SELECT subject, app, risk, count(*) AS sessions, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY subject) AS p FROM f GROUP BY 1, 2, 3) WHERE app IS NOT NULL)"


@check("I16_app_usage", f"WITH {feat()}, {_AU} SELECT subject, app, risk, sessions, round(p, 4) AS share_pct, risk IN ('HIGH', 'CRITICAL') AS high_risk FROM au")
def _(v):
    return ipdr.app_usage(S(v))


_UP = "upt AS (SELECT subject, destination_port, count(*) AS sessions, avg(vol) / 1048576.0 AS mb FROM f WHERE app IS NULL AND destination_port IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5)"


@check("I17_unknown_ports", f"WITH {feat()}, {_UP} SELECT subject, destination_port, sessions, round(mb, 4) AS mean_mb FROM upt")
def _(v):
    return ipdr.unknown_ports(S(v))


@check("I17_unknown_share", f"""WITH {feat()} SELECT subject, round(count(*) FILTER (app IS NULL) * 100.0 / count(*), 4) AS unknown_pct,
 count(*) FILTER (app IS NULL) * 100.0 / count(*) > 30 AS high_unknown FROM f GROUP BY 1""")
def _(v):
    return ipdr.unknown_share(S(v))


_AT = """tr AS (SELECT subject, pa AS from_app, app AS to_app, count(*) AS times FROM (SELECT *, lag(app) OVER (PARTITION BY subject ORDER BY us, event_id) AS pa FROM f)
 WHERE pa IS NOT NULL AND app IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 5),
tk AS (SELECT *, CASE WHEN from_app IN ('whatsapp', 'telegram', 'signal') AND to_app IN ('whatsapp', 'telegram', 'signal') AND from_app <> to_app THEN 'APP_SWITCHING'
 WHEN from_app IN ('tor', 'vpn') OR to_app IN ('tor', 'vpn') THEN 'ANONYMIZATION' END AS kind FROM tr)"""


@check("I18_app_transitions", f"WITH {feat()}, {_AT} SELECT * FROM tk WHERE kind IS NOT NULL")
def _(v):
    return ipdr.app_transitions(S(v))


_AB = """ab AS (SELECT subject, app, count(*) AS sessions, avg(dur) AS md, count(*) FILTER (odd) AS o, avg(vol) AS m, stddev_samp(vol) AS s FROM f WHERE app IS NOT NULL
 GROUP BY 1, 2 HAVING count(*) > 10),
abp AS (SELECT *, CASE WHEN s > m * 2 THEN 'HIGHLY_VARIABLE' WHEN o * 1.0 / sessions > 0.5 THEN 'ODD_HOURS' ELSE 'NORMAL' END AS pattern FROM ab)"""


@check("I19_app_behaviour", f"""WITH {feat()}, {_AB}, h AS (SELECT subject, app, hour, row_number() OVER (PARTITION BY subject, app ORDER BY count(*) DESC, hour) AS n FROM f GROUP BY 1, 2, 3),
hh AS (SELECT subject, app, string_agg(hour, '|' ORDER BY n) AS top_hours FROM h WHERE n <= 3 GROUP BY 1, 2)
SELECT subject, app AS detected_app, sessions, top_hours, round(md, 4) AS mean_seconds, pattern FROM abp JOIN hh USING (subject, app)""")
def _(v):
    return ipdr.app_behaviour(S(v))


@check("I20_port_profile", f"""WITH {feat()}, p AS (SELECT subject, destination_port, count(*) AS sessions, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY subject) AS s,
 row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, destination_port) AS rank FROM f GROUP BY 1, 2)
SELECT subject, destination_port, sessions, round(s, 4) AS share_pct, rank, CASE destination_port WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 8443 THEN 'HTTPS-Alt'
 WHEN 1194 THEN 'OpenVPN' WHEN 9001 THEN 'Tor' ELSE 'Unknown' END AS service FROM p WHERE rank <= 10""")
def _(v):
    return ipdr.port_profile(S(v))


@check("I20_nonstandard_share", f"""WITH {feat()}, n AS (SELECT subject, count(*) FILTER (destination_port NOT IN (80, 443, 8080, 8443, 25, 587, 110, 143, 993, 995)) * 100.0 / count(*) AS p FROM f GROUP BY 1)
SELECT subject, round(p, 4) AS nonstandard_pct, p > 50 AS nonstandard FROM n""")
def _(v):
    return ipdr.nonstandard_share(S(v))


_PP = """pp0 AS (SELECT subject, destination_port, count(*) AS n FROM f GROUP BY 1, 2),
pq AS (SELECT subject, count(*) FILTER (destination_port > 10000) AS high_ports, stddev_samp(n) FILTER (destination_port > 10000) / avg(n) FILTER (destination_port > 10000) AS cv,
 coalesce(sum(n) FILTER (destination_port IN (6881, 6882, 6883, 6884, 6885, 6886, 6887, 6888, 6889, 4662, 4672, 1214, 6346, 6347, 8333, 30303)), 0) AS ps FROM pp0 GROUP BY 1),
pr AS (SELECT subject, high_ports, CAST(ps AS BIGINT) AS p2p_sessions, CASE WHEN high_ports > 1 AND cv < 0.5 THEN 'DISTRIBUTED_HIGH_PORTS' WHEN ps > 10 THEN 'KNOWN_PORTS' END AS reason,
 CASE WHEN high_ports > 1 AND cv < 0.5 THEN 80 WHEN ps > 10 THEN 90 ELSE 0 END AS confidence FROM pq)"""


@check("I21_p2p", f"WITH {feat()}, {_PP} SELECT * FROM pr")
def _(v):
    return ipdr.p2p(S(v), high_ports=1)


_ASC = f"""{_AU}, {_UP}, {_AT}, {_AB}, {_PP.replace('high_ports > 1 ', 'high_ports > 20 ')},
a1 AS (SELECT subject, count(*) AS high_risk_apps FROM au WHERE risk IN ('HIGH', 'CRITICAL') GROUP BY 1), a2 AS (SELECT subject, count(*) AS unknown_ports FROM upt GROUP BY 1),
a3 AS (SELECT subject, count(*) AS combos FROM tk WHERE kind IS NOT NULL GROUP BY 1), a4 AS (SELECT subject, count(*) FILTER (pattern = 'ODD_HOURS') AS odd_apps FROM abp GROUP BY 1),
aj AS (SELECT b.subject, coalesce(high_risk_apps, 0) AS high_risk_apps, coalesce(unknown_ports, 0) AS unknown_ports, coalesce(combos, 0) AS combos, coalesce(odd_apps, 0) AS odd_apps,
 coalesce(confidence > 0, false) AS is_p2p FROM (SELECT DISTINCT subject FROM f) b LEFT JOIN a1 USING (subject) LEFT JOIN a2 USING (subject) LEFT JOIN a3 USING (subject)
 LEFT JOIN a4 USING (subject) LEFT JOIN pr USING (subject)),
ascore AS (SELECT *, least(100, CASE WHEN high_risk_apps >= 3 THEN 25 WHEN high_risk_apps >= 1 THEN 15 ELSE 0 END + CASE WHEN unknown_ports >= 10 THEN 20 WHEN unknown_ports >= 5 THEN 10 ELSE 0 END
 + least(combos * 10, 20) + least(odd_apps * 5, 15) + least(30, 15 * (CAST(combos > 0 AS INT) + CAST(is_p2p AS INT)))) AS score FROM aj)"""


@check("I22_app_score", f"WITH {feat()}, {_ASC} SELECT *, {LV} AS level FROM ascore")
def _(v):
    return ipdr.app_score(S(v))


RISK_SQL = f"""{feat()}, {_ESC}, {_DSC}, {_SSC}, {_ASC},
comp AS (SELECT subject, e.score AS es, d.score AS ds, s.score AS ss, a.score AS sa, e.encrypted_pct, e.odd_encrypted, d.large_uploads, d.ratio, s.marathons, s.pairs,
 a.high_risk_apps, a.unknown_ports FROM escore e JOIN dscore d USING (subject) JOIN sscore s USING (subject) JOIN ascore a USING (subject)),
rk AS (SELECT *, CAST(floor(es * CAST(0.3 AS DOUBLE) + ds * CAST(0.25 AS DOUBLE) + ss * CAST(0.25 AS DOUBLE) + sa * CAST(0.2 AS DOUBLE)) AS INT) AS weighted,
 es >= 70 AND ds >= 70 AS sharing, ss >= 70 AND sa >= 70 AS opsec, CAST(es >= 40 AS INT) + CAST(ds >= 40 AS INT) + CAST(ss >= 40 AS INT) + CAST(sa >= 40 AS INT) >= 3 AS many FROM comp),
rm AS (SELECT *, CAST(CASE WHEN sharing THEN 1.3 ELSE 1.0 END AS DOUBLE) * CAST(CASE WHEN opsec THEN 1.2 ELSE 1.0 END AS DOUBLE) * CAST(CASE WHEN many THEN 1.25 ELSE 1.0 END AS DOUBLE) AS mult FROM rk),
risk AS (SELECT *, CAST(least(100, floor(weighted * mult)) AS INT) AS score FROM rm),
riskl AS (SELECT *, CASE WHEN score >= 70 THEN 'CRITICAL' WHEN score >= 40 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM risk)"""


def lv(c):
    return f"CASE WHEN {c} >= 70 THEN 'HIGH' WHEN {c} >= 40 THEN 'MEDIUM' ELSE 'LOW' END"


@check("I23_ipdr_risk", f"""WITH {RISK_SQL} SELECT subject, es AS encryption_score, ds AS data_score, ss AS session_score, sa AS app_score, {lv('es')} AS encryption_level,
 {lv('ds')} AS data_level, {lv('ss')} AS session_level, {lv('sa')} AS app_level, weighted, round(mult, 4) AS multiplier,
 concat_ws('|', CASE WHEN sharing THEN 'ENCRYPTION_AND_UPLOADS' END, CASE WHEN opsec THEN 'SESSIONS_AND_APPS' END, CASE WHEN many THEN 'SEVERAL_COMPONENTS' END) AS reasons,
 score, level FROM riskl""")
def _(v):
    return ipdr.ipdr_risk(S(v))


@check("I24_ipdr_risk_factors", f"""WITH {RISK_SQL} SELECT subject, score,
 concat_ws('|', CASE WHEN encrypted_pct > 60 THEN 'ENCRYPTED_SHARE' END, CASE WHEN odd_encrypted > 20 THEN 'ODD_HOUR_ENCRYPTED' END) AS encryption_factors,
 concat_ws('|', CASE WHEN large_uploads > 5 THEN 'LARGE_UPLOADS' END, CASE WHEN ratio > 2 THEN 'UPLOAD_RATIO' END) AS data_factors,
 concat_ws('|', CASE WHEN marathons > 5 THEN 'MARATHONS' END, CASE WHEN pairs > 5 THEN 'CONCURRENT' END) AS session_factors,
 concat_ws('|', CASE WHEN high_risk_apps > 0 THEN 'HIGH_RISK_APPS' END, CASE WHEN unknown_ports > 10 THEN 'UNKNOWN_APPS' END) AS app_factors,
 array_to_string(list_filter([CASE WHEN level = 'CRITICAL' THEN 'REVIEW_FIRST' END, CASE WHEN level = 'CRITICAL' THEN 'REVIEW_BY_SECOND_PERSON' END,
  CASE WHEN es >= 70 THEN 'CHECK_ENCRYPTION' END, CASE WHEN ds >= 70 THEN 'CHECK_UPLOADS' END, CASE WHEN ss >= 70 THEN 'CHECK_LONG_SESSIONS' END,
  CASE WHEN sa >= 70 THEN 'CHECK_APPS' END, CASE WHEN sharing THEN 'COMPARE_UPLOAD_TIMES' END, CASE WHEN opsec THEN 'COMPARE_SESSIONS_AND_APPS' END],
  lambda x: x IS NOT NULL)[1:5], '|') AS notes FROM riskl""")
def _(v):
    return ipdr.ipdr_risk_factors(S(v))


@check("I25_ipdr_overview", f"""WITH {RISK_SQL}
SELECT 'app_sessions' AS section, app AS item, CAST(sum(sessions) AS DOUBLE) AS value FROM au GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'unknown_port_sessions', CAST(destination_port AS VARCHAR), CAST(sum(sessions) AS DOUBLE) FROM upt GROUP BY destination_port ORDER BY 3 DESC, destination_port LIMIT 5)
UNION ALL SELECT 'component_mean', unnest(['encryption', 'data', 'session', 'app']), round(unnest([avg(es), avg(ds), avg(ss), avg(sa)]), 4) FROM risk
UNION ALL SELECT 'component_high', unnest(['encryption', 'data', 'session', 'app']), CAST(unnest([count(*) FILTER (es >= 70), count(*) FILTER (ds >= 70),
  count(*) FILTER (ss >= 70), count(*) FILTER (sa >= 70)]) AS DOUBLE) FROM risk
UNION ALL SELECT 'co_spiking_subjects', 'all', CAST(count(DISTINCT subject) AS DOUBLE) FROM es HAVING count(DISTINCT subject) > 2
UNION ALL SELECT 'upload_spikes', CAST(day AS VARCHAR), CAST(count(*) AS DOUBLE) FROM usp GROUP BY day
UNION ALL SELECT 'up_down_ratio', 'all', round(sum(data_volume_up) / sum(data_volume_down), 4) FROM f
UNION ALL SELECT * FROM (SELECT 'longest_hours', subject || '/' || event_id, round(dur / 3600, 4) FROM f WHERE dur > 7200 ORDER BY dur DESC, subject, event_id LIMIT 5)""")
def _(v):
    return ipdr.ipdr_overview(S(v))
