"""Call records: devices, time of day, communication, behaviour."""

from tallymast.operators import cdr

from . import check

HAV = "2 * 6371.0 * atan2(sqrt({h}), sqrt(1.0 - {h}))"


def km(a, b, c, d):
    """Great-circle distance in plain SQL."""
    h = (f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c}))"
         f" * pow(sin((radians({d}) - radians({b})) / 2), 2))")
    return HAV.format(h=h)


@check("D1_device_profile", """
SELECT subject, string_agg(DISTINCT imei, '|' ORDER BY imei) AS imeis, string_agg(DISTINCT imsi, '|' ORDER BY imsi) AS imsis,
  count(DISTINCT imei) AS imei_count, count(DISTINCT imsi) AS imsi_count,
  count(DISTINCT imei) >= 3 AS device_switching, count(DISTINCT imsi) > 1 AS sim_swap,
  CASE WHEN count(DISTINCT imei) >= 3 THEN 'HIGH' WHEN count(DISTINCT imei) = 2 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM calls GROUP BY subject""")
def _(v):
    return cdr.device_profile(v.cdr)


@check("D2_device_changes", """
WITH s AS (SELECT subject, us, event_id, imei, lag(imei) OVER (PARTITION BY subject ORDER BY us, event_id) AS from_imei
           FROM calls WHERE imei IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY us, event_id) AS change_no FROM s WHERE from_imei <> imei)
SELECT subject, change_no, us AS datetime, from_imei, imei AS to_imei FROM r WHERE change_no <= 10""")
def _(v):
    return cdr.device_changes(v.cdr)


@check("T1_odd_hours", """
SELECT subject, count(*) AS total, count(*) FILTER (hour(datetime) < 5) AS odd_calls,
  round(count(*) FILTER (hour(datetime) < 5) * 100.0 / count(*), 4) AS odd_pct,
  CASE WHEN count(*) FILTER (hour(datetime) < 5) * 100.0 / count(*) > 25 THEN 'HIGH'
       WHEN count(*) FILTER (hour(datetime) < 5) * 100.0 / count(*) > 18 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM calls GROUP BY subject""")
def _(v):
    return cdr.odd_hours(v.cdr, high=25, medium=18)


@check("T2_pattern_days", """
WITH d AS (SELECT subject, count(*) AS total, count(*) FILTER (dayname(datetime) = 'Tuesday') AS tuesday_calls,
  count(*) FILTER (dayname(datetime) = 'Friday') AS friday_calls FROM calls GROUP BY subject)
SELECT *, round(tuesday_calls * 100.0 / total, 4) AS tuesday_pct, round(friday_calls * 100.0 / total, 4) AS friday_pct,
  round((tuesday_calls + friday_calls) * 100.0 / total, 4) AS pattern_pct,
  CASE WHEN (tuesday_calls + friday_calls) * 100.0 / total > 40 THEN 'HIGH'
       WHEN (tuesday_calls + friday_calls) * 100.0 / total > 25 THEN 'MEDIUM' ELSE 'LOW' END AS concentration
FROM d""")
def _(v):
    return cdr.pattern_days(v.cdr)


@check("T3_hourly_profile", """
WITH h AS (SELECT subject, hour(datetime) AS hour, count(*) AS calls FROM calls GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY subject ORDER BY calls DESC, hour) AS peak_rank FROM h""")
def _(v):
    return cdr.hourly_profile(v.cdr)


_CAND = """cand AS (SELECT * FROM (SELECT subject, us, event_id,
  count(*) OVER (PARTITION BY subject ORDER BY us RANGE BETWEEN CURRENT ROW AND 900000000 FOLLOWING) AS calls,
  row_number() OVER (PARTITION BY subject ORDER BY us, event_id) AS rn FROM calls_dense) WHERE calls >= 5)"""


@check("T4_burst_candidates", f"WITH {_CAND} SELECT subject, us AS datetime, event_id, calls FROM cand")
def _(v):
    return cdr.burst_candidates(v.cdr_dense)


_CONTACTS = """, named AS (SELECT p.subject, p.us, p.calls, c.b_party, min(c.us) AS seen FROM picks p
  JOIN calls_dense c ON c.subject = p.subject AND c.us BETWEEN p.us AND p.us + 900000000 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject, us ORDER BY seen, b_party) AS n FROM named)
SELECT subject, us AS start, max(calls) AS calls, count(*) AS unique_contacts,
  string_agg(b_party, '|' ORDER BY n) FILTER (n <= 5) AS contacts, count(*) = 1 AS suspicious
FROM ranked GROUP BY subject, us"""


@check("T4_call_bursts", f"""
WITH RECURSIVE {_CAND}, picks AS (
  SELECT c.subject, c.us, c.calls, 1 AS n FROM cand c
  WHERE c.us = (SELECT min(us) FROM cand x WHERE x.subject = c.subject)
  UNION ALL
  SELECT c.subject, c.us, c.calls, p.n + 1 FROM picks p JOIN cand c ON c.subject = p.subject AND p.n < 10
    AND c.us = (SELECT min(us) FROM cand x WHERE x.subject = p.subject AND x.us >= p.us + 300000000))
{_CONTACTS}""")
def _(v):
    return cdr.call_bursts(v.cdr_dense)


@check("T5_call_bursts_skip", f"""
WITH RECURSIVE {_CAND}, picks AS (
  SELECT c.subject, c.us, c.calls, c.rn, 1 AS n FROM cand c
  WHERE c.rn = (SELECT min(rn) FROM cand x WHERE x.subject = c.subject)
  UNION ALL
  SELECT c.subject, c.us, c.calls, c.rn, p.n + 1 FROM picks p JOIN cand c ON c.subject = p.subject AND p.n < 5
    AND c.rn = (SELECT min(rn) FROM cand x WHERE x.subject = p.subject AND x.rn >= p.rn + p.calls))
{_CONTACTS}""")
def _(v):
    return cdr.call_bursts(v.cdr_dense, mode="skip")


@check("T6_silent_periods", """
WITH g AS (SELECT subject, us, lead(us) OVER (PARTITION BY subject ORDER BY us, event_id) AS nx FROM calls),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY us) AS n FROM g WHERE nx - us > 48 * 3600000000)
SELECT subject, us AS silent_from, nx AS silent_to, round((nx - us) / 3600e6, 4) AS gap_hours,
  CASE WHEN nx - us > 72 * 3600000000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM r WHERE n <= 5""")
def _(v):
    return cdr.silent_periods(v.cdr)


_SPLIT = """SELECT subject, count(*) AS total, count(*) FILTER (call_type LIKE 'CALL%') AS voice_calls,
  count(*) FILTER (call_type LIKE 'SMS%') AS sms, count(*) FILTER (call_type = 'CALL-IN') AS call_in,
  count(*) FILTER (call_type = 'CALL-OUT') AS call_out, count(*) FILTER (call_type = 'SMS-IN') AS sms_in,
  count(*) FILTER (call_type = 'SMS-OUT') AS sms_out,
  avg(duration_seconds) FILTER (call_type LIKE 'CALL%') AS avg_voice_seconds FROM calls GROUP BY subject"""


@check("C1_voice_sms_profile", f"""
WITH s AS ({_SPLIT})
SELECT * REPLACE (round(avg_voice_seconds, 4) AS avg_voice_seconds), round(voice_calls * 100.0 / (voice_calls + sms), 4) AS voice_pct,
  round(sms * 100.0 / (voice_calls + sms), 4) AS sms_pct, sms = 0 AND voice_calls > 10 AS voice_only,
  CASE WHEN sms = 0 AND voice_calls > 10 THEN 'HIGH' WHEN voice_calls * 100.0 / (voice_calls + sms) > 90 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM s""")
def _(v):
    return cdr.voice_sms_profile(v.cdr, min_voice=10)


_REPEAT = """SELECT subject, duration_seconds, count(*) AS times FROM calls WHERE call_type LIKE 'CALL%' GROUP BY ALL"""


@check("C2_repeated_durations", f"""
WITH d AS ({_REPEAT} HAVING count(*) > 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY times DESC, duration_seconds) AS rank FROM d) WHERE rank <= 5""")
def _(v):
    return cdr.repeated_durations(v.cdr)


_PER = "per AS (SELECT subject, b_party, count(*) AS calls FROM calls GROUP BY ALL)"


@check("C3_contact_frequency", f"""
WITH {_PER}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY calls DESC, b_party) AS n FROM per)
SELECT subject, count(*) AS contacts, max(calls) AS max_calls, round(avg(calls), 4) AS mean_calls,
  count(*) FILTER (calls > 20) AS high_frequency_contacts, count(*) FILTER (calls = 1) AS single_call_contacts,
  string_agg(b_party, '|' ORDER BY n) FILTER (n <= 10) AS top_contacts FROM r GROUP BY subject""")
def _(v):
    return cdr.contact_frequency(v.cdr)


@check("C4_top_contacts", f"""
WITH {_PER}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY calls DESC, b_party) AS rank,
  sum(calls) OVER (PARTITION BY subject) AS total FROM per)
SELECT subject, rank, right(b_party, 4) AS contact, calls, round(calls * 100.0 / total, 4) AS share_pct,
  rank = 1 AND calls * 100.0 / total > 30 AS dominant FROM r WHERE rank <= 5""")
def _(v):
    return cdr.top_contacts(v.cdr)


_CYCLES = """e AS (SELECT src, dst FROM call_links),
p(path, anchor, tail, n) AS (
  SELECT [src, dst], src, dst, 2 FROM e WHERE src < dst
  UNION ALL
  SELECT list_append(p.path, e.dst), p.anchor, e.dst, p.n + 1 FROM p JOIN e ON e.src = p.tail
  WHERE p.n < 5 AND e.dst > p.anchor AND NOT list_contains(p.path, e.dst)),
cyc AS (SELECT list_sort(p.path) AS m, min(p.path) AS path FROM p JOIN e ON e.src = p.tail AND e.dst = p.anchor WHERE p.n >= 3 GROUP BY 1)"""


@check("C5_call_cycles", f"""
WITH RECURSIVE {_CYCLES}
SELECT array_to_string(m, '|') AS members, array_to_string(path, '|') AS path, len(path) AS length FROM cyc""")
def _(v):
    return cdr.call_cycles(v.call_links)


_RING = """short AS (SELECT subject, us, event_id, b_party,
    lead(us) OVER (PARTITION BY subject ORDER BY us, event_id) - us AS gap
  FROM calls_dense WHERE call_type LIKE 'CALL%' AND coalesce(duration_seconds, 0) <= 3),
per AS (SELECT subject, b_party, count(*) AS n, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, b_party) AS k
  FROM short GROUP BY subject, b_party),
sig AS (SELECT subject, count(*) FILTER (n >= 3) AS s FROM per WHERE k <= 5 GROUP BY subject),
agg AS (SELECT subject, count(*) AS one_rings, count(*) FILTER (gap < 300000000) AS rapid_pairs FROM short GROUP BY subject),
tot AS (SELECT subject, count(*) AS total FROM calls_dense GROUP BY subject),
ring AS (SELECT subject, total, coalesce(one_rings, 0) AS one_rings, round(coalesce(one_rings, 0) * 100.0 / total, 4) AS one_ring_pct,
  coalesce(s, 0) AS signal_contacts, coalesce(rapid_pairs, 0) AS rapid_pairs, coalesce(s, 0) > 0 AS signalling
FROM tot LEFT JOIN agg USING (subject) LEFT JOIN sig USING (subject))"""


@check("C6_one_ring", f"WITH {_RING} SELECT * FROM ring")
def _(v):
    return cdr.one_ring(v.cdr_dense)


@check("C7_communication_profile", f"""
WITH RECURSIVE {_CYCLES}, {_RING}, s AS ({_SPLIT.replace('FROM calls', 'FROM calls_dense')}),
rep AS (SELECT subject, least(count(*), 3) AS repeated FROM ({_REPEAT.replace('FROM calls', 'FROM calls_dense')} HAVING count(*) > 5) GROUP BY 1),
pr AS (SELECT subject, b_party, count(*) AS n FROM calls_dense GROUP BY ALL),
dom AS (SELECT DISTINCT pr.subject, true AS d FROM pr JOIN tot USING (subject) WHERE n * 100.0 / total > 30),
lp AS (SELECT subject, count(*) AS cycles FROM (SELECT unnest(m) AS subject FROM cyc) GROUP BY 1),
j AS (SELECT s.subject, s.total, s.voice_calls, s.sms, s.voice_calls * 100.0 / (s.voice_calls + s.sms) AS vp,
  s.sms = 0 AND s.voice_calls > 10 AS voice_only, coalesce(repeated, 0) AS repeated_durations,
  coalesce(d, false) AS dominant_contact, ring.signalling, coalesce(lp.cycles, 0) AS cycles
  FROM s LEFT JOIN rep USING (subject) LEFT JOIN dom USING (subject) LEFT JOIN lp USING (subject) LEFT JOIN ring USING (subject))
SELECT subject, total, voice_calls, sms, round(vp, 4) AS voice_pct, voice_only, repeated_durations, dominant_contact, signalling, cycles,
  CASE WHEN voice_only OR cycles > 0 THEN 'HIGH' WHEN vp > 90 OR dominant_contact OR signalling THEN 'MEDIUM' ELSE 'LOW' END AS level FROM j""")
def _(v):
    return cdr.communication_profile(v.cdr_dense, cycles=cdr.call_cycles(v.call_links))


@check("C7_communication_full", f"""
WITH rep AS (SELECT subject, count(*) AS n FROM ({_REPEAT.replace('FROM calls', 'FROM calls_dense')} HAVING count(*) > 5) GROUP BY 1)
SELECT subject, coalesce(n, 0) AS all_repeated_durations, least(coalesce(n, 0), 3) AS repeated_durations
FROM (SELECT DISTINCT subject FROM calls_dense) LEFT JOIN rep USING (subject)""")
def _(v):
    profile = cdr.communication_profile(v.cdr_dense, cycles=cdr.call_cycles(v.call_links), full=True)
    return profile.select("subject", "all_repeated_durations", "repeated_durations")


@check("B1_daily_activity", """
WITH d AS (SELECT subject, CAST(datetime AS DATE) AS day, count(*) AS calls FROM calls GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY day DESC) AS n FROM d),
a AS (SELECT subject, count(*) AS active_days, avg(calls) AS m, max(calls) AS max_daily, min(calls) AS min_daily,
  stddev_samp(calls) AS sd, avg(calls) FILTER (n <= 7) AS rm FROM r GROUP BY subject)
SELECT subject, active_days, round(m, 4) AS mean_daily, max_daily, min_daily, round(sd, 4) AS sd_daily, round(rm, 4) AS recent_mean,
  CASE WHEN active_days > 7 AND rm > m * 2 THEN 'SPIKE' WHEN active_days > 7 AND rm < m * 0.5 THEN 'DROP' ELSE 'NONE' END AS change
FROM a""")
def _(v):
    return cdr.daily_activity(v.cdr)


@check("B2_weekend_split", """
SELECT subject, count(*) FILTER (dayofweek(datetime) IN (0, 6)) AS weekend_calls,
  count(*) FILTER (dayofweek(datetime) NOT IN (0, 6)) AS weekday_calls,
  round(count(*) FILTER (dayofweek(datetime) IN (0, 6)) * 100.0 / count(*), 4) AS weekend_pct FROM calls GROUP BY subject""")
def _(v):
    return cdr.weekend_split(v.cdr)


PATTERNS = """
base AS (SELECT subject, count(DISTINCT imei) AS imei_count, count(DISTINCT imsi) AS imsi_count, count(*) AS total,
  count(*) FILTER (hour(datetime) < 5) * 100.0 / count(*) AS odd_pct,
  count(*) FILTER (dayname(datetime) IN ('Tuesday', 'Friday')) * 100.0 / count(*) AS pattern_pct,
  count(*) FILTER (call_type LIKE 'CALL%') * 100.0 / count(*) AS voice_pct,
  count(*) FILTER (call_type LIKE 'SMS%') = 0 AS voice_only,
  count(DISTINCT first_cell) AS tower_count, bool_or(first_cell <> last_cell) AS tower_hopping,
  count(*) FILTER (dayofweek(datetime) IN (0, 6)) * 100.0 / count(*) AS weekend_pct FROM calls GROUP BY subject),
bc AS (SELECT * FROM (SELECT subject, us, event_id, count(*) OVER (PARTITION BY subject ORDER BY us RANGE BETWEEN CURRENT ROW
  AND 900000000 FOLLOWING) AS n FROM calls) WHERE n >= 5),
bp AS (SELECT b.subject, b.us, 1 AS n FROM bc b WHERE b.us = (SELECT min(us) FROM bc x WHERE x.subject = b.subject)
  UNION ALL SELECT b.subject, b.us, p.n + 1 FROM bp p JOIN bc b ON b.subject = p.subject AND p.n < 10
   AND b.us = (SELECT min(us) FROM bc x WHERE x.subject = p.subject AND x.us >= p.us + 300000000)),
bu AS (SELECT subject, count(*) AS bursts FROM bp GROUP BY 1),
rd AS (SELECT subject, least(count(*), 5) AS repeated_durations FROM (SELECT subject, duration_seconds, count(*) AS t FROM calls
  WHERE call_type LIKE 'CALL%' GROUP BY ALL HAVING count(*) > 3) GROUP BY 1),
cf AS (SELECT subject, count(*) AS contacts, count(*) FILTER (c > 20) AS high_frequency_contacts, count(*) FILTER (c = 1) AS single_call_contacts
  FROM (SELECT subject, b_party, count(*) AS c FROM calls GROUP BY ALL) GROUP BY 1),
rc AS (SELECT subject, least(count(*), 10) AS rapid_changes FROM (SELECT subject, us, first_cell,
   lag(coalesce(last_cell, first_cell)) OVER w AS f, lag(us) OVER w AS pu FROM calls WINDOW w AS (PARTITION BY subject ORDER BY us, event_id))
  WHERE us - pu <= 300000000 AND f <> first_cell GROUP BY 1),
dd AS (SELECT subject, CAST(datetime AS DATE) AS day, count(*) AS c FROM calls GROUP BY ALL),
dr AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY day DESC) AS n FROM dd),
da AS (SELECT subject, count(*) AS active_days, avg(c) AS m, avg(c) FILTER (n <= 7) AS rm FROM dr GROUP BY 1),
patterns AS (SELECT base.*, coalesce(bursts, 0) AS bursts, coalesce(repeated_durations, 0) AS repeated_durations, contacts,
  high_frequency_contacts, single_call_contacts, coalesce(rapid_changes, 0) AS rapid_changes, active_days,
  CASE WHEN active_days > 7 AND rm > m * 2 THEN 'SPIKE' WHEN active_days > 7 AND rm < m * 0.5 THEN 'DROP' ELSE 'NONE' END AS activity_change
  FROM base LEFT JOIN bu USING (subject) LEFT JOIN rd USING (subject) LEFT JOIN cf USING (subject) LEFT JOIN rc USING (subject)
  LEFT JOIN da USING (subject))"""


@check("B3_cdr_patterns", f"""
WITH RECURSIVE {PATTERNS}
SELECT subject, imei_count, imsi_count, imei_count >= 3 AS device_switching, imsi_count > 1 AS sim_swap, total,
  round(odd_pct, 4) AS odd_pct, round(pattern_pct, 4) AS pattern_pct, bursts, round(voice_pct, 4) AS voice_pct, voice_only, repeated_durations,
  contacts, high_frequency_contacts, single_call_contacts, tower_count, tower_hopping, rapid_changes, active_days, activity_change,
  round(weekend_pct, 4) AS weekend_pct FROM patterns""")
def _(v):
    return cdr.cdr_patterns(v.cdr)


_FULL = PATTERNS.replace(" AND p.n < 10", "").replace("least(count(*), 5)", "count(*)").replace("least(count(*), 10)", "count(*)")


@check("B3_cdr_patterns_full", f"""
WITH RECURSIVE {_FULL}
SELECT subject, total, least(bursts, 10) AS bursts, least(repeated_durations, 5) AS repeated_durations, least(rapid_changes, 10) AS rapid_changes,
  bursts AS all_bursts, repeated_durations AS all_repeated_durations, rapid_changes AS all_rapid_changes FROM patterns""")
def _(v):
    counts = ("bursts", "repeated_durations", "rapid_changes")
    return cdr.cdr_patterns(v.cdr, full=True).select("subject", "total", *counts, *(f"all_{c}" for c in counts))
