"""Sources, normalization, validation and summaries."""

from pyspark.sql import functions as F

from tallymast import normalize
from tallymast.functions import geo, scalar as S
from tallymast.operators import quality, summaries
from tallymast.sources import consolidate

from . import check
from .cdr import km
from .ipdr import APP

PROV = "(upper(trim({c})) SIMILAR TO '.*(AA-AIRTEL|JZ-REGINF|VM-|AD-|AX-|BW-|TM-|VK-|VF-|IM-|ID-|BP-|BZ-|AW-).*' OR regexp_matches(upper(trim({c})), '^[A-Z][A-Z]-'))"


def prov(c):
    return "coalesce(" + PROV.format(c=c) + ", false)"


def phone(c):
    return f"coalesce(CASE WHEN {prov(c)} THEN trim({c}) ELSE regexp_replace(trim({c}), '[^0-9]', '', 'g') END, '')"


MS = "regexp_replace(trim({c}), '[^0-9]', '', 'g')"


def msisdn(c):
    d = MS.format(c=c)
    return f"CASE WHEN length({d}) = 12 AND {d} LIKE '91%' THEN substr({d}, 3) WHEN length({d}) = 10 THEN {d} END"


# -- sources -----------------------------------------------------------------------------

@check("S4_deduplicate", """
WITH a AS (SELECT event_id, mobile_number, us - us % 60000000 AS m, tower_id, 'f1' AS source_file FROM tower_dump
  UNION ALL SELECT event_id + 1, mobile_number, us - us % 60000000, tower_id, 'f0' FROM tower_dump),
r AS (SELECT *, row_number() OVER (PARTITION BY m, mobile_number, tower_id ORDER BY source_file, event_id) AS n FROM a)
SELECT event_id, mobile_number, m AS timestamp, tower_id, source_file FROM r WHERE n = 1""")
def _(v):
    a = v.tower_dump.select("event_id", "mobile_number", S.bin_start("timestamp", 60).alias("timestamp"), "tower_id", F.lit("f1").alias("source_file"))
    b = a.withColumns({"event_id": F.col("event_id") + 1, "source_file": F.lit("f0")})
    return normalize.deduplicate(a.unionByName(b))


@check("S6_subject_from_file", """
WITH f AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN a_party || '_Name_' || event_id % 7 WHEN 1 THEN 'plain' || event_id % 5 ELSE a_party || '_' END AS stem FROM cdr)
SELECT event_id, CASE WHEN contains(stem, '_') THEN substr(stem, strpos(stem, '_') + 1) || '_' || split_part(stem, '_', 1) ELSE stem END AS subject FROM f""")
def _(v):
    stem = F.when(F.expr("event_id % 3 = 0"), F.expr("concat(a_party, '_Name_', event_id % 7)")).when(
        F.expr("event_id % 3 = 1"), F.expr("concat('plain', event_id % 5)")).otherwise(F.expr("concat(a_party, '_')"))
    df = v.cdr.select("event_id", F.concat(F.lit("file:/data/in/"), stem, F.lit(".csv")).alias("source_file"))
    return normalize.with_subject(df).select("event_id", "subject")


@check("S9_consolidate", """
SELECT subject, count(*) AS records FROM (SELECT 'a' AS subject FROM cdr UNION ALL SELECT 'b' FROM cdr_dense) GROUP BY 1""")
def _(v):
    out = consolidate({"a": v.cdr.drop("subject"), "b": v.cdr_dense.drop("subject", "lat")})
    return out.groupBy("subject").agg(F.count(F.lit(1)).alias("records"))


# -- projections and filters -------------------------------------------------------------

@check("P1_normalize_cdr", f"""
SELECT event_id, {phone('a_party')} AS a_party, {phone('b_party')} AS b_party, {prov('b_party')} AS is_provider_message,
  CASE WHEN date NOT LIKE 'not%' AND time <> '99' THEN us - us % 1000000 END AS datetime,
  CAST(coalesce(TRY_CAST(duration AS DOUBLE), 0) AS BIGINT) AS duration_seconds, lat IS NOT NULL AND lon IS NOT NULL AS has_location
FROM cdr_raw""")
def _(v):
    raw = normalize.rename(v.cdr_raw.withColumnsRenamed({"a_party": "A PARTY", "first_cell": "FIRST CELL ID A", "lat": "LATITUDE", "lon": "LONGITUDE"}),
                           {**{c: [c, h] for c, h in __import__("tallymast.tables", fromlist=["x"]).CDR_COLUMNS.items()}, "event_id": ["event_id"]})
    return normalize.normalize_cdr(raw).select("event_id", "a_party", "b_party", "is_provider_message", "datetime", "duration_seconds", "has_location")


@check("P2_cdr_timestamp", """
SELECT event_id, CASE WHEN date NOT LIKE 'not%' AND time <> '99' THEN us - us % 1000000 END AS ts FROM cdr_raw""")
def _(v):
    return v.cdr_raw.select("event_id", S.cdr_timestamp("date", "time").alias("ts"))


@check("P3_tower_timestamp", """
SELECT event_id, us - us % 1000000 AS ts, us - us % 1000000 AS serial_ts FROM tower_raw""")
def _(v):
    t = F.col("timestamp")
    text = (F.when(F.expr("event_id % 6 = 0"), F.date_format(t, "yyyy-MM-dd HH:mm:ss")).when(F.expr("event_id % 6 = 1"), F.date_format(t, "dd-MM-yyyy HH:mm:ss"))
            .when(F.expr("event_id % 6 = 2"), F.date_format(t, "dd/MM/yyyy HH:mm:ss")).when(F.expr("event_id % 6 = 3"), F.date_format(t, "yyyy/MM/dd HH:mm:ss"))
            .when(F.expr("event_id % 6 = 4"), F.date_format(t, "dd-MM-yyyy hh:mm:ss a")).otherwise(F.date_format(t, "dd/MM/yyyy hh:mm:ss a")))
    serial = F.datediff(t, F.lit("1899-12-30").cast("date")).cast("string")
    df = v.tower_raw.select("event_id", text.alias("a"), serial.alias("d"), F.date_format(t, "HH:mm:ss").alias("c"))
    return df.select("event_id", S.tower_timestamp("a").alias("ts"), S.tower_date_time("d", "c").alias("serial_ts"))


@check("P4_clean_phone", f"SELECT event_id, {phone('a_party')} AS a, {phone('b_party')} AS b FROM cdr_raw")
def _(v):
    return v.cdr_raw.select("event_id", S.clean_phone("a_party").alias("a"), S.clean_phone("b_party").alias("b"))


@check("P5_is_provider", f"SELECT event_id, {prov('b_party')} AS provider FROM cdr_raw")
def _(v):
    return v.cdr_raw.select("event_id", S.is_provider("b_party").alias("provider"))


@check("P6_clean_tower", f"""
WITH c AS (SELECT event_id, {msisdn('mobile_number')} AS mobile_number, CASE WHEN length(imei) = 15 THEN imei END AS imei,
  CASE WHEN length(imsi) = 15 THEN imsi END AS imsi, trim(tower_id) AS tower_id, round(lat, 4) AS lat, round(long, 4) AS long FROM tower_raw)
SELECT * FROM c WHERE mobile_number IS NOT NULL""")
def _(v):
    return normalize.clean_tower(v.tower_raw).select("event_id", "mobile_number", "imei", "imsi", "tower_id", "lat", "long")


@check("P7_clean_subscriber", "SELECT event_id, trim(replace(subscriber_id, '+91', '')) AS id FROM ipdr_raw")
def _(v):
    return v.ipdr_raw.select("event_id", S.clean_subscriber("subscriber_id").alias("id"))


@check("P8_calendar", """
SELECT event_id, hour(datetime) AS hour, dayname(datetime) AS day_of_week, CAST(CAST(datetime AS DATE) AS VARCHAR) AS date, hour(datetime) < 5 AS is_odd_hour,
  dayofweek(datetime) IN (0, 6) AS is_weekend FROM cdr""")
def _(v):
    return S.with_calendar(v.cdr.select("event_id", "datetime"), "datetime").drop("datetime")


@check("P9_connection_type", """
SELECT event_id, CASE WHEN duration <= 0 THEN NULL WHEN duration <= 10 THEN 'brief' WHEN duration <= 60 THEN 'short' WHEN duration <= 300 THEN 'normal'
  WHEN duration > 300 THEN 'long' END AS kind FROM tower_dump""")
def _(v):
    return v.tower_dump.select("event_id", S.connection_type("duration").alias("kind"))


@check("P10_session_metrics", """
SELECT event_id, round((CASE WHEN event_id % 31 = 0 THEN us - 60000000 ELSE end_us END - us) / 1e6, 4) AS session_duration, data_volume_up + data_volume_down AS total_data_volume FROM ipdr_raw""")
def _(v):
    from tallymast.operators.ipdr import with_session_metrics

    return with_session_metrics(v.ipdr_raw).select("event_id", "session_duration", "total_data_volume")


@check("P11_fingerprint_app", f"SELECT event_id, {APP} AS app FROM ipdr_raw")
def _(v):
    return v.ipdr_raw.select("event_id", S.fingerprint_app("destination_port", "protocol").alias("app"))


@check("P12_app_risk", f"""
WITH a AS (SELECT event_id, {APP} AS app FROM ipdr_raw)
SELECT event_id, CASE WHEN app IN ('whatsapp', 'telegram', 'signal', 'threema', 'vpn') THEN 'HIGH' WHEN app IN ('banking', 'video_call') THEN 'MEDIUM'
  WHEN app = 'tor' THEN 'CRITICAL' ELSE 'LOW' END AS risk, coalesce(app IN ('whatsapp', 'telegram', 'signal', 'threema'), false) AS encrypted FROM a""")
def _(v):
    df = v.ipdr_raw.select("event_id", S.fingerprint_app("destination_port", "protocol").alias("app"))
    return df.select("event_id", S.app_risk("app").alias("risk"), S.is_encrypted("app").alias("encrypted"))


@check("P13_port_service", """
SELECT event_id, CASE destination_port WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 8443 THEN 'HTTPS-Alt' WHEN 1194 THEN 'OpenVPN' WHEN 9001 THEN 'Tor'
  ELSE 'Unknown' END AS service FROM ipdr_raw""")
def _(v):
    return v.ipdr_raw.select("event_id", S.port_service("destination_port").alias("service"))


@check("P14_haversine_km", f"SELECT event_id, round({km('lat', 'lon', '17.1', '82.05')}, 4) AS km FROM cdr")
def _(v):
    return v.cdr.select("event_id", geo.haversine_km("lat", "lon", F.lit(17.1), F.lit(82.05)).alias("km"))


@check("P16_movement_class", """
SELECT event_id, CASE WHEN k < 1 THEN 'stationary' WHEN k < 5 THEN 'walking' WHEN k < 25 THEN 'bicycle' WHEN k < 200 THEN 'vehicle' WHEN k > 500 THEN 'impossible'
  ELSE 'vehicle' END AS kind FROM (SELECT event_id, duration_seconds * event_id % 700 / 1.0 AS k FROM cdr)""")
def _(v):
    return v.cdr.select("event_id", S.movement_class(F.expr("CAST(duration_seconds * event_id % 700 AS DOUBLE)")).alias("kind"))


@check("P17_filter_window", """
SELECT event_id FROM tower_dump WHERE us BETWEEN 1704880800000000 - 600000000 AND 1704967200000000 + 600000000""")
def _(v):
    return normalize.filter_window(v.tower_dump, "2024-01-10 10:00:00", "2024-01-11 10:00:00", 10).select("event_id")


@check("P18_filter_location", f"""
SELECT event_id, round({km('lat', 'lon', '17.2', '82.05')}, 4) AS distance_km FROM tower_dump WHERE {km('lat', 'lon', '17.2', '82.05')} <= 9""")
def _(v):
    return normalize.filter_location(v.tower_dump, center=(17.2, 82.05), radius_km=9, lon="lon").select("event_id", "distance_km")


@check("P18_filter_towers", "SELECT event_id FROM tower_dump WHERE tower_id IN ('T1', 'T7')")
def _(v):
    return normalize.filter_location(v.tower_dump, towers=["T1", "T7"]).select("event_id")


@check("P19_mask_last4", "SELECT event_id, right(b_party, 4) AS masked FROM cdr")
def _(v):
    return v.cdr.select("event_id", S.mask_last4("b_party").alias("masked"))


@check("P20_clean_text", r"""
WITH d AS (SELECT doc_id, replace(replace(text, chr(8232), chr(10)), chr(8233), chr(10) || chr(10)) AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '[\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'), '[^\x{00}-\x{FF}]', '?', 'g')) AS digest, length(t) AS chars FROM d""")
def _(v):
    text = S.clean_text("text")
    return v.documents.select("doc_id", F.md5(text).alias("digest"), F.length(text).alias("chars"))


@check("P21_drop_empty", "SELECT event_id, duration, us FROM (SELECT CASE WHEN event_id % 3 = 0 THEN event_id END AS event_id, CASE WHEN event_id % 2 = 0 THEN duration END AS duration, CASE WHEN event_id % 5 = 0 THEN us END AS us FROM tower_dump) WHERE coalesce(event_id, duration, us) IS NOT NULL")
def _(v):
    return normalize.drop_empty(v.tower_dump.selectExpr("CASE WHEN event_id % 3 = 0 THEN event_id END AS event_id", "CASE WHEN event_id % 2 = 0 THEN duration END AS duration", "CASE WHEN event_id % 5 = 0 THEN us END AS us"))


# -- call-record validation --------------------------------------------------------------

_SERV = "regexp_matches(trim(b_party), 'AA-AIRTEL|JZ-REGINF|VM-|AD-|AX-|BW-|TM-|VK-|VF-|IM-|ID-|BP-|BZ-|AW-|^[A-Z][A-Z]-')"
_RULES = [
    ("a_party", "a_party", "regexp_matches(trim(a_party), '^[6-9][0-9]{9}$')", "a_party"),
    ("b_party", "b_party", f"(regexp_matches(trim(b_party), '^[6-9][0-9]{{9}}$') OR {_SERV})", "b_party"),
    ("date", "date", "date NOT LIKE 'not%'", "date"),
    ("time", "time", "regexp_matches(trim(time), '^[0-9]{1,2}:[0-9]{2}:[0-9]{2}')", "time"),
    ("duration", "duration", "TRY_CAST(duration AS DOUBLE) >= 0", "duration"),
    ("call_type", "call_type", "call_type IN ('CALL-IN', 'CALL-OUT', 'SMS-IN', 'SMS-OUT')", "call_type"),
    ("imei", "imei", "regexp_matches(imei, '^[0-9]{15}$')", "imei"),
    ("imsi", "imsi", "regexp_matches(imsi, '^[0-9]{15}$')", "imsi"),
    ("coordinates", "lat", "(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)", None),
]
_FIELDS = " UNION ALL ".join(f"""SELECT '{n}' AS field, count(*) FILTER (coalesce({ok}, false)) AS valid, count({c}) - count(*) FILTER (coalesce({ok}, false)) AS invalid,
 count(*) FILTER (coalesce({ok}, false)) * 100.0 / count({c}) AS p FROM cdr_raw""" for n, c, ok, _ in _RULES)
_SAMPLES = " UNION ALL ".join(f"SELECT '{n}' AS field, event_id, {val} AS value FROM cdr_raw WHERE {c} IS NOT NULL AND NOT coalesce({ok}, false)"
                              for n, c, ok, val in _RULES if val)


_V1 = ["a_party", "b_party", "date", "time", "duration", "call_type", "first_cell", "last_cell", "imei", "address", "lat", "lon", "event_id", "us"]
_V1SQL = " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{'EXTRA' if c in ('event_id', 'us') else 'PRESENT'}' AS status, count({c}) AS filled, round(1200.0 / 13, 4) AS match_pct FROM cdr_raw""" for c in _V1)


@check("V1_cdr_column_report", f"{_V1SQL} UNION ALL SELECT 'imsi', 'MISSING', 0, round(1200.0 / 13, 4)")
def _(v):
    return quality.cdr_column_report(v.cdr_raw.drop("imsi"))


@check("V2_cdr_field_quality", f"""
WITH f AS ({_FIELDS}), s AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY event_id) AS n FROM ({_SAMPLES})),
l AS (SELECT field, string_agg(value, '|' ORDER BY n) AS samples FROM s WHERE n <= 5 GROUP BY 1),
b AS (SELECT count(*) FILTER ({_SERV}) AS service, count(*) FILTER (regexp_matches(trim(b_party), '^[6-9][0-9]{{9}}$')) AS phone FROM cdr_raw)
SELECT field, valid, invalid, round(p, 4) AS valid_pct, CASE WHEN field = 'b_party' THEN phone END AS phone_numbers, CASE WHEN field = 'b_party' THEN service END AS service_codes, samples
FROM f LEFT JOIN l USING (field), b""")
def _(v):
    out = quality.cdr_field_quality(v.cdr_raw)
    return out.withColumn("samples", F.when(F.col("field") != "coordinates", F.col("samples")))


@check("V2_call_type_distribution", "SELECT call_type, count(*) AS records FROM cdr_raw GROUP BY 1")
def _(v):
    return quality.call_type_distribution(v.cdr_raw)


@check("V3_cdr_quality_score", f"SELECT round(avg(p), 4) AS quality_score FROM (SELECT p FROM ({_FIELDS}) UNION ALL SELECT 100.0)")
def _(v):
    return quality.cdr_quality_score(v.cdr_raw)


# -- session validation ------------------------------------------------------------------

_IC = ["event_id", "us", "end_us", "subject", "protocol", "start_time", "end_time", "subscriber_id", "destination_ip", "destination_port", "data_volume_up", "data_volume_down"]
_IREQ = ["subscriber_id", "start_time", "end_time", "destination_ip", "destination_port", "data_volume_up", "data_volume_down"]


def _kind(c):
    return "REQUIRED" if c in _IREQ else "OPTIONAL" if c == "protocol" else "UNEXPECTED"


_COMPL = " UNION ALL ".join(f"SELECT '{c}' AS c, '{_kind(c)}' AS s, count({c}) * 100.0 / count(*) AS p FROM ipdr_raw" for c in _IC)


@check("V4_ipdr_column_report", f"""SELECT c AS "column", s AS status, round(p, 4) AS complete_pct FROM ({_COMPL})""")
def _(v):
    return quality.ipdr_column_report(v.ipdr_raw)


_V5 = [("start_time", "datetime", "timestamp", True), ("end_time", "datetime", "timestamp", True), ("subscriber_id", "string", "string", True),
       ("destination_ip", "string", "string", True), ("destination_port", "numeric", "string", False), ("data_volume_up", "numeric", "bigint", True),
       ("data_volume_down", "numeric", "bigint", True), ("protocol", "string", "string", True)]


@check("V5_ipdr_type_report", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{e}' AS expected, '{a}' AS actual, {ok} AS ok, count({c}) AS filled FROM ipdr_raw""" for c, e, a, ok in _V5))
def _(v):
    return quality.ipdr_type_report(v.ipdr_raw.withColumn("destination_port", F.col("destination_port").cast("string")))


_DUP = """d AS (SELECT subject, protocol, destination_port, epoch_us(start_time) - us % 3600000000 AS start_time,
  epoch_us(end_time) - us % 3600000000 AS end_time FROM ipdr_raw), g AS (SELECT *, count(*) AS n FROM d GROUP BY ALL),
q AS (SELECT sum(n) AS rows, sum(n * (CAST(destination_port IS NOT NULL AS INT) + 4)) * 100.0 / (sum(n) * 5) AS c, sum(n - 1) AS dup, coalesce(sum(n) FILTER (end_time < start_time), 0) AS bad FROM g)"""


@check("V6_ipdr_quality", f"""WITH {_DUP} SELECT CAST(rows AS BIGINT) AS rows, round(c, 4) AS complete_pct, CAST(dup AS BIGINT) AS duplicates, CAST(bad AS BIGINT) AS ends_before_start,
 round(dup * 100.0 / rows, 4) AS duplicate_pct, round((rows - bad) * 100.0 / rows, 4) AS consistent_pct FROM q""")
def _(v):
    cut = lambda c: F.timestamp_micros(F.unix_micros(c) - F.col("us") % 3_600_000_000).alias(c)
    return quality.ipdr_quality(v.ipdr_raw.select("subject", "protocol", "destination_port", cut("start_time"), cut("end_time")))


@check("V7_ipdr_temporal_quality", """
SELECT min(us) AS earliest, max(us) AS latest, (max(us) - min(us)) // 86400000000 AS span_days, count(*) FILTER (us > 1705708800000000) AS future_rows,
 count(*) FILTER (us < 1705708800000000 - 365 * 86400000000) AS old_rows FROM ipdr_raw""")
def _(v):
    return quality.ipdr_temporal_quality(v.ipdr_raw, "2024-01-20 00:00:00")


@check("V8_ipdr_network_quality", """
SELECT count(*) FILTER (destination_port < 1 OR destination_port > 65535) AS bad_ports, count(*) FILTER (NOT regexp_matches(destination_ip, '^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$')) AS bad_ips FROM ipdr_raw""")
def _(v):
    return quality.ipdr_network_quality(v.ipdr_raw)


@check("V8_ipdr_top_ports", "SELECT destination_port, count(*) AS sessions FROM ipdr_raw WHERE destination_port IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(v):
    return quality.ipdr_top_ports(v.ipdr_raw)


_VQ = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < 0) AS negatives, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean,
 round(sum({c}) / 1073741824.0, 4) AS total_gb FROM ipdr_raw""" for c in ("data_volume_up", "data_volume_down"))


@check("V9_ipdr_volume_quality", _VQ)
def _(v):
    return quality.ipdr_volume_quality(v.ipdr_raw)


_REP = f"""rep AS (SELECT 'completeness' AS "check", c AS item, CASE WHEN s = 'UNEXPECTED' THEN 'WARNING' ELSE 'INFO' END AS severity, p AS value FROM ({_COMPL})
UNION ALL SELECT 'quality', unnest(['complete_pct', 'duplicates', 'duplicate_pct', 'ends_before_start']), unnest(['INFO', 'INFO', 'INFO', CASE WHEN bad > 0 THEN 'ERROR' ELSE 'INFO' END]),
 unnest([cp, 0.0, 0.0, bad]) FROM (SELECT avg(p) AS cp FROM ({_COMPL})), (SELECT CAST(count(*) FILTER (end_time < start_time) AS DOUBLE) AS bad FROM ipdr_raw)
UNION ALL SELECT 'time', unnest(['span_days', 'future_rows', 'old_rows']), unnest(['INFO', CASE WHEN fu > 0 THEN 'ERROR' ELSE 'INFO' END, 'INFO']), unnest([sp, fu, 0.0])
 FROM (SELECT CAST((max(us) - min(us)) // 86400000000 AS DOUBLE) AS sp, CAST(count(*) FILTER (us > 1705708800000000) AS DOUBLE) AS fu FROM ipdr_raw)
UNION ALL SELECT 'network', unnest(['bad_ports', 'bad_ips']), unnest([CASE WHEN bp > 0 THEN 'ERROR' ELSE 'INFO' END, CASE WHEN bi > 0 THEN 'WARNING' ELSE 'INFO' END]), unnest([bp, bi])
 FROM (SELECT CAST(count(*) FILTER (destination_port > 65535) AS DOUBLE) AS bp, CAST(count(*) FILTER (destination_ip = '10.0.300') AS DOUBLE) AS bi FROM ipdr_raw)
UNION ALL SELECT 'volume', "column" || '_negatives', CASE WHEN negatives > 0 THEN 'ERROR' ELSE 'INFO' END, CAST(negatives AS DOUBLE) FROM ({_VQ}))"""


@check("V10_ipdr_recommendations", f"""WITH {_REP} SELECT count(*) FILTER (severity = 'ERROR') AS errors, count(*) FILTER (severity = 'WARNING') AS warnings,
 count(*) FILTER (severity = 'ERROR') = 0 AS is_valid, CASE WHEN count(*) FILTER (severity = 'WARNING') > 3 THEN 'REVIEW_EXPORT' ELSE '' END AS recommendations FROM rep""")
def _(v):
    return quality.ipdr_recommendations(quality.ipdr_quality_report(v.ipdr_raw, "2024-01-20 00:00:00"))


@check("V11_ipdr_quick_quality", """SELECT round(a, 4) AS timestamp_completeness, round(b, 4) AS port_completeness, round((a + b) / 2, 4) AS overall_score, true AS is_valid
FROM (SELECT count(start_time) * 1.0 / count(*) AS a, count(destination_port) * 1.0 / count(*) AS b FROM ipdr_raw)""")
def _(v):
    return quality.ipdr_quick_quality(v.ipdr_raw)


@check("V21_ipdr_quality_report", f"WITH {_REP} SELECT * REPLACE (round(value, 4) AS value) FROM rep")
def _(v):
    return quality.ipdr_quality_report(v.ipdr_raw, "2024-01-20 00:00:00")


# -- tower validation --------------------------------------------------------------------

@check("V12_tower_structure", "SELECT '' AS missing, count(*) AS records, count(*) = 0 AS empty, count(*) > 0 AS ok FROM tower_raw")
def _(v):
    return quality.tower_structure(v.tower_raw)


_TQ = " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{k}' AS problem, count(*) FILTER ({cond}) AS rows, count(*) FILTER ({cond}) * 100.0 / count(*) AS p FROM {{v}}""" for c, k, cond in [
    ("timestamp", "NULL", "timestamp IS NULL"), ("mobile_number", "NULL", "mobile_number IS NULL"), ("tower_id", "NULL", "tower_id IS NULL"),
    ("mobile_number", "PATTERN", "length(mobile_number) <> 10"), ("imei", "PATTERN", "length(imei) <> 15"), ("imsi", "PATTERN", "length(imsi) <> 15"),
    ("lat", "RANGE", "lat NOT BETWEEN -90 AND 90"), ("long", "RANGE", "lon NOT BETWEEN -180 AND 180")])


@check("V13_tower_quality", f"""SELECT "column", problem, rows, round(p, 4) AS rows_pct FROM ({_TQ.format(v='tower_raw').replace('lon NOT', 'long NOT')})""")
def _(v):
    return quality.tower_quality(v.tower_raw)


@check("V14_tower_pattern_quality", """
SELECT CAST((SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM tower_dump GROUP BY us - us % 3600000000, mobile_number, tower_id) WHERE n > 1) AS BIGINT) AS duplicate_members,
 (SELECT NOT coalesce(bool_or(p > t), false) FROM (SELECT us - us % 3600000000 AS t, lag(us - us % 3600000000) OVER (ORDER BY event_id) AS p FROM tower_dump)) AS in_time_order""")
def _(v):
    return quality.tower_pattern_quality(v.tower_dump.withColumn("timestamp", S.bin_start("timestamp", 3600)))


_SW = """ch AS (SELECT * FROM (SELECT *, lag(tower_id) OVER (PARTITION BY mobile_number ORDER BY us, event_id) AS p FROM {v}) WHERE p IS NULL OR p <> tower_id),
sw AS (SELECT mobile_number, count(*) AS switches FROM (SELECT mobile_number, us - lag(us) OVER (PARTITION BY mobile_number ORDER BY us, event_id) AS g FROM ch) WHERE g < 60000000 GROUP BY 1)"""


@check("V15_rapid_switching", f"WITH {_SW.format(v='tower_dump_dense')} SELECT * FROM sw")
def _(v):
    return quality.rapid_switching(v.tower_dump_dense)


_IT = f"""stp AS (SELECT *, lag(tower_id) OVER w AS ft, lag(us) OVER w AS fu, lag(lat) OVER w AS fl, lag(lon) OVER w AS fo FROM {{v}} WINDOW w AS (PARTITION BY {{k}} ORDER BY us, event_id)),
it AS (SELECT *, {km('fl', 'fo', 'lat', 'lon')} AS km, (us - fu) / 1e6 AS sec FROM stp WHERE ft <> tower_id AND us > fu)"""


@check("V16_impossible_travel", f"""WITH {_IT.format(v='tower_dump_dense', k='mobile_number')}
SELECT mobile_number, ft AS from_tower, tower_id AS to_tower, fu AS from_time, us AS to_time, round(km, 4) AS km, round(km * 3600 / sec, 4) AS kmh FROM it WHERE km * 3600 / sec > 200""")
def _(v):
    return quality.impossible_travel(v.tower_dump_dense, 200, lon="lon").drop("seconds")


@check("V17_multi_imei", """SELECT mobile_number, count(DISTINCT imei) AS imei_count, string_agg(DISTINCT imei, '|' ORDER BY imei) AS imeis FROM tower_dump GROUP BY 1 HAVING count(DISTINCT imei) >= 3""")
def _(v):
    return quality.multi_imei(v.tower_dump)


@check("V18_new_sim_activity", """SELECT mobile_number, min(us) AS first_seen, count(*) AS records, (max(us) - min(us)) // 86400000000 AS span_days FROM tower_dump_dense GROUP BY 1
HAVING (max(us) - min(us)) // 86400000000 <= 7 AND count(*) > 10""")
def _(v):
    return quality.new_sim_activity(v.tower_dump_dense)


@check("V19_one_time_numbers", "SELECT mobile_number, min(tower_id) AS tower_id FROM (SELECT CAST(event_id AS VARCHAR) || '_' || mobile_number AS mobile_number, tower_id FROM tower_dump UNION ALL SELECT mobile_number, tower_id FROM tower_dump) GROUP BY 1 HAVING count(*) = 1")
def _(v):
    t = v.tower_dump.select("event_id", "mobile_number", "tower_id")
    some = t.withColumn("mobile_number", F.concat_ws("_", F.col("event_id").cast("string"), "mobile_number"))
    return quality.one_time_numbers(t.unionByName(some))


_ST = """n AS (SELECT mobile_number, count(*) AS n, count(DISTINCT imei) AS i FROM {v} GROUP BY 1),
st AS (SELECT count(*) AS unique_numbers, avg(n) AS records_per_number, count(*) FILTER (i > 1) AS numbers_with_several_imeis,
 (SELECT (max(us) - min(us)) / 3600e6 FROM {v}) AS span_hours, (SELECT count(DISTINCT tower_id) FROM {v}) AS unique_towers, (SELECT count(DISTINCT imei) FROM {v}) AS unique_imeis FROM n)"""


@check("V20_tower_statistics", f"WITH {_ST.format(v='tower_dump')} SELECT * REPLACE (round(records_per_number, 4) AS records_per_number, round(span_hours, 4) AS span_hours) FROM st")
def _(v):
    return quality.tower_statistics(v.tower_dump)


@check("V22_tower_quality_report", f"""
WITH {_SW.format(v='tower_dump_dense')}, {_IT.format(v='tower_dump_dense', k='mobile_number')}, {_ST.format(v='tower_dump_dense')}
SELECT 'structure' AS kind, 'ok' AS item, 1.0 AS value
UNION ALL SELECT 'quality', "column" || '/' || problem, rows FROM ({_TQ.format(v='tower_dump_dense')}) WHERE "column" <> 'long'
UNION ALL SELECT 'quality', 'lon/RANGE', 0.0
UNION ALL SELECT 'valid_records', 'all', count(*) FROM tower_dump_dense
UNION ALL SELECT 'pattern', 'duplicate_members', 0.0
UNION ALL SELECT 'pattern', 'in_time_order', (SELECT CASE WHEN bool_or(p > us) THEN 0.0 ELSE 1.0 END FROM (SELECT us, lag(us) OVER (ORDER BY event_id) AS p FROM tower_dump_dense))
UNION ALL SELECT 'statistic', unnest(['unique_numbers', 'records_per_number', 'numbers_with_several_imeis', 'span_hours', 'unique_towers', 'unique_imeis']),
 round(unnest([unique_numbers, records_per_number, numbers_with_several_imeis, span_hours, unique_towers, unique_imeis]), 4) FROM st
UNION ALL SELECT 'rapid_tower_switching', mobile_number, switches FROM sw
UNION ALL SELECT 'impossible_travel', mobile_number, round(max(km * 3600 / sec), 4) FROM it WHERE km * 3600 / sec > 200 GROUP BY 2
UNION ALL SELECT 'multiple_imei', mobile_number, count(DISTINCT imei) FROM tower_dump_dense GROUP BY 2 HAVING count(DISTINCT imei) >= 3
UNION ALL SELECT 'new_sim_high_activity', mobile_number, count(*) FROM tower_dump_dense GROUP BY 2 HAVING count(*) > 10
UNION ALL SELECT 'one_time_visitor', mobile_number, 1 FROM tower_dump_dense GROUP BY 2 HAVING count(*) = 1""")
def _(v):
    return quality.tower_quality_report(v.tower_dump_dense, lon="lon")


# -- summaries ---------------------------------------------------------------------------

@check("A1_cdr_summary", """
SELECT subject, count(*) AS total_records, count(*) FILTER (NOT is_provider_message) AS filtered_records, count(*) FILTER (is_provider_message) AS provider_messages,
 min(us) AS first_record, max(us) AS last_record, count(DISTINCT b_party) FILTER (NOT is_provider_message) AS unique_contacts,
 CAST(sum(duration_seconds) FILTER (NOT is_provider_message) AS BIGINT) AS total_duration, round(avg(duration_seconds) FILTER (NOT is_provider_message), 4) AS avg_duration,
 count(*) FILTER (NOT is_provider_message AND call_type = 'CALL-IN') AS call_in, count(*) FILTER (NOT is_provider_message AND call_type = 'CALL-OUT') AS call_out,
 count(*) FILTER (NOT is_provider_message AND call_type = 'SMS-IN') AS sms_in, count(*) FILTER (NOT is_provider_message AND call_type = 'SMS-OUT') AS sms_out FROM cdr GROUP BY 1""")
def _(v):
    return summaries.cdr_summary(v.cdr)


@check("A3_tower_summary", """
SELECT count(*) AS records, count(DISTINCT mobile_number) AS numbers, count(DISTINCT tower_id) AS towers, count(DISTINCT imei) AS devices, min(us) AS first_record, max(us) AS last_record,
 round(count(*) FILTER (hour(timestamp) < 6) * 100.0 / count(*), 4) AS odd_pct, round(count(*) FILTER (dayofweek(timestamp) IN (0, 6)) * 100.0 / count(*), 4) AS weekend_pct FROM tower_dump""")
def _(v):
    return summaries.tower_summary(v.tower_dump)


@check("A4_dump_summary", """
SELECT coalesce(dump_id, 'TOTAL') AS dump_id, count(*) AS records, count(DISTINCT mobile_number) AS numbers, count(DISTINCT tower_id) AS towers, min(us) AS first_record, max(us) AS last_record
FROM dumps GROUP BY ROLLUP (dump_id)""")
def _(v):
    return summaries.dump_summary(v.dumps)


@check("A5_time_overview", """
SELECT min(us) AS first_record, max(us) AS last_record, count(*) AS records, round((max(us) - min(us)) / 3600e6, 4) AS span_hours, min(us) + (max(us) - min(us)) // 2 AS midpoint FROM tower_dump""")
def _(v):
    return summaries.time_overview(v.tower_dump)
