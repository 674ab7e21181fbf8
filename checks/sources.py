"""Readers and writers: views written in source layouts and read back."""

from pyspark.sql import functions as F

from tallymast import sources, tables
from tallymast.session import new_folder

from . import check
from .quality import phone, prov

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def written(df, fmt, **options):
    """Folder of ``df``, written with a header where the format has one."""
    path = f"{new_folder(df.sparkSession, 'sources')}/{fmt}"
    df.write.format(fmt).options(header=True, **options).save(path)
    return path


# Half of the calls under the headers of exports in another order, half under the plain names.
@check("S1_read_cdr", f"""
SELECT event_id, {phone('a_party')} AS a_party, {phone('b_party')} AS b_party, us - us % 1000000 AS datetime, duration_seconds, call_type, first_cell, last_cell,
  imei, imsi, lat, lon, {prov('b_party')} AS is_provider_message, TRUE AS has_location, a_party AS subject FROM cdr""")
def _(v):
    raw = v.cdr.select("event_id", "a_party", "b_party", F.date_format("datetime", "yyyy-MM-dd").alias("date"), F.date_format("datetime", "HH:mm:ss").alias("time"),
                       F.col("duration_seconds").alias("duration"), "call_type", "first_cell", "last_cell", "imei", "imsi", "lat", "lon")
    odd = raw.filter("event_id % 2 = 1").select(*reversed(raw.columns)).withColumnsRenamed({c: h for c, h in tables.CDR_COLUMNS.items() if c in raw.columns})
    paths = [written(raw.filter("event_id % 2 = 0"), "csv"), written(odd, "csv")]
    got = sources.read_cdr(v.spark, [f"{p}/*.csv" for p in paths], subject=F.col("a_party"))
    return got.select("event_id", "a_party", "b_party", "datetime", "duration_seconds", "call_type", "first_cell", "last_cell", "imei", "imsi", "lat", "lon",
                      "is_provider_message", "has_location", "subject")


@check("S2_read_ipdr", """
SELECT event_id, subject, subscriber_id, us AS start_time, end_us AS end_time, destination_port, protocol, CAST(data_volume_up AS DOUBLE) AS data_volume_up, CAST(data_volume_down AS DOUBLE) AS data_volume_down FROM ipdr""")
def _(v):
    raw = v.ipdr.select("event_id", "subscriber_id", "start_time", "end_time", "destination_port", "protocol", "data_volume_up", "data_volume_down")
    text = raw.withColumns({c: F.date_format(c, STAMP) for c in ("start_time", "end_time")})
    paths = [f"{written(raw.filter('event_id % 3 = 0'), 'parquet')}/*.parquet", f"{written(text.filter('event_id % 3 > 0'), 'csv')}/*.csv"]
    got = sources.read_ipdr(v.spark, ",".join(paths))
    return got.select("event_id", "subject", "subscriber_id", "start_time", "end_time", "destination_port", "protocol", "data_volume_up", "data_volume_down")


@check("S3_read_tower_dump", """
SELECT event_id, mobile_number, us - us % 1000000 AS timestamp, tower_id, imei, imsi, lat, lon AS long, CAST(duration AS DOUBLE) AS duration FROM tower_dump""")
def _(v):
    raw = v.tower_dump.select("event_id", F.col("mobile_number").alias("MSISDN"), F.date_format("timestamp", "dd-MM-yyyy HH:mm:ss").alias("TimeStamp"),
                              F.col("tower_id").alias("Cell_ID"), "imei", "imsi", F.col("lat").alias("Latitude"), F.col("lon").alias("Lon"), F.col("duration").alias("Duration"))
    got = sources.read_tower_dump(v.spark, f"{written(raw, 'csv')}/*.csv")
    return got.select("event_id", "mobile_number", "timestamp", "tower_id", "imei", "imsi", "lat", "long", "duration")


# Two dumps with the same records: of copies one is left, from the first dump.
@check("S4_read_tower_dumps", """
SELECT DISTINCT mobile_number, us - us % 1000000 AS timestamp, tower_id FROM tower_dump""")
def _(v):
    raw = v.tower_dump.select(F.col("mobile_number").alias("MSISDN"), F.date_format("timestamp", "dd-MM-yyyy HH:mm:ss").alias("TimeStamp"), F.col("tower_id").alias("Cell_ID"))
    paths = [f"{written(raw, 'csv')}/*.csv", f"{written(raw.filter(F.crc32('MSISDN') % 2 == 0), 'parquet')}/*.parquet"]
    return sources.read_tower_dumps(v.spark, paths).select("mobile_number", "timestamp", "tower_id")


@check("S7_read_towers", "SELECT tower_id, lat, lon AS long, CASE WHEN tower_id < 'T2' THEN 2.5E0 ELSE 1.0E0 END AS coverage_radius FROM towers")
def _(v):
    raw = v.towers.select(F.concat(F.lit(" "), "tower_id").alias("Cell_ID"), F.col("lat").alias("latitude"), "lon", F.expr("CASE WHEN tower_id < 'T2' THEN 2.5D END").alias("radius"))
    return sources.read_towers(v.spark, f"{written(raw, 'csv')}/*.csv").select("tower_id", "lat", "long", "coverage_radius")


@check("S8_write_towers", "SELECT tower_id, lat, lon AS long, coverage_radius FROM towers WHERE tower_id IN ('T3', 'T5', 'T11')")
def _(v):
    path = f"{new_folder(v.spark, 'towers')}/out.parquet"
    sources.write_towers(v.towers.withColumnRenamed("lon", "long"), path, ["T3", "T5", "T11"], fmt="parquet")
    return sources.read_towers(v.spark, path).select("tower_id", "lat", "long", "coverage_radius")


# Lists become separated text in a text format.
@check("S10_write_result", """
SELECT a_party AS subject, count(*) AS calls, (SELECT string_agg(b, '|' ORDER BY b) FROM (SELECT DISTINCT b_party AS b FROM cdr AS o WHERE o.a_party = cdr.a_party)) AS parties FROM cdr GROUP BY a_party""")
def _(v):
    out = v.cdr.groupBy("subject").agg(F.count("*").alias("calls"), F.array_sort(F.collect_set("b_party")).alias("parties"))
    path = new_folder(v.spark, "result")
    sources.write_result(out, path, "csv")
    return v.spark.read.option("header", True).csv(path).select("subject", F.col("calls").cast("long").alias("calls"), "parties")
