"""Group-by summaries of the three record kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions.scalar import count_if, is_weekend, odd_hour, pct, seconds_between


def cdr_summary(df: DataFrame) -> DataFrame:
    """Records, provider messages, range, contacts, durations and a count per call type."""
    kept = ~F.col("is_provider_message")
    name = F.lower(F.regexp_replace("call_type", "-", "_"))
    base = df.groupBy("subject").agg(
        F.count(F.lit(1)).alias("total_records"), count_if(kept).alias("filtered_records"),
        count_if(~kept).alias("provider_messages"), F.min("datetime").alias("first_record"), F.max("datetime").alias("last_record"),
        F.count_distinct(F.when(kept, F.col("b_party"))).alias("unique_contacts"),
        F.sum(F.when(kept, F.col("duration_seconds"))).alias("total_duration"),
        F.avg(F.when(kept, F.col("duration_seconds"))).alias("avg_duration"))
    kinds = (
        df.filter(kept).withColumn("_kind", name).groupBy("subject")
        .pivot("_kind", [t.lower().replace("-", "_") for t in tables.CALL_TYPES]).agg(F.count(F.lit(1))).fillna(0))
    return base.join(kinds, "subject", "left").fillna(0, [t.lower().replace("-", "_") for t in tables.CALL_TYPES])


def tower_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("mobile_number").alias("numbers"),
        F.count_distinct("tower_id").alias("towers"), F.count_distinct("imei").alias("devices"),
        F.min("timestamp").alias("first_record"), F.max("timestamp").alias("last_record"),
        pct(count_if(odd_hour("timestamp", 0, 6)), F.count(F.lit(1))).alias("odd_pct"),
        pct(count_if(is_weekend("timestamp")), F.count(F.lit(1))).alias("weekend_pct"))


def dump_summary(df: DataFrame) -> DataFrame:
    """One row per dump and one total row; numbers in several dumps count once in the total.

    The distinct counts come from one row per (dump, number, tower), so the extra grouping set
    of the rollup multiplies that table and not the records."""
    per = df.groupBy("dump_id", "mobile_number", "tower_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    out = per.rollup("dump_id").agg(
        F.sum("n").alias("records"), F.count_distinct("mobile_number").alias("numbers"), F.count_distinct("tower_id").alias("towers"),
        F.min("lo").alias("first_record"), F.max("hi").alias("last_record"), F.grouping("dump_id").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("dump_id")).alias("dump_id"),
                      "records", "numbers", "towers", "first_record", "last_record")


def time_overview(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    out = df.agg(F.min(ts).alias("first_record"), F.max(ts).alias("last_record"), F.count(F.lit(1)).alias("records"))
    return out.select("*", (seconds_between("last_record", "first_record") / 3600).alias("span_hours"),
                      F.timestamp_micros(F.expr("unix_micros(first_record) + (unix_micros(last_record) - unix_micros(first_record)) div 2")).alias("midpoint"))
