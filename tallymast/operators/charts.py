"""Data sets behind charts; drawing is not part of this library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions.scalar import bin_start, count_if, day_name, pct, us
from ..normalize import filter_window
from .graph import _one_row
from .movement import correlations


def tower_heat(df: DataFrame) -> DataFrame:
    per = df.groupBy("tower_id").agg(F.count(F.lit(1)).alias("records"))
    out = _one_row(per, per.agg(F.max("records").alias("_max")))
    x = F.col("records") / F.col("_max")
    return out.select("tower_id", "records", x.alias("intensity"), F.when(x > 0.8, "HIGH").when(x > 0.5, "MEDIUM").otherwise("LOW").alias("band"))


def hour_week_matrix(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Hour by weekday; every hour that occurs has all seven columns."""
    rows = df.select(F.hour(ts).alias("hour"), day_name(ts).alias("dow"))
    return rows.groupBy("hour").pivot("dow", tables.DAY_NAMES).agg(F.count(F.lit(1))).fillna(0)


def device_density(df: DataFrame, seconds: int = 3600) -> DataFrame:
    """Unique devices per tower and window, and as a share of the greatest."""
    per = df.groupBy("tower_id", bin_start("timestamp", seconds).alias("bin")).agg(F.count_distinct("mobile_number").alias("devices"))
    out = _one_row(per, per.agg(F.max("devices").alias("_max")))
    return out.select("tower_id", "bin", "devices", (F.col("devices") / F.col("_max")).alias("density"))


def risk_by_tower(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Risk of the records of a tower (no score counts as 0) and its devices."""
    rows = df.join(scores.select(F.col("subject").alias("mobile_number"), "score"), "mobile_number", "left").withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    return rows.groupBy("tower_id").agg(F.avg("score").alias("mean_risk"), F.max("score").alias("max_risk"), F.sum("score").alias("total_risk"), F.count_distinct("mobile_number").alias("devices"))


def risk_by_hour(df: DataFrame, scores: DataFrame) -> DataFrame:
    rows = df.join(scores.select(F.col("subject").alias("mobile_number"), "score"), "mobile_number", "left")
    return rows.groupBy(F.hour("timestamp").alias("hour")).agg(F.avg(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("mean_risk"), F.count(F.lit(1)).alias("records"))


DEVICE_METRICS = ("records", "towers", "days", "odd_records", "imeis", "odd_pct", "mobility")


def device_metrics(df: DataFrame) -> DataFrame:
    """Seven metrics per device; mobility is towers per hundred records."""
    out = df.groupBy("mobile_number").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("tower_id").alias("towers"), F.count_distinct(F.to_date("timestamp")).alias("days"),
        count_if(F.hour("timestamp") <= 5).alias("odd_records"), F.count_distinct("imei").alias("imeis"))
    return out.select("*", pct(F.col("odd_records"), F.col("records")).alias("odd_pct"), pct(F.col("towers"), F.col("records")).alias("mobility"))


def metric_correlation(df: DataFrame) -> DataFrame:
    """Correlation of the seven device metrics, pairwise in long form."""
    return correlations(device_metrics(df), DEVICE_METRICS)


def call_matrix(df: DataFrame, k: int = 20) -> DataFrame:
    """Caller by receiver counts over the ``k`` busiest callers and receivers, in long form."""
    per = df.groupBy("a_party", "b_party").agg(F.count(F.lit(1)).alias("calls"))
    top = lambda c: per.groupBy(F.col(c).alias("party")).agg(F.sum("calls").alias("n")).orderBy(F.desc("n"), "party").limit(k).select("party")
    both = F.broadcast(top("a_party").union(top("b_party")).distinct())  # at most 2k rows
    out = per.join(both.withColumnRenamed("party", "a_party"), "a_party", "left_semi")
    return out.join(both.withColumnRenamed("party", "b_party"), "b_party", "left_semi").select("a_party", "b_party", "calls")


def activity_series(df: DataFrame, seconds: int = 300) -> DataFrame:
    return df.groupBy(bin_start("timestamp", seconds).alias("bin"), "tower_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("mobile_number").alias("devices"))


def appearance_classes(df: DataFrame, focus, hours: float = 2, new_minutes: float = 30) -> DataFrame:
    """Device classes around a focus time: first seen near it, last seen near it, transient, persistent."""
    t = F.unix_micros(F.lit(focus).cast("timestamp"))
    near = int(new_minutes * 60e6)
    out = filter_window(df, focus, focus, hours * 60).groupBy("mobile_number").agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("records"))
    lo, hi = us("first_seen"), us("last_seen")
    kind = F.when(F.abs(lo - t) < near, "NEW").when(F.abs(hi - t) < near, "LEAVING").when(hi - lo < 3_600_000_000, "TRANSIENT").otherwise("PERSISTENT")
    return out.withColumn("kind", kind)


def appearance_series(df: DataFrame, classes: DataFrame, focus, hours: float = 2, seconds: int = 300) -> DataFrame:
    """Devices of each class per bin."""
    rows = filter_window(df, focus, focus, hours * 60).join(classes.select("mobile_number", "kind"), "mobile_number")
    return rows.groupBy(bin_start("timestamp", seconds).alias("bin"), "kind").agg(F.count_distinct("mobile_number").alias("devices"))


def window_relation(df: DataFrame, start, end, hours: float = 2) -> DataFrame:
    """Relation of a device to a window by its first and last record, looking ``hours`` to both sides."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    out = filter_window(df, start, end, hours * 60).groupBy("mobile_number").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("records"), F.count_distinct("tower_id").alias("towers"))
    a, b = F.col("first_seen"), F.col("last_seen")
    kind = (F.when((a >= lo) & (b <= hi), "ONLY_DURING").when(a.between(lo, hi), "ARRIVED").when(b.between(lo, hi), "LEFT")
            .when((a < lo) & (b > hi), "THROUGHOUT").otherwise("OTHER"))
    return out.select("mobile_number", "first_seen", "last_seen", "records", "towers", kind.alias("relation"), ((us("last_seen") - us("first_seen")) / 60e6).alias("minutes"))


def relation_series(relations: DataFrame, seconds: int = 300) -> DataFrame:
    """Devices of each relation present per bin, from first to last seen."""
    width = seconds * 1_000_000
    bins = F.explode(F.sequence(F.floor(us("first_seen") / width), F.floor(us("last_seen") / width))).alias("_b")
    return relations.select("relation", bins).groupBy(F.timestamp_micros(F.col("_b") * width).alias("bin"), "relation").agg(F.count(F.lit(1)).alias("devices"))


def key_devices(relations: DataFrame, k: int = 10) -> DataFrame:
    return relations.filter("relation <> 'OTHER'").orderBy(F.desc("minutes"), "mobile_number").limit(k)
