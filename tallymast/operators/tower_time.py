"""Tower dumps: activity in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import tables
from ..functions.scalar import bin_start, count_if, day_name, level, odd_hour, pct, points, seconds_between, us
from ..normalize import filter_window
from ..plans.shards import neighbours
from .cdr import TIE


def at(moment) -> Column:
    return F.lit(moment).cast("timestamp")


def window_activity(df: DataFrame, start, end) -> DataFrame:
    """Records, devices and towers in the inclusive window."""
    return filter_window(df, start, end).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("mobile_number").alias("devices"), F.count_distinct("tower_id").alias("towers"))


def window_towers(df: DataFrame, start, end, k: int = 5) -> DataFrame:
    per = filter_window(df, start, end).groupBy("tower_id").agg(F.count(F.lit(1)).alias("records"))
    return per.orderBy(F.desc("records"), "tower_id").limit(k)


def window_devices(df: DataFrame, start, end) -> DataFrame:
    """First and last record of each device in the window and a presence class (F14: a single
    record is tested first, so every class can occur)."""
    out = filter_window(df, start, end).groupBy("mobile_number").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("records"))
    span = seconds_between("last_seen", "first_seen")
    return out.withColumn("presence", F.when(F.col("records") == 1, "SINGLE_PING").when(span == 0, "STATIONARY")
                          .when(span < 300, "BRIEF_PRESENCE").otherwise("ACTIVE_MOVEMENT"))


def window_only(df: DataFrame, start, end) -> DataFrame:
    """Devices with no record outside the window; one aggregate, no anti-join."""
    inside = (F.col("timestamp") >= at(start)) & (F.col("timestamp") <= at(end))
    out = df.groupBy("mobile_number").agg(F.bool_and(inside).alias("_only"), F.count(F.lit(1)).alias("records"))
    return out.filter("_only").drop("_only")


def odd_hour_devices(df: DataFrame, odd: tuple[int, int] = (0, 5)) -> DataFrame:
    """Odd-hour records per device with a small score over count, days and towers."""
    rows = df.filter(odd_hour("timestamp", *odd))
    out = rows.groupBy("mobile_number").agg(
        F.count(F.lit(1)).alias("records"), F.array_sort(F.collect_set(F.hour("timestamp"))).alias("hours"),
        F.count_distinct(F.to_date("timestamp")).alias("days"), F.count_distinct("tower_id").alias("towers"))
    n, d, t = F.col("records"), F.col("days"), F.col("towers")
    score = F.when(n > 10, 3).when(n > 5, 2).otherwise(1) + points((d > 3, 2), (d > 1, 1)) + points((t > 3, 2), (t > 1, 1))
    return out.withColumn("score", score).withColumn("level", level((score >= 6, "HIGH"), (score >= 4, "MEDIUM")))


def around(df: DataFrame, moment, before: float = 60, after: float = 60, during_seconds: float = 0) -> DataFrame:
    """Presence before, during and after a moment; left, arrived or there throughout.

    Deviation F14: "during" is a half-width in seconds instead of equality with one instant."""
    t = F.unix_micros(at(moment))
    gap = us("timestamp") - t
    rows = filter_window(df, moment, moment, max(before, after, during_seconds / 60))
    out = rows.groupBy("mobile_number").agg(
        F.bool_or((gap < 0) & (gap >= -int(before * 60e6))).alias("before"),
        F.bool_or(F.abs(gap) <= int(during_seconds * 1e6)).alias("during"),
        F.bool_or((gap > 0) & (gap <= int(after * 60e6))).alias("after"))
    out = out.filter(F.col("before") | F.col("during") | F.col("after"))
    return out.withColumn("change", F.when(F.col("before") & F.col("after"), "THROUGHOUT").when(F.col("before"), "LEFT")
                          .when(F.col("after"), "ARRIVED").otherwise("DURING_ONLY"))


def activity_bursts(df: DataFrame, minutes: int = 5, least: int = 10, high: int = 20) -> DataFrame:
    """Tumbling bins with at least ``least`` records.

    Counts come from one row per (bin, device, tower), combined before the shuffle, so a bin
    that holds very many records is not one task's load."""
    per = df.groupBy(bin_start("timestamp", minutes * 60).alias("bin"), "mobile_number", "tower_id").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("bin").agg(
        F.sum("n").alias("records"), F.count_distinct("mobile_number").alias("devices"), F.count_distinct("tower_id").alias("towers"))
    return out.filter(F.col("records") >= least).withColumn("level", level((F.col("records") > high, "HIGH"), default="MEDIUM"))


def device_silence(df: DataFrame, minutes: float = 120, tie: Sequence[str] = TIE) -> DataFrame:
    """Gaps longer than ``minutes`` per device: how many, and the longest."""
    steps = neighbours(df.select("mobile_number", "timestamp", *tie), ["mobile_number"], "timestamp", prev={"_prev": "timestamp"}, tie=tie)
    gap = us("timestamp") - us("_prev")
    gaps = steps.withColumn("_gap", gap).filter(F.col("_gap") > int(minutes * 60e6))
    longest = F.max(F.struct(F.col("_gap"), F.col("_prev").alias("start"), F.col("timestamp").alias("stop"))).alias("_l")
    out = gaps.groupBy("mobile_number").agg(F.count(F.lit(1)).alias("silences"), longest)
    return out.select("mobile_number", "silences", (F.col("_l._gap") / 60e6).alias("longest_minutes"),
                      F.col("_l.start").alias("silent_from"), F.col("_l.stop").alias("silent_to"))


def hourly_activity(df: DataFrame) -> DataFrame:
    """All 24 hours, zero where nothing happened."""
    hours = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    per = df.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("records"))
    return hours.join(per, "hour", "left").fillna(0, ["records"])


def weekday_activity(df: DataFrame) -> DataFrame:
    return df.groupBy(day_name("timestamp").alias("day_of_week")).agg(F.count(F.lit(1)).alias("records"))


def temporal_profile(df: DataFrame, high: float = 20, medium: float = 10) -> DataFrame:
    """Peak and low hour (ties to the lower hour) and the share of hours 0-5."""
    h = hourly_activity(df)
    out = h.agg(
        F.max_by("hour", F.struct("records", (-F.col("hour")).alias("h"))).alias("peak_hour"),
        F.min_by("hour", F.struct("records", "hour")).alias("low_hour"), F.sum("records").alias("records"),
        F.sum(F.when(F.col("hour") < 6, F.col("records")).otherwise(0)).alias("_odd"))
    share = pct(F.col("_odd"), F.col("records"))
    return out.select("peak_hour", "low_hour", "records", share.alias("odd_pct"), level((share > high, "HIGH"), (share > medium, "MEDIUM")).alias("level"))
