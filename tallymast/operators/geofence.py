"""Tower dumps: places, dwell times, perimeters, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.scalar import bin_start, count_if, seconds_between, us
from ..plans.shards import neighbours
from .cdr import TIE, top_k


def busiest_towers(df: DataFrame, k: int = 3) -> DataFrame:
    return df.groupBy("tower_id").agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "tower_id").limit(k)


def devices_at(df: DataFrame, towers: DataFrame | Sequence[str]) -> DataFrame:
    """Per (tower, number) at the given towers: span, connections, days, minutes."""
    rows = df.join(towers.select("tower_id"), "tower_id", "left_semi") if isinstance(towers, DataFrame) else df.filter(F.col("tower_id").isin(list(towers)))
    out = rows.groupBy("tower_id", "mobile_number").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("connections"),
        F.count_distinct(F.to_date("timestamp")).alias("days"))
    return out.withColumn("minutes", seconds_between("last_seen", "first_seen") / 60)


def categorize_devices(d: DataFrame) -> DataFrame:
    """Resident, one-time or brief, and independently first seen at hours 0-5."""
    return d.select(
        "tower_id", "mobile_number",
        F.when(F.col("days") >= 3, "RESIDENT").when(F.col("connections") == 1, "ONE_TIME").when(F.col("minutes") < 10, "BRIEF").otherwise("OTHER").alias("category"),
        (F.hour("first_seen") <= 5).alias("odd_hour"))


def _tower_sets(df: DataFrame, minutes: int) -> DataFrame:
    """Distinct towers of a number per bin; distinct rows first, so repeats collapse before the lists."""
    cells = df.select("mobile_number", bin_start("timestamp", minutes * 60).alias("bin"), "tower_id").distinct()
    return cells.groupBy("mobile_number", "bin").agg(F.array_sort(F.collect_list("tower_id")).alias("towers"))


def overlap_zones(df: DataFrame, minutes: int = 10, devices: int = 3, listed: int = 5) -> DataFrame:
    """Tower sets that at least ``devices`` numbers used within one bin, with a few of them."""
    zones = _tower_sets(df, minutes).filter(F.size("towers") >= 2).select("towers", "mobile_number").distinct()
    counts = zones.groupBy("towers").agg(F.count(F.lit(1)).alias("devices")).filter(F.col("devices") >= devices)
    few = top_k(zones, ["towers"], ["mobile_number"], listed, "_n").groupBy("towers").agg(F.array_sort(F.collect_list("mobile_number")).alias("samples"))
    return counts.join(few, "towers")


def triangulable(df: DataFrame, minutes: int = 5, least: int = 3, high: int = 4) -> DataFrame:
    out = _tower_sets(df, minutes).filter(F.size("towers") >= least)
    return out.withColumn("precision", F.when(F.size("towers") >= high, "HIGH").otherwise("MEDIUM"))


def stationary(tri: DataFrame, least: int = 3, minutes: int = 5) -> DataFrame:
    """Numbers whose instants all have the same tower set (F19: none is an empty result)."""
    out = tri.groupBy("mobile_number").agg(F.count(F.lit(1)).alias("instants"), F.min("towers").alias("towers"), F.max("towers").alias("_other"))
    return out.filter((F.col("instants") >= least) & (F.col("towers") == F.col("_other"))).select(
        "mobile_number", "towers", (F.col("instants") * minutes).alias("minutes"))


def dwell(df: DataFrame, minutes: float = 10, max_gap: float = 30, tie: Sequence[str] = TIE) -> DataFrame:
    """Continuous presence of a number at a tower."""
    rows = neighbours(df.select("mobile_number", "tower_id", "timestamp", *tie), ["mobile_number", "tower_id"], "timestamp", prev={"_p": "timestamp"}, tie=tie)
    out = rows.groupBy("mobile_number", "tower_id").agg(
        F.count(F.lit(1)).alias("connections"), F.min("timestamp").alias("start"), F.max("timestamp").alias("stop"),
        F.max(us("timestamp") - us("_p")).alias("_gap"))
    span = us("stop") - us("start")
    out = out.filter((F.col("connections") >= 2) & (span >= int(minutes * 60e6)) & (F.col("_gap") < int(max_gap * 60e6)))
    long = span / 60e6
    return out.select(
        "mobile_number", "tower_id", "connections", "start", "stop", long.alias("minutes"),
        F.when(long < 30, "SHORT").when(long < 120, "MEDIUM").otherwise("EXTENDED").alias("kind"),
        (F.col("_gap") < 600_000_000).alias("continuous"), ((F.hour("start") >= 22) | (F.hour("start") <= 5)).alias("night_start"))


def perimeter(df: DataFrame, core: DataFrame | None = None, k: int = 5, tie: Sequence[str] = TIE) -> DataFrame:
    """Steps across the edge of the core towers (the ``k`` busiest unless given)."""
    core = F.broadcast(busiest_towers(df, k)) if core is None else core  # at most k rows
    core = core.select("tower_id").withColumn("core", F.lit(True))
    rows = df.select("mobile_number", "timestamp", "tower_id", *tie).join(core, "tower_id", "left").fillna(False, ["core"])
    out = neighbours(rows, ["mobile_number"], "timestamp", prev={"from_tower": "tower_id", "_core": "core"}, tie=tie)
    return out.filter(F.col("_core") != F.col("core")).select(
        "mobile_number", F.when(F.col("core"), "ENTRY").otherwise("EXIT").alias("direction"), "from_tower", F.col("tower_id").alias("to_tower"), "timestamp", *tie)


def perimeter_devices(crossed: DataFrame, least: int = 3) -> DataFrame:
    return crossed.groupBy("mobile_number").agg(
        F.count(F.lit(1)).alias("crossings"), count_if(F.col("direction") == "ENTRY").alias("entries")).filter(F.col("crossings") >= least)


def tower_density(df: DataFrame) -> DataFrame:
    """Connections per hour covered, peak hour (ties to the lower hour) and repeat ratio."""
    per_hour = df.groupBy("tower_id", F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.min(us("timestamp")).alias("lo"), F.max(us("timestamp")).alias("hi"))
    stats = per_hour.groupBy("tower_id").agg(
        F.sum("n").alias("connections"), ((F.max("hi") - F.min("lo")) / 3600e6).alias("hours"),
        F.max(F.struct("n", (-F.col("hour")).alias("neg"))).alias("_p"))
    devices = df.groupBy("tower_id").agg(F.count_distinct("mobile_number").alias("devices"))
    ratio = F.col("connections") / F.col("devices")
    return stats.join(devices, "tower_id").select(
        "tower_id", "connections", "devices", "hours", F.when(F.col("hours") > 0, F.col("connections") / F.col("hours")).otherwise(0.0).alias("per_hour"),
        (-F.col("_p.neg")).alias("peak_hour"), F.col("_p.n").alias("peak_connections"), ratio.alias("repeat_ratio"),
        F.when(ratio > 10, "HIGH_REPEAT").when((ratio < 1.5) & (F.col("devices") > 20), "TRANSIENT").otherwise("NORMAL").alias("anomaly"))


# -- tower dimension ---------------------------------------------------------------------

def towers_within(towers: DataFrame, lat: float, lon: float, km: float, lon_column: str = "long") -> DataFrame:
    d = haversine_km(F.col("lat"), F.col(lon_column), F.lit(lat), F.lit(lon))
    band = towers.filter(F.col("lat").between(lat - km / 110, lat + km / 110))
    return band.withColumn("km", d).filter(F.col("km") <= km).orderBy("km", "tower_id")


def neighbours_of(towers: DataFrame, km: float, lon_column: str = "long") -> DataFrame:
    """Tower pairs within ``km``.  Latitude is cut into strips a little wider than ``km`` and a
    tower meets only its own and the two adjacent strips: an equi-join, not all pairs."""
    strip = km / 110.0
    t = towers.select("tower_id", "lat", F.col(lon_column).alias("lon"), "coverage_radius")
    a = t.withColumn("_s", F.floor(F.col("lat") / strip))
    b = t.select(*[F.col(c).alias(f"other_{c}") for c in t.columns],
                 F.explode(F.array(*[F.floor(F.col("lat") / strip) + d for d in (-1, 0, 1)])).alias("_s"))
    d = haversine_km("lat", "lon", "other_lat", "other_lon")
    return a.join(b, "_s").filter("tower_id <> other_tower_id").withColumn("km", d).filter(F.col("km") <= km).select(
        "tower_id", "other_tower_id", "km", "coverage_radius", "other_coverage_radius")


def enrich(df: DataFrame, towers: DataFrame, lon_column: str = "long") -> DataFrame:
    """Dump rows with tower attributes; own coordinates win, the tower's fill gaps (F15).

    No broadcast hint: Spark broadcasts the tower table if its size is below
    ``spark.sql.autoBroadcastJoinThreshold`` and joins by shuffle otherwise."""
    have = set(df.columns)
    dim = towers.select(
        F.col("tower_id").alias("_tid"), F.col("lat").alias("_lat"), F.col(lon_column).alias("_long"),
        *[F.col(c) for c in ("address", "area", "city", "state", "coverage_radius") if c in towers.columns])
    own = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    out = df.join(dim, F.col("tower_id") == F.col("_tid"), "left")
    extra = [c for c in dim.columns if not c.startswith("_")]
    return out.select(*[c for c in df.columns if c not in ("lat", "long")], F.coalesce(own("lat"), F.col("_lat")).alias("lat"),
                      F.coalesce(own("long"), F.col("_long")).alias("long"), *extra)


def coverage_overlap(pairs: DataFrame) -> DataFrame:
    """Overlap of the coverage circles of tower pairs (input: :func:`neighbours_of`)."""
    r1, r2, d = F.col("coverage_radius"), F.col("other_coverage_radius"), F.col("km")
    return pairs.select("tower_id", "other_tower_id", "km",
                        F.when(d > r1 + r2, 0.0).when(d <= F.abs(r1 - r2), 100.0).otherwise(100.0 * (1 - d / (r1 + r2))).alias("overlap_pct"))


def tower_info(towers: DataFrame, ids: Sequence[str]) -> DataFrame:
    return towers.filter(F.col("tower_id").isin(list(ids)))


def geofence_overview(df: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    count = lambda name, frame: frame.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("item"), "value")
    return reduce(DataFrame.unionByName, [
        df.agg(F.count_distinct("tower_id").alias("value")).select(F.lit("towers").alias("item"), "value"),
        df.agg(F.count_distinct("mobile_number").alias("value")).select(F.lit("devices").alias("item"), "value"),
        count("triangulable_instants", triangulable(df)), count("extended_dwell", dwell(df, tie=tie).filter("kind = 'EXTENDED'")),
        count("density_anomalies", tower_density(df).filter("anomaly <> 'NORMAL'"))])
