"""Call records: cells and coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions.geo import haversine_km, speed_kmh
from ..functions.scalar import count_if, level, pct, seconds_between
from ..plans.shards import neighbours
from .cdr import TIE, listed, people, top_k


def cell_profile(df: DataFrame, listed: int = 20, k: int = 10) -> DataFrame:
    """Distinct first cells (``listed`` of them named), the ``k`` busiest, whether any call
    changed cell (deviation F5: both ends must be known) and whether any has coordinates."""
    rows = people(df)
    flags = rows.groupBy("subject").agg(
        F.coalesce(F.bool_or(F.col("first_cell") != F.col("last_cell")), F.lit(False)).alias("tower_hopping"),
        F.bool_or(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("has_location"),
    )
    cells = rows.filter(F.col("first_cell").isNotNull()).groupBy("subject", "first_cell").agg(F.count(F.lit(1)).alias("n"))
    by_name = Window.partitionBy("subject").orderBy("first_cell")
    by_use = Window.partitionBy("subject").orderBy(F.desc("n"), "first_cell")
    ranked = cells.withColumns({"_a": F.row_number().over(by_name), "_u": F.row_number().over(by_use)})
    lists = ranked.groupBy("subject").agg(
        F.count(F.lit(1)).alias("tower_count"),
        F.array_sort(F.collect_list(F.when(F.col("_a") <= listed, F.col("first_cell")))).alias("towers"),
        F.array_sort(F.collect_list(F.when(F.col("_u") <= k, F.struct("_u", "first_cell")))).alias("_top"),
    ).select("subject", "tower_count", "towers", F.col("_top.first_cell").alias("top_towers"))
    return flags.join(lists, "subject", "left").select(
        "subject", F.coalesce("tower_count", F.lit(0)).alias("tower_count"), "towers", "top_towers", "tower_hopping", "has_location"
    )


def rapid_cell_changes(df: DataFrame, minutes: float = 5, limit: int | None = 10, tie: Sequence[str] = TIE) -> DataFrame:
    """Next record within ``minutes`` on another cell than the one the previous call ended on."""
    rows = people(df).select("subject", "datetime", "first_cell", F.coalesce("last_cell", "first_cell").alias("end_cell"), *tie)
    steps = neighbours(rows, ["subject"], "datetime", prev={"from_cell": "end_cell", "from_time": "datetime"}, tie=tie)
    gap = seconds_between("datetime", "from_time")
    hits = steps.filter((gap <= minutes * 60) & (F.col("from_cell") != F.col("first_cell"))).select(
        "subject", "from_time", F.col("datetime").alias("to_time"), "from_cell", F.col("first_cell").alias("to_cell"),
        (gap / 60).alias("minutes"), *tie,
    )
    out = hits if limit is None else top_k(hits, ["subject"], ["to_time", *tie], limit, "_n").drop("_n")
    return out.drop(*tie)


def fixes(df: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    return people(df).filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("subject", "datetime", "lat", "lon", *tie)


def fix_steps(df: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    """Consecutive fixes of a subject with distance, seconds and speed."""
    steps = neighbours(fixes(df, tie), ["subject"], "datetime",
                       next={"to_lat": "lat", "to_lon": "lon", "to_time": "datetime"}, tie=tie)
    km = haversine_km("lat", "lon", "to_lat", "to_lon")
    sec = seconds_between("to_time", "datetime")
    return steps.select("*", km.alias("km"), sec.alias("seconds"), speed_kmh(km, sec).alias("kmh"))


def impossible_travel(df: DataFrame, kmh: float = 200, min_km: float = 0.1, limit: int | None = 5, tie: Sequence[str] = TIE) -> DataFrame:
    hits = fix_steps(df, tie).filter((F.col("km") > min_km) & (F.col("kmh") > kmh))
    hits = hits.select("subject", F.col("datetime").alias("from_time"), "to_time", "lat", "lon", "to_lat", "to_lon",
                       "km", (F.col("seconds") / 3600).alias("hours"), "kmh", *tie)
    out = hits if limit is None else top_k(hits, ["subject"], ["from_time", *tie], limit, "_n").drop("_n")
    return out.drop(*tie)


def location_clusters(df: DataFrame, least: int = 5, hotspot: float = 20, k: int | None = 10) -> DataFrame:
    """Coordinates rounded to three decimals with at least ``least`` records, the top ``k`` of a
    subject or all of them, without rank.

    Deviation F1: the dominant hour is that of the cluster itself."""
    rows = fixes(df).select("subject", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), F.hour("datetime").alias("hour"))
    by_hour = rows.groupBy("subject", "lat", "lon", "hour").agg(F.count(F.lit(1)).alias("n"))
    cells = by_hour.groupBy("subject", "lat", "lon").agg(
        F.sum("n").alias("calls"), F.max(F.struct(F.col("n"), (-F.col("hour")).alias("neg"))).alias("_peak")
    )
    w = Window.partitionBy("subject")
    cells = cells.withColumn("_all", F.sum("calls").over(w))
    share = pct(F.col("calls"), F.col("_all"))
    out = cells.filter(F.col("calls") >= least).select(
        "subject", "lat", "lon", "calls", share.alias("share_pct"),
        F.when(share > hotspot, "HOTSPOT").otherwise("FREQUENT_LOCATION").alias("kind"),
        F.when(F.col("_peak.n") > F.col("calls") * 0.5, -F.col("_peak.neg")).alias("dominant_hour"),
    )
    return out if k is None else top_k(out, ["subject"], [F.desc("calls"), "lat", "lon"], k)


def near_areas(df: DataFrame, areas: DataFrame | None = None, km: float = 50, high_km: float = 20) -> DataFrame:
    """Nearest approach of a subject to each listed point within ``km``.

    Latitude is cut into strips as high as ``km``; a record meets the points of its own strip
    and the two beside it, so this is an equi-join and the point list may be of any size.
    """
    if areas is None:
        areas = df.sparkSession.createDataFrame(tables.BORDER_AREAS, "area string, area_lat double, area_lon double")
    strip = km / 110.0
    rows = fixes(df).select("subject", "datetime", "lat", "lon", F.floor(F.col("lat") / strip).alias("_s"))
    points = areas.withColumn("_s", F.explode(F.array(*[F.floor(F.col("area_lat") / strip) + d for d in (-1, 0, 1)])))
    km_col = haversine_km("lat", "lon", "area_lat", "area_lon")
    near = rows.join(points, "_s").withColumn("km", km_col).filter(F.col("km") <= km)
    best = near.groupBy("subject", "area").agg(
        F.min(F.struct("km", "datetime", "lat", "lon")).alias("b"), F.count(F.lit(1)).alias("records"))
    return best.select("subject", "area", "records", F.col("b.km").alias("km"), F.col("b.datetime").alias("at"),
                       level((F.col("b.km") < high_km, "HIGH"), default="MEDIUM").alias("severity"))


def movement_stats(df: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    places = fixes(df).groupBy("subject").agg(
        F.count_distinct("lat", "lon").alias("unique_locations"), F.count(F.lit(1)).alias("fixes"))
    steps = fix_steps(df, tie).groupBy("subject").agg(
        F.avg("km").alias("mean_km"), F.max("km").alias("max_km"),
        pct(count_if(F.col("km") < 0.1), F.count("km")).alias("stationary_pct"))
    return places.join(steps, "subject")


def location_spread(df: DataFrame, wide: float = 0.5) -> DataFrame:
    out = fixes(df).groupBy("subject").agg(
        F.count(F.lit(1)).alias("fixes"), F.sqrt(F.var_samp("lat") + F.var_samp("lon")).alias("spread"))
    return out.select("*", F.coalesce(F.col("spread") > wide, F.lit(False)).alias("wide_area"))


def location_profile(df: DataFrame, kmh: float = 200, areas: DataFrame | None = None, wide: float = 0.5, full: bool = False) -> DataFrame:
    """HIGH for impossible travel or closeness to a listed point, MEDIUM for a wide area;
    subjects with fewer than two fixes have no level.  ``impossible`` and ``clusters`` stop at 5
    and 10 as the reference's lists do; ``full`` adds ``all_impossible`` and ``all_clusters``."""
    base = location_spread(df, wide)
    travel = impossible_travel(df, kmh, limit=None).groupBy("subject").agg(F.count(F.lit(1)).alias("impossible"))
    near = near_areas(df, areas).groupBy("subject").agg(F.count(F.lit(1)).alias("areas"))
    clusters = location_clusters(df, k=None).groupBy("subject").agg(F.count(F.lit(1)).alias("clusters"))
    out = base.join(travel, "subject", "left").join(near, "subject", "left").join(clusters, "subject", "left")
    out = listed(out, {"impossible": 5, "clusters": 10}, full).fillna(0, ["areas"]).filter("fixes >= 2")
    return out.select("*", level(((F.col("impossible") > 0) | (F.col("areas") > 0), "HIGH"), (F.col("wide_area"), "MEDIUM")).alias("level"))
