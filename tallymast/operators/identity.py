"""Tower dumps: numbers, SIMs and devices over time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.scalar import count_if, seconds_between, us
from ..plans.joins import counted_pairs
from ..plans.shards import neighbours, row_numbers
from .cdr import TIE


def spans(df: DataFrame, *keys: str) -> DataFrame:
    """First seen, last seen and records of every combination of ``keys`` (nulls left out)."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(known).groupBy(*keys).agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("records"))


def _several(df: DataFrame, one: str, many: str, name: str) -> DataFrame:
    """Spans of (one, many) for those with more than one ``many``.  The count is an aggregate
    joined back, so a value with very many partners is not one window partition."""
    per = spans(df, one, many)
    counts = per.groupBy(one).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)
    return per.join(counts, one)


def imei_timeline(df: DataFrame, high: int = 3) -> DataFrame:
    return _several(df, "mobile_number", "imei", "imei_count").withColumn("high_risk", F.col("imei_count") >= high)


def imei_mean(df: DataFrame) -> DataFrame:
    """Numbers with several devices and their mean number of devices."""
    per = df.filter(F.col("imei").isNotNull()).groupBy("mobile_number").agg(F.count_distinct("imei").alias("n")).filter("n > 1")
    return per.agg(F.count(F.lit(1)).alias("numbers"), F.avg("n").alias("mean_imeis"))


def _changes(df: DataFrame, key: str, value: str) -> DataFrame:
    steps = neighbours(spans(df, key, value), [key], "first_seen", prev={"_from": value, "_left": "last_seen"}, tie=[value])
    gap = (us("first_seen") - us("_left"))
    return steps.filter(F.col("_from").isNotNull()).withColumn("_gap", gap)


def rapid_imei(df: DataFrame, hours: float = 24) -> DataFrame:
    """Next device first seen within ``hours`` after the last record of the one before."""
    steps = _changes(df, "mobile_number", "imei").filter((F.col("_gap") >= 0) & (F.col("_gap") <= int(hours * 3600e6)))
    return steps.select("mobile_number", F.col("_from").alias("from_imei"), F.col("imei").alias("to_imei"), F.col("first_seen").alias("changed_at"),
                        (F.col("_gap") / 3600e6).alias("gap_hours"))


def device_sharing(df: DataFrame, many_sims: int = 5) -> DataFrame:
    """Devices used with several SIMs or numbers."""
    per = df.filter(F.col("imei").isNotNull()).groupBy("imei").agg(
        F.count_distinct("imsi").alias("sims"), F.count_distinct("mobile_number").alias("numbers"), F.count(F.lit(1)).alias("records"))
    return per.filter((F.col("sims") > 1) | (F.col("numbers") > 1)).select(
        "*", (F.col("sims") >= many_sims).alias("many_sims"), (F.col("numbers") > F.col("sims")).alias("more_numbers_than_sims"))


def sim_timeline(df: DataFrame) -> DataFrame:
    """Per (device, SIM) of shared devices: span and how many numbers."""
    shared = device_sharing(df).select("imei")
    per = df.filter(F.col("imei").isNotNull() & F.col("imsi").isNotNull()).join(shared, "imei", "left_semi")
    return per.groupBy("imei", "imsi").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count_distinct("mobile_number").alias("numbers"))


def sim_swap(df: DataFrame) -> DataFrame:
    """Numbers with several SIMs; rapid if a SIM was first seen 0-1 whole days after the last."""
    rows = df.filter(F.col("imei").isNotNull())
    per = spans(rows, "mobile_number", "imsi").groupBy("mobile_number").agg(F.count(F.lit(1)).alias("imsi_count")).filter("imsi_count > 1")
    days = F.floor(F.col("_gap") / 86_400_000_000)
    rapid = _changes(rows, "mobile_number", "imsi").groupBy("mobile_number").agg(F.bool_or(days.between(0, 1)).alias("rapid"))
    return per.join(rapid, "mobile_number")


def imei_simultaneous(df: DataFrame, seconds: float = 300, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    """Consecutive records of a device at two towers within ``seconds``."""
    rows = df.filter(F.col("imei").isNotNull()).select("imei", "timestamp", "tower_id", "mobile_number", F.col(lat).alias("lat"), F.col(lon).alias("lon"), *tie)
    steps = neighbours(rows, ["imei"], "timestamp", next={"to_time": "timestamp", "to_tower": "tower_id", "to_number": "mobile_number", "to_lat": "lat", "to_lon": "lon"}, tie=tie)
    gap = us("to_time") - us("timestamp")
    return steps.filter((gap <= int(seconds * 1e6)) & (F.col("to_tower") != F.col("tower_id"))).select(
        "imei", "timestamp", "to_time", F.col("tower_id").alias("from_tower"), "to_tower", F.col("mobile_number").alias("from_number"), "to_number",
        haversine_km("lat", "lon", "to_lat", "to_lon").alias("km"))


def imei_impossible(df: DataFrame, kmh: float = 500, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    from .movement import impossible_travel

    return impossible_travel(df.filter(F.col("imei").isNotNull()), "imei", kmh, lat, lon, tie)


def device_handover(df: DataFrame, min_days: int = 30, min_records: int = 100, within_days: int = 30) -> DataFrame:
    """A device that passed from an established user to another within ``within_days``; the last
    such pair of a device, with the number of users from then on."""
    users = row_numbers(spans(df, "imei", "mobile_number"), ["imei"], "first_seen", ["mobile_number"], "_no")
    totals = users.groupBy("imei").agg(F.count(F.lit(1)).alias("_users"))
    steps = neighbours(users, ["imei"], "first_seen", prev={
        "_who": "mobile_number", "_from": "first_seen", "_to": "last_seen", "_n": "records"}, tie=["mobile_number"])
    day = 86_400_000_000
    used, gap = F.floor((us("_to") - us("_from")) / day), F.floor((us("first_seen") - us("_to")) / day)
    hits = steps.filter((used >= min_days) & (F.col("_n") >= min_records) & gap.between(0, within_days))
    last = hits.groupBy("imei").agg(F.max(F.struct("_no", F.col("_who").alias("original"), used.alias("used_days"), F.col("_n").alias("used_records"),
                                                   F.col("mobile_number").alias("successor"), gap.alias("gap_days"))).alias("l"))
    return last.join(totals, "imei").select("imei", "l.original", "l.used_days", "l.used_records", "l.successor", "l.gap_days",
                                            (F.col("_users") - F.col("l._no") + 1).alias("later_users"))


def identity_maps(df: DataFrame) -> DataFrame:
    """Numbers per device, devices per number, SIMs per device: those with more than one."""
    def side(kind, one, many):
        per = df.filter(F.col(one).isNotNull()).groupBy(F.col(one).alias("key")).agg(F.count_distinct(many).alias("partners"))
        return per.filter("partners > 1").select(F.lit(kind).alias("kind"), "key", "partners")

    return reduce(DataFrame.unionByName, [
        side("numbers_per_imei", "imei", "mobile_number"), side("imeis_per_number", "mobile_number", "imei"), side("imsis_per_imei", "imei", "imsi")])


def device_pairs(df: DataFrame, least: int = 1) -> DataFrame:
    """Number pairs that used the same device, with how many devices they share: at least ``least``.

    With more than one, a device that is among the ``least - 1`` most shared of all its numbers, as a
    placeholder IMEI is, makes no pairs (``counted_pairs``); it counts for pairs that share others too.
    """
    links = df.filter(F.col("imei").isNotNull()).select("imei", "mobile_number").distinct()
    return counted_pairs(links, ["imei"], "mobile_number", least, "devices")


def identity_totals(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count("imei").alias("imeis"), count("imsi").alias("imsis"), count("mobile_number").alias("numbers"))


def identity_overview(df: DataFrame, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE, **handover) -> DataFrame:
    """Totals, and how much the identity operators found."""
    count = lambda name, frame: frame.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("item"), "value")
    t = identity_totals(df)
    totals = t.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in t.columns])))
    return reduce(DataFrame.unionByName, [
        totals, count("numbers_with_several_imeis", df.filter("imei IS NOT NULL").groupBy("mobile_number").agg(F.count_distinct("imei").alias("n")).filter("n > 1")),
        count("shared_devices", device_sharing(df)), count("simultaneous_use", imei_simultaneous(df, lat=lat, lon=lon, tie=tie)),
        count("handovers", device_handover(df, **handover))])
