"""From source columns to the canonical layouts: renaming, cleaning, derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema, tables
from .functions import scalar as S


def rename(df: DataFrame, aliases: Mapping[str, Sequence[str]], merge: bool = False) -> DataFrame:
    """First matching alias per canonical name, ignoring case, underscores and spaces being the
    same.  Names are resolved on the driver from column metadata only; absent columns become
    null columns.  ``merge`` takes the first filled one row by row, for input that shows every
    alias as a column."""
    flat = lambda name: name.strip().lower().replace("_", " ")
    present: dict[str, str] = {}
    for c in df.columns:
        present.setdefault(flat(c), c)
    out = []
    for name, names in aliases.items():
        found = list(dict.fromkeys(present[flat(a)] for a in names if flat(a) in present))
        columns = [F.col(f"`{c}`") for c in (found if merge else found[:1])]
        out.append((F.coalesce(*columns) if columns else F.lit(None).cast("string")).alias(name))
    return df.select(*out)


def identifier(c: Column | str) -> Column:
    """Identifier text; numbers that went through a float (``123.0``, ``1.23E9``) are made whole
    again by a decimal, not by string surgery on the digits (F28)."""
    text = F.trim(S.col(c).cast("string"))
    whole = text.try_cast(T.DecimalType(20, 0)).cast("string")
    return F.when(text.rlike(r"^\d+\.0+$|^\d(\.\d+)?[eE]\+?\d+$"), whole).otherwise(text)


def record_id(df: DataFrame) -> Column:
    """Stable tie-breaker from the content of the row; needs no shuffle and no row order."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def drop_empty(df: DataFrame) -> DataFrame:
    return df.dropna("all")


def source_stem(c: Column | str) -> Column:
    """File name without folders and extension."""
    return F.url_decode(F.regexp_extract(S.col(c), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1))


def subject_key(stem: Column) -> Column:
    """``<number>_<name>`` becomes ``<name>_<number>``; anything else stays as it is."""
    number, name = F.regexp_extract(stem, r"^([^_]*)_(.*)$", 1), F.regexp_extract(stem, r"^([^_]*)_(.*)$", 2)
    return F.when(F.contains(stem, F.lit("_")), F.concat_ws("_", name, number)).otherwise(stem)


def with_subject(df: DataFrame, file_column: str = "source_file") -> DataFrame:
    return df.withColumn("subject", subject_key(source_stem(file_column)))


def _conform(df: DataFrame, layout: T.StructType) -> DataFrame:
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in layout.fields])


def normalize_cdr(raw: DataFrame, subject: Column | None = None, null_duration_as_zero: bool = True) -> DataFrame:
    """Canonical call records from the 13 source columns (:data:`schema.CDR_RAW` names)."""
    number = F.coalesce(F.col("duration").try_cast("double"), F.lit(0.0) if null_duration_as_zero else F.lit(None).cast("double"))
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    a, b = identifier("a_party"), identifier("b_party")
    when = S.cdr_timestamp("date", "time")
    out = raw.select(
        *( ["source_file"] if "source_file" in raw.columns else [] ),
        (F.col("event_id") if "event_id" in raw.columns else record_id(raw)).alias("event_id"),
        when.alias("datetime"), S.clean_phone(a).alias("a_party"), S.clean_phone(b).alias("b_party"),
        F.floor(number).cast("bigint").alias("duration_seconds"), F.trim("call_type").alias("call_type"),
        F.trim("first_cell").alias("first_cell"), F.trim("last_cell").alias("last_cell"), "address",
        identifier("imei").alias("imei"), identifier("imsi").alias("imsi"), lat.alias("lat"), lon.alias("lon"),
        S.is_provider(b).alias("is_provider_message"), F.hour(when).alias("hour"), S.day_name(when).alias("day_of_week"),
        (lat.isNotNull() & lon.isNotNull()).alias("has_location"),
    )
    key = subject if subject is not None else (
        subject_key(source_stem("source_file")) if "source_file" in raw.columns else F.col("a_party"))
    return _conform(out.withColumn("subject", key), schema.CDR)


def normalize_ipdr(raw: DataFrame, subject: Column | None = None) -> DataFrame:
    """Canonical sessions.  Without an own subject the ten-digit number of the subscriber is used."""
    out = drop_empty(raw)
    out = out.withColumn("event_id", F.col("event_id") if "event_id" in raw.columns else record_id(raw))
    clean = S.clean_subscriber(identifier("subscriber_id"))
    out = out.withColumns({
        "subscriber_id_clean": clean,
        "start_time": F.col("start_time").try_cast("timestamp"), "end_time": F.col("end_time").try_cast("timestamp"),
        "destination_port": F.col("destination_port").try_cast("double").try_cast("bigint"),
        "data_volume_up": F.col("data_volume_up").try_cast("double"),
        "data_volume_down": F.col("data_volume_down").try_cast("double"),
    })
    for name, kind in (("source_port", "bigint"), ("session_duration", "double")):
        if name in out.columns:
            out = out.withColumn(name, F.col(name).try_cast("double").try_cast(kind))
    for name in ("imei", "imsi"):
        if name in out.columns:
            out = out.withColumn(name, identifier(name))
    key = subject if subject is not None else F.coalesce(S.msisdn("subscriber_id"), F.col("subscriber_id_clean"))
    return _conform(out.withColumn("subject", key), schema.IPDR)


def clean_tower(df: DataFrame) -> DataFrame:
    """Ten-digit numbers only, 15-digit device and SIM numbers or null, trimmed tower ids,
    coordinates in range or null; rows without number or tower are dropped (F2, F28)."""
    inside = lambda c, edge: F.when(F.col(c).try_cast("double").between(-edge, edge), F.col(c).try_cast("double"))
    out = df.withColumns({
        "mobile_number": S.msisdn(identifier("mobile_number")),
        "imei": S.fifteen_digits(identifier("imei")), "imsi": S.fifteen_digits(identifier("imsi")),
        "tower_id": F.trim("tower_id"), "lat": inside("lat", 90.0), "long": inside("long", 180.0),
    })
    return out.filter(F.col("mobile_number").isNotNull() & F.col("tower_id").isNotNull())


def normalize_tower(raw: DataFrame, dump_id: Column | None = None) -> DataFrame:
    """Canonical tower connections.  A missing timestamp is built from date and time.

    The result is not sorted: every ordered operator sorts by itself, so no global sort is paid."""
    stamp = F.coalesce(
        S.tower_timestamp(F.col("timestamp").cast("string")),
        S.tower_date_time(F.col("date").cast("string"), F.col("time").cast("string")),
    )
    out = raw.withColumn("event_id", F.col("event_id") if "event_id" in raw.columns else record_id(raw))
    out = out.withColumn("timestamp", stamp).filter(F.col("timestamp").isNotNull())
    out = clean_tower(out)
    for name in ("duration", "signal_strength"):
        if name in out.columns:
            out = out.withColumn(name, F.col(name).try_cast("double"))
    key = dump_id if dump_id is not None else (
        source_stem("source_file") if "source_file" in raw.columns else F.lit("dump"))
    return _conform(out.withColumn("dump_id", key), schema.TOWER)


def with_tower_features(df: DataFrame) -> DataFrame:
    """Calendar columns (odd hours 0-5, F3) and the connection class."""
    return S.with_calendar(df, "timestamp", odd=(0, 6)).withColumn("connection_type", S.connection_type("duration"))


def deduplicate(df: DataFrame, keys: Sequence[str] = ("timestamp", "mobile_number", "tower_id"),
                order: Sequence[str] = ("source_file", "event_id")) -> DataFrame:
    """One row per key: the first by ``order``.

    An aggregate and not a window, so copies collapse before the shuffle and a key with very
    many copies is no burden on one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def filter_window(df: DataFrame, start, end, buffer_minutes: float = 0, ts: str = "timestamp") -> DataFrame:
    """Inclusive time window, widened on both sides; bounds are literals and reach the scan."""
    lo = F.lit(start).cast("timestamp") - F.expr(f"INTERVAL {int(buffer_minutes * 60)} SECONDS")
    hi = F.lit(end).cast("timestamp") + F.expr(f"INTERVAL {int(buffer_minutes * 60)} SECONDS")
    return df.filter((F.col(ts) >= lo) & (F.col(ts) <= hi))


def filter_location(df: DataFrame, towers: Sequence[str] | None = None, center: tuple[float, float] | None = None,
                    radius_km: float | None = None, lat: str = "lat", lon: str = "long") -> DataFrame:
    """By tower list, or by distance with ``distance_km`` added.  A latitude band is tested first
    and can be pushed to the scan.  A coordinate of 0.0 is a coordinate (F27)."""
    if towers:
        return df.filter(F.col("tower_id").isin(list(towers)))
    if center is None or radius_km is None:
        return df
    from .functions.geo import haversine_km

    band = radius_km / 110.0
    near = df.filter(F.col(lat).between(center[0] - band, center[0] + band))
    km = haversine_km(F.col(lat), F.col(lon), F.lit(center[0]), F.lit(center[1]))
    return near.withColumn("distance_km", km).filter(F.col("distance_km") <= radius_km)
