"""Validation and quality of the three record kinds, as metric rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import tables
from ..functions.scalar import count_if, pct, seconds_between, us
from ..plans.shards import neighbours
from .cdr import TIE

PHONE = r"^[6-9]\d{9}$"


# -- call records ------------------------------------------------------------------------

def cdr_column_report(df: DataFrame, expected: Sequence[str] = tuple(tables.CDR_COLUMNS)) -> DataFrame:
    """Present, missing and extra columns with the number of filled values, and the match share."""
    have = set(df.columns)
    rows = [(c, "PRESENT" if c in have else "MISSING") for c in expected]
    rows += [(c, "EXTRA") for c in df.columns if c not in expected]
    share = 100.0 * sum(s == "PRESENT" for _, s in rows) / len(expected)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"_{c}") for c in df.columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(s).alias("status"),
                 (F.lit(0).cast("bigint") if s == "MISSING" else F.col(f"`_{c}`")).alias("filled"), F.lit(share).alias("match_pct"))
        for c, s in rows])))


def _service(c: str) -> Column:
    import re

    codes = "|".join(re.escape(p) for p in tables.PROVIDER_CODES)
    return F.trim(c).rlike(f"(?:{codes})|^[A-Z]{{2}}-")


def _readable_date(c: str) -> Column:
    text = F.trim(F.col(c).cast("string"))
    formats = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy/MM/dd")
    tries = [F.try_to_timestamp(F.substring(text, 1, 10), F.lit(f)) for f in formats]
    return F.coalesce(*tries).isNotNull()


def _cdr_rules() -> dict[str, tuple[Column, Column]]:
    """field -> (counted in the total, valid)."""
    number = F.col("duration").try_cast("double")
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    rules = {
        "a_party": F.trim("a_party").rlike(PHONE),
        "b_party": F.trim("b_party").rlike(PHONE) | _service("b_party"),
        "date": _readable_date("date"),
        "time": F.trim("time").rlike(r"^\d{1,2}:\d{2}:\d{2}"),
        "duration": number >= 0,
        "call_type": F.trim("call_type").isin(tables.CALL_TYPES),
        "imei": F.trim("imei").rlike(r"^\d{15}$"),
        "imsi": F.trim("imsi").rlike(r"^\d{15}$"),
    }
    out = {name: (F.col(name).isNotNull(), F.coalesce(cond, F.lit(False))) for name, cond in rules.items()}
    out["coordinates"] = (F.col("lat").isNotNull(), F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)))
    return out


def cdr_field_quality(df: DataFrame, samples: int = 5, tie: Sequence[str] = TIE) -> DataFrame:
    """One row per field: valid, invalid, share over non-null values, the first few bad values.

    One pass counts every field; only bad values are melted for the samples, and each map
    partition keeps at most ``samples`` of them per field.
    """
    rules = _cdr_rules()
    totals = df.agg(
        *[count_if(known).alias(f"{n}_n") for n, (known, _) in rules.items()],
        *[count_if(known & ok).alias(f"{n}_ok") for n, (known, ok) in rules.items()],
        count_if(_service("b_party")).alias("service"),
        count_if(F.trim("b_party").rlike(PHONE) & ~_service("b_party")).alias("phone"))
    none = F.lit(None).cast("bigint")
    stacked = totals.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("field"), F.col(f"{n}_ok").alias("valid"), (F.col(f"{n}_n") - F.col(f"{n}_ok")).alias("invalid"),
                 pct(F.col(f"{n}_ok"), F.col(f"{n}_n")).alias("valid_pct"),
                 (F.col("phone") if n == "b_party" else none).alias("phone_numbers"),
                 (F.col("service") if n == "b_party" else none).alias("service_codes"))
        for n in rules])))
    value = lambda n: F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")) if n == "coordinates" else F.col(n).cast("string")
    bad = df.select(*tie, F.explode(F.array_compact(F.array(*[
        F.when(known & ~ok, F.struct(F.lit(n).alias("field"), value(n).alias("value"))) for n, (known, ok) in rules.items()]))).alias("b"))
    w = Window.partitionBy("field").orderBy(*tie)
    few = bad.select(*tie, "b.*").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= samples)
    lists = few.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("_n", "value"))).alias("_s")).select(
        "field", F.col("_s.value").alias("samples"))
    return stacked.join(F.broadcast(lists), "field", "left")


def call_type_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("call_type").agg(F.count(F.lit(1)).alias("records"))


def cdr_quality_score(df: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    """Mean of the column match and of all field shares."""
    columns = cdr_column_report(df).select(F.col("match_pct").alias("p")).limit(1)
    fields = cdr_field_quality(df, tie=tie).select(F.col("valid_pct").alias("p"))
    return columns.unionByName(fields).agg(F.avg("p").alias("quality_score"))


# -- sessions ----------------------------------------------------------------------------

def ipdr_column_report(df: DataFrame) -> DataFrame:
    """Completeness per column, with missing and unexpected columns marked."""
    have = [c for c in df.columns]
    counts = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(f"_{c}") for c in have])
    absent = [c for c in tables.IPDR_REQUIRED if c not in have]
    kind = lambda c: "REQUIRED" if c in tables.IPDR_REQUIRED else "OPTIONAL" if c in tables.IPDR_COLUMNS else "UNEXPECTED"
    cells = [F.struct(F.lit(c).alias("column"), F.lit(kind(c)).alias("status"), pct(F.col(f"_{c}"), F.col("_all")).alias("complete_pct")) for c in have]
    cells += [F.struct(F.lit(c).alias("column"), F.lit("MISSING").alias("status"), F.lit(0.0).alias("complete_pct")) for c in absent]
    return counts.select(F.inline(F.array(*cells)))


def ipdr_type_report(df: DataFrame) -> DataFrame:
    """Kind of type expected and found per column, with the number of filled values."""
    kinds = {"start_time": "datetime", "end_time": "datetime"}
    kinds |= {c: "numeric" for c in ("destination_port", "source_port", "data_volume_up", "data_volume_down", "session_duration")}
    kinds |= {c: "string" for c in ("subscriber_id", "imei", "imsi", "destination_ip", "source_ip", "protocol", "app_protocol")}
    test = {"datetime": (T.TimestampType, T.TimestampNTZType), "numeric": (T.NumericType,), "string": (T.StringType,)}
    rows = [(f.name, kinds[f.name], f.dataType.simpleString(), isinstance(f.dataType, test[kinds[f.name]]))
            for f in df.schema.fields if f.name in kinds]
    counts = df.agg(*[F.count(c).alias(f"_{c}") for c, *_ in rows])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(e).alias("expected"), F.lit(a).alias("actual"), F.lit(ok).alias("ok"), F.col(f"_{c}").alias("filled"))
        for c, e, a, ok in rows])))


def ipdr_quality(df: DataFrame) -> DataFrame:
    """Cell completeness, full-row duplicates (all but the first) and rows that end before they start.

    Duplicates collapse into counts before the shuffle."""
    per = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in df.columns])
    out = per.agg(
        F.sum("_n").alias("rows"), (F.sum(filled * F.col("_n")) * 100.0 / (F.sum("_n") * len(df.columns))).alias("complete_pct"),
        F.sum(F.col("_n") - 1).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("end_time") < F.col("start_time"), F.col("_n"))), F.lit(0)).alias("ends_before_start"))
    return out.select("*", pct(F.col("duplicates"), F.col("rows")).alias("duplicate_pct"),
                      pct(F.col("rows") - F.col("ends_before_start"), F.col("rows")).alias("consistent_pct"))


def ipdr_temporal_quality(df: DataFrame, as_of) -> DataFrame:
    """Range, span in whole days, rows after ``as_of`` and rows more than 365 days before it."""
    now = F.lit(as_of).cast("timestamp")
    return df.filter(F.col("start_time").isNotNull()).agg(
        F.min("start_time").alias("earliest"), F.max("start_time").alias("latest"),
        F.floor((F.max(us("start_time")) - F.min(us("start_time"))) / 86_400_000_000).alias("span_days"),
        count_if(F.col("start_time") > now).alias("future_rows"),
        count_if(F.col("start_time") < now - F.expr("INTERVAL 365 DAYS")).alias("old_rows"))


def ipdr_network_quality(df: DataFrame) -> DataFrame:
    port = F.col("destination_port")
    return df.agg(
        count_if((port < 1) | (port > 65535)).alias("bad_ports"),
        count_if(~F.col("destination_ip").rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")).alias("bad_ips"))


def ipdr_top_ports(df: DataFrame, k: int = 10) -> DataFrame:
    per = df.filter(F.col("destination_port").isNotNull()).groupBy("destination_port").agg(F.count(F.lit(1)).alias("sessions"))
    return per.orderBy(F.desc("sessions"), "destination_port").limit(k)


def ipdr_volume_quality(df: DataFrame) -> DataFrame:
    cols = ("data_volume_up", "data_volume_down")
    pieces = []
    for c in cols:
        pieces += [count_if(F.col(c) < 0).alias(f"{c}_neg"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"),
                   F.avg(c).alias(f"{c}_mean"), (F.sum(F.col(c).cast("double")) / 1073741824.0).alias(f"{c}_gb")]
    return df.agg(*pieces).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}_neg").alias("negatives"), F.col(f"{c}_min").cast("double").alias("min"),
                 F.col(f"{c}_max").cast("double").alias("max"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_gb").alias("total_gb"))
        for c in cols])))


def ipdr_quick_quality(df: DataFrame) -> DataFrame:
    """Light check: completeness of the start time and the port, and their mean."""
    out = df.agg((F.count("start_time") / F.count(F.lit(1))).alias("timestamp_completeness"),
                 (F.count("destination_port") / F.count(F.lit(1))).alias("port_completeness"))
    absent = [c for c in ("start_time", "destination_port", "data_volume_up", "data_volume_down") if c not in df.columns]
    return out.select("*", ((F.col("timestamp_completeness") + F.col("port_completeness")) / 2).alias("overall_score"),
                      F.lit(not absent).alias("is_valid"))


def ipdr_quality_report(df: DataFrame, as_of) -> DataFrame:
    """All session checks in long form ``(check, item, severity, value)``."""
    columns = ipdr_column_report(df)
    cols = columns.select(F.lit("completeness").alias("check"), F.col("column").alias("item"),
                          F.when(F.col("status") == "MISSING", "ERROR").when(F.col("status") == "UNEXPECTED", "WARNING").otherwise("INFO").alias("severity"),
                          F.col("complete_pct").alias("value"))
    types = ipdr_type_report(df).filter("NOT ok").select(F.lit("type").alias("check"), F.col("column").alias("item"),
                                                         F.lit("ERROR").alias("severity"), F.lit(1.0).alias("value"))
    q = ipdr_quality(df)
    flat = lambda frame, items: frame.select(F.inline(F.array(*items)))
    sev = lambda c, bad: F.when(F.col(c) > 0, bad).otherwise("INFO")
    item = lambda check, name, severity, c: F.struct(F.lit(check).alias("check"), F.lit(name).alias("item"), severity.alias("severity"), F.col(c).cast("double").alias("value"))
    overall = flat(q, [item("quality", "complete_pct", F.lit("INFO"), "complete_pct"), item("quality", "duplicates", sev("duplicates", "WARNING"), "duplicates"),
                       item("quality", "duplicate_pct", F.lit("INFO"), "duplicate_pct"),
                       item("quality", "ends_before_start", sev("ends_before_start", "ERROR"), "ends_before_start")])
    t = ipdr_temporal_quality(df, as_of)
    times = flat(t, [item("time", "span_days", F.lit("INFO"), "span_days"), item("time", "future_rows", sev("future_rows", "ERROR"), "future_rows"),
                     item("time", "old_rows", sev("old_rows", "WARNING"), "old_rows")])
    n = ipdr_network_quality(df)
    net = flat(n, [item("network", "bad_ports", sev("bad_ports", "ERROR"), "bad_ports"), item("network", "bad_ips", sev("bad_ips", "WARNING"), "bad_ips")])
    vol = ipdr_volume_quality(df).select(F.lit("volume").alias("check"), F.concat("column", F.lit("_negatives")).alias("item"),
                                         sev("negatives", "ERROR").alias("severity"), F.col("negatives").cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [cols, types, overall, times, net, vol])


def ipdr_recommendations(report: DataFrame) -> DataFrame:
    """Codes from the long report; a table is valid if it has no error."""
    is_item = lambda name: F.col("item") == name
    out = report.agg(
        count_if(F.col("severity") == "ERROR").alias("errors"), count_if(F.col("severity") == "WARNING").alias("warnings"),
        count_if((F.col("check") == "completeness") & (F.col("severity") == "ERROR")).alias("_missing"),
        count_if((F.col("check") == "type") & F.col("item").isin("start_time", "end_time")).alias("_times"),
        F.max(F.when(is_item("complete_pct"), F.col("value"))).alias("_complete"), F.max(F.when(is_item("duplicate_pct"), F.col("value"))).alias("_dup"))
    return out.select("errors", "warnings", (F.col("errors") == 0).alias("is_valid"), F.array_compact(F.array(
        F.when(F.col("_missing") > 0, "ADD_REQUIRED_COLUMNS"), F.when(F.col("_times") > 0, "CONVERT_TIMESTAMPS"),
        F.when(F.col("_complete") < 80, "IMPROVE_COMPLETENESS"), F.when(F.col("_dup") > 5, "REMOVE_DUPLICATES"),
        F.when(F.col("warnings") > 3, "REVIEW_EXPORT"))).alias("recommendations"))


# -- tower dumps -------------------------------------------------------------------------

def tower_structure(df: DataFrame) -> DataFrame:
    """Missing required columns, number of records and whether there are none."""
    absent = [c for c in tables.TOWER_REQUIRED if c not in df.columns]
    some = df.agg(F.count(F.lit(1)).alias("records"), (F.count(F.lit(1)) == 0).alias("empty"))
    return some.select(F.array(*[F.lit(c) for c in absent]).cast("array<string>").alias("missing"), "records", "empty",
                       (F.lit(not absent) & ~F.col("empty")).alias("ok"))


def tower_quality(df: DataFrame, lat: str = "lat", lon: str = "long") -> DataFrame:
    """Per column: nulls where a value is required, pattern mismatches, range violations."""
    patterns = {"mobile_number": r"^\d{10}$", "imei": r"^\d{15}$", "imsi": r"^\d{15}$"}
    checks: list[tuple[str, str, Column]] = [(c, "NULL", F.col(c).isNull()) for c in tables.TOWER_REQUIRED if c in df.columns]
    checks += [(c, "PATTERN", ~F.col(c).cast("string").rlike(p)) for c, p in patterns.items() if c in df.columns]
    checks += [(c, "RANGE", ~F.col(c).between(-e, e)) for c, e in ((lat, 90), (lon, 180)) if c in df.columns]
    out = df.agg(F.count(F.lit(1)).alias("_all"), *[count_if(cond).alias(f"_{i}") for i, (_, _, cond) in enumerate(checks)])
    return out.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("problem"), F.col(f"_{i}").alias("rows"), pct(F.col(f"_{i}"), F.col("_all")).alias("rows_pct"))
        for i, (c, kind, _) in enumerate(checks)])))


def _time_order(df: DataFrame, tie: Sequence[str]) -> DataFrame:
    """One row: whether times never go back in record order.

    Range partitions of the record id are walked where they lie; each gives one row with its
    first and last time, and only these rows are compared with each other."""
    rows = df.select(F.col(tie[0]).alias("id"), us("timestamp").alias("at"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")

    def walk(batches):
        import pandas as pd

        first = last = None
        low, good = None, True
        for pdf in batches:
            if not len(pdf):
                continue
            at = pdf["at"]
            good = good and at.is_monotonic_increasing and (last is None or at.iloc[0] >= last)
            if first is None:
                first, low = at.iloc[0], pdf["id"].iloc[0]
            last = at.iloc[-1]
        if first is not None:
            yield pd.DataFrame([(low, first, last, good)], columns=["low", "first", "last", "good"])

    parts = rows.mapInPandas(walk, "low bigint, first bigint, last bigint, good boolean")
    across = Window.orderBy("low")  # one row per partition
    jump = F.coalesce(F.lag("last").over(across) > F.col("first"), F.lit(False))
    return parts.withColumn("_jump", jump).agg(F.coalesce(F.bool_and(F.col("good") & ~F.col("_jump")), F.lit(True)).alias("in_time_order"))


def tower_pattern_quality(df: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    """Members of duplicate groups, and whether record order is time order."""
    groups = df.groupBy("timestamp", "mobile_number", "tower_id").agg(F.count(F.lit(1)).alias("n"))
    dups = groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_members"))
    return dups.withColumn("_k", F.lit(1)).join(_time_order(df, tie).withColumn("_k", F.lit(1)), "_k").drop("_k")


def rapid_switching(df: DataFrame, secs: float = 60, tie: Sequence[str] = TIE) -> DataFrame:
    """Numbers whose consecutive tower changes (the first record counts as one) are less than
    ``secs`` apart, with how often."""
    rows = df.select("mobile_number", "timestamp", "tower_id", *tie)
    steps = neighbours(rows, ["mobile_number"], "timestamp", prev={"_prev": "tower_id"}, tie=tie)
    changes = steps.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("tower_id"))).drop("_prev")
    gaps = neighbours(changes, ["mobile_number"], "timestamp", prev={"_before": "timestamp"}, tie=tie)
    return gaps.filter(seconds_between("timestamp", "_before") < secs).groupBy("mobile_number").agg(F.count(F.lit(1)).alias("switches"))


def multi_imei(df: DataFrame, n: int = 3) -> DataFrame:
    per = df.filter(F.col("imei").isNotNull()).groupBy("mobile_number").agg(F.array_sort(F.collect_set("imei")).alias("imeis"))
    return per.filter(F.size("imeis") >= n).select("mobile_number", F.size("imeis").alias("imei_count"), "imeis")


def new_sim_activity(df: DataFrame, days: int = 7, more_than: int = 10) -> DataFrame:
    out = df.groupBy("mobile_number").agg(
        F.min("timestamp").alias("first_seen"), F.count(F.lit(1)).alias("records"),
        F.floor((F.max(us("timestamp")) - F.min(us("timestamp"))) / 86_400_000_000).alias("span_days"))
    return out.filter((F.col("span_days") <= days) & (F.col("records") > more_than))


def one_time_numbers(df: DataFrame) -> DataFrame:
    out = df.groupBy("mobile_number").agg(F.count(F.lit(1)).alias("n"), F.min("tower_id").alias("tower_id"))
    return out.filter("n = 1").select("mobile_number", "tower_id")


def tower_statistics(df: DataFrame) -> DataFrame:
    per = df.groupBy("mobile_number").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("imei").alias("i"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    numbers = per.agg(
        F.count("mobile_number").alias("unique_numbers"), F.avg("n").alias("records_per_number"),
        count_if(F.col("i") > 1).alias("numbers_with_several_imeis"),
        (seconds_between(F.max("hi"), F.min("lo")) / 3600).alias("span_hours"))
    distinct = df.agg(F.count_distinct("tower_id").alias("unique_towers"), F.count_distinct("imei").alias("unique_imeis"))
    return numbers.withColumn("_k", F.lit(1)).join(distinct.withColumn("_k", F.lit(1)), "_k").drop("_k")


def impossible_travel(df: DataFrame, kmh: float = 200, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    from .movement import impossible_travel as travel

    return travel(df, "mobile_number", kmh, lat=lat, lon=lon, tie=tie)


def tower_quality_report(df: DataFrame, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    """Structure, quality, pattern and statistics rows plus every per-number anomaly, in one
    long table ``(kind, item, value)``.  Valid rows are counted, not inferred (F20)."""
    row = lambda kind, item, value: (F.lit(kind).alias("kind"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    q = tower_quality(df, lat, lon).select(*row("quality", F.concat_ws("/", "column", "problem"), F.col("rows")))
    p = tower_pattern_quality(df, tie)
    s = tower_statistics(df)
    st = tower_structure(df).select(*row("structure", F.lit("ok"), F.col("ok").cast("int")))
    valid = df.agg(count_if(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in tables.TOWER_REQUIRED])
                            & F.coalesce(F.col("mobile_number").rlike(r"^\d{10}$"), F.lit(False))).alias("v"))
    parts = [
        st, q, valid.select(*row("valid_records", F.lit("all"), F.col("v"))),
        p.select(*row("pattern", F.lit("duplicate_members"), F.col("duplicate_members"))),
        p.select(*row("pattern", F.lit("in_time_order"), F.col("in_time_order").cast("int"))),
        s.select(F.lit("statistic").alias("kind"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in s.columns]))),
        rapid_switching(df, tie=tie).select(*row("rapid_tower_switching", F.col("mobile_number"), F.col("switches"))),
        impossible_travel(df, lat=lat, lon=lon, tie=tie).groupBy("mobile_number").agg(F.max("kmh").alias("v")).select(*row("impossible_travel", F.col("mobile_number"), F.col("v"))),
        multi_imei(df).select(*row("multiple_imei", F.col("mobile_number"), F.col("imei_count"))),
        new_sim_activity(df).select(*row("new_sim_high_activity", F.col("mobile_number"), F.col("records"))),
        one_time_numbers(df).select(*row("one_time_visitor", F.col("mobile_number"), F.lit(1))),
    ]
    return reduce(DataFrame.unionByName, parts)
