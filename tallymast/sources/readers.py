"""Call, session and tower files as canonical DataFrames."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema, tables
from ..normalize import deduplicate, normalize_cdr, normalize_ipdr, normalize_tower, rename
from .xlsx import read_xlsx

log = logging.getLogger(__name__)

CDR_ALIASES = {name: [name, header] for name, header in tables.CDR_COLUMNS.items()}
CDR_ALIASES["lat"].append("lat")
CDR_ALIASES["lon"] += ["long", "lon"]
IPDR_ALIASES = {name: [name] for name in tables.IPDR_COLUMNS}
CDR_REQUIRED = ["a_party", "b_party", "date", "time", "call_type"]


def _split(paths: str | Sequence[str]) -> list[str]:
    parts = paths.split(",") if isinstance(paths, str) else list(paths)
    return [p.strip() for p in parts if p and p.strip()]


def _format(path: str) -> str:
    tail = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    return {"csv": "csv", "xlsx": "xlsx", "parquet": "parquet", "json": "json"}.get(tail, "")


def _formats(spark: SparkSession, path: str) -> list[str]:
    """Format by the name of the path, or those of the files in a folder; only names are read."""
    if _format(path) or path.lower().endswith(".xls"):  # the old binary workbooks are not supported
        return [_format(path)]
    files = lambda ext: spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").load(path).select("path")
    try:
        return [k for k in ("csv", "xlsx", "parquet", "json") if not files(k).isEmpty()] or [""]
    except PySparkException as e:
        raise ValueError(f"unsupported file type or no such path: {path}") from e


def _csv(spark: SparkSession, path: str, names: str) -> list[DataFrame]:
    """One frame for every header line among the files: Spark would apply the header of one file to all.
    The beginnings of the files give the headers; their number is that of export formats, not of files."""
    read = lambda p: spark.read.option("header", True).option("mode", "PERMISSIVE").option("pathGlobFilter", names).csv(p)
    lines = spark.read.option("pathGlobFilter", names).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    first = lines.filter("at = 0").withColumn("n", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "n").alias("header"))
    headers = [r["header"] for r in first.select("header").distinct().collect()]
    if len(headers) < 2:
        return [read(path)]
    files = lambda h: [r["file"] for r in first.filter(F.col("header") == h).select("file").toLocalIterator()]
    return [read(sorted(files(h))) for h in sorted(headers)]


def _numbered(df: DataFrame) -> DataFrame:
    """``event_id`` is that of the source, or else the place of the record: rises along every file, and from
    one part of the union (a path, or a header) to the next.  One numbering of all parts, 2**31 tasks of
    2**33 records, so no two meet; needs no shuffle."""
    return df.withColumn("event_id", F.coalesce("event_id", F.monotonically_increasing_id()))


def _raw(spark: SparkSession, path: str, aliases: dict, required: Sequence[str] = (), fmt: str | None = None) -> list[DataFrame]:
    """One path (file, folder or glob) with ``source_file``, a frame for every layout found there."""
    if fmt is None:
        kinds = _formats(spark, path)
        if len(kinds) > 1 or kinds[0] != _format(path):
            return [df for k in kinds for df in _raw(spark, path, aliases, required, k)]
    names = "*" if fmt is None or path.rstrip("/*").lower().endswith(f".{fmt}") else f"*.{fmt}"
    fmt = fmt or _format(path)
    if fmt == "xlsx":
        headers = {a.lower().replace("_", " "): a for names in aliases.values() for a in names}  # one per name
        return [read_xlsx(spark, path, list(headers.values()), [aliases[r] for r in required], names)]
    if fmt == "csv":
        found = _csv(spark, path, names)
    elif fmt == "json":
        found = [spark.read.option("multiLine", True).option("pathGlobFilter", names).json(path)]
    elif fmt == "parquet":
        found = [spark.read.option("pathGlobFilter", names).parquet(path)]
    else:
        raise ValueError(f"unsupported file type: {path}")
    return [df.withColumn("source_file", F.col("_metadata.file_path")) for df in found]


def _known(df: DataFrame, aliases: dict, merge: bool) -> DataFrame:
    """Canonical names; ``event_id`` is that of the source, null without one."""
    named = rename(df, {**aliases, "source_file": ["source_file"], "event_id": ["event_id"]}, merge=merge)
    return named.withColumn("event_id", F.col("event_id").cast("string").try_cast("bigint"))


def _read_all(spark, paths, aliases, required, fmt) -> DataFrame | None:
    """Union of the readable paths that have the required columns; others are logged and skipped.

    Only metadata is looked at here.  A path may be a folder or glob with any number of files."""
    good = []
    for path in _split(paths):
        try:
            found = _raw(spark, path, aliases, required, fmt)
        except (PySparkException, ValueError) as e:
            log.warning("skipped %s: %s", path, e)
            continue
        for raw in found:
            flat = {c.strip().lower().replace("_", " ") for c in raw.columns}
            absent = [r for r in required if not any(a.lower().replace("_", " ") in flat for a in aliases[r])]
            if absent:
                log.warning("skipped %s: no column for %s", path, absent)
                continue
            good.append(_known(raw, aliases, merge=_is_workbook(raw)))
    return reduce(lambda a, b: a.unionByName(b), good) if good else None


def _is_workbook(raw: DataFrame) -> bool:
    """Workbooks show every alias as a column, see :func:`read_xlsx`."""
    return "source_file" == raw.columns[-1] and all(f.dataType.simpleString() == "string" for f in raw.schema) and "_workbook" in raw.schema["source_file"].metadata


def _empty(spark: SparkSession, layout) -> DataFrame:
    return spark.createDataFrame([], layout)


def read_cdr(spark: SparkSession, paths: str | Sequence[str], fmt: str | None = None, **kw) -> DataFrame:
    """Call records from csv, xlsx or parquet; the subject comes from the file name."""
    raw = _read_all(spark, paths, CDR_ALIASES, CDR_REQUIRED, fmt)
    return _empty(spark, schema.CDR) if raw is None else _numbered(normalize_cdr(raw, **kw))


def read_ipdr(spark: SparkSession, paths: str | Sequence[str], fmt: str | None = None, **kw) -> DataFrame:
    """Sessions from csv, xlsx or parquet; a comma-separated list is split."""
    raw = _read_all(spark, paths, IPDR_ALIASES, ["start_time", "destination_port", "data_volume_up", "data_volume_down"], fmt)
    return _empty(spark, schema.IPDR) if raw is None else _numbered(normalize_ipdr(raw, **kw))


def _dump(spark: SparkSession, path: str, fmt: str | None, **kw) -> DataFrame:
    kinds = [fmt] if fmt else _formats(spark, path)
    if not set(kinds) <= {"csv", "xlsx", "parquet"}:
        raise ValueError(f"unsupported file type: {path}")
    raw = [df for k in kinds for df in _raw(spark, path, tables.TOWER_ALIASES, fmt=k)]
    known = [_known(df, tables.TOWER_ALIASES, _is_workbook(df)) for df in raw]
    return normalize_tower(reduce(lambda a, b: a.unionByName(b), known), **kw)


def read_tower_dump(spark: SparkSession, path: str, fmt: str | None = None, **kw) -> DataFrame:
    """One dump: a file, or a folder of files.  Any file type but csv, xlsx and parquet is an error."""
    return _numbered(_dump(spark, path, fmt, **kw))


def read_tower_dumps(spark: SparkSession, paths: str | Sequence[str], fmt: str | None = None) -> DataFrame:
    """Several dumps, tagged with their file and de-duplicated on (timestamp, number, tower)."""
    dumps = []
    for path in _split(paths):
        try:
            dumps.append(_dump(spark, path, fmt))
        except (PySparkException, ValueError) as e:
            log.warning("skipped %s: %s", path, e)
    if not dumps:
        return _empty(spark, schema.TOWER)
    return deduplicate(_numbered(reduce(lambda a, b: a.unionByName(b), dumps)), order=("event_id",))


def read_towers(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Tower dimension from csv, xlsx, json or parquet; the coverage radius defaults to 1 km."""
    found = [rename(df, tables.TOWER_DIM_ALIASES, merge=_is_workbook(df)) for df in _raw(spark, path, tables.TOWER_DIM_ALIASES, fmt=fmt)]
    raw = reduce(lambda a, b: a.unionByName(b), found)
    number = lambda c: F.col(c).try_cast("double")
    return raw.select(
        F.trim(F.col("tower_id").cast("string")).alias("tower_id"), number("lat").alias("lat"), number("long").alias("long"),
        *[F.col(c).cast("string").alias(c) for c in ("address", "area", "city", "state")],
        F.coalesce(number("coverage_radius"), F.lit(1.0)).alias("coverage_radius"))
