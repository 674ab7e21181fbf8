"""Result tables out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_towers(towers: DataFrame, path: str, ids: Sequence[str] | None = None, fmt: str = "json") -> None:
    out = towers.filter(F.col("tower_id").isin(list(ids))) if ids else towers
    write_result(out, path, fmt)


def consolidate(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Frames of several subjects as one, labelled with their key."""
    labelled = [df.withColumn("subject", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Write a table.  Text formats cannot hold lists, so lists become separated text there."""
    if fmt == "csv":
        df = df.select(*[
            F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if t.startswith("array") else F.col(c)
            for c, t in df.dtypes])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
