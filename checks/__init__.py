"""One entry per operator: the Spark call and an independent SQL statement of its meaning.

``check(name, sql)`` registers a function of :class:`tallymast.fixtures.Views`.  The frame it
returns is flattened to plain comparable columns: times as epoch microseconds, dates and
lists as text, floating-point values rounded to four decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymast.fixtures import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 4)
        elif isinstance(f.dataType, T.ArrayType):
            if isinstance(f.dataType.elementType, T.TimestampType):
                c = F.transform(c, lambda x: F.unix_micros(x))
            c = F.array_join(c.cast("array<string>"), "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def check(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name``; no ``sql`` means rows only."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate check {name}")
        QUERIES[name] = lambda spark, folder: plain(fn(Views(spark, folder)))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def load_all() -> None:
    import importlib
    import pkgutil

    for module in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if module.name == "compare":
            continue
        importlib.import_module(f"{__name__}.{module.name}")
