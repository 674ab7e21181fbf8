"""Session settings the operators rely on, and lineage cutting for iterative ones."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Settings worth having on every cluster.  Only the time zone is needed for right results.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session."""
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cores: int | str = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A laptop session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallymast")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for name, value in {**SETTINGS, **extra}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors of a cluster that has not installed it: Python functions in
    tasks import it by name."""
    folder = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tallymast-"), "tallymast.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for top, _, names in os.walk(folder):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(folder)))
    spark.sparkContext.addPyFile(target)  # copied from the driver to every executor
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only in local mode, where one machine
    is all there is."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return shared or tempfile.mkdtemp(prefix="tallymast-checkpoint-")


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder not there yet, below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, columns: Sequence[str], name: str = "kept") -> DataFrame:
    """``columns`` of ``df`` written as a Parquet table in the shared folder, for what is read many times: rows are
    computed once, and each reader takes the columns it needs."""
    rows = df.select(*dict.fromkeys(columns))
    path = new_folder(df.sparkSession, name)
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder named by ``spark.checkpoint.dir``.

    Blocks on executors are lost with the executor, so nothing here is kept only there.  A
    folder of our own is used only in local mode, where one machine is all there is; a cluster
    has to name a shared one.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
