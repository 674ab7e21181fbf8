"""What several operators of the subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: texts may be long, and a batch is held in a Python worker.
BATCH_ROWS = 1_000


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of ``folder``, read with the named columns only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(doc_id: str | Column, folds: int = 5) -> Column:
    """Remainder of the CRC-32 of the id written as text; a null id falls into fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds, F.lit(0))


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 0


def training_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids outside fold 0, those of the smallest id hash: a sample that
    does not depend on the order of the rows.  An id labelled several times counts by its mean."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    means = known.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    return means.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def some_texts(docs: DataFrame, most: int) -> DataFrame:
    """(h, text) of at most ``most`` different texts, those of the smallest hash.  Only hashes are sorted."""
    hashed = docs.select(F.xxhash64("text").alias("h"), "text").where("text is not null")
    last = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return hashed.where(F.col("h") <= F.lit(0 if last is None else last)).groupBy("h").agg(F.min("text").alias("text"))


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder not there yet, below the shared folder that ``spark.checkpoint.dir`` names."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="tallymast-llm-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and read again: later steps
    neither repeat the work nor lose it with an executor, and read only the columns they need."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
