"""Document fingerprints: a Merkle tree over sections, paragraphs and the pieces of a paragraph.

Blank lines part sections, line ends part paragraphs, and a paragraph falls into sentences (a stretch
of more than 60 characters without a full stop, question or exclamation mark into stretches of 60).
A node's hash is that of its children's hashes, so equal roots mean equal texts, and where roots differ
one descends into the branches that do.  A fingerprint is the root and the leaves, written as

    root|leaf leaf,leaf;leaf

with ``,`` between paragraphs and ``;`` between sections (leaves are eight hexadecimal digits each
without a space between them): every inner hash can be had from it.  Spark expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

PIECE = r"(?s)[^.!?]{1,60}[.!?]*[ \t\n\x0B\f\r]*|[.!?]+[ \t\n\x0B\f\r]*"
LEAF = 8
#: Key of a null id, which comes before all others.
NULL_KEY = -(2**63)


def tree(text: str | Column) -> Column:
    """Leaf hashes as sections of paragraphs of pieces."""
    c = F.col(text) if isinstance(text, str) else text
    leaf = lambda piece: F.substring(F.sha2(piece, 256), 1, LEAF)
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), leaf)
    section = lambda s: F.transform(F.split(s, "\n"), paragraph)
    return F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n"), section)


def root(text: str | Column) -> Column:
    """Hash of the root, over full hashes of the paragraphs."""
    c = F.col(text) if isinstance(text, str) else text
    section = lambda s: F.sha2(F.array_join(F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)), ""), 256)
    return F.sha2(F.array_join(F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n"), section), ""), 256)


def fingerprint(text: str | Column) -> Column:
    """Fingerprint of a text column; a null text has that of an empty one."""
    section = lambda s: F.array_join(F.transform(s, lambda p: F.array_join(p, "")), ",")
    return F.concat_ws("|", root(text), F.array_join(F.transform(tree(text), section), ";"))


def leaves(fp: str | Column) -> Column:
    c = F.col(fp) if isinstance(fp, str) else fp
    return F.regexp_extract_all(F.substring_index(c, "|", -1), F.lit(f"[0-9a-f]{{{LEAF}}}"), F.lit(0))


def likeness(a: str | Column, b: str | Column) -> Column:
    """1 for equal roots, else different leaves in both over those of the one with more (0 to 1)."""
    x, y = leaves(a), leaves(b)
    most = F.greatest(F.size(F.array_distinct(x)), F.size(F.array_distinct(y)))
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.when(a == b, F.lit(1.0)).when(most == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / most)


def changed_paragraphs(a: str | Column, b: str | Column) -> Column:
    """Places (from 0, sections run together) of the paragraphs of ``a`` that ``b`` has otherwise at the
    same place: where an edit in place lies."""
    rows = lambda fp: F.split(F.translate(F.substring_index(fp, "|", -1), ";", ","), ",")
    x, y = (rows(F.col(c) if isinstance(c, str) else c) for c in (a, b))
    return F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))


def successors(ids: DataFrame) -> DataFrame:
    """(key, n, next_key) for the distinct ``key`` of ``ids`` (key, n): the next larger key, after the
    last the first.  Keys are ranged over partitions; only one row of each range meets in one task."""
    ranged = stored(ids.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ids")
    firsts = ranged.groupBy("part").agg(F.min("key").alias("low"))
    lowest = F.min("low").over(Window.partitionBy())
    edge = firsts.select("part", F.coalesce(F.lead("low").over(Window.partitionBy().orderBy("part")), lowest).alias("after"))
    follows = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return ranged.withColumn("next", follows).join(edge, "part").select("key", "n", F.coalesce("next", "after").alias("next_key"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) beside its edited text, whose last quarter gives way to the
    beginning of the next document, by ascending id: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The last document is followed by the first, and a lone one by itself.  A null id comes first.  Where
    an id is repeated, all its rows have the same next document, and where the next id is, its row
    that begins smallest counts.  Whole texts are shuffled once; of a next document only what the edit
    takes and its fingerprint travel.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    after = successors(texts.groupBy("key").agg(F.max(F.length("text")).alias("n")))
    to = after.select(F.col("next_key").alias("key"), F.col("key").alias("before"), F.floor(F.col("n") / 4).cast("int").alias("most"))
    sent = texts.join(to, "key").select("before", F.substr("text", F.lit(1), "most").alias("head"), fingerprint("text").alias("next_fp"))
    one = sent.groupBy(F.col("before").alias("key")).agg(F.min(F.struct("head", "next_fp")).alias("next"))
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - k), F.substr("next.head", F.lit(1), k))
    rows = texts.join(one, "key").select("key", n.cast("long").alias("n_chars"), edited.alias("edited"), "text", F.col("next.next_fp").alias("next_fp"))
    known = rows.select("key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("text").alias("fingerprint"), fingerprint("edited").alias("edited_fingerprint"), "next_fp")
    doc_id = F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id")
    near = likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fp").alias("near_next")
    return known.select(doc_id, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
