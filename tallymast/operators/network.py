"""Call records: the network across subjects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import count_if, pct, seconds_between, us
from ..plans.folds import with_island
from ..plans.joins import block_pairs, counted_pairs, crowded_blocks, packed_pairs
from ..plans.shards import count_ahead
from ..session import cut_lineage
from .cdr import TIE, contact_counts, people


def contact_edges(df: DataFrame) -> DataFrame:
    """(subject, contact, calls)."""
    return contact_counts(df).withColumnRenamed("b_party", "contact")


def direct_links(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Subjects whose contact is another subject's number.  Deviation F9: both directions."""
    other = ids.select(F.col("msisdn").alias("contact"), F.col("subject").alias("to_subject"))
    return edges.join(other, "contact").filter("subject <> to_subject").select("subject", "to_subject", "calls")


def isolated_subjects(edges: DataFrame, ids: DataFrame) -> DataFrame:
    links = direct_links(edges, ids)
    ends = links.select("subject").unionByName(links.select(F.col("to_subject").alias("subject"))).distinct()
    return ids.select("subject").distinct().join(ends, "subject", "left_anti")


def shared_contacts(edges: DataFrame, intermediary: int = 3) -> DataFrame:
    """Contacts of more than one subject.  ``sharers`` is the count; names are a join away."""
    out = edges.groupBy("contact").agg(F.count(F.lit(1)).alias("sharers"), F.sum("calls").alias("calls"))
    return out.filter("sharers > 1").select("*", (F.col("sharers") >= intermediary).alias("intermediary"))


def sharers(edges: DataFrame, shared: DataFrame) -> DataFrame:
    """Long form of who shares a contact: (contact, subject, calls)."""
    return edges.join(shared.select("contact"), "contact", "left_semi").select("contact", "subject", "calls")


def pairwise_common(edges: DataFrame, samples: int = 3, least: int = 1) -> DataFrame:
    """Number of contacts two subjects share, at least ``least``, with the first ``samples`` of them.

    Where contacts have many subjects, pairs are counted in tasks (``packed_pairs``), else listed: contacts of very
    many subjects are joined block against block.  With ``least`` above one the largest make
    no pairs (``counted_pairs``), and samples are looked up for the pairs that are left.
    """
    links = cut_lineage(edges.select("contact", "subject").distinct())
    if blocks := crowded_blocks(links.dropna(), ["contact"]):
        return packed_pairs(links, ["contact"], "subject", blocks, least, samples=samples)
    pairs = block_pairs(links, ["contact"], "subject")
    if least > 1:
        pairs = pairs.join(counted_pairs(links, ["contact"], "subject", least).select("a", "b"), ["a", "b"], "left_semi")
    w = Window.partitionBy("a", "b").orderBy("contact")
    return (
        pairs.withColumn("_n", F.row_number().over(w)).groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("common"),
             F.array_sort(F.collect_list(F.when(F.col("_n") <= samples, F.col("contact")))).alias("samples"))
    )


def central_subjects(edges: DataFrame, k: int = 5) -> DataFrame:
    out = edges.groupBy("subject").agg(F.count(F.lit(1)).alias("contacts"), F.sum("calls").alias("calls"))
    return (
        out.withColumn("calls_per_contact", F.col("calls") / F.col("contacts"))
        .orderBy(F.desc("contacts"), "subject").limit(k)
    )


def fan_out(edges: DataFrame, more_than: int = 50, share: float = 50) -> DataFrame:
    out = edges.groupBy("subject").agg(F.count(F.lit(1)).alias("contacts"), count_if(F.col("calls") == 1).alias("single"))
    return out.select("*", pct(F.col("single"), F.col("contacts")).alias("single_pct")).filter(
        (F.col("contacts") > more_than) & (F.col("single_pct") > share))


def synchronized(df: DataFrame, seconds: int = 300, tie: Sequence[str] = TIE) -> DataFrame:
    """Every record from which on at least two subjects are active within ``seconds``.

    The order runs over all subjects, so it is cut into cells of twice the window, each seeing one window
    ahead, and crowded cells at quantiles of their times: no step sorts a large stretch in one task.
    """
    span = seconds * 1_000_000
    rows = people(df).select("subject", "datetime", *tie)
    out = count_ahead(rows, [], "datetime", span, "subjects", distinct="subject", tie=tie)
    return out.filter("subjects >= 2").select(
        F.col("datetime").alias("start"), *tie, F.col("subject").alias("anchor"), "subjects",
        F.when(F.col("subjects") >= 3, "COORDINATED").otherwise("SYNCHRONIZED").alias("kind"))


def synchronized_greedy(df: DataFrame, seconds: int = 300, tie: Sequence[str] = TIE) -> DataFrame:
    """Synchronized activity with consumed records.

    An anchor takes the first record of every other subject in its window; a record taken by
    any anchor cannot become an anchor.  Islands are independent; inside one the records
    stream past the anchors still open, so memory holds one window and not an island.
    """
    span = seconds * 1_000_000
    rows = with_island(people(df).select("subject", "datetime", *tie), "datetime", span)
    rows = rows.withColumn("_us", us("datetime")).repartition("island").sortWithinPartitions("island", "_us", *tie)
    tie_name = tie[0]

    def fold(batches):
        import pandas as pd

        island, open_anchors = None, []

        def closed(anchors):
            return [(a[1], a[0], sorted(a[2]), len(a[2])) for a in anchors if len(a[2]) >= 2]

        for pdf in batches:
            out = []
            for isl, at, who, rid in zip(pdf["island"], pdf["_us"], pdf["subject"], pdf[tie_name]):
                if isl != island:
                    out += closed(open_anchors)
                    island, open_anchors = isl, []
                live = [a for a in open_anchors if at - a[0] <= span]
                out += closed(a for a in open_anchors if at - a[0] > span)
                open_anchors = live
                taken = False
                for anchor in live:
                    if who not in anchor[2]:
                        anchor[2].add(who)
                        taken = True
                if not taken:
                    open_anchors.append((at, rid, {who}))
            yield pd.DataFrame(out, columns=["anchor_id", "_us", "members", "subjects"])
        yield pd.DataFrame(closed(open_anchors), columns=["anchor_id", "_us", "members", "subjects"])

    found = rows.mapInPandas(fold, "anchor_id bigint, _us bigint, members array<string>, subjects bigint")
    return found.select(
        F.timestamp_micros("_us").alias("start"), F.col("anchor_id").alias(tie_name), "members", "subjects",
        F.when(F.col("subjects") >= 3, "COORDINATED").otherwise("SYNCHRONIZED").alias("kind"))


def coordination_windows(sync: DataFrame, hours: float = 1.0, tie: Sequence[str] = TIE) -> DataFrame:
    """Consecutive synchronized events at most ``hours`` apart.

    Deviation F10: events are compared in time order.  Minutes are shards; the first event of
    the next occupied minute is looked up on one row per minute.
    """
    rows = sync.select("start", *tie).withColumn("_minute", F.floor(us("start") / 60_000_000))
    w = Window.partitionBy("_minute").orderBy("start", *tie)
    inside = rows.withColumn("_next", F.lead("start").over(w))
    minutes = rows.groupBy("_minute").agg(F.min("start").alias("_first"))
    ahead = minutes.select("_minute", F.lead("_first").over(Window.orderBy("_minute")).alias("_ahead"))
    out = inside.join(F.broadcast(ahead), "_minute").withColumn("end", F.coalesce("_next", "_ahead"))
    gap = seconds_between("end", "start")
    return out.filter((gap >= 0) & (gap <= hours * 3600)).select("start", "end", gap.alias("gap_seconds"))
