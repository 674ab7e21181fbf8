"""Order-dependent operators against plain loops over small random input."""

import random
import time
from itertools import groupby

from pyspark.sql import functions as F

from tallymast.operators import behaviour, cdr, movement, network
from tallymast.plans import folds

US = 1_000_000


def stamp(df, seconds="s", name="timestamp"):
    return df.withColumn(name, F.timestamp_micros((F.col(seconds) * US).cast("bigint"))).drop(seconds)


def test_keep_spaced_boundaries(spark):
    data = [("a", s, n) for n, s in enumerate([0, 299, 300, 301, 599, 600, 2000])] + [("b", 5, 99)]
    df = stamp(spark.createDataFrame(data, "k string, s bigint, id bigint"))
    got = {(r["k"], r["id"]) for r in folds.keep_spaced(df, "k", "timestamp", 300 * US, 10, ["id"]).collect()}
    assert got == {("a", 0), ("a", 2), ("a", 5), ("a", 6), ("b", 99)}
    few = folds.keep_spaced(df, "k", "timestamp", 300 * US, 2, ["id"]).filter("k = 'a'").count()
    assert few == 2


def spaced(data, gap, limit=None):
    kept, last = [], {}
    for k, s, i in sorted(data, key=lambda r: (r[1], r[2])):
        if k not in last or s - last[k] >= gap:
            last[k] = s
            kept.append((k, i))
    return {x for k in {k for k, _ in kept} for x in [y for y in kept if y[0] == k][:limit]}


def test_keep_spaced_against_a_loop(spark):
    """One key never rests, so its chain has no place to start anew; times repeat."""
    rng = random.Random(13)
    data = [("busy", rng.randrange(20_000), n) for n in range(1500)] + [(rng.choice("abc"), rng.randrange(90_000), 5000 + n) for n in range(300)]
    df = stamp(spark.createDataFrame(data, "k string, s bigint, id bigint"))
    for limit in (None, 1, 3, 10):
        for hot_rows in (100, 10**9):
            got = folds.keep_spaced(df, "k", "timestamp", 300 * US, limit, ["id"], hot_rows)
            assert {(r["k"], r["id"]) for r in got.collect()} == spaced(data, 300, limit)
    none = folds.keep_spaced(df.limit(0), "k", "timestamp", 300 * US, None, ["id"])
    assert none.count() == 0 and none.columns == df.columns


def test_chains_are_followed_in_rounds_of_joins(spark):
    """A chain of 5,000 choices takes 13 rounds, and no row passes through Python."""
    df = spark.range(5_000).select(F.lit("k").alias("_key"), F.col("id").alias("_at"), F.when(F.col("id") < 4_999, F.col("id") + 1).alias("_next"))
    assert folds.chain(df).count() == 5_000
    assert {r["_at"] for r in folds.chain(df, 10).collect()} == set(range(10))
    times = stamp(df.select(F.col("_key").alias("k"), F.col("_at").alias("s"), F.col("_at").alias("id")))
    plan = folds.keep_spaced(times, "k", "timestamp", 2 * US, 10, ["id"])._jdf.queryExecution().toString()
    assert "InPandas" not in plan and "Python" not in plan


def calls(spark, rng, n=400, span=20_000, subjects="abc"):
    data = [(rng.choice(subjects), rng.randrange(span), i, rng.choice("pqr")) for i in range(n)]
    df = spark.createDataFrame(data, "subject string, s bigint, event_id bigint, b_party string")
    return data, stamp(df, name="datetime").withColumn("is_provider_message", F.lit(False))


def test_bursts_both_definitions(spark):
    data, df = calls(spark, random.Random(1))
    for mode in ("spaced", "skip"):
        want = []
        for who, group in groupby(sorted(data), key=lambda r: r[0]):
            group = sorted(group, key=lambda r: (r[1], r[2]))
            size = [sum(1 for x in group if g[1] <= x[1] <= g[1] + 900) for g in group]
            kept, at = [], 0
            if mode == "spaced":
                for g, n in zip(group, size):
                    if n >= 5 and (not kept or g[1] - kept[-1][0] >= 300):
                        kept.append((g[1], n))
                kept = kept[:10]
            else:
                while at < len(group):
                    if size[at] >= 5:
                        kept.append((group[at][1], size[at]))
                        at += size[at]
                    else:
                        at += 1
                kept = kept[:5]
            want += [(who, *k) for k in kept]
        got = cdr.call_bursts(df, mode).select("subject", F.unix_seconds("start"), "calls")
        assert sorted(tuple(r) for r in got.collect()) == sorted(want), mode


def naive_sync(data, window):
    order = sorted(data, key=lambda r: (r[1], r[2]))
    used, out = set(), []
    for i, row in enumerate(order):
        if i in used:
            continue
        seen = {row[0]}
        for j in range(i + 1, len(order)):
            if order[j][1] - row[1] > window:
                break
            if order[j][0] not in seen:
                seen.add(order[j][0])
                used.add(j)
        if len(seen) >= 2:
            out.append((row[2], tuple(sorted(seen))))
    return sorted(out)


def test_synchronized_greedy(spark):
    for seed, span in ((2, 30_000), (3, 200_000)):
        data, df = calls(spark, random.Random(seed), 300, span, "abcdefgh")
        got = network.synchronized_greedy(df.repartition(5))
        assert sorted((r["event_id"], tuple(r["members"])) for r in got.collect()) == naive_sync(data, 300)


def towers(spark, rng, n=500, span=15_000):
    data = [(rng.choice("TU"), rng.randrange(span), rng.choice("abcdefgh"), i) for i in range(n)]
    df = spark.createDataFrame(data, "tower_id string, s bigint, mobile_number string, event_id bigint")
    return data, stamp(df)


def naive_groups(data):
    kept = []
    for tower in sorted({d[0] for d in data}):
        rows = sorted((d for d in data if d[0] == tower), key=lambda r: (r[1], r[3]))
        own = []
        for r in rows:
            inside = [x for x in rows if r[1] <= x[1] <= r[1] + 300]
            who = {x[2] for x in inside}
            if len(who) >= 3 and not any(abs(k[0] - r[1]) < 300 and len(k[1] & who) > len(who) * 0.7 for k in own):
                own.append((r[1], who))
        kept += [(tower, s, tuple(sorted(w))) for s, w in own]
    return sorted(kept)


def test_group_windows(spark):
    for seed, span in ((4, 15_000), (5, 120_000)):
        data, df = towers(spark, random.Random(seed), span=span)
        got = behaviour.group_windows(df.repartition(6)).select("tower_id", F.unix_seconds("start").alias("s"), "members")
        assert sorted((r["tower_id"], r["s"], tuple(r["members"])) for r in got.collect()) == naive_groups(data)


def test_group_windows_of_a_crowd(spark):
    """Every start in a crowded window is decided without a look at all its members."""
    n = 30_000
    rows = spark.range(n).select(F.lit("T").alias("tower_id"), F.timestamp_micros(F.col("id") * (300_000_000 // n)).alias("timestamp"),
                                 F.format_string("n%05d", "id").alias("mobile_number"), F.col("id").alias("event_id"))
    start = time.monotonic()
    found = [(len(r["members"]), r["numbers"], r["duration_seconds"]) for r in behaviour.group_windows(rows).collect()]
    assert found == [(n, n, 299.99)]
    assert time.monotonic() - start < 25  # a set of all members for every start takes minutes


def test_recurring_pairs(spark):
    data, df = towers(spark, random.Random(6))
    want = {}
    for _, _, members in naive_groups(data):
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                want[a, b] = want.get((a, b), 0) + 1
    got = behaviour.recurring_pairs(behaviour.group_windows(df))
    assert {(r["a"], r["b"]): r["groups"] for r in got.collect()} == {k: v for k, v in want.items() if v >= 2}


def test_merge_convoys(spark):
    rng = random.Random(8)
    data = [("A", rng.choice("BC"), n, sorted(rng.sample("abcdefghij", rng.randrange(2, 5))), n) for n in range(60)]
    df = stamp(spark.createDataFrame(data, "from_tower string, to_tower string, s bigint, members array<string>, window_id bigint"), name="start")
    want = []
    for route in ("B", "C"):
        kept = []
        for row in data:
            if row[1] != route:
                continue
            new = set(row[3])
            for k in kept:
                if len(k & new) > len(new) * 0.5:
                    k |= new
                    break
            else:
                kept.append(set(new))
        want += [(route, tuple(sorted(k))) for k in kept]
    got = movement.merge_convoys(df.repartition(4))
    assert sorted((r["to_tower"], tuple(r["members"])) for r in got.collect()) == sorted(want)
    counts = {}
    for _, members in want:
        for m in members:
            counts[m] = counts.get(m, 0) + 1
    again = movement.convoy_members(got)
    assert {r["mobile_number"]: r["convoys"] for r in again.collect()} == {k: v for k, v in counts.items() if v >= 2}


def test_islands_split_only_at_longer_gaps(spark):
    df = stamp(spark.createDataFrame([(s, s) for s in (0, 300, 600, 901, 1201, 9000)], "s bigint, id bigint"))
    got = {r["id"]: r["island"] for r in folds.with_island(df, "timestamp", 300 * US).collect()}
    assert got[0] == got[300] == got[600] != got[901] and got[901] == got[1201] != got[9000]


def test_convoys_by_stretches_of_window_ends(spark):
    """Against a row per window and member; with repeated records, a missing number and records of one time."""
    from tallymast.operators import movement

    rng = random.Random(17)
    data = [(rng.choice("ABC"), rng.randrange(0, 4000, 20), rng.choice(["n1", "n2", "n3", "n4", "n5", None]), k) for k in range(400)] + [("A", None, "n1", 400), (None, 40, "n2", 401)]
    data += data[:30]
    df = stamp(spark.createDataFrame(data, "tower_id string, s bigint, mobile_number string, event_id bigint"))
    rows = sorted({r for r in data if r[1] is not None}, key=lambda r: (r[1], r[3]))
    want = set()
    for tower, at, _, number in rows:
        inside = {w for t, s, w, _ in rows if t == tower and at <= s <= at + 300}
        if tower is None or len(inside) < 2:
            continue
        after = {w: next(((t, s) for t, s, x, _ in rows if x == w and s > at + 300), (None, None)) for w in inside}
        for to in {t for t, _ in after.values()} - {tower, None}:
            group = [w for w in inside if after[w][0] == to]
            times = [after[w][1] for w in group]
            if len(group) >= 2 and max(times) - min(times) <= 60:
                want.add((number, tower, to, at, tuple(sorted(w for w in group if w is not None)), len(group), round(len(group) / len(inside), 6)))
    got = movement.convoys(df, least=2, spread=60).selectExpr("window_id", "from_tower", "to_tower", "unix_seconds(start)", "members", "members_count", "score").collect()
    base = min(r[3] for r in got) - min(w[3] for w in want)
    assert len(want) > 50 and sorted((r[0], r[1], r[2], r[3] - base, tuple(r[4]), r[5], round(r[6], 6)) for r in got) == sorted(want)


def test_stretches_hold_no_row_per_window():
    """Three numbers leave A for B: one stretch where all hold, however many windows end in it."""
    import pandas as pd

    from tallymast.operators import movement

    rows = [("A", "B", 0, 0, 100, 500, "x"), ("A", "B", 0, 10, 90, 510, "y"), ("A", "B", 0, 20, 60, 900, None), ("A", "C", 0, 0, 9, 9, "x")]
    pdf = pd.DataFrame(rows, columns=["tower_id", "to_tower", "_cell", "_from", "_until", "_to", "mobile_number"])
    got = [tuple(r) for out in movement._together(2, 50)([pdf[:2], pdf[2:]]) for r in out.itertuples(index=False, name=None)]
    assert [r for r in got if r[2] <= r[3]] == [("A", "B", 10, 19, 2, ["x", "y"]), ("A", "B", 61, 90, 2, ["x", "y"])]
