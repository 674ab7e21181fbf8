"""Tower dumps: movement between towers.

Speeds need coordinates: run :func:`tallymast.operators.geofence.enrich` first where the dump
has none (F15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, speed_kmh
from ..functions.scalar import bin_start, count_if, movement_class, pct, seconds_between, us
from ..plans.joins import band_join, block_pairs, point_in_interval
from ..plans.shards import count_ahead, neighbours
from ..session import cut_lineage
from .cdr import TIE, top_k


def _points(df: DataFrame, key: str, lat: str, lon: str, tie: Sequence[str]) -> DataFrame:
    have = set(df.columns)
    place = [(F.col(c) if c in have else F.lit(None).cast("double")).alias(n) for c, n in ((lat, "lat"), (lon, "lon"))]
    return df.select(F.col(key).alias("who"), "timestamp", "tower_id", *place, *tie)


def tower_steps(df: DataFrame, key: str = "mobile_number", lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    """The shared feature table: every record with its predecessor, distance, seconds and speed.
    ``changed`` is false for the first record of a key."""
    steps = neighbours(_points(df, key, lat, lon, tie), ["who"], "timestamp", prev={
        "from_tower": "tower_id", "from_time": "timestamp", "from_lat": "lat", "from_lon": "lon"}, tie=tie)
    km = haversine_km("from_lat", "from_lon", "lat", "lon")
    sec = seconds_between("timestamp", "from_time")
    return steps.select("*", F.coalesce(F.col("from_tower") != F.col("tower_id"), F.lit(False)).alias("changed"),
                        km.alias("km"), sec.alias("seconds"), speed_kmh(km, sec).alias("kmh"))


def trajectories(df: DataFrame, least: int = 3, listed: int = 10, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    """One row per number with at least ``least`` records: towers, moves, distance and speeds over
    tower changes, and the first ``listed`` stops."""
    steps = tower_steps(df, lat=lat, lon=lon, tie=tie)
    move = F.col("changed") & (F.col("seconds") > 0)
    stats = steps.groupBy("who").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("tower_id").alias("towers"), count_if(F.col("changed")).alias("moves"),
        F.coalesce(F.sum(F.when(move, F.col("km"))), F.lit(0.0)).alias("km"),
        F.coalesce(F.avg(F.when(move, F.col("kmh"))), F.lit(0.0)).alias("mean_kmh"),
        F.coalesce(F.max(F.when(move, F.col("kmh"))), F.lit(0.0)).alias("max_kmh"),
        F.min("timestamp").alias("start"), F.max("timestamp").alias("stop")).filter(F.col("records") >= least)
    stops = top_k(steps.filter(F.col("changed") | F.col("from_tower").isNull()), ["who"], ["timestamp", *tie], listed, "_n")
    lists = stops.groupBy("who").agg(F.array_sort(F.collect_list(F.struct("_n", "tower_id"))).alias("_s"))
    return stats.join(lists, "who").select(
        F.col("who").alias("mobile_number"), "records", "towers", "moves", "km", "mean_kmh", "max_kmh", "start", "stop",
        (seconds_between("stop", "start") / 3600).alias("span_hours"), F.col("_s.tower_id").alias("stops"))


def trajectory_classes(t: DataFrame, long_km: float = 50) -> DataFrame:
    """Long distance, and circular: the first tower comes back from the fourth stop on."""
    back = F.array_contains(F.slice("stops", 4, 100), F.element_at("stops", 1))
    return t.select("mobile_number", "km", "moves", (F.col("km") > long_km).alias("long_distance"),
                    ((F.size("stops") >= 4) & back).alias("circular"))


def impossible_travel(df: DataFrame, key: str = "mobile_number", kmh: float = 500, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    steps = tower_steps(df, key, lat, lon, tie).filter(F.col("changed") & (F.col("kmh") > kmh))
    return steps.select(F.col("who").alias(key), "from_tower", F.col("tower_id").alias("to_tower"), "from_time", F.col("timestamp").alias("to_time"), "km", "seconds", "kmh")


def impossible_subjects(df: DataFrame, key: str = "mobile_number", kmh: float = 500, least: int = 2, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    hits = impossible_travel(df, key, kmh, lat, lon, tie).groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.max("kmh").alias("max_kmh"))
    return hits.filter(F.col("events") >= least)


def timed_moves(df: DataFrame, hours: float = 2, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    """Tower changes with more than zero and less than ``hours`` between the records."""
    steps = tower_steps(df, lat=lat, lon=lon, tie=tie)
    return steps.filter(F.col("changed") & (F.col("seconds") > 0) & (F.col("seconds") < hours * 3600)).select(
        F.col("who").alias("mobile_number"), "from_tower", F.col("tower_id").alias("to_tower"), "timestamp", "km", "seconds", "kmh", *tie)


def vehicle_moves(moves: DataFrame, low: float = 20, high: float = 200) -> DataFrame:
    return moves.filter(F.col("kmh").between(low, high))


def vehicle_users(moves: DataFrame, least: int = 3) -> DataFrame:
    """Input: :func:`vehicle_moves`."""
    out = moves.groupBy("mobile_number").agg(
        F.count(F.lit(1)).alias("moves"), F.avg("kmh").alias("mean_kmh"), F.max("kmh").alias("max_kmh"), F.sum("km").alias("km"))
    return out.filter(F.col("moves") >= least)


def fast_moves(moves: DataFrame, kmh: float = 100) -> DataFrame:
    return moves.filter(F.col("kmh") > kmh)


def common_routes(moves: DataFrame, users: DataFrame, first: int = 5, kmh: float = 60, least: int = 2, tie: Sequence[str] = TIE) -> DataFrame:
    """Fast routes taken at least ``least`` times among the ``first`` vehicle moves of each user."""
    firsts = top_k(moves.join(users.select("mobile_number"), "mobile_number", "left_semi"), ["mobile_number"], ["timestamp", *tie], first, "_n")
    out = firsts.filter(F.col("kmh") > kmh).groupBy("from_tower", "to_tower").agg(F.count(F.lit(1)).alias("trips"))
    return out.filter(F.col("trips") >= least)


def crossings(df: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    """Tower changes as entry and exit rows ``(tower_id, number, kind, other, timestamp)``."""
    steps = neighbours(df.select("mobile_number", "timestamp", "tower_id", *tie), ["mobile_number"], "timestamp", prev={"from_tower": "tower_id"}, tie=tie)
    moved = steps.filter(F.col("from_tower") != F.col("tower_id"))
    return moved.select("mobile_number", "timestamp", *tie, F.inline(F.array(
        F.struct(F.col("from_tower").alias("tower"), F.lit("EXIT").alias("kind"), F.col("tower_id").alias("other")),
        F.struct(F.col("tower_id").alias("tower"), F.lit("ENTRY").alias("kind"), F.col("from_tower").alias("other")))))


def tower_traffic(df: DataFrame, more_than: int = 50, k: int = 3, tie: Sequence[str] = TIE) -> DataFrame:
    """Entries, exits, visitors and the busiest entry hours of towers with much traffic."""
    rows = crossings(df, tie)
    entry = F.col("kind") == "ENTRY"
    stats = rows.groupBy("tower").agg(
        count_if(entry).alias("entries"), count_if(~entry).alias("exits"), F.count_distinct(F.when(entry, F.col("mobile_number"))).alias("visitors"))
    hours = rows.filter(entry).groupBy("tower", F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    peaks = top_k(hours, ["tower"], [F.desc("n"), "hour"], k).groupBy("tower").agg(F.array_sort(F.collect_list(F.struct("rank", "hour"))).alias("_h"))
    out = stats.filter(F.col("entries") + F.col("exits") > more_than).join(peaks, "tower", "left")
    return out.select(F.col("tower").alias("tower_id"), "entries", "exits", "visitors", F.col("_h.hour").alias("peak_hours"))


def quick_visits(df: DataFrame, minutes: float = 10, tie: Sequence[str] = TIE) -> DataFrame:
    """Entry and any exit of the same number at that tower less than ``minutes`` later."""
    rows = crossings(df, tie)
    entries = rows.filter("kind = 'ENTRY'").select("tower", "mobile_number", F.col("timestamp").alias("entered"), F.col("other").alias("from_tower"))
    exits = rows.filter("kind = 'EXIT'").select("tower", "mobile_number", F.col("timestamp").alias("left_at"), F.col("other").alias("to_tower"))
    span = int(minutes * 60e6)
    out = band_join(entries, exits, ["tower", "mobile_number"], "entered", "left_at", 1, span - 1)
    return out.select(F.col("tower").alias("tower_id"), "mobile_number", "entered", "left_at", "from_tower", "to_tower",
                      (seconds_between("left_at", "entered") / 60).alias("minutes"))


def quick_visit_towers(visits: DataFrame, least: int = 3) -> DataFrame:
    return visits.groupBy("tower_id").agg(F.count(F.lit(1)).alias("visits")).filter(F.col("visits") >= least)


def _together(least: int, spread: int):
    """A task's function: from rows (tower_id, to_tower, _cell, _from, _until, _to, mobile_number), those of a cell
    beside each other, the stretches of time in which at least ``least`` of them hold at once, with at most ``spread``
    between the first and the last ``_to``; and who they are.  Nothing of this module is imported in the task."""

    def stretches(held):
        from heapq import heappop, heappush

        import numpy as np

        begin, end, to, who = held
        marks = sorted([(at, 1, k) for k, at in enumerate(begin)] + [(at + 1, 0, k) for k, at in enumerate(end)])
        edges = np.array([m[0] for m in marks])
        if np.cumsum([1 if m[1] else -1 for m in marks]).max() < least:
            return
        open_, low, high, gone = set(), [], [], np.zeros(len(to), bool)
        for n, (at, opens, k) in enumerate(marks):
            if opens:
                open_.add(k)
                heappush(low, (to[k], k))
                heappush(high, (-to[k], k))
            else:
                open_.remove(k)
                gone[k] = True
            if len(open_) >= least and edges[n + 1] > at:
                while gone[low[0][1]]:
                    heappop(low)
                while gone[high[0][1]]:
                    heappop(high)
                if -high[0][0] - low[0][0] <= spread:
                    yield at, int(edges[n + 1]) - 1, len(open_), sorted(who[k] for k in open_ if who[k] is not None)

    def run(batches):
        import pandas as pd

        place, held = None, ([], [], [], [])

        def out():
            return pd.DataFrame([(*place[:2], *found) for found in stretches(held)], columns=["tower_id", "to_tower", "_from", "_until", "members_count", "members"])

        for pdf in batches:
            done = []
            for tower, to_tower, cell, *row in pdf.itertuples(index=False, name=None):
                if (tower, to_tower, cell) != place:
                    if place is not None:
                        done.append(out())
                    place, held = (tower, to_tower, cell), ([], [], [], [])
                for column, value in zip(held, row):
                    column.append(value)
            if done:
                yield pd.concat(done)
        if place is not None:
            yield out()

    return run


def convoys(df: DataFrame, seconds: int = 300, least: int = 3, together: int = 2, spread: int = 600, tie: Sequence[str] = TIE) -> DataFrame:
    """Numbers seen together at a tower that are next seen together at another one.

    A sweep finds the windows.  Where a number goes after the end of a window depends on that end alone, so every
    visit gives stretches of ends for which it is counted, cut at the number's next records; there are about as
    many as records.  A second sweep along the ends finds the stretches in which enough numbers go to a tower and
    arrive close together, and only these, with their members, meet the windows.  No row per window and member is made.
    """
    span = seconds * 1_000_000
    rows = df.select("tower_id", "timestamp", "mobile_number", *tie)
    windows = count_ahead(rows, ["tower_id"], "timestamp", span, "candidates", distinct="mobile_number", tie=tie).filter(
        F.col("candidates") >= least).select("tower_id", F.col("timestamp").alias("start"), F.col(tie[0]).alias("window_id"), "candidates").distinct()
    timed = rows.filter(F.col("timestamp").isNotNull()).withColumn("_who", F.struct("mobile_number"))  # equal where null
    # one record of a number and time, the first by tie, with the next one
    first = timed.groupBy("_who", "timestamp").agg(F.min_by("tower_id", F.struct(F.lit(0).alias("_t"), *tie)).alias("_tower"))
    ways = neighbours(first, ["_who"], "timestamp", next={"to_tower": "_tower", "_to": "timestamp"})
    ways = ways.filter(F.col("to_tower").isNotNull()).select("_who", F.col("timestamp").alias("_leaves"), "to_tower", us("_to").alias("_to"))
    visits = timed.filter(F.col("tower_id").isNotNull()).select("_who", "tower_id", "timestamp").distinct()
    visits = neighbours(visits, ["_who", "tower_id"], "timestamp", next={"_again": "timestamp"})
    last = F.least(us("timestamp") + span, us("_again") - 1)
    visits = visits.select("_who", "tower_id", F.col("timestamp").alias("_seen"), F.timestamp_micros(last).alias("_last"))
    counted = point_in_interval(ways, visits, ["_who"], "_leaves", "_seen", "_last", 1_000_000).filter(F.col("to_tower") != F.col("tower_id"))
    counted = counted.select("tower_id", "to_tower", us("_leaves").alias("_from"), F.least(us("_seen") + span, F.col("_to") - 1).alias("_until"), "_to", "_who.mobile_number")
    # stretches are no longer than a window: two cells at most
    width = 12 * max(span, 1)
    cells = counted.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_until") / width))))
    cells = cells.select("tower_id", "to_tower", "_cell", F.greatest("_from", F.col("_cell") * width).alias("_from"),
                         F.least("_until", (F.col("_cell") + 1) * width - 1).alias("_until"), "_to", "mobile_number")
    cells = cells.repartition("tower_id", "to_tower", "_cell").sortWithinPartitions("tower_id", "to_tower", "_cell")
    found = cells.mapInPandas(_together(together, spread * 1_000_000), "tower_id string, to_tower string, _from bigint, _until bigint, members_count bigint, members array<string>")
    found = cut_lineage(found.withColumn("_from", F.timestamp_micros("_from")).withColumn("_until", F.timestamp_micros("_until")))
    ends = windows.withColumn("_end", F.timestamp_micros(us("start") + span))
    out = point_in_interval(ends, found, ["tower_id"], "_end", "_from", "_until", 1_000_000)
    return out.select("window_id", F.col("tower_id").alias("from_tower"), "to_tower", "start", "members", "members_count",
                      (F.col("members_count") / F.col("candidates")).alias("score"))


def merge_convoys(found: DataFrame, shared: float = 0.5) -> DataFrame:
    """Convoys on the same route that share more than ``shared`` of the later one's members
    become one.  Order dependent, so a route is walked in time order; a convoy is held against those merged ones only
    that have a member of it."""
    rows = found.withColumn("_us", us("start")).repartition("from_tower", "to_tower").sortWithinPartitions("from_tower", "to_tower", "_us", "window_id")
    rows = rows.select("from_tower", "to_tower", "_us", "members")
    cols = ["from_tower", "to_tower", "_us", "members", "convoys"]

    def fold(batches):
        import pandas as pd

        route, kept, of = None, [], {}  # of: which of the kept ones have a member

        def out():
            return pd.DataFrame([(*route, at, sorted(m), n) for at, m, n in kept], columns=cols)

        for pdf in batches:
            for a, b, at, members in zip(pdf["from_tower"], pdf["to_tower"], pdf["_us"], pdf["members"]):
                if (a, b) != route:
                    if route is not None:
                        yield out()
                    route, kept, of = (a, b), [], {}
                new = set(members)
                need, common = len(new) * shared, {0: 0} if kept else {}
                for m in new:
                    for n in of.get(m, ()):
                        common[n] = common.get(n, 0) + 1
                n = min((n for n, size in common.items() if size > need), default=len(kept))
                if n == len(kept):
                    kept.append([at, set(), 0])
                for m in new - kept[n][1]:
                    of.setdefault(m, []).append(n)
                kept[n][1] |= new
                kept[n][2] += 1
        if route is not None:
            yield out()

    merged = rows.mapInPandas(fold, "from_tower string, to_tower string, _us bigint, members array<string>, convoys bigint")
    return merged.select("from_tower", "to_tower", F.timestamp_micros("_us").alias("start"), "members", F.size("members").alias("size"), "convoys")


def convoy_members(merged: DataFrame, least: int = 2) -> DataFrame:
    out = merged.select(F.explode("members").alias("mobile_number")).groupBy("mobile_number").agg(F.count(F.lit(1)).alias("convoys"))
    return out.filter(F.col("convoys") >= least)


def tower_degrees(df: DataFrame) -> DataFrame:
    """Neighbours of a tower: other towers visited by a number that visited it."""
    visits = df.select("mobile_number", "tower_id").distinct()
    pairs = block_pairs(visits, ["mobile_number"], "tower_id").select("a", "b").distinct()
    return pairs.select(F.explode(F.array("a", "b")).alias("tower_id")).groupBy("tower_id").agg(F.count(F.lit(1)).alias("neighbours"))


def edge_towers(df: DataFrame, below: float = 0.5, minutes: float = 30) -> DataFrame:
    """Towers with fewer than ``below`` of the mean number of neighbours, with their devices and
    brief visits (several records within less than ``minutes``)."""
    degrees = tower_degrees(df)
    mean = degrees.agg(F.avg("neighbours").alias("_mean")).withColumn("_k", F.lit(1))
    edge = degrees.withColumn("_k", F.lit(1)).join(F.broadcast(mean), "_k").filter(F.col("neighbours") < F.col("_mean") * below)
    visits = df.groupBy("tower_id", "mobile_number").agg(
        F.count(F.lit(1)).alias("n"), (F.max(us("timestamp")) - F.min(us("timestamp"))).alias("_span"))
    per = visits.groupBy("tower_id").agg(
        F.count(F.lit(1)).alias("devices"), count_if((F.col("n") > 1) & (F.col("_span") < int(minutes * 60e6))).alias("brief_visits"))
    return edge.select("tower_id", "neighbours").join(per, "tower_id")


def movement_totals(df: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    steps = neighbours(df.select("mobile_number", "timestamp", "tower_id", *tie), ["mobile_number"], "timestamp", prev={"_f": "tower_id"}, tie=tie)
    per = steps.filter(F.col("_f") != F.col("tower_id")).groupBy("mobile_number").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("moves"), F.count(F.lit(1)).alias("movers"))


def steps(df: DataFrame, lat: str = "lat", lon: str = "long", dwell_minutes: float = 30, tie: Sequence[str] = TIE) -> DataFrame:
    """Each point with the way to the next: distance, speed (0 without time between them),
    class, and minutes spent; the last point has no way on."""
    rows = neighbours(_points(df, "mobile_number", lat, lon, tie), ["who"], "timestamp", next={
        "to_tower": "tower_id", "to_time": "timestamp", "to_lat": "lat", "to_lon": "lon"}, tie=tie)
    km = F.when(F.col("to_time").isNotNull(), haversine_km("lat", "lon", "to_lat", "to_lon")).otherwise(0.0)
    sec = F.coalesce(seconds_between("to_time", "timestamp"), F.lit(0.0))
    kmh = F.coalesce(speed_kmh(km, sec), F.lit(0.0))
    out = rows.select(F.col("who").alias("mobile_number"), "timestamp", *tie, "tower_id", "to_tower", "to_time", km.alias("km"), sec.alias("seconds"), kmh.alias("kmh"))
    return out.select("*", movement_class("kmh").alias("movement"), (F.col("seconds") / 60).alias("dwell_minutes"), (F.col("seconds") > dwell_minutes * 60).alias("long_dwell"))


def movement_metrics(df: DataFrame, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    """Per device with more than one record; the last point counts with speed 0, as observed."""
    out = steps(df, lat, lon, tie=tie).groupBy("mobile_number").agg(
        F.count(F.lit(1)).alias("records"), F.sum("km").alias("km"), F.avg("kmh").alias("mean_kmh"), F.max("kmh").alias("max_kmh"),
        F.count_distinct("tower_id").alias("towers"), pct(count_if(F.col("kmh") < 1), F.count(F.lit(1))).alias("stationary_pct"),
        pct(count_if(F.col("kmh") > 25), F.count(F.lit(1))).alias("vehicle_pct"))
    return out.filter("records > 1").withColumn("movement", movement_class("mean_kmh"))


METRICS = ("km", "mean_kmh", "max_kmh", "towers", "stationary_pct", "vehicle_pct")


def movement_distribution(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("movement").agg(F.count(F.lit(1)).alias("devices"))


def correlations(metrics: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every pair of columns in one pass, in long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    out = metrics.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return out.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("correlation")) for a, b in pairs])))


def co_movement(df: DataFrame, devices: Sequence[str], seconds: int = 300, lat: str = "lat", lon: str = "long") -> DataFrame:
    """Bins in which at least two of the given devices were at no more than two towers."""
    rows = df.filter(F.col("mobile_number").isin(list(devices)))
    out = rows.groupBy(bin_start("timestamp", seconds).alias("bin")).agg(
        F.array_sort(F.collect_set("mobile_number")).alias("devices"), F.array_sort(F.collect_set("tower_id")).alias("towers"),
        F.avg(lat).alias("center_lat"), F.avg(lon).alias("center_lon"))
    return out.filter((F.size("devices") >= 2) & (F.size("towers") <= 2))


def area_visits(df: DataFrame, towers: Sequence[str], tie: Sequence[str] = TIE) -> DataFrame:
    """Entries into and exits from a tower set; a visit lasts from the last record inside to the
    first one outside, as observed."""
    rows = df.select("mobile_number", "timestamp", "tower_id", F.col("tower_id").isin(list(towers)).alias("inside"), *tie)
    out = neighbours(rows, ["mobile_number"], "timestamp", prev={"_in": "inside", "_at": "timestamp"}, tie=tie)
    was = F.coalesce("_in", F.lit(False))
    return out.filter(was != F.col("inside")).select(
        "mobile_number", "timestamp", *tie, "tower_id", F.when(F.col("inside"), "ENTRY").otherwise("EXIT").alias("kind"),
        F.when(~F.col("inside"), seconds_between("timestamp", "_at") / 3600).alias("visit_hours"),
        F.hour("timestamp").alias("hour"))
