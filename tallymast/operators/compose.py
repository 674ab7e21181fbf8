"""Composite analyses: tables put together from the operators of several families.

``t`` are tower connections with coordinates, ``c`` call records, ``i`` sessions with features
(:func:`tallymast.operators.ipdr.with_session_features`).  Analyses of one party or one moment
filter first, so the predicate reaches the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import count_if, level
from ..normalize import filter_location, filter_window
from ..plans.joins import row_count
from ..session import kept
from . import behaviour, cdr, charts, correlate, crossref, geofence, graph, identity, ipdr, location, movement, network, quality, risk, summaries, tower_time
from .cdr import TIE


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def report_sizes(report: Mapping[str, DataFrame]) -> DataFrame:
    """(section, rows) of a report, for an overview without opening its tables."""
    return _union([row_count(df).select(F.lit(name).alias("section"), "rows") for name, df in report.items()])


def incident_scene(t: DataFrame, c: DataFrame, i: DataFrame, at, towers: Sequence[str] | None = None, center: tuple[float, float] | None = None,
                   radius_km: float | None = None, before: float = 60, after: float = 60, lon: str = "long") -> DataFrame:
    """Devices at a place around a moment: change of presence, category, calls and sessions in
    that time, and whether the device is in neither source; ranked by activity."""
    scene = filter_window(filter_location(t, towers, center, radius_km, lon=lon), at, at, max(before, after))
    change = tower_time.around(scene, at, before, after).select("mobile_number", "change")
    stay = scene.groupBy("mobile_number").agg(F.count(F.lit(1)).alias("records"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    span = max(before, after)
    calls = filter_window(c, at, at, span, "datetime").groupBy(F.col("a_party").alias("mobile_number")).agg(F.count(F.lit(1)).alias("calls"))
    data = filter_window(i, at, at, span, "start_time").groupBy(F.col("subject").alias("mobile_number")).agg(F.count(F.lit(1)).alias("sessions"), count_if(F.col("is_encrypted")).alias("encrypted"))
    known = crossref.parties(c, "a_party").union(crossref.parties(i, "subject")).distinct().select(F.col("party").alias("mobile_number"), F.lit(True).alias("_known"))
    out = change.join(stay, "mobile_number").join(calls, "mobile_number", "left").join(data, "mobile_number", "left").join(known, "mobile_number", "left")
    out = out.fillna(0, ["calls", "sessions", "encrypted"])
    return out.select("mobile_number", "change", "records", "first_seen", "last_seen", "calls", "sessions", "encrypted", F.col("_known").isNull().alias("silent"),
                      (F.col("records") + F.col("calls") + F.col("sessions")).alias("activity"))


def journey(t: DataFrame, c: DataFrame, i: DataFrame, party: str, day: str, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    """Steps, calls and sessions of a party on one day, in time order."""
    of_day = lambda df, key, ts: df.filter((F.col(key) == party) & (F.to_date(ts) == F.lit(day).cast("date")))
    way = movement.steps(of_day(t, "mobile_number", "timestamp"), lat, lon, tie=tie).select(
        F.col("timestamp").alias("at"), F.lit("step").alias("source"), F.concat_ws(" > ", "tower_id", "to_tower").alias("detail"), "kmh", "movement")
    talk = correlate.timeline(of_day(c, "subject", "datetime"), of_day(i, "subject", "start_time")).select(
        "at", "source", "detail", F.lit(None).cast("double").alias("kmh"), F.lit(None).cast("string").alias("movement"))
    return way.unionByName(talk).orderBy("at", "source", "detail")


def party_network(t: DataFrame, c: DataFrame, i: DataFrame, party: str, seconds: int = 300, least: int = 3) -> DataFrame:
    """Contacts, applications and co-located devices of one party in long form.

    Only the bins the party itself is in are joined, so no pairs of other devices are made."""
    contacts = network.contact_edges(c.filter(F.col("subject") == party)).select(F.lit("contact").alias("kind"), F.col("contact").alias("other"), F.col("calls").alias("weight"))
    apps = ipdr.app_usage(i.filter(F.col("subject") == party)).select(F.lit("app").alias("kind"), F.col("app").alias("other"), F.col("sessions").alias("weight"))
    cells = t.select("tower_id", F.floor(F.unix_micros("timestamp") / (seconds * 1_000_000)).alias("bin"), "mobile_number").distinct()
    own = cells.filter(F.col("mobile_number") == party).select("tower_id", "bin")
    near = cells.filter(F.col("mobile_number") != party).join(own, ["tower_id", "bin"], "left_semi").groupBy("mobile_number").agg(F.count(F.lit(1)).alias("weight"))
    near = near.filter(F.col("weight") >= least).select(F.lit("colocated").alias("kind"), F.col("mobile_number").alias("other"), "weight")
    return _union([contacts, apps, near])


def evasion_indicators(t: DataFrame, c: DataFrame, i: DataFrame, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    """(party, indicator) rows from device, encryption, silence, short-life and travel operators."""
    row = lambda df, key, name: df.select(F.col(key).alias("party"), F.lit(name).alias("indicator")).distinct()
    return _union([
        row(cdr.device_profile(c).filter("device_switching"), "subject", "CALL_DEVICES"), row(identity.imei_timeline(t).filter("high_risk"), "mobile_number", "TOWER_DEVICES"),
        row(ipdr.encryption_profile(i).filter("encrypted_pct >= 60"), "subject", "MOSTLY_ENCRYPTED"), row(cdr.silent_periods(c, tie=tie), "subject", "CALL_SILENCE"),
        row(behaviour.burner_score(t).filter("kind = 'SUSPECT'"), "mobile_number", "SHORT_LIVED"), row(movement.impossible_subjects(t, lat=lat, lon=lon, tie=tie), "mobile_number", "IMPOSSIBLE_TRAVEL")])


def evasion_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("party").agg(F.count(F.lit(1)).alias("indicators"), F.array_sort(F.collect_list("indicator")).alias("codes"))


def device_snapshot(t: DataFrame, c: DataFrame, i: DataFrame, party: str, as_of, recent: int = 5) -> DataFrame:
    """State of a party at a moment: last tower and the last few calls and sessions."""
    moment = F.lit(as_of).cast("timestamp")
    last = t.filter((F.col("mobile_number") == party) & (F.col("timestamp") <= moment)).agg(
        F.max("timestamp").alias("at"), F.max_by("tower_id", "timestamp").alias("detail")).filter("at IS NOT NULL").select(F.lit("tower").alias("source"), "at", "detail")
    events = correlate.timeline(c.filter((F.col("subject") == party) & (F.col("datetime") <= moment)), i.filter((F.col("subject") == party) & (F.col("start_time") <= moment)))
    tail = cdr.top_k(events, ["source"], [F.desc("at"), "detail"], recent, "_n").select("source", "at", "detail")
    return last.unionByName(tail)


def device_patterns(t: DataFrame, party: str, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> DataFrame:
    """Movement, hours, devices and company of one number in long form ``(section, item, value)``."""
    own = t.filter(F.col("mobile_number") == party)
    row = lambda df, section, item, value: df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    tr = movement.trajectories(own, lat=lat, lon=lon, tie=tie)
    way = tr.select(F.lit("movement").alias("section"), F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in ("records", "towers", "moves", "km")])))
    hours = own.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    devices = identity.spans(own, "mobile_number", "imei")
    return _union([way, row(hours, "hour", F.col("hour"), F.col("n")), row(devices, "device", F.col("imei"), F.col("records")), row(
        party_network(t, t.select(F.col("mobile_number").alias("subject"), F.lit(None).cast("string").alias("b_party"), F.lit(True).alias("is_provider_message")).limit(0),
                      t.select(F.col("mobile_number").alias("subject"), F.lit(None).cast("string").alias("detected_app"), F.lit("LOW").alias("app_risk")).limit(0), party),
        "colocated", F.col("other"), F.col("weight"))])


def day_timeline(c: DataFrame, i: DataFrame, day: str, tie: Sequence[str] = TIE) -> DataFrame:
    """All calls and sessions of one day, with the sessions that follow a call marked."""
    c = c.filter(F.to_date("datetime") == F.lit(day).cast("date"))
    i = i.filter(F.to_date("start_time") == F.lit(day).cast("date"))
    after = correlate.call_to_data(c, i, tie=tie).select("subject", F.col("data_start").alias("at"), F.col("app").alias("detail"), F.lit("session").alias("source"), "risk")
    worst = after.groupBy("subject", "at", "source", F.coalesce("detail", F.lit("")).alias("_d")).agg(
        F.max(F.when(F.col("risk") == "HIGH", 3).when(F.col("risk") == "MEDIUM", 2).otherwise(1)).alias("_r"))
    rows = correlate.timeline(c, i).withColumn("_d", F.coalesce("detail", F.lit("")))
    out = rows.join(worst, ["subject", "at", "source", "_d"], "left")
    return out.select("subject", "at", "source", "detail", "seconds", F.when(F.col("_r") == 3, "HIGH").when(F.col("_r") == 2, "MEDIUM").when(F.col("_r") == 1, "LOW").alias("after_call"))


def integrated_risk(c: DataFrame, i: DataFrame, t: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    """One row per party with every score there is.

    ``combined`` is a choice of this library, as no rule for it exists elsewhere: the mean of
    the call score, the session score and the amplified correlation score over the sources a
    party has, plus five per profile indicator, at most 100.  Calls and sessions are read by many parts, so what these
    need is kept; the correlation score and its factor come from one row of counts.
    """
    c = kept(c, ["subject", "a_party", "b_party", "datetime", "duration_seconds", "call_type", "imei", "imsi", "first_cell", "last_cell", "is_provider_message", *tie], "calls")
    i = kept(i, ["subject", "start_time", "end_time", "session_duration", "data_volume_up", "data_volume_down", "total_data_volume", "destination_port",
                 "detected_app", "app_risk", "is_encrypted", "is_odd_hour", "day", "day_of_week", *tie], "sessions")
    return _integrated_risk(c, i, t, tie)


def _integrated_risk(c: DataFrame, i: DataFrame, t: DataFrame, tie: Sequence[str]) -> DataFrame:
    talk = risk.cdr_risk_components(cdr.cdr_patterns(c)).select(F.col("subject").alias("party"), F.col("score").cast("double").alias("call_score"))
    data = ipdr.ipdr_risk(i, tie=tie).select(F.col("subject").alias("party"), F.col("score").cast("double").alias("session_score"))
    k = correlate.correlate(c, i, tie)
    linked = k["score"].select(F.col("subject").alias("party"), F.least(F.col("score") * correlate.multiplier(), F.lit(100.0)).alias("correlation_score"))
    codes = crossref.profiles(t, c, i).select("party", F.size("indicators").alias("indicators"))
    out = talk.join(data, "party", "full_outer").join(linked, "party", "full_outer").join(codes, "party", "full_outer")
    names = ("call_score", "session_score", "correlation_score")
    have = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in names])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(n), F.lit(0.0)) for n in names])
    n = F.coalesce("indicators", F.lit(0))
    combined = F.least(F.when(have > 0, total / have).otherwise(0.0) + n * 5, F.lit(100.0))
    return out.select("party", *names, n.alias("indicators"), combined.alias("combined"), level((combined >= 70, "HIGH"), (combined >= 40, "MEDIUM")).alias("level"))


def priority_list(scores: DataFrame, threshold: float = 40, k: int = 50) -> DataFrame:
    """The ``k`` highest combined scores from ``threshold`` on."""
    return scores.filter(F.col("combined") >= threshold).orderBy(F.desc("combined"), "party").limit(k).select("party", "combined", "level", "indicators")


def coordination(c: DataFrame, i: DataFrame, tie: Sequence[str] = TIE) -> dict[str, DataFrame]:
    k5 = correlate.encrypted_after_call(correlate.call_to_data(c, i, tie=tie))
    return {"synchronized_calls": network.synchronized(c, tie=tie), "coordinated_encryption": correlate.coordinated_pairs(correlate.coordinated_encryption(k5, by_pair=True), by_pair=True),
            "channel_shifts": correlate.channel_shifts(c, i), "pattern_days": cdr.pattern_days(c).filter("concentration <> 'LOW'")}


def dossier(c: DataFrame, i: DataFrame, party: str, tie: Sequence[str] = TIE) -> DataFrame:
    """Patterns, sessions and correlation of one party in long form; the filter is applied first."""
    c, i = c.filter(F.col("subject") == party), i.filter(F.col("subject") == party)
    melt = lambda df, section, columns: df.select(F.lit(section).alias("section"), F.inline(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("string").alias("value")) for n in columns])))
    talk = cdr.cdr_patterns(c)
    data = ipdr.ipdr_risk(i, tie=tie)
    linked = correlate.correlate(c, i, tie)["score"]
    return _union([melt(talk, "calls", ("total", "imei_count", "bursts", "voice_only", "contacts", "tower_count", "activity_change")),
                   melt(risk.cdr_risk_components(talk), "call_risk", ("score", "level")), melt(data, "sessions", ("encryption_score", "data_score", "session_score", "app_score", "score", "level")),
                   melt(linked, "correlation", ("call_to_data", "encrypted_after_call", "silences", "shifts", "score", "level"))])


def evidence_links(c: DataFrame, i: DataFrame, tie: Sequence[str] = TIE) -> DataFrame:
    """Chains, data in silence and coordinated encryption per subject."""
    k = correlate.correlate(c, i, tie)
    ends = graph.degrees(correlate.coordinated_encryption(k["encrypted_after_call"], by_pair=True))  # counted where they are listed
    row = lambda df, name: df.groupBy("subject").agg(F.count(F.lit(1)).alias("links")).select("subject", F.lit(name).alias("kind"), "links")
    return _union([row(k["chains"], "CHAIN"), row(k["data_in_silence"].filter("risk = 'HIGH'"), "DATA_IN_SILENCE"),
                   ends.select(F.col("node").alias("subject"), F.lit("COORDINATED_ENCRYPTION").alias("kind"), F.col("degree").alias("links"))])


def group_activity(t: DataFrame, at, tie: Sequence[str] = TIE) -> dict[str, DataFrame]:
    edges = graph.colocation_edges(t)
    return {"convoys": movement.convoys(t, tie=tie), "appearance": charts.appearance_classes(t, at), "clusters": graph.cluster_stats(edges, graph.components(edges)),
            "group_windows": behaviour.group_windows(t, tie=tie)}


def movement_patterns(t: DataFrame, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> dict[str, DataFrame]:
    moves = movement.timed_moves(t, lat=lat, lon=lon, tie=tie)
    vehicles = movement.vehicle_moves(moves)
    return {"vehicle_users": movement.vehicle_users(vehicles), "fast_moves": movement.fast_moves(moves), "impossible": movement.impossible_subjects(t, lat=lat, lon=lon, tie=tie),
            "traffic": movement.tower_traffic(t, tie=tie), "circular": movement.trajectory_classes(movement.trajectories(t, lat=lat, lon=lon, tie=tie)).filter("circular OR long_distance")}


def cross_reference(t: DataFrame, c: DataFrame, i: DataFrame, tie: Sequence[str] = TIE) -> dict[str, DataFrame]:
    return {"silent_devices": crossref.silent_devices(t, c, i), "call_links": crossref.link_summary(crossref.link_calls(t, c)),
            "unplaced_sessions": crossref.unplaced_sessions(t, i, tie=tie), "high_profiles": crossref.profiles(t, c, i).filter("high")}


def tower_report(t: DataFrame, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> dict[str, DataFrame]:
    edges = graph.colocation_edges(t)
    return {"summary": summaries.dump_summary(t), "one_time_visitors": behaviour.one_time_visitors(t), "burner": behaviour.burner_score(t).filter("kind = 'SUSPECT'"),
            "trajectories": movement.trajectories(t, lat=lat, lon=lon, tie=tie), "impossible": movement.impossible_subjects(t, lat=lat, lon=lon, tie=tie),
            "identity": identity.identity_totals(t), "device_sharing": identity.device_sharing(t), "hubs": graph.degree_centrality(edges).filter("hub"),
            "isolated": graph.isolated_devices(t, edges)}


def ipdr_report(i: DataFrame, topic: str | None = None, tie: Sequence[str] = TIE) -> dict[str, DataFrame]:
    """Session report; ``topic`` picks one of encryption, data, sessions, apps or risk."""
    topics = {
        "encryption": lambda: {"encryption": ipdr.encryption_score(i), "encrypted_apps": ipdr.encryption_by_app(i)},
        "data": lambda: {"data": ipdr.data_score(i), "upload_spikes": ipdr.upload_spikes(i)},
        "sessions": lambda: {"sessions": ipdr.session_score(i, tie), "marathons": ipdr.marathon_sessions(i, tie=tie)},
        "apps": lambda: {"apps": ipdr.app_score(i, tie), "app_usage": ipdr.app_usage(i)},
        "risk": lambda: {"risk": ipdr.ipdr_risk(i, tie=tie)}}
    if topic is not None:
        return topics[topic]()
    out = {"summary": ipdr.ipdr_summary(i)}
    for make in topics.values():
        out |= make()
    return out


def cdr_report(c: DataFrame) -> dict[str, DataFrame]:
    p = cdr.cdr_patterns(c)
    r = risk.cdr_risk_report(p)
    return {"anomalies": risk.critical_anomalies(p), "ranking": risk.rank_subjects(r), "common_contacts": network.pairwise_common(network.contact_edges(c)), "priorities": risk.priority_list(r)}


def integrated_report(c: DataFrame, i: DataFrame, t: DataFrame, lat: str = "lat", lon: str = "long", tie: Sequence[str] = TIE) -> dict[str, DataFrame]:
    c, i, t = kept(c, c.columns, "calls"), kept(i, i.columns, "sessions"), kept(t, t.columns, "towers")  # every part reads them
    tag = lambda name, report: {f"{name}.{k}": v for k, v in report.items()}
    return {"overview": risk.load_summary(c, i, t), **tag("tower", tower_report(t, lat, lon, tie)), **tag("ipdr", ipdr_report(i, tie=tie)), **tag("cdr", cdr_report(c)),
            **tag("cross", cross_reference(t, c, i, tie)), "risk": _integrated_risk(c, i, t, tie), "links": evidence_links(c, i, tie)}


def load_report(c: DataFrame, i: DataFrame, t: DataFrame, as_of, lon: str = "long") -> DataFrame:
    """What was loaded and how good it is, per source, in long form ``(source, item, value)``."""
    row = lambda df, source, item, value: df.select(F.lit(source).alias("source"), item.cast("string").alias("item"), value.cast("double").alias("value"))
    base = risk.load_summary(c, i, t).select("source", F.inline(F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in ("records", "parties")])))
    shown = [F.col(n) if n in i.columns else F.lit(None).cast("string").alias(n)
             for n in ("subject", "start_time", "end_time", "destination_ip", "destination_port", "protocol", "data_volume_up", "data_volume_down")]
    data = ipdr.ipdr_summary(i).agg(F.sum("sessions").alias("n"), F.sum("encrypted").alias("e"))
    q = quality.ipdr_quality_report(i.select(*shown), as_of).filter("check <> 'completeness'")
    talk = summaries.cdr_summary(c).agg(F.sum("provider_messages").alias("n"))
    return _union([base, row(data, "ipdr", F.lit("encrypted"), F.col("e")), row(q, "ipdr", F.concat_ws(".", "check", "item"), F.col("value")),
                   row(talk, "cdr", F.lit("provider_messages"), F.col("n")), row(quality.tower_quality(t, lon=lon), "tower", F.concat_ws(".", "column", "problem"), F.col("rows"))])
