"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is materialized in full by a no-op sink, so all rows and columns are computed.
``BENCH_DUCKDB=1`` also times the SQL statement of each query in DuckDB on stderr.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "B3_cdr_patterns", "T1_odd_hours", "T4_call_bursts", "T6_silent_periods", "C3_contact_frequency", "L3_impossible_travel", "N5_pairwise_common", "N8_synchronized",
    "V2_cdr_field_quality", "V22_tower_quality_report", "A2_ipdr_summary", "I13_concurrent_counts", "I18_app_transitions", "I23_ipdr_risk", "W6_activity_bursts",
    "H4_group_candidates", "H6_burner_score", "E5_imei_simultaneous", "E9_device_pairs", "M1_trajectories", "M7_quick_visits", "G4_overlap_zones", "G7_dwell",
    "Q1_colocation_edges", "Q5_in_out_degree", "X3_link_calls", "X7_profiles", "K2_call_to_data", "K4_data_in_silence", "R2_cdr_risk_components", "Z5_metric_correlation",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    import checks
    from tallymast.session import local_session

    checks.load_all()
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"))
    run = lambda name: checks.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("T1_odd_hours")  # start-up of the session is not a query
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    if os.environ.get("BENCH_DUCKDB"):
        from checks.compare import connect

        con = connect(folder)
        con.execute(f"SET threads={cpus}")
        for name in seconds:
            if name in checks.ORACLES:
                start = time.perf_counter()
                con.execute(checks.ORACLES[name]).fetchall()
                print(f"{name} spark {seconds[name]:.2f} duckdb {time.perf_counter() - start:.2f}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
