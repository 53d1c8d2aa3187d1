"""Time the headline queries: seconds to compute every row of each, after one warm-up query. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tracewarden.plans.catalog import QUERIES  # noqa: E402
from tracewarden.session import local_session  # noqa: E402

HEADLINE = [
    "event_search", "event_dashboard", "timeline_hour", "brute_force", "credential_stuffing", "lateral_movement",
    "escalation_chain", "persistence_after_auth", "after_hours_auth", "new_source_auth", "correlate", "sigma_builtin",
    "sigma_modifiers", "sigma_documents", "entity_deviations", "entity_lateral", "risk_scores", "entity_snapshot",
    "alert_cooldown", "detect_alerts", "narrative_sections", "json_events", "windows_xml", "linux_lines", "syslog_messages",
    "network_events", "dedup_events",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, int(cores) if cores.isdigit() else 8)
    names = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("severity_histogram")
    seconds = {name: round(run(name), 3) for name in names}
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
