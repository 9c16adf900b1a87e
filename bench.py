"""Time the scan stages and headline queries; prints one JSON line.

Stages are timed on first use, so a query's own time excludes the stage tables it reads.
``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose input and cores.
"""

from __future__ import annotations

import json
import os
import time

from cipherledger.plans import catalogue
from cipherledger.plans.registry import scan
from cipherledger.session import local_session

STAGES = ("detections", "assets", "central", "decided", "impacts", "items")
HEADLINE = ("top_assets_per_application", "scenario_sweep", "policy_comparison", "decision_summary",
            "dashboard_tally", "risk_crosstab", "inventory_filtered_page", "roadmap_phase_rollup",
            "application_rollup", "bom_components", "config_cipher_suites", "lexical_tokens",
            "fan_out_detections", "enablement_waves")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    s = scan(spark, sf_dir)
    for stage in STAGES:
        t = time.time()
        getattr(s, stage).write.format("noop").mode("overwrite").save()
        times["stage_" + stage] = round(time.time() - t, 3)
    for name in HEADLINE:
        t = time.time()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total wall time of scan stages and headline queries",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cores": cpus,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
