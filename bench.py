"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all),
BENCH_REPEAT (default 3). Each query is built and fully executed into the
``noop`` sink (no collect to the driver); the reported time per query is the
median of BENCH_REPEAT runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "M4_mrg_review": "mrg_review",
    "G1_agg_sev_cat": "agg_sev_cat",
    "C9_chk_dispatch": "chk_dispatch",
    "V2_rag_topk": "rag_topk",
    "A5_rev_rules_line": "rev_rules_line",
    "V3_rag_topk_text": "rag_topk_text",
    "A6_rev_rules_block": "rev_rules_block",
    "review_diffs": "rev_review",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    os.environ.setdefault("SPARK_MASTER", f"local[{cpus}]")
    from reviewgrid.plans.catalog import load_all
    from reviewgrid.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    registry = load_all()
    times: dict[str, float] = {}
    for label, name in HEADLINE.items():
        build = registry[name].build
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i > 0:
                runs.append(time.perf_counter() - t0)
        times[label] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
