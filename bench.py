"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from matchspark.plans import catalog
from matchspark.session import local_session

HEADLINE = [
    "score_moments", "pack_timeline", "edit_plan", "clip_shots", "coverage_gaps", "rank_gaps", "covered_seconds", "anchor_for_scene", "score_ledger",
    "incident_coverage", "unique_evidence", "chapter_order", "enrich_with_annotations", "fill_gaps", "scene_metrics", "framing_verdict", "scorer_track",
    "request_stats", "phase_wall_time", "page_text", "semantic_tokens", "merge_reviews",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "matchspark-bench")
    times: dict[str, float] = {}
    catalog.QUERIES["score_moments"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
