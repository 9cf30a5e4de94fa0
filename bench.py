"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wayscore.plans import catalog  # noqa: E402
from wayscore.session import build_session  # noqa: E402

HEADLINES = (
    "model_ranking", "scene_metrics", "displacement_errors", "hausdorff_distance", "dynamic_time_warping", "trajectory_quality",
    "match_detections", "average_precision", "confusion_matrix", "non_maximum_suppression", "best_overlap_box",
    "track_summaries", "region_entry_counts", "tracking_summary", "tracked_objects",
    "feature_covariance", "frechet_feature_distance", "similarity_index", "scene_consistency",
    "caption_report", "caption_model_rows", "depth_error_suite", "flow_error_summary", "chamfer_distance", "min_displacement_by_kind",
    "exposure_statistics", "spectral_flicker", "segmentation_overlap",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
    spark = build_session(f"local[{cpus}]", "wayscore-bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory=os.environ.get("BENCH_MEM", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["displacement_errors"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        spark.catalog.clearCache()
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total_headline_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
