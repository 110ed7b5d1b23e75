"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

HEADLINE = (
    "consistency_score",
    "consistency_segments",
    "consistency_classes",
    "consistency_tracks",
    "iou_pairs",
    "cascade_status",
    "cascade_final",
    "parse_boxes",
    "parse_segments",
    "parse_poses",
    "parse_texts",
    "yolo_lines",
    "coco_annotations",
    "vision_records",
    "voc_documents",
    "overlay_primitives",
    "detection_eval",
    "class_distribution",
    "inference_drafts",
    "run_metrics",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tagloom.plans.queries import registered

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registered(), {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.monotonic()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": pathlib.Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
