"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from stridelake.plans import registry

HEADLINE = ["e1_clip_report", "d10_forward_kinematics", "f4_contact_hysteresis", "f6_clean_mask", "f1_finite_difference", "e2_root_speed", "e3_foot_sliding", "e5_angular_smoothness", "e11_audit_breakdowns", "e20_binary_auroc", "e21_average_precision", "e37_transitivity", "d14_consistency_pairs", "i16_target_severity", "g8_query_priority"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times, clips = registry.queries(), {}, 0
    queries[HEADLINE[0]](spark, sf_dir).count()  # starts the engine
    for name in HEADLINE:
        start = time.time()
        n = len(queries[name](spark, sf_dir).toArrow())
        times[name] = round(time.time() - start, 3)
        clips = n if name == registry.FLAGSHIP else clips
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "clips_graded_per_second": round(clips / times[registry.FLAGSHIP], 1), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
