"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assetloom.operators.raster import resample_lines  # noqa: E402
from assetloom.plans.catalog import QUERIES  # noqa: E402
from assetloom.session import build_session, written  # noqa: E402

HEADLINE = [
    "a14_analyze", "a16_class_report", "b8_plan_build", "b14_lock_diff", "b19_content_duplicates", "d3_format_shortlist",
    "d5_pick_winner", "d6_forced_fallback", "d9_explain", "k1_iso_quality", "k3_bucket_medians", "k10_pivot_tools",
    "l12_run_lint", "l17_nearest_config", "l21_lint_summary", "m4_set_tags", "m9_metadata_audit", "q1_quality_ladder",
    "q3_block_ssim", "q7_bisect_quality", "r4_plan_resize", "r7_resample", "r13_composite", "s12_asset_info", "v7_picture_html",
    "w4_debounce", "w6_stream_build", "p8_web",
]


def wide_lines(spark, sf_dir: str):
    """Every vector as a scanline of 2048 pixels, 1024 lines an asset; and how many megapixels that is."""
    sample = "x -> cast(least(greatest(floor((embedding[x % 64] + 1) * 127.5), 0), 255) as int)"
    lines = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr(
        "vec_id div 1024 AS asset_id", "2048 AS w", "1024 AS h", "cast(vec_id % 1024 as int) AS y", "512 AS dw", "256 AS dh",
        *[f"transform(sequence(0, 2047), {sample.replace('x %', f'({k} * x) %')}) AS {c}" for k, c in ((1, "r"), (3, "g"), (5, "b"), (7, "a"))])
    stored = written(lines.repartition(4 * spark.sparkContext.defaultParallelism), "lines")
    return stored, stored.count() * 2048 / 1e6


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session("assetloom-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # warm the session, not the queries
    only = set(sys.argv[1:])
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    lines, megapixels = wide_lines(spark, sf_dir)
    start = time.perf_counter()
    resample_lines(lines).write.format("noop").mode("overwrite").save()
    per_mp = round((time.perf_counter() - start) / megapixels, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "resample_seconds_per_mp": per_mp, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
