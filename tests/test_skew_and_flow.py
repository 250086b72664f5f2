"""Dealt joins, size fits over one table of rungs, recipes on lines and the outcomes of the end-to-end flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetloom.operators import metadata as M
from assetloom.operators import quality as Q
from assetloom.operators import raster as R
from assetloom.operators import recipes as P
from assetloom.operators.skew import dealt_join
from assetloom.plans.web import FALLBACK, solve, with_fallback


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_dealt_join_is_a_join(spark):
    """A third of the rows on one key, NULL keys, keys of one side only, repeated rows on both sides."""
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97).alias("k"),
                                    F.concat(F.lit("p"), F.col("id") % 2500).alias("path"))
    one = spark.range(90).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v")).union(
        spark.createDataFrame([(0, "second"), (None, "none")], "k BIGINT, v STRING"))
    want = rows(many.join(one, "k"))
    for per in (1, 7, 100_000):
        assert rows(dealt_join(many, one, "k", ["path"], per)) == want
    assert dealt_join(many.limit(0), one, "k", ["path"]).count() == 0


def test_dealt_join_splits_popular_keys(spark):
    many = spark.range(1000).select(F.lit(5).alias("k"), F.col("id").cast("string").alias("path"))
    one = spark.createDataFrame([(5, "wide")], "k INT, v STRING")
    hot = many.groupBy("k").count()
    assert hot.count() == 1
    plan = dealt_join(many, one, "k", ["path"], 100)
    parts = plan.withColumn("p", F.pmod(F.xxhash64("path"), F.lit(10))).groupBy("p").count().collect()
    assert plan.count() == 1000 and len(parts) == 10 and max(r["count"] for r in parts) < 200


def test_copied_tags_of_a_popular_source(spark):
    tags = spark.createDataFrame([(1, "PRIMARY", 1, "a"), (1, "GPS", 2, "b"), (7, "PRIMARY", 3, "old"), (8, "PRIMARY", 4, "kept")],
                                 "asset_id BIGINT, ifd STRING, tag INT, value STRING")
    pairs = spark.createDataFrame([(7, 1), (9, 1), (10, 1), (11, 99)], "target_id BIGINT, source_id BIGINT")
    want = sorted([(1, "PRIMARY", 1, "a"), (1, "GPS", 2, "b"), (8, "PRIMARY", 4, "kept")] + [
        (t, i, n, v) for t in (7, 9, 10) for i, n, v in (("PRIMARY", 1, "a"), ("GPS", 2, "b"))], key=str)
    for per in (1, 100_000):
        assert rows(M.copy_metadata(tags, pairs, per)) == want


def test_fit_of_quality_then_scale(spark):
    ladder = spark.createDataFrame([(a, q, 10 * q + 100, lossy, budget) for a, lossy, budget in (
        (1, True, 500), (2, True, 60), (3, False, 600), (4, True, 0)) for q in range(1, 101)], "asset_id INT, q INT, bytes BIGINT, lossy BOOLEAN, budget BIGINT")
    rungs = Q.fit_ladder(ladder, F.col("lossy"), lambda size, pct: F.ceil(size * pct * pct / 10000.0))
    assert rungs.count() == 4 * 200
    got = {r.asset_id: (r.quality, r.scale_percent, r.bytes, r.met_budget) for r in Q.fit_under_size(rungs).collect()}
    assert got == {1: (40, 100, 500, True), 2: (1, 73, 59, True), 3: (None, 73, 587, True), 4: (1, 1, 1, False)}


def test_fit_reads_the_ladder_once(spark):
    ladder = spark.range(5).selectExpr("id AS asset_id", "100 AS q", "id AS bytes", "true AS lossy", "3 AS budget")
    plan = Q.fit_under_size(Q.fit_ladder(ladder, F.col("lossy"), lambda size, pct: size))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and "Join" not in plan and plan.count("Exchange") <= 1


def test_recipe_on_lines_is_the_recipe_on_pixels(make_px):
    px = make_px({1: (6, 4, lambda x, y: (40 * x, 60 * y, x * y, 255)), 2: (3, 9, lambda x, y: (x, y, 9, 200))}).withColumn("orientation", (F.col("asset_id") * 3 + 2).cast("int"))
    at = px.select("asset_id", "orientation").distinct()
    lines = R.collect_scanlines(px).join(at, "asset_id")
    P.register_op("red-only", lambda d, p: d.withColumns({"g": F.lit(0), "b": F.lit(0)}))
    try:
        for steps in ([("auto-orient", {}), ("invert", {}), ("resize", {"mode": "max", "width": "3"})],
                      [("auto-orient", {}), ("resize", {"mode": "fill", "width": "2", "height": "3"}), ("identity", {})],
                      [("auto-orient", {}), ("red-only", {}), ("invert", {})]):
            want = P.apply_recipe(px, steps).select("asset_id", "w", "h", "x", "y", "r", "g", "b", "a")
            got = R.explode_pixels(P.apply_recipe_lines(lines, steps)).select(*want.columns)
            assert rows(got) == rows(want)
    finally:
        del P.OPS["red-only"]


def entries(spark):
    return spark.createDataFrame([(1, 0, "webp", "lossy"), (1, 1, "png", "lossless")], "asset_id INT, ord INT, fmt STRING, disposition STRING")


def outcomes(spark, mode, target=0.0, budget=0):
    rungs = spark.createDataFrame([(1, q, q * 10, float(q)) for q in range(1, 101)], "asset_id INT, q INT, bytes BIGINT, metric DOUBLE")
    return {r.fmt: (r.quality, r.bytes, r.met_target, r.scale_percent, r.metric) for r in solve(entries(spark), rungs, mode, target, budget).collect()}


def test_outcomes_by_mode(spark):
    assert outcomes(spark, "fast") == {"webp": (85, 595, True, 100, 85.0), "png": (None, 1000, True, 100, 100.0)}
    assert outcomes(spark, "perceptual", 60.5) == {"webp": (61, 427, True, 100, 61.0), "png": (None, 1000, True, 100, 100.0)}
    assert outcomes(spark, "perceptual", 101.0)["webp"] == (100, 700, False, 100, 100.0)
    assert outcomes(spark, "size-budget", budget=300) == {"webp": (42, 294, True, 100, 42.0), "png": (None, 292, True, 54, None)}
    assert outcomes(spark, "size-budget", budget=3)["webp"] == (1, 3, True, 65, None)
    assert outcomes(spark, "size-budget", budget=0) == {"webp": (1, 1, False, 1, None), "png": (None, 1, False, 1, None)}


def test_fallback_joins_only_shortlists_without_lossy(spark):
    req = spark.createDataFrame([(1, "lossy", False, "jpeg"), (2, "lossless-flat", False, "jpeg"), (3, "lossless-flat", True, "jpeg"), (4, "lossless-flat", True, "webp"), (5, "lossless-flat", False, "png")],
                                "asset_id INT, bucket STRING, has_alpha BOOLEAN, source_format STRING").selectExpr("*", "'web' AS profile", "'fast' AS mode", "true AS webp_lossy", "true AS avif")
    got = {(r.asset_id, r.fmt) for r in with_fallback(req).where(F.col("ord") == FALLBACK).collect()}
    assert got == {(2, "jpeg"), (4, "webp")}
