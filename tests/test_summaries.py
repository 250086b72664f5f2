from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.functions import paths as PA
from assetloom.functions import scalars as S
from assetloom.operators import benchstats as K
from assetloom.operators import responsive as V


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_are_exact(spark, q):
    rng = random.Random(5)
    groups = {
        "one": [3.5], "two": [1.0, 2.0], "ties": [7.0] * 50 + [8.0], "mixed": [rng.uniform(-1e6, 1e6) for _ in range(501)],
        "tiny": [rng.uniform(-1e-9, 1e-9) for _ in range(200)] + [0.0, -0.0], "ints": [float(rng.randrange(100)) for _ in range(400)],
        "close": [1e9 + i / 8 for i in range(64)],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("ints", None)], "k STRING, v DOUBLE")
    got = {r.k: r.v for r in K.exact_quantile(df, ["k"], "v", q).collect()}
    for k, vs in groups.items():
        assert got[k] == pytest.approx(float(np.quantile(vs, q)), rel=1e-12, abs=1e-18), k


def test_median_has_no_group_wide_window_over_rows(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    assert {r.k: r.v for r in K.exact_quantile(df, ["k"], "v").collect()} == {0: 499.0, 1: 500.0}


def test_iso_quality_ties(spark):
    df = spark.createDataFrame([("i", "t", 1, 80.0, 500), ("i", "t", 2, 84.0, 400), ("i", "t", 3, 90.0, 10)],
                               "image STRING, tool STRING, q INT, score DOUBLE, bytes BIGINT")
    row = K.iso_quality(df).first()
    assert (row.q, row.bytes) == (2, 400)


def test_buckets(spark):
    df = spark.createDataFrame([(1.99,), (2.0,), (11.9,), (12.0,), (1e10,)], "mp DOUBLE")
    assert [r[0] for r in df.select(K.mp_bucket(F.col("mp"))).collect()] == ["small", "medium", "medium", "large", "large"]


def test_pinning(spark):
    cases = [(["web", "in.png"], None), (["-o", "out.avif"], "-o out.avif"), (["--output=x/y.PNG"], "-o y.PNG"), (["-o", "-"], None),
             (["-o", "dir/noext"], None), (["--format", "webp"], "--format webp"), (["-o"], None)]
    df = spark.createDataFrame(cases, "args ARRAY<STRING>, want STRING")
    assert df.where(~K.pinning_arg(F.col("args")).eqNullSafe(F.col("want"))).collect() == []


def test_widths_and_markup(spark):
    df = spark.createDataFrame([(1, "a", 500, 400, "400, 200,200"), (2, "b", 100, 100, "200"), (3, "c", 10, 10, "1,,2")],
                               "asset_id BIGINT, stem STRING, src_w INT, src_h INT, spec STRING")
    out = V.variant_dims(V.surviving_widths(df.withColumn("widths", V.parse_widths(F.col("spec")))))
    assert [bool(r.reason) for r in out.orderBy("asset_id").collect()] == [False, True, True]
    html = {r.asset_id: r.html for r in V.picture_html(out, ["jpeg"]).collect()}
    assert html == {1: '<img srcset="a-200w.jpg 200w, a-400w.jpg 400w" src="a-400w.jpg" width="400" height="320" alt="">'}
    assert "shuffle" not in V.picture_html(out, ["avif", "jpeg"])._jdf.queryExecution().executedPlan().toString().lower()


def col_test(spark, fn, cases):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i INT, a STRING").select("i", fn(F.col("a")).alias("v"))
    got = {r.i: r.v for r in df.collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_scalars(spark):
    col_test(spark, S.parse_size, [("200KB", 200_000), ("1.5 MiB", 1_572_864), ("0", None), ("5", 5), (".5k", 500), ("1.2.3", None), ("9zb", None),
                                   ("0.4B", None), ("  7 b ", 7), ("", None)])
    col_test(spark, PA.lexical_clean, [("./a/b/../c", "a/c"), ("../a", "../a"), ("a/..", "."), ("/a//b/", "/a/b"), ("/..", "/.."), ("", "."), ("a/../../b", "../b")])
    col_test(spark, lambda c: S.fmt_bytes(c.cast("bigint")), [("999", "999 B"), ("1000", "1.0 KB"), ("1250", "1.2 KB"), ("1350", "1.4 KB"), ("1500000", "1.5 MB"),
                                                            ("123456789012", "123456.8 MB")])
    col_test(spark, S.escape_json, [('a"b\\c\n', '"a\\"b\\\\c\\n"'), ("", '""')])
    col_test(spark, PA.literal_root, [("assets/**/x", "assets"), ("*.png", "."), ("a/b/c.png", "a/b"), ("photos/", "photos"), ("/", ".")])


@pytest.mark.parametrize("pattern,crosses,yes,no", [
    ("*.png", True, ["a/b.png", "x.png"], ["x.pngx"]), ("*.png", False, ["x.png"], ["a/x.png"]), ("a/**/b", False, ["a/b", "a/x/y/b"], ["ab"]),
    ("**", False, ["", "a/b"], []), ("d[!0-4]?", True, ["d5x"], ["d3x", "d5"]), ("a+(b).c", True, ["a+(b).c"], ["aab.c"]), ("x/**", False, ["x/a/b"], ["x"]),
    ("a[!b]c", False, ["axc"], ["a/c", "abc"]), ("a[!b]c", True, ["a/c"], ["abc"]), ("[]x]y", True, ["]y", "xy"], ["y"]), ("[^a]", True, ["^", "a"], ["b"]),
])
def test_globs(pattern, crosses, yes, no):
    import re
    rx = re.compile(PA.glob_to_regex(pattern, crosses))
    assert all(rx.search(s) for s in yes) and not any(rx.search(s) for s in no)


def test_malformed_globs(spark):
    for bad in ("a**", "**b", "***", "[abc", "[!]"):
        with pytest.raises(ValueError):
            PA.glob_to_regex(bad, True)
    df = spark.createDataFrame([("abc",)], "p STRING")
    assert not df.select(PA.glob_matches(F.col("p"), "a**")).first()[0]
