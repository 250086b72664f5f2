from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assetloom.operators import analysis as A
from assetloom.operators import raster as R

gray = lambda v: (v, v, v, 255)


def brute(w, h, fn):
    px = [[fn(x, y) for x in range(w)] for y in range(h)]
    lum = [[(77 * p[0] + 150 * p[1] + 29 * p[2]) >> 8 for p in row] for row in px]
    flat = [p for row in px for p in row]
    hist = Counter(v for row in lum for v in row)
    n = w * h
    grads = [abs(lum[y][x + 1] - lum[y][x]) + abs(lum[y + 1][x] - lum[y][x]) for y in range(h - 1) for x in range(w - 1)]
    bins = Counter((p[0] >> 4) * 256 + (p[1] >> 4) * 16 + (p[2] >> 4) for p in flat)
    dom = min(b for b in bins if bins[b] == max(bins.values()))
    return {
        "entropy": -sum(c / n * math.log2(c / n) for c in hist.values()),
        "bimodality": sum(sorted(hist.values())[-2:]) / n,
        "unique_colors": len({p[:3] for p in flat}), "unique_saturated": len({p[:3] for p in flat}) >= 4096,
        "gray_ratio": sum(max(p[:3]) - min(p[:3]) <= 12 for p in flat) / n,
        "sat_low_ratio": sum(max(p[:3]) - min(p[:3]) <= 32 for p in flat) / n,
        "alpha_transparent": sum(p[3] == 0 for p in flat) / n, "alpha_translucent": sum(0 < p[3] < 255 for p in flat) / n,
        "edge_ratio": sum(g >= 48 for g in grads) / len(grads) if grads else 0.0,
        "flat_ratio": sum(g <= 4 for g in grads) / len(grads) if grads else 1.0,
        "dom_r": (dom >> 8) * 16 + 8, "dom_g": (dom >> 4 & 15) * 16 + 8, "dom_b": (dom & 15) * 16 + 8,
    }


rng = random.Random(7)
NOISE = {(x, y): tuple(rng.randrange(256) for _ in range(4)) for x in range(80) for y in range(70)}
IMAGES = {
    1: (8, 8, lambda x, y: gray(255 if (x + y) % 2 else 0)), 2: (8, 8, lambda x, y: gray(90)),
    3: (1, 5, lambda x, y: gray(y * 50)), 4: (80, 70, lambda x, y: NOISE[(x, y)]), 5: (5, 1, lambda x, y: (x * 9, 0, 0, x * 60)),
    6: (16, 40, lambda x, y: (200, x * 16, y * 6, 255 if x else 0)),
}


@pytest.mark.parametrize("band", [1, 3, 256])
def test_features_against_brute_force(make_px, band):
    px = make_px(IMAGES)
    lines = R.collect_scanlines(px)
    got = {r.asset_id: r.asDict() for r in A.color_features(px).join(A.edge_flat_ratios(lines, band), "asset_id").collect()}
    for k, (w, h, fn) in IMAGES.items():
        for name, want in brute(w, h, fn).items():
            assert got[k][name] == pytest.approx(want, abs=1e-9), (k, name)


def test_one_feature_operators_agree_with_the_combined_one(make_px):
    px = make_px(IMAGES)
    whole = {r.asset_id: r for r in A.color_features(px).collect()}
    colors, hist = A.color_counts(px), A.luma_histogram(px)
    for df in (A.entropy(hist), A.bimodality(hist), A.unique_colors(colors), A.gray_ratio(colors), A.alpha_ratios(colors), A.dominant_color(colors)):
        for r in df.collect():
            for c in df.columns:
                assert r[c] == pytest.approx(whole[r.asset_id][c]), c


def test_row_stride(spark):
    df = spark.createDataFrame([(2001, 2001), (2002, 2001), (4001, 2001), (1, 9)], "w INT, h INT")
    assert [r[0] for r in df.select(A.row_stride(F.col("w"), F.col("h"))).collect()] == [1, 1, 2, 1]


def row(**kw):
    base = dict(width=1000, height=800, has_exif=False, source_format="png", unique_colors=4096, unique_saturated=True,
                entropy=3.0, bimodality=0.1, gray_ratio=0.1, flat_ratio=0.1, edge_ratio=0.5)
    return {**base, **kw}


CASES = [
    (row(source_format="ico", has_exif=True), "icon", 0.8), (row(width=128, height=64), "icon", 0.8),
    (row(width=128, height=63), "photograph", 0.4), (row(width=100, height=100, has_exif=True), "photograph", 0.9),
    (row(bimodality=0.55, gray_ratio=0.85, entropy=4.49), "document", 0.7),
    (row(bimodality=0.9, gray_ratio=0.9, entropy=4.5), "photograph", 0.8), (row(entropy=4.0), "photograph", 0.8),
    (row(entropy=4.2, unique_colors=256, unique_saturated=False), "graphic-logo", 0.85),
    (row(entropy=4.2, flat_ratio=0.6, edge_ratio=0.07), "graphic-logo", 0.7), (row(flat_ratio=0.6, edge_ratio=0.079), "graphic-logo", 0.7),
    (row(flat_ratio=0.35, height=700), "ui-screenshot", 0.6), (row(flat_ratio=0.35, height=800), "photograph", 0.4),
    (row(unique_colors=257, unique_saturated=False), "photograph", 0.4),
]


def test_cascade(spark):
    df = spark.createDataFrame([{**c, "i": i} for i, (c, *_) in enumerate(CASES)])
    got = {r.i: (r["class"], r.confidence) for r in A.classify(df).collect()}
    assert [got[i] for i in range(len(CASES))] == [(c, p) for _, c, p in CASES]


def test_degenerate(spark):
    df = spark.createDataFrame([(0, 5), (5, 5)], "width INT, height INT")
    assert [bool(r.reason) for r in A.degenerate(df).collect()] == [True, False]
