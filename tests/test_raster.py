from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from assetloom.operators import raster as R


def grid(df, c="r"):
    return {(r["x"], r["y"]): r[c] for r in df.collect()}


def lanczos_rows(src, n, d):
    """Brute-force weights of one axis: clip, renormalise."""
    scale = n / d
    f = max(scale, 1.0)
    out = []
    for i in range(d):
        c = (i + 0.5) * scale
        w = []
        for s in range(n):
            t = (s + 0.5 - c) / f
            w.append(1.0 if abs(t) < 1e-12 else 0.0 if abs(t) >= 3 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2)
        out.append([v / sum(w) for v in w])
    return out


def lin(v):
    c = v / 255
    return c / 12.92 if c <= 0.040448237 else ((c + 0.055) / 1.055) ** 2.4


def enc(c):
    c = min(max(c, 0), 1)
    return math.floor((12.92 * c if c <= 0.0031308 else 1.055 * c ** (1 / 2.4) - 0.055) * 255 + 0.5)


@pytest.mark.parametrize("dw,dh", [(5, 3), (13, 11), (1, 1), (9, 2)])
def test_resample_against_brute_force(make_px, dw, dh):
    w, h = 9, 7
    value = lambda x, y: (x * 29 + y * 41 + (x * y) % 7 * 20) % 256
    px = make_px({1: (w, h, lambda x, y: (value(x, y), 10, 200, 255))})
    got = grid(R.resize(px, "exact", dw, dh))
    wx, wy = lanczos_rows(None, w, dw), lanczos_rows(None, h, dh)
    for j in range(dh):
        for i in range(dw):
            want = enc(sum(wy[j][y] * wx[i][x] * lin(value(x, y)) for y in range(h) for x in range(w)))
            assert abs(got[(i, j)] - want) <= 0, (i, j)


def test_solid_stays_solid_and_same_size_is_untouched(make_px):
    px = make_px({1: (6, 4, lambda x, y: (77, 3, 250, 128))})
    assert {(r.r, r.g, r.b, r.a) for r in R.resize(px, "max", 3).collect()} == {(77, 3, 250, 128)}
    odd = make_px({1: (4, 4, lambda x, y: (x * 60, y * 60, 5, 255))})
    assert sorted(R.resize(odd, "max", 4096).select(*odd.columns).collect()) == sorted(odd.collect())


def test_resize_modes(spark):
    df = spark.createDataFrame([(4000, 3000)], "w INT, h INT")
    dims = lambda *a: tuple(R.plan_resize(df, *a).select("dw", "dh").first())
    assert dims("max", 2048) == (2048, 1536) and dims("max", 9000) == (4000, 3000)
    assert dims("fit", 1000, 1000) == (1000, 750) and dims("cover", 1000, 1000) == (1333, 1000)
    assert dims("fill", 5000, 100) == (5000, 3750) and dims("exact", 7, 9) == (7, 9)
    assert dims("percent", None, None, 0.001) == (1, 1) and dims("percent", None, None, 150.0) == (6000, 4500)


def test_limits(spark):
    df = spark.createDataFrame([(50_000, 1), (50_001, 1), (20_000, 6_710), (20_000, 6_711)], "dw BIGINT, dh BIGINT")
    assert [r.reason for r in R.resize_limits(df).collect()] == [None, "edge", None, "area"]


# 2x3 image numbered 1..6 row by row; upright results written by hand from the EXIF definition
UPRIGHT = {1: [[1, 2], [3, 4], [5, 6]], 2: [[2, 1], [4, 3], [6, 5]], 3: [[6, 5], [4, 3], [2, 1]], 4: [[5, 6], [3, 4], [1, 2]],
           5: [[1, 3, 5], [2, 4, 6]], 6: [[5, 3, 1], [6, 4, 2]], 7: [[6, 4, 2], [5, 3, 1]], 8: [[2, 4, 6], [1, 3, 5]]}


@pytest.mark.parametrize("o", range(1, 9))
def test_orientation(make_px, o):
    px = make_px({1: (2, 3, lambda x, y: (y * 2 + x + 1, 0, 0, 255))}).withColumn("orientation", F.lit(o))
    out = R.auto_orient(px)
    got = grid(out)
    want = UPRIGHT[o]
    assert [[got[(x, y)] for x in range(len(want[0]))] for y in range(len(want))] == want
    row = out.first()
    assert (row.w, row.h, row.orientation) == (len(want[0]), len(want), None)


@pytest.mark.parametrize("o", range(1, 9))
def test_orientation_of_lines_in_blocks(make_px, o, monkeypatch):
    """Blocks of one column (two samples are fewer than a column has) give what one block gives; other columns stay."""
    px = make_px({1: (2, 3, lambda x, y: (y * 2 + x + 1, 0, 0, 255))}).withColumns({"orientation": F.lit(o), "name": F.lit("n")})
    lines = R.collect_scanlines(px.drop("name", "orientation")).withColumns({"orientation": F.lit(o), "name": F.lit("n")})
    for samples in (2, 3, 1 << 18):
        monkeypatch.setattr(R, "TURN_SAMPLES", samples)
        got = sorted(R.auto_orient_lines(lines).collect(), key=lambda r: r.y)
        assert [r.r for r in got] == UPRIGHT[o] and [r.y for r in got] == list(range(len(UPRIGHT[o])))
        assert {(r.w, r.h, r.orientation, r.name) for r in got} == {(len(UPRIGHT[o][0]), len(UPRIGHT[o]), None, "n")}


def test_orientation_of_lines_with_gaps_and_none(make_px):
    px = make_px({1: (2, 3, lambda x, y: (y * 2 + x + 1, 0, 0, 255))}).where("y <> 1")
    lines = R.collect_scanlines(px).withColumn("orientation", F.lit(6))
    assert [r.r for r in sorted(R.auto_orient_lines(lines).collect(), key=lambda r: r.y)] == [[5, None, 1], [6, None, 2]]
    kept = R.auto_orient_lines(lines.withColumn("orientation", F.lit(None).cast("int"))).orderBy("y").collect()
    assert [(r.y, r.r) for r in kept] == [(0, [1, 2]), (2, [5, 6])]
    assert R.auto_orient_lines(lines.limit(0)).collect() == []


def test_crop_of_lines(make_px):
    px = make_px({1: (5, 4, lambda x, y: (10 * y + x, 0, 0, 255)), 2: (2, 2, lambda x, y: (x + y, 0, 0, 255))})
    got = R.explode_pixels(R.crop_center_lines(R.collect_scanlines(px), 2, 3)).select(*px.columns)
    want = R.crop_center(px, 2, 3).select(*px.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gravity_saturates(spark):
    df = spark.createDataFrame([("southeast", 10, 10, 4, 4, 2), ("southeast", 10, 10, 40, 4, 2), ("center", 10, 9, 4, 4, 5),
                                ("north", 10, 10, 3, 4, 2), ("west", 10, 10, 4, 5, 9)],
                               "gravity STRING, bw INT, bh INT, ow INT, oh INT, margin INT")
    assert [(r.ox, r.oy) for r in R.gravity_place(df).collect()] == [(4, 4), (0, 4), (3, 2), (3, 2), (9, 2)]


def test_composite_opaque_clear_and_clipped(make_px, spark):
    base = make_px({1: (3, 3, lambda x, y: (100, 100, 100, 255))})
    over = spark.createDataFrame([(0, 0, 200, 0, 0, 255), (1, 0, 0, 200, 0, 0), (0, 1, 0, 0, 200, 128)],
                                 "x INT, y INT, r INT, g INT, b INT, a INT")
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in R.composite(base, over, 2, 1).collect()}
    assert got[(2, 1)] == (200, 0, 0, 255) and got[(0, 0)] == (100, 100, 100, 255)
    assert got[(2, 2)] == (50, 50, 150, 255) and len(got) == 9
    tiled = R.composite_tiled(base, over, 2, 2)
    assert tiled.where("r = 200").count() == 4


def test_scanlines_round_trip(make_px):
    px = make_px({1: (5, 3, lambda x, y: (x, y, x + y, 255)), 2: (1, 2, lambda x, y: (9, 8, 7, 0))})
    back = R.explode_pixels(R.collect_scanlines(px)).select(*px.columns)
    assert sorted(back.collect()) == sorted(px.collect())


def test_resampling_plan_and_bands(spark):
    from assetloom.operators import raster as R
    lines = spark.range(300).selectExpr("7L as asset_id", "8 as w", "300 as h", "cast(id as int) as y", *[
        f"transform(sequence(0, 7), x -> cast((x * {k} + id * 3) % 256 as int)) as {c}" for k, c in ((5, "r"), (9, "g"), (2, "b"))], "array_repeat(255, 8) as a")
    sized = R.plan_resize(lines, "exact", 5, 40)
    one = {r.y: (r.r, r.g, r.b, r.a) for r in R.resample_lines(sized, band_lines=10 ** 6).collect()}
    many = {r.y: (r.r, r.g, r.b, r.a) for r in R.resample_lines(sized, band_lines=16).collect()}
    assert one == many and sorted(one) == list(range(40)) and {len(v[0]) for v in one.values()} == {5}
    plan = R.resample_lines(sized)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "FlatMapGroupsInArrow" in plan


def test_strong_shrink_and_enlargement_stay_small(spark):
    """A kernel of thousands of taps, summed as lines stream in: no more memory than the destination's band takes."""
    import tracemalloc

    import numpy as np
    w = h = 3000
    at, weight, inside = R._kernel(6, w)
    assert at.shape == weight.shape == inside.shape and at.shape[1] <= 6 * w / 6 + 2
    line = np.random.default_rng(1).random((4, 1, w))
    tracemalloc.start()
    got = R._across(line, (at, weight, inside))
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()
    t = (np.arange(w) + 0.5 - (np.arange(6)[:, None] + 0.5) * 500) / 500
    dense = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0)
    assert np.allclose(got[:, 0], line[:, 0] @ (dense / dense.sum(axis=1, keepdims=True)).T)
    rows = [(1, 2, h, y, 2, 3, *([[y % 256, 7]] * 4)) for y in range(h)]
    lines = spark.createDataFrame(rows, "asset_id BIGINT, w INT, h INT, y INT, dw INT, dh INT, r ARRAY<INT>, g ARRAY<INT>, b ARRAY<INT>, a ARRAY<INT>")
    shrunk = {r.y: r.a for r in R.resample_lines(lines).collect()}
    assert sorted(shrunk) == [0, 1, 2] and all(x[1] == 7 and 100 < x[0] < 156 for x in shrunk.values())
    tall = R.resample_lines(lines.where("y < 4").selectExpr("asset_id", "w", "4 AS h", "y", "dw", "2000 AS dh", "r", "g", "b", "a"))
    assert sorted(r.y for r in tall.collect()) == list(range(2000))


def test_overlays_meet_lines(spark, make_px):
    """Line form and pixel form agree where the overlay sticks out on any side; the join is by line."""
    base = make_px({1: (9, 7, lambda x, y: (x * 20, y * 30, 5, (x * 40) % 256)), 2: (4, 3, lambda x, y: (9, 9, 9, 255))})
    over = make_px({0: (5, 4, lambda x, y: (200, x * 10, y * 10, 0 if x == y else 100 + x * 30))})
    lines, over_lines = R.collect_scanlines(base), R.collect_scanlines(over).select("y", "r", "g", "b", "a")
    side = over.select("x", "y", "r", "g", "b", "a")
    for ox, oy in ((0, 0), (-2, -1), (7, 5), (3, 2), (40, 40), (-9, 0)):
        want = sorted(R.composite(base, side, ox, oy).select(*base.columns).collect())
        assert sorted(R.explode_pixels(R.composite_lines(lines, over_lines, ox, oy)).select(*base.columns).collect()) == want
    want = sorted(R.composite_tiled(base, side, 5, 4).select(*base.columns).collect())
    out = R.composite_lines(lines, over_lines, tile=4)
    assert sorted(R.explode_pixels(out).select(*base.columns).collect()) == want
    assert out.count() == lines.count() and "_oy" in out._jdf.queryExecution().executedPlan().toString()
