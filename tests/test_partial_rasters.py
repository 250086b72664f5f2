"""Rasters of which pixels are missing: at the end, inside of lines, whole lines."""

from __future__ import annotations

import duckdb
import pytest

from assetloom.operators import raster as R
from oracle_check import DATA, compare, connect

PLANES = ["r", "g", "b", "a"]


def cut(root, *tiles):
    """Embeddings whose mosaics keep these tiles: the first eight (one per orientation) the first choice, and so on."""
    keep = " ".join(f"WHEN {i} THEN {test}" for i, test in enumerate(tiles))
    duckdb.connect().execute(f"""COPY (SELECT * FROM '{DATA}/sf0.001/embeddings.parquet' WHERE CASE vec_id // 16 // 8 {keep} ELSE true END)
        TO '{root}/embeddings.parquet' (FORMAT parquet)""")
    return str(root)


@pytest.fixture(scope="module")
def partial(tmp_path_factory):
    """Short lines, lines with holes, lines that are gone."""
    return cut(tmp_path_factory.mktemp("partial"), "vec_id % 16 < 5", "vec_id % 16 NOT IN (1, 6, 11)", "vec_id % 16 NOT BETWEEN 4 AND 7")


@pytest.mark.parametrize("name", ["p8_web", "p8_web_traces", "p7_batch_apply", "r9_resize_fill_lines", "r11_auto_orient_lines", "r1_explode_pixels", "r13_composite_lines", "r13_watermark_lines", "r14_composite_tiled_lines"])
def test_query_on_partial_rasters(spark, partial, name):
    assert compare(spark, connect(partial), name, partial) is None


@pytest.mark.parametrize("name", ["a10_edge_flat_ratios", "a14_analyze"])
def test_edges_of_partial_rasters(spark, tmp_path, name):
    root = cut(tmp_path, "vec_id % 16 < 5", "vec_id % 4 <> 1", "vec_id % 16 < 2")
    assert compare(spark, connect(root), name, root) is None


def test_missing_pixels_have_their_place(make_px):
    px = make_px({1: (4, 2, lambda x, y: (10 * y + x, 1, 2, 3))}).where("not (y = 0 and x in (0, 2)) and not (y = 1 and x = 3)")
    lines = R.collect_scanlines(px)
    assert [r.r for r in lines.orderBy("y").collect()] == [[None, 1, None, 3], [10, 11, 12, None]]
    assert sorted(R.explode_pixels(lines).select(*px.columns).collect()) == sorted(px.collect())


def test_missing_pixels_of_an_overlay_cover_nothing(make_px):
    base = make_px({1: (5, 4, lambda x, y: (20 * x, 30 * y, 5, 90))})
    over = make_px({0: (3, 2, lambda x, y: (200, 10 * x, 10 * y, 120))}).where("not (y = 0 and x = 1) and not (y = 1 and x = 2)")
    side = over.select("x", "y", *PLANES)
    got = R.composite_lines(R.collect_scanlines(base), R.collect_scanlines(over).select("y", *PLANES), 1, 1)
    assert sorted(R.explode_pixels(got).select(*base.columns).collect()) == sorted(R.composite(base, side, 1, 1).select(*base.columns).collect())
    got = R.composite_lines(R.collect_scanlines(base), R.collect_scanlines(over).select("y", *PLANES), tile=2)
    assert sorted(R.explode_pixels(got).select(*base.columns).collect()) == sorted(R.composite_tiled(base, side, 3, 2).select(*base.columns).collect())


def short_lines(spark):
    """Lines as a file may hold them: cut short, empty, or not there at all."""
    rows = [(1, 6, 4, y, *[line] * 4) for y, line in enumerate([[10, 20, 30, 40, 50, 60], [70, 80, 90], [], None])]
    return spark.createDataFrame(rows, "asset_id BIGINT, w INT, h INT, y INT, r ARRAY<INT>, g ARRAY<INT>, b ARRAY<INT>, a ARRAY<INT>")


@pytest.mark.parametrize("size", [(3, 2), (3, 4), (9, 7)])
def test_short_lines_are_resampled_like_their_pixels(spark, size):
    lines = short_lines(spark)
    want = R.resize(R.explode_pixels(lines), "exact", *size)
    got = R.explode_pixels(R.resize_lines(lines, "exact", *size)).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 0


@pytest.mark.parametrize("o", range(1, 9))
def test_short_lines_are_turned_like_their_pixels(spark, o):
    lines = short_lines(spark).selectExpr("*", f"{o} AS orientation")
    want = R.auto_orient(R.explode_pixels(lines)).drop("orientation")
    got = R.explode_pixels(R.auto_orient_lines(lines)).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() == 9
