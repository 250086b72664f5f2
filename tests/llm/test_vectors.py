"""Vector operators against all pairs, with odd rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetloom.llm import vectors
from assetloom.llm.common import connected_components

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep bigint, uid string"
NAN, INF = float("nan"), float("inf")


def _rows():
    rng = np.random.default_rng(4)
    out = []
    for g in range(8):
        centre = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 4, 60]))):
            out.append((len(out), (centre + rng.normal(size=16) * rng.choice([0.1, 0.25])).astype(np.float32).tolist(), g % 2, 7, "u"))
    out += [(len(out) + k, out[0][1], out[0][2], None, None) for k in range(3)]
    return out


ODD = [(None, [1.0] * 16, 0, 1, "a"), (900, None, 0, 1, "a"), (901, [0.0] * 16, 0, 1, "a"), (902, [NAN] + [1.0] * 15, 0, 1, "a"), (903, [INF] + [1.0] * 15, 0, 1, "a"),
       (904, [None] + [1.0] * 15, 0, 1, "a"), (905, [1.0] * 16, None, 1, "a"), (906, [], 0, 1, "a"), (907, [1.0, 2.0], 0, 1, "a"), (908, [1.0] * 16, 0, 1, "a"), (908, [1.0] * 16, 0, 1, "a")]


@pytest.mark.parametrize("block", [1024, 8])
def test_cosine_links_equal_all_pairs(spark, block):
    rows = _rows()
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    low = np.arange(len(rows))
    for _ in rows:
        low = np.minimum(low, np.where(link, low[None, :], len(rows)).min(axis=1))
    out = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), tables=40, block=block).select("row.vec_id", "n_links", "component_id", "kept").collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {i: (int(link[i].sum()), int(low[i]), bool(low[i] == i)) for i in range(len(rows))}


def test_cosine_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    out = vectors.near_duplicates(df).select("row.vec_id", "row.label", "n_links", "component_id", "kept").collect()
    assert len(out) == len(ODD)
    group = [r for r in out if r.vec_id in (None, 908)]
    assert {(r.n_links, r.component_id) for r in group} == {(2, 908)} and sum(r.kept for r in group) == 1
    assert all(r.n_links == 0 and r.kept and r.component_id == r.vec_id for r in out if r.vec_id not in (None, 908))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [(1024, 8192), (5, 16)])
def test_nearest_equals_all_products(spark, blocks):
    rows = _rows() + ODD[1:-2]
    good = [r for r in rows if r[1] and len(r[1]) == 16 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    out = vectors.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 7 == 0, k=9, query_block=blocks[0], base_block=blocks[1]).collect()
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in out}
    want = {}
    for q in good:
        if q[0] % 7 == 0:
            s = sorted((-float(np.dot(np.float64(q[1]), np.float64(c[1]))), c[0]) for c in good if c[0] != q[0])[:9]
            want |= {(q[0], k + 1): (i, round(-v, 9)) for k, (v, i) in enumerate(s)}
    assert {k: v[1] for k, v in got.items() if k[0] != 907} == {k: v[1] for k, v in want.items()}
    assert sum(got[k] != want[k] for k in want) <= sum(1 for k in want if list(want.values()).count(want[k]) > 1)
    assert vectors.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 7 == 0).count() == 0


def test_quantised_bounds_hold():
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(50, 24)) * rng.lognormal(size=(50, 1)), rng.normal(size=(70, 24))
    bound, approx = vectors._bounds(x, y)
    assert (np.abs(x @ y.T - approx) <= bound).all() and (bound < 0.05 * np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(i, 1000) for i in range(500)] + [(7, 7)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert out[1000] == 0 and out[160] == 0 and len(out) == 501 and set(out.values()) == {0}
    far = {r.node: r.component for r in connected_components(spark.createDataFrame([(i, i + 1) for i in range(64)] + [(90, 80)], "a bigint, b bigint")).collect()}
    assert far[64] == 0 and far[90] == 80
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_tile_of_ties_takes_little_memory():
    """Equal queries and equal candidates: every pair survives, slice by slice."""
    import tracemalloc
    one = np.random.default_rng(2).random(64)
    side = lambda n, first, **more: pa.table({"uid": pa.array(range(first, first + n), pa.int64()), "vector": pa.array([one] * n), **more})
    queries, base = side(500, 0), side(4000, 10_000, id=pa.array(range(4000, 0, -1), pa.int64()))
    tracemalloc.start()
    out = vectors._tile(20)(None, queries, base)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400_000_000
    assert out.num_rows == 500 * 20 and out.slice(20, 20)["vec_id"].to_pylist() == list(range(1, 21))
