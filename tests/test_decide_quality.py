from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from assetloom.operators import decide as D
from assetloom.operators import quality as Q
from assetloom.schemas import CANDIDATES

SRC = "asset_id BIGINT, source_bytes BIGINT, source_format STRING, altered BOOLEAN, has_alpha BOOLEAN"


def pick(spark, cands, sources, **kw):
    c = spark.createDataFrame([(a, i, f, "lossy", 85, b, m) for a, i, f, b, m in cands], CANDIDATES)
    s = spark.createDataFrame([(*x, False, False) if len(x) == 3 else x for x in sources], SRC)
    return {r.asset_id: (r.winner, r.fmt, r.out_bytes, r.branch) for r in D.pick_winner(c, s).collect()}


def test_winner_edges(spark):
    got = pick(spark, [
        (1, 0, "avif", 95, True), (1, 1, "jpeg", 100, True),      # exactly five percent: switch
        (2, 0, "avif", 96, True), (2, 1, "jpeg", 100, True),      # four percent: keep the format
        (3, 0, "webp", 50, True), (3, 1, "webp", 50, True),       # tie: earlier entry
        (4, 0, "jpeg", 1000, True), (4, 1, "webp", 10, False),    # equal to the source, or off target
        (6, 0, "webp", 10, True),
    ], [(k, 1000, "jpeg") for k in (1, 2, 3, 4, 5, 6)])
    assert got == {1: (0, "avif", 95, "switch"), 2: (1, "jpeg", 100, "guard-kept"), 3: (0, "webp", 50, "switch-no-rival"),
                   4: (None, None, 1000, "pass-through"), 5: (None, None, 1000, "pass-through"), 6: (0, "webp", 10, "switch-no-rival")}


def test_forced_fallback(spark):
    cands = spark.createDataFrame([(1, 0, "png", "lossless", None, 900, True), (2, 0, "webp", "lossy", 85, 700, True),
                                   (3, 0, "png", "lossless", None, 900, True)], CANDIDATES)
    src = spark.createDataFrame([(1, 500, "jpeg", True, False), (2, 500, "jpeg", True, False), (3, 500, "jpeg", True, True),
                                 (4, 500, "jpeg", True, False)], SRC)
    trials = spark.createDataFrame([(k, f, 85, 600) for k in (1, 2, 3) for f in ("jpeg", "webp")], "asset_id BIGINT, fmt STRING, quality INT, bytes BIGINT")
    got = {r.asset_id: (r.fmt, r.out_bytes, r.branch) for r in D.forced_fallback(cands, src, trials).collect()}
    # 1 ships a lossy jpeg, 2 already had a lossy entry, 3 has alpha so no jpeg, 4 has nothing at all
    assert got == {1: ("jpeg", 600, "forced"), 2: ("webp", 700, "forced"), 3: ("png", 900, "forced"), 4: (None, 500, "pass-through")}


def test_shortlist_matrix(spark):
    rows = [("lossy", False, "web", "fast", True, True), ("lossy", True, "web", "fast", False, False), ("mixed-safe", False, "web", "fast", True, True),
            ("mixed-safe", False, "web", "size-budget", True, True), ("lossy", False, "docs", "fast", True, True), ("lossy", False, "web", "size-budget", True, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i INT, bucket STRING, has_alpha BOOLEAN, profile STRING, mode STRING, webp_lossy BOOLEAN, avif BOOLEAN")
    def lists(**kw):
        out = {}
        for r in D.format_shortlist(df, **kw).orderBy("i", "ord").collect():
            out.setdefault(r.i, []).append(f"{r.fmt}/{r.disposition}")
        return out
    whole = lists()
    assert whole[2] == ["avif/lossy", "webp/lossy", "webp/lossless", "png/lossless", "jpeg/lossy"]
    assert whole[3] == ["webp/lossy", "webp/lossless", "png/lossless", "jpeg/lossy", "avif/lossy"]
    assert lists(max_entries=3) == {0: ["avif/lossy", "webp/lossy", "jpeg/lossy"], 1: ["webp/lossless", "png/lossless"],
                   2: ["avif/lossy", "webp/lossy", "webp/lossless"], 3: ["webp/lossy", "webp/lossless", "png/lossless"],
                   4: ["webp/lossless", "png/lossless"], 5: ["webp/lossy", "jpeg/lossy", "avif/lossy"]}


def test_explain_drops_what_was_not_measured(spark):
    dec = spark.createDataFrame([(1, "png", "fast", 100, None, 120, 1.23456, 0.5, 0.25, 10, False)],
                                "asset_id BIGINT, source_format STRING, mode STRING, source_bytes BIGINT, winner INT, out_bytes BIGINT, entropy DOUBLE, "
                                "edge_ratio DOUBLE, flat_ratio DOUBLE, unique_colors INT, unique_saturated BOOLEAN")
    doc = json.loads(D.explain(dec, spark.createDataFrame([], CANDIDATES), [D.feature_struct()]).first().trace)
    assert doc["features"]["entropy"] == 1.23 and doc["candidates"] == [] and "winner" not in doc and "ssim" not in doc
    assert doc["larger_than_source"] is True and doc["savings_percent"] == -20


def replay(ladder, accept, lower):
    lo, hi, best, last, iters = 1, 100, None, (100, None), 0
    while lo <= hi and iters < 8:
        mid = lo + (hi - lo) // 2
        iters += 1
        m = ladder.get(mid)
        last = (mid, m)
        ok = m is not None and accept(m)
        if ok:
            best = (mid, m)
        if ok == lower:
            if mid == 1:
                break
            hi = mid - 1
        else:
            if mid == 100:
                break
            lo = mid + 1
    if best:
        return best[0], best[1], iters, True
    fallback = 100 if lower else 1
    return fallback, last[1] if last[0] == fallback else None, iters, False


@pytest.mark.parametrize("lower", [True, False])
def test_bisect_against_replay(spark, lower):
    rng = random.Random(11)
    ladders = {}
    for k in range(60):
        kind = k % 4
        ladders[k] = {q: float({0: q, 1: rng.randrange(120), 2: 200, 3: -1}[kind]) for q in range(1, 101) if kind != 1 or rng.random() < 0.9}
    accept = (lambda m: m >= 60) if lower else (lambda m: m <= 40)
    df = spark.createDataFrame([(k, q, m) for k, l in ladders.items() for q, m in l.items()], "asset_id BIGINT, q INT, metric DOUBLE")
    got = {r.asset_id: (r.quality, r.score, r.iterations, r.met_target) for r in Q.bisect(df, accept, lower).collect()}
    assert got == {k: replay(l, accept, lower) for k, l in ladders.items()}


def test_global_and_bisected_answers_differ_when_not_monotone(spark):
    ladder = {q: 10.0 for q in range(1, 101)}
    ladder[3] = ladder[88] = 99.0  # 88 is on the probe path 50, 75, 88; 3 is not
    df = spark.createDataFrame([(1, q, m, q) for q, m in ladder.items()], "asset_id BIGINT, q INT, metric DOUBLE, bytes BIGINT")
    assert Q.search_quality(df, 90.0).first().quality == 3
    assert Q.bisect(df, lambda m: m >= 90, True).first().quality == 88


def test_unmet_searches(spark):
    df = spark.createDataFrame([(1, q, 1.0, 500 + q) for q in range(1, 101)], "asset_id BIGINT, q INT, metric DOUBLE, bytes BIGINT")
    assert tuple(Q.search_quality(df, 50.0).first()) == (1, 100, None, False)
    assert tuple(Q.search_under_size(df, 100).first()) == (1, 1, 501, False)


def test_gate_and_modes(spark):
    s = spark.createDataFrame([(1, 80.0), (2, None)], "asset_id BIGINT, score DOUBLE")
    assert [r.passed for r in Q.diff_gate(s, 80).collect()] == [True, False]
    assert [r.passed for r in Q.diff_gate(s).collect()] == [True, True]
    with pytest.raises(ValueError):
        Q.diff_gate(s, 101)
    with_nan = spark.createDataFrame([(1, "lossy", "avif", 16), (2, "lossy", "png", 16), (3, "lossless", "png", 8)],
                                     "asset_id BIGINT, disposition STRING, fmt STRING, source_depth INT")
    sc = spark.createDataFrame([(1, 81.0), (2, float("nan")), (3, 99.0)], "asset_id BIGINT, score DOUBLE")
    got = {r.asset_id: (r.verify_score, r.scored_source_depth) for r in Q.score_winner(with_nan, sc).collect()}
    assert got == {1: (81.0, 16), 2: (None, None), 3: (None, None)}


def test_identical_rasters_score_full(make_px):
    px = make_px({1: (16, 16, lambda x, y: (x * 9, y * 7, 30, 255))})
    assert Q.block_ssim(px, px).first().score == pytest.approx(100.0)
    r = Q.pair_score(px, px).first()
    assert r.mse == 0 and r.psnr is None and r.reason is None
    wide = px.withColumn("w", F.lit(99))
    assert Q.pair_score(px, wide).first().reason == "dimensions differ"
