"""Quality ladders, fidelity scores and threshold searches."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import color
from ..functions.scalars import lookup
from ..schemas import require

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def ssim(ma: Column, mb: Column, va: Column, vb: Column, cov: Column) -> Column:
    """Structural similarity from first and second moments."""
    return ((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def quality_step(q: Column) -> Column:
    """Quantisation step of a quality: 1 at 100, 63 at 1."""
    return F.floor((100 - q) * 63 / 100.0).cast("int") + 1


def quality_ladder(hist: DataFrame, levels: Column | None = None) -> DataFrame:
    """Size proxy and fidelity per (asset, q) from luma histograms.

    Uniform quantisation stands in for an encoder. Working from the histogram
    bounds the fan-out at 256 bins x 100 qualities per asset however large the
    raster is. ``metric`` is whole-raster SSIM x 100, ``bytes`` entropy x pixels / 8.
    """
    require(hist, "asset_id", "luma", "n")
    levels = levels if levels is not None else F.sequence(F.lit(fixed.SEARCH_MIN), F.lit(fixed.SEARCH_MAX))
    step = quality_step(F.col("q"))
    coded = F.least(F.lit(255), F.floor(F.col("luma") / step).cast("int") * step + F.floor(step / 2).cast("int"))
    v, n = F.col("luma"), F.col("n")
    bins = (hist.select("asset_id", "luma", "n", F.explode(levels).alias("q")).withColumn("code", coded)
            .groupBy("asset_id", "q", "code").agg(
                F.sum("n").alias("n"), F.sum(n * v).alias("sv"), F.sum(n * v * v).alias("svv")))
    c, total = F.col("code"), F.sum("n")
    sums = bins.groupBy("asset_id", "q").agg(
        total.alias("t"), (F.log2(total) - F.sum(n * F.log2("n")) / total).alias("bits"),
        (F.sum("sv") / total).alias("ma"), (F.sum(n * c) / total).alias("mb"),
        (F.sum("svv") / total).alias("aa"), (F.sum(n * c * c) / total).alias("bb"),
        (F.sum(F.col("sv") * c) / total).alias("ab"))
    ma, mb = F.col("ma"), F.col("mb")
    score = ssim(ma, mb, F.col("aa") - ma * ma, F.col("bb") - mb * mb, F.col("ab") - ma * mb)
    return sums.select("asset_id", "q", (100.0 * score).alias("metric"),
                       F.ceil(F.round(F.col("bits") * F.col("t") / 8.0, 6)).alias("bytes"))


def _paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixel pairs of two rasters of the same asset, keyed by position so that no key is hot."""
    left = a.select("asset_id", "x", "y", F.col("w").alias("aw"), F.col("h").alias("ah"),
                    *[F.col(c).alias(f"a{c}") for c in "rgb"])
    right = b.select("asset_id", "x", "y", F.col("w").alias("bw"), F.col("h").alias("bh"),
                     *[F.col(c).alias(f"b{c}") for c in "rgb"])
    return left.join(right, ["asset_id", "x", "y"], "full")


def _refusal() -> Column:
    same = (F.max("aw") == F.max("bw")) & (F.max("ah") == F.max("bh"))
    return F.when(same.isNull() | ~same, F.lit("dimensions differ"))


def pair_score(a: DataFrame, b: DataFrame) -> DataFrame:
    """MSE and PSNR per asset; unequal dimensions are refused with a reason."""
    err = sum((F.pow(F.col(f"a{c}") - F.col(f"b{c}"), 2) for c in "rgb"), F.lit(0.0)) / 3.0
    out = _paired(a, b).groupBy("asset_id").agg(_refusal().alias("reason"), F.avg(err).alias("mse"))
    ok = F.col("reason").isNull()
    mse = F.when(ok, F.col("mse"))
    psnr = F.when(mse > 0, 10.0 * F.log10(65025.0 / F.nullif(mse, F.lit(0.0))))
    return out.select("asset_id", "reason", mse.alias("mse"), psnr.alias("psnr"))


def block_ssim(a: DataFrame, b: DataFrame, win: int = 8, scales: int = 2) -> DataFrame:
    """Luma SSIM per ``win x win`` block, averaged over blocks and then over halved scales.

    An SSIM-family score of our own on 0..100; it claims no other metric's numbers.
    """
    pairs = _paired(a, b).select(
        "asset_id", "x", "y", "aw", "ah", "bw", "bh",
        color.luma(F.col("ar"), F.col("ag"), F.col("ab")).alias("la"),
        color.luma(F.col("br"), F.col("bg"), F.col("bb")).alias("lb"))
    factors = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(2 ** s).alias("f")) for s in range(scales)])
    pooled = (pairs.withColumn("_k", F.explode(factors)).groupBy(
        "asset_id", F.col("_k.s").alias("scale"), F.floor(F.col("x") / F.col("_k.f")).alias("x"),
        F.floor(F.col("y") / F.col("_k.f")).alias("y")).agg(
        F.avg("la").alias("la"), F.avg("lb").alias("lb"), *[F.max(c).alias(c) for c in ("aw", "ah", "bw", "bh")]))
    blocks = pooled.groupBy("asset_id", "scale", F.floor(F.col("x") / win).alias("bx"),
                            F.floor(F.col("y") / win).alias("by")).agg(
        ssim(F.avg("la"), F.avg("lb"), F.var_pop("la"), F.var_pop("lb"), F.covar_pop("la", "lb")).alias("s"),
        *[F.max(c).alias(c) for c in ("aw", "ah", "bw", "bh")])
    per_scale = blocks.groupBy("asset_id", "scale").agg(F.avg("s").alias("s"),
                                                       *[F.max(c).alias(c) for c in ("aw", "ah", "bw", "bh")])
    out = per_scale.groupBy("asset_id").agg(_refusal().alias("reason"), (100.0 * F.avg("s")).alias("score"))
    return out.withColumn("score", F.when(F.col("reason").isNull(), F.col("score")))


def block_metric(a: DataFrame, b: DataFrame, metric: Callable[[pd.Series, pd.Series], float],
                 win: int = 8) -> DataFrame:
    """A user metric on luma, per ``win x win`` block and averaged per asset.

    The function sees Arrow-fed Series of at most ``win * win`` values.
    """
    @F.pandas_udf("double")
    def scored(x: pd.Series, y: pd.Series) -> float:
        return float(metric(x, y))

    pairs = _paired(a, b).select(
        "asset_id", F.floor(F.col("x") / win).alias("bx"), F.floor(F.col("y") / win).alias("by"),
        color.luma(F.col("ar"), F.col("ag"), F.col("ab")).alias("la"), color.luma(F.col("br"), F.col("bg"), F.col("bb")).alias("lb"))
    blocks = pairs.groupBy("asset_id", "bx", "by").agg(scored("la", "lb").alias("s"))
    return blocks.groupBy("asset_id").agg(F.avg("s").alias("score"))


def diff_gate(scores: DataFrame, fail_under: float | None = None, score: str = "score") -> DataFrame:
    """Add ``passed``; without a threshold everything passes."""
    if fail_under is not None and not 0 <= fail_under <= 100:
        raise ValueError("threshold must be within 0..100")
    ok = F.lit(True) if fail_under is None else F.coalesce(F.col(score) >= fail_under, F.lit(False))
    return scores.withColumn("passed", ok)


def search_quality(ladder: DataFrame, target: float | Column) -> DataFrame:
    """Lowest quality whose metric reaches the target; else 100, unmet."""
    hit = F.min(F.when(F.col("metric") >= target, F.struct("q", "metric")))
    out = ladder.groupBy("asset_id").agg(hit.alias("_h"))
    return out.select("asset_id", F.coalesce("_h.q", F.lit(fixed.SEARCH_MAX)).alias("quality"),
                      F.col("_h.metric").alias("score"), F.col("_h").isNotNull().alias("met_target"))


def search_under_size(ladder: DataFrame, budget: int | Column, level: str = "q") -> DataFrame:
    """Highest level whose bytes fit the budget; else the lowest level, unmet."""
    fits = F.max(F.when(F.col("bytes") <= budget, F.struct(F.col(level).alias("q"), "bytes")))
    low = F.min(F.struct(F.col(level).alias("q"), "bytes"))
    out = ladder.groupBy("asset_id").agg(fits.alias("_h"), low.alias("_l"))
    return out.select("asset_id", F.coalesce("_h.q", F.lit(fixed.SEARCH_MIN)).alias("quality"),
                      F.coalesce("_h.bytes", "_l.bytes").alias("bytes"), F.col("_h").isNotNull().alias("met_target"))


STATE = "struct<lo:int,hi:int,best:int,best_m:double,last:int,last_m:double,iters:int,done:boolean>"


def bisect(ladder: DataFrame, accept: Callable[[Column], Column], prefer_lower: bool,
           value: str = "metric", max_iters: int = fixed.SEARCH_ITERS) -> DataFrame:
    """Replay the eight-probe binary search, whose answer differs on non-monotone ladders.

    One expression per asset over a map of at most 100 levels; no iterated jobs.
    """
    lo, hi = fixed.SEARCH_MIN, fixed.SEARCH_MAX
    maps = ladder.groupBy("asset_id").agg(
        F.map_from_entries(F.collect_list(F.struct("q", F.col(value).cast("double").alias("m")))).alias("_map"))
    none_i, none_d = F.lit(None).cast("int"), F.lit(None).cast("double")
    start = F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), none_i.alias("best"), none_d.alias("best_m"),
                     F.lit(hi).alias("last"), none_d.alias("last_m"), F.lit(0).alias("iters"),
                     F.lit(False).alias("done")).cast(STATE)

    def step(s: Column, _: Column) -> Column:
        mid = s["lo"] + F.floor((s["hi"] - s["lo"]) / 2).cast("int")
        m = F.try_element_at(F.col("_map"), mid)
        ok = F.coalesce(accept(m), F.lit(False))
        lower = ok if prefer_lower else ~ok
        stop = F.when(lower, mid == lo).otherwise(mid == hi)
        moved = F.struct(
            F.when(lower | stop, s["lo"]).otherwise(mid + 1).alias("lo"),
            F.when(lower & ~stop, mid - 1).otherwise(s["hi"]).alias("hi"),
            F.when(ok, mid).otherwise(s["best"]).alias("best"), F.when(ok, m).otherwise(s["best_m"]).alias("best_m"),
            mid.alias("last"), m.alias("last_m"), (s["iters"] + 1).alias("iters"), stop.alias("done")).cast(STATE)
        return F.when(s["done"] | (s["lo"] > s["hi"]), s).otherwise(moved)

    end = maps.select("asset_id", F.aggregate(F.sequence(F.lit(1), F.lit(max_iters)), start, step).alias("s"))
    fallback = F.lit(hi if prefer_lower else lo)
    probed = F.when(F.col("s.last") == fallback, F.col("s.last_m"))
    met = F.col("s.best").isNotNull()
    return end.select("asset_id", F.coalesce("s.best", fallback).alias("quality"),
                      F.when(met, F.col("s.best_m")).otherwise(probed).alias("score"),
                      F.col("s.iters").alias("iterations"), met.alias("met_target"))


def fit_ladder(ladder: DataFrame, lossy: Column, scaled: Callable[[Column, Column], Column]) -> DataFrame:
    """Quality and scale rungs of every asset as one table ``asset_id, kind, level, bytes``.

    The scale rungs (``kind`` 's', 1 to 100 percent) come from the rung that scaling starts at, the lowest quality of a
    lossy asset and the highest otherwise, by ``scaled(bytes, percent)``. One pass over ``ladder``, no join.
    """
    rung = lambda kind, level, size: F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"), size.cast("bigint").alias("bytes"))
    own = F.array(rung("q", F.col("q"), F.col("bytes")))
    scales = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda p: rung("s", p, scaled(F.col("bytes"), p)))
    base = F.col("q") == F.when(lossy, F.lit(fixed.SEARCH_MIN)).otherwise(F.lit(fixed.SEARCH_MAX))
    keep = [c for c in ladder.columns if c not in ("q", "bytes", "metric")]
    return ladder.select(*keep, F.explode(F.when(base, F.concat(own, scales)).otherwise(own)).alias("_r")).select(*keep, "_r.*")


def fit_under_size(rungs: DataFrame, lossy: str = "lossy", budget: str = "budget") -> DataFrame:
    """Quality first, then scale, in one aggregation per asset.

    ``rungs``: ``asset_id, kind, level, bytes`` (see :func:`fit_ladder`) with the asset's ``lossy`` and ``budget`` beside them.
    The state of an asset is a handful of numbers: the best level that fits and its bytes, for qualities and for scales,
    and what the smallest scale takes. Assets without a scale rung end at scale 1, unmet, with no size.
    """
    require(rungs, "asset_id", "kind", "level", "bytes", lossy, budget)
    level, size = F.col("level"), F.col("bytes")
    of = lambda kind: F.when((F.col("kind") == kind) & (size <= F.col(budget)), level)
    low = F.when(F.col("kind") == "s", level)
    out = rungs.groupBy("asset_id").agg(
        F.bool_or(lossy).alias("_lossy"), F.max(of("q")).alias("_q"), F.max_by(size, of("q")).alias("_qb"),
        F.max(of("s")).alias("_s"), F.max_by(size, of("s")).alias("_sb"), F.min_by(size, low).alias("_low"))
    by_quality = F.col("_lossy") & F.col("_q").isNotNull()
    return out.select(
        "asset_id", F.when(F.col("_lossy"), F.coalesce("_q", F.lit(fixed.SEARCH_MIN))).alias("quality"),
        F.when(by_quality, F.lit(100)).otherwise(F.coalesce("_s", F.lit(fixed.SEARCH_MIN))).alias("scale_percent"),
        F.when(by_quality, F.col("_qb")).otherwise(F.coalesce("_sb", "_low")).alias("bytes"),
        (by_quality | F.col("_s").isNotNull()).alias("met_budget"))


def target_preset(name: Column) -> Column:
    """Named quality targets."""
    return lookup(name, {k: str(v) for k, v in fixed.QUALITY_TARGETS.items()}).cast("double")


def score_winner(winners: DataFrame, scores: DataFrame) -> DataFrame:
    """Attach the one score of each lossy winner.

    Lossless winners and non-finite scores give NULL; ``scored_source_depth`` is
    set when the winner's format could not hold the source's depth.
    """
    joined = winners.join(scores.select("asset_id", F.col("score").alias("_s")), "asset_id", "left")
    finite = ~F.isnan("_s") & (F.abs("_s") < float("inf"))
    score = F.when((F.col("disposition") == "lossy") & finite, F.col("_s"))
    blind = score.isNotNull() & (F.col("source_depth") > 8) & F.col("fmt").isin(*fixed.EIGHT_BIT_ONLY)
    return joined.withColumns({"verify_score": score,
                               "scored_source_depth": F.when(blind, F.col("source_depth"))}).drop("_s")


def size_search_capable(fmt: Column, webp_lossy: Column, avif: Column) -> Column:
    """Formats with an encoder quality knob."""
    return (fmt == "jpeg") | ((fmt == "avif") & avif) | ((fmt == "webp") & webp_lossy)


def perceptual_search_capable(fmt: Column, webp_lossy: Column) -> Column:
    """Formats that can also be decoded back and scored."""
    return (fmt == "jpeg") | ((fmt == "webp") & webp_lossy)


def request_mode(target: Column, score: Column, budget: Column) -> Column:
    """Search mode of a request; NULL when more than one goal is given."""
    given = sum((g.isNotNull().cast("int") for g in (target, score, budget)), F.lit(0))
    return (F.when(given > 1, F.lit(None).cast("string")).when(budget.isNotNull(), F.lit("size-budget"))
            .when(given == 1, F.lit("perceptual")).otherwise(F.lit("fast")))
