"""The end-to-end flow: orient, bound, analyse, shortlist, decide, score, explain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..operators import analysis as A
from ..operators import decide as D
from ..operators import quality as Q
from ..operators import raster as R
from ..session import written

#: Order of a trial beyond the shortlist.
FALLBACK = 1000
SIZE_FACTOR = {("avif", "lossy"): 0.5, ("webp", "lossy"): 0.7, ("jpeg", "lossy"): 0.9, ("webp", "lossless"): 0.95,
               ("png", "lossless"): 1.0}


def size_factor(fmt: Column, disposition: Column) -> Column:
    """Relative size of a format's stand-in encode."""
    out = None
    for (f, d), factor in SIZE_FACTOR.items():
        test = (fmt == f) & (disposition == d)
        out = F.when(test, F.lit(factor)) if out is None else out.when(test, F.lit(factor))
    return out


def with_fallback(requests: DataFrame) -> DataFrame:
    """The shortlist of every asset and, where it holds nothing lossy, the lossy format of the source's own family.

    The latter has ``ord`` ``FALLBACK``: it is encoded like the others, but only competes where an altered source must ship.
    """
    entry = lambda n: F.struct(F.lit(FALLBACK).alias("ord"), n.alias("fmt"), F.lit("lossy").alias("disposition"))
    listed = D.shortlist_array(F.col("bucket"), F.col("has_alpha"), F.col("profile"), F.col("mode"), F.col("webp_lossy"), F.col("avif"))
    ranked = F.transform(listed, lambda e, i: F.struct(i.cast("int").alias("ord"), e["fmt"].alias("fmt"), e["disposition"].alias("disposition")))
    own = D.fallback_format(F.col("source_format"), F.col("has_alpha"))
    bare = ~F.exists(listed, lambda e: e["disposition"] == "lossy") & own.isNotNull()
    return requests.select("*", F.explode(F.when(bare, F.concat(ranked, F.array(entry(own)))).otherwise(ranked)).alias("_e")).select(
        *requests.columns, "_e.ord", "_e.fmt", "_e.disposition")


def solve(entries: DataFrame, rungs: DataFrame, mode: str, target: float, budget: int) -> DataFrame:
    """One outcome per shortlist entry from the asset's ladder (stand-in encodes: ladder bytes x format factor).

    ``fast``: the fixed quality, always met. ``perceptual``: the lowest quality that reaches ``target``, else the highest,
    unmet. ``size-budget``: the highest quality within ``budget``, else the largest scale within it at the lowest quality,
    else the smallest, unmet. Lossless entries have no quality; they always meet a score, and a budget by their scale.
    At most 100 rungs meet an entry.
    """
    lossy, q = F.col("disposition") == "lossy", F.col("q")
    size = F.round(F.col("_b") * size_factor(F.col("fmt"), F.col("disposition"))).cast("bigint")
    met = rungs.select("asset_id", "q", F.col("bytes").alias("_b"), "metric")
    sized = entries.join(met, "asset_id").withColumn("_size", size)
    entry = F.struct("q", "_size", "metric")
    top = F.lit(fixed.SEARCH_MAX)
    if mode == "fast":
        hit, rest = F.min(F.when(q == F.when(lossy, fixed.FAST_LOSSY_QUALITY).otherwise(top), entry)), F.min(F.when(q == top, entry))
    elif mode == "perceptual":
        hit, rest = F.min(F.when(F.when(lossy, F.col("metric") >= target).otherwise(q == top), entry)), F.max(F.when(q == top, entry))
    else:
        hit = F.max(F.when((lossy | (q == top)) & (F.col("_size") <= budget), entry))
        rest = F.min(F.when(q == F.when(lossy, fixed.SEARCH_MIN).otherwise(top), entry))
    keys = [*entries.columns]
    out = sized.groupBy(*keys).agg(hit.alias("_h"), rest.alias("_r"))
    chosen = F.coalesce("_h", "_r")
    pct = F.lit(100)
    if mode == "size-budget":
        scaled = lambda p: F.ceil(F.col("_r._size") * p * p / 10000.0)
        fits = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(100)), lambda p: scaled(p) <= budget))
        pct = F.when(F.col("_h").isNotNull(), 100).otherwise(F.coalesce(fits, F.lit(1)))
        size = F.when(F.col("_h").isNotNull(), F.col("_h._size")).otherwise(scaled(F.col("scale_percent")))
        done = F.col("_h").isNotNull() | fits.isNotNull()
    else:
        size, done = chosen["_size"], F.col("_h").isNotNull()
    return out.withColumn("scale_percent", pct).select(
        "asset_id", F.col("ord").alias("cand_idx"), "fmt", "disposition", F.when(lossy, chosen["q"]).cast("int").alias("quality"),
        size.cast("bigint").alias("bytes"), done.alias("met_target"), "scale_percent",
        F.when(F.col("scale_percent") == 100, chosen["metric"]).alias("metric"))


def web(lines: DataFrame, facts: DataFrame, max_edge: int = fixed.BUNDLED_MAX_EDGE["web"], mode: str = "fast",
        profile: str = "web", target: float = fixed.QUALITY_TARGETS["visually-lossless"], budget: int = 200_000) -> DataFrame:
    """Decision, score and JSON trace per asset.

    ``lines``: scanlines as stored; ``facts``: declared facts with ``source_bytes`` and ``orientation``, and where known
    ``source_alpha`` (else measured), ``has_icc`` and ``bit_depth`` (else 8). The source is analysed before any transform.
    Facts meet the scanlines line by line, never pixel by pixel; scoring sees one row per asset. Features (one row per
    asset), outcomes (one row per shortlist entry) and winners are written once, because several branches read them;
    lines are only scanned to make the first two.
    """
    if mode not in ("fast", "perceptual", "size-budget"):
        raise ValueError(f"no such mode: '{mode}'")
    has = lambda n: n in facts.columns
    analyzed = written(A.analyze(lines, facts), "features")
    upright = R.auto_orient_lines(lines.join(facts.select("asset_id", "orientation"), "asset_id")).drop("orientation")
    bounded = R.explode_pixels(R.resize_lines(upright, "max", max_edge)).where("r is not null")
    fixed_levels = F.array(F.lit(fixed.FAST_LOSSY_QUALITY), F.lit(fixed.SEARCH_MAX))
    rungs = Q.quality_ladder(A.luma_histogram(bounded), fixed_levels if mode == "fast" else None)
    turned = F.coalesce(F.col("orientation").isin(5, 6, 7, 8), F.lit(False))
    shown = [F.when(turned, F.col(b)).otherwise(F.col(a)) for a, b in (("width", "height"), ("height", "width"))]
    dw, dh = R.planned_dims(F.lit("max"), *shown, F.lit(max_edge), F.lit(max_edge), F.lit(100))
    measured = F.col("alpha_transparent") + F.col("alpha_translucent") > 0
    requests = analyzed.select(
        "asset_id", "source_bytes", "source_format", "class", "bucket", "entropy", "edge_ratio", "flat_ratio", "unique_colors",
        "unique_saturated", (F.col("source_alpha") if has("source_alpha") else measured).alias("has_alpha"),
        F.lit(profile).alias("profile"), F.lit(mode).alias("mode"), F.lit(True).alias("webp_lossy"), F.lit(True).alias("avif"),
        (F.col("bit_depth") if has("bit_depth") else F.lit(8)).alias("source_depth"),
        (F.col("has_exif") | (F.col("has_icc") if has("has_icc") else F.lit(False)) | (dw != F.col("width")) | (dh != F.col("height"))).alias("altered"))
    entries = with_fallback(requests).select("asset_id", "ord", "fmt", "disposition")
    solved = written(solve(entries, rungs, mode, target, budget), "candidates")
    first = F.col("cand_idx") < FALLBACK
    picked = written(D.forced_fallback(solved.where(first), requests, solved.where(~first).select("asset_id", "fmt", "quality", "bytes")), "winners")
    won = solved.select("asset_id", F.col("cand_idx").alias("winner"), F.col("metric").alias("score"))
    scored = Q.score_winner(picked, picked.join(won, ["asset_id", "winner"]).select("asset_id", "score"))
    tried = solved.join(picked.select("asset_id", "branch"), "asset_id").where(first | (F.col("branch") == "forced"))
    trace = D.explain(scored, tried.select("asset_id", "cand_idx", "fmt", "disposition", "quality", "bytes", "met_target"),
                      ["class", "has_alpha", "profile", D.feature_struct(), F.round("verify_score", 1).alias("ssim"), "scored_source_depth"])
    return D.savings(scored).select("asset_id", "class", "bucket", "fmt", "disposition", "quality", "source_bytes", "out_bytes",
                                    "savings_percent", "winner", "branch", "verify_score").join(trace, "asset_id")
