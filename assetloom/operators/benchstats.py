"""Benchmark summaries at matched quality, with guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import color
from ..functions.paths import extension
from ..schemas import require
from ..session import written

C = F.col
RANGES_PER_OCTAVE, OCTAVES, SUB_RANGES = 1024, 1100, 1024


def value_range(v: Column) -> Column:
    """Order-preserving integer range of a double: 1024 ranges per octave, either sign.

    A fixed function of the value, so every evaluation agrees, unlike split points
    taken from a sketch. Infinities and NaN (above all numbers) have end ranges.
    """
    top = 2 * OCTAVES * RANGES_PER_OCTAVE
    size = F.floor(F.log2(F.abs(v)) * RANGES_PER_OCTAVE) + OCTAVES * RANGES_PER_OCTAVE
    return (F.when(F.isnan(v), F.lit(top + 1)).when(v == float("inf"), F.lit(top)).when(v == float("-inf"), F.lit(-top))
            .when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)).cast("bigint")


def _holding(totals: DataFrame, keys: list[str], part: str) -> DataFrame:
    """The one or two parts of each group that hold the ranks ``_lo`` and ``_hi``, with the rows ``_before`` them."""
    run = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, 0)
    upto = totals.withColumn("_upto", C("_start") + F.sum("_pn").over(run)).withColumn("_before", C("_upto") - C("_pn"))
    holds = lambda r: (C(r) >= C("_before")) & (C(r) < C("_upto"))
    return upto.where(holds("_lo") | holds("_hi"))


def _matched(rows: DataFrame, parts: DataFrame, keys: list[str], also: dict[str, str]) -> DataFrame:
    """Rows of the parts, joined on the group (NULL is a group of its own) and on ``also``."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    test = [C(k).eqNullSafe(C(n)) for k, n in names.items()] + [C(a) == C(b) for a, b in also.items()]
    return rows.join(parts.withColumnsRenamed(names), test).drop(*names.values(), *also.values())


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5,
                   out: str | None = None, count: str | None = None) -> DataFrame:
    """Exact interpolated quantile per group without gathering or ordering a group.

    Values collapse to counts while still spread over (group, value), written once. Totals per
    value range locate the wanted ranks; the one or two ranges holding them are cut again, into
    ``SUB_RANGES`` equal parts between their own least and largest value, and only the parts
    holding the ranks are ordered, each in its own task. NULLs do not count; NaN is above all numbers.
    """
    v = C(value).cast("double")
    counts = df.where(C(value).isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    binned = written(counts.withColumn("_b", value_range(C("_v"))), "counts")
    totals = binned.groupBy(*keys, "_b").agg(F.sum("_n").alias("_pn"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    rank = F.lit(q) * (C("_all") - 1)
    ranked = totals.withColumn("_all", F.sum("_pn").over(Window.partitionBy(*keys))).withColumns(
        {"_start": F.lit(0).cast("bigint"), "_rank": rank, "_lo": F.floor(rank), "_hi": F.ceil(rank)})
    facts = ["_rank", "_lo", "_hi", "_all"]
    hot = _holding(ranked, keys, "_b").select(*keys, C("_b").alias("_hb"), C("_before").alias("_start"), "_least", "_most", *facts)
    share = (C("_v") - C("_least")) / (C("_most") - C("_least"))
    part = F.when(C("_least") == C("_most"), 0).otherwise(F.floor(share * SUB_RANGES)).cast("bigint")
    inside = _matched(binned, hot, keys, {"_b": "_hb"}).withColumn("_p", part)
    sums = inside.groupBy(*keys, "_b", "_p").agg(F.sum("_n").alias("_pn"), *[F.max(c).alias(c) for c in ("_start", *facts)])
    final = _holding(sums, [*keys, "_b"], "_p").select(*keys, C("_b").alias("_hb"), C("_p").alias("_hp"), "_before")
    inner = Window.partitionBy(*keys, "_b", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = _matched(inside, final, keys, {"_b": "_hb", "_p": "_hp"}).withColumn("_upto", C("_before") + F.sum("_n").over(inner)).withColumn("_from", C("_upto") - C("_n"))
    at = lambda r: F.max(F.when((C(r) >= C("_from")) & (C(r) < C("_upto")), C("_v")))
    ends = placed.groupBy(*keys).agg(at("_lo").alias("_a"), at("_hi").alias("_z"), F.max(C("_rank") - C("_lo")).alias("_f"),
                                     F.max("_all").alias("_all"))
    between = F.when((C("_a") == C("_z")) | (C("_f") == 0), C("_a")).otherwise(C("_a") + (C("_z") - C("_a")) * C("_f"))
    return ends.select(*keys, between.alias(out or value), *([C("_all").alias(count)] if count else []))


def iso_quality(runs: DataFrame, target: float = fixed.ISO_TARGET_SCORE) -> DataFrame:
    """Per (image, tool) the run nearest the target score; ties take the smaller, then lower q."""
    require(runs, "image", "tool", "q", "score", "bytes")
    rest = [c for c in runs.columns if c not in ("image", "tool", "bytes", "q")]
    best = F.min(F.struct(F.abs(C("score") - target).alias("_d"), "bytes", "q", *rest)).alias("_m")
    return runs.groupBy("image", "tool").agg(best).select(
        "image", "tool", "_m.bytes", "_m.q", *[C(f"_m.{c}") for c in rest])


def mp_bucket(mp: Column) -> Column:
    """Size class by megapixels, half-open ranges."""
    out = None
    for name, lo, hi in fixed.MP_BUCKETS:
        test = (mp >= lo) & (mp < hi)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("large"))


def savings_table(rows: DataFrame) -> DataFrame:
    """Add ``saved = 1 - bytes / source_bytes``."""
    return rows.withColumn("saved", 1.0 - C("bytes").cast("double") / F.nullif(C("source_bytes"), F.lit(0)))


def bucket_medians(picked: DataFrame) -> DataFrame:
    """Median score, bytes, savings and time per (bucket, tool).

    The four measures become rows keyed by name, so one quantile plan serves all.
    """
    base = savings_table(picked).withColumn("bucket", mp_bucket(C("mp")))
    names = ("score", "bytes", "saved", "ms")
    long = base.select("bucket", "tool", F.explode(F.array(*[
        F.struct(F.lit(n).alias("measure"), C(n).cast("double").alias("v")) for n in names])).alias("_m")).select(
        "bucket", "tool", "_m.measure", "_m.v")
    med = exact_quantile(long, ["bucket", "tool", "measure"], "v", count="n")
    pick = [F.max(F.when(C("measure") == n, C("v"))).alias(n) for n in names]
    return med.groupBy("bucket", "tool").agg(F.max(F.when(C("measure") == "score", C("n"))).alias("images"), *pick)


def median_time(runs: DataFrame, warmup: int = 1) -> DataFrame:
    """Median of the runs after warm-up per (image, tool)."""
    return exact_quantile(runs.where(C("run_idx") >= warmup), ["image", "tool"], "ms", out="median_ms")


def smallest_per_image(picked: DataFrame) -> DataFrame:
    """Tools whose output is smallest for an image (ties share). One row per tool in a group."""
    win = Window.partitionBy("image").orderBy("bytes")
    return picked.withColumn("_r", F.rank().over(win)).where("_r = 1").select("image", "tool", "bytes")


def win_counts(picked: DataFrame) -> DataFrame:
    """Images won per tool."""
    return smallest_per_image(picked).groupBy("tool").agg(F.count(F.lit(1)).alias("wins"))


def ratio_to_best(picked: DataFrame) -> DataFrame:
    """Output size relative to the image's smallest."""
    best = F.min("bytes").over(Window.partitionBy("image"))
    return picked.select("image", "tool", "bytes", (C("bytes") / best).alias("ratio"))


def dim_guard(df: DataFrame) -> DataFrame:
    """Reason an output did not get the planned downscale (NULL when right).

    Orientation-insensitive. Columns ``src_w, src_h, out_w, out_h, cap``.
    """
    long_, short = lambda p: F.greatest(f"{p}_w", f"{p}_h"), lambda p: F.least(f"{p}_w", f"{p}_h")
    want = F.least(C("cap"), long_("src"))
    aspect = lambda p: long_(p) / F.nullif(short(p), F.lit(0))
    off = F.abs(aspect("out") - aspect("src")) / aspect("src") > fixed.ASPECT_TOLERANCE
    bad = F.coalesce(C("out_w"), F.lit(0)) * F.coalesce(C("out_h"), F.lit(0)) == 0
    return df.withColumn("reason", F.when(bad, "output dimensions unreadable").when(
        F.abs(long_("out") - want) > fixed.EDGE_TOLERANCE, "long edge").when(off, "aspect"))


def pinning_arg(args: Column) -> Column:
    """The argument that pins the output format, NULL when none does."""
    nxt = F.transform(args, lambda a, i: F.struct(
        F.substring_index(a, "=", 1).alias("flag"),
        F.when(F.contains(a, F.lit("=")), F.regexp_replace(a, "^[^=]*=", "")).otherwise(
            F.coalesce(F.get(args, i + 1), F.lit(""))).alias("val")))
    is_pin = lambda p: (p["flag"] == "--format") | (p["flag"].isin("-o", "--output") & (p["val"] != "-") & F.lower(
        extension(p["val"])).isin(*fixed.PINNING_EXTENSIONS))
    hit = F.get(F.filter(nxt, is_pin), F.lit(0))
    return F.when(hit["flag"] == "--format", F.concat(F.lit("--format "), hit["val"])).when(
        hit.isNotNull(), F.concat(F.lit("-o "), F.regexp_extract(hit["val"], "([^/]*)$", 1)))


def operating_point_guard(claims: DataFrame, observed: DataFrame) -> DataFrame:
    """Distinct reasons a run is not at the operating point its row claims.

    ``claims``: ``image, tool, args, expect_quality, expect_format, bytes``;
    ``observed``: ``image, tool, got_quality, got_format, got_bytes``.
    """
    both = claims.join(observed.withColumn("_seen", F.lit(True)), ["image", "tool"], "left")
    seen = C("_seen").isNotNull()
    say = lambda test, text: F.when(test, F.lit(text))
    differs = lambda a, b: ~C(a).eqNullSafe(C(b))
    reasons = F.array_distinct(F.array_compact(F.array(
        F.when(pinning_arg(C("args")).isNotNull(), F.concat(F.lit("pins the format: "), pinning_arg(C("args")))),
        say(~seen, "operating point not observed"),
        say(seen & C("expect_quality").isNotNull() & differs("got_quality", "expect_quality"), "quality differs"),
        say(seen & C("expect_format").isNotNull() & differs("got_format", "expect_format"), "format differs"),
        say(seen & differs("got_bytes", "bytes"), "bytes differ"))))
    claimed = C("expect_quality").isNotNull() | C("expect_format").isNotNull()
    none = F.array().cast("array<string>")
    return both.select("image", "tool", F.when(claimed, reasons).otherwise(none).alias("reasons"))


def pivot_tools(picked: DataFrame, tools: list[str], value: str = "bytes") -> DataFrame:
    """Image x tool grid; the tool list is given, so no extra pass finds it."""
    return picked.groupBy("image").pivot("tool", tools).agg(F.min(value))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two result sets side by side: identical scores and bytes, time change in percent."""
    side = lambda d, p: d.select("image", "tool", *[C(c).alias(f"{p}_{c}") for c in ("score", "bytes", "ms")])
    both = side(a, "a").join(side(b, "b"), ["image", "tool"], "full")
    return both.select(
        "image", "tool", C("a_score").eqNullSafe(C("b_score")).alias("same_score"),
        C("a_bytes").eqNullSafe(C("b_bytes")).alias("same_bytes"),
        (100.0 * (C("b_ms") - C("a_ms")) / F.nullif(C("a_ms"), F.lit(0.0))).alias("ms_delta_pct"))


TRACE = (
    "source_format STRING, mode STRING, source_bytes BIGINT, winner INT, out_bytes BIGINT, savings_percent BIGINT, "
    "candidates ARRAY<STRUCT<cand_idx: INT, format: STRING, disposition: STRING, quality: INT, bytes: BIGINT, met_target: BOOLEAN>>")


def audit_rows(traces: DataFrame, verb: str = "optimize") -> DataFrame:
    """One flat row per explained asset."""
    t = traces.withColumn("_t", F.from_json("trace", TRACE))
    won = F.get(F.filter("_t.candidates", lambda c: c["cand_idx"] == C("_t.winner")), F.lit(0))
    return t.select(
        "asset_id", F.lit(verb).alias("verb"), "_t.source_format", "_t.mode", "_t.source_bytes", "_t.out_bytes",
        "_t.savings_percent", F.size("_t.candidates").alias("n_candidates"),
        F.coalesce(won["format"], C("_t.source_format")).alias("out_format"), won["quality"].alias("quality"))


def not_run(images: DataFrame, results: DataFrame, tools: list[str]) -> DataFrame:
    """Every image x tool cell; cells without a result are labelled, never dropped."""
    grid = images.select("image").distinct().select("image", F.explode(F.array(*[F.lit(t) for t in tools])).alias("tool"))
    done = results.select("image", "tool", "bytes").withColumn("_d", F.lit(True))
    return grid.join(done, ["image", "tool"], "left").select(
        "image", "tool", "bytes", F.when(C("_d").isNull(), "NOT RUN").otherwise("ok").alias("status"))


def fidelity_study(reference: DataFrame, renditions: DataFrame) -> DataFrame:
    """Mean absolute linear-light error per (asset, rendition) against the reference raster."""
    lin = lambda d, p: d.select("asset_id", "x", "y", *(["rendition"] if "rendition" in d.columns else []),
                                *[color.decode_sample(C(c)).alias(f"{p}{c}") for c in "rgb"])
    joined = lin(renditions, "a").join(lin(reference, "b"), ["asset_id", "x", "y"])
    err = sum((F.abs(C(f"a{c}") - C(f"b{c}")) for c in "rgb"), F.lit(0.0)) / 3.0
    return joined.groupBy("asset_id", "rendition").agg(F.avg(err).alias("mean_error"))
