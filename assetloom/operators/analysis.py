"""Content features per asset and the rule cascade over them.

All colour features come from one table of distinct colours per asset: pixels
collapse to (asset, colour) counts in the map stage, and luma histogram, coarse
bins and ratios are sums over that small table. Shuffle keys are never the
asset alone until at most 256 + 4096 bin rows per asset remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import color
from ..functions.scalars import lookup
from ..schemas import require
from .raster import explode_pixels

BAND_LINES = 256


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def luma(px: DataFrame) -> DataFrame:
    """Add integer luma."""
    return px.withColumn("luma", color.luma(*_rgb()))


def color_counts(px: DataFrame) -> DataFrame:
    """Distinct colours per asset with pixel and alpha counts."""
    require(px, "asset_id", "r", "g", "b", "a")
    return px.groupBy("asset_id", "r", "g", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("a") == 0).alias("n_transparent"),
        F.count_if((F.col("a") > 0) & (F.col("a") < 255)).alias("n_translucent"))


def luma_histogram(px: DataFrame) -> DataFrame:
    """Pixels per (asset, luma)."""
    return luma(px).groupBy("asset_id", "luma").agg(F.count(F.lit(1)).alias("n"))


def entropy(hist: DataFrame) -> DataFrame:
    """Shannon entropy in bits: log2(T) - sum(n*log2 n)/T, empty bins absent."""
    return hist.groupBy("asset_id").agg(
        (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def bimodality(hist: DataFrame) -> DataFrame:
    """Mass of the two fullest bins (at most 256 counts per asset are gathered)."""
    top = F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, 2)
    total = F.aggregate(top, F.lit(0).cast("bigint"), lambda a, v: a + v)
    return hist.groupBy("asset_id").agg((total / F.sum("n")).alias("bimodality"))


def unique_colors(colors: DataFrame, cap: int = fixed.UNIQUE_COLOR_CAP) -> DataFrame:
    """Exact number of distinct colours, and whether it reaches ``cap`` (what the cascade calls many)."""
    n = F.count(F.lit(1))
    return colors.groupBy("asset_id").agg(n.alias("unique_colors"), (n >= cap).alias("unique_saturated"))


def unique_colors_approx(px: DataFrame, cap: int = fixed.UNIQUE_COLOR_CAP) -> DataFrame:
    """Sketch variant for very large rasters: constant state per asset."""
    n = F.approx_count_distinct(color.packed_rgb(*_rgb()), 0.01)
    return px.groupBy("asset_id").agg(n.alias("unique_colors"), (n >= cap).alias("unique_saturated"))


def gray_ratio(colors: DataFrame) -> DataFrame:
    """Share of pixels with chroma at most 12."""
    return _share(colors, color.chroma(*_rgb()) <= fixed.GRAY_CHROMA_MAX, "gray_ratio")


def sat_low_ratio(colors: DataFrame) -> DataFrame:
    """Share of pixels with chroma at most 32."""
    return _share(colors, color.chroma(*_rgb()) <= fixed.SAT_LOW_CHROMA_MAX, "sat_low_ratio")


def _share(colors: DataFrame, test: Column, name: str) -> DataFrame:
    hit = F.sum(F.when(test, F.col("n")).otherwise(0))
    return colors.groupBy("asset_id").agg((hit / F.sum("n")).alias(name))


def alpha_ratios(colors: DataFrame) -> DataFrame:
    """Shares of fully transparent and of translucent pixels."""
    return colors.groupBy("asset_id").agg(
        (F.sum("n_transparent") / F.sum("n")).alias("alpha_transparent"),
        (F.sum("n_translucent") / F.sum("n")).alias("alpha_translucent"))


def dominant_color(colors: DataFrame) -> DataFrame:
    """Centre of the fullest 4-bit-per-channel bin; ties go to the lowest bin."""
    bins = (colors.groupBy("asset_id", color.coarse_bin(*_rgb()).alias("bin"))
            .agg(F.sum("n").alias("n")))
    best = bins.groupBy("asset_id").agg(
        F.max(F.struct("n", (-F.col("bin")).alias("b"))).alias("_m"))
    return best.select("asset_id", *_centers(-F.col("_m.b")))


def _centers(bin_: Column) -> list[Column]:
    return [*[color.bin_center(bin_, c).alias(f"dom_{c}") for c in ("r", "g", "b")],
            F.lit(255).alias("dom_a")]


def row_stride(w: Column, h: Column, sample_cap: int = fixed.EDGE_SAMPLE_CAP) -> Column:
    """Lines to step over so that about ``sample_cap`` pixels are evaluated, for callers who want that sample."""
    total = (w.cast("bigint") - 1) * (h.cast("bigint") - 1)
    step = F.floor(total / sample_cap).cast("bigint")
    return F.when(total > sample_cap, F.greatest(step, F.lit(1))).otherwise(
        F.lit(1).cast("bigint"))


def edge_flat_ratios(lines: DataFrame, band_lines: int = BAND_LINES, sample_cap: int | None = None) -> DataFrame:
    """Forward-difference edge and flat shares from scanlines, over all lines.

    ``sample_cap`` steps over lines of rasters with more pixels than that (see :func:`row_stride`).

    Lines are cut into bands of ``band_lines`` with the first line of the next
    band copied over, so one shuffle on (asset, band) gives every line its lower
    neighbour and no group exceeds ``band_lines + 1`` lines however tall the raster.
    Samples that are missing (NULL) have no difference; the next one in the line is the neighbour.
    """
    require(lines, "asset_id", "w", "h", "y", "r", "g", "b")
    lum = F.transform(F.arrays_zip("r", "g", "b"), lambda p: color.luma(p["r"], p["g"], p["b"]))
    y = F.col("y")
    band = F.floor(y / band_lines)
    bands = F.when((y > 0) & (y % band_lines == 0), F.array(band, band - 1)).otherwise(F.array(band))
    spread = lines.select("asset_id", "w", "h", "y", lum.alias("c"), F.explode(bands).alias("band"))
    win = Window.partitionBy("asset_id", "band").orderBy("y")
    paired = spread.withColumns({"below": F.lead("c").over(win), "_ny": F.lead("y").over(win)})
    used = F.col("_ny") == y + 1
    if sample_cap is not None:
        used &= y % row_stride(F.col("w"), F.col("h"), sample_cap) == 0
    there = F.filter(F.arrays_zip("c", "below"), lambda p: p["c"].isNotNull())
    n = F.greatest(F.size("_p") - 1, F.lit(0))
    cells = F.arrays_zip(F.slice("_p.c", F.lit(1), n).alias("c"), F.slice("_p.c", F.lit(2), n).alias("r"),
                         F.slice("_p.below", F.lit(1), n).alias("b"))
    known = paired.select("asset_id", F.when(used, there).alias("_p"))
    grads = known.select("asset_id", F.explode_outer(F.when(F.col("_p").isNotNull(), cells)).alias("p")).select(
        "asset_id", (F.abs(F.col("p.r") - F.col("p.c")) + F.abs(F.col("p.b") - F.col("p.c"))).alias("grad"))
    total = F.count("grad")
    return grads.groupBy("asset_id").agg(
        F.when(total == 0, F.lit(0.0)).otherwise(
            F.count_if(F.col("grad") >= fixed.EDGE_THRESHOLD) / F.nullif(total, F.lit(0))).alias("edge_ratio"),
        F.when(total == 0, F.lit(1.0)).otherwise(
            F.count_if(F.col("grad") <= fixed.FLAT_THRESHOLD) / F.nullif(total, F.lit(0))).alias("flat_ratio"))


def color_features(px: DataFrame) -> DataFrame:
    """All colour features of every asset in one aggregation chain."""
    rgb = _rgb()
    chroma = color.chroma(*rgb)
    keyed = color_counts(px).withColumns({
        "n_gray": F.when(chroma <= fixed.GRAY_CHROMA_MAX, F.col("n")).otherwise(0),
        "n_sat_low": F.when(chroma <= fixed.SAT_LOW_CHROMA_MAX, F.col("n")).otherwise(0),
        "_key": F.explode(F.array(
            F.struct(F.lit(True).alias("is_luma"), color.luma(*rgb).alias("key")),
            F.struct(F.lit(False).alias("is_luma"), color.coarse_bin(*rgb).alias("key"))))})
    sums = ("n", "n_gray", "n_sat_low", "n_transparent", "n_translucent")
    bins = keyed.groupBy("asset_id", "_key.is_luma", "_key.key").agg(
        *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("n_colors"))
    lum = lambda c: F.sum(F.when(F.col("is_luma"), F.col(c)))
    total = lum("n")
    top = F.slice(F.sort_array(F.collect_list(F.when(F.col("is_luma"), F.col("n"))), asc=False), 1, 2)
    mass = F.aggregate(top, F.lit(0).cast("bigint"), lambda a, v: a + v)
    colors = lum("n_colors")
    wide = bins.groupBy("asset_id").agg(
        total.alias("pixels"),
        (F.log2(total) - F.sum(F.when(F.col("is_luma"), F.col("n") * F.log2("n"))) / total).alias("entropy"),
        (mass / total).alias("bimodality"),
        colors.alias("unique_colors"),
        (colors >= fixed.UNIQUE_COLOR_CAP).alias("unique_saturated"),
        (lum("n_gray") / total).alias("gray_ratio"),
        (lum("n_sat_low") / total).alias("sat_low_ratio"),
        (lum("n_transparent") / total).alias("alpha_transparent"),
        (lum("n_translucent") / total).alias("alpha_translucent"),
        F.max(F.when(~F.col("is_luma"), F.struct(F.col("n").alias("n"), (-F.col("key")).alias("b"))))
        .alias("_m"))
    return wide.select("*", *_centers(-F.col("_m.b"))).drop("_m")


def features(lines: DataFrame) -> DataFrame:
    """Colour features plus edge shares, one row per asset."""
    return color_features(explode_pixels(lines)).join(edge_flat_ratios(lines), "asset_id")


def classify(feats: DataFrame) -> DataFrame:
    """Ordered cascade, first match wins; the safe default is photograph."""
    c = F.col
    few = ~c("unique_saturated") & (c("unique_colors") <= fixed.PALETTE_COLORS)
    aspect = F.greatest("width", "height") / F.greatest(F.least("width", "height"), F.lit(1))
    small = (F.greatest("width", "height") <= fixed.ICON_MAX_EDGE) & (aspect <= fixed.ICON_ASPECT_MAX)
    flat_graphic = (c("flat_ratio") >= fixed.FLAT_GRAPHIC_RATIO) & (c("edge_ratio") < fixed.GRAPHIC_EDGE_MAX)
    document = ((c("bimodality") >= fixed.DOC_BIMODALITY) & (c("gray_ratio") >= fixed.DOC_GRAY_RATIO)
                & (c("entropy") < fixed.DOC_ENTROPY_MAX))
    screen = ~few & (c("flat_ratio") >= fixed.UI_FLAT_RATIO) & (aspect >= fixed.UI_ASPECT_MIN)
    cascade = [
        ((c("source_format") == "ico") | (~c("has_exif") & small), "icon", 0.8),
        (c("has_exif"), "photograph", 0.9),
        (document, "document", 0.7),
        (c("entropy") >= fixed.DOC_ENTROPY_MAX, "photograph", 0.8),
        ((c("entropy") >= fixed.PHOTO_ENTROPY_STRONG) & ~(few | flat_graphic), "photograph", 0.8),
        (few, "graphic-logo", 0.85),
        (flat_graphic, "graphic-logo", 0.7),
        (screen, "ui-screenshot", 0.6),
    ]
    verdict = None
    for test, name, confidence in cascade:
        hit = F.struct(F.lit(name).alias("class"), F.lit(confidence).alias("confidence"))
        verdict = F.when(test, hit) if verdict is None else verdict.when(test, hit)
    fallback = F.struct(F.lit("photograph").alias("class"), F.lit(0.4).alias("confidence"))
    return feats.withColumn("_v", verdict.otherwise(fallback)).select(
        *feats.columns, c("_v.class").alias("class"), c("_v.confidence").alias("confidence"))


def opt_bucket(df: DataFrame, class_col: str = "class") -> DataFrame:
    """Optimisation bucket of a class."""
    return df.withColumn("bucket", lookup(F.col(class_col), fixed.BUCKET_OF_CLASS))


def analyze(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Features, class, confidence and bucket per asset.

    ``facts``: ``asset_id, width, height, has_exif, source_format``.
    """
    require(facts, "asset_id", "width", "height", "has_exif", "source_format")
    return opt_bucket(classify(features(lines).join(facts, "asset_id")))


def degenerate(df: DataFrame, w: str = "width", h: str = "height") -> DataFrame:
    """Reason an asset cannot be analysed (zero area), else NULL."""
    return df.withColumn("reason", F.when((F.col(w) == 0) | (F.col(h) == 0), F.concat(
        F.lit("cannot analyse a degenerate image with zero area ("), F.col(w).cast("string"),
        F.lit("x"), F.col(h).cast("string"), F.lit(")"))))


def class_report(classified: DataFrame) -> DataFrame:
    """Assets, mean entropy and mean edge share by bucket and class, with subtotals."""
    return classified.rollup("bucket", "class").agg(
        F.count(F.lit(1)).alias("assets"), F.avg("entropy").alias("mean_entropy"),
        F.avg("edge_ratio").alias("mean_edge_ratio"))
