"""Content-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from . import inputs as I
from .inputs import APX, DIM, PX, RFACTS, ctes
from .registry import query

HIST = """lum AS (SELECT *, (77 * r + 150 * g + 29 * b) >> 8 AS luma, greatest(r, g, b) - least(r, g, b) AS chroma FROM {src}),
hist AS (SELECT asset_id, luma, count(*) AS n FROM lum GROUP BY asset_id, luma),
total AS (SELECT asset_id, count(*) AS t FROM lum GROUP BY asset_id)"""
H = HIST.format(src="px")
ENT = """ent AS (SELECT asset_id, -sum((n / t::DOUBLE) * log2(n / t::DOUBLE)) AS entropy FROM hist JOIN total USING (asset_id) GROUP BY asset_id),
bim AS (SELECT asset_id, sum(n) / any_value(t)::DOUBLE AS bimodality FROM (
   SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, luma) AS rn FROM hist) JOIN total USING (asset_id)
   WHERE rn <= 2 GROUP BY asset_id)"""
COL = """col AS (SELECT asset_id, count(DISTINCT r * 65536 + g * 256 + b) AS unique_colors,
   count(DISTINCT r * 65536 + g * 256 + b) >= 4096 AS unique_saturated, count_if(chroma <= 12) / count(*)::DOUBLE AS gray_ratio,
   count_if(chroma <= 32) / count(*)::DOUBLE AS sat_low_ratio, count_if(a = 0) / count(*)::DOUBLE AS alpha_transparent,
   count_if(a > 0 AND a < 255) / count(*)::DOUBLE AS alpha_translucent FROM lum GROUP BY asset_id)"""
DOM = """dom AS (SELECT asset_id, (bin >> 8) * 16 + 8 AS dom_r, ((bin >> 4) & 15) * 16 + 8 AS dom_g, (bin & 15) * 16 + 8 AS dom_b,
   255 AS dom_a FROM (SELECT asset_id, bin, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, bin) AS rn FROM (
   SELECT asset_id, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) AS bin, count(*) AS n FROM lum GROUP BY ALL)) WHERE rn = 1)"""
EDGE = """grad AS (SELECT asset_id, abs(right_ - luma) + abs(below - luma) AS grad FROM (SELECT asset_id, luma,
   lead(luma) OVER (PARTITION BY asset_id, y ORDER BY x) AS right_, lead(luma) OVER (PARTITION BY asset_id, x ORDER BY y) AS below FROM lum)),
edge AS (SELECT asset_id, count_if(grad >= 48) / count(grad)::DOUBLE AS edge_ratio, count_if(grad <= 4) / count(grad)::DOUBLE AS flat_ratio
   FROM grad GROUP BY asset_id)"""
CASCADE = """CASE
   WHEN source_format = 'ico' OR (NOT has_exif AND greatest(width, height) <= 128 AND {asp} <= 2.0) THEN {icon}
   WHEN has_exif THEN {exif}
   WHEN bimodality >= 0.55 AND gray_ratio >= 0.85 AND entropy < 4.5 THEN {doc}
   WHEN entropy >= 4.5 THEN {photo}
   WHEN entropy >= 4.0 AND NOT ((NOT unique_saturated AND unique_colors <= 256) OR (flat_ratio >= 0.60 AND edge_ratio < 0.08)) THEN {photo}
   WHEN NOT unique_saturated AND unique_colors <= 256 THEN {few}
   WHEN flat_ratio >= 0.60 AND edge_ratio < 0.08 THEN {flat}
   WHEN flat_ratio >= 0.35 AND {asp} >= 1.3 THEN {ui} ELSE {rest} END"""
ASP = "(greatest(width, height)::DOUBLE / greatest(least(width, height), 1))"
CLASS = CASCADE.format(asp=ASP, icon="'icon'", exif="'photograph'", doc="'document'", photo="'photograph'", few="'graphic-logo'",
                       flat="'graphic-logo'", ui="'ui-screenshot'", rest="'photograph'")
CONF = CASCADE.format(asp=ASP, icon="0.8", exif="0.9", doc="0.7", photo="0.8", few="0.85", flat="0.7", ui="0.6", rest="0.4")
BUCKET = "CASE class WHEN 'photograph' THEN 'lossy' WHEN 'ui-screenshot' THEN 'mixed-safe' ELSE 'lossless-flat' END"
CLASSED = f"""feats AS (SELECT * FROM rfacts JOIN ent USING (asset_id) JOIN bim USING (asset_id) JOIN col USING (asset_id)
   JOIN dom USING (asset_id) JOIN edge USING (asset_id)),
classed AS (SELECT *, {BUCKET} AS bucket FROM (SELECT *, {CLASS} AS class, CAST({CONF} AS DOUBLE) AS confidence FROM feats))"""
ALL = ctes(PX, RFACTS, H, ENT, COL, DOM, EDGE, CLASSED)


def analyzed(spark, sf):
    return A.analyze(I.lines(spark, sf), I.raster_facts(spark, sf))


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("a1_luma", ctes(PX, H) + "SELECT asset_id, x, y, luma FROM lum")
def a1(spark, sf):
    return A.luma(I.pixels(spark, sf)).select("asset_id", "x", "y", "luma")


@query("a2_luma_histogram", ctes(PX, H) + "SELECT asset_id, luma, n FROM hist")
def a2(spark, sf):
    return A.luma_histogram(I.pixels(spark, sf))


@query("a3_entropy", ctes(PX, H, ENT) + "SELECT asset_id, round(entropy, 6) AS entropy FROM ent")
def a3(spark, sf):
    return rounded(A.entropy(A.luma_histogram(I.pixels(spark, sf))), "entropy")


@query("a4_bimodality", ctes(PX, H, ENT) + "SELECT asset_id, round(bimodality, 6) AS bimodality FROM bim")
def a4(spark, sf):
    return rounded(A.bimodality(A.luma_histogram(I.pixels(spark, sf))), "bimodality")


@query("a5_unique_colors", ctes(PX) + """SELECT asset_id, count(DISTINCT (r, g, b)) AS unique_colors,
    count(DISTINCT (r, g, b)) >= 256 AS unique_saturated FROM px GROUP BY asset_id""")
def a5(spark, sf):
    return A.unique_colors(A.color_counts(I.pixels(spark, sf)), cap=256)


@query("a5_unique_colors_approx")
def a5_approx(spark, sf):
    return A.unique_colors_approx(I.pixels(spark, sf))


@query("a5_unique_colors_approx_error", ctes(PX) + """SELECT asset_id, count(DISTINCT (r, g, b)) AS unique_colors, true AS within FROM px GROUP BY asset_id""")
def a5_approx_error(spark, sf):
    """The sketch against the exact count: within five of its standard errors (one percent), or one colour."""
    px = I.pixels(spark, sf)
    exact = A.unique_colors(A.color_counts(px)).select("asset_id", "unique_colors")
    near = A.unique_colors_approx(px).select("asset_id", F.col("unique_colors").alias("_near"))
    off = F.abs(F.col("_near") - F.col("unique_colors"))
    return exact.join(near, "asset_id").select("asset_id", "unique_colors", (off <= F.greatest(F.lit(1.0), 0.05 * F.col("unique_colors"))).alias("within"))


@query("a6_gray_ratio", ctes(PX, H, COL) + "SELECT asset_id, round(gray_ratio, 6) AS gray_ratio FROM col")
def a6(spark, sf):
    return rounded(A.gray_ratio(A.color_counts(I.pixels(spark, sf))), "gray_ratio")


@query("a7_sat_low_ratio", ctes(PX, H, COL) + "SELECT asset_id, round(sat_low_ratio, 6) AS sat_low_ratio FROM col")
def a7(spark, sf):
    return rounded(A.sat_low_ratio(A.color_counts(I.pixels(spark, sf))), "sat_low_ratio")


@query("a8_alpha_ratios", ctes(PX, APX, HIST.format(src="apx"), COL) + """SELECT asset_id,
    round(alpha_transparent, 6) AS alpha_transparent, round(alpha_translucent, 6) AS alpha_translucent FROM col""")
def a8(spark, sf):
    return rounded(A.alpha_ratios(A.color_counts(I.alpha_pixels(spark, sf))), "alpha_transparent", "alpha_translucent")


@query("a9_dominant_color", ctes(PX, H, DOM) + "SELECT * FROM dom")
def a9(spark, sf):
    return A.dominant_color(A.color_counts(I.pixels(spark, sf)))


@query("a10_edge_flat_ratios", ctes(PX, H, EDGE) + """SELECT asset_id, round(edge_ratio, 6) AS edge_ratio,
    round(flat_ratio, 6) AS flat_ratio FROM edge""")
def a10(spark, sf):
    return rounded(A.edge_flat_ratios(I.lines(spark, sf), band_lines=8), "edge_ratio", "flat_ratio")


@query("a11_edge_row_stride", ctes(DIM) + """SELECT asset_id, line, part_id, supp_id, CASE WHEN (w - 1) * (h - 1) > 4000000
    THEN greatest(((w - 1) * (h - 1)) // 4000000, 1) ELSE 1 END AS stride FROM dims""")
def a11(spark, sf):
    return I.dims(spark, sf).select("asset_id", "line", "part_id", "supp_id", A.row_stride(F.col("w"), F.col("h")).alias("stride"))


FEATURE_ROWS = """frows AS (SELECT l_orderkey AS asset_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id,
   CAST(40 + l_partkey % 1600 AS BIGINT) AS width, CAST(40 + (l_suppkey * 13) % 900 AS BIGINT) AS height,
   l_partkey % 9 = 0 AS has_exif, CASE WHEN l_orderkey % 40 = 7 THEN 'ico' ELSE 'png' END AS source_format,
   l_quantity / 8.0::DOUBLE AS entropy, l_tax * 10.0::DOUBLE AS bimodality, 1.0::DOUBLE - l_discount * 2.0::DOUBLE AS gray_ratio,
   CAST(least(l_partkey * 7, 4096) AS BIGINT) AS unique_colors, l_partkey * 7 >= 4096 AS unique_saturated,
   l_linenumber / 8.0::DOUBLE AS flat_ratio, l_discount * 1.5::DOUBLE AS edge_ratio FROM lineitem)"""


def feature_rows(spark, sf):
    e = F.expr
    return I.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"), e("40 + l_partkey % 1600").alias("width"), e("40 + (l_suppkey * 13) % 900").alias("height"),
        e("l_partkey % 9 = 0").alias("has_exif"), e("if(l_orderkey % 40 = 7, 'ico', 'png')").alias("source_format"),
        e("l_quantity / 8.0D").alias("entropy"), e("l_tax * 10.0D").alias("bimodality"), e("1.0D - l_discount * 2.0D").alias("gray_ratio"),
        e("least(l_partkey * 7, 4096)").alias("unique_colors"), e("l_partkey * 7 >= 4096").alias("unique_saturated"),
        e("l_linenumber / 8.0D").alias("flat_ratio"), e("l_discount * 1.5D").alias("edge_ratio"))


@query("a12_classify", ctes(FEATURE_ROWS) + f"""SELECT asset_id, line, part_id, supp_id, {CLASS} AS class,
    CAST({CONF} AS DOUBLE) AS confidence FROM frows""")
def a12(spark, sf):
    return A.classify(feature_rows(spark, sf)).select("asset_id", "line", "part_id", "supp_id", "class", "confidence")


@query("a12_classify_rasters", ALL + "SELECT asset_id, class, confidence FROM classed")
def a12_rasters(spark, sf):
    return analyzed(spark, sf).select("asset_id", "class", "confidence")


@query("a13_opt_bucket", ALL + "SELECT asset_id, class, bucket FROM classed")
def a13(spark, sf):
    return analyzed(spark, sf).select("asset_id", "class", "bucket")


@query("a14_analyze", ALL + """SELECT asset_id, round(entropy, 6) AS entropy, round(bimodality, 6) AS bimodality, unique_colors,
    unique_saturated, round(gray_ratio, 6) AS gray_ratio, round(sat_low_ratio, 6) AS sat_low_ratio, round(edge_ratio, 6) AS edge_ratio,
    round(flat_ratio, 6) AS flat_ratio, dom_r, dom_g, dom_b, dom_a, class, bucket, confidence FROM classed""")
def a14(spark, sf):
    out = analyzed(spark, sf).select(
        "asset_id", "entropy", "bimodality", "unique_colors", "unique_saturated", "gray_ratio", "sat_low_ratio", "edge_ratio",
        "flat_ratio", "dom_r", "dom_g", "dom_b", "dom_a", "class", "bucket", "confidence")
    return rounded(out, "entropy", "bimodality", "gray_ratio", "sat_low_ratio", "edge_ratio", "flat_ratio")


@query("a15_degenerate", """SELECT l_orderkey AS asset_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id,
    CASE WHEN l_partkey % 50 = 0 OR l_suppkey % 20 = 0 THEN 'cannot analyse a degenerate image with zero area (' || (l_partkey % 50) || 'x' || (l_suppkey % 20) || ')' END AS reason FROM lineitem""")
def a15(spark, sf):
    rows = I.dims(spark, sf).withColumns({"width": F.col("part_id") % 50, "height": F.col("supp_id") % 20})
    return A.degenerate(rows).select("asset_id", "line", "part_id", "supp_id", "reason")


@query("a16_class_report", ALL + """SELECT bucket, class, count(*) AS assets, round(avg(entropy), 6) AS mean_entropy,
    round(avg(edge_ratio), 6) AS mean_edge_ratio FROM classed GROUP BY ROLLUP (bucket, class)""")
def a16(spark, sf):
    return rounded(A.class_report(analyzed(spark, sf)), "mean_entropy", "mean_edge_ratio")
