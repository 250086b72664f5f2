"""Responsive variant queries: one asset per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import mime_for_format
from ..operators import responsive as V
from . import inputs as I
from .inputs import ctes
from .registry import query

E = F.expr
FORMATS = ["avif", "webp", "jpeg"]
SPECS = ["320,640,1280", " 640, 320 ,640", "100,2000,3200", "4000,9000", "12,x", "0,50", "", "160"]
ARR = "(['" + "','".join(SPECS) + "'])"
REQ = f"""vreq AS (SELECT p_partkey AS asset_id, replace(p_name, ' ', '_') || p_partkey AS stem, 200 + p_size * 60 AS src_w,
  CASE WHEN p_partkey % 17 = 0 THEN 9000000 ELSE 100 + p_partkey % 1500 END AS src_h, {ARR}[p_partkey % 8 + 1] AS spec FROM part)"""
SETS = """vlist AS (SELECT *, len(list_filter(string_split(spec, ','), lambda s: coalesce(TRY_CAST(trim(s) AS BIGINT), 0) < 1)) > 0 AS bad FROM vreq),
vwidths AS (SELECT DISTINCT asset_id, stem, src_w, src_h, CAST(trim(s) AS BIGINT) AS req FROM (SELECT *, unnest(string_split(spec, ',')) AS s FROM vlist WHERE NOT bad)),
kept AS (SELECT *, least(req::DOUBLE / src_w, 1000000::DOUBLE / src_h, 1.0) AS s FROM vwidths WHERE req <= src_w),
sized AS (SELECT *, greatest(CAST(round(src_w * s) AS BIGINT), 1) AS w, greatest(CAST(round(src_h * s) AS BIGINT), 1) AS h FROM kept),
variants AS (SELECT * FROM sized QUALIFY row_number() OVER (PARTITION BY asset_id, w ORDER BY req) = 1),
fmts(fmt_ord, fmt, ext, mime) AS (VALUES (0, 'avif', 'avif', 'image/avif'), (1, 'webp', 'webp', 'image/webp'), (2, 'jpeg', 'jpg', 'image/jpeg')),
matrix AS (SELECT asset_id, w, h, fmt_ord, fmt, mime, stem || '-' || w || 'w.' || ext AS name FROM variants, fmts),
sets AS (SELECT asset_id, fmt_ord, fmt, mime, string_agg(name || ' ' || w || 'w', ', ' ORDER BY w) AS srcset FROM matrix GROUP BY ALL),
widest AS (SELECT asset_id, name, w, h FROM matrix WHERE fmt = 'jpeg' QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY w DESC) = 1)"""
X = ctes(REQ, SETS)


def requests(spark, sf):
    spec = F.element_at(F.array(*[F.lit(s) for s in SPECS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("asset_id"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey").alias("stem"),
        (F.col("p_size") * 60 + 200).alias("src_w"), E("if(p_partkey % 17 = 0, 9000000, 100 + p_partkey % 1500)").alias("src_h"), spec.alias("spec"))


def variants(spark, sf):
    return V.variant_dims(V.surviving_widths(requests(spark, sf).withColumn("widths", V.parse_widths(F.col("spec")))))


@query("v1_parse_widths", X + """SELECT asset_id, CASE WHEN NOT bad THEN (SELECT string_agg(req::VARCHAR, ',' ORDER BY req) FROM vwidths w WHERE w.asset_id = vlist.asset_id) END AS widths FROM vlist""")
def v1(spark, sf):
    return requests(spark, sf).select("asset_id", F.array_join(V.parse_widths(F.col("spec")).cast("array<string>"), ",").alias("widths"))


@query("v2_surviving_widths", X + "SELECT asset_id, req AS width FROM kept")
def v2(spark, sf):
    rows = V.surviving_widths(requests(spark, sf).withColumn("widths", V.parse_widths(F.col("spec"))))
    return rows.select("asset_id", F.explode("kept").alias("width"))


@query("v2_no_width_left", X + """SELECT asset_id, CASE WHEN bad THEN 'invalid widths' WHEN asset_id NOT IN (SELECT asset_id FROM kept)
    THEN 'no requested width is ≤ the source width (' || src_w || 'px)' END AS reason FROM vlist""")
def v2_none(spark, sf):
    return variants(spark, sf).select("asset_id", "reason")


@query("v3_variant_dims", X + "SELECT asset_id, req AS requested, w, h FROM variants")
def v3(spark, sf):
    return variants(spark, sf).select("asset_id", F.explode("variants").alias("v")).select("asset_id", "v.*")


@query("v4_dedupe_actual_width", X + "SELECT asset_id, count(*) AS variants, count(DISTINCT w) AS widths FROM variants GROUP BY asset_id")
def v4(spark, sf):
    rows = variants(spark, sf).where(F.size("variants") > 0)
    return rows.select("asset_id", F.size("variants").alias("variants"),
                       F.size(F.array_distinct(F.transform("variants", lambda v: v["w"]))).alias("widths"))


@query("v5_variant_matrix", X + "SELECT asset_id, w, h, fmt_ord, fmt, name FROM matrix")
def v5(spark, sf):
    return V.variant_matrix(variants(spark, sf), FORMATS).drop("stem")


@query("v6_srcset", X + "SELECT asset_id, fmt, srcset FROM sets")
def v6(spark, sf):
    return V.srcset(variants(spark, sf), FORMATS)


@query("v7_picture_html", X + """SELECT asset_id, '<picture>' || chr(10) || string_agg('  <source type="' || mime || '" srcset="' || srcset || '">' || chr(10), '' ORDER BY fmt_ord) ||
    '  <img src="' || any_value(name) || '" width="' || any_value(w) || '" height="' || any_value(h) || '" alt="">' || chr(10) || '</picture>' AS html
    FROM sets JOIN widest USING (asset_id) GROUP BY asset_id""")
def v7(spark, sf):
    return V.picture_html(variants(spark, sf), FORMATS)


@query("v7_img_html", X + """SELECT asset_id, '<img srcset="' || srcset || '" src="' || name || '" width="' || w || '" height="' || h || '" alt="">' AS html
    FROM sets JOIN widest USING (asset_id) WHERE fmt = 'jpeg'""")
def v7_img(spark, sf):
    return V.picture_html(variants(spark, sf), ["jpeg"])


@query("v8_fallback", X + "SELECT asset_id, name AS fallback_file, w AS fallback_w, h AS fallback_h FROM widest")
def v8(spark, sf):
    return V.fallback(variants(spark, sf), FORMATS).select("asset_id", "fallback_file", "fallback_w", "fallback_h")


@query("v9_mime_for_format", ctes(I.AS) + """SELECT asset_id, 'image/' || CASE lower(ext) WHEN 'jpg' THEN 'jpeg' WHEN 'png' THEN 'png' WHEN 'webp' THEN 'webp' WHEN 'gif' THEN 'gif' ELSE 'bin' END AS mime FROM assets""")
def v9(spark, sf):
    fmt = F.when(F.lower("ext") == "jpg", "jpeg").otherwise(F.lower("ext"))
    return I.assets(spark, sf).select("asset_id", mime_for_format(fmt).alias("mime"))
