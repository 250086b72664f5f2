"""Raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as R
from . import inputs as I
from .inputs import APX, DIM, PX, RFACTS, ctes
from .registry import query

OUT = "asset_id, w, h, x, y, r, g, b, a"
LANCZOS = """
CASE WHEN abs({t}) < 1e-12 THEN 1.0 WHEN abs({t}) >= 3.0 THEN 0.0
     ELSE sin(pi() * ({t})) * sin(pi() * ({t}) / 3.0) * 3.0 / ((pi() * ({t})) * (pi() * ({t}))) END"""


def _lin(c: str, top: str = "255.0::DOUBLE") -> str:
    v = f"({c} / {top})"
    return f"CASE WHEN {v} <= 0.040448237 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END"


def _enc(c: str) -> str:
    v = f"greatest(0.0, least(1.0, {c}))"
    return (f"CAST(round(CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 "
            f"ELSE 1.055 * pow({v}, 1.0 / 2.4) - 0.055 END * 255.0) AS BIGINT)")


def resample_ctes(src: str, dw: str, dh: str, name: str = "resampled") -> str:
    """Two-pass resample of CTE ``src`` written as joins over every destination index."""
    def axis(inp: str, out: str, ax: str, n: str, d: str, other: str) -> str:
        t = f"((s.{ax} + 0.5::DOUBLE - (k.d + 0.5::DOUBLE) * (s.{n}::DOUBLE / s.{d})) / greatest(s.{n}::DOUBLE / s.{d}, 1.0))"
        w = f"CASE WHEN s.{n} = s.{d} THEN CASE WHEN s.{ax} = k.d THEN 1.0 ELSE 0.0 END ELSE {LANCZOS.format(t=t)} END"
        sums = ", ".join(f"sum(wt * {c}) / sum(wt) AS {c}" for c in "rgba")
        return f"""{out} AS (SELECT asset_id, w, h, dw, dh, {other}, d AS {ax}, {sums} FROM (
            SELECT s.*, k.d, {w} AS wt FROM (SELECT * EXCLUDE ({ax}), {ax} FROM {inp}) s
            JOIN (SELECT unnest(range(64)) AS d) k ON k.d < s.{d}) WHERE wt <> 0 GROUP BY ALL)"""
    return ",\n".join([
        f"""lin AS (SELECT asset_id, w, h, {dw} AS dw, {dh} AS dh, x, y, {_lin('r')} AS r, {_lin('g')} AS g,
            {_lin('b')} AS b, a / 255.0::DOUBLE AS a FROM {src})""",
        axis("lin", "pass1", "x", "w", "dw", "y"), axis("pass1", "pass2", "y", "h", "dh", "x"),
        f"""{name} AS (SELECT asset_id, CAST(dw AS INT) AS w, CAST(dh AS INT) AS h, x, y, {_enc('r')} AS r, {_enc('g')} AS g,
            {_enc('b')} AS b, CAST(round(greatest(0.0, least(1.0, a)) * 255.0) AS BIGINT) AS a FROM pass2)"""])


@query("r1_explode_pixels", ctes(PX) + f"SELECT {OUT} FROM px")
def r1(spark, sf):
    return R.explode_pixels(R.collect_scanlines(I.pixels(spark, sf)))


@query("r1_explode_array", """SELECT vec_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y,
       round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value
FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)""")
def r1_array(spark, sf):
    emb = I.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return R.explode_array(emb, "e", 8).withColumn("value", F.round("value", 6))


@query("r2_identity", ctes(PX) + f"SELECT {OUT} FROM px")
def r2(spark, sf):
    return R.identity(I.pixels(spark, sf))


@query("r3_invert", ctes(PX) + "SELECT asset_id, w, h, x, y, 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM px")
def r3(spark, sf):
    return R.invert(I.pixels(spark, sf))


@query("r3_invert_sixteen_bit", ctes(PX) + """SELECT asset_id, x, y, 65535 - r * 257 AS r, 65535 - g * 257 AS g,
       65535 - b * 257 AS b, a * 257 AS a FROM px""")
def r3_16(spark, sf):
    wide = I.pixels(spark, sf).withColumns({c: F.col(c) * 257 for c in "rgba"})
    return R.invert(wide, 16).select("asset_id", "x", "y", "r", "g", "b", "a")


MODES = ["max", "exact", "percent", "fit", "cover", "fill"]
MODE_SQL = "(['max','exact','percent','fit','cover','fill'])[part_id % 6 + 1]"
PLAN_SQL = f"""requests AS (SELECT *, {MODE_SQL} AS mode, 200 + supp_id * 37 AS tw, 150 + line * 410 AS th,
    1.0 + part_id % 250 AS pct FROM dims),
scaled AS (SELECT *, CASE mode WHEN 'max' THEN least(tw::DOUBLE / greatest(w, h), 1.0)
      WHEN 'percent' THEN pct / 100.0::DOUBLE WHEN 'fit' THEN least(tw::DOUBLE / w, th::DOUBLE / h, 1.0)
      WHEN 'exact' THEN NULL ELSE greatest(tw::DOUBLE / w, th::DOUBLE / h) END AS s FROM requests),
planned AS (SELECT *, CASE WHEN mode = 'exact' THEN tw ELSE greatest(CAST(round(w * s) AS BIGINT), 1) END AS dw,
      CASE WHEN mode = 'exact' THEN th ELSE greatest(CAST(round(h * s) AS BIGINT), 1) END AS dh FROM scaled)"""


def planned(spark, sf):
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), (F.col("part_id") % 6 + 1).cast("int"))
    req = I.dims(spark, sf).withColumns({
        "mode": mode, "tw": F.col("supp_id") * 37 + 200, "th": F.col("line").cast("bigint") * 410 + 150,
        "pct": F.col("part_id") % 250 + F.lit(1.0)})
    return R.plan_resize(req, F.col("mode"), F.col("tw"), F.col("th"), F.col("pct"))


@query("r4_plan_resize", ctes(DIM, PLAN_SQL) + "SELECT asset_id, line, part_id, supp_id, mode, w, h, dw, dh FROM planned")
def r4(spark, sf):
    return planned(spark, sf).select("asset_id", "line", "part_id", "supp_id", "mode", "w", "h", "dw", "dh")


@query("r5_resize_limits", ctes(DIM, PLAN_SQL) + """SELECT asset_id, line, part_id, supp_id, dw, dh,
    CASE WHEN greatest(dw, dh) > 50000 THEN 'edge' WHEN dw * dh > 134217728 THEN 'area' END AS reason FROM planned""")
def r5(spark, sf):
    return R.resize_limits(planned(spark, sf)).select("asset_id", "line", "part_id", "supp_id", "dw", "dh", "reason")


@query("r6_linear_light", ctes(PX) + f"""SELECT asset_id, x, y, round({_lin('r')}, 6) AS lr, round({_lin('g')}, 6) AS lg,
    {_enc(_lin('g'))} AS g_again FROM px""")
def r6(spark, sf):
    from ..functions import color
    lin = I.pixels(spark, sf).withColumns({"lr": color.decode_sample(F.col("r")), "lg": color.decode_sample(F.col("g"))})
    return lin.select("asset_id", "x", "y", F.round("lr", 6).alias("lr"), F.round("lg", 6).alias("lg"),
                      color.encode_sample(F.col("lg")).alias("g_again"))


@query("r7_resample", ctes(PX, APX, resample_ctes("apx", "20", "12")) + f"SELECT {OUT} FROM resampled")
def r7(spark, sf):
    return R.resize(I.alpha_pixels(spark, sf), "exact", 20, 12)


@query("r7_resample_same_size", ctes(PX) + f"SELECT {OUT} FROM px")
def r7_same(spark, sf):
    return R.resize(I.pixels(spark, sf), "max", 2048)


@query("r8_crop_center", ctes(PX) + """SELECT asset_id, 11 AS w, 20 AS h, x - 10 AS x, y - 6 AS y, r, g, b, a FROM px
    WHERE x >= 10 AND x < 21 AND y >= 6 AND y < 26""")
def r8(spark, sf):
    return R.crop_center(I.pixels(spark, sf), 11, 20)


@query("r9_resize_fill", ctes(PX, resample_ctes("px", "24", "24")) + """SELECT asset_id, 24 AS w, 10 AS h, x, y - 7 AS y,
    r, g, b, a FROM resampled WHERE y >= 7 AND y < 17""")
def r9(spark, sf):
    return R.resize_fill(I.pixels(spark, sf), 24, 10)


@query("r9_resize_fill_lines", ctes(PX, resample_ctes("px", "24", "24")) + """SELECT asset_id, 24 AS w, 10 AS h, x, y - 7 AS y,
    r, g, b, a FROM resampled WHERE y >= 7 AND y < 17""")
def r9_lines(spark, sf):
    out = R.explode_pixels(R.resize_lines(I.lines(spark, sf), "fill", 24, 10))
    return out.select("asset_id", "w", "h", "x", "y", "r", "g", "b", "a")


@query("r10_thumbnail", ctes(PX, resample_ctes("px", "16", "16")) + f"SELECT {OUT} FROM resampled")
def r10(spark, sf):
    return R.thumbnail(I.pixels(spark, sf), 16)


@query("r10_thumbnail_square", ctes(PX, resample_ctes("px", "8", "8")) + f"SELECT {OUT} FROM resampled")
def r10_square(spark, sf):
    return R.thumbnail(I.pixels(spark, sf), 8, square=True)


R11_SQL = ctes(PX) + """SELECT asset_id, CAST(1 + asset_id % 8 AS INT) AS o,
    CASE WHEN asset_id % 8 IN (4,5,6,7) THEN h ELSE w END AS w, CASE WHEN asset_id % 8 IN (4,5,6,7) THEN w ELSE h END AS h,
    CASE asset_id % 8 WHEN 1 THEN w-1-x WHEN 2 THEN w-1-x WHEN 4 THEN y WHEN 5 THEN h-1-y WHEN 6 THEN h-1-y WHEN 7 THEN y ELSE x END AS x,
    CASE asset_id % 8 WHEN 2 THEN h-1-y WHEN 3 THEN h-1-y WHEN 4 THEN x WHEN 5 THEN x WHEN 6 THEN w-1-x WHEN 7 THEN w-1-x ELSE y END AS y,
    r, g, b, a FROM px"""


@query("r11_auto_orient", R11_SQL)
def r11(spark, sf):
    px = I.pixels(spark, sf).withColumn("orientation", F.expr("cast(1 + asset_id % 8 as int)"))
    return R.auto_orient(px.withColumn("o", F.col("orientation"))).drop("orientation")


@query("r11_auto_orient_lines", R11_SQL)
def r11_lines(spark, sf):
    lines = I.lines(spark, sf).withColumn("orientation", F.expr("cast(1 + asset_id % 8 as int)"))
    out = R.auto_orient_lines(lines.withColumn("o", F.col("orientation")))
    return R.explode_pixels(out).where("r is not null").select("asset_id", "o", "w", "h", "x", "y", "r", "g", "b", "a")


GRAVITIES = ["center", "north", "south", "east", "west", "northeast", "northwest", "southeast", "southwest"]
PLACE = """placed AS (SELECT asset_id, line, part_id, supp_id, w AS bw, h AS bh, 50 + supp_id * 9 AS ow, 20 + part_id % 900 AS oh,
    line * 3 AS margin, (['center','north','south','east','west','northeast','northwest','southeast','southwest'])[(part_id + line) % 9 + 1] AS gravity FROM dims)"""


@query("r12_gravity_place", ctes(DIM, PLACE) + """SELECT asset_id, line, part_id, supp_id, gravity,
    CASE WHEN gravity LIKE '%west' THEN margin WHEN gravity LIKE '%east' THEN greatest(0, greatest(0, bw - ow) - margin)
         ELSE greatest(0, bw - ow) // 2 END AS ox,
    CASE WHEN gravity LIKE 'north%' THEN margin WHEN gravity LIKE 'south%' THEN greatest(0, greatest(0, bh - oh) - margin)
         ELSE greatest(0, bh - oh) // 2 END AS oy FROM placed""")
def r12(spark, sf):
    gravity = F.element_at(F.array(*[F.lit(g) for g in GRAVITIES]), ((F.col("part_id") + F.col("line")) % 9 + 1).cast("int"))
    req = I.dims(spark, sf).select(
        "asset_id", "line", "part_id", "supp_id", F.col("w").alias("bw"), F.col("h").alias("bh"),
        (F.col("supp_id") * 9 + 50).alias("ow"), (F.col("part_id") % 900 + 20).alias("oh"),
        (F.col("line") * 3).alias("margin"), gravity.alias("gravity"))
    return R.gravity_place(req).select("asset_id", "line", "part_id", "supp_id", "gravity", "ox", "oy")


def overlay(spark, sf):
    """The corner of the corpus-wide mean mosaic as a translucent 12x10 overlay."""
    mean = lambda c: F.floor(F.avg(c)).cast("int").alias(c)
    return (I.pixels(spark, sf).where("x < 12 and y < 10").groupBy("x", "y").agg(mean("r"), mean("g"), mean("b"))
            .withColumn("a", ((F.col("x") * 20 + F.col("y") * 9) % 256).cast("int")))


OVERLAY = """ov AS (SELECT x AS vx, y AS vy, CAST(floor(avg(r)) AS BIGINT) AS vr, CAST(floor(avg(g)) AS BIGINT) AS vg,
    CAST(floor(avg(b)) AS BIGINT) AS vb, (x * 20 + y * 9) % 256 AS va FROM px WHERE x < 12 AND y < 10 GROUP BY x, y)"""


def _blend_sql(src: str, on: str, va: str = "va") -> str:
    f, b = f"(coalesce({va}, 0) / 255.0::DOUBLE)", "(a / 255.0::DOUBLE)"
    oa = f"({b} + {f} - {b} * {f})"
    mix = lambda c, v: (f"CASE WHEN {f} = 0 THEN {c} ELSE CAST(round(({v} * {f} + {c} * {b} * (1.0 - {f})) / {oa}) AS BIGINT) END AS {c}")
    return (f"SELECT asset_id, w, h, x, y, {mix('r', 'vr')}, {mix('g', 'vg')}, {mix('b', 'vb')}, "
            f"CASE WHEN {f} = 0 THEN a ELSE CAST(round({oa} * 255.0) AS BIGINT) END AS a FROM {src} LEFT JOIN ov ON {on}")


@query("r13_composite", ctes(PX, APX, OVERLAY) + _blend_sql("apx", "apx.x - 25 = vx AND apx.y - 3 = vy"))
def r13(spark, sf):
    return R.composite(I.alpha_pixels(spark, sf), overlay(spark, sf), 25, 3)


@query("r13_watermark", ctes(PX, APX, OVERLAY) + "SELECT asset_id, w, h, x, y, r, g, b, CASE WHEN asset_id % 4 = 1 THEN a ELSE 255 END AS a FROM ("
       + _blend_sql("apx", "apx.x - 18 = vx AND apx.y - 20 = vy", "round(va * 0.5::DOUBLE)") + ")")
def r13_watermark(spark, sf):
    return R.watermark(I.alpha_pixels(spark, sf), overlay(spark, sf), 12, 10, "southeast", 2, 0.5, had_alpha=F.col("asset_id") % 4 == 1)


@query("r14_composite_tiled", ctes(PX, APX, OVERLAY) + _blend_sql("apx", "apx.x % 12 = vx AND apx.y % 10 = vy"))
def r14(spark, sf):
    return R.composite_tiled(I.alpha_pixels(spark, sf), overlay(spark, sf), 12, 10)


def overlay_lines(spark, sf):
    px = overlay(spark, sf)
    return R.collect_scanlines(px.withColumns({"asset_id": F.lit(0), "w": F.lit(12), "h": F.lit(10)})).select("y", "r", "g", "b", "a")


def alpha_lines(spark, sf):
    return R.collect_scanlines(I.alpha_pixels(spark, sf))


PIXEL = ["asset_id", "w", "h", "x", "y", "r", "g", "b", "a"]


@query("r13_composite_lines", ctes(PX, APX, OVERLAY) + _blend_sql("apx", "apx.x - 25 = vx AND apx.y - 3 = vy"))
def r13_lines(spark, sf):
    return R.explode_pixels(R.composite_lines(alpha_lines(spark, sf), overlay_lines(spark, sf), 25, 3)).select(PIXEL)


@query("r13_watermark_lines", ctes(PX, APX, OVERLAY) + "SELECT asset_id, w, h, x, y, r, g, b, CASE WHEN asset_id % 4 = 1 THEN a ELSE 255 END AS a FROM ("
       + _blend_sql("apx", "apx.x - 18 = vx AND apx.y - 20 = vy", "round(va * 0.5::DOUBLE)") + ")")
def r13_watermark_lines(spark, sf):
    out = R.watermark_lines(alpha_lines(spark, sf), overlay_lines(spark, sf), 12, 10, "southeast", 2, 0.5, had_alpha=F.col("asset_id") % 4 == 1)
    return R.explode_pixels(out).select(PIXEL)


@query("r14_composite_tiled_lines", ctes(PX, APX, OVERLAY) + _blend_sql("apx", "apx.x % 12 = vx AND apx.y % 10 = vy"))
def r14_lines(spark, sf):
    return R.explode_pixels(R.composite_lines(alpha_lines(spark, sf), overlay_lines(spark, sf), tile=10)).select(PIXEL)


@query("r15_overlay_opacity", ctes(PX, APX) + """SELECT asset_id, x, y, r, g, b, CASE WHEN asset_id % 3 = 0 THEN a
    ELSE CAST(round(a * 0.35::DOUBLE) AS BIGINT) END AS a FROM apx""")
def r15(spark, sf):
    opacity = F.when(F.col("asset_id") % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.35))
    return R.overlay_opacity(I.alpha_pixels(spark, sf), opacity).select("asset_id", "x", "y", "r", "g", "b", "a")


@query("r16_overlay_scale_dims", ctes(DIM) + """SELECT asset_id, line, part_id, supp_id, tw,
    greatest(CAST(round(tw * oh::DOUBLE / ow) AS BIGINT), 1) AS th FROM (
    SELECT *, greatest(CAST(round(w * scale) AS BIGINT), 1) AS tw FROM (
    SELECT *, 1 + supp_id % 300 AS ow, 1 + part_id % 500 AS oh, line / 16.0::DOUBLE AS scale FROM dims))""")
def r16(spark, sf):
    req = I.dims(spark, sf).withColumns({"bw": F.col("w"), "ow": F.col("supp_id") % 300 + 1, "oh": F.col("part_id") % 500 + 1,
                                         "scale": F.col("line") / 16.0})
    return R.overlay_scale_dims(req).select("asset_id", "line", "part_id", "supp_id", "tw", "th")


@query("r17_narrow_layout", ctes(PX, APX, RFACTS) + """SELECT asset_id, all_gray, any_translucent, CASE
    WHEN source_gray AND all_gray THEN CASE WHEN source_alpha OR any_translucent THEN 'LA' ELSE 'L' END
    WHEN source_alpha OR any_translucent THEN 'RGBA' ELSE 'RGB' END AS layout
    FROM (SELECT asset_id, bool_and(r = g AND g = b) AS all_gray, min(a) < 255 AS any_translucent FROM apx GROUP BY asset_id)
    JOIN rfacts USING (asset_id)""")
def r17(spark, sf):
    return R.narrow_layout(I.alpha_pixels(spark, sf), I.raster_facts(spark, sf))


@query("r18_depth_downgrade", ctes(I.AS, I.AF) + """SELECT asset_id, bit_depth, target_fmt, down AS downgraded,
    CASE WHEN down THEN 'warning: ' || bit_depth || '-bit source downgraded to 8-bit for ' || target_fmt || ' output' END AS warning
    FROM (SELECT *, bit_depth > 8 AND target_fmt IN ('jpeg','avif','webp','bmp') AS down FROM (SELECT asset_id, bit_depth,
    (['jpeg','png','avif','tiff','webp','gif','bmp'])[bytes % 7 + 1] AS target_fmt FROM afacts))""")
def r18(spark, sf):
    fmts = F.array(*[F.lit(f) for f in ("jpeg", "png", "avif", "tiff", "webp", "gif", "bmp")])
    req = I.asset_facts(spark, sf).select("asset_id", "bit_depth", F.element_at(fmts, (F.col("bytes") % 7 + 1).cast("int")).alias("target_fmt"))
    return R.depth_downgrade(req).select("asset_id", "bit_depth", "target_fmt", "downgraded", "warning")
