"""Ladder, fidelity and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators import quality as Q
from . import inputs as I
from .analysis_queries import H
from .decide_queries import PICK, picked
from .inputs import CD, PX, ctes
from .registry import query

LADDER = """steps AS (SELECT asset_id, luma, n, q, CAST(floor((100 - q) * 63 / 100.0::DOUBLE) AS BIGINT) + 1 AS step
   FROM hist, (SELECT unnest(range(1, 101)) AS q)),
coded AS (SELECT asset_id, q, n, luma AS v, least(255, (luma // step) * step + step // 2) AS c FROM steps),
codebins AS (SELECT asset_id, q, c, sum(n) AS n FROM coded GROUP BY ALL),
bits AS (SELECT asset_id, q, sum(n) AS t, -sum(n / tt * log2(n / tt)) AS bits FROM (
   SELECT *, sum(n) OVER (PARTITION BY asset_id, q)::DOUBLE AS tt FROM codebins) GROUP BY asset_id, q),
mom AS (SELECT asset_id, q, sum(n * v)::DOUBLE / sum(n) AS ma, sum(n * c)::DOUBLE / sum(n) AS mb, sum(n * v * v)::DOUBLE / sum(n) AS aa,
   sum(n * c * c)::DOUBLE / sum(n) AS bb, sum(n * v * c)::DOUBLE / sum(n) AS ab FROM coded GROUP BY asset_id, q),
ladder AS (SELECT asset_id, q, 100.0 * ((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) /
   ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225)) AS metric, CAST(ceil(round(bits * t / 8.0, 6)) AS BIGINT) AS bytes
   FROM mom JOIN bits USING (asset_id, q))"""
L = ctes(PX, H, LADDER)


def ladder(spark, sf):
    return Q.quality_ladder(A.luma_histogram(I.pixels(spark, sf)))


@query("q1_quality_ladder", L + "SELECT asset_id, q, round(metric, 6) AS metric, bytes FROM ladder")
def q1(spark, sf):
    return ladder(spark, sf).withColumn("metric", F.round("metric", 6))


POSTER = """bpx AS (SELECT asset_id, CASE WHEN asset_id % 9 = 4 THEN 16 ELSE w END AS w, h, x, y, (r // 24) * 24 AS r, (g // 24) * 24 AS g,
   (b // 24) * 24 AS b, a FROM px)"""


def posterized(spark, sf):
    """The mosaics quantised; some declare another width."""
    cut = lambda c: (F.floor(F.col(c) / 24) * 24).cast("int")
    return I.pixels(spark, sf).withColumns({
        "r": cut("r"), "g": cut("g"), "b": cut("b"),
        "w": F.when(F.col("asset_id") % 9 == 4, 16).otherwise(F.col("w"))})


@query("q2_pair_score", ctes(PX, POSTER) + """SELECT asset_id, reason, CASE WHEN reason IS NULL THEN round(mse, 6) END AS mse,
    CASE WHEN reason IS NULL AND mse > 0 THEN round(10.0 * log10(65025.0 / mse), 6) END AS psnr FROM (
    SELECT p.asset_id, CASE WHEN max(p.w) <> max(b.w) THEN 'dimensions differ' END AS reason,
    avg(((p.r - b.r) * (p.r - b.r) + (p.g - b.g) * (p.g - b.g) + (p.b - b.b) * (p.b - b.b)) / 3.0::DOUBLE) AS mse
    FROM px p JOIN bpx b USING (asset_id, x, y) GROUP BY p.asset_id)""")
def q2(spark, sf):
    return Q.pair_score(I.pixels(spark, sf), posterized(spark, sf)).withColumns(
        {"mse": F.round("mse", 6), "psnr": F.round("psnr", 6)})


SSIM = """pair AS (SELECT asset_id, x, y, (77 * p.r + 150 * p.g + 29 * p.b) >> 8 AS la, (77 * b.r + 150 * b.g + 29 * b.b) >> 8 AS lb,
   p.w <> b.w AS off FROM px p JOIN bpx b USING (asset_id, x, y)),
pooled AS (SELECT asset_id, k.f, x // k.f AS x, y // k.f AS y, avg(la) AS la, avg(lb) AS lb, bool_or(off) AS off
   FROM pair, (SELECT unnest([1, 2]) AS f) k GROUP BY ALL),
blocks AS (SELECT asset_id, f, x // 8 AS bx, y // 8 AS yb, avg(la) AS ma, avg(lb) AS mb, var_pop(la) AS va, var_pop(lb) AS vb,
   covar_pop(la, lb) AS cv, bool_or(off) AS off FROM pooled GROUP BY ALL),
scored AS (SELECT asset_id, CASE WHEN bool_or(off) THEN 'dimensions differ' END AS reason, 100.0 * avg(s) AS score FROM (
   SELECT asset_id, f, bool_or(off) AS off, avg(((2 * ma * mb + 6.5025) * (2 * cv + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))) AS s
   FROM blocks GROUP BY asset_id, f) GROUP BY asset_id)"""


def scores(spark, sf):
    return Q.block_ssim(I.pixels(spark, sf), posterized(spark, sf))


@query("q3_block_ssim", ctes(PX, POSTER, SSIM) + """SELECT asset_id, reason, CASE WHEN reason IS NULL THEN round(score, 6) END AS score FROM scored""")
def q3(spark, sf):
    return scores(spark, sf).withColumn("score", F.round("score", 6))


@query("q3_user_metric", ctes(PX, POSTER) + """SELECT asset_id, round(avg(s), 6) AS score FROM (SELECT asset_id, x // 8 AS bx, y // 8 AS yb,
    avg(abs(((77 * p.r + 150 * p.g + 29 * p.b) >> 8) - ((77 * b.r + 150 * b.g + 29 * b.b) >> 8))) AS s FROM px p JOIN bpx b USING (asset_id, x, y) GROUP BY ALL) GROUP BY asset_id""")
def q3_user(spark, sf):
    out = Q.block_metric(I.pixels(spark, sf), posterized(spark, sf), lambda x, y: (x - y).abs().mean())
    return out.withColumn("score", F.round("score", 6))


@query("q4_diff_gate", ctes(PX, POSTER, SSIM) + """SELECT asset_id, coalesce(CASE WHEN reason IS NULL THEN score >= 85 END, false) AS passed FROM scored""")
def q4(spark, sf):
    return Q.diff_gate(scores(spark, sf), 85).select("asset_id", "passed")


@query("q5_search_quality", L + """SELECT asset_id, coalesce(min(q) FILTER (WHERE metric >= 98), 100) AS quality,
    round(arg_min(metric, q) FILTER (WHERE metric >= 98), 6) AS score, coalesce(bool_or(metric >= 98), false) AS met_target FROM ladder GROUP BY asset_id""")
def q5(spark, sf):
    return Q.search_quality(ladder(spark, sf), 98.0).withColumn("score", F.round("score", 6))


@query("q6_search_under_size", L + """SELECT asset_id, coalesce(max(q) FILTER (WHERE bytes <= 300), 1) AS quality,
    coalesce(arg_max(bytes, q) FILTER (WHERE bytes <= 300), arg_min(bytes, q)) AS bytes, bool_or(bytes <= 300) AS met_target FROM ladder GROUP BY asset_id""")
def q6(spark, sf):
    return Q.search_under_size(ladder(spark, sf), 300)


ROUGH = """rough AS (SELECT asset_id, q, avg_q + q / 4.0::DOUBLE AS metric, bytes FROM (SELECT l_suppkey AS asset_id, l_partkey % 100 + 1 AS q,
   avg(l_quantity) AS avg_q, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL))"""


def rough_ladder(spark, sf):
    """Non-monotone ladders: one per supplier, with gaps."""
    q = (F.col("l_partkey") % 100 + 1).cast("int")
    return (I.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("asset_id"), q.alias("q"))
            .agg(F.avg("l_quantity").alias("m"), F.sum("l_quantity").cast("bigint").alias("bytes"))
            .select("asset_id", "q", (F.col("m") + F.col("q") / 4.0).alias("metric"), "bytes"))


def bisect_sql(src: str, value: str, test: str, lower: bool) -> str:
    go = "ok" if lower else "NOT ok"
    fallback = 100 if lower else 1
    return f"""search AS (WITH RECURSIVE st AS (
   SELECT DISTINCT asset_id, 1 AS lo, 100 AS hi, CAST(NULL AS BIGINT) AS best, CAST(NULL AS DOUBLE) AS best_m, 100 AS last_q,
     CAST(NULL AS DOUBLE) AS last_m, 0 AS iters, false AS done FROM {src}
   UNION ALL SELECT asset_id, CASE WHEN go OR stop THEN lo ELSE mid + 1 END, CASE WHEN go AND NOT stop THEN mid - 1 ELSE hi END,
     CASE WHEN ok THEN mid ELSE best END, CASE WHEN ok THEN m ELSE best_m END, mid, m, iters + 1, stop FROM (
     SELECT *, CASE WHEN go THEN mid = 1 ELSE mid = 100 END AS stop FROM (SELECT *, {go} AS go FROM (
     SELECT s.*, s.lo + (s.hi - s.lo) // 2 AS mid, r.m, coalesce({test}, false) AS ok FROM st s LEFT JOIN
     (SELECT asset_id AS ra, q AS rq, CAST({value} AS DOUBLE) AS m FROM {src}) r ON r.ra = s.asset_id AND r.rq = s.lo + (s.hi - s.lo) // 2
     WHERE NOT s.done AND s.lo <= s.hi AND s.iters < 8))))
   SELECT asset_id, coalesce(best, {fallback}) AS quality, round(CASE WHEN best IS NOT NULL THEN best_m WHEN last_q = {fallback} THEN last_m END, 6) AS score,
     iters AS iterations, best IS NOT NULL AS met_target FROM st QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY iters DESC) = 1)"""


@query("q7_bisect_quality", ctes(ROUGH, bisect_sql("rough", "metric", "r.m >= 46.0", True)) + "SELECT * FROM search")
def q7(spark, sf):
    return Q.bisect(rough_ladder(spark, sf), lambda m: m >= 46.0, True).withColumn("score", F.round("score", 6))


@query("q7_bisect_size", ctes(ROUGH, bisect_sql("rough", "bytes", "r.m <= 150", False)) + "SELECT * FROM search")
def q7_size(spark, sf):
    return Q.bisect(rough_ladder(spark, sf), lambda m: m <= 150, False, "bytes").withColumn("score", F.round("score", 6))


@query("q8_fit_under_size", ctes(PX, H, LADDER) + """, want AS (SELECT asset_id, asset_id % 3 <> 0 AS lossy, 60 + asset_id * 17 AS budget FROM total),
    scale AS (SELECT asset_id, s.pct, CAST(ceil(bytes * s.pct * s.pct / 10000.0::DOUBLE) AS BIGINT) AS bytes FROM ladder JOIN want USING (asset_id),
      (SELECT unnest(range(1, 101)) AS pct) s WHERE q = CASE WHEN lossy THEN 1 ELSE 100 END),
    bq AS (SELECT asset_id, max(q) FILTER (WHERE bytes <= budget) AS q, arg_max(bytes, q) FILTER (WHERE bytes <= budget) AS b FROM ladder JOIN want USING (asset_id) GROUP BY asset_id),
    bs AS (SELECT asset_id, max(pct) FILTER (WHERE bytes <= budget) AS p, coalesce(arg_max(bytes, pct) FILTER (WHERE bytes <= budget), arg_min(bytes, pct)) AS b FROM scale JOIN want USING (asset_id) GROUP BY asset_id)
    SELECT asset_id, CASE WHEN lossy THEN coalesce(bq.q, 1) END AS quality, CASE WHEN lossy AND bq.q IS NOT NULL THEN 100 ELSE coalesce(p, 1) END AS scale_percent,
    CASE WHEN lossy AND bq.q IS NOT NULL THEN bq.b ELSE bs.b END AS bytes, (lossy AND bq.q IS NOT NULL) OR p IS NOT NULL AS met_budget
    FROM want JOIN bq USING (asset_id) JOIN bs USING (asset_id)""")
def q8(spark, sf):
    rungs = ladder(spark, sf).withColumns({"lossy": F.col("asset_id") % 3 != 0, "budget": F.col("asset_id") * 17 + 60})
    scaled = lambda size, pct: F.ceil(size * pct * pct / 10000.0)
    return Q.fit_under_size(Q.fit_ladder(rungs, F.col("lossy"), scaled))


@query("q9_target_presets", """SELECT o_orderkey AS asset_id, CASE o_orderstatus WHEN 'F' THEN 90.0 WHEN 'O' THEN 70.0 ELSE 50.0 END::DOUBLE AS target FROM orders""")
def q9(spark, sf):
    name = F.expr("case o_orderstatus when 'F' then 'visually-lossless' when 'O' then 'high' else 'medium' end")
    return I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("asset_id"), Q.target_preset(name).alias("target"))


WSCORE = "wscores AS (SELECT o_orderkey AS asset_id, CASE WHEN o_custkey % 10 = 0 THEN 'nan'::DOUBLE ELSE 60 + o_totalprice / 12500.0 END AS score FROM orders)"


@query("q10_score_winner", ctes(CD, PICK, WSCORE) + """SELECT asset_id, round(v, 6) AS verify_score, CASE WHEN v IS NOT NULL AND source_depth > 8
    AND fmt IN ('jpeg','avif','webp','bmp') THEN source_depth END AS scored_source_depth FROM (
    SELECT *, CASE WHEN disposition = 'lossy' AND NOT isnan(score) THEN score END AS v FROM picked JOIN wscores USING (asset_id))""")
def q10(spark, sf):
    sc = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("asset_id"),
        F.when(F.col("o_custkey") % 10 == 0, F.lit(float("nan"))).otherwise(60 + F.col("o_totalprice") / 12500.0).alias("score"))
    return Q.score_winner(picked(spark, sf), sc).select("asset_id", F.round("verify_score", 6).alias("verify_score"), "scored_source_depth")


@query("q11_format_capability", ctes(CD) + """SELECT asset_id, cand_idx, fmt = 'jpeg' OR (fmt = 'avif' AND bytes % 2 = 0) OR (fmt = 'webp' AND bytes % 3 = 0) AS size_search,
    fmt = 'jpeg' OR (fmt = 'webp' AND bytes % 3 = 0) AS perceptual_search FROM cands""")
def q11(spark, sf):
    avif, webp = F.col("bytes") % 2 == 0, F.col("bytes") % 3 == 0
    return I.candidates(spark, sf).select(
        "asset_id", "cand_idx", Q.size_search_capable(F.col("fmt"), webp, avif).alias("size_search"),
        Q.perceptual_search_capable(F.col("fmt"), webp).alias("perceptual_search"))


@query("q12_mode_exclusive", """SELECT asset_id, CASE WHEN (t IS NOT NULL)::INT + (s IS NOT NULL)::INT + (m IS NOT NULL)::INT > 1 THEN NULL
    WHEN m IS NOT NULL THEN 'size-budget' WHEN t IS NOT NULL OR s IS NOT NULL THEN 'perceptual' ELSE 'fast' END AS mode FROM (
    SELECT o_orderkey AS asset_id, CASE WHEN o_orderkey % 3 = 0 THEN 'high' END AS t, CASE WHEN o_custkey % 4 = 0 THEN 80 END AS s,
    CASE WHEN o_orderstatus = 'F' THEN 1000 END AS m FROM orders)""")
def q12(spark, sf):
    goal = lambda test, v: F.when(F.expr(test), F.lit(v))
    return I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("asset_id"), Q.request_mode(
        goal("o_orderkey % 3 = 0", "high"), goal("o_custkey % 4 = 0", 80), goal("o_orderstatus = 'F'", 1000)).alias("mode"))
