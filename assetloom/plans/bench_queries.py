"""Benchmark-summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import benchstats as K
from ..operators import decide as D
from ..operators import raster as R
from . import inputs as I
from .decide_queries import PICK, SAVE, picked as winners
from .inputs import BN, CD, DIM, PX, ctes
from .raster_queries import _lin, resample_ctes
from .registry import query

E = F.expr
TOOLS = [f"tool{i}" for i in range(5)]
ISO = """iso AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY image, tool ORDER BY abs(score - 82), bytes, q, mp, score, source_bytes, ms, run_idx) = 1)"""
BUCKET = "CASE WHEN mp < 2 THEN 'small' WHEN mp < 12 THEN 'medium' ELSE 'large' END"


def iso(spark, sf):
    return K.iso_quality(I.bench_runs(spark, sf))


@query("k1_iso_quality", ctes(BN, ISO) + "SELECT image, tool, q, bytes, round(score, 6) AS score, round(ms, 6) AS ms FROM iso")
def k1(spark, sf):
    return iso(spark, sf).select("image", "tool", "q", "bytes", F.round("score", 6).alias("score"), F.round("ms", 6).alias("ms"))


@query("k2_mp_bucket", f"SELECT p_partkey AS image, {BUCKET} AS bucket FROM (SELECT *, p_size AS mp FROM part)")
def k2(spark, sf):
    return I.table(spark, sf, "part").select(F.col("p_partkey").alias("image"), K.mp_bucket(F.col("p_size").cast("double")).alias("bucket"))


@query("k3_bucket_medians", ctes(BN, ISO) + f"""SELECT {BUCKET} AS bucket, tool, count(*) AS images, round(median(score), 6) AS score, round(median(bytes::DOUBLE), 6) AS bytes,
    round(median(1.0::DOUBLE - bytes::DOUBLE / source_bytes), 6) AS saved, round(median(ms), 6) AS ms FROM iso GROUP BY ALL""")
def k3(spark, sf):
    return K.bucket_medians(iso(spark, sf)).withColumns({c: F.round(c, 6) for c in ("score", "bytes", "saved", "ms")})


@query("k4_median_time", ctes(BN) + "SELECT image, tool, round(median(ms), 6) AS median_ms FROM runs WHERE run_idx >= 1 GROUP BY image, tool")
def k4(spark, sf):
    return K.median_time(I.bench_runs(spark, sf)).withColumn("median_ms", F.round("median_ms", 6))


@query("k4_exact_quantiles", """SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY l_returnflag""")
def k4_quantile(spark, sf):
    rows = I.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return K.exact_quantile(rows, ["flag"], "l_extendedprice", 0.9, "p90").withColumn("p90", F.round("p90", 6))


NARROW = "1.7e9::DOUBLE + l_partkey + l_extendedprice / 1000000"


@query("k4_narrow_quantile", f"""SELECT l_returnflag AS flag, round(quantile_cont(CASE WHEN l_orderkey % 9 = 0 THEN 'nan'::DOUBLE ELSE {NARROW} END, 0.5), 4) AS p50
    FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_returnflag""")
def k4_narrow(spark, sf):
    """Values within a ten-thousandth of each other, and NaN above them."""
    v = E("if(l_orderkey % 9 = 0, double('NaN'), 1.7e9D + l_partkey + l_extendedprice / 1000000)")
    rows = I.table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_returnflag").alias("flag"), v.alias("v"))
    return K.exact_quantile(rows, ["flag"], "v", 0.5, "p50").withColumn("p50", F.round("p50", 4))


@query("k5_savings_table", ctes(BN, ISO) + "SELECT image, tool, round(1.0::DOUBLE - bytes::DOUBLE / source_bytes, 6) AS saved FROM iso")
def k5(spark, sf):
    return K.savings_table(iso(spark, sf)).select("image", "tool", F.round("saved", 6).alias("saved"))


@query("k6_smallest_per_image", ctes(BN, ISO) + "SELECT image, tool, bytes FROM iso QUALIFY rank() OVER (PARTITION BY image ORDER BY bytes) = 1")
def k6(spark, sf):
    return K.smallest_per_image(iso(spark, sf))


@query("k6_win_counts", ctes(BN, ISO) + "SELECT tool, count(*) AS wins FROM (SELECT tool FROM iso QUALIFY rank() OVER (PARTITION BY image ORDER BY bytes) = 1) GROUP BY tool")
def k6_wins(spark, sf):
    return K.win_counts(iso(spark, sf))


@query("k7_ratio_to_best", ctes(BN, ISO) + "SELECT image, tool, bytes, round(bytes::DOUBLE / min(bytes) OVER (PARTITION BY image), 6) AS ratio FROM iso")
def k7(spark, sf):
    return K.ratio_to_best(iso(spark, sf)).withColumn("ratio", F.round("ratio", 6))


GUARD = """outs AS (SELECT *, 2048 AS cap, CASE WHEN part_id % 40 = 0 THEN 0 ELSE CAST(round(w * least(1.0, 2048.0::DOUBLE / greatest(w, h))) AS BIGINT) + supp_id % 4 END AS out_w,
  CAST(round(h * least(1.0, 2048.0::DOUBLE / greatest(w, h))) AS BIGINT) + part_id % 3 AS out_h FROM dims)"""


@query("k8_dim_guard", ctes(DIM, GUARD) + """SELECT asset_id, line, part_id, supp_id, CASE WHEN out_w * out_h = 0 THEN 'output dimensions unreadable'
    WHEN abs(greatest(out_w, out_h) - least(cap, greatest(w, h))) > 1 THEN 'long edge'
    WHEN abs(greatest(out_w, out_h)::DOUBLE / least(out_w, out_h) - greatest(w, h)::DOUBLE / least(w, h)) / (greatest(w, h)::DOUBLE / least(w, h)) > 0.01 THEN 'aspect' END AS reason FROM outs""")
def k8(spark, sf):
    s = F.least(F.lit(1.0), 2048.0 / F.greatest("w", "h"))
    rows = I.dims(spark, sf).withColumns({
        "cap": F.lit(2048), "src_w": F.col("w"), "src_h": F.col("h"),
        "out_w": F.when(F.col("part_id") % 40 == 0, 0).otherwise(F.round(F.col("w") * s).cast("bigint") + F.col("supp_id") % 4),
        "out_h": F.round(F.col("h") * s).cast("bigint") + F.col("part_id") % 3})
    return K.dim_guard(rows).select("asset_id", "line", "part_id", "supp_id", "reason")


@query("k9_operating_point_guard", ctes(BN, ISO) + """, c AS (SELECT image, tool, bytes, image % 4 AS a, CASE WHEN image % 6 <> 5 THEN 85 END AS eq, CASE WHEN image % 6 <> 5 THEN 'avif' END AS ef,
    mp >= 4 AS seen, CASE WHEN bytes % 5 = 0 THEN 80 ELSE 85 END AS gq, CASE WHEN bytes % 8 = 0 THEN 'webp' ELSE 'avif' END AS gf, CASE WHEN bytes % 9 = 0 THEN bytes + 1 ELSE bytes END AS gb FROM iso)
    SELECT image, tool, CASE WHEN eq IS NULL THEN '' ELSE concat_ws(';', CASE a WHEN 1 THEN 'pins the format: -o x.AVIF' WHEN 2 THEN 'pins the format: --format webp' WHEN 3 THEN 'pins the format: --format avif' END,
    CASE WHEN NOT seen THEN 'operating point not observed' END, CASE WHEN seen AND gq <> eq THEN 'quality differs' END, CASE WHEN seen AND gf <> ef THEN 'format differs' END,
    CASE WHEN seen AND gb <> bytes THEN 'bytes differ' END) END AS reasons FROM c""")
def k9(spark, sf):
    claims = iso(spark, sf).select(
        "image", "tool", "bytes", E("case image % 4 when 0 then array('web', 'in.png', '-o', '-') when 1 then array('web', '-o', 'out/x.AVIF') "
                                    "when 2 then array('web', '--format=webp') else array('--format', 'avif', '--output', 'y.png') end").alias("args"),
        E("case when image % 6 <> 5 then 85 end").alias("expect_quality"), E("case when image % 6 <> 5 then 'avif' end").alias("expect_format"))
    observed = iso(spark, sf).where("mp >= 4").select(
        "image", "tool", E("if(bytes % 5 = 0, 80, 85)").alias("got_quality"), E("if(bytes % 8 = 0, 'webp', 'avif')").alias("got_format"),
        E("if(bytes % 9 = 0, bytes + 1, bytes)").alias("got_bytes"))
    return K.operating_point_guard(claims, observed).select("image", "tool", F.array_join("reasons", ";").alias("reasons"))


@query("k10_pivot_tools", ctes(BN, ISO) + "SELECT image, " + ", ".join(f"min(bytes) FILTER (WHERE tool = '{t}') AS {t}" for t in TOOLS) + " FROM iso GROUP BY image")
def k10(spark, sf):
    return K.pivot_tools(iso(spark, sf), TOOLS)


#: The second run holds the cells of the first but for the large images of one tool, so its columns stand beside the first's.
SECOND = """both_runs AS (SELECT *, NOT (tool = 'tool4' AND mp > 45) AS again FROM iso)"""


@query("k11_compare_runs", ctes(BN, ISO, SECOND) + """SELECT image, tool, CASE WHEN again THEN bytes % 10 <> 0 OR score IS NULL ELSE score IS NULL END AS same_score,
    CASE WHEN again THEN bytes % 6 <> 0 ELSE bytes IS NULL END AS same_bytes,
    round(CASE WHEN again AND ms <> 0 THEN 100.0 * (ms * (1.0::DOUBLE + (image % 5) / 10.0::DOUBLE) - ms) / ms END, 6) AS ms_delta_pct FROM both_runs""")
def k11(spark, sf):
    a = iso(spark, sf)
    b = a.where("not (tool = 'tool4' and mp > 45)").select(
        "image", "tool", E("if(bytes % 10 = 0, score + 1, score)").alias("score"), E("if(bytes % 6 = 0, bytes + 1, bytes)").alias("bytes"),
        (F.col("ms") * (1.0 + (F.col("image") % 5) / 10.0)).alias("ms"))
    return K.compare_runs(a, b).withColumn("ms_delta_pct", F.round("ms_delta_pct", 6))


@query("k12_audit_rows", ctes(CD, PICK) + f"""SELECT asset_id, 'optimize' AS verb, source_format, mode, source_bytes, out_bytes, {SAVE} AS savings_percent,
    (SELECT count(*) FROM cands c WHERE c.asset_id = picked.asset_id) AS n_candidates, coalesce(fmt, source_format) AS out_format, quality FROM picked""")
def k12(spark, sf):
    return K.audit_rows(D.explain(winners(spark, sf), I.candidates(spark, sf)))


@query("k13_not_run", ctes(BN, ISO) + """SELECT p_partkey AS image, t.tool, bytes, CASE WHEN bytes IS NULL THEN 'NOT RUN' ELSE 'ok' END AS status
    FROM part, (SELECT 'tool' || unnest(range(5)) AS tool) t LEFT JOIN iso ON iso.image = p_partkey AND iso.tool = t.tool""")
def k13(spark, sf):
    images = I.table(spark, sf, "part").select(F.col("p_partkey").alias("image"))
    return K.not_run(images, iso(spark, sf), TOOLS)


def _err(src: str) -> str:
    return " + ".join(f"abs(({_lin(f'a.{c}')}) - ({_lin(f'b.{c}')}))" for c in "rgb")


@query("k14_fidelity_study", ctes(PX, resample_ctes("px", "16", "16")) + f""", naive AS (SELECT asset_id, x // 2 AS x, y // 2 AS y, CAST(round(avg(r)) AS BIGINT) AS r,
    CAST(round(avg(g)) AS BIGINT) AS g, CAST(round(avg(b)) AS BIGINT) AS b FROM px GROUP BY ALL)
    SELECT a.asset_id, 'box' AS rendition, round(avg(({_err('')}) / 3.0::DOUBLE), 6) AS mean_error FROM naive a JOIN resampled b USING (asset_id, x, y) GROUP BY a.asset_id""")
def k14(spark, sf):
    px = I.pixels(spark, sf)
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    box = px.groupBy("asset_id", half("x"), half("y")).agg(*[F.round(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    out = K.fidelity_study(R.resize(px, "exact", 16, 16), box.withColumn("rendition", F.lit("box")))
    return out.withColumn("mean_error", F.round("mean_error", 6))
