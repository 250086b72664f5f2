"""Decision queries over the candidate table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as D
from . import inputs as I
from .inputs import CD, ctes
from .registry import query

REQ = """req AS (SELECT o_orderkey AS asset_id, (['lossy','lossless-flat','mixed-safe'])[o_orderkey % 3 + 1] AS bucket,
   o_orderstatus = 'F' AS has_alpha, (['web','docs','preserve'])[o_custkey % 3 + 1] AS profile,
   (['fast','perceptual','size-budget'])[o_orderkey % 5 % 3 + 1] AS mode, o_orderpriority < '3' AS webp_lossy,
   o_custkey % 4 <> 0 AS avif FROM orders),
eff AS (SELECT *, CASE WHEN profile = 'docs' AND bucket <> 'lossless-flat' THEN 'lossless-flat' ELSE bucket END AS effective FROM req)"""
SHORT = """policy(effective, alpha, pos, fmt, disposition) AS (VALUES
   ('lossy', NULL, 1, 'webp', 'lossy'), ('lossy', true, 2, 'webp', 'lossless'), ('lossy', true, 3, 'png', 'lossless'),
   ('lossy', false, 2, 'jpeg', 'lossy'), ('lossless-flat', NULL, 1, 'webp', 'lossless'), ('lossless-flat', NULL, 2, 'png', 'lossless'),
   ('mixed-safe', NULL, 1, 'webp', 'lossy'), ('mixed-safe', NULL, 2, 'webp', 'lossless'), ('mixed-safe', NULL, 3, 'png', 'lossless'),
   ('mixed-safe', false, 4, 'jpeg', 'lossy')),
hits AS (SELECT asset_id, pos, fmt, disposition FROM eff JOIN policy USING (effective)
   WHERE (alpha IS NULL OR alpha = has_alpha) AND NOT (fmt = 'webp' AND disposition = 'lossy' AND NOT webp_lossy)
   UNION ALL SELECT asset_id, CASE mode WHEN 'fast' THEN 0 ELSE 9 END, 'avif', 'lossy' FROM eff
   WHERE avif AND effective <> 'lossless-flat' AND mode <> 'perceptual'),
short AS (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY pos) - 1 AS ord, fmt, disposition FROM hits)"""


def requests(spark, sf):
    e = F.expr
    return I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("asset_id"),
        e("element_at(array('lossy','lossless-flat','mixed-safe'), cast(o_orderkey % 3 as int) + 1)").alias("bucket"),
        (F.col("o_orderstatus") == "F").alias("has_alpha"),
        e("element_at(array('web','docs','preserve'), cast(o_custkey % 3 as int) + 1)").alias("profile"),
        e("element_at(array('fast','perceptual','size-budget'), cast(o_orderkey % 5 % 3 as int) + 1)").alias("mode"),
        (F.col("o_orderpriority") < "3").alias("webp_lossy"), (F.col("o_custkey") % 4 != 0).alias("avif"))


@query("d1_effective_bucket", ctes(REQ) + "SELECT asset_id, effective FROM eff")
def d1(spark, sf):
    return requests(spark, sf).select("asset_id", D.effective_bucket(F.col("bucket"), F.col("profile")).alias("effective"))


@query("d2_avif_admissible", ctes(REQ) + "SELECT asset_id, avif AND bucket IN ('lossy', 'mixed-safe') AS admitted FROM req")
def d2(spark, sf):
    return requests(spark, sf).select("asset_id", D.avif_admissible(F.col("bucket"), F.col("avif")).alias("admitted"))


@query("d3_format_shortlist", ctes(REQ, SHORT) + "SELECT asset_id, ord, fmt, disposition FROM short")
def d3(spark, sf):
    return D.format_shortlist(requests(spark, sf)).select("asset_id", "ord", "fmt", "disposition")


@query("d3_shortlist_first", ctes(REQ, SHORT) + "SELECT asset_id, ord, fmt, disposition FROM short WHERE ord < 3")
def d3_first(spark, sf):
    return D.format_shortlist(requests(spark, sf), max_entries=3).select("asset_id", "ord", "fmt", "disposition")


@query("d3_shortlist_ranked", ctes(CD) + """SELECT asset_id, cand_idx, fmt FROM cands
    QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY cand_idx) <= 3""")
def d3_ranked(spark, sf):
    cands = I.candidates(spark, sf).withColumn("ord", F.col("cand_idx"))
    return D.shortlist_ranked(cands, ["asset_id"]).select("asset_id", "cand_idx", "fmt")


@query("d4_eligible", ctes(CD) + """SELECT asset_id, cand_idx, fmt, bytes, source_bytes FROM cands JOIN sources USING (asset_id)
    WHERE met_target AND bytes < source_bytes""")
def d4(spark, sf):
    return D.eligible(I.candidates(spark, sf), I.sources(spark, sf)).select("asset_id", "cand_idx", "fmt", "bytes", "source_bytes")


PICK = """elig AS (SELECT c.*, row_number() OVER (PARTITION BY asset_id ORDER BY bytes, cand_idx) AS rk,
     row_number() OVER (PARTITION BY asset_id, fmt = source_format ORDER BY bytes, cand_idx) AS rks, fmt = source_format AS same
   FROM cands c JOIN sources USING (asset_id) WHERE met_target AND bytes < source_bytes),
best AS (SELECT * FROM elig WHERE rk = 1), same AS (SELECT * FROM elig WHERE same AND rks = 1),
choice AS (SELECT s.*, CASE WHEN b.asset_id IS NULL THEN 'pass-through' WHEN b.fmt = source_format THEN 'same-format'
     WHEN m.asset_id IS NULL THEN 'switch-no-rival'
     WHEN (m.bytes - b.bytes)::DOUBLE / m.bytes < 0.05::DOUBLE THEN 'guard-kept' ELSE 'switch' END AS branch,
     b.cand_idx AS bi, m.cand_idx AS mi FROM sources s LEFT JOIN best b USING (asset_id) LEFT JOIN same m USING (asset_id)),
picked AS (SELECT p.*, c.cand_idx AS winner, c.fmt, c.disposition, c.quality, coalesce(c.bytes, source_bytes) AS out_bytes
   FROM choice p LEFT JOIN cands c ON c.asset_id = p.asset_id AND c.cand_idx = CASE WHEN branch = 'guard-kept' THEN mi ELSE bi END)"""
SAVE = "CASE WHEN source_bytes = 0 THEN 0 ELSE CAST(round((1.0::DOUBLE - out_bytes::DOUBLE / source_bytes) * 100) AS BIGINT) END"


def picked(spark, sf):
    return D.pick_winner(I.candidates(spark, sf), I.sources(spark, sf))


@query("d5_pick_winner", ctes(CD, PICK) + "SELECT asset_id, winner, fmt, disposition, quality, out_bytes, branch FROM picked")
def d5(spark, sf):
    return picked(spark, sf).select("asset_id", "winner", "fmt", "disposition", "quality", "out_bytes", "branch")


@query("d5_branch_counts", ctes(CD, PICK) + """SELECT branch, count(*) AS assets, CAST(sum(source_bytes) AS BIGINT) AS source_bytes,
    CAST(sum(out_bytes) AS BIGINT) AS out_bytes FROM picked GROUP BY branch""")
def d5_counts(spark, sf):
    return picked(spark, sf).groupBy("branch").agg(
        F.count(F.lit(1)).alias("assets"), F.sum("source_bytes").alias("source_bytes"), F.sum("out_bytes").alias("out_bytes"))


FORCE = """lossy AS (SELECT asset_id, bool_or(disposition = 'lossy') AS any_lossy FROM cands GROUP BY asset_id),
fb AS (SELECT asset_id, 1000 AS cand_idx, fmt, 'lossy' AS disposition, 85 AS quality, bytes FROM (
   SELECT s.*, CASE WHEN source_format = 'webp' THEN 'webp' WHEN source_format = 'jpeg' AND NOT has_alpha THEN 'jpeg' END AS fmt,
     CAST(round(source_bytes * 1.1::DOUBLE) AS BIGINT) AS bytes FROM sources s) LEFT JOIN lossy USING (asset_id)
   WHERE fmt IS NOT NULL AND NOT coalesce(any_lossy, false)),
pool AS (SELECT asset_id, cand_idx, fmt, disposition, quality, bytes FROM cands UNION ALL SELECT * FROM fb),
smallest AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY bytes, cand_idx) = 1),
forced AS (SELECT p.asset_id, p.source_bytes, p.source_format, p.mode, altered, CASE WHEN f THEN s.cand_idx ELSE winner END AS winner,
     CASE WHEN f THEN s.fmt ELSE p.fmt END AS fmt, CASE WHEN f THEN s.disposition ELSE p.disposition END AS disposition,
     CASE WHEN f THEN coalesce(s.bytes, source_bytes) ELSE out_bytes END AS out_bytes,
     CASE WHEN f AND s.asset_id IS NOT NULL THEN 'forced' ELSE branch END AS branch
   FROM (SELECT *, branch = 'pass-through' AND altered AS f FROM picked) p LEFT JOIN smallest s ON s.asset_id = p.asset_id AND f)"""


def fallback_trials(spark, sf):
    """A lossy encode of every source in its fallback format, where it has one."""
    fmt = D.fallback_format(F.col("source_format"), F.col("has_alpha"))
    return I.sources(spark, sf).select(
        "asset_id", fmt.alias("fmt"), F.lit(85).alias("quality"),
        F.round(F.col("source_bytes") * 1.1).cast("bigint").alias("bytes")).where("fmt is not null")


def forced(spark, sf):
    return D.forced_fallback(I.candidates(spark, sf), I.sources(spark, sf), fallback_trials(spark, sf))


@query("d6_forced_fallback", ctes(CD, PICK, FORCE) + "SELECT asset_id, winner, fmt, disposition, out_bytes, branch FROM forced")
def d6(spark, sf):
    return forced(spark, sf).select("asset_id", "winner", "fmt", "disposition", "out_bytes", "branch")


@query("d7_savings", ctes(CD, PICK, FORCE) + f"""SELECT asset_id, {SAVE} AS savings_percent,
    source_bytes > 0 AND out_bytes > source_bytes AS larger_than_source FROM forced""")
def d7(spark, sf):
    return D.savings(forced(spark, sf)).select("asset_id", "savings_percent", "larger_than_source")


@query("d8_report_lines", ctes(CD, PICK, FORCE) + f"""SELECT asset_id, phrase, CASE WHEN fmt IS NULL
    THEN 'kept ' || source_format || ' (' || source_bytes || ' B, nothing smaller)'
    ELSE source_format || ' → ' || fmt || ' · ' || source_bytes || ' → ' || out_bytes || ' B (' || phrase || ')' END AS summary,
    CASE WHEN fmt IS NULL AND mode = 'fast' THEN 'source stays: all candidates are as large'
    WHEN fmt IS NULL THEN 'source stays: no candidate is both good enough and smaller'
    WHEN out_bytes >= source_bytes THEN 'took the least of the sound candidates (' || fmt || '): larger than the source, which had to change anyway (tags or orientation)'
    WHEN mode = 'fast' THEN 'at the fixed quality the least below the source (' || fmt || ')'
    ELSE 'the least of those good enough and below the source (' || fmt || ')' END AS reason
    FROM (SELECT *, abs(p) || '%' || CASE WHEN p < 0 THEN ' larger' ELSE ' smaller' END AS phrase FROM (SELECT *, {SAVE} AS p FROM forced))""")
def d8(spark, sf):
    return D.report_lines(forced(spark, sf)).select("asset_id", "phrase", "summary", "reason")


@query("d9_explain", ctes(CD, PICK) + f"""SELECT asset_id, '{{"schema":"optimize.explain/v1","source_format":"' || source_format || '","mode":"' || mode ||
    '","source_bytes":' || source_bytes || ',"candidates":[' || coalesce(list, '') || ']' || coalesce(',"winner":' || winner, '') ||
    ',"out_bytes":' || out_bytes || ',"savings_percent":' || {SAVE} || '}}' AS trace
    FROM picked LEFT JOIN (SELECT asset_id, string_agg('{{"cand_idx":' || cand_idx || ',"format":"' || fmt || '","disposition":"' || disposition || '"' ||
    coalesce(',"quality":' || quality, '') || ',"bytes":' || bytes || ',"met_target":' || met_target || '}}', ',' ORDER BY cand_idx) AS list
    FROM cands GROUP BY asset_id) USING (asset_id)""")
def d9(spark, sf):
    return D.explain(picked(spark, sf), I.candidates(spark, sf))


@query("d10_never_bigger", ctes(CD) + """SELECT asset_id, cand_idx, fmt = source_format AND NOT altered AND bytes >= source_bytes AS kept_source,
    CASE WHEN fmt = source_format AND NOT altered AND bytes >= source_bytes THEN source_bytes ELSE bytes END AS shipped_bytes
    FROM cands JOIN sources USING (asset_id)""")
def d10(spark, sf):
    outs = I.candidates(spark, sf).withColumnRenamed("bytes", "out_bytes").join(I.sources(spark, sf), "asset_id")
    return D.never_bigger(outs).select("asset_id", "cand_idx", "kept_source", "shipped_bytes")


@query("d11_pinned_format", ctes(I.AS) + """SELECT asset_id, coalesce(explicit, CASE lower(ext) WHEN 'png' THEN 'png' WHEN 'jpg' THEN 'jpeg'
    WHEN 'webp' THEN 'webp' WHEN 'gif' THEN 'gif' END, 'tiff') AS fmt FROM (SELECT *, CASE WHEN bytes % 4 = 0 THEN 'avif' END AS explicit FROM assets)""")
def d11(spark, sf):
    explicit = F.when(F.col("bytes") % 4 == 0, F.lit("avif"))
    return I.assets(spark, sf).select("asset_id", D.pinned_format(explicit, F.col("path"), F.lit("tiff")).alias("fmt"))


@query("d12_fast_quality", ctes(CD) + """SELECT asset_id, cand_idx, CASE WHEN disposition <> 'lossy' THEN NULL
    WHEN verb = 'convert' AND fmt = 'avif' THEN 80 WHEN verb = 'responsive' THEN 80 ELSE 85 END AS quality
    FROM (SELECT *, (['optimize','convert','responsive'])[bytes % 3 + 1] AS verb FROM cands)""")
def d12(spark, sf):
    verb = F.expr("element_at(array('optimize','convert','responsive'), cast(bytes % 3 as int) + 1)")
    return I.candidates(spark, sf).select(
        "asset_id", "cand_idx", D.fast_quality(F.col("fmt"), F.col("disposition"), verb).alias("quality"))
