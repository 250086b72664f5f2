"""Operator inputs derived from the given tables.

Each input exists twice, as a DataFrame and as a DuckDB CTE of the same name,
and both always cover whole tables: columns are derived, rows are never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import collect_scanlines

E = F.expr


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One given table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ctes(*parts: str) -> str:
    """WITH clause from named CTE bodies."""
    return "WITH " + ",\n".join(parts) + "\n"


# --- rasters: 16 rows of 64 values form one 32x32 mosaic ---------------------
SIDE = 32


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Pixel rows of the embedding mosaics; even assets are grey, odd ones coloured."""
    base = table(spark, sf, "embeddings").select(
        E("vec_id div 16").alias("asset_id"), E("cast(vec_id % 16 as int)").alias("t"),
        F.col("embedding").cast("array<double>").alias("e"))
    cells = base.select("asset_id", "t", "e", F.posexplode("e").alias("i", "v"))
    sample = lambda v: F.least(F.greatest(F.floor((v + 1.0) * 127.5 + 0.5), F.lit(0)), F.lit(255)).cast("int")
    step = E("cast(shiftleft(1, cast(asset_id % 8 as int)) as int)")
    q = (F.floor(sample(F.col("v")) / step) * step).cast("int")
    nxt = sample(F.get(F.col("e"), (F.col("i") + 1) % 64))
    g = F.when(F.col("asset_id") % 2 == 0, q).otherwise(nxt)
    return cells.select(
        "asset_id", F.lit(SIDE).alias("w"), F.lit(SIDE).alias("h"),
        E("cast((t % 4) * 8 + i % 8 as int)").alias("x"),
        E("cast((t div 4) * 8 + i div 8 as int)").alias("y"),
        q.alias("r"), g.alias("g"), q.alias("b"), F.lit(255).alias("a"))


def alpha_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """The mosaics with a varying alpha channel: rows below 8 transparent, then translucent."""
    a = F.when(F.col("y") < 8, 0).when(F.col("y") < 16, F.col("r")).otherwise(255)
    return pixels(spark, sf).withColumn("a", F.when(F.col("asset_id") % 4 == 1, a).otherwise(255).cast("int"))


PX = """cells AS (
  SELECT vec_id // 16 AS asset_id, vec_id % 16 AS t, i,
         CAST(embedding[i + 1] AS DOUBLE) AS v, CAST(embedding[(i + 1) % 64 + 1] AS DOUBLE) AS v2
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)),
samples AS (
  SELECT asset_id, t, i, CAST(1 << (asset_id % 8)::INT AS BIGINT) AS k,
         CAST(least(greatest(floor((v + 1.0) * 127.5 + 0.5), 0), 255) AS BIGINT) AS s,
         CAST(least(greatest(floor((v2 + 1.0) * 127.5 + 0.5), 0), 255) AS BIGINT) AS s2 FROM cells),
px AS (
  SELECT asset_id, 32 AS w, 32 AS h, (t % 4) * 8 + i % 8 AS x, (t // 4) * 8 + i // 8 AS y,
         (s // k) * k AS r, CASE WHEN asset_id % 2 = 0 THEN (s // k) * k ELSE s2 END AS g,
         (s // k) * k AS b, 255 AS a FROM samples)"""
APX = """apx AS (
  SELECT asset_id, w, h, x, y, r, g, b, CASE WHEN asset_id % 4 = 1 THEN
         CASE WHEN y < 8 THEN 0 WHEN y < 16 THEN r ELSE 255 END ELSE 255 END AS a FROM px)"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Scanlines of the mosaics."""
    return collect_scanlines(pixels(spark, sf))


def raster_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Declared facts of each mosaic."""
    ids = table(spark, sf, "embeddings").select(E("vec_id div 16").alias("asset_id")).distinct()
    edge = F.when(F.col("asset_id") % 3 == 0, 64).otherwise(512)
    return ids.select(
        "asset_id", edge.alias("width"), edge.alias("height"),
        (F.col("asset_id") % 5 == 0).alias("has_exif"),
        F.when(F.col("asset_id") % 7 == 3, "ico").otherwise("png").alias("source_format"),
        E("cast(1 + asset_id % 8 as int)").alias("orientation"),
        (F.col("asset_id") % 2 == 0).alias("source_gray"), (F.col("asset_id") % 3 == 1).alias("source_alpha"))


RFACTS = """rfacts AS (
  SELECT DISTINCT vec_id // 16 AS asset_id, CASE WHEN (vec_id // 16) % 3 = 0 THEN 64 ELSE 512 END AS width,
         CASE WHEN (vec_id // 16) % 3 = 0 THEN 64 ELSE 512 END AS height,
         (vec_id // 16) % 5 = 0 AS has_exif,
         CASE WHEN (vec_id // 16) % 7 = 3 THEN 'ico' ELSE 'png' END AS source_format,
         CAST(1 + (vec_id // 16) % 8 AS INT) AS orientation,
         (vec_id // 16) % 2 = 0 AS source_gray, (vec_id // 16) % 3 = 1 AS source_alpha FROM embeddings)"""


# --- assets: one per document ------------------------------------------------
def assets(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus rows with mixed-case extensions and colliding stems."""
    return assets_from(table(spark, sf, "documents"))


def assets_from(documents: DataFrame) -> DataFrame:
    """The same columns from any frame of documents, batch or stream."""
    ext = E("element_at(array('jpg','PNG','webp','txt','gif'), cast(doc_id % 5 as int) + 1)")
    return documents.select(
        F.col("doc_id").alias("asset_id"),
        F.concat(F.lit("assets/"), "source", F.lit("/"), "lang", F.lit("/d"), E("doc_id % 700"),
                 F.lit("-"), E("doc_id div 700"), F.lit("."), ext).alias("path"),
        ext.alias("ext"), "lang", "source", F.octet_length("text").cast("bigint").alias("bytes"),
        F.col("text").alias("content"))


AS = """assets AS (
  SELECT doc_id AS asset_id, 'assets/' || source || '/' || lang || '/d' || (doc_id % 700) || '-' ||
         (doc_id // 700) || '.' || (['jpg','PNG','webp','txt','gif'])[(doc_id % 5) + 1] AS path,
         (['jpg','PNG','webp','txt','gif'])[(doc_id % 5) + 1] AS ext, lang, source,
         CAST(strlen(text) AS BIGINT) AS bytes, text AS content FROM documents)"""


def asset_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Everything the lint rules read, per asset."""
    return facts_from(table(spark, sf, "documents"))


def facts_from(documents: DataFrame) -> DataFrame:
    """The same columns from any frame of documents, batch or stream."""
    i = F.col("asset_id")
    return assets_from(documents).select(
        "asset_id", "path", "ext", "lang", "source", "bytes",
        F.when(F.lower("ext") == "jpg", "jpeg").otherwise(F.lower("ext")).alias("format"),
        E("cast(16 + bytes % 4000 as int)").alias("width"), E("cast(16 + bytes % 3000 as int)").alias("height"),
        F.when(i % 13 == 0, 16).otherwise(8).alias("bit_depth"),
        F.when(i % 10 == 5, 4).otherwise(3).alias("components"),
        E("case asset_id % 17 when 3 then 'corrupt' when 5 then 'codec-not-built' "
          "when 7 then 'over-limit' else 'ok' end").alias("decode_status"),
        (i % 6 == 1).alias("has_gps"), (i % 4 == 2).alias("has_camera"),
        E("case when asset_id % 9 < 8 then cast(1 + asset_id % 9 as int) end").alias("orientation"),
        E("case when asset_id % 3 = 0 then bytes end").alias("icc_bytes"),
        (i % 8 == 4).alias("animated"), E("cast(bytes * (40 + asset_id % 80) / 100 as bigint)").alias("best_bytes"))


AF = """afacts AS (
  SELECT asset_id, path, ext, lang, source, bytes,
         CASE WHEN lower(ext) = 'jpg' THEN 'jpeg' ELSE lower(ext) END AS format,
         16 + bytes % 4000 AS width, 16 + bytes % 3000 AS height,
         CASE WHEN asset_id % 13 = 0 THEN 16 ELSE 8 END AS bit_depth,
         CASE WHEN asset_id % 10 = 5 THEN 4 ELSE 3 END AS components,
         CASE asset_id % 17 WHEN 3 THEN 'corrupt' WHEN 5 THEN 'codec-not-built' WHEN 7 THEN 'over-limit'
              ELSE 'ok' END AS decode_status,
         asset_id % 6 = 1 AS has_gps, asset_id % 4 = 2 AS has_camera,
         CASE WHEN asset_id % 9 < 8 THEN 1 + asset_id % 9 END AS orientation,
         CASE WHEN asset_id % 3 = 0 THEN bytes END AS icc_bytes, asset_id % 8 = 4 AS animated,
         CAST(trunc(bytes * (40 + asset_id % 80) / 100.0) AS BIGINT) AS best_bytes FROM assets)"""


# --- candidates: one per (order, format, disposition) ------------------------
def sources(spark: SparkSession, sf: str) -> DataFrame:
    """One source per order."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("asset_id"),
        F.round(F.col("o_totalprice") / 5).cast("bigint").alias("source_bytes"),
        E("case o_orderstatus when 'F' then 'jpeg' when 'O' then 'png' else 'webp' end").alias("source_format"),
        (F.col("o_orderkey") % 3 == 0).alias("altered"), (F.col("o_orderkey") % 11 == 0).alias("has_alpha"),
        F.when(F.col("o_orderkey") % 6 == 0, 16).otherwise(8).alias("source_depth"),
        E("element_at(array('fast','perceptual','size-budget'), cast(o_custkey % 3 as int) + 1)").alias("mode"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Cheapest trial per (asset, format, disposition): at most four rows per asset."""
    trials = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"),
        E("case l_returnflag when 'A' then 'avif' when 'N' then 'webp' else 'jpeg' end").alias("fmt"),
        E("case when l_returnflag = 'N' and l_linestatus = 'O' then 'lossless' else 'lossy' end").alias("disposition"),
        F.round("l_extendedprice").cast("bigint").alias("bytes"),
        E("cast(l_quantity * 2 as int)").alias("q"), (F.col("l_discount") <= 0.08).alias("met"))
    # (bytes, q, met) packed in one long: the minimum stays a hash aggregate without a sort
    packed = (F.col("bytes") * 1000 + F.col("q")) * 2 + F.col("met").cast("int")
    best = trials.groupBy("asset_id", "fmt", "disposition").agg(F.min(packed).alias("m"))
    idx = E("case fmt when 'avif' then 0 when 'webp' then if(disposition = 'lossy', 1, 2) else 3 end")
    return best.select("asset_id", idx.alias("cand_idx"), "fmt", "disposition",
                       E("if(disposition = 'lossy', cast(m div 2 % 1000 as int), null)").alias("quality"),
                       E("m div 2000").alias("bytes"), E("m % 2 = 1").alias("met_target"))


CD = """sources AS (
  SELECT o_orderkey AS asset_id, CAST(round(o_totalprice / 5) AS BIGINT) AS source_bytes,
         CASE o_orderstatus WHEN 'F' THEN 'jpeg' WHEN 'O' THEN 'png' ELSE 'webp' END AS source_format,
         o_orderkey % 3 = 0 AS altered, o_orderkey % 11 = 0 AS has_alpha,
         CASE WHEN o_orderkey % 6 = 0 THEN 16 ELSE 8 END AS source_depth,
         (['fast','perceptual','size-budget'])[o_custkey % 3 + 1] AS mode FROM orders),
trials AS (
  SELECT l_orderkey AS asset_id,
         CASE l_returnflag WHEN 'A' THEN 'avif' WHEN 'N' THEN 'webp' ELSE 'jpeg' END AS fmt,
         CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'lossless' ELSE 'lossy' END AS disposition,
         CAST(round(l_extendedprice) AS BIGINT) AS bytes, CAST(l_quantity * 2 AS BIGINT) AS q,
         l_discount <= 0.08 AS met FROM lineitem),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY asset_id, fmt, disposition ORDER BY bytes, q, met) AS rn FROM trials),
cands AS (
  SELECT asset_id, CASE fmt WHEN 'avif' THEN 0 WHEN 'webp' THEN CASE WHEN disposition = 'lossy' THEN 1 ELSE 2 END
         ELSE 3 END AS cand_idx, fmt, disposition, CASE WHEN disposition = 'lossy' THEN q END AS quality,
         bytes, met AS met_target FROM ranked WHERE rn = 1)"""


# --- tags --------------------------------------------------------------------
def tags(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as metadata tags."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("asset_id"),
        E("case role when 'user' then 'PRIMARY' when 'assistant' then 'EXIF' else 'GPS' end").alias("ifd"),
        F.col("turn").alias("tag"), F.col("text").alias("value"))


TG = """tags AS (
  SELECT conv_id AS asset_id, CASE role WHEN 'user' THEN 'PRIMARY' WHEN 'assistant' THEN 'EXIF' ELSE 'GPS' END AS ifd,
         turn AS tag, text AS value FROM conversations)"""


def coded_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The same turns under real tag numbers, several of which matter to rules."""
    code = E("element_at(array(270, 271, 274, 305, 315, 33432, 36867, 42036), cast(tag % 8 as int) + 1)")
    value = F.when(code == 274, E("cast(1 + asset_id % 8 as string)")).otherwise(F.col("value"))
    return tags(spark, sf).select("asset_id", "ifd", code.cast("bigint").alias("tag"), value.alias("value"))


CTG = """ctags AS (
  SELECT asset_id, ifd, tag, CASE WHEN tag = 274 THEN CAST(1 + asset_id % 8 AS VARCHAR) ELSE value END AS value
  FROM (SELECT asset_id, ifd, value,
        CAST(([270, 271, 274, 305, 315, 33432, 36867, 42036])[tag % 8 + 1] AS BIGINT) AS tag FROM tags))"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Container segments: lineitems of an order stand for the segments of a file."""
    kind_j = E("element_at(array('APP0','APP1','APP2','APP11','COM','DQT','SOF0','SOS'), cast(l_suppkey % 8 as int) + 1)")
    kind_p = E("element_at(array('IHDR','eXIf','iCCP','caBX','tEXt','IDAT','tRNS','IEND'), cast(l_suppkey % 8 as int) + 1)")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").cast("bigint").alias("seg_idx"),
        F.when(F.col("l_orderkey") % 2 == 0, "jpeg").otherwise("png").alias("fmt"),
        F.when(F.col("l_orderkey") % 2 == 0, kind_j).otherwise(kind_p).alias("kind"),
        F.round("l_extendedprice").cast("bigint").alias("length"))


SEG = """segs AS (
  SELECT l_orderkey AS asset_id, CAST(l_linenumber AS BIGINT) AS seg_idx,
         CASE WHEN l_orderkey % 2 = 0 THEN 'jpeg' ELSE 'png' END AS fmt,
         CASE WHEN l_orderkey % 2 = 0
              THEN (['APP0','APP1','APP2','APP11','COM','DQT','SOF0','SOS'])[l_suppkey % 8 + 1]
              ELSE (['IHDR','eXIf','iCCP','caBX','tEXt','IDAT','tRNS','IEND'])[l_suppkey % 8 + 1] END AS kind,
         CAST(round(l_extendedprice) AS BIGINT) AS length FROM lineitem)"""


# --- lock snapshots ----------------------------------------------------------
def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def lock_committed(spark: SparkSession, sf: str) -> DataFrame:
    """Lock of every document as first built."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("dist/"), "source", F.lit("/d"), "doc_id", F.lit(".webp")).alias("path"),
        "source", F.lit("web").alias("recipe"), F.sha2("text", 256).alias("key"), F.md5("text").alias("hash"),
        F.octet_length("text").cast("bigint").alias("bytes"))


def lock_current(spark: SparkSession, sf: str) -> DataFrame:
    """Rebuilt lock: toxic documents moved, poor ones re-keyed, German ones re-encoded."""
    moved = F.when(F.col("toxic") == 1, F.lit("dist/held/d")).otherwise(
        F.concat(F.lit("dist/"), "source", F.lit("/d")))
    return _labelled(spark, sf).select(
        F.concat(moved, "doc_id", F.lit(".webp")).alias("path"), "source", F.lit("web").alias("recipe"),
        F.sha2(F.when(F.col("quality") == 0, F.concat(F.lit("v2:"), "text")).otherwise(F.col("text")), 256).alias("key"),
        F.md5(F.when(F.col("lang") == "de", F.concat(F.lit("m2:"), "text")).otherwise(F.col("text"))).alias("hash"),
        F.octet_length("text").cast("bigint").alias("bytes"))


LK = """committed AS (
  SELECT 'dist/' || source || '/d' || doc_id || '.webp' AS path, source, 'web' AS recipe, sha256(text) AS key,
         md5(text) AS hash, CAST(strlen(text) AS BIGINT) AS bytes FROM documents),
current_lock AS (
  SELECT CASE WHEN toxic = 1 THEN 'dist/held/d' ELSE 'dist/' || source || '/d' END || doc_id || '.webp' AS path,
         source, 'web' AS recipe, sha256(CASE WHEN quality = 0 THEN 'v2:' || text ELSE text END) AS key,
         md5(CASE WHEN lang = 'de' THEN 'm2:' || text ELSE text END) AS hash,
         CAST(strlen(text) AS BIGINT) AS bytes FROM documents LEFT JOIN labels USING (doc_id))"""


# --- changes -----------------------------------------------------------------
def change_columns() -> list[Column]:
    """Projection from raw events to changes (used by batch and stream alike)."""
    return [F.concat(F.lit("src/u"), "user_id", F.lit("/"), "event_type").alias("path"),
            F.col("ts").cast("timestamp").alias("event_time"), F.col("user_id"), F.col("event_type"),
            F.col("value")]


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """File changes."""
    return table(spark, sf, "events").select(*change_columns())


EV = """changes AS (
  SELECT 'src/u' || user_id || '/' || event_type AS path, ts AS event_time, user_id, event_type, value FROM events)"""


# --- benchmark runs ----------------------------------------------------------
def bench_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as images, lineitems as runs of five tools over them."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    runs = table(spark, sf, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    return runs.select(
        F.col("l_partkey").alias("image"), F.col("p_size").cast("double").alias("mp"),
        E("concat('tool', l_suppkey % 5)").alias("tool"), F.col("l_quantity").alias("q"),
        (60.0 + 0.8 * F.col("l_quantity")).alias("score"), F.round("l_extendedprice").cast("bigint").alias("bytes"),
        F.round(F.col("p_retailprice") * 1000).cast("bigint").alias("source_bytes"),
        (F.col("l_discount") * 1000.0 + F.col("l_linenumber") * 10.0).alias("ms"),
        (F.col("l_linenumber") - 1).cast("bigint").alias("run_idx"))


BN = """runs AS (
  SELECT l_partkey AS image, CAST(p_size AS DOUBLE) AS mp, 'tool' || (l_suppkey % 5) AS tool, l_quantity AS q,
         60.0::DOUBLE + 0.8::DOUBLE * l_quantity AS score, CAST(round(l_extendedprice) AS BIGINT) AS bytes,
         CAST(round(p_retailprice * 1000) AS BIGINT) AS source_bytes,
         l_discount * 1000.0::DOUBLE + l_linenumber * 10.0::DOUBLE AS ms, CAST(l_linenumber - 1 AS BIGINT) AS run_idx
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


# --- sizes: declared dimensions derived from lineitems -----------------------
def dims(spark: SparkSession, sf: str) -> DataFrame:
    """Width and height of every lineitem, some beyond every limit."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        E("cast(l_extendedprice as bigint)").alias("w"), E("cast(l_quantity * 40 + l_suppkey % 97 + 1 as bigint)").alias("h"))


DIM = """dims AS (
  SELECT l_orderkey AS asset_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id,
         CAST(trunc(l_extendedprice) AS BIGINT) AS w, CAST(l_quantity * 40 + l_suppkey % 97 + 1 AS BIGINT) AS h
  FROM lineitem)"""
