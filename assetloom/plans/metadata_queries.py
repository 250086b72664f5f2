"""Metadata queries over tag and segment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metadata as M
from . import inputs as I
from .inputs import AS, CTG, SEG, TG, ctes
from .registry import query

STRIP = """(fmt = 'jpeg' AND kind IN ('APP1','APP2','APP3','APP4','APP5','APP6','APP7','APP8','APP9','APP10','APP11','APP12','APP13','APP14','APP15','COM'))
    OR (fmt = 'png' AND kind IN ('eXIf','iCCP','tEXt','zTXt','iTXt','tIME','caBX'))"""


@query("m1_tags_nested", ctes(TG) + """SELECT asset_id, ifd, tag // 4096 AS tag_block, count(*) AS n, string_agg(tag || '=' || value, '|' ORDER BY tag) AS flat
    FROM tags GROUP BY ALL""")
def m1(spark, sf):
    flat = F.array_join(F.transform("tags", lambda t: F.concat(t["tag"].cast("string"), F.lit("="), t["value"])), "|")
    return M.tags_nested(I.tags(spark, sf)).select("asset_id", "ifd", "tag_block", F.size("tags").cast("bigint").alias("n"), flat.alias("flat"))


@query("m1_tags_long", ctes(TG) + "SELECT * FROM tags")
def m1_long(spark, sf):
    return M.tags_long(M.tags_nested(I.tags(spark, sf)))


@query("m2_strip_all", ctes(SEG) + f"SELECT asset_id, seg_idx, fmt, kind, length FROM segs WHERE NOT ({STRIP})")
def m2(spark, sf):
    return M.strip_all(I.segments(spark, sf))


@query("m3_clean_gps", ctes(TG) + "SELECT * FROM tags WHERE ifd <> 'GPS'")
def m3(spark, sf):
    return M.clean_gps(I.tags(spark, sf))


UPD = """updates AS (SELECT doc_id AS asset_id, 'PRIMARY' AS ifd, CAST(([0, 315, 33432])[doc_id % 3 + 1] AS BIGINT) AS tag, source || '/' || lang AS value FROM documents)"""


def updates(spark, sf):
    tag = F.expr("cast(element_at(array(0, 315, 33432), cast(doc_id % 3 as int) + 1) as bigint)")
    return I.table(spark, sf, "documents").select(F.col("doc_id").alias("asset_id"), F.lit("PRIMARY").alias("ifd"), tag.alias("tag"),
                                                  F.concat("source", F.lit("/"), "lang").alias("value"))


@query("m4_set_tags", ctes(TG, UPD) + """SELECT asset_id, ifd, tag, coalesce(u.value, t.value) AS value
    FROM tags t FULL JOIN updates u USING (asset_id, ifd, tag)""")
def m4(spark, sf):
    return M.set_tags(I.tags(spark, sf), updates(spark, sf))


PAIRS = "pairs AS (SELECT DISTINCT conv_id AS target_id, (conv_id * 7 + 3) % 150 AS source_id FROM conversations WHERE role = 'system')"


@query("m5_copy_metadata", ctes(TG, PAIRS) + """SELECT * FROM tags WHERE asset_id NOT IN (SELECT target_id FROM pairs)
    UNION ALL SELECT target_id, ifd, tag, value FROM tags JOIN pairs ON asset_id = source_id""")
def m5(spark, sf):
    pairs = (I.table(spark, sf, "conversations").where("role = 'system'")
             .select(F.col("conv_id").alias("target_id"), F.expr("(conv_id * 7 + 3) % 150").alias("source_id")).distinct())
    return M.copy_metadata(I.tags(spark, sf), pairs)




@query("m6_manifest_dropped", ctes(SEG) + """SELECT DISTINCT asset_id FROM segs WHERE kind IN ('APP11', 'caBX')
    AND asset_id NOT IN (SELECT asset_id FROM segs WHERE kind IN ('APP11', 'caBX') AND length >= 40000)""")
def m6(spark, sf):
    segs = I.segments(spark, sf)
    return M.manifest_dropped(segs, segs.where("length >= 40000"))


@query("m7_exif_facts", ctes(TG, CTG) + """SELECT asset_id, bool_or(ifd = 'GPS') AS has_gps,
    bool_or(ifd = 'PRIMARY' AND tag IN (271, 272, 42033, 42036, 42035, 36867)) AS has_camera,
    max(CASE WHEN ifd = 'PRIMARY' AND tag = 274 THEN TRY_CAST(value AS INT) END) AS orientation FROM ctags GROUP BY asset_id""")
def m7(spark, sf):
    return M.exif_facts(I.coded_tags(spark, sf))


@query("m8_preservation_policy", ctes(TG, CTG) + "SELECT * FROM ctags WHERE tag IN (274, 33432, 315) AND ifd <> 'GPS'")
def m8(spark, sf):
    return M.preservation_policy(I.coded_tags(spark, sf))


@query("m8_preservation_keep_gps", ctes(TG, CTG) + "SELECT * FROM ctags WHERE tag IN (274, 33432, 315) OR ifd = 'GPS'")
def m8_gps(spark, sf):
    return M.preservation_policy(I.coded_tags(spark, sf), keep_gps=True)


@query("m9_metadata_audit", ctes(SEG) + f"""SELECT fmt, kind, count(*) AS segments, CAST(sum(length) AS BIGINT) AS bytes, count_if({STRIP}) AS strippable,
    GROUPING_ID(fmt, kind) AS level FROM segs GROUP BY CUBE (fmt, kind)""")
def m9(spark, sf):
    return M.metadata_audit(I.segments(spark, sf))


@query("m10_ext_for_metadata", ctes(AS) + """SELECT asset_id, CASE WHEN bytes % 4 <> 0 THEN lower(ext)
    WHEN lang = 'de' THEN 'png' ELSE 'jpg' END AS ext FROM assets""")
def m10(spark, sf):
    ext = F.when(F.col("bytes") % 4 == 0, F.lit("")).otherwise(F.col("ext"))
    sniffed = F.expr("case lang when 'de' then 'png' when 'en' then 'jpeg' end")
    return I.assets(spark, sf).select("asset_id", M.ext_for_metadata(ext, sniffed).alias("ext"))
