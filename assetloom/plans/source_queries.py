"""Source, path and scalar queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from ..session import fresh_dir
from ..sources import assets as SA
from ..sources import outputs as SO
from ..sources import segments as SG
from ..sources import sniff as SN
from . import inputs as I
from .inputs import AS, DIM, ctes
from .registry import query

E = F.expr
ALLOWED = "('jpg','jpeg','png','gif','bmp','tif','tiff','ico','avif','svg')"


@query("s2_filter_asset_ext", ctes(AS) + f"SELECT asset_id, path FROM assets WHERE lower(ext) IN {ALLOWED}")
def s2(spark, sf):
    return SA.filter_asset_ext(I.assets(spark, sf)).select("asset_id", "path")


@query("s2_filter_asset_ext_extra", ctes(AS) + f"SELECT asset_id, path FROM assets WHERE lower(ext) IN {ALLOWED} OR lower(ext) = 'webp'")
def s2_extra(spark, sf):
    return SA.filter_asset_ext(I.assets(spark, sf), extra=["webp"]).select("asset_id", "path")


@query("s3_path_parts", ctes(AS) + """SELECT asset_id, 'd' || (asset_id % 700) || '-' || (asset_id // 700) || '.' || ext AS name,
    'd' || (asset_id % 700) || '-' || (asset_id // 700) AS stem, ext, lang AS parent FROM assets""")
def s3(spark, sf):
    return SA.path_parts(I.assets(spark, sf)).select("asset_id", "name", "stem", "ext", "parent")


@query("s3_url_parts", """SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) AS name FROM pages""")
def s3_urls(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"),
                                              P.file_name(F.substring_index("url", "?", 1)).alias("name"))


@query("s1_scan_assets", """SELECT 'd' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' ELSE '.txt' END AS name,
    CASE WHEN doc_id % 7 = 0 THEN 0 ELSE strlen(coalesce(text, '')) END AS bytes FROM documents WHERE doc_id % 3 < 2""")
def s1(spark, sf):
    """Every document as a loose file, a seventh of them empty, listed again: image names only, empty files too."""
    root = fresh_dir(spark, "scan").removeprefix("file://")
    name = E("concat('d', doc_id, case doc_id % 3 when 0 then '.png' when 1 then '.JPG' else '.txt' end)")
    payload = E("case when doc_id % 7 = 0 then '' else coalesce(text, '') end").cast("binary")
    SO.write_files(I.table(spark, sf, "documents").select(name.alias("out_name"), payload.alias("payload")), root, overwrite=True)
    return SA.scan_assets(spark, root).select("name", "bytes")


MESSY = "msg AS (SELECT *, CASE bytes % 4 WHEN 0 THEN path WHEN 1 THEN './' || replace(path, '/', '//') WHEN 2 THEN 'x/../' || path ELSE '../' || path END AS messy FROM assets)"


def messy(spark, sf):
    path = E("case bytes % 4 when 0 then path when 1 then concat('./', replace(path, '/', '//')) when 2 then concat('x/../', path) else concat('../', path) end")
    return I.assets(spark, sf).withColumn("messy", path)


@query("s4_contained_in", ctes(AS, MESSY) + "SELECT asset_id, messy FROM msg WHERE source = 'src1' AND bytes % 4 <> 3")
def s4(spark, sf):
    return SA.contained_in(messy(spark, sf), "assets/./src1/", "messy").select("asset_id", "messy")


def containers(spark: SparkSession, sf: str) -> DataFrame:
    """Container bytes around every document's whole text: eight kinds by id."""
    h4 = lambda c: f"lpad(hex({c}), 8, '0')"
    h2 = lambda c: f"lpad(hex({c}), 4, '0')"
    l2 = lambda c: f"concat(lpad(hex({c} % 256), 2, '0'), lpad(hex({c} div 256), 2, '0'))"
    n = "octet_length(text)"
    i = "doc_id"
    chunk = lambda size, kind, body: f"concat({h4(size)}, '{kind.encode().hex().upper()}', {body}, '00000000')"
    png_head = f"concat('89504E470D0A1A0A', {chunk('13', 'IHDR', f'concat({h4('w')}, {h4('h')}, if({i} % 3 = 0, {chr(39)}10{chr(39)}, {chr(39)}08{chr(39)}), if({i} % 5 = 0, {chr(39)}06{chr(39)}, {chr(39)}02{chr(39)}), {chr(39)}000000{chr(39)})')}, if({i} % 3 = 1, {chunk('8', 'acTL', repr('00' * 8))}, ''), if({i} % 2 = 1, '', {chunk('4', 'eXIf', repr('4D4D002A'))}), {h4(n)}, '49444154')"
    jpg_head = f"concat('FFD8FFE00010', '{'00' * 14}', if({i} % 3 = 0, 'FFE10008457869660000', ''), if({i} % 5 < 3, 'FFE2000D4943435F50524F46494C45', ''), 'FFC0000B08', {h2('h')}, {h2('w')}, if({i} % 7 = 0, '04', '03'), '000000', 'FFDA000400FF')"
    gif_head = f"concat('474946383961', {l2('w')}, {l2('h')}, '000000', repeat('2C00000000000000000002014400', cast({i} % 3 as int)), '3B')"
    l4 = lambda c: f"concat({l2(f'({c} % 65536)')}, {l2(f'({c} div 65536)')})"
    webp = f"concat('52494646', '00000000', '57454250', '56503858', '0A000000', if({i} % 3 = 0, '12', '00'), '000000', {l2('(w - 1)')}, '00', {l2('(h - 1)')}, '00', '584D5020', {l4(n)})"
    rows = I.table(spark, sf, "documents").withColumns({"w": E("cast(1 + n_chars % 5000 as bigint)"), "h": E("cast(1 + n_chars % 900 as bigint)")})
    head = (f"case {i} % 8 when 0 then {png_head} when 1 then {jpg_head} when 2 then {gif_head} when 3 then {webp} "
            f"when 4 then '00000014667479706176696600000000 6D696631' when 5 then '000000186674797068656978000000006D69663168656963' "
            f"when 6 then hex(if({i} % 3 = 0, '<?xml version=\"1.0\"?><!-- x --><SVG>', '  <svg/>')) else '' end").replace("00000000 6D", "000000006D")
    tail = f"case {i} % 8 when 0 then concat('00000000', {h4('0')}, '49454E4400000000') when 1 then if({i} % 11 = 0, '', 'FFD9') when 3 then repeat('00', {n} % 2) else '' end"
    return rows.select(F.col("doc_id").alias("asset_id"), "w", "h", "text", F.concat(
        F.unhex(E(head)), F.encode("text", "UTF-8"), F.unhex(E(tail))).alias("content"))


BOX = """box AS (SELECT doc_id AS asset_id, doc_id % 8 AS k, doc_id, 1 + n_chars % 5000 AS w, 1 + n_chars % 900 AS h, text, strlen(text) AS n FROM documents)"""
FMT = "(['png','jpeg','gif','webp','avif','heic','svg'])[k + 1]"


@query("s5_sniff_format", ctes(BOX) + f"SELECT asset_id, {FMT} AS format FROM box")
def s5(spark, sf):
    return containers(spark, sf).select("asset_id", SN.sniff_format(F.col("content")).alias("format"))


@query("s6_is_svg", r"""SELECT page_id, regexp_matches(html, '^\s*<svg[\s>/]', 'i') OR (regexp_matches(html, '^\s*<\?xml', 'i') AND regexp_matches(left(html, 1024), '<svg[\s>/]', 'i')) AS svg FROM pages""")
def s6(spark, sf):
    return I.table(spark, sf, "pages").select("page_id", SN.is_svg(F.encode("html", "UTF-8")).alias("svg"))


@query("s7_header_dims", ctes(BOX) + f"SELECT asset_id, {FMT} AS format, CASE WHEN k IN (0, 2, 3) THEN w END AS width, CASE WHEN k IN (0, 2, 3) THEN h END AS height FROM box")
def s7(spark, sf):
    base = containers(spark, sf).withColumn("format", SN.sniff_format(F.col("content")))
    return SN.header_dims(base).select("asset_id", "format", "width", "height")


@query("s8_within_pixel_budget", ctes(DIM) + """SELECT asset_id, line, part_id, supp_id, CASE WHEN greatest(w, h * 9) > 65535 THEN 'side over limit' WHEN w * h * 9 > 67108864
    THEN 'image ' || w || 'x' || (h * 9) || ' would hold ' || (w * h * 9) || ' pixels' END AS reason FROM dims""")
def s8(spark, sf):
    rows = I.dims(spark, sf).withColumn("h", F.col("h") * 9)
    return SA.within_pixel_budget(rows).select("asset_id", "line", "part_id", "supp_id", "reason")


@query("s9_jpeg_truncated", ctes(BOX) + "SELECT asset_id, k = 1 AND doc_id % 11 = 0 AND right(text, 2) <> 'zz' AS truncated FROM box")
def s9(spark, sf):
    return containers(spark, sf).select("asset_id", SN.jpeg_truncated(F.col("content")).alias("truncated"))


@query("s10_is_animated", ctes(BOX) + """SELECT asset_id, CASE k WHEN 0 THEN doc_id % 3 = 1 WHEN 2 THEN doc_id % 3 = 2 WHEN 3 THEN doc_id % 3 = 0 ELSE false END AS animated FROM box""")
def s10(spark, sf):
    return SG.asset_info(containers(spark, sf)).select("asset_id", "animated")


SEGS = """segs AS (
  SELECT asset_id, 0 AS o, 'IHDR' AS kind, 13 AS length FROM box WHERE k = 0 UNION ALL SELECT asset_id, 1, 'acTL', 8 FROM box WHERE k = 0 AND doc_id % 3 = 1
  UNION ALL SELECT asset_id, 2, 'eXIf', 4 FROM box WHERE k = 0 AND doc_id % 2 = 0 UNION ALL SELECT asset_id, 3, 'IDAT', n FROM box WHERE k = 0
  UNION ALL SELECT asset_id, 4, 'IEND', 0 FROM box WHERE k = 0 UNION ALL SELECT asset_id, 0, 'APP0', 14 FROM box WHERE k = 1
  UNION ALL SELECT asset_id, 1, 'APP1', 6 FROM box WHERE k = 1 AND doc_id % 3 = 0 UNION ALL SELECT asset_id, 2, 'APP2', 11 FROM box WHERE k = 1 AND doc_id % 5 < 3
  UNION ALL SELECT asset_id, 3, 'SOF0', 9 FROM box WHERE k = 1 UNION ALL SELECT asset_id, 4, 'SOS', 2 FROM box WHERE k = 1
  UNION ALL SELECT asset_id, unnest(range(doc_id % 3)), 'image', 14 FROM box WHERE k = 2 UNION ALL SELECT asset_id, 0, 'VP8X', 10 FROM box WHERE k = 3
  UNION ALL SELECT asset_id, 1, 'XMP ', n FROM box WHERE k = 3)"""


@query("s11_segments", ctes(BOX, SEGS) + """SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY o) - 1 AS seg_idx, kind, length FROM segs""")
def s11(spark, sf):
    return SG.segments(containers(spark, sf)).select("asset_id", "seg_idx", "kind", "length")


@query("s12_asset_info", ctes(BOX) + f"""SELECT asset_id, {FMT} AS format, CASE WHEN k < 4 THEN w END AS width, CASE WHEN k < 4 THEN h END AS height,
    CASE WHEN k = 0 THEN w * h * CASE WHEN doc_id % 5 = 0 THEN 4 ELSE 3 END * CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END WHEN k = 1 THEN w * h * 3 WHEN k = 2 THEN w * h * 4
         WHEN k = 3 THEN w * h * CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 3 END END AS decoded_bytes,
    CASE WHEN k = 0 AND doc_id % 3 = 0 THEN 16 ELSE 8 END AS bit_depth, (k = 0 AND doc_id % 2 = 0) OR (k = 1 AND doc_id % 3 = 0) AS has_exif, k = 1 AND doc_id % 5 < 3 AS has_icc FROM box""")
def s12(spark, sf):
    return SG.asset_info(containers(spark, sf)).select("asset_id", "format", "width", "height", "decoded_bytes", "bit_depth", "has_exif", "has_icc")


@query("s13_container_label", ctes(BOX) + "SELECT asset_id, CASE k WHEN 6 THEN 'svg' WHEN 5 THEN 'heic' ELSE 'png' END AS label FROM box")
def s13(spark, sf):
    kind = SN.sniff_format(F.col("content"))
    return containers(spark, sf).select("asset_id", SA.container_label(F.lit("png"), F.coalesce(kind, F.lit(""))).alias("label"))


@query("s14_write_outputs", ctes(AS) + "SELECT lang || '_d' || (asset_id % 700) || '-' || (asset_id // 700) || '.webp' AS out_name, source, strlen('out:' || content) AS payload_len FROM assets")
def s14(spark, sf):
    rows = SO.named_outputs(I.assets(spark, sf), "{parent}_{stem}.{ext}", F.lit("webp")).where("reason is null").select(
        "out_name", "source", F.concat(F.lit("out:"), "content").cast("binary").alias("payload"))
    target = fresh_dir(spark, "outputs")
    SO.write_outputs(rows, target, partition_by=["source"])
    return spark.read.parquet(target).select("out_name", "source", F.octet_length("payload").alias("payload_len"))


NAMES = "nm AS (SELECT asset_id, CASE bytes % 6 WHEN 0 THEN '' WHEN 1 THEN '/' || path WHEN 2 THEN path WHEN 3 THEN '..' WHEN 4 THEN 'a\\b' ELSE ext || '..x' END AS name FROM assets)"


@query("s15_safe_names", ctes(AS, NAMES) + "SELECT asset_id, CASE WHEN name = '' THEN 'empty' WHEN name[1] = '/' THEN 'absolute' WHEN contains(name, '/') OR contains(name, '\\') THEN 'separator' WHEN name = '..' THEN 'parent' END AS reason FROM nm")
def s15(spark, sf):
    b = F.col("bytes") % 6
    name = (F.when(b == 0, "").when(b == 1, F.concat(F.lit("/"), "path")).when(b == 2, F.col("path")).when(b == 3, "..")
            .when(b == 4, "a\\b").otherwise(F.concat("ext", F.lit("..x"))))
    return SO.safe_names(I.assets(spark, sf).select("asset_id", name.alias("name"))).select("asset_id", "reason")


CHECKS = {"unsupported": "lower(ext) = 'txt'", "too small": "bytes < 100", "too large": "bytes > 20000"}


def marked(spark, sf):
    return SO.mark_failures(I.assets(spark, sf), {k: E(v) for k, v in CHECKS.items()})


@query("s16_split_failures", ctes(AS) + "SELECT asset_id, CASE WHEN lower(ext) = 'txt' THEN 'unsupported' WHEN bytes < 100 THEN 'too small' WHEN bytes > 20000 THEN 'too large' END AS error FROM assets")
def s16(spark, sf):
    kept, failed = SO.split_failures(I.assets(spark, sf), {k: E(v) for k, v in CHECKS.items()})
    return kept.select("asset_id", F.lit(None).cast("string").alias("error")).unionByName(failed.select("asset_id", "error"))


@query("s16_failure_summary", ctes(AS) + """SELECT count(*) AS total, count_if(bad) AS failed, count_if(bad) || ' of ' || count(*) || ' failed' AS line
    FROM (SELECT lower(ext) = 'txt' OR bytes < 100 OR bytes > 20000 AS bad FROM assets)""")
def s16_summary(spark, sf):
    return SO.failure_summary(marked(spark, sf))


# --- scalar functions over texts derived from lineitems -----------------------
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def lines(spark, sf, **cols):
    return I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[v.alias(k) for k, v in cols.items()])


SIZE_TEXT = """CASE l_partkey % 10 WHEN 0 THEN l_suppkey || 'KB' WHEN 1 THEN ' ' || l_suppkey || '.5 mb ' WHEN 2 THEN l_linenumber || 'KiB' WHEN 3 THEN '0.' || l_linenumber || 'MiB'
    WHEN 4 THEN '' WHEN 5 THEN '-5KB' WHEN 6 THEN '1.5.2MB' WHEN 7 THEN l_suppkey || 'xb' WHEN 8 THEN '0.' || l_linenumber ELSE l_partkey || ' B' END"""


@query("f1_parse_size", f"""SELECT {KEYS}, CASE l_partkey % 10 WHEN 0 THEN CASE WHEN l_suppkey > 0 THEN l_suppkey * 1000 END WHEN 1 THEN l_suppkey * 1000000 + 500000 WHEN 2 THEN l_linenumber * 1024
    WHEN 3 THEN CAST(round(l_linenumber / 10.0::DOUBLE * 1048576) AS BIGINT) WHEN 9 THEN l_partkey END AS bytes FROM lineitem""")
def f1(spark, sf):
    return lines(spark, sf, bytes=S.parse_size(E(SIZE_TEXT)))


BYTES = "(l_orderkey * l_partkey) % 30000000 // (CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 30000 END)"


@query("f2_fmt_bytes", f"""SELECT {KEYS}, CASE WHEN n >= 1000000 THEN printf('%.1f', n / 1000000.0::DOUBLE) || ' MB' WHEN n >= 1000 THEN printf('%.1f', n / 1000.0::DOUBLE) || ' KB' ELSE n || ' B' END AS label
    FROM (SELECT *, {BYTES} AS n FROM lineitem)""")
def f2(spark, sf):
    return lines(spark, sf, label=S.fmt_bytes(E(BYTES.replace("//", "div"))))


WXH = "CASE l_partkey % 7 WHEN 0 THEN l_suppkey || 'x' || l_linenumber WHEN 1 THEN l_partkey || 'X' || l_suppkey WHEN 2 THEN 'x5' WHEN 3 THEN '5x5x5' WHEN 4 THEN '10x-3' WHEN 5 THEN '99999999999x2' ELSE '10 x 20' END"


@query("f3_parse_wxh", f"""SELECT {KEYS}, CASE l_partkey % 7 WHEN 0 THEN CASE WHEN l_suppkey > 0 THEN l_suppkey END WHEN 1 THEN CASE WHEN l_suppkey > 0 THEN l_partkey END END AS w,
    CASE l_partkey % 7 WHEN 0 THEN CASE WHEN l_suppkey > 0 THEN l_linenumber END WHEN 1 THEN CASE WHEN l_suppkey > 0 THEN l_suppkey END END AS h FROM lineitem""")
def f3(spark, sf):
    w, h = S.parse_wxh(E(WXH))
    return lines(spark, sf, w=w, h=h)


@query("f4_parse_color", f"""SELECT {KEYS}, CASE WHEN l_partkey % 5 < 3 THEN l_suppkey % 256 END AS r, CASE WHEN l_partkey % 5 < 3 THEN l_partkey % 256 END AS g,
    CASE WHEN l_partkey % 5 < 3 THEN l_orderkey % 256 END AS b, CASE WHEN l_partkey % 5 = 2 THEN l_linenumber WHEN l_partkey % 5 < 3 THEN 255 END AS a FROM lineitem""")
def f4(spark, sf):
    h = lambda c: f"lpad(hex({c} % 256), 2, '0')"
    rgb = f"concat({h('l_suppkey')}, lower({h('l_partkey')}), {h('l_orderkey')})"
    text = E(f"case l_partkey % 5 when 0 then {rgb} when 1 then concat('#', {rgb}) when 2 then concat({rgb}, {h('l_linenumber')}) when 3 then 'GG0011' else '#123' end")
    r, g, b, a = S.parse_color(text)
    return lines(spark, sf, r=r, g=g, b=b, a=a)


@query("f5_parse_threshold", f"""SELECT {KEYS}, CASE WHEN l_partkey % 4 < 2 AND l_suppkey <= 100 THEN l_partkey END AS min_bytes, CASE WHEN l_partkey % 4 < 2 AND l_suppkey <= 100 THEN l_suppkey END AS min_percent FROM lineitem""")
def f5(spark, sf):
    text = E("case l_partkey % 4 when 0 then concat(l_partkey, ':', l_suppkey) when 1 then concat(' ', l_partkey, ' : ', l_suppkey) when 2 then concat(l_partkey) else concat('x:', l_suppkey) end")
    size, pct = S.parse_threshold(text)
    return lines(spark, sf, min_bytes=size, min_percent=pct)


EXTS = ["png", "JPG", "jpeg", "GIF", "bmp", "tif", "TIFF", "ico", "webp", "avif", "nef", "heic", "docx"]
EXT_SQL = "(['" + "','".join(EXTS) + "'])[l_partkey % 13 + 1]"


def ext_col():
    return F.element_at(F.array(*[F.lit(e) for e in EXTS]), (F.col("l_partkey") % 13 + 1).cast("int"))


@query("f6_format_maps", f"""SELECT {KEYS}, fmt, CASE fmt WHEN 'jpeg' THEN 'jpg' ELSE coalesce(fmt, 'bin') END AS ext FROM (SELECT *, CASE lower({EXT_SQL}) WHEN 'jpg' THEN 'jpeg' WHEN 'tif' THEN 'tiff'
    WHEN 'nef' THEN NULL WHEN 'heic' THEN NULL WHEN 'docx' THEN NULL ELSE lower({EXT_SQL}) END AS fmt FROM lineitem)""")
def f6(spark, sf):
    fmt = S.format_from_ext(ext_col())
    return lines(spark, sf, fmt=fmt, ext=S.ext_for_format(fmt))


@query("f7_glob_to_regex", ctes(AS) + """SELECT asset_id, path LIKE 'assets/%.jpg' AS crossing, false AS stopping, path LIKE '%/de/%' AS middle,
    regexp_matches(path, '^assets/src[1-3]/[^f].*$') AS class_, regexp_matches(path, '^assets/src1[^/]/[^/]*/d[^/]*$') AS file_level FROM assets""")
def f7(spark, sf):
    p = F.col("path")
    return I.assets(spark, sf).select(
        "asset_id", P.glob_matches(p, "assets/*.jpg").alias("crossing"), P.glob_matches(p, "assets/*.jpg", False).alias("stopping"),
        P.glob_matches(p, "**/de/**", False).alias("middle"), P.glob_matches(p, "assets/src[1-3]/[!f]*").alias("class_"),
        P.glob_matches(p, "assets/src1?/*/d*", False).alias("file_level"))


@query("f8_prefix_matches", ctes(AS) + "SELECT asset_id, starts_with(path, 'assets/src1/') AS hit FROM assets")
def f8(spark, sf):
    return I.assets(spark, sf).select("asset_id", P.prefix_matches(F.lit("assets/src1"), F.col("path")).alias("hit"))


@query("f9_escape_json", "SELECT conv_id, turn, length(to_json(text)::VARCHAR) > length(text) AS longer, json_extract_string(to_json(text), '$') AS back FROM conversations")
def f9(spark, sf):
    quoted = S.escape_json(F.col("text"))
    back = F.get_json_object(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "$.v")
    return I.table(spark, sf, "conversations").select("conv_id", "turn", (F.length(quoted) > F.length("text")).alias("longer"), back.alias("back"))


@query("f10_short_hash", "SELECT doc_id, left(sha256(text), 12) AS short FROM documents")
def f10(spark, sf):
    return I.table(spark, sf, "documents").select("doc_id", S.short_hash(F.sha2("text", 256)).alias("short"))


@query("f11_lexical_clean", ctes(AS, MESSY) + "SELECT asset_id, CASE WHEN bytes % 4 = 3 THEN '../' || path ELSE path END AS clean FROM msg")
def f11(spark, sf):
    return messy(spark, sf).select("asset_id", P.lexical_clean(F.col("messy")).alias("clean"))


@query("f12_is_raw_ext", f"SELECT {KEYS}, {EXT_SQL} = 'nef' AS raw FROM lineitem")
def f12(spark, sf):
    return lines(spark, sf, raw=S.is_raw_ext(ext_col()))


@query("f13_plural", f"SELECT {KEYS}, l_linenumber || CASE WHEN l_linenumber = 1 THEN ' target' ELSE ' targets' END AS label FROM lineitem")
def f13(spark, sf):
    return lines(spark, sf, label=S.plural(F.col("l_linenumber"), "target"))


@query("f14_labels", f"""SELECT {KEYS}, lower({EXT_SQL}) AS format, (['l','la','rgb','rgba'])[l_suppkey % 4 + 1] || CASE WHEN l_suppkey % 4 >= 2 AND l_linenumber % 3 = 2 THEN '32f' WHEN l_linenumber % 3 = 1 THEN '16' ELSE '8' END AS color_type FROM lineitem""")
def f14(spark, sf):
    ch = (F.col("l_suppkey") % 4 + 1).cast("int")
    depth = F.when((ch >= 3) & (F.col("l_linenumber") % 3 == 2), 32).when(F.col("l_linenumber") % 3 == 1, 16).otherwise(8)
    return lines(spark, sf, format=S.format_label(ext_col()), color_type=S.color_type_label(ch, depth))
