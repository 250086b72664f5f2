"""Incremental build queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.paths import expand_template
from ..operators import build as B
from . import inputs as I
from .inputs import AS, LK, ctes
from .registry import query

E = F.expr
TARGETS = [
    B.Target(("assets/src1/**", "assets/*/de/*.PNG"), "web", "dist/a", "{stem}.{ext}"),
    B.Target(("assets/**/*.jpg",), "gallery", "./dist//b", "{parent}-{stem}.{ext}"),
    B.Target(("assets/src?/en/d[0-4]*", "assets/**"), "product", "dist/c/../c"),
    B.Target(("missing/**",), "web", "dist/none"),
]
EXPANDED = """expanded AS (
  SELECT *, 0 AS target_idx, 0 AS pattern_idx, 'web' AS recipe, 'dist/a' AS out_dir, '{stem}.{ext}' AS template FROM assets WHERE path LIKE 'assets/src1/%' AND lower(ext) IN ('jpg', 'png', 'gif')
  UNION ALL SELECT *, 0, 1, 'web', 'dist/a', '{stem}.{ext}' FROM assets WHERE regexp_matches(path, '^assets/[^/]*/de/[^/]*\\.PNG$')
  UNION ALL SELECT *, 1, 0, 'gallery', 'dist/b', '{parent}-{stem}.{ext}' FROM assets WHERE path LIKE 'assets/%.jpg'
  UNION ALL SELECT *, 2, 0, 'product', 'dist/c', '{stem}.{ext}' FROM assets WHERE regexp_matches(path, '^assets/src[^/]/en/d[0-4][^/]*$') AND lower(ext) IN ('jpg', 'png', 'gif')
  UNION ALL SELECT *, 2, 1, 'product', 'dist/c', '{stem}.{ext}' FROM assets WHERE path LIKE 'assets/%' AND lower(ext) IN ('jpg', 'png', 'gif')),
named AS (SELECT *, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS parent FROM expanded),
placed AS (SELECT *, out_dir || '/' || CASE target_idx WHEN 1 THEN parent || '-' ELSE '' END || stem || '.' || '{ext}' AS out_sym,
  out_dir || '/' || CASE target_idx WHEN 1 THEN parent || '-' ELSE '' END || stem || '.webp' AS out_path FROM named)"""
X = ctes(AS, EXPANDED)


def expanded(spark, sf):
    return B.expand_targets(I.assets(spark, sf), TARGETS)


@query("b1_expand_targets", X + "SELECT asset_id, path, target_idx, pattern_idx, recipe FROM expanded")
def b1(spark, sf):
    return expanded(spark, sf).select("asset_id", "path", "target_idx", "pattern_idx", "recipe")


MAN = """man AS (SELECT c_custkey AS target_idx, c_nationkey AS manifest, CASE WHEN c_nationkey % 6 = 5 THEN 2 ELSE 1 END AS version,
  CASE c_custkey % 8 WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN ['a.png', ' '] WHEN 3 THEN ['-', 'b.png'] ELSE ['assets/' || c_mktsegment || '/**/x*.png', 'photos/'] END AS source,
  CASE WHEN c_custkey % 13 = 0 THEN ' ' ELSE 'web' END AS recipe,
  CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN '../out' WHEN 2 THEN '/abs' WHEN 3 THEN 'a/../../b' WHEN 4 THEN './dist/' ELSE 'dist/c' || c_nationkey END AS out_dir,
  CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 11 = 1 THEN '{stem}.{ext}' END AS name FROM customer)"""


def manifest_targets(spark, sf):
    """One manifest target per customer, many of them broken."""
    return I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("target_idx"), F.col("c_nationkey").alias("manifest"), E("if(c_nationkey % 6 = 5, 2, 1)").alias("version"),
        E("case c_custkey % 8 when 1 then cast(array() as array<string>) when 2 then array('a.png', ' ') when 3 then array('-', 'b.png') "
          "else array(concat('assets/', c_mktsegment, '/**/x*.png'), 'photos/') end").alias("source"),
        E("if(c_custkey % 13 = 0, ' ', 'web')").alias("recipe"),
        E("case c_custkey % 9 when 0 then '' when 1 then '../out' when 2 then '/abs' when 3 then 'a/../../b' when 4 then './dist/' else concat('dist/c', c_nationkey) end").alias("out"),
        E("case when c_custkey % 11 = 0 then ' ' when c_custkey % 11 = 1 then '{stem}.{ext}' end").alias("name"))


@query("b1_empty_targets", ctes(AS, EXPANDED) + """SELECT t AS target_idx FROM (SELECT DISTINCT c_custkey % 4 AS t FROM customer) WHERE t NOT IN (SELECT target_idx FROM expanded)""")
def b1_empty(spark, sf):
    targets = I.table(spark, sf, "customer").select((F.col("c_custkey") % 4).alias("target_idx")).distinct()
    return B.empty_targets(expanded(spark, sf), targets)


@query("b2_validate_targets", ctes(MAN) + """SELECT target_idx, CASE WHEN len(source) = 0 THEN 'no entry under `source`'
    WHEN source[1] = '-' THEN '`source` names standard input, which a build cannot repeat' WHEN source[2] = ' ' THEN 'an entry of `source` is blank'
    WHEN recipe = ' ' THEN '`recipe` is blank' WHEN out_dir = '' THEN '`out` is blank'
    WHEN out_dir IN ('../out', 'a/../../b') THEN '`out` leads above the project: ' || out_dir
    WHEN out_dir = '/abs' THEN '`out` is not relative to the project: /abs' WHEN name = ' ' THEN '`name` is blank' END AS reason FROM man""")
def b2(spark, sf):
    return B.validate_targets(manifest_targets(spark, sf)).select("target_idx", "reason")


@query("b2_validate_manifests", ctes(MAN) + """SELECT manifest, max(version) AS version, count(*) AS targets, CASE WHEN max(version) <> 1 THEN 'manifests of this version are unknown: 2'
    WHEN count(*) > 1024 THEN 'more targets than a manifest may have (' || count(*) || ')' END AS reason FROM man GROUP BY manifest""")
def b2_manifests(spark, sf):
    return B.validate_manifests(manifest_targets(spark, sf))


@query("b3_expand_template", ctes(AS) + """SELECT asset_id, parent || '/' || stem || '_' || lower(ext) || '_' || stem || '.' || ext || '{other}' AS name FROM (
    SELECT *, regexp_extract(path, '([^/]*)\\.[^.]*$', 1) AS stem, lang AS parent FROM assets)""")
def b3(spark, sf):
    return I.assets(spark, sf).select("asset_id", expand_template(
        "{parent}/{stem}_{ext}_{name}{other}", F.col("path"), F.lower("ext")).alias("name"))


ORDER = ["target_idx", "pattern_idx", "path"]


def symbolic(spark, sf):
    return B.output_paths(expanded(spark, sf), "{ext}")


COLL = """ranked AS (SELECT *, row_number() OVER (PARTITION BY out_sym ORDER BY target_idx, pattern_idx, path) AS rn FROM placed),
coll AS (SELECT out_sym, max(path) FILTER (WHERE rn = 1) AS first, max(path) FILTER (WHERE rn = 2) AS second, max((target_idx, pattern_idx, path)) FILTER (WHERE rn = 2) AS ord
  FROM ranked WHERE rn <= 2 GROUP BY out_sym HAVING count(*) = 2)"""


@query("b4_output_collisions", ctes(AS, EXPANDED, COLL) + "SELECT out_sym AS out_path, first, second FROM coll")
def b4(spark, sf):
    return B.output_collisions(symbolic(spark, sf), ORDER).drop("_ord")


@query("b4_first_collision", ctes(AS, EXPANDED, COLL) + "SELECT out_sym AS out_path, first, second FROM coll ORDER BY ord LIMIT 1")
def b4_first(spark, sf):
    return B.first_collision(symbolic(spark, sf), ORDER)


@query("b5_content_hash", ctes(AS) + "SELECT asset_id, sha256(content) AS hash FROM assets")
def b5(spark, sf):
    return I.assets(spark, sf).select("asset_id", hashing.content_hash(F.col("content")).alias("hash"))


def le(n: str, width: int = 8) -> str:
    """Little-endian bytes of a value below 65 536, in SQL."""
    return f"unhex(printf('%02X%02X', ({n}) % 256, ({n}) // 256) || '{'00' * (width - 2)}')"


def frame_sql(tag: int, blob: str) -> str:
    return f"unhex('{tag:02X}') || {le(f'octet_length({blob})')} || {blob}"


STEPS = """rsteps AS (SELECT p_partkey AS recipe, 0 AS step_idx, 'auto-orient' AS op, '[]' AS params FROM part
  UNION ALL SELECT p_partkey, 1, 'resize', '[{"key":"mode","value":"max"},{"key":"width","value":"' || (p_size * 100) || '"}]' FROM part
  UNION ALL SELECT p_partkey, 2, CASE p_type WHEN 'PROMO' THEN 'invert' ELSE 'optimize' END, '[]' FROM part WHERE p_type <> 'SMALL')"""


def part_steps(spark, sf):
    """A two- or three-step recipe per part, as step rows."""
    p = I.table(spark, sf, "part")
    empty = "cast(map() as map<string,string>)"
    steps = E(f"""array(named_struct('step_idx', 0, 'op', 'auto-orient', 'params', {empty}),
        named_struct('step_idx', 1, 'op', 'resize', 'params', map('width', cast(p_size * 100 as string), 'mode', 'max')),
        if(p_type <> 'SMALL', named_struct('step_idx', 2, 'op', if(p_type = 'PROMO', 'invert', 'optimize'), 'params', {empty}), null))""")
    return p.select(F.col("p_partkey").alias("recipe"), F.explode(F.array_compact(steps)).alias("_s")).select("recipe", "_s.*")


CANON = """canon AS (SELECT recipe, '[' || string_agg('{"step_idx":' || step_idx || ',"op":"' || op || '","params":' || params || '}', ',' ORDER BY step_idx) || ']' AS canonical
  FROM rsteps GROUP BY recipe)"""


@query("b6_recipe_hash", ctes(STEPS, CANON) + f"""SELECT recipe, canonical, sha256({frame_sql(0, 'encode(canonical)')} || {frame_sql(1, "encode('decide')")}) AS recipe_hash FROM canon""")
def b6(spark, sf):
    return B.recipe_hash(part_steps(spark, sf), "decide")


RH = "".join(f"{i:02x}" for i in range(32))
VERSION, FEATURES = "1.4.0", "avif,webp-lossy"


def key_sql(quality: str | None = None) -> str:
    level = frame_sql(5, "unhex('')") if quality is None else (
        f"CASE WHEN {quality} IS NULL THEN {frame_sql(5, chr(117) + 'nhex(' + chr(39) * 2 + ')')} ELSE "
        f"unhex('04') || {le('1')} || unhex(printf('%02X', {quality})) END")
    return (f"sha256({frame_sql(0, le('1', 4))} || {frame_sql(1, f'encode({VERSION!r})')} || {frame_sql(2, f'encode({FEATURES!r})')} || "
            f"{frame_sql(3, f'unhex({RH!r})')} || {level} || {frame_sql(6, 'encode(lower(ext))')} || {frame_sql(7, 'unhex(sha256(content))')})")


QUAL = "CASE WHEN bytes % 3 = 0 THEN NULL ELSE bytes % 100 END"


@query("b7_cache_key", ctes(AS) + f"SELECT asset_id, {key_sql('q')} AS key FROM (SELECT *, {QUAL} AS q FROM assets)")
def b7(spark, sf):
    rows = I.assets(spark, sf).withColumns({"recipe_hash": F.lit(RH), "q": E(f"{QUAL}")})
    return B.with_keys(rows, VERSION, FEATURES, quality=F.col("q")).select("asset_id", "key")


KEYED = f"keyed AS (SELECT *, {key_sql()} AS key FROM placed)"
CACHE = f"""entries AS (SELECT key, content, toxic FROM (SELECT a.*, l.toxic, {key_sql()} AS key FROM assets a JOIN labels l ON a.asset_id = l.doc_id)),
cache AS (SELECT key, 'webp' AS ext, encode('out:' || content) AS payload, strlen('out:' || content) AS payload_len,
  sha256(CASE WHEN toxic = 1 THEN 'bad' ELSE '' END || 'out:' || content) AS payload_hash FROM entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY toxic DESC) = 1),
valid AS (SELECT * FROM cache WHERE sha256(payload) = payload_hash)"""


def keyed(spark, sf):
    hashed = B.hash_contents(I.assets(spark, sf))
    placed = B.output_paths(B.expand_targets(hashed, TARGETS), "webp")
    return B.with_keys(placed.withColumn("recipe_hash", F.lit(RH)), VERSION, FEATURES)


def cache_table(spark, sf):
    """Cache entries for every labelled document; toxic ones are corrupted."""
    rows = I.assets(spark, sf).join(I.table(spark, sf, "labels").withColumnRenamed("doc_id", "asset_id"), "asset_id")
    k = B.with_keys(rows.withColumn("recipe_hash", F.lit(RH)), VERSION, FEATURES)
    body = F.concat(F.lit("out:"), "content")
    per_key = k.groupBy("key").agg(F.min("content").alias("content"), F.max("toxic").alias("toxic"))
    return per_key.select("key", F.lit("webp").alias("ext"), body.cast("binary").alias("payload"), F.octet_length(body).cast("bigint").alias("payload_len"),
                          F.sha2(F.concat(F.when(F.col("toxic") == 1, "bad").otherwise(""), body), 256).alias("payload_hash"))


BC = ctes(AS, EXPANDED, KEYED, CACHE)
PLAN = "plan AS (SELECT k.*, CASE WHEN v.key IS NULL THEN 'rebuild' ELSE 'cached' END AS status FROM keyed k LEFT JOIN valid v USING (key))"


def planned(spark, sf):
    return B.plan_build(keyed(spark, sf), B.verify_cache(cache_table(spark, sf)))


@query("b8_plan_build", ctes(AS, EXPANDED, KEYED, CACHE, PLAN) + "SELECT asset_id, target_idx, pattern_idx, key, status FROM plan")
def b8(spark, sf):
    return planned(spark, sf).select("asset_id", "target_idx", "pattern_idx", "key", "status")


@query("b8_work_list", BC + "SELECT key, min(path) AS path, count(*) AS outputs FROM keyed WHERE key NOT IN (SELECT key FROM valid) GROUP BY key")
def b8_work(spark, sf):
    return B.work_list(keyed(spark, sf), B.verify_cache(cache_table(spark, sf)))


@query("b9_verify_cache", BC + "SELECT key, payload_len, payload_hash FROM valid")
def b9(spark, sf):
    return B.verify_cache(cache_table(spark, sf)).select("key", "payload_len", "payload_hash")


@query("b10_materialize", BC + "SELECT out_path, key, payload_len, payload_hash FROM keyed JOIN valid USING (key)")
def b10(spark, sf):
    return B.materialize(keyed(spark, sf), B.verify_cache(cache_table(spark, sf))).select("out_path", "key", "payload_len", "payload_hash")


@query("b11_store", BC + """SELECT key, payload_len FROM valid UNION ALL SELECT DISTINCT key, strlen('out:' || content) FROM keyed WHERE key NOT IN (SELECT key FROM valid)""")
def b11(spark, sf):
    body = F.concat(F.lit("out:"), "content")
    new = keyed(spark, sf).select("key", F.lit("webp").alias("ext"), body.cast("binary").alias("payload"),
                                  F.octet_length(body).cast("bigint").alias("payload_len"), F.sha2(body, 256).alias("payload_hash"))
    return B.store(B.verify_cache(cache_table(spark, sf)), new).select("key", "payload_len")


STATUS = "CASE WHEN target_idx = 1 AND ext = 'jpg' AND bytes < 200 THEN 'failed' ELSE status END"


def with_failures(spark, sf):
    failed = (F.col("target_idx") == 1) & (F.col("bytes") < 200)
    return planned(spark, sf).withColumn("status", F.when(failed, "failed").otherwise(F.col("status")))


@query("b12_build_summary", ctes(AS, EXPANDED, KEYED, CACHE, PLAN) + f"""SELECT target_idx, count(*) AS outputs, count_if(s = 'cached') AS cached, count_if(s = 'rebuild') AS rebuilt,
    count_if(s = 'failed') AS failed FROM (SELECT *, {STATUS} AS s FROM plan) GROUP BY target_idx""")
def b12(spark, sf):
    return B.build_summary(with_failures(spark, sf))


@query("b12_summary_text", ctes(AS, EXPANDED, KEYED, CACHE, PLAN) + f"""SELECT count(DISTINCT target_idx) || ' targets, ' || count(*) || ' outputs: ' || count_if(s = 'cached') || ' cached, ' ||
    count_if(s = 'rebuild') || ' rebuilt, ' || count_if(s = 'failed') || ' failed' AS line FROM (SELECT *, {STATUS} AS s FROM plan)""")
def b12_text(spark, sf):
    return B.summary_text(B.build_summary(with_failures(spark, sf))).select("line")


@query("b13_write_lock", BC + "SELECT out_path AS path, source, recipe, key, payload_hash AS hash, payload_len AS bytes FROM keyed JOIN valid USING (key)")
def b13(spark, sf):
    return B.write_lock(B.materialize(keyed(spark, sf), B.verify_cache(cache_table(spark, sf))))


def diff_sql(cross: bool = False, strict: bool = False) -> str:
    kind = "hash-changed-cross-env" if cross else "hash-changed"
    drift = "kind <> 'hash-changed-cross-env'" if cross and not strict else "true"
    return f"""diffs AS (SELECT *, {drift} AS drift FROM (SELECT path, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' WHEN o.key <> n.key THEN 'key-changed'
      WHEN o.hash <> n.hash THEN '{kind}' END AS kind, CASE WHEN o.key <> n.key THEN o.key WHEN o.hash <> n.hash THEN o.hash END AS committed,
      CASE WHEN o.key <> n.key THEN n.key WHEN o.hash <> n.hash THEN n.hash END AS current FROM committed o FULL JOIN current_lock n USING (path)) WHERE kind IS NOT NULL)"""


def diffed(spark, sf, **kw):
    return B.lock_diff(I.lock_committed(spark, sf), I.lock_current(spark, sf), **kw)


CROSS = {"committed_target": "x86_64-linux", "current_target": "aarch64-macos"}


@query("b14_lock_diff", ctes(LK, diff_sql()) + "SELECT * FROM diffs")
def b14(spark, sf):
    return diffed(spark, sf)


@query("b14_lock_diff_cross_env", ctes(LK, diff_sql(True)) + "SELECT * FROM diffs")
def b14_cross(spark, sf):
    return diffed(spark, sf, **CROSS)


@query("b14_lock_diff_strict", ctes(LK, diff_sql(True, True)) + "SELECT * FROM diffs")
def b14_strict(spark, sf):
    return diffed(spark, sf, strict=True, **CROSS)


@query("b15_lock_gate", ctes(LK, diff_sql()) + "SELECT coalesce(bool_or(drift), false) AS drifted, count(*) = 0 AS clean FROM diffs")
def b15(spark, sf):
    return B.lock_gate(diffed(spark, sf))


@query("b15_lock_gate_clean", "SELECT false AS drifted, true AS clean FROM (SELECT count(*) FROM documents)")
def b15_clean(spark, sf):
    lock = I.lock_committed(spark, sf)
    return B.lock_gate(B.lock_diff(lock, lock))


@query("b16_change_line", ctes(LK, diff_sql(True)) + """SELECT path, CASE WHEN drift THEN 'drift' ELSE 'note' END || ': "' || path || '": ' || CASE kind WHEN 'added' THEN 'new since the lock'
    WHEN 'removed' THEN 'locked, but nothing made it' WHEN 'key-changed' THEN 'other inputs (key ' || left(committed, 12) || ' → ' || left(current, 12) || ')'
    ELSE 'bytes depend on the machine (x86_64-linux ' || left(committed, 12) || ' → aarch64-macos ' || left(current, 12) || '); encoders may differ; --strict counts it as drift' END AS line FROM diffs""")
def b16(spark, sf):
    return B.change_line(diffed(spark, sf, **CROSS), **CROSS).select("path", "line")


@query("b17_lock_validate", ctes(LK) + """SELECT path, CASE WHEN bytes % 50 = 0 THEN 'unsupported lock version' WHEN bytes % 7 = 0 THEN 'key is not hex' ELSE 'hash is not hex' END AS reason
    FROM committed WHERE bytes % 50 = 0 OR bytes % 7 = 0 OR bytes % 11 = 0""")
def b17(spark, sf):
    broken = I.lock_committed(spark, sf).withColumns({
        "key": F.when(F.col("bytes") % 7 == 0, F.concat(F.lit("zz"), "key")).otherwise(F.col("key")),
        "hash": F.when(F.col("bytes") % 11 == 0, F.lit("")).otherwise(F.col("hash"))})
    return B.lock_validate(broken, F.when(F.col("bytes") % 50 == 0, 2).otherwise(1)).select("path", "reason")


@query("b18_lock_env", """SELECT c_custkey AS env_id, '1.4.0' AS version, CASE WHEN c_nationkey % 2 = 0 THEN 'x86_64' ELSE 'aarch64' END || '-' || CASE WHEN c_nationkey % 3 = 0 THEN 'macos' ELSE 'linux' END AS target,
    CASE c_custkey % 3 WHEN 0 THEN 'avif,heic,webp-lossy' WHEN 1 THEN 'avif,webp-lossy' ELSE '' END AS features FROM customer""")
def b18(spark, sf):
    rows = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("env_id"), E("if(c_nationkey % 2 = 0, 'x86_64', 'aarch64')").alias("arch"), E("if(c_nationkey % 3 = 0, 'macos', 'linux')").alias("os"),
        E("case c_custkey % 3 when 0 then array('webp-lossy', 'avif', 'heic') when 1 then array('webp-lossy', 'avif') else cast(array() as array<string>) end").alias("features"))
    return B.lock_env(rows, VERSION).select("env_id", "version", "target", "features")


@query("b19_content_duplicates", ctes(AS) + "SELECT sha256(content) AS hash, count(*) AS copies, min(path) AS first_path FROM assets GROUP BY content HAVING count(*) > 1")
def b19(spark, sf):
    return B.content_duplicates(I.assets(spark, sf))


@query("b20_stale_outputs", ctes(LK) + "SELECT path, key FROM committed WHERE path NOT IN (SELECT path FROM current_lock)")
def b20(spark, sf):
    return B.stale_outputs(I.lock_committed(spark, sf), I.lock_current(spark, sf)).select("path", "key")
