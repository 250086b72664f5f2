"""Recipe, end-to-end and streaming queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import build as B
from ..operators import lint as L
from ..operators.benchstats import TRACE
from ..operators import recipes as P
from ..session import fresh_dir
from ..sources import outputs as SO
from ..streaming import changes as W
from ..operators.render import RenderError, render_rows
from ..streaming.rebuild import StreamBuilder, run_available
from . import inputs as I
from . import lint_queries as LQ
from .analysis_queries import ALL
from .build_queries import FEATURES, MAN, RH, STEPS, TARGETS, VERSION, EXPANDED, KEYED, manifest_targets, part_steps
from .inputs import AS, EV, PX, RFACTS, ctes
from .decide_queries import SAVE
from .quality_queries import LADDER
from .raster_queries import OUT, resample_ctes
from .registry import query
from .web import web

E = F.expr

# --- recipes -----------------------------------------------------------------
DOCS = """docs AS (SELECT p_partkey AS recipe, '[{"op":"auto-orient","params":{}},{"op":"resize","params":{"mode":"max","width":"' || (p_size * 100) || '"}}' ||
  CASE WHEN p_type = 'SMALL' THEN '' WHEN p_type = 'PROMO' THEN ',{"op":"invert","params":{}}' ELSE ',{"op":"optimize","params":{}}' END || ']' AS doc FROM part)"""


def docs(spark, sf):
    tail = F.expr("case when p_type = 'SMALL' then '' when p_type = 'PROMO' then ',{\"op\":\"invert\",\"params\":{}}' else ',{\"op\":\"optimize\",\"params\":{}}' end")
    return I.table(spark, sf, "part").select(F.col("p_partkey").alias("recipe"), F.concat(
        F.lit('[{"op":"auto-orient","params":{}},{"op":"resize","params":{"mode":"max","width":"'), (F.col("p_size") * 100).cast("string"), F.lit('"}}'), tail, F.lit("]")).alias("doc"))


@query("p1_recipe_steps", ctes(STEPS) + """SELECT recipe, step_idx, op, CASE WHEN op = 'resize' THEN json_extract_string(params, '$[1].value') END AS width FROM rsteps""")
def p1(spark, sf):
    return P.recipe_steps(docs(spark, sf)).select("recipe", "step_idx", "op", F.try_element_at("params", F.lit("width")).alias("width"))


@query("p1_round_trip", ctes(DOCS) + "SELECT recipe, doc FROM docs")
def p1_round(spark, sf):
    return P.to_recipe(P.recipe_steps(docs(spark, sf)))


BROKEN = """broken AS (SELECT c_custkey AS recipe, step_idx, CASE WHEN step_idx = 0 AND c_custkey % 5 = 0 THEN 'sharpen' WHEN step_idx = 1 THEN 'resize' WHEN step_idx = 2 THEN 'optimize' ELSE 'invert' END AS op,
  (['max', 'fit', 'percent', 'blur', NULL])[c_custkey % 5 + 1] AS mode, CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_nationkey - 4 END AS v FROM customer, (SELECT unnest(range(3)) AS step_idx))"""


@query("p2_validate_recipe", ctes(BROKEN) + """SELECT recipe, step_idx, op, reason FROM (SELECT *, CASE WHEN recipe % 31 = 0 THEN 'unsupported recipe version'
    WHEN op IN ('sharpen', 'optimize') THEN 'unknown operation ''' || op || '''' WHEN op = 'invert' THEN NULL WHEN mode IS NULL THEN '''mode'' is not given'
    WHEN mode = 'blur' THEN 'no such mode: ''blur''' WHEN mode IN ('max', 'fit') AND coalesce(v, 0) <= 0 THEN 'mode ''' || mode || ''' needs a positive ''width'''
    WHEN mode = 'percent' AND coalesce(v, 0) <= 0 THEN 'mode ''percent'' needs a positive ''percent''' END AS reason FROM broken) WHERE reason IS NOT NULL""")
def p2(spark, sf):
    rows = I.table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("step_idx"))
    v = E("if(c_nationkey % 3 = 0, null, cast(c_nationkey - 4 as string))")
    mode = E("element_at(array('max', 'fit', 'percent', 'blur', null), cast(c_custkey % 5 as int) + 1)")
    params = F.map_filter(F.create_map(F.lit("mode"), mode, F.lit("width"), v, F.lit("height"), v, F.lit("percent"), v), lambda k, x: x.isNotNull())
    steps = rows.select(F.col("c_custkey").alias("recipe"), "step_idx", E(
        "case when step_idx = 0 and c_custkey % 5 = 0 then 'sharpen' when step_idx = 1 then 'resize' when step_idx = 2 then 'optimize' else 'invert' end").alias("op"), params.alias("params"))
    return P.validate_recipe(steps, F.when(F.col("recipe") % 31 == 0, "2").otherwise("1"))


CHAIN = [("invert", {}), ("resize", {"mode": "exact", "width": "16", "height": "16"}), ("identity", {})]


@query("p3_apply_recipe", ctes(PX, "inv AS (SELECT asset_id, w, h, x, y, 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM px)", resample_ctes("inv", "16", "16")) + f"SELECT {OUT} FROM resampled")
def p3(spark, sf):
    return P.apply_recipe(I.pixels(spark, sf), CHAIN)


@query("p4_split_terminal", ctes(STEPS) + "SELECT recipe, step_idx, op, op = 'optimize' AND step_idx = max(step_idx) OVER (PARTITION BY recipe) AS terminal FROM rsteps")
def p4(spark, sf):
    return P.split_terminal(part_steps(spark, sf)).drop("params")


BUNDLED_SQL = "bundled(name, doc) AS (VALUES " + ", ".join(
    f"('{n}', '" + json.dumps([{"op": o, "params": p} for o, p in P.bundled(n)], separators=(",", ":")) + "')" for n in ("web", "gallery", "product")) + ")"


@query("p5_bundled_recipes", ctes(BUNDLED_SQL, "files AS (SELECT DISTINCT CASE n_name WHEN 'NATION_3' THEN 'web' ELSE n_name END AS name, '[]' AS doc FROM nation)") + """SELECT c_custkey AS request, w.name,
    CASE WHEN f.name IS NOT NULL THEN 'file' WHEN b.name IS NOT NULL THEN 'bundled' END AS origin, coalesce(f.doc, b.doc) AS doc
    FROM (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'gallery' WHEN 2 THEN 'product' ELSE 'NATION_' || c_nationkey END AS name FROM customer) w LEFT JOIN files f USING (name) LEFT JOIN bundled b USING (name)""")
def p5(spark, sf):
    req = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("request"), E(
        "case c_nationkey % 4 when 0 then 'web' when 1 then 'gallery' when 2 then 'product' else concat('NATION_', c_nationkey) end").alias("name"))
    files = I.table(spark, sf, "nation").select(E("if(n_name = 'NATION_3', 'web', n_name)").alias("recipe"), F.lit("[]").alias("doc")).distinct()
    return P.resolve_recipes(req, files).select("request", "name", "origin", "doc")


@query("p6_canonical_chain", """SELECT o_orderkey AS request, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'auto-orient' END, CASE WHEN o_custkey % 3 = 0 THEN 'resize:' || (o_custkey + 1) END, CASE WHEN o_orderstatus = 'F' THEN 'invert' END) AS ops,
    CASE WHEN o_orderkey % 2 <> 0 AND o_custkey % 3 <> 0 AND o_orderstatus <> 'F' THEN 'nothing to do: no operation was asked for' END AS reason FROM orders""")
def p6(spark, sf):
    req = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_orderkey") % 2 == 0).alias("auto_orient"),
                                              E("case when o_custkey % 3 = 0 then o_custkey + 1 end").alias("resize_max"), (F.col("o_orderstatus") == "F").alias("invert"))
    return P.canonical_chain(req).select("request", F.array_join("ops", ",").alias("ops"), "reason")


@query("p7_batch_apply", ctes(PX, RFACTS) + """SELECT asset_id, error, count(*) AS pixels, CAST(sum(CASE WHEN error IS NULL THEN 255 - r ELSE r END) AS BIGINT) AS red FROM (
    SELECT px.*, CASE WHEN source_format = 'ico' THEN 'unsupported' WHEN width < 100 THEN 'too small' END AS error FROM px JOIN rfacts USING (asset_id)) GROUP BY ALL""")
def p7(spark, sf):
    """A recipe over all lines; lines of assets that a check refuses keep their samples and the reason."""
    facts = I.raster_facts(spark, sf).select("asset_id", "source_format", "width")
    kept, failed = SO.split_failures(I.lines(spark, sf).join(facts, "asset_id"), {"unsupported": F.col("source_format") == "ico", "too small": F.col("width") < 100})
    done = P.apply_recipe_lines(kept, [("invert", {}), ("identity", {})]).withColumn("error", F.lit(None).cast("string"))
    return done.unionByName(failed).groupBy("asset_id", "error").agg(F.sum(F.size(F.array_compact("r"))).alias("pixels"), F.sum(P.line_sum("r")).alias("red"))


MENU = [("lossy", "false", "avif:lossy webp:lossy jpeg:lossy"), ("lossy", "true", "avif:lossy webp:lossy webp:lossless png:lossless"),
        ("lossless-flat", "false", "webp:lossless png:lossless"), ("lossless-flat", "true", "webp:lossless png:lossless"),
        ("mixed-safe", "false", "avif:lossy webp:lossy webp:lossless png:lossless jpeg:lossy"), ("mixed-safe", "true", "avif:lossy webp:lossy webp:lossless png:lossless")]
TARGET, BUDGET = 97.0, 180


def web_sql(mode: str, edge: int, hist: str) -> str:
    """Twin of the end-to-end flow over the ladder of ``hist``: every entry solved, then ranked."""
    rows = []
    for bucket, alpha, text in MENU:
        names = text.split()
        if mode != "fast" and names[0] == "avif:lossy":
            names = names[1:] + (["avif:lossy"] if mode == "size-budget" else [])
        rows += [f"('{bucket}', {alpha}, {i}, '{n.split(':')[0]}', '{n.split(':')[1]}')" for i, n in enumerate(names)]
    ok = {"fast": "q = CASE WHEN lossy THEN 85 ELSE 100 END", "perceptual": f"CASE WHEN lossy THEN metric >= {TARGET} ELSE q = 100 END",
          "size-budget": f"(lossy OR q = 100) AND b <= {BUDGET}"}[mode]
    rest = {"fast": "q", "perceptual": "CASE WHEN ok THEN q ELSE -q END", "size-budget": "CASE WHEN ok THEN -q WHEN lossy THEN q ELSE -q END"}[mode]
    fits = f"list_max(list_filter(range(1, 101), lambda p: ceil(b * p * p / 10000.0::DOUBLE) <= {BUDGET}))"
    pct = f"CASE WHEN ok THEN 100 ELSE coalesce({fits}, 1) END" if mode == "size-budget" else "100"
    met = f"ok OR {fits} IS NOT NULL" if mode == "size-budget" else "ok"
    return LADDER.replace("FROM hist,", f"FROM {hist},") + f""",
menu(bucket, has_alpha, cand_idx, fmt, disposition) AS (VALUES {", ".join(rows)}),
factor(fmt, disposition, f) AS (VALUES ('avif', 'lossy', 0.5), ('webp', 'lossy', 0.7), ('jpeg', 'lossy', 0.9), ('webp', 'lossless', 0.95), ('png', 'lossless', 1.0)),
cl AS (SELECT * REPLACE (CASE WHEN source_format = 'ico' THEN 'ico' WHEN asset_id % 4 = 0 THEN 'jpeg' WHEN asset_id % 4 = 1 THEN 'webp' ELSE 'png' END AS source_format),
   200 + (asset_id % 9) * 60 AS source_bytes, source_alpha AS has_alpha, has_exif OR width > {edge} AS altered FROM classed),
listed AS (SELECT asset_id, cand_idx, fmt, disposition FROM cl JOIN menu USING (bucket, has_alpha) UNION ALL
   SELECT asset_id, 1000, CASE source_format WHEN 'webp' THEN 'webp' ELSE 'jpeg' END, 'lossy' FROM cl
   WHERE bucket = 'lossless-flat' AND (source_format = 'webp' OR (source_format = 'jpeg' AND NOT has_alpha))),
sized AS (SELECT *, disposition = 'lossy' AS lossy, CAST(round(bytes * f::DOUBLE) AS BIGINT) AS b FROM listed JOIN factor USING (fmt, disposition) JOIN ladder USING (asset_id)),
best AS (SELECT *, {ok} AS ok FROM sized QUALIFY row_number() OVER (PARTITION BY asset_id, cand_idx ORDER BY ok DESC, {rest}) = 1),
tr AS (SELECT * EXCLUDE (bytes, metric), CASE WHEN lossy THEN q END AS quality, CAST(ceil(b * pct * pct / 10000.0::DOUBLE) AS BIGINT) AS bytes, CASE WHEN pct = 100 AND lossy THEN metric END AS metric
   FROM (SELECT *, {met} AS met, {pct} AS pct FROM best) JOIN (SELECT asset_id, source_bytes, source_format FROM cl) USING (asset_id)),
el AS (SELECT * FROM tr WHERE met AND bytes < source_bytes AND cand_idx < 1000 QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY bytes, cand_idx) = 1),
sm AS (SELECT * FROM tr WHERE met AND bytes < source_bytes AND cand_idx < 1000 AND fmt = source_format QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY bytes, cand_idx) = 1),
anyc AS (SELECT * FROM tr QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY bytes, cand_idx) = 1),
branched AS (SELECT c.*, e.cand_idx AS ei, s.cand_idx AS si, x.cand_idx AS xi, CASE WHEN e.asset_id IS NULL THEN CASE WHEN altered THEN 'forced' ELSE 'pass-through' END
   WHEN e.fmt = c.source_format THEN 'same-format' WHEN s.asset_id IS NULL THEN 'switch-no-rival' WHEN (s.bytes - e.bytes)::DOUBLE / s.bytes < 0.05 THEN 'guard-kept' ELSE 'switch' END AS branch
   FROM cl c LEFT JOIN el e USING (asset_id) LEFT JOIN sm s USING (asset_id) LEFT JOIN anyc x USING (asset_id)),
won AS (SELECT w.*, t.fmt, t.disposition, t.quality, t.metric, coalesce(t.bytes, w.source_bytes) AS out_bytes FROM (
   SELECT *, CASE branch WHEN 'forced' THEN xi WHEN 'pass-through' THEN NULL WHEN 'guard-kept' THEN si ELSE ei END AS winner FROM branched) w
   LEFT JOIN tr t ON t.asset_id = w.asset_id AND t.cand_idx = w.winner)"""


ORIENTED = """opx AS (SELECT asset_id, 32 AS w, 32 AS h, CASE asset_id % 8 WHEN 1 THEN 31-x WHEN 2 THEN 31-x WHEN 4 THEN y WHEN 5 THEN 31-y WHEN 6 THEN 31-y WHEN 7 THEN y ELSE x END AS x,
   CASE asset_id % 8 WHEN 2 THEN 31-y WHEN 3 THEN 31-y WHEN 4 THEN x WHEN 5 THEN x WHEN 6 THEN 31-x WHEN 7 THEN 31-x ELSE y END AS y, r, g, b, a FROM px)"""


def web_decisions(spark, sf, mode="fast", max_edge=24):
    """The flow over the mosaics, of which some claim to be lossy files."""
    fmt = E("case when source_format = 'ico' then 'ico' when asset_id % 4 = 0 then 'jpeg' when asset_id % 4 = 1 then 'webp' else 'png' end")
    facts = I.raster_facts(spark, sf).withColumns({"source_bytes": (F.col("asset_id") % 9) * 60 + 200, "source_format": fmt})
    return web(I.lines(spark, sf), facts, max_edge=max_edge, mode=mode, target=TARGET, budget=BUDGET)


WEB = ALL.rstrip() + ", "
BOUNDED = ORIENTED + ",\n" + resample_ctes("opx", "24", "24") + """,
histr AS (SELECT asset_id, (77 * r + 150 * g + 29 * b) >> 8 AS luma, count(*) AS n FROM resampled GROUP BY ALL),
"""
WON = " SELECT asset_id, class, bucket, fmt, disposition, quality, source_bytes, out_bytes, branch, round(metric, 6) AS verify_score FROM won"


def decided(df):
    return df.select("asset_id", "class", "bucket", "fmt", "disposition", "quality", "source_bytes", "out_bytes", "branch", F.round("verify_score", 6).alias("verify_score"))


@query("p8_web", WEB + BOUNDED + web_sql("fast", 24, "histr") + WON)
def p8(spark, sf):
    return decided(web_decisions(spark, sf))


@query("p8_web_perceptual", WEB + web_sql("perceptual", 100, "hist") + WON)
def p8_perceptual(spark, sf):
    return decided(web_decisions(spark, sf, "perceptual", 100))


@query("p8_web_size_budget", WEB + web_sql("size-budget", 100, "hist") + WON)
def p8_budget(spark, sf):
    return decided(web_decisions(spark, sf, "size-budget", 100))


@query("p8_web_traces", WEB + BOUNDED + web_sql("fast", 24, "histr") + f""", tried AS (SELECT t.asset_id, string_agg(concat_ws(':', t.fmt, t.disposition, t.quality, t.bytes, t.met), ' ' ORDER BY t.cand_idx) AS candidates
    FROM tr t JOIN won w USING (asset_id) WHERE t.cand_idx < 1000 OR w.branch = 'forced' GROUP BY t.asset_id)
    SELECT asset_id, source_format, 'fast' AS mode, source_bytes, winner, out_bytes, {SAVE} AS savings_percent, candidates, class, has_alpha, unique_colors, round(metric, 1) AS ssim
    FROM won JOIN tried USING (asset_id)""")
def p8_traces(spark, sf):
    """What the JSON traces say."""
    t = web_decisions(spark, sf).select("asset_id", F.from_json("trace", TRACE + ", class STRING, has_alpha BOOLEAN, features STRUCT<unique_colors: BIGINT>, ssim DOUBLE").alias("t"))
    listed = F.transform("t.candidates", lambda c: F.concat_ws(":", c["format"], c["disposition"], c["quality"], c["bytes"], c["met_target"].cast("string")))
    return t.select("asset_id", "t.source_format", "t.mode", "t.source_bytes", "t.winner", "t.out_bytes", "t.savings_percent",
                    F.array_join(listed, " ").alias("candidates"), "t.class", "t.has_alpha", "t.features.unique_colors", "t.ssim")


# --- change feeds --------------------------------------------------------------
EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
DOCS_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def table_stream(spark, sf, name, schema):
    """A given table as a stream, be it one file or a folder of files (hence a glob path)."""
    return W.asset_stream(spark, f"{sf}/{name}.parque[t]", schema, fmt="parquet")


def change_stream(spark, sf):
    """The events table as a stream of file changes."""
    return table_stream(spark, sf, "events", EVENTS_SCHEMA).select(*I.change_columns())


def drained(spark, stream, name, mode="append"):
    """Run a stream over all available input into the shared folder and read the result back."""
    out = fresh_dir(spark, name)
    run_available(stream, f"{out}/checkpoint", f"{out}/rows", mode=mode)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("w1_watch_roots", ctes(MAN) + """, roots AS (SELECT DISTINCT kind, path FROM (
    SELECT 'recursive' AS kind, unnest(list_transform(source, lambda s: CASE WHEN starts_with(s, 'assets/') THEN 'assets/' || string_split(s, '/')[2] WHEN s = 'photos/' THEN 'photos' ELSE '.' END)) AS path FROM man
    UNION ALL SELECT 'shallow', '.' FROM man UNION ALL SELECT 'excluded', unnest([CASE out_dir WHEN '' THEN '.' WHEN './dist/' THEN 'dist' WHEN 'a/../../b' THEN '../b' ELSE out_dir END, '.cache', 'build.lock']) FROM man))
    SELECT kind, path FROM roots WHERE NOT (kind = 'shallow' AND path IN (SELECT path FROM roots WHERE kind = 'recursive'))""")
def w1(spark, sf):
    return W.watch_roots(manifest_targets(spark, sf))


@query("w2_asset_stream", ctes(EV) + "SELECT path, event_time, value FROM changes")
def w2(spark, sf):
    return ntz(drained(spark, change_stream(spark, sf), "arrivals").select("path", "event_time", "value"), "event_time")


OWN = ["src/u1", "src/u2/error", "src/u30", "out"]


@query("w3_exclude_own_writes", ctes(EV) + "SELECT path, event_time FROM changes WHERE NOT (starts_with(path, 'src/u1/') OR path = 'src/u2/error' OR starts_with(path, 'src/u30/'))")
def w3(spark, sf):
    return ntz(W.exclude_own_writes(I.changes(spark, sf), OWN).select("path", "event_time"), "event_time")


@query("w3_exclude_own_writes_stream", ctes(EV) + "SELECT path, event_time FROM changes WHERE NOT (starts_with(path, 'src/u1/') OR path = 'src/u2/error' OR starts_with(path, 'src/u30/'))")
def w3_stream(spark, sf):
    return ntz(drained(spark, W.exclude_own_writes(change_stream(spark, sf), OWN).select("path", "event_time"), "foreign"), "event_time")


def sessions_sql(keys: str, gap: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"{keys}, " if keys else ""
    return f"""marks AS (SELECT *, CASE WHEN event_time - lag(event_time) OVER ({part} ORDER BY event_time) <= INTERVAL '{gap}' THEN 0 ELSE 1 END AS o FROM changes),
    nums AS (SELECT *, sum(o) OVER ({part} ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS s FROM marks),
    sess AS (SELECT {group}min(event_time) AS first_change, max(event_time) AS last_change, count(*) AS changes FROM nums GROUP BY {group}s)"""


@query("w4_debounce", ctes(EV, sessions_sql("user_id", "6 hours")) + "SELECT * FROM sess")
def w4(spark, sf):
    return ntz(W.debounce(I.changes(spark, sf), 6 * 3600, ["user_id"]), "first_change", "last_change")


@query("w4_debounce_global", ctes(EV, sessions_sql("", "30 seconds")) + "SELECT * FROM sess")
def w4_global(spark, sf):
    return ntz(W.debounce(I.changes(spark, sf), 30), "first_change", "last_change")


@query("w4_debounce_stream", ctes(EV, sessions_sql("user_id", "6 hours")) + """SELECT * FROM sess
    WHERE last_change + INTERVAL '6 hours' <= (SELECT date_trunc('millisecond', max(event_time)) - INTERVAL '10 minutes' FROM changes)""")
def w4_stream(spark, sf):
    sessions = W.debounce_stream(change_stream(spark, sf), "6 hours", "10 minutes", ["user_id"])
    return ntz(drained(spark, sessions, "sessions"), "first_change", "last_change")


@query("w4_debounce_global_stream", """WITH t AS (SELECT CAST(ts AS TIMESTAMP) AS t FROM events), o AS (SELECT t, t - lag(t) OVER (ORDER BY t) > INTERVAL '10 minutes' AS gap FROM t),
    g AS (SELECT t, sum(coalesce(gap, true)::INT) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT min(t) AS first_change, max(t) AS last_change, count(*) AS changes FROM g GROUP BY k
    HAVING max(t) + INTERVAL '10 minutes' <= (SELECT date_trunc('millisecond', max(t)) - INTERVAL '10 minutes' FROM t)""")
def w4_global_stream(spark, sf):
    """All changes as one feed, in bursts."""
    feed = W.BurstFeed(spark, fresh_dir(spark, "bursts"), 600, 600)
    run_available(change_stream(spark, sf), f"{feed.root}/checkpoint", each=feed)
    return ntz(feed.bursts(), "first_change", "last_change")


@query("w5_late_data", ctes(EV) + """SELECT event_type, start, start + INTERVAL '1 hour' AS "end", count(*) AS changes FROM (SELECT *, date_trunc('hour', event_time) AS start FROM changes)
    WHERE start + INTERVAL '1 hour' <= (SELECT date_trunc('millisecond', max(event_time)) - INTERVAL '30 minutes' FROM changes) GROUP BY ALL""")
def w5(spark, sf):
    counts = W.windowed_counts(change_stream(spark, sf), "1 hour", delay="30 minutes", keys=["event_type"])
    return ntz(drained(spark, counts, "hourly"), "start", "end")


def doc_stream(spark, sf):
    """Documents arriving as assets."""
    return I.assets_from(table_stream(spark, sf, "documents", DOCS_SCHEMA))


def builder(spark, root, targets=lambda: TARGETS, failing=None):
    """Streaming builder with the stand-in renderer."""
    prepare = lambda d: B.with_keys(d.withColumn("recipe_hash", F.lit(RH)), VERSION, FEATURES)
    body = F.concat(F.lit("out:"), "content")
    render = lambda d: d.select("key", F.lit("webp").alias("ext"), body.cast("binary").alias("payload"),
                                F.octet_length(body).cast("bigint").alias("payload_len"), F.sha2(body, 256).alias("payload_hash"))
    return StreamBuilder(spark, root, targets, prepare, render, failing)


def build_stream(spark, sf):
    root = fresh_dir(spark, "rebuild")
    run = builder(spark, root, failing=lambda: F.col("bytes") < 50)
    run_available(doc_stream(spark, sf), f"{root}/checkpoint", each=run)
    return run


CLAIMS = """claims AS (SELECT *, row_number() OVER (PARTITION BY out_path ORDER BY target_idx, pattern_idx, path) AS claim FROM keyed WHERE bytes >= 50)"""


@query("w6_stream_build", ctes(AS, EXPANDED, KEYED, CLAIMS) + "SELECT out_path, key FROM claims WHERE claim = 1")
def w6(spark, sf):
    return build_stream(spark, sf).outputs().select("out_path", "key")


@query("w6_collisions", ctes(AS, EXPANDED, KEYED, CLAIMS) + "SELECT asset_id, path, 'output claimed twice: ' || out_path AS reason FROM claims WHERE claim > 1")
def w6_collisions(spark, sf):
    aside = build_stream(spark, sf).quarantined().where(F.col("reason").startswith("output"))
    return aside.select("asset_id", "path", "reason")


@query("w7_quarantine", ctes(AS) + "SELECT asset_id, path FROM assets WHERE bytes < 50")
def w7(spark, sf):
    return build_stream(spark, sf).quarantined().where("reason = 'check failed'").select("asset_id", "path")


@query("w7_render_errors", ctes(AS, EXPANDED, KEYED, CLAIMS) + """SELECT asset_id, path, 'cannot render ' || bytes || ' bytes' AS error FROM claims
    WHERE claim = 1 AND bytes % 17 = 0""")
def w7_render_errors(spark, sf):
    """Rows that a row renderer refuses (a length that 17 divides), set aside by one job per batch."""
    def render(row: dict) -> tuple[str, bytes]:
        if row["bytes"] % 17 == 0:
            raise RenderError(f"cannot render {row['bytes']} bytes")
        return "webp", b"out:" + row["content"].encode()
    root = fresh_dir(spark, "rebuild")
    run = builder(spark, root, failing=lambda: F.col("bytes") < 50)
    run.render = lambda todo: render_rows(todo, render, ["bytes", "content"])
    run_available(doc_stream(spark, sf), f"{root}/checkpoint", each=run)
    return run.quarantined().where("reason = 'render failed'").select("asset_id", "path", "error")


@query("w10_stream_dedup", ctes(EV) + "SELECT DISTINCT path FROM changes")
def w10(spark, sf):
    return drained(spark, W.dedup_stream(change_stream(spark, sf), ["path"], "30 days").select("path"), "dedup")


@query("w10_stream_dedup_content", "SELECT DISTINCT sha256(props) AS content_hash FROM events")
def w10_content(spark, sf):
    """Content that has arrived before is no work, under whatever path it comes."""
    arrivals = table_stream(spark, sf, "events", EVENTS_SCHEMA).select(F.sha2("props", 256).alias("content_hash"), F.col("ts").cast("timestamp").alias("event_time"))
    return drained(spark, W.dedup_stream(arrivals, ["content_hash"], "30 days").select("content_hash"), "contents")


@query("w11_stream_lint", LQ.BASE + "SELECT rule, severity, count(*) AS findings FROM found GROUP BY ALL")
def w11(spark, sf):
    facts = table_stream(spark, sf, "documents", DOCS_SCHEMA)
    rows = L.run_lint(I.facts_from(facts), LQ.CONFIG)
    return drained(spark, rows, "findings").groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query("w11_tumbling_counts", ctes(EV) + """SELECT date_trunc('day', event_time) AS start, date_trunc('day', event_time) + INTERVAL '1 day' AS "end", count(*) AS changes FROM changes GROUP BY ALL""")
def w11_tumbling(spark, sf):
    return ntz(W.windowed_counts(I.changes(spark, sf), "1 day"), "start", "end")


@query("w11_sliding_counts", ctes(EV) + """SELECT event_type, start, start + INTERVAL '2 hours' AS "end", count(*) AS changes FROM (
    SELECT event_type, date_trunc('hour', event_time) - INTERVAL '1 hour' * k AS start FROM changes, (SELECT unnest([0, 1]) AS k)) GROUP BY ALL""")
def w11_sliding(spark, sf):
    return ntz(W.windowed_counts(I.changes(spark, sf), "2 hours", "1 hour", keys=["event_type"]), "start", "end")
