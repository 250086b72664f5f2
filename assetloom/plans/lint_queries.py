"""Lint queries over asset facts and config tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lint as L
from . import inputs as I
from .inputs import AF, AS, ctes
from .registry import query

CONFIG = L.LintConfig(
    severity={"privacy/camera-metadata": "info", "color/missing-icc": "warn", "color/unexpected-icc": "info", "format/animated-gif": "off"},
    budgets=(L.Budget("**/de/**", 1000, 900), L.Budget("**", 2000), L.Budget("assets/src1/**", 8000, 2400), L.Budget("assets/src?/en/*.PNG", None, 500)),
    per_file_ignores=(("assets/src2/**", ("privacy/gps-metadata-leak", "size/oversized-bytes")), ("**/*.txt", ("orient/orientation-not-baked",))),
    max_width=3000)

BUDGET = """bud AS (SELECT *, CASE WHEN path LIKE 'assets/src1/%' THEN 8000 ELSE 2000 END AS byte_budget,
   CASE WHEN regexp_matches(path, '^assets/src./en/.*\\.PNG$') THEN 500 WHEN path LIKE 'assets/src1/%' THEN 2400 WHEN path LIKE '%/de/%' THEN 900
        ELSE 3000 END AS intended_width FROM afacts)"""
ANIM = ": only its first frame would survive an export"
RULE_SQL = [
    ("privacy/gps-metadata-leak", "error", "has_gps", "'position of the camera is readable from the file'", "'meta clean --gps'"),
    ("size/truncated-or-corrupt", "error", "decode_status = 'corrupt'", "'file cannot be decoded to its end; export it anew'", "NULL"),
    ("privacy/camera-metadata", "info", "has_camera", "'tags name the camera that took the picture'", "'meta strip'"),
    ("orient/orientation-not-baked", "warn", "orientation <> 1", "'orientation tag ' || orientation || ': viewers must turn the picture'", "'auto-orient'"),
    ("size/oversized-bytes", "error", "bytes > byte_budget", "'holds ' || bytes || ' bytes, limit here ' || byte_budget", "'optimize'"),
    ("dims/oversized-dimensions", "warn", "decode_status = 'ok' AND width > intended_width",
     "'is ' || width || ' pixels across, meant to be shown at ' || intended_width", "'resize --max ' || intended_width"),
    ("color/wrong-colorspace", "warn", "decode_status = 'ok' AND (bit_depth >= 16 OR (format = 'jpeg' AND components = 4))",
     "CASE WHEN bit_depth >= 16 THEN bit_depth || ' bits a channel, more than browsers show' ELSE 'JPEG in ink colours, which browsers render differently' END", "'convert --format'"),
    ("color/missing-icc", "warn", "decode_status = 'ok' AND icc_bytes IS NULL", "'colours are undefined without a profile; state sRGB'", "NULL"),
    ("color/unexpected-icc", "info", "icc_bytes > 4096", "'carries ' || icc_bytes || ' bytes of colour profile, more than a page needs'", "'meta strip'"),
    ("format/animated-input", "warn", "decode_status = 'ok' AND animated AND format IN ('png','webp')",
     f"CASE WHEN format = 'png' THEN 'moving PNG' ELSE 'moving WebP' END || '{ANIM}'", "NULL"),
]
IGNORED = """NOT (path LIKE 'assets/src2/%' AND rule IN ('privacy/gps-metadata-leak', 'size/oversized-bytes'))
   AND NOT (path LIKE '%.txt' AND rule = 'orient/orientation-not-baked')"""
RAW = "raw AS (" + "\nUNION ALL ".join(
    f"SELECT path, bytes, '{r}' AS rule, '{s}' AS severity, CAST({m} AS VARCHAR) AS message, CAST({f} AS VARCHAR) AS fix FROM bud WHERE {p}"
    for r, s, p, m, f in RULE_SQL) + ")"
FOUND = f"""found AS (SELECT path AS file, rule, severity, CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS severity_rank, message, fix
   FROM raw WHERE {IGNORED})"""
BASE = ctes(AS, AF, BUDGET, RAW, FOUND)


def facts(spark, sf):
    return I.asset_facts(spark, sf)


def found(spark, sf):
    return L.run_lint(facts(spark, sf), CONFIG)


def rule_query(code: str, rule: str, sql_index: int | None, animated_gif: bool = False):
    """One rule on its own, selected by its exact id, under the shared budgets."""
    if animated_gif:
        sql = f"SELECT path AS file, 'moving GIF{ANIM}' AS message, CAST(NULL AS VARCHAR) AS fix FROM bud WHERE decode_status = 'ok' AND animated AND format = 'gif'"
    else:
        _, _, p, m, f = RULE_SQL[sql_index]
        sql = f"SELECT path AS file, CAST({m} AS VARCHAR) AS message, CAST({f} AS VARCHAR) AS fix FROM bud WHERE {p}"

    @query(f"{code}_{rule.split('/')[1].replace('-', '_')}", ctes(AS, AF, BUDGET) + sql)
    def one(spark, sf):
        only = L.LintConfig(select=(rule,), budgets=CONFIG.budgets, max_width=CONFIG.max_width)
        return L.run_lint(facts(spark, sf), only).select("file", "message", "fix")


for _i, (_rule, *_rest) in enumerate(RULE_SQL[:9]):
    rule_query(f"l{_i + 1}", _rule, _i)
rule_query("l10", "format/animated-gif", None, animated_gif=True)
rule_query("l11", "format/animated-input", 9)


@query("l12_run_lint", BASE + "SELECT * FROM found")
def l12(spark, sf):
    return found(spark, sf)


CONF = """confs AS (SELECT c_custkey AS config_id,
   CASE c_custkey % 4 WHEN 1 THEN ['privacy', 'size/oversized-bytes'] WHEN 2 THEN ['color', 'colour'] ELSE CAST([] AS VARCHAR[]) END AS sel,
   CASE c_custkey % 3 WHEN 1 THEN ['size'] WHEN 2 THEN ['privacy/gps-metadata-leak', 'privacy/gps'] ELSE CAST([] AS VARCHAR[]) END AS ign,
   (['color/missing-icc', 'privacy/camera-metadata', 'orient/orientation-not-baked', 'orient'])[c_nationkey % 4 + 1] AS ov,
   (['error', 'off', 'info'])[c_custkey % 5 % 3 + 1] AS lvl FROM customer)"""
RULES_SQL = "rules(rule, default_severity, enabled) AS (VALUES " + ", ".join(
    f"('{r.id}', '{r.severity}', {str(r.enabled).lower()})" for r in L.RULES.values()) + ")"


def configs(spark, sf):
    """One lint config per customer."""
    e = F.expr
    none = "cast(array() as array<string>)"
    return I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("config_id"),
        e(f"case c_custkey % 4 when 1 then array('privacy', 'size/oversized-bytes') when 2 then array('color', 'colour') else {none} end").alias("select"),
        e(f"case c_custkey % 3 when 1 then array('size') when 2 then array('privacy/gps-metadata-leak', 'privacy/gps') else {none} end").alias("ignore"),
        F.create_map(e("element_at(array('color/missing-icc', 'privacy/camera-metadata', 'orient/orientation-not-baked', 'orient'), c_nationkey % 4 + 1)"),
                     e("element_at(array('error', 'off', 'info'), cast(c_custkey % 5 % 3 as int) + 1)")).alias("severity"))


HIT = "len(list_filter({arr}, lambda p: rule = p OR starts_with(rule, p || '/'))) > 0"


@query("l13_active_rules", ctes(CONF, RULES_SQL) + f"""SELECT config_id, rule, CASE WHEN ov = rule THEN lvl ELSE default_severity END AS severity_for
    FROM confs, rules WHERE CASE WHEN ov = rule AND lvl = 'off' THEN false WHEN {HIT.format(arr='ign')} THEN false
    WHEN len(sel) > 0 THEN {HIT.format(arr='sel')} ELSE enabled OR ov = rule END""")
def l13(spark, sf):
    return L.active_rules(configs(spark, sf)).select("config_id", "rule", "severity_for")


@query("l14_budget_for", ctes(AS, AF, BUDGET) + "SELECT path, byte_budget, intended_width FROM bud")
def l14(spark, sf):
    return L.budget_for(facts(spark, sf), CONFIG).select("path", "byte_budget", "intended_width")


@query("l15_severity_for", BASE + """SELECT file, rule, CASE rule WHEN 'size/oversized-bytes' THEN 'info' WHEN 'color/missing-icc' THEN 'error' ELSE severity END AS severity FROM found""")
def l15(spark, sf):
    return L.severity_for(found(spark, sf), L.LintConfig(severity={
        "size/oversized-bytes": "info", "color/missing-icc": "error", "privacy/camera-metadata": "off"})).select("file", "rule", "severity")


@query("l16_per_file_ignores", BASE + """SELECT file, rule FROM found WHERE NOT (file LIKE '%/fr/%' AND rule IN ('color/missing-icc')) AND NOT (file LIKE 'assets/src1_/%' AND rule = 'privacy/camera-metadata')""")
def l16(spark, sf):
    cfg = L.LintConfig(per_file_ignores=(("**/fr/**", ("color/missing-icc",)), ("assets/src1?/**", ("privacy/camera-metadata",))))
    return L.per_file_ignores(found(spark, sf), cfg).select("file", "rule")


@query("l17_nearest_config", ctes(AS) + """, confdirs AS (SELECT 'assets' AS dir, 'root' AS config UNION
    SELECT DISTINCT 'assets/' || source, 'src:' || source FROM documents WHERE n_chars > 15000 UNION
    SELECT DISTINCT 'assets/' || source || '/' || lang, 'lang:' || source || lang FROM documents WHERE n_chars < 60)
    SELECT path, dir, config FROM assets JOIN confdirs ON starts_with(path, dir || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(dir) DESC) = 1""")
def l17(spark, sf):
    docs = I.table(spark, sf, "documents")
    dirs = docs.select(F.lit("assets").alias("dir"), F.lit("root").alias("config")).union(
        docs.where("n_chars > 15000").select(F.concat(F.lit("assets/"), "source"), F.concat(F.lit("src:"), "source"))).union(
        docs.where("n_chars < 60").select(F.concat(F.lit("assets/"), "source", F.lit("/"), "lang"), F.concat(F.lit("lang:"), "source", "lang"))).distinct()
    return L.nearest_config(I.assets(spark, sf), dirs)


MERGE = """merges AS (SELECT c_custkey AS config_id, c_custkey % 7 = 0 AS no_config, c_custkey % 3 = 0 AS has_forced, ['f1'] AS fs, ['n' || c_nationkey] AS ns,
   CASE WHEN c_custkey % 2 = 0 THEN ['cli'] END AS cs, 1000 + c_nationkey AS fw, CASE WHEN c_nationkey % 2 = 0 THEN 500 + c_nationkey END AS nw,
   CASE WHEN c_custkey % 5 = 0 THEN 42 END AS cw FROM customer)"""


@query("l18_merge_config", ctes(MERGE) + """SELECT config_id, array_to_string(list_concat(CASE WHEN no_config THEN CAST([] AS VARCHAR[]) WHEN has_forced THEN fs ELSE ns END,
    coalesce(cs, CAST([] AS VARCHAR[]))), ',') AS selected, array_to_string(CASE WHEN no_config THEN CAST([] AS VARCHAR[]) WHEN has_forced THEN ns ELSE fs END, ',') AS ignored,
    coalesce(cw, CASE WHEN no_config THEN NULL WHEN has_forced THEN fw ELSE nw END) AS max_width FROM merges""")
def l18(spark, sf):
    e, n = F.expr, F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    f1 = F.array(F.lit("f1"))
    rows = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("config_id"), e("c_custkey % 7 = 0").alias("no_config"), e("c_custkey % 3 = 0").alias("has_forced"),
        f1.alias("forced_select"), n.alias("found_select"), e("case when c_custkey % 2 = 0 then array('cli') end").alias("cli_select"),
        n.alias("forced_ignore"), f1.alias("found_ignore"), e("cast(null as array<string>)").alias("cli_ignore"),
        e("1000 + c_nationkey").alias("forced_max_width"), e("case when c_nationkey % 2 = 0 then 500 + c_nationkey end").alias("found_max_width"),
        e("case when c_custkey % 5 = 0 then 42 end").alias("cli_max_width"))
    return L.merge_configs(rows).select("config_id", F.array_join("select", ",").alias("selected"), F.array_join("ignore", ",").alias("ignored"), "max_width")


@query("l19_unknown_rules", ctes(CONF, RULES_SQL) + """SELECT DISTINCT config_id, name FROM (
    SELECT config_id, unnest(list_concat(sel, ign)) AS name, true AS loose FROM confs UNION ALL SELECT config_id, ov, false FROM confs) n
    WHERE NOT EXISTS (SELECT 1 FROM rules WHERE rule = name OR (loose AND starts_with(rule, name || '/')))""")
def l19(spark, sf):
    return L.unknown_rules(configs(spark, sf))


@query("l20_sort_findings", BASE + "SELECT file, severity_rank, rule FROM found ORDER BY ALL")
def l20(spark, sf):
    return L.sort_findings(found(spark, sf)).select("file", "severity_rank", "rule")


SAVED = "CASE WHEN bytes - best_bytes >= 4096 AND (bytes - best_bytes) * 100 >= bytes * 10 THEN bytes - best_bytes END"


@query("l21_savings_findings", ctes(AS, AF) + f"SELECT path, {SAVED} AS bytes_saved FROM afacts")
def l21_savings(spark, sf):
    return L.savings_findings(facts(spark, sf)).select("path", "bytes_saved")


SUMMARY = BASE + f"""SELECT (SELECT count(*) FROM afacts) AS files_scanned, count_if(severity = 'error') AS errors, count_if(severity = 'warn') AS warnings,
    count_if(severity = 'info') AS infos, (SELECT CAST(coalesce(sum({SAVED}), 0) AS BIGINT) FROM afacts) AS potential_bytes_saved FROM found"""


@query("l21_lint_summary", SUMMARY)
def l21(spark, sf):
    return L.scan_summary(facts(spark, sf), CONFIG)


@query("l21_lint_summary_of_findings", SUMMARY)
def l21_findings(spark, sf):
    base = facts(spark, sf)
    return L.lint_summary(base, found(spark, sf), L.savings_findings(base))


@query("l22_lint_gate", BASE + "SELECT count_if(severity = 'error') = 0 AND count_if(severity = 'warn') <= 50 AS passed, count_if(severity = 'error') AS errors, count_if(severity = 'warn') AS warnings FROM found")
def l22(spark, sf):
    return L.lint_gate(found(spark, sf), 50)


@query("l23_report_human", BASE + """SELECT file, file || chr(10) || string_agg('  ' || severity || ' ' || rule || ': ' || message || coalesce(chr(10) || '    fix: ' || fix || ' ' || file, ''),
    chr(10) ORDER BY severity_rank, rule) AS report FROM found GROUP BY file""")
def l23_human(spark, sf):
    return L.report_human(found(spark, sf))


@query("l23_report_json", BASE + """SELECT file, rule, '{"file":"' || file || '","rule":"' || rule || '","severity":"' || severity || '","message":"' || message || '"' ||
    ',"fix":' || coalesce('"' || fix || ' ' || file || '"', 'null') || ',"bytes_saved":null}' AS json FROM found""")
def l23_json(spark, sf):
    return L.report_json(found(spark, sf)).select("file", "rule", "json")


LEVEL = "CASE {0} WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END"


@query("l23_report_sarif", BASE.rstrip() + f", {RULES_SQL} " + f"""SELECT 1 AS section, rule, file, '{{"ruleId":"' || rule || '","level":"' || {LEVEL.format('severity')} || '","message":{{"text":"' || message ||
    coalesce(' — fix: ' || fix || ' ' || file, '') || '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file[8:] || '"}}}}}}]}}' AS json FROM found
    UNION ALL SELECT 0, rule, NULL, '{{"id":"' || rule || '","defaultConfiguration":{{"level":"' || {LEVEL.format('default_severity')} || '"}}}}' FROM (SELECT DISTINCT rule FROM found) JOIN rules USING (rule)""")
def l23_sarif(spark, sf):
    return L.report_sarif(found(spark, sf), "assets")


@query("l24_fix_command", BASE + "SELECT file, rule, fix || ' ' || file AS command FROM found")
def l24(spark, sf):
    return L.fix_command(found(spark, sf)).select("file", "rule", "command")
