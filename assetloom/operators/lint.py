"""Lint: rules as Columns, findings by one projection, gates and reports.

All active rules are evaluated in a single scan: each row builds an array of
optional findings which is exploded. Severities, per-file ignores and budgets are
resolved while the plan is built, so no join or shuffle is needed to find anything.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from os.path import commonprefix

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions.paths import glob_matches, parent_dir, prefix_matches, under
from ..session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its Python functions travel with the job

C = F.col


@dataclass(frozen=True)
class Rule:
    """One rule: predicate, message and optional remedy are Columns over the facts."""
    id: str
    severity: str
    enabled: bool
    predicate: Callable[[], Column]
    message: Callable[[], Column]
    fix: Callable[[], Column] | None = None


@dataclass(frozen=True)
class Budget:
    """Limits of the paths a glob matches."""
    glob: str
    max_bytes: int | None = None
    max_width: int | None = None


@dataclass(frozen=True)
class LintConfig:
    """Effective configuration; tuples so that it can be shared and compared."""
    select: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    severity: dict[str, str] = field(default_factory=dict)
    budgets: tuple[Budget, ...] = ()
    per_file_ignores: tuple[tuple[str, tuple[str, ...]], ...] = ()
    max_width: int | None = None
    min_bytes: int = fixed.SAVINGS_MIN_BYTES
    min_percent: int = fixed.SAVINGS_MIN_PERCENT


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


ANIMATION = ": only its first frame would survive an export"
_decoded = lambda: C("decode_status") == "ok"
_deep = lambda: C("bit_depth") >= 16

RULES: dict[str, Rule] = {}


def register_rule(id_: str, severity: str, enabled: bool, predicate: Callable[[], Column],
                  message: Callable[[], Column], fix: Callable[[], Column] | None = None) -> Rule:
    """Add a rule to the registry (the user extension point)."""
    if severity not in fixed.SEVERITY_RANK:
        raise ValueError(f"unknown severity {severity}")
    RULES[id_] = Rule(id_, severity, enabled, predicate, message, fix)
    return RULES[id_]


register_rule("privacy/gps-metadata-leak", "error", True, lambda: C("has_gps"),
              lambda: _text("position of the camera is readable from the file"),
              lambda: _text("meta clean --gps"))
register_rule("size/truncated-or-corrupt", "error", True, lambda: C("decode_status") == "corrupt",
              lambda: _text("file cannot be decoded to its end; export it anew"))
register_rule("privacy/camera-metadata", "info", False, lambda: C("has_camera"),
              lambda: _text("tags name the camera that took the picture"),
              lambda: _text("meta strip"))
register_rule("orient/orientation-not-baked", "warn", True, lambda: C("orientation") != 1,
              lambda: _text("orientation tag ", C("orientation"), ": viewers must turn the picture"),
              lambda: _text("auto-orient"))
register_rule("size/oversized-bytes", "error", True, lambda: C("bytes") > C("byte_budget"),
              lambda: _text("holds ", C("bytes"), " bytes, limit here ", C("byte_budget")),
              lambda: _text("optimize"))
register_rule("dims/oversized-dimensions", "warn", True, lambda: _decoded() & (C("width") > C("intended_width")),
              lambda: _text("is ", C("width"), " pixels across, meant to be shown at ", C("intended_width")),
              lambda: _text("resize --max ", C("intended_width")))
register_rule("color/wrong-colorspace", "warn", True,
              lambda: _decoded() & (_deep() | ((C("format") == "jpeg") & (C("components") == 4))),
              lambda: F.when(_deep(), _text(C("bit_depth"), " bits a channel, more than browsers show"))
              .otherwise(_text("JPEG in ink colours, which browsers render differently")),
              lambda: _text("convert --format"))
register_rule("color/missing-icc", "info", False, lambda: _decoded() & C("icc_bytes").isNull(),
              lambda: _text("colours are undefined without a profile; state sRGB"))
register_rule("color/unexpected-icc", "info", False, lambda: C("icc_bytes") > fixed.ICC_BULKY_BYTES,
              lambda: _text("carries ", C("icc_bytes"), " bytes of colour profile, more than a page needs"),
              lambda: _text("meta strip"))
register_rule("format/animated-gif", "warn", True, lambda: _decoded() & C("animated") & (C("format") == "gif"),
              lambda: _text("moving GIF" + ANIMATION))
register_rule("format/animated-input", "warn", True,
              lambda: _decoded() & C("animated") & C("format").isin("png", "webp"),
              lambda: F.when(C("format") == "png", _text("moving PNG" + ANIMATION))
              .otherwise(_text("moving WebP" + ANIMATION)))


def rule_active(config: LintConfig, rule: Rule) -> bool:
    """Off beats everything, then ignores, then selects, then the default or an override."""
    hit = lambda prefixes: any(rule.id == p or rule.id.startswith(p + "/") for p in prefixes)
    if config.severity.get(rule.id) == "off" or hit(config.ignore):
        return False
    if config.select:
        return hit(config.select)
    return rule.enabled or rule.id in config.severity


def rules_table(configs: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """All rules beside every row of a table of configs (bounded by the rule count)."""
    entries = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("default_severity"),
                                 F.lit(r.enabled).alias("enabled")) for r in (rules or RULES).values()])
    return configs.select("*", F.explode(entries).alias("_r")).select(*configs.columns, "_r.*")


def active_rules(configs: DataFrame) -> DataFrame:
    """Active rules and severities for a table of configs.

    ``select`` / ``ignore``: arrays of prefixes; ``severity``: map rule -> override.
    """
    table = rules_table(configs)
    override = F.try_element_at("severity", C("rule"))
    hit = lambda arr: F.exists(arr, lambda p: prefix_matches(p, C("rule")))
    on = (F.when(override == "off", False).when(hit("ignore"), False)
          .when(F.size("select") > 0, hit("select"))
          .otherwise(C("enabled") | override.isNotNull()))
    return table.where(on).withColumn("severity_for", F.coalesce(override, C("default_severity")))


def merge_configs(df: DataFrame) -> DataFrame:
    """Lists extend, scalars replace; forced beats discovered beats default; no_config is default."""
    base = lambda name, default: F.when(C("no_config"), default).otherwise(
        F.coalesce(F.when(C("has_forced"), C(f"forced_{name}")).otherwise(C(f"found_{name}")), default))
    empty = F.array().cast("array<string>")
    lists = {n: F.concat(base(n, empty), F.coalesce(C(f"cli_{n}"), empty)) for n in ("select", "ignore")}
    return df.withColumns({**lists, "max_width": F.coalesce(C("cli_max_width"), base("max_width", F.lit(None).cast("int")))})


def unknown_rules(configs: DataFrame) -> DataFrame:
    """Selectors and overrides that match no rule: prefixes loosely, overrides exactly."""
    ids = F.array(*[F.lit(i) for i in RULES])
    keep = [c for c in configs.columns if c not in ("select", "ignore", "severity")]
    loose = F.transform(F.concat("select", "ignore"), lambda p: F.struct(p.alias("name"), F.lit(True).alias("loose")))
    exact = F.transform(F.map_keys("severity"), lambda p: F.struct(p.alias("name"), F.lit(False).alias("loose")))
    named = configs.select(*keep, F.explode(F.concat(loose, exact)).alias("_n")).select(*keep, "_n.*")
    known = F.exists(ids, lambda i: (C("name") == i) | (C("loose") & F.startswith(i, F.concat(C("name"), F.lit("/")))))
    return named.where(~known).drop("loose").distinct()


def budget_columns(config: LintConfig, path: Column) -> tuple[Column, Column]:
    """(byte budget, intended width): the last matching glob wins, each on its own."""
    none = F.lit(None).cast("bigint")

    def last_match(pick: Callable[[Budget], int | None], default: Column) -> Column:
        chain = None
        for b in reversed(config.budgets):
            if pick(b) is not None:
                test, value = glob_matches(path, b.glob), F.lit(pick(b)).cast("bigint")
                chain = F.when(test, value) if chain is None else chain.when(test, value)
        return default if chain is None else chain.otherwise(default)

    width = none if config.max_width is None else F.lit(config.max_width).cast("bigint")
    return last_match(lambda b: b.max_bytes, none), last_match(lambda b: b.max_width, width)


def budget_for(df: DataFrame, config: LintConfig, path: str = "path") -> DataFrame:
    """Add ``byte_budget`` and ``intended_width``."""
    size, width = budget_columns(config, C(path))
    return df.withColumns({"byte_budget": size, "intended_width": width})


def severity_for(findings: DataFrame, config: LintConfig) -> DataFrame:
    """Apply severity overrides to findings."""
    chain = C("severity")
    for rule, level in config.severity.items():
        if level != "off":
            chain = F.when(C("rule") == rule, F.lit(level)).otherwise(chain)
    return findings.withColumn("severity", chain)


def suppressed(config: LintConfig, path: Column, rule: Column | str) -> Column:
    """A per-file ignore names this exact rule for this path."""
    rule = F.lit(rule) if isinstance(rule, str) else rule
    test = F.lit(False)
    for glob, rules in config.per_file_ignores:
        test = test | (rule.isin(*rules) & glob_matches(path, glob))
    return test


def per_file_ignores(findings: DataFrame, config: LintConfig) -> DataFrame:
    """Findings that no per-file ignore suppresses."""
    return findings.where(~suppressed(config, C("file"), C("rule")))


FINDING = "array<struct<rule:string,severity:string,severity_rank:int,message:string,fix:string>>"


def findings_array(config: LintConfig, path: str = "path") -> Column:
    """All findings of a row as one array; needs the budget columns."""
    checks = []
    for rule in RULES.values():
        if not rule_active(config, rule):
            continue
        level = config.severity.get(rule.id, rule.severity)
        live = F.coalesce(rule.predicate(), F.lit(False))
        if any(rule.id in rules for _, rules in config.per_file_ignores):
            live = live & ~suppressed(config, C(path), rule.id)
        fix = rule.fix() if rule.fix else F.lit(None).cast("string")
        checks.append(F.when(live, F.struct(
            F.lit(rule.id).alias("rule"), F.lit(level).alias("severity"),
            F.lit(fixed.SEVERITY_RANK[level]).alias("severity_rank"),
            rule.message().alias("message"), fix.alias("fix"))))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast(FINDING)


def run_lint(facts: DataFrame, config: LintConfig | None = None, path: str = "path",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of all active rules, at most one per (file, rule), in one pass."""
    config = config or LintConfig()
    rows = budget_for(facts, config, path).select(C(path).alias("file"), *keep, F.explode(findings_array(config, path)).alias("_f"))
    return rows.select("file", *keep, "_f.*")


def fix_command(findings: DataFrame) -> DataFrame:
    """Remedy plus path; no remedy, no command."""
    return findings.withColumn("command", F.concat(C("fix"), F.lit(" "), C("file")))


def sort_findings(findings: DataFrame) -> DataFrame:
    """By file, severity, rule (a range-partitioned sort)."""
    return findings.orderBy("file", "severity_rank", "rule")


_LEVEL = "\x01"  # sorts before all that a name holds, so that a directory is followed by all below it


def _folder_key(folder: Column) -> Column:
    """A directory as its names, each ended by a level mark: ancestors are prefixes."""
    return F.when(folder == "", "").otherwise(F.concat(F.translate(folder, "/", _LEVEL), F.lit(_LEVEL)))


def _nearest_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks directories in order with the stack of config folders above the present one.

    A row below no config folder of its own task may still lie below some that came before: it gets the number of levels
    that it shares with the task's first directory, whose ancestors are looked up afterwards. That directory is a row of
    its own, of level -1.
    """
    stack: list[tuple[str, str, object]] = []
    first = None
    for batch in batches:
        keys, kinds, dirs, configs = (batch[n].to_pylist() for n in ("key", "kind", "dir", "config"))
        rows, opening, found, levels = [], [], [], []
        for i, key in enumerate(keys):
            if key is None:
                if kinds[i]:
                    rows.append(i), opening.append(None), found.append((None, None)), levels.append(None)
                continue
            if first is None:
                first = key
                rows.append(i), opening.append(key), found.append((None, None)), levels.append(-1)
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not kinds[i]:
                stack.append((key, dirs[i], configs[i]))
                continue
            rows.append(i), opening.append(None)
            found.append(stack[-1][1:] if stack else (None, None))
            levels.append(None if stack else commonprefix([first, key]).count(_LEVEL))  # levels that end in both
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch["p"].take(at), batch["path"].take(at), pa.array(opening, pa.string()), pa.array([d for d, _ in found], pa.string()),
                                          pa.array([c for _, c in found], batch["config"].type), pa.array(levels, pa.int32())],
                                         names=["p", "path", "key", "dir", "config", "level"])


def nearest_config(paths: DataFrame, configs: DataFrame, path: str = "path") -> DataFrame:
    """The config of the closest directory above each path.

    Paths and ``configs`` (``dir, config``; of equal ``dir`` one counts) are range-partitioned together in the order of
    directories, a directory before all below it, and each task walks its range with a stack of config folders. Paths
    are part of the order, so a directory that holds a third of them is dealt to several tasks. What lies above a whole
    range is looked up once per task, for its first directory and that one's ancestors. A null path has no config.
    """
    home = parent_dir(C(path))
    config_type = configs.schema["config"].dataType.simpleString()
    kind = paths.schema[path].dataType.simpleString()
    rows = paths.select(_folder_key(home).alias("key"), F.lit(1).alias("kind"), C(path).alias("path"), F.lit(None).cast("string").alias("dir"), F.lit(None).cast(config_type).alias("config")).union(
        configs.select(_folder_key(C("dir")), F.lit(0), F.lit(None).cast(kind), "dir", "config"))
    order = ["key", "kind", "path"]
    walked = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id())
                     .mapInArrow(_nearest_in_order, f"p int, path {kind}, key string, dir string, config {config_type}, level int"), "walked")
    names = F.split("key", _LEVEL)
    level = F.posexplode(F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/")))
    starts = walked.where("level = -1").select("p", level.alias("level", "up")).join(
        configs.groupBy("dir").agg(F.any_value("config").alias("above")).withColumn("up", C("dir")), "up", "left")
    so_far = Window.partitionBy("p").orderBy("level")
    # as many rows as tasks have levels
    open_ = starts.select("p", "level", F.last(F.when(C("dir").isNotNull(), F.struct("dir", "above")), ignorenulls=True).over(so_far).alias("_up"))
    left = walked.where("level is null or level >= 0").join(open_, ["p", "level"], "left")
    return left.select(C("path").alias(path), F.coalesce("dir", "_up.dir").alias("dir"),
                       F.when(C("dir").isNotNull(), C("config")).otherwise(C("_up.above")).alias("config"))


def savings_findings(df: DataFrame, config: LintConfig | None = None) -> DataFrame:
    """``bytes_saved`` where a better rendition clears both savings thresholds."""
    config = config or LintConfig()
    saved = C("bytes") - C("best_bytes")
    worth = (saved >= config.min_bytes) & (saved * 100 >= C("bytes") * config.min_percent)
    return df.withColumn("bytes_saved", F.when(worth, saved))


def lint_summary(facts: DataFrame, findings: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """One row of counts; files are counted on the input, not on findings."""
    files = facts.agg(F.count(F.lit(1)).alias("files_scanned"))
    level = lambda s: F.count_if(C("severity") == s)
    counts = findings.agg(level("error").alias("errors"), level("warn").alias("warnings"), level("info").alias("infos"))
    bytes_ = (saved.agg(F.coalesce(F.sum("bytes_saved"), F.lit(0)).alias("potential_bytes_saved")) if saved is not None
              else files.select(F.lit(0).cast("bigint").alias("potential_bytes_saved")))
    parts = files.unionByName(counts, allowMissingColumns=True).unionByName(bytes_, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def scan_summary(facts: DataFrame, config: LintConfig | None = None, path: str = "path") -> DataFrame:
    """The same row as ``lint_summary`` straight from facts: one scan, one partial aggregate."""
    config = config or LintConfig()
    rows = savings_findings(budget_for(facts, config, path), config).withColumn("_f", findings_array(config, path))
    count = lambda s: F.coalesce(F.sum(F.size(F.filter("_f", lambda f: f["severity"] == s))), F.lit(0)).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("files_scanned"), count("error").alias("errors"), count("warn").alias("warnings"),
                    count("info").alias("infos"), F.coalesce(F.sum("bytes_saved"), F.lit(0)).alias("potential_bytes_saved"))


def lint_gate(findings: DataFrame, max_warnings: int | None = None) -> DataFrame:
    """One row ``passed``: no errors and not too many warnings."""
    errors, warnings = F.count_if(C("severity") == "error"), F.count_if(C("severity") == "warn")
    over = F.lit(False) if max_warnings is None else warnings > max_warnings
    return findings.agg((~((errors > 0) | over)).alias("passed"), errors.alias("errors"), warnings.alias("warnings"))


def report_human(findings: DataFrame) -> DataFrame:
    """One text block per file (a file has at most one finding per rule)."""
    line = F.concat(F.lit("  "), C("severity"), F.lit(" "), C("rule"), F.lit(": "), C("message"),
                    F.coalesce(F.concat(F.lit("\n    fix: "), C("command")), F.lit("")))
    rows = fix_command(findings).groupBy("file").agg(F.array_sort(F.collect_list(
        F.struct("severity_rank", "rule", line.alias("line")))).alias("_l"))
    return rows.select("file", F.concat_ws("\n", C("file"), C("_l.line")).alias("report"))


def report_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding (JSON lines); an absent fix or saving is null. The summary is its own row elsewhere."""
    saved = C("bytes_saved") if "bytes_saved" in findings.columns else F.lit(None).cast("bigint")
    body = F.to_json(F.struct("file", "rule", "severity", "message", C("command").alias("fix"), saved.alias("bytes_saved")),
                     {"ignoreNullFields": "false"})
    return fix_command(findings).select("file", "severity_rank", "rule", body.alias("json"))


def write_report(parts: list[tuple[str, DataFrame]], head: str, tail: str, directory: str) -> None:
    """One document as numbered text files that are concatenated in order of name: head, sections of JSON rows, tail.

    ``parts`` are the opening text of a section and its rows (column ``json``). The least row of a section is written by
    itself, all others after a comma each, by the tasks that hold them; nothing is gathered.
    """
    spark = parts[0][1].sparkSession
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{directory}/00-head")
    for i, (opening, rows) in enumerate(parts, 1):
        first = spark.createDataFrame([(opening,)], "value string")
        first.coalesce(1).write.mode("overwrite").text(f"{directory}/{i:02d}-a")
        lead = rows.orderBy("json").limit(1)
        lead.select(C("json").alias("value")).coalesce(1).write.mode("overwrite").text(f"{directory}/{i:02d}-b")
        top = lead.select(C("json").alias("_first"), F.lit(1).alias("_n"))
        numbered = rows.select("json").withColumn("_copy", F.lit(1)).groupBy("json").agg(F.sum("_copy").alias("_c"))
        rest = numbered.join(F.broadcast(top), C("json") == C("_first"), "left").select(
            "json", F.explode(F.array_repeat(F.lit(0), (C("_c") - F.coalesce(C("_n"), F.lit(0))).cast("int"))))
        rest.select(F.concat(F.lit(","), "json").alias("value")).write.mode("overwrite").text(f"{directory}/{i:02d}-c")
    spark.createDataFrame([(tail,)], "value string").coalesce(1).write.mode("overwrite").text(f"{directory}/99-tail")


def write_sarif(findings: DataFrame, directory: str, tool: str = "assetloom", base: str | None = None) -> None:
    """A SARIF 2.1.0 document: the files under ``directory``, concatenated in order of path."""
    rows = report_sarif(findings, base)
    head = ('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":"%s"' % tool)
    write_report([(',"rules":[', rows.where("section = 0")), (']}},"results":[', rows.where("section = 1"))], head, "]}]}", directory)


def write_json(findings: DataFrame, facts: DataFrame, directory: str, max_warnings: int | None = None) -> None:
    """A JSON document with findings, summary and ``passed``: the files under ``directory``, in order of path."""
    summary = lint_summary(facts, findings).crossJoin(lint_gate(findings, max_warnings).select("passed")).first().asDict()  # one row
    tail = '],"summary":%s,"passed":%s}' % (json.dumps({k: v for k, v in summary.items() if k != "passed"}), json.dumps(summary["passed"]))
    write_report([('"findings":[', report_json(findings))], '{"version":1,', tail, directory)


def report_sarif(findings: DataFrame, base: str | None = None) -> DataFrame:
    """SARIF 2.1.0 results, one per row, with rule rows ahead of them (``section`` orders)."""
    level = lambda s: F.when(s == "error", "error").when(s == "warn", "warning").otherwise("note")
    uri = C("file") if base is None else F.when(
        under(C("file"), base), F.substring(C("file"), F.lit(len(base) + 2), F.length("file"))).otherwise(C("file"))
    text = F.concat(C("message"), F.coalesce(F.concat(F.lit(" — fix: "), C("command")), F.lit("")))
    location = F.struct(F.struct(F.struct(F.replace(uri, F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"))
                        .alias("physicalLocation"))
    results = fix_command(findings).select(
        F.lit(1).alias("section"), C("rule"), C("file"), F.to_json(F.struct(
            C("rule").alias("ruleId"), level(C("severity")).alias("level"), F.struct(text.alias("text")).alias("message"),
            F.array(location).alias("locations"))).alias("json"))
    defaults = F.lit("warning")
    for r in RULES.values():
        defaults = F.when(C("rule") == r.id, F.lit(fixed.SARIF_LEVEL[r.severity])).otherwise(defaults)
    rules = findings.select("rule").distinct().select(
        F.lit(0).alias("section"), "rule", F.lit(None).cast("string").alias("file"),
        F.to_json(F.struct(C("rule").alias("id"), F.struct(defaults.alias("level")).alias("defaultConfiguration"))).alias("json"))
    return rules.unionByName(results)


def with_config(config: LintConfig, **changes) -> LintConfig:
    """A copy with some fields replaced."""
    return replace(config, **changes)
