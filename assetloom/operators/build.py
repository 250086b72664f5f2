"""Incremental, content-addressed builds over tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import hashing
from ..functions.paths import expand_template, extension, glob_matches, lexical_clean
from ..functions.scalars import is_image_ext, plural, short_hash
from ..schemas import require
from .skew import dealt_join

C = F.col
DEFAULT_TEMPLATE = "{stem}.{ext}"


@dataclass(frozen=True)
class Target:
    """One build target; at most 1024 per manifest."""
    source: tuple[str, ...]
    recipe: str
    out: str
    name: str | None = None


def _resolves(path: str, pattern: str, extra: list[str] | None) -> Column:
    """Whether a source entry takes a path: a named file always, a directory or glob only images.

    A directory (trailing slash) lists its top level.
    """
    wild = any(c in pattern for c in "*?[")
    glob = pattern + "*" if pattern.endswith("/") and not wild else pattern
    hit = glob_matches(C(path), glob, crosses_slash=False)
    return hit & is_image_ext(extension(C(path)), extra) if wild or glob != pattern else hit


def expand_targets(assets: DataFrame, targets: list[Target], path: str = "path", extra: list[str] | None = None) -> DataFrame:
    """Assets x matching source patterns, duplicates kept, ordered by target, pattern, path.

    Patterns are literals of the plan, compiled once per task: one scan of the
    assets, no join, and rows only for real matches. Entries resolve like a scan:
    globs and directories take image extensions (and ``extra``) only.
    """
    if len(targets) > fixed.MANIFEST_MAX_TARGETS:
        raise ValueError(f"more targets than a manifest may have ({len(targets)})")
    entries = []
    for t_idx, target in enumerate(targets):
        for p_idx, pattern in enumerate(target.source):
            entries.append(F.when(_resolves(path, pattern, extra), F.struct(
                F.lit(t_idx).alias("target_idx"), F.lit(p_idx).alias("pattern_idx"),
                F.lit(target.recipe).alias("recipe"), F.lit(target.out).alias("out"),
                F.lit(target.name or DEFAULT_TEMPLATE).alias("template"))))
    return assets.select("*", F.explode(F.array_compact(F.array(*entries))).alias("_t")).select(
        *assets.columns, "_t.*")


def empty_targets(expanded: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that matched nothing (an error in a build)."""
    return targets.join(expanded.select("target_idx").distinct(), "target_idx", "left_anti")


def validate_targets(targets: DataFrame) -> DataFrame:
    """Add the first reason a target is invalid (NULL when fine)."""
    require(targets, "source", "recipe", "out", "name")
    blank = lambda c: F.trim(c) == ""
    first_bad = F.get(F.filter("source", lambda s: blank(s) | (s == "-")), F.lit(0))
    clean = lexical_clean(C("out"))
    return targets.withColumn("reason", (
        F.when(F.size("source") == 0, "no entry under `source`")
        .when(first_bad == "-", "`source` names standard input, which a build cannot repeat")
        .when(first_bad.isNotNull(), "an entry of `source` is blank")
        .when(blank(C("recipe")), "`recipe` is blank")
        .when(blank(C("out")), "`out` is blank")
        .when((clean == "..") | clean.startswith("../"), F.concat(F.lit("`out` leads above the project: "), "out"))
        .when(clean.startswith("/"), F.concat(F.lit("`out` is not relative to the project: "), "out"))
        .when(C("name").isNotNull() & blank(C("name")), "`name` is blank")))


def validate_manifests(targets: DataFrame) -> DataFrame:
    """Manifest-level reasons: version, then target count."""
    counted = targets.groupBy("manifest").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("targets"))
    return counted.withColumn("reason", (
        F.when(C("version") != fixed.MANIFEST_VERSION, F.concat(
            F.lit("manifests of this version are unknown: "), C("version").cast("string")))
        .when(C("targets") > fixed.MANIFEST_MAX_TARGETS, F.concat(
            F.lit("more targets than a manifest may have ("), C("targets").cast("string"), F.lit(")")))))


def output_paths(expanded: DataFrame, ext: Column | str, path: str = "path") -> DataFrame:
    """Add ``out_path``; pass '{ext}' to leave the extension symbolic."""
    out_dir = lexical_clean(C("out"))
    return expanded.withColumn("out_path", F.concat(out_dir, F.lit("/"), expand_template(C("template"), C(path), ext)))


def output_collisions(inputs: DataFrame, order: list[str], label: str = "path") -> DataFrame:
    """Outputs claimed twice: first and second claimant in build order.

    ``row_number <= 2`` is limited before the shuffle in every task, so an output
    claimed by a third of all rows still ships two rows per task.
    """
    win = Window.partitionBy("out_path").orderBy(*order, label)
    two = inputs.select("out_path", label, *order).withColumn("_rn", F.row_number().over(win)).where("_rn <= 2")
    pairs = two.groupBy("out_path").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(label, "_rn").alias("first"), F.max_by(label, "_rn").alias("second"),
        F.max_by(F.struct(*order, label), "_rn").alias("_ord"))
    return pairs.where("_n = 2").select("out_path", "first", "second", "_ord")


def first_collision(inputs: DataFrame, order: list[str], label: str = "path") -> DataFrame:
    """The earliest collision in build order (at most one row)."""
    return output_collisions(inputs, order, label).orderBy("_ord").limit(1).drop("_ord")


def recipe_hash(steps: DataFrame, plan: Column | str = "preserve") -> DataFrame:
    """Digest of a recipe's canonical steps with its format plan folded in, framed.

    Only parsed content counts: ops in order and sorted params. A recipe has at
    most 1024 steps, which bounds the gathered list.
    """
    plan = F.lit(plan) if isinstance(plan, str) else plan
    params = F.array_sort(F.map_entries("params"))
    docs = steps.groupBy("recipe").agg(F.to_json(F.array_sort(F.collect_list(
        F.struct("step_idx", "op", params.alias("params"))))).alias("canonical"))
    return docs.select("recipe", "canonical", F.sha2(F.concat(
        hashing.frame(0, C("canonical")), hashing.frame(1, plan)), 256).alias("recipe_hash"))


def hash_contents(assets: DataFrame, content: str = "content") -> DataFrame:
    """Add ``content_hash``; do this before expansion so that each asset is hashed once."""
    return assets.withColumn("content_hash", hashing.content_hash(C(content)))


def with_keys(inputs: DataFrame, version: str, features: str, content: str = "content",
              quality: Column | None = None) -> DataFrame:
    """Add ``key`` (and ``content_hash`` where absent); needs ``recipe_hash`` and ``ext``."""
    hashed = inputs if "content_hash" in inputs.columns else hash_contents(inputs, content)
    require(hashed, "recipe_hash", "ext", "content_hash")
    level = F.lit(None).cast("int") if quality is None else quality
    return hashed.withColumn("key", hashing.cache_key(
        version, features, C("recipe_hash"), level, C("ext"), C("content_hash")))


def verify_cache(cache: DataFrame, keys: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    """Entries whose length and digest hold (and which have at most ``max_bytes``); all else is a miss.

    With ``keys``, only entries of those keys are read and hashed: the cost follows the lookups, not the store.
    """
    wanted = cache if keys is None else cache.join(keys.select("key").distinct(), "key", "left_semi")
    sound = (F.octet_length("payload") == C("payload_len")) & (F.sha2("payload", 256) == C("payload_hash"))
    return wanted.where(sound if max_bytes is None else sound & (C("payload_len") <= max_bytes))


def plan_build(inputs: DataFrame, cache: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """Mark each input ``cached`` or ``rebuild``.

    Inputs collapse to their distinct keys, which meet the cache's keys once; only keys found there go back to the
    inputs. A key of more than ``rows_per_task`` inputs is dealt in as many parts as its count asks for, so copies of
    one popular content spread over tasks while every other key crosses the shuffle once.
    """
    counted = inputs.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    hits = counted.join(cache.select("key").distinct(), "key", "left_semi")
    parts = F.ceil(C("_n") / rows_per_task).cast("int")
    known = hits.select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"), F.lit(True).alias("_hit"))
    hot = hits.where(parts > 1).select("key", parts.alias("_parts"))  # at most one key per rows_per_task inputs
    spread = F.xxhash64(*[c for c in ("path", "out_path") if c in inputs.columns])
    dealt = inputs.join(hot, "key", "left").withColumn("_part", F.coalesce(F.pmod(spread, C("_parts")).cast("int"), F.lit(0)))
    return dealt.join(known, ["key", "_part"], "left").withColumn(
        "status", F.when(C("_hit"), "cached").otherwise("rebuild")).drop("_hit", "_part", "_parts")


def work_list(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """One row per key still to be built (identical work is done once).

    Inputs collapse to keys before the join, so content copied to a third of all
    paths meets the cache as a single row.
    """
    keys = inputs.groupBy("key").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("outputs"))
    return keys.join(cache.select("key"), "key", "left_anti")


def materialize(plan: DataFrame, cache: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """Payload of every planned output, one cached entry feeding many paths; keys of very many paths are dealt to several tasks."""
    entries = cache.select("key", C("ext").alias("out_ext"), "payload", "payload_len", "payload_hash")
    return dealt_join(plan, entries, "key", [c for c in ("path", "out_path") if c in plan.columns] or ["key"], rows_per_task)


def store(cache: DataFrame, new: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Cache plus new entries, one per key; those without a length or over ``max_bytes`` are not kept."""
    cols = ["key", "ext", "payload", "payload_len", "payload_hash"]
    fits = new.where(C("payload_len").isNotNull() if max_bytes is None else C("payload_len") <= max_bytes)
    fresh = fits.select(*cols).groupBy("key").agg(F.min(F.struct(*cols[1:])).alias("_e")).select("key", "_e.*")
    return cache.select(*cols).unionByName(fresh.join(cache.select("key"), "key", "left_anti"))


def build_summary(plan: DataFrame) -> DataFrame:
    """Outputs by target: cached, rebuilt, failed."""
    return plan.groupBy("target_idx").agg(
        F.count(F.lit(1)).alias("outputs"), F.count_if(C("status") == "cached").alias("cached"),
        F.count_if(C("status") == "rebuild").alias("rebuilt"), F.count_if(C("status") == "failed").alias("failed"))


def summary_text(summary: DataFrame) -> DataFrame:
    """One line over all targets."""
    total = summary.agg(F.count(F.lit(1)).alias("targets"), *[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("outputs", "cached", "rebuilt", "failed")])
    return total.withColumn("line", F.concat(
        plural(C("targets"), "target"), F.lit(", "), plural(C("outputs"), "output"), F.lit(": "),
        C("cached").cast("string"), F.lit(" cached, "), C("rebuilt").cast("string"), F.lit(" rebuilt, "),
        C("failed").cast("string"), F.lit(" failed")))


def write_lock(outputs: DataFrame) -> DataFrame:
    """Lock rows sorted by path; the env header is a one-row table of its own."""
    return outputs.select(C("out_path").alias("path"), "source", "recipe", "key",
                          C("payload_hash").alias("hash"), C("payload_len").alias("bytes")).orderBy("path")


def feature_signature(features: Column) -> Column:
    """Sorted, comma-joined feature names."""
    return F.array_join(F.array_sort(features), ",")


def lock_env(df: DataFrame, version: str) -> DataFrame:
    """Env header columns from ``arch, os, features``."""
    return df.withColumns({"version": F.lit(version), "target": F.concat("arch", F.lit("-"), "os"),
                           "features": feature_signature(C("features"))})


def lock_diff(committed: DataFrame, current: DataFrame, committed_target: str = "local",
              current_target: str = "local", strict: bool = False) -> DataFrame:
    """Changed outputs only: kind, old and new digests, and whether they count as drift."""
    side = lambda d, p: d.select("path", C("key").alias(f"{p}_key"), C("hash").alias(f"{p}_hash"), F.lit(True).alias(f"_{p}"))
    both = side(committed, "old").join(side(current, "new"), "path", "full")
    same_env = committed_target == current_target
    kind = (F.when(C("_old").isNull(), "added").when(C("_new").isNull(), "removed")
            .when(~C("old_key").eqNullSafe(C("new_key")), "key-changed")
            .when(~C("old_hash").eqNullSafe(C("new_hash")), "hash-changed" if same_env else "hash-changed-cross-env"))
    drift = F.when(C("kind") == "hash-changed-cross-env", F.lit(strict)).otherwise(F.lit(True))
    by_key = C("kind") == "key-changed"
    hashed = C("kind").startswith("hash-changed")
    pick = lambda p: F.when(by_key, C(f"{p}_key")).when(hashed, C(f"{p}_hash"))
    return both.withColumn("kind", kind).where("kind is not null").select(
        "path", "kind", pick("old").alias("committed"), pick("new").alias("current"), drift.alias("drift"))


def lock_gate(diff: DataFrame) -> DataFrame:
    """One row: drifted if any drift row, clean if no rows at all."""
    return diff.agg(F.coalesce(F.bool_or("drift"), F.lit(False)).alias("drifted"),
                    (F.count(F.lit(1)) == 0).alias("clean"))


def change_line(diff: DataFrame, committed_target: str = "local", current_target: str = "local") -> DataFrame:
    """Rendered change, digests cut to twelve."""
    arrow = F.concat(short_hash(C("committed")), F.lit(" → "), short_hash(C("current")))
    why = F.when(C("drift"), "counts as drift under --strict").otherwise(
        "encoders may differ; --strict counts it as drift")
    text = (F.when(C("kind") == "added", "new since the lock").when(C("kind") == "removed", "locked, but nothing made it")
            .when(C("kind") == "key-changed", F.concat(F.lit("other inputs (key "), arrow, F.lit(")")))
            .when(C("kind") == "hash-changed", F.concat(
                F.lit("equal inputs gave other bytes here ("), arrow, F.lit(")")))
            .otherwise(F.concat(F.lit(f"bytes depend on the machine ({committed_target} "), short_hash(C("committed")),
                                F.lit(f" → {current_target} "), short_hash(C("current")), F.lit("); "), why)))
    tag = F.when(C("drift"), "drift").otherwise("note")
    return diff.withColumn("line", F.concat(tag, F.lit(': "'), C("path"), F.lit('": '), text))


def lock_validate(lock: DataFrame, version: Column | int = 1) -> DataFrame:
    """Rows whose digests are not hex, or whose version is unknown."""
    version = F.lit(version) if isinstance(version, int) else version
    hexa = lambda c: C(c).rlike("^[0-9A-Fa-f]+$")
    reason = (F.when(version != 1, "unsupported lock version").when(~hexa("key"), "key is not hex")
              .when(~hexa("hash"), "hash is not hex"))
    return lock.withColumn("reason", reason).where("reason is not null")


def content_duplicates(assets: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Digests found at several paths, with their count and first path."""
    groups = assets.groupBy(hashing.content_hash(C(content)).alias("hash")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(path).alias("first_path"))
    return groups.where("copies > 1")


def stale_outputs(lock: DataFrame, current: DataFrame) -> DataFrame:
    """Locked outputs no longer produced."""
    return lock.join(current.select("path"), "path", "left_anti")


