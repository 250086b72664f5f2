from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assetloom.functions import hashing
from assetloom.operators import build as B
from assetloom.operators import lint as L
from assetloom.operators import recipes as P
from assetloom.schemas import CACHE, LOCK

FACTS = ("path STRING, bytes BIGINT, format STRING, width INT, bit_depth INT, components INT, decode_status STRING, has_gps BOOLEAN, "
         "has_camera BOOLEAN, orientation INT, icc_bytes BIGINT, animated BOOLEAN")


def facts(spark, **kw):
    base = dict(path="img/a.jpg", bytes=100, format="jpeg", width=10, bit_depth=8, components=3, decode_status="ok", has_gps=False,
                has_camera=False, orientation=None, icc_bytes=None, animated=False)
    return spark.createDataFrame([tuple({**base, **kw}.values())], FACTS)


def rules(df):
    return sorted(r.rule for r in df.collect())


def test_nulls_are_not_findings(spark):
    assert rules(L.run_lint(facts(spark))) == []
    assert rules(L.run_lint(facts(spark, has_gps=None, orientation=1))) == []


def test_decode_failures(spark):
    assert rules(L.run_lint(facts(spark, decode_status="corrupt"))) == ["size/truncated-or-corrupt"]
    for status in ("codec-not-built", "over-limit"):
        assert rules(L.run_lint(facts(spark, decode_status=status))) == []


def test_activation_precedence(spark):
    df = facts(spark, has_gps=True, has_camera=True)
    gps, cam = "privacy/gps-metadata-leak", "privacy/camera-metadata"
    run = lambda **kw: [r for r in rules(L.run_lint(df, L.LintConfig(**kw))) if r.startswith("privacy")]
    assert run() == [gps] and run(severity={cam: "error"}) == [cam, gps] and run(select=("privacy",)) == [cam, gps]
    assert run(select=("privacy",), ignore=(gps,)) == [cam] and run(select=(gps,), severity={gps: "off"}) == []
    assert run(select=("priv",)) == [] and run(ignore=("privacy",)) == []


def test_last_budget_wins_each_on_its_own(spark):
    cfg = L.LintConfig(budgets=(L.Budget("**", 50, 5), L.Budget("img/**", 200), L.Budget("other/**", 1, 1)), max_width=3)
    row = L.budget_for(facts(spark), cfg).first()
    assert (row.byte_budget, row.intended_width) == (200, 5)
    assert tuple(L.budget_for(facts(spark), L.LintConfig(max_width=7)).select("byte_budget", "intended_width").first()) == (None, 7)


def test_gate_on_nothing_and_on_warnings(spark):
    none = L.run_lint(facts(spark))
    assert L.lint_gate(none).first().passed
    warn = L.run_lint(facts(spark, orientation=6))
    assert L.lint_gate(warn).first().passed and L.lint_gate(warn, 1).first().passed and not L.lint_gate(warn, 0).first().passed
    assert not L.lint_gate(L.run_lint(facts(spark, has_gps=True))).first().passed


def test_user_rule(spark):
    try:
        L.register_rule("name/spaces", "warn", True, lambda: F.contains(F.col("path"), F.lit(" ")), lambda: F.lit("path has spaces"))
        assert rules(L.run_lint(facts(spark, path="a b.jpg"))) == ["name/spaces"]
    finally:
        L.RULES.pop("name/spaces")
    with pytest.raises(ValueError):
        L.register_rule("x/y", "fatal", True, lambda: F.lit(True), lambda: F.lit(""))


def test_run_lint_is_one_scan_without_shuffle(spark):
    plan = L.run_lint(facts(spark), L.LintConfig(budgets=(L.Budget("**", 5),)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


# --- build ---------------------------------------------------------------------
def lock(spark, rows):
    return spark.createDataFrame([(p, "s", "r", k, h, 1) for p, k, h in rows], LOCK)


def test_lock_matrix(spark):
    old = lock(spark, [("a", "k", "h"), ("b", "k", "h"), ("c", "k", "h"), ("d", "k", "h")])
    new = lock(spark, [("a", "k", "h"), ("b", "k2", "h2"), ("c", "k", "h2"), ("e", "k", "h")])
    kinds = lambda **kw: {r.path: (r.kind, r.drift) for r in B.lock_diff(old, new, **kw).collect()}
    assert kinds() == {"b": ("key-changed", True), "c": ("hash-changed", True), "d": ("removed", True), "e": ("added", True)}
    cross = dict(committed_target="x-linux", current_target="y-mac")
    assert kinds(**cross)["c"] == ("hash-changed-cross-env", False) and kinds(strict=True, **cross)["c"][1]
    only_c = B.lock_diff(lock(spark, [("c", "k", "h")]), lock(spark, [("c", "k", "h2")]), **cross)
    gate = B.lock_gate(only_c).first()
    assert (gate.drifted, gate.clean) == (False, False)
    assert B.lock_gate(B.lock_diff(old, old)).first() == (False, True)


def test_keys_are_framed(spark):
    zero = "00" * 32
    key = lambda version, features, q: spark.range(1).select(hashing.cache_key(
        version, features, F.lit(zero), F.lit(q).cast("int"), F.lit("png"), F.lit(zero))).first()[0]
    assert key("1.0", "avif", None) != key("1.0a", "vif", None)
    assert key("1", "", None) != key("1", "", 0) and key("1", "", 1) != key("1", "", 0)
    assert key("1", "", 7) == key("1", "", 7)


def test_corrupt_cache_entries_are_misses(spark):
    import hashlib
    good = hashlib.sha256(b"x").hexdigest()
    rows = [("ok", "png", bytearray(b"x"), 1, good), ("len", "png", bytearray(b"x"), 2, good), ("hash", "png", bytearray(b"y"), 1, good),
            ("null", "png", None, None, None)]
    cache = spark.createDataFrame(rows, CACHE)
    assert [r.key for r in B.verify_cache(cache).collect()] == ["ok"]
    inputs = spark.createDataFrame([("ok", "p1"), ("ok", "p2"), ("hash", "p3"), ("new", "p4")], "key STRING, path STRING")
    plan = {r.path: r.status for r in B.plan_build(inputs, B.verify_cache(cache)).collect()}
    assert plan == {"p1": "cached", "p2": "cached", "p3": "rebuild", "p4": "rebuild"}
    assert B.store(B.verify_cache(cache), cache).count() == 3  # the null entry has no length and is never stored


def test_expansion_keeps_duplicates_and_limits(spark):
    assets = spark.createDataFrame([("a/x.png",), ("a/b/y.png",)], "path STRING")
    got = sorted((r.path, r.pattern_idx) for r in B.expand_targets(assets, [B.Target(("a/*.png", "a/**", "**/x.*"), "web", "o")]).collect())
    assert got == [("a/b/y.png", 1), ("a/x.png", 0), ("a/x.png", 1), ("a/x.png", 2)]
    with pytest.raises(ValueError):
        B.expand_targets(assets, [B.Target(("a",), "web", "o")] * 1025)


def test_recipe_round_trip_and_errors(spark, make_px):
    doc = '[{"op":"resize","params":{"mode":"max","width":"20"}},{"op":"invert","params":{}}]'
    df = spark.createDataFrame([("r", doc)], "recipe STRING, doc STRING")
    assert P.to_recipe(P.recipe_steps(df)).first().doc == doc
    px = make_px({1: (2, 2, lambda x, y: (1, 2, 3, 255))})
    with pytest.raises(ValueError, match="unknown operation 'optimize'"):
        P.apply_recipe(px, P.bundled("web"))
    with pytest.raises(ValueError):
        P.register_op("optimize", lambda d, p: d)
    try:
        P.register_op("halve", lambda d, p: d.withColumn("r", (F.col("r") / 2).cast("int")))
        assert {r.r for r in P.apply_recipe(px, [("invert", {}), ("halve", {})]).collect()} == {127}
    finally:
        P.OPS.pop("halve")


def test_hash_ignores_param_order(spark):
    steps = lambda m: spark.sql(f"select 'r' as recipe, 0 as step_idx, 'resize' as op, {m} as params")
    h = lambda m, plan="preserve": B.recipe_hash(steps(m), plan).first().recipe_hash
    assert h("map('a','1','b','2')") == h("map('b','2','a','1')") != h("map('a','1','b','3')")
    assert h("map('a','1')") != h("map('a','1')", "decide")


def test_targets_resolve_like_a_scan(spark):
    assets = spark.createDataFrame([(p,) for p in ("photos/a.png", "photos/b.txt", "photos/x/c.png", "notes/d.txt", "e.webp")], "path STRING")
    targets = [B.Target(("photos/", "photos/**", "notes/d.txt", "*.webp"), "web", "o")]
    got = lambda **kw: sorted((r.pattern_idx, r.path) for r in B.expand_targets(assets, targets, **kw).collect())
    assert got() == [(0, "photos/a.png"), (1, "photos/a.png"), (1, "photos/x/c.png"), (2, "notes/d.txt")]
    assert (3, "e.webp") in got(extra=["webp"])


def test_report_documents_parse(spark, tmp_path):
    import glob
    import json
    facts = spark.createDataFrame([("a.png", 1), ("b.png", 2)], "file STRING, bytes BIGINT")
    row = ("gps-metadata-leak", "error", 0, 'says "hi"')
    schema = "file STRING, rule STRING, severity STRING, severity_rank INT, message STRING, fix STRING"
    for n, rows in enumerate(([], [("a.png", *row, None)], [("a.png", *row, "clean --gps"), ("b.png", *row, None), ("b.png", *row, None)])):
        found = spark.createDataFrame(rows, schema)
        read = lambda d: json.loads("".join(open(f).read() for f in sorted(glob.glob(f"{d}/*/part-*"))))
        L.write_sarif(found, f"{tmp_path}/s{n}")
        run = read(f"{tmp_path}/s{n}")["runs"][0]
        assert len(run["results"]) == n + (n == 2) and len(run["tool"]["driver"]["rules"]) == min(n, 1)
        L.write_json(found, facts, f"{tmp_path}/j{n}")
        doc = read(f"{tmp_path}/j{n}")
        assert len(doc["findings"]) == len(rows) and doc["passed"] == (not rows) and doc["summary"]["files_scanned"] == 2
        assert all("fix" in f and f["bytes_saved"] is None for f in doc["findings"])
