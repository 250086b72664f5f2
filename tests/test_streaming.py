from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assetloom.operators import build as B
from assetloom.plans import flow_queries as FQ
from assetloom.session import fresh_dir
from assetloom.streaming import changes as W
from assetloom.streaming.rebuild import ConfigHolder, run_available

T0 = datetime(2024, 1, 1)
SCHEMA = "path STRING, event_time TIMESTAMP, k STRING"


def brute(events, gap, keyed):
    out, groups = [], {}
    for path, t, k in events:
        groups.setdefault(k if keyed else None, []).append(t)
    for k, ts in groups.items():
        ts.sort()
        start = prev = ts[0]
        n = 1
        for t in ts[1:]:
            if (t - prev).total_seconds() > gap:
                out.append((k, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        out.append((k, start, prev, n))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
@pytest.mark.parametrize("keyed", [True, False])
def test_debounce_against_brute_force(spark, monkeypatch, chunk, keyed):
    monkeypatch.setattr(W, "CHUNK_BUCKETS", chunk)
    rng = random.Random(3)
    events, t = [], 0.0
    for _ in range(400):
        t += rng.choice([0, 0.2, 1, 5, 5, 9, 10, 10, 10, 11, 40, 300])
        events.append(("p", T0 + timedelta(seconds=t), rng.choice("abc")))
    df = spark.createDataFrame(events, SCHEMA)
    got = W.debounce(df, 10, ["k"] if keyed else None).collect()
    rows = sorted(((r["k"] if keyed else None, r.first_change, r.last_change, r.changes) for r in got), key=str)
    assert rows == brute(events, 10, keyed)


def write(spark, folder, events):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_are_dropped_and_open_windows_stay_open(spark):
    root = fresh_dir(spark, "late")
    at = lambda m: T0 + timedelta(minutes=m)
    out, ck = f"{root}/out", f"{root}/ck"
    def run():
        src = W.asset_stream(spark, f"{root}/in", SCHEMA, fmt="parquet")
        run_available(W.windowed_counts(src, "10 minutes", delay="5 minutes"), ck, out)
    write(spark, f"{root}/in", [("a", at(1), "k"), ("a", at(2), "k"), ("a", at(40), "k")])
    run()
    write(spark, f"{root}/in", [("a", at(3), "k"), ("a", at(80), "k")])  # minute 3 is behind the watermark
    run()
    got = {(r.start, r.changes) for r in spark.read.parquet(out).collect()}
    assert got == {(T0, 2), (at(40), 1)}


def test_dedup_across_batches(spark):
    root = fresh_dir(spark, "dedup")
    def run():
        src = W.asset_stream(spark, f"{root}/in", SCHEMA, fmt="parquet")
        run_available(W.dedup_stream(src, ["path"], "1 hour").select("path", "event_time"), f"{root}/ck", f"{root}/out")
    write(spark, f"{root}/in", [("a", T0, "k"), ("b", T0, "k"), ("a", T0, "k")])
    run()
    write(spark, f"{root}/in", [("a", T0 + timedelta(minutes=1), "k"), ("c", T0, "k")])
    run()
    assert sorted(r.path for r in spark.read.parquet(f"{root}/out").collect()) == ["a", "b", "c"]


DOC = "asset_id BIGINT, path STRING, ext STRING, bytes BIGINT, content STRING"
TARGETS = [B.Target(("in/**",), "web", "dist")]


def test_stream_build_reuses_cache_and_replays(spark):
    root = fresh_dir(spark, "sb")
    run = FQ.builder(spark, root, lambda: TARGETS, lambda: F.col("bytes") < 1)
    first = spark.createDataFrame([(1, "in/a.png", "png", 1, "A"), (2, "in/b.png", "png", 1, "A"), (3, "in/z.png", "png", 0, "")], DOC)
    run(first, 0)
    assert {(r.out_path, r.status) for r in run.outputs().collect()} == {("dist/a.webp", "rebuild"), ("dist/b.webp", "rebuild")}
    assert run.cache().count() == 1 and [r.path for r in run.quarantined().collect()] == ["in/z.png"]
    second = spark.createDataFrame([(4, "in/c.png", "png", 1, "A"), (1, "in/a.png", "png", 1, "B")], DOC)
    for _ in range(2):  # the second time is a replay
        run(second, 1)
        got = {r.out_path: r.status for r in run.outputs().collect()}
        assert got == {"dist/a.webp": "rebuild", "dist/b.webp": "rebuild", "dist/c.webp": "cached"}
        assert run.cache().count() == 2


def test_stream_build_sets_aside_and_goes_on(spark):
    root = fresh_dir(spark, "sb")
    run = FQ.builder(spark, root, lambda: TARGETS, lambda: F.col("bytes") < 1)
    run(spark.createDataFrame([(1, "in/a.png", "png", None, "A"), (2, "in/x/a.png", "png", 1, "B"), (3, "in/c.png", "png", 1, "C")], DOC), 0)
    assert {r.out_path for r in run.outputs().collect()} == {"dist/a.webp", "dist/c.webp"}  # a NULL check does not fail a row
    assert [(r.path, r.reason) for r in run.quarantined().collect()] == [("in/x/a.png", "output claimed twice: dist/a.webp")]
    # a damaged entry is a miss: rendered anew, one output
    entries = spark.read.parquet(f"{root}/cache/epoch=0").collect()
    spark.createDataFrame([(*e[:2], bytearray(b"broken!!"), *e[3:]) for e in entries], entries and spark.read.parquet(f"{root}/cache/epoch=0").schema) \
        .write.mode("overwrite").parquet(f"{root}/cache/epoch=0")
    run(spark.createDataFrame([(1, "in/a.png", "png", 1, "A")], DOC), 1)
    made = spark.read.parquet(f"{root}/outputs/epoch=1").collect()
    assert [(r.out_path, r.status) for r in made] == [("dist/a.webp", "rebuild")]
    assert made[0].payload_hash == [e.payload_hash for e in entries if e.key == made[0].key][0]
    # a row with an error is set aside by itself
    good = run.render
    bad = F.col("content") == "BAD"
    run.render = lambda d: good(d).join(d.select("key", F.when(bad, "cannot render").alias("error")), "key")
    rows = [(10 + i, f"in/n{i}.png", "png", 1, "BAD" if i == 3 else f"text {i}") for i in range(40)]
    run(spark.createDataFrame(rows, DOC), 2)
    assert [(r.path, r.error) for r in run.quarantined().where("reason = 'render failed'").collect()] == [("in/n3.png", "cannot render")]
    assert run.outputs().where("epoch = 2").count() == 39


def test_broken_config_keeps_the_last_good_one():
    answers = iter([1, ValueError("bad"), 3])
    def load():
        v = next(answers)
        if isinstance(v, Exception):
            raise v
        return v
    holder = ConfigHolder(load)
    assert [holder.refresh(), holder.refresh(), holder.refresh()] == [1, 1, 3] and holder.errors == ["bad"]
    with pytest.raises(KeyError):
        ConfigHolder(lambda: {}["x"]).refresh()


def test_watch_arguments():
    W.check_watch_args(True)
    W.check_watch_args(False, check=True, strict=True)
    for kw in ({"check": True}, {"strict": True}):
        with pytest.raises(ValueError):
            W.check_watch_args(True, **kw)


def test_exclusion_is_by_component(spark):
    df = spark.createDataFrame([("dist/a",), ("distortion/a",), ("./dist/../dist/b",), ("x/dist/c",), ("dist",)], "path STRING")
    assert sorted(r.path for r in W.exclude_own_writes(df, ["dist"]).collect()) == ["distortion/a", "x/dist/c"]


def test_watch_roots(spark):
    df = spark.createDataFrame([(["assets/**/*.png", "a/b*.png", "*.gif", "photos/", "logo.png"], "recipes/web.toml", "./dist/")],
                               "source ARRAY<STRING>, recipe STRING, out STRING")
    got = {(r.kind, r.path) for r in W.watch_roots(df).collect()}
    assert got == {("recursive", "assets"), ("recursive", "a"), ("recursive", "."), ("recursive", "photos"), ("shallow", "recipes"),
                   ("excluded", "dist"), ("excluded", ".cache"), ("excluded", "build.lock")}
