"""Rows that fail to render, and faults that are no row's."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from assetloom.operators import build as B
from assetloom.operators.render import RenderError, render_rows
from assetloom.plans import flow_queries as FQ
from assetloom.session import fresh_dir

DOC = "asset_id BIGINT, path STRING, ext STRING, bytes BIGINT, content STRING"


def builder(spark, fn):
    run = FQ.builder(spark, fresh_dir(spark, "sb"), lambda: [B.Target(("in/**",), "web", "dist")], lambda: F.col("bytes") < 1)
    run.render = lambda todo: render_rows(todo, fn, ["content"])
    return run


def docs(spark, bad, n=400):
    return spark.createDataFrame([(i, f"in/n{i}.png", "png", 1, f"BAD {i}" if i in bad else f"text {i}") for i in range(n)], DOC)


@pytest.mark.parametrize("bad", [{3, 300}, set(range(0, 400, 2)), set(range(400))])
def test_only_the_rows_that_fail_to_render_are_set_aside(spark, bad):
    """One call per row however many fail: nothing is rendered twice."""
    calls = spark.sparkContext.accumulator(0)

    def render(row):
        calls.add(1)
        if row["content"].startswith("BAD"):
            raise (RenderError("cannot render") if row["content"] == "BAD 300" else ValueError(row["content"]))
        return "webp", row["content"].encode()
    run = builder(spark, render)
    run(docs(spark, bad), 0)
    aside = run.quarantined().where("reason = 'render failed'").collect()
    assert {r.path: r.error for r in aside} == {f"in/n{i}.png": "cannot render" if i == 300 else f"ValueError: BAD {i}" for i in bad}
    assert run.outputs().count() == 400 - len(bad) and calls.value == 400
    run(docs(spark, bad), 1)  # what failed is tried again, what was rendered is not
    assert calls.value == 400 + len(bad) and run.outputs().where("status = 'cached'").count() == 400 - len(bad)


def test_a_fault_of_the_machine_fails_the_batch(spark, tmp_path):
    gone = tmp_path / "mount"

    def render(row):
        if row["content"] == "text 7":
            os.stat(gone)
        return "webp", row["content"].encode()
    run = builder(spark, render)
    with pytest.raises(Exception, match="FileNotFoundError"):
        run(docs(spark, set()), 0)
    assert not os.path.exists(f"{run.root}/quarantine") and not os.path.exists(f"{run.root}/outputs")
    gone.mkdir()
    run(docs(spark, set()), 0)
    assert run.outputs().count() == 400 and run.quarantined().count() == 0


def test_a_broken_job_sets_nothing_aside(spark):
    run = builder(spark, None)
    run.render = lambda todo: todo.select("key", F.raise_error(F.lit("no codec")).cast("string").alias("ext"), F.lit(b"").alias("payload"), F.lit(0).cast("bigint").alias("payload_len"), F.lit("").alias("payload_hash"))
    with pytest.raises(Exception, match="no codec"):
        run(docs(spark, set(), 20), 0)
    assert not os.path.exists(f"{run.root}/quarantine")


def test_rows_a_renderer_leaves_out(spark):
    run = builder(spark, lambda row: ("webp", row["content"].encode()))
    whole = run.render
    run.render = lambda todo: whole(todo.where("content <> 'text 5'"))
    run(docs(spark, set(), 20), 0)
    assert [(r.path, r.error) for r in run.quarantined().collect()] == [("in/n5.png", "nothing rendered")]
