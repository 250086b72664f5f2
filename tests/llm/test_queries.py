"""Queries against their SQL twins, and the pipeline stage by stage."""

from __future__ import annotations

import re
from html import unescape

import duckdb
import oracle_check
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assetloom.llm import queries
from assetloom.llm.linededup import WORD

SF = f"{oracle_check.DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, monkeypatch, name):
    monkeypatch.setattr(oracle_check, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(oracle_check, "ORACLES", queries.ORACLES)
    assert oracle_check.compare(spark, oracle_check.connect(SF), name, SF) is None


def test_nearest_twin(spark):
    con = oracle_check.connect(SF)
    want = con.execute(queries.NEAREST_SQL).fetchall()
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in queries.QUERIES["op7_nearest"](spark, SF).collect()]
    assert sorted(got) == sorted((q, k, v, round(s, 9)) for q, k, v, s in want)


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pages_keep_the_article_text(spark):
    """The whole article and nothing else: the pages' blocks, read with plain replacements."""
    pages = duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in queries.QUERIES["op4_html"](spark, SF).collect()}
    for i, page in pages:
        article = page.split("<article>")[1].split("</article>")[0]
        blocks = re.sub(r"</?(?:p|h1)>", "\n", re.sub(r"</?b>|<br>", "", article))
        want = [" ".join(unescape(x).split()) for x in re.split("\n(?=)", blocks)]
        assert got[i].text.split() == " ".join(want).split()
        assert got[i].n_chars == len(got[i].text)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name == "packing":
            tokens = docs.select(F.regexp_count("text", F.lit(WORD)).alias("n")).agg(F.sum("n")).first()[0]
            assert out.agg(F.sum("n_tokens")).first()[0] == tokens
            assert out.where("bin_id is not null").groupBy("bin_id").agg(F.sum("n_tokens").alias("n")).agg(F.max("n")).first()[0] <= 2048
        else:
            assert out.columns == columns and out.dtypes == docs.dtypes
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            if name in ("toxicity", "near_dedup"):
                assert 0 < out.count() <= docs.count() and out.exceptAll(docs).count() == 0
        docs = out
