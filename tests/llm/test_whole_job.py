"""Cases in which an operator did less than its whole job."""

from __future__ import annotations

import textwrap
import zlib

import pytest

from assetloom.llm import licenses, mixing, pii, toxicity

IDS = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]  # not held out


# --- toxicity -------------------------------------------------------------------------------------------------------

def _sampled(monkeypatch, docs, labels, **bounds) -> list[tuple[str, bool]]:
    """Texts that the chain is trained on, and whether they count as toxic."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, prior: seen.extend(zip(texts, map(bool, toxic), strict=True)))
    toxicity.fit(docs, labels, **bounds)
    return seen


def test_each_class_has_its_own_sample(spark, monkeypatch):
    bad = set(IDS[:6])
    long = IDS[6:10]  # none of them fits
    docs = spark.createDataFrame([(i, ("x" * 5000 if i in long else f"{i:05d} " * 10)) for i in IDS], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i in bad)) for i in IDS], "doc_id bigint, toxic int")
    seen = _sampled(monkeypatch, docs, labels, sample_chars=1200)
    assert sum(toxic for _, toxic in seen) == 6 and sum(not toxic for _, toxic in seen) == 20
    assert all(len(text) == 60 for text, _ in seen)
    only_long = spark.createDataFrame([(i, int(i in long)) for i in IDS], "doc_id bigint, toxic int")
    with pytest.raises(ValueError, match="no text"):
        _sampled(monkeypatch, docs, only_long, sample_chars=1200)


def test_repeated_rows_of_an_id_are_sampled_once(spark, monkeypatch):
    hot = IDS[0]
    rows = [(i, f"{i:05d} " * 10) for i in IDS] + [(hot, f"{hot:05d} " * 10)] * 50 + [(hot, f"other {k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i == hot)) for i in IDS], "doc_id bigint, toxic int")
    seen = _sampled(monkeypatch, docs, labels, sample_chars=1200)
    assert sum(toxic for _, toxic in seen) == 1 and sum(len(text) for text, _ in seen) <= 2 * 1200
    assert seen == _sampled(monkeypatch, docs.repartition(7), labels, sample_chars=1200)


# --- licences -------------------------------------------------------------------------------------------------------

def test_parts_of_notices_and_wrapped_notices_are_found():
    c = licenses.train([f"plain words about market number {i} and other things" for i in range(300)])
    found = lambda text: [(x["paragraph"], x["family"]) for x in licenses.notices(c, text)]
    assert found("some prose\nAll rights reserved.\nmore prose") == [(1, "Proprietary")]
    for family in ("MIT", "GPL", "BSD", "Apache"):
        notice = max(licenses.TEMPLATES[family], key=len)
        for width in (30, 60):
            lines = [f"# {x}" for x in textwrap.wrap(notice, width, break_on_hyphens=False)]
            assert len(lines) > 2 and found("\n".join(["A title", "", *lines, "", "prose"])) == [(2, family)]
            prose = "The people went to the market to buy bread"
            assert found("\n".join([prose, *lines, prose])) == [(1, family)]
    assert found("Released under the MIT License.\nReleased under the MIT License.") == [(0, "MIT"), (1, "MIT")]
    assert found("all seats\nare reserved\nfor the people of the house") == []


# --- personal data --------------------------------------------------------------------------------------------------

def test_contexts_of_a_frequent_value_are_never_one_array(spark, monkeypatch):
    plans, links = [], []
    real = pii.written

    def kept(df, name):
        plans.append(df._jdf.queryExecution().toString().lower())
        out = real(df, name)
        if name == "pattern-links":
            links.append(out)
        return out
    monkeypatch.setattr(pii, "written", kept)
    rows = [("hot", None, [f"p{i}", f"q{i % 3}"]) for i in range(500)] + [("hot", 2, []), ("cold", None, ["p1"]), ("bare", 1, [])]
    pii.bootstrap(spark.createDataFrame(rows, "value string, kind int, patterns array<string>"), rounds=1).collect()
    got = {(r.value, r.kind, r.pattern) for r in links[0].collect()}
    assert got == {("hot", 2, f"p{i}") for i in range(500)} | {("hot", 2, f"q{i}") for i in range(3)} | {("cold", None, "p1")}
    assert links[0].count() == len(got) and not any("collect_set" in p or "collect_list" in p for p in plans)


# --- mixing ---------------------------------------------------------------------------------------------------------

def test_rows_without_an_id_draw_their_own_counts(spark):
    docs = spark.createDataFrame([(None, f"text {i:04d}", "s") for i in range(2000)], "doc_id bigint, text string, source string")
    rows = mixing.replicate(docs, mixing.source_rates(docs, budget=0.6)).select("row.text", "shuffle_key").collect()
    assert abs(len(rows) / 2000 - 0.6) < 0.08 and len({r.shuffle_key for r in rows}) == len(rows)
