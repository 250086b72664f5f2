"""What the toxicity operator reads and sends to Python, and that its sample and emissions are those of the plain definitions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetloom.llm import queries, toxicity


def test_only_the_id_goes_along_with_the_text(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id bigint, text string, lang string")
    assert toxicity.score(docs, toxicity.Chain(), keep=["doc_id"]).schema["row"].dataType.names == ["doc_id"]
    plan = queries.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert re.search(r"struct\(doc_id, doc_id#\d+L\) AS row", plan), plan


@pytest.mark.parametrize("missing", [0, 0.97], ids=["all have a text", "most have none"])
def test_sample_is_that_of_all_ids(spark, monkeypatch, missing):
    """The first ids by hash whose text fits, whether those of least hash are enough or all must be looked at."""
    rng = np.random.default_rng(3)
    y = {i: int(i % 4 == 0) for i in range(4000)}
    text = {i: f"text {i} " + "x" * int(rng.choice([5, 90])) for i in y if rng.random() >= missing}
    looked, chosen = [], []
    choose = toxicity._choose
    monkeypatch.setattr(toxicity, "_choose", lambda known, texts, *a: looked.append(texts) or choose(known, texts, *a))
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, prior: chosen.extend(zip(texts, toxic)))
    docs = spark.createDataFrame([*text.items(), (min(text), text[min(text)])], "doc_id bigint, text string")
    toxicity.fit(docs, spark.createDataFrame(list(y.items()), "doc_id bigint, toxic int"), toxic_docs=20, clean_docs=30, sample_chars=60)
    assert len(looked) == 1 + (missing > 0)
    assert "LeftSemi" in looked[0]._jdf.queryExecution().executedPlan().toString()
    want = []
    for bad, bound in ((1, 20), (0, 30)):
        ids = spark.createDataFrame([(i,) for i in text if y[i] == bad and len(text[i]) <= 60], "id bigint").where(~toxicity.held_out(F.col("id")))
        room = 60
        for r in ids.orderBy(F.xxhash64(F.col("id").cast("string"), F.lit("sample"), F.lit(bad)), "id").limit(bound).collect():
            if len(text[r.id]) <= room:
                room -= len(text[r.id])
                want.append((text[r.id], bool(bad)))
    assert sorted(chosen) == sorted(want) and len({bad for _, bad in want}) == 2


def test_emissions_and_spans_equal_the_definitions():
    rng = np.random.default_rng(1)
    words = ["Bad", "bad!", "BAD", "İbadİ", "ΣΑΣ", "σας", "…", "--", "a", "ab", "abc", "abcd", "abcde", "abcdef", "abcdefg", "Badness", "x" * 300, "ß", "ŉbad"]
    texts = ["", "\n", *("".join(w + rng.choice([" ", "\n", "\t", "\x1c", "\x85", " ", " \r\n"]) for w in rng.choice(words, 700)) for _ in range(5))]
    chain = toxicity.Chain({f: float(rng.normal(0, 9)) for f in sorted({f for w in words for f in toxicity.features(w)})[::2]}, -1.0, rng.normal(size=(2, 2)), np.array([0.0, 1.0, 0.0]))
    evidence, odds, lines = toxicity.score_texts(chain, toxicity._Memo(chain), texts)
    chains = [toxicity.chains_of(t) for t in texts]
    emission = [np.clip(chain.bias + sum([chain.weight.get(f, 0.0) for f in toxicity.features(w)]), -toxicity.LIMIT, toxicity.LIMIT) for c in chains for seq in c for w in seq]
    lengths = np.array([len(seq) for c in chains for seq in c])
    assert (odds == toxicity.marginals(np.array(emission), lengths, chain.step)[0]).all()
    assert [sum(x) for x in lines] == [len(t.split()) for t in texts]
    out = next(toxicity._scorer(chain)(iter([pa.record_batch({"row": range(len(texts)), "text": texts})])))
    first = 0
    for t, spans in zip(texts, out.column("spans").to_pylist()):
        places = [m.span() for m in toxicity.TOKEN.finditer(t)]
        bad = odds[first:first + len(places)] >= 0
        runs = [[p] if not k or not bad[k - 1] else p for k, p in enumerate(places) if bad[k]]
        want: list[tuple[int, int]] = []
        for run in runs:
            if isinstance(run, list):
                want.append(run[0])
            else:
                want[-1] = (want[-1][0], run[1])
        assert spans == ",".join(f"{a}:{b}" for a, b in want)
        first += len(places)


def test_tokens_that_are_dropped_and_met_again_keep_their_emission(monkeypatch):
    """A task that keeps no token from one slice to the next scores as one that keeps all."""
    chain = toxicity.Chain({"wbad": 3.5, "pba": 0.1, "sbad": 0.7, "pgo": -1.25}, -0.3, np.array([[0.2, -0.1], [0.0, 0.4]]))
    slices = [["bad good", "good"], ["good bad bad", ""], ["gold\nbad badly"]]
    kept = toxicity._Memo(chain)
    want = [toxicity.score_texts(chain, kept, s)[1] for s in slices]
    monkeypatch.setattr(toxicity, "TOKENS", 0)
    memo = toxicity._Memo(chain)
    assert all((toxicity.score_texts(chain, memo, s)[1] == w).all() for s, w in zip(slices, want))
    assert len(memo.number) == len(memo.emission) == 3 and len(kept.number) == len(kept.emission) == 4
