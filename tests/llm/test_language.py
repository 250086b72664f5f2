"""The string kernel against plain sets of n-grams, and accuracy on rows that are held out."""

from __future__ import annotations

import numpy as np
import oracle_check
from pyspark.sql import functions as F

from assetloom.llm import language, queries

SF = f"{oracle_check.DATA}/sf0.01"


def grams(text):
    text = language.plain(text)
    return {text[i:i + n] for n in range(1, language.ORDER + 1) for i in range(len(text) - n + 1)}


def test_kernel_counts_shared_ngrams(monkeypatch):
    monkeypatch.setattr(language, "MIN_DOCS", 1)
    monkeypatch.setattr(language, "SLICE_CHARS", 50)  # texts cross slices
    rows = [("en", f"the cat number {i} sat on the mat and was happy, with {chr(97 + i)} hat") for i in range(6)]
    rows += [("fr", f"le chat numéro {i} était sur le tapis où il dort, très {chr(97 + i)} content") for i in range(6)]
    model = language.train(rows)
    texts = [t for _, t in rows]
    known = set().union(*map(grams, texts))
    assert len(model.index.keys) - 1 == len(known)
    new = ["the hat of the cat", "le tapis", "Ωμέγα", "x"]
    got = model.kernel(model.presence([language.plain(t) for t in new]))
    assert got.shape[1] == len(texts)
    for i, a in enumerate(new):
        have = grams(a) & known
        want = sorted(len(have & grams(b)) / np.sqrt(max(1, len(have)) * len(grams(b))) for b in texts)
        assert np.allclose(np.sort(got[i]), want, atol=1e-6)
    best, share = model.score([language.plain(t) for t in new[:2]])
    assert [model.languages[b] for b in best] == ["en", "fr"] and (share > 0.5).all()


def test_index_finds_every_key_and_no_other():
    keys = np.unique(np.random.default_rng(1).integers(1, 1 << 62, 300_000, dtype=np.uint64))
    index = language.Index(keys)
    asked = np.concatenate([keys[::3], keys[::5] + np.uint64(1 << 63)])
    places, columns = index.find(asked)
    assert sorted(places) == list(range(len(keys[::3]))) and (keys[columns] == asked[places]).all()


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    got = queries.QUERIES["op12_language"](spark, SF).join(truth, "doc_id").collect()
    assert len(got) == truth.count()
    for held in (True, False):
        mine = [r for r in got if r.held_out == held]
        assert sum(r.lang == r.lang_pred for r in mine) >= 0.99 * len(mine)
    assert all(0 <= r.score <= 1 for r in got)


def test_learns_from_its_own_rows_only(spark):
    """Labels of held-out rows and the other columns have no part in the model."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = language.fit(docs), language.fit(other.repartition(3))
    assert a.languages == b.languages and np.array_equal(a.index.keys, b.index.keys) and np.allclose(a.weights, b.weights)


def test_odd_rows(spark, odd_docs, no_docs):
    model = language.train([("en", "the cat sat on the mat")] * 3 + [("de", "die Katze saß auf der Matte")] * 3)
    out = language.identify(odd_docs, model)
    assert out.count() == odd_docs.count()
    for r in out.collect():
        assert (r.lang_pred == "und") == (not any(ch.isalpha() for ch in r.row.text or "")) and 0 <= r.score <= 1
    assert [r.score for r in out.where("lang_pred = 'und'").collect()] == [0.0] * 4
    assert language.identify(no_docs, language.fit(no_docs)).count() == 0
    assert {r.lang_pred for r in language.identify(odd_docs, language.fit(no_docs)).collect()} == {"und"}
    letters = spark.createDataFrame([(1, "Ωμέγα"), (2, "1234 !? ²½Ⅷ"), (3, "ª"), (4, "x" * 3_000_000)], "doc_id bigint, text string")
    got = {r.row.doc_id: r.lang_pred for r in language.identify(letters, model).collect()}
    assert got[2] == "und" and got[1] != "und" and got[4] != "und"


ROWS = [("en", f"the cat number {i} sat on the mat and was happy, with {chr(97 + i)} hat") for i in range(6)]
ROWS += [("el", f"η γάτα {i} κάθισε στο χαλί, ΌΠΩΣ ΠΆΝΤΑ {chr(0x3b1 + i)}") for i in range(6)]
ODD = ["", "  ", "12_3 !?", "the", "The  CAT\n\n12 sat", "_the_cat_", "ΌΠΩΣ ΠΆΝΤΑ", "İ the İstanbul", "²½Ⅷ the", "日本 the 日", "\u0000the\u0000", "t", " h", "\U0001f600cat\U0001f600 mat", "the cat sat on the mat " * 40]


def test_tree_finds_the_same_ngrams_as_hashes(monkeypatch):
    monkeypatch.setattr(language, "MIN_DOCS", 2)
    monkeypatch.setattr(language, "SLICE_CHARS", 50)  # texts cross slices
    tree = language.train(ROWS)
    monkeypatch.setattr(language, "TREE_CELLS", 0)
    hashed = language.train(ROWS)
    assert isinstance(tree.finder, language.Tree) and hashed.finder is hashed.index
    known = language._spelled(tree.index, [language.plain(t) for _, t in ROWS])
    assert len(set(known)) == len(known) and all(known)
    texts = [t.lower() for t in ODD]
    got = tree.presence(texts)
    for row, text in zip(got, texts, strict=True):
        if any(map(str.isalpha, text)):
            assert {known[k] for k in np.flatnonzero(row)} == grams(text) & set(known)
    assert np.array_equal(got, hashed.presence(texts))
    assert all(np.array_equal(a, b) for a, b in zip(tree.score(texts), hashed.score(texts), strict=True))


def test_beginnings_that_are_no_ngrams_are_not_marked():
    tree = language.Tree([" the", "cat", "e"])
    marks = np.zeros(tree.nodes, bool)
    for columns in tree.columns(tree.codes("the cat")):
        marks[columns] = True
    assert marks[:3].all()
    marks[:] = False
    for columns in tree.columns(tree.codes("th ca")):
        marks[columns] = True
    assert not marks[:3].any()
