"""Spelling variants against a plain comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import oracle_check

from assetloom.llm import queries, spelling

SF = f"{oracle_check.DATA}/sf0.001"


def plain_words(docs):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_variants(words):
    holes = {}  # words that agree when one code point is left out, or is a gap
    for w in words:
        for i in range(len(w)):
            for key in ((w[:i] + w[i + 1:], "out"), (w[:i] + "\0" + w[i + 1:], "gap")):
                holes.setdefault(key, set()).add(w)
        holes.setdefault((w, "out"), set()).add(w)
    near = {w: set() for w in words}
    for (key, kind), group in holes.items():
        for a in group:
            for b in group:
                if a != b and (kind == "gap" or a == key or b == key):
                    near[a].add(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def rows(df):
    out = [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_whole_table(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = rows(queries.QUERIES["op11_spelling"](spark, SF))
    assert got == plain_variants(plain_words(docs))


def test_passes_cut_by_length_and_hash(spark):
    """Chains, accents, repeated letters and ties, with filters so small that each length takes several passes."""
    pick = random.Random(11)
    words = {}
    for _ in range(700):
        w = "".join(pick.choice("aabé") for _ in range(pick.choice([7, 7, 8, 9])))
        words[w] = pick.choice([2, 2, 3, 20, 35, 400, 5000])
    words |= {"z" * 400: 50, "z" * 399: 2, "z" * 398 + "ÿ": 4, "àéîôüçñ": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert len(spelling.planned([(7, 200), (8, 100), (400, 1)], 256)) > 3
    assert rows(spelling.variants(df, broadcast_bytes=512)) == plain_variants(words) == rows(spelling.variants(df))


def test_words_of_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        want = plain_words([tuple(r) for r in docs.select("doc_id", "text").collect()])
        got = spelling.vocabulary(docs)
        assert {r.word: r.n for r in got.collect()} == want
        assert rows(spelling.variants(got)) == plain_variants(want)
    text = "ÀÉÎÔÜÇÑ àéîôüçñ StraSSe× 1234567 ab_cdefghi Straßen-strasseń " * 3 + "q" * 3000 + " " + "q" * 2999 + " "
    docs = [(1, text), (2, text), (None, text), (3, None), (4, ""), (1, text)]
    want = plain_words(docs)
    got = spelling.vocabulary(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.word: r.n for r in got.collect()} == want
    assert rows(spelling.variants(got)) == plain_variants(want)
