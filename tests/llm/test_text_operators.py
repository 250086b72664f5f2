"""Document operators against brute force, with odd rows."""

from __future__ import annotations

import math
import random
import time
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.llm import html, licenses, linededup, minhash, mixing, packing, pii, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- toxicity -------------------------------------------------------------------------------------------------------

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    e, lengths, step = rng.normal(size=8), np.array([3, 1, 4]), rng.normal(size=(2, 2))
    odds, at = toxicity.marginals(e, lengths, step)[0], 0
    for n in map(int, lengths):
        mass = np.zeros((n, 2))
        for ys in product((0, 1), repeat=n):
            w = math.exp(sum(e[at + i] * y for i, y in enumerate(ys)) + sum(step[a, b] for a, b in zip(ys, ys[1:])))
            for i, y in enumerate(ys):
                mass[i, y] += w
        assert np.allclose(np.log(mass[:, 1] / mass[:, 0]), odds[at:at + n])
        at += n


def _toxic_corpus(n: int):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(3, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(40)]
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            text[rnd.randrange(40)] = rnd.choice(["zorgbad", "zorgvile", "Zorgmean!"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_and_leaves_held_out_labels_alone(spark):
    rows, labels = _toxic_corpus(600)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    out = toxicity.score(docs, chain).select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held"), "predicted", "spans", "score").collect()
    held = [r for r in out if r.held]
    assert len(held) > 50 and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    text = dict(rows)
    for r in held:
        if r.predicted:
            assert any("zorg" in text[r.doc_id][int(a):int(b)].lower() for a, b in (s.split(":") for s in r.spans.split(",")))
    flipped = [(i, 1 - y) if toxicity_held(i) else (i, y) for i, y in labels]
    again = toxicity.fit(docs, spark.createDataFrame(flipped, "doc_id bigint, toxic int"))
    assert again.weight == chain.weight and (again.calibration == chain.calibration).all()


def toxicity_held(i: int) -> bool:
    import zlib
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 0)], "doc_id bigint, toxic int")
    chain = toxicity.fit(odd_docs, labels)
    out = toxicity.score(odd_docs, chain).collect()
    assert len(out) == 9 and all(0 <= r.score <= 1 and r.predicted == 0 for r in out)
    assert toxicity.score(no_docs, chain).count() == 0
    assert toxicity.fit(no_docs, labels.limit(0)).weight == {}
    assert toxicity.without_toxic(odd_docs, labels).columns == odd_docs.columns


# --- packing --------------------------------------------------------------------------------------------------------

def test_best_fit_equals_exhaustive_search():
    rnd = random.Random(1)
    items = sorted(((rnd.randint(1, 60), rnd.randint(0, 2), rnd.randint(0, 40)) for _ in range(400)), reverse=True)
    got = packing.best_fit(items, 100, 2)
    bins: list[dict] = []
    for (need, source, cluster), b in zip(items, got, strict=True):
        fits = [(x["left"], k) for k, x in enumerate(bins) if x["left"] >= need and cluster not in x["clusters"] and x["sources"][source] < 2]
        if fits:
            assert b == min(fits)[1]
        else:
            assert b == len(bins)
            bins.append({"left": 100, "clusters": set(), "sources": Counter()})
        bins[b]["left"] -= need
        bins[b]["clusters"].add(cluster)
        bins[b]["sources"][source] += 1


def test_runs_of_equal_items_equal_exhaustive_search():
    """Few sizes, sources and clusters in sorted order: searches that start behind earlier ones find the same bins."""
    rnd = random.Random(9)
    for _ in range(60):
        items = sorted(((rnd.choice([1, 1, 2, 3, 7]), rnd.randrange(3), rnd.choice([-1, -1, 0, 1, 2])) for _ in range(150)), key=lambda x: (-x[0], *x[1:]))
        for order in (items, rnd.sample(items, len(items))):
            bins, want = [], []  # what is left, sources, clusters
            for need, source, cluster in order:
                fits = [(left, b) for b, (left, s, c) in enumerate(bins) if left >= need and s.count(source) < 2 and (cluster < 0 or cluster not in c)]
                b = min(fits)[1] if fits else len(bins)
                if not fits:
                    bins.append([10, [], set()])
                bins[b][0] -= need
                bins[b][1].append(source)
                bins[b][2].add(cluster)
                want.append(b)
            assert packing.best_fit(order, 10, 2) == want


def test_many_short_items_of_one_source_and_cluster():
    start = time.perf_counter()
    bins = packing.best_fit([(1, 0, -1)] * 100_000 + [(1, 1, 0)] * 20_000, 2048, 4)
    assert len(set(bins[:100_000])) == 25_000 and len(set(bins[100_000:])) == 20_000
    assert time.perf_counter() - start < 20


def test_packing_is_whole_and_without_conflicts(spark, odd_docs, no_docs):
    rnd = random.Random(2)
    rows = [(i, "x " * rnd.randint(0, 300) if i % 3 else "copy " * 20, "hot" if i % 2 else f"s{i % 5}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = packing.pack(docs, capacity=128, shard_tokens=5000).collect()
    length, source, text = ({r[0]: f(r) for r in rows} for f in (lambda r: len(r[1].split()), lambda r: r[2], lambda r: r[1]))
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.start_token, r.n_tokens))
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for i, n in length.items():
        at = 0
        for start, size in sorted(pieces[i]):
            assert start == at
            at += size
        assert at == n
    for rs in bins.values():
        assert sum(r.n_tokens for r in rs) <= 128
        assert max(Counter(text[r.doc_id] for r in rs).values()) == 1
        assert max(Counter(source[r.doc_id] for r in rs).values()) <= packing.SOURCE_SLOTS
        assert sorted(r.position for r in rs) == list(range(len(rs)))
    odd = packing.pack(odd_docs).collect()
    assert sum(r.n_tokens for r in odd) == 8 * 3 + 30_000 + 30_001 and sum(r.bin_id is None for r in odd) == 4
    assert len({r.bin_id for r in odd if r.n_tokens == 8}) == 3  # equal texts never share a bin
    assert packing.pack(no_docs).count() == 0


# --- personal data --------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits: str) -> bool:
    worth = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in worth) % 10 == 0


def _base(text: str) -> str:
    out = []
    for k, (kind, rx) in enumerate(PATTERNS.items()):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "phone" and 10 <= len(d) <= 15) \
                    or (kind == "card" and 14 <= len(d) <= 19 and _luhn(d)):
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_base_entities_equal_plain_regular_expressions(spark):
    rnd = random.Random(3)
    hard = ["", "a@b.c_x@y.z foo@bar", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111", "a@b.c.", "x@y.z@w.q",
            "+1 (171) 555-2028, +12 3", "é\U0001F600 joe@ex.com 10.0.0.1 ñ", "5 5 5 4111111111111111-", "a\x01b@c.d \x01 4111\x0111111111", "1" * 9000, "a." * 4000 + "@b.c"]
    hard += ["".join(rnd.choice("01459.@+- ()ab\n") for _ in range(120)) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(hard), (None, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.b for r in pii.scan(docs).select("doc_id", pii.joined(F.col("base")).alias("b")).collect()}
    assert got.pop(None) == ""
    for i, text in enumerate(hard):
        assert got[i] == _base(text), text[:100]


def test_contexts_discover_unseen_identifiers(spark, no_docs):
    rows = [(i, f"please phone +1 (171) 555-{2000 + i} tomorrow; total 99{i}0000{i} units") for i in range(20)]
    rows += [(100, "please phone 171-555-1234 tomorrow"), (101, "we sold 1234567 pieces")]
    out = {r.doc_id: r.s for r in pii.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
    assert out[100] == "phone:13:25" and out[101] == "" and out[3] == "phone:13:30"
    assert pii.scan(no_docs).count() == 0


# --- HTML -----------------------------------------------------------------------------------------------------------

def test_main_text():
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
            "<div class='ad-box'>Buy &amp; save</div><article><h1>Big  &lt;News&gt;</h1><p>First <b>bold</b>\n text &amp; more of it, long enough to count.<p>Second one."
            "<form><input name=q>Search</form><script>var x='</p>';</script><br>Third</p></article><section id=comments><p>A reader comment that is rather long indeed.</p></section>"
            "<footer>&copy; us</footer></body></html>")
    assert html.main_text(page) == "Big <News>\nFirst bold text & more of it, long enough to count.\nSecond one.\nThird"
    plain = "<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><div><p>" + "Some words of the story. " * 9 + "<p>" + "It goes on and on. " * 9 + "</div><div class=sidebar>Other things</div>"
    text = html.main_text(plain)
    assert text.startswith("Some words") and "One" not in text and "Other" not in text and text.count("\n") == 1
    laid_out = "<body><div class='wrap has-sidebar'><main class='page with-comments'><p>Kept text of some length.</p></main><div id='Sidebar'>no</div></div>"
    assert html.main_text(laid_out) == "Kept text of some length."
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("<article><p>cut off text here <a hre") == "cut off text here"
    assert html.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"

LONG = "This is a long paragraph of an article with quite many words, so that it is text and no menu. " * 3
PARA = f"<p>{LONG}</p>"


def _cut(page: str) -> list[str]:
    return [x[:12] for x in html.main_text(page).split("\n")]


def test_names_of_the_layout_and_of_other_things_keep_their_text():
    text = "This is a lo"
    assert _cut(f"<body><nav><a href=x>Home</a></nav><div class='main sidebar-right'><h1>Title</h1>{PARA}{PARA}</div></body>") == ["Title", text, text]
    assert _cut(f"<body><article>{PARA}<div class='share-price'>The price is 12</div><p class='notice-board'>On the board</p>{PARA}</article></body>") == [text, "The price is", "On the board", text]
    assert _cut(f"<body><div class='wrapper right-sidebar'><div>{PARA}{PARA}</div></div><p>foot</p></body>") == [text, text]
    assert _cut(f"<body><article class='post'><div class='share'>{PARA}{PARA}</div></article></body>") == [text, text]


def test_claims_that_hold_go():
    text = "This is a lo"
    for name in ("ad", "ad-box", "sidebar left", "cookie-notice", "newsletter-signup-form", "related_posts", "comments", "comment-list"):
        for page in (f"<article><h1>Title</h1>{PARA}{PARA}<div class='{name}'>{PARA}</div></article>", f"<div><h1>Title</h1>{PARA}{PARA}</div><div id='{name}'>{PARA}</div>"):
            assert _cut(f"<body>{page}</body>") == ["Title", text, text], (name, page)
    assert _cut(f"<body><div class='post'>{PARA}</div><div id='comments'><div class='comment-body'>{PARA}</div>{PARA}{PARA}</div></body>") == [text]
    assert _cut(f"<body><div class=ad>{LONG}</div><article><h1>Short one</h1><p>Few words</p></article></body>") == ["Short one", "Few words"]


def test_every_marked_line_of_sibling_containers_stays():
    text = "This is a lo"
    menu = "<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>"
    assert _cut(f"<body>{menu}<div><h2>Title</h2>{PARA * 8}</div>{menu}<div><p>Brief</p>{PARA}</div><p><a href=3>Next</a></p></body>") == ["Title", *[text] * 8, "Brief", text]
    linked = f"<p><a href=9>{LONG}</a></p>"
    assert _cut(f"<body>{menu}<div>{PARA}{linked}{PARA}</div></body>") == [text] * 3


def test_extract_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>", "a"), (None, None, None, None), (1, "u", "<article><p>x</p></article>", "a"), (2, "u", "", "b")],
                                  "page_id bigint, url string, html string, text string")
    out = html.extract(pages).collect()
    assert sorted(r.text for r in out) == ["", "", "x", "x"] and {r.row.text for r in out} == {"a", "b", None}
    assert html.extract(pages.limit(0)).count() == 0


# --- MinHash --------------------------------------------------------------------------------------------------------

def _shingles(text: str | None, n: int) -> set:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = WORD.findall(low)
    return set(zip(*[ws[i:] for i in range(n)])) if len(ws) >= n else ({tuple(ws)} if ws else set())


@pytest.mark.parametrize("text", ["", " ", "a", "A b", " a b c", "The the the the", "  x\ty\nz ", "é à É c é à É", "aa a a aa a a aa", None, "a\x00b c d e f"])
def test_shingle_sets(text):
    assert len(minhash.shingle_set(text, 3)) == len(_shingles(text, 3))


def _near_corpus():
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(12):
        base = [rnd.choice(vocab) for _ in range(120)]
        for _ in range(rnd.choice([1, 3, 40])):
            ws = list(base)
            for _ in range(rnd.randint(0, 5)):
                ws[rnd.randrange(len(ws))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(ws)))
    return rows


def test_near_duplicates_equal_all_pairs(spark):
    rows = _near_corpus()
    sets = [_shingles(t, 3) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=3, jaccard=(100, 85))
    got = {r.doc_id: (r.component_id, r.kept, r.n_shingles) for r in out.select("row.doc_id", "component_id", "kept", "n_shingles").collect()}
    assert got == {i: (root(i), root(i) == i, len(sets[i])) for i in range(len(rows))}


def test_near_duplicates_odd_rows(spark, odd_docs, no_docs):
    out = minhash.near_duplicates(odd_docs).select("row.*", "n_shingles", "component_id", "kept").collect()
    assert len(out) == 9
    same = [r for r in out if r.text == "a b c d e f g h"]
    assert {r.component_id for r in same} == {1} and sum(r.kept for r in same) == 1
    assert all(r.kept and r.n_shingles == 0 for r in out if not (r.text or "").strip())
    long = [r for r in out if r.source == "t"]
    assert {r.component_id for r in long} == {5} and [r.doc_id for r in long if r.kept] == [5]
    assert minhash.near_duplicates(no_docs).count() == 0
    assert minhash.deduplicated(odd_docs).columns == odd_docs.columns


# --- line dedup -----------------------------------------------------------------------------------------------------

def _gone(docs: list[tuple[int, str]], least: int) -> dict[int, set[int]]:
    lines = {i: t.split("\n") for i, t in docs}
    first: dict[tuple, tuple] = {}
    runs = [(i, a, b) for i in sorted(lines) for a in range(len(lines[i])) for b in range(a, len(lines[i]))]
    gone = defaultdict(set)
    for i, a, b in runs:
        key = tuple(lines[i][a:b + 1])
        seen = first.setdefault(key, (i, a))
        if seen != (i, a) and sum(len(WORD.findall(x)) for x in key) >= least:
            gone[i] |= set(range(a, b + 1))
    return gone


def test_line_dedup_equals_all_runs(spark):
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 6))) for _ in range(14)]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14)))) for i in range(60)]
    want = _gone(docs, 9)
    assert sum(map(len, want.values())) > 20
    for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), 9).select("row.doc_id", "row.text", "gone", "kept_text").collect():
        assert set(r.gone) == want.get(r.doc_id, set()), r
        assert r.kept_text == "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in want.get(r.doc_id, set()))


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    out = linededup.dedup_lines(odd_docs, 5).select("row.*", "n_lines", "gone", "kept_text").collect()
    assert len(out) == 9
    same = [r for r in out if r.text == "a b c d e f g h"]
    assert sorted(r.kept_text for r in same) == ["", "", "a b c d e f g h"] and all(r.kept_text is None and r.n_lines == 0 for r in out if r.text is None)
    assert linededup.dedup_lines(no_docs).count() == 0
    kept = linededup.deduplicated(odd_docs, 5)
    assert kept.columns == odd_docs.columns and kept.count() == 7  # two emptied copies go; empty and null ones stay


# --- licences -------------------------------------------------------------------------------------------------------

def test_licences(spark, odd_docs, no_docs):
    rnd = random.Random(6)
    rows = [(i, "\n".join(" ".join(rnd.choice("lorem ipsum dolor under this work is free software in the public".split()) for _ in range(12)) for _ in range(4))) for i in range(200)]
    notes = {"MIT": "Released under the MIT License.", "CC": "Licensed under CC BY-NC 4.0.", "GPL": "This work is licensed under the GNU General Public License, version 3.",
             "Apache": "Foo bar. Licensed under the Apache License, Version 2.0."}
    rows += [(1000 + k, f"plain words here\n{note}\nmore") for k, note in enumerate(notes.values())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    c = licenses.fit(docs)
    got = {r.doc_id: [(x.paragraph, x.family) for x in r.licences] for r in licenses.scan(docs, c).select("row.doc_id", "licences").collect()}
    assert [got[1000 + k] for k in range(4)] == [[(1, f)] for f in notes] and not any(got[i] for i in range(200))
    for paragraph in ("the gnu grazes", "an MIT lecture", "All the people reserved a table"):
        assert c.classify(paragraph)[0] == "unknown"
    assert all(r.licences == [] for r in licenses.scan(odd_docs, licenses.fit(odd_docs)).collect())
    assert licenses.scan(no_docs, licenses.fit(no_docs)).count() == 0


# --- mixing ---------------------------------------------------------------------------------------------------------

def test_mixing_meets_the_weights_and_keeps_all_columns(spark, odd_docs, no_docs):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"),
                                      F.lit("ten chars.").alias("text"))
    mixed = mixing.mix(docs, weights={"hot": 0.1, "s0": 0.6, "s1": 0.3}, budget=2.0)
    share = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    total = sum(share.values())
    assert set(share) == {"hot", "s0", "s1"} and abs(total - 40_000) < 1000 and abs(share["s0"] / total - 0.6) < 0.02
    a = mixing.mix(docs).groupBy("doc_id").count()
    assert a.exceptAll(mixing.mix(docs.repartition(7)).groupBy("doc_id").count()).count() == 0
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0


def test_poisson_inversion(spark):
    for mean in (0.3, 4.0, 40.0):
        pieces, cdf = mixing.poisson_table(F.lit(mean))
        df = spark.range(20_000).select(pieces.alias("p"), cdf.alias("c"), F.col("id").cast("string").alias("k"))
        n = df.select(mixing.poisson_count(F.col("p"), F.col("c"), lambda j: mixing.uniform(F.col("k"), j.cast("string"))).alias("n"))
        m, v = n.agg(F.avg("n"), F.var_samp("n")).first()
        assert abs(m - mean) < 0.05 * math.sqrt(mean) + 0.02 and abs(v / mean - 1) < 0.06
