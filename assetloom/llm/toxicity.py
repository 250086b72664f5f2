"""Toxic spans and document scores from a linear-chain conditional random field.

Labels exist per document only, so the tokens of a bounded labelled sample are labelled first: word features that stand
out in toxic documents mark tokens of toxic documents, every token of a clean document is clean. A chain with the states
"clean" and "toxic" is trained on those tokens. Forward-backward marginals of all tokens of a text give the offending
offsets, and their sums, through a calibrated logistic, the document's score.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import shingle_set

#: Bounds of the labelled sample: documents per class, and characters of each class. Scoring itself has no bound.
TOXIC_DOCS, CLEAN_DOCS, SAMPLE_CHARS = 2000, 4000, 12_000_000
#: Tokens that the chain is trained on.
TRAIN_TOKENS = 400_000
#: A sequence is a line; longer lines are cut into chains of so many tokens.
CHAIN = 256
#: Characters scored at once by a task.
SLICE_CHARS = 2_000_000
#: Different tokens whose emissions a task keeps.
TOKENS = 500_000
#: Lengths of the affixes that are features of a word.
PREFIXES, SUFFIXES = range(2, 6), range(3, 6)
TOKEN = re.compile(r"\S+")
LIMIT = 30.0


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from: crc32 of the id as text leaves 0 by 5. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(token: str) -> list[str]:
    """The word itself and its affixes; case and surrounding punctuation do not count."""
    w = token.lower().strip(punctuation)
    if not w:
        return []
    n = len(w)
    return ["w" + w, *["p" + w[:k] for k in PREFIXES if k < n], *["s" + w[-k:] for k in SUFFIXES if k < n]]


@dataclass
class Chain:
    """Weights of the chain: ``weight`` per feature for "toxic", ``bias``, log-potentials ``step[from, to]``."""

    weight: dict[str, float] = field(default_factory=dict)
    bias: float = -LIMIT
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-LIMIT, 0.0, 0.0]))


class _Memo:
    """Lower-case tokens, numbered as they come, and the emission of each before it is clipped."""

    def __init__(self, chain: Chain):
        self.bias = chain.bias
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.emission = np.empty(0)
        self.weights = []  # of the words, then of the affixes of each length; the last weight is that of unknown ones
        for kind, k in [("w", 0), *(("p", k) for k in PREFIXES), *(("s", k) for k in SUFFIXES)]:
            known = {f[1:]: x for f, x in chain.weight.items() if f[0] == kind and k in (0, len(f) - 1)}
            self.weights.append((kind, k, pa.array(list(known), pa.string()), np.array([*known.values(), 0.0])))

    def emissions(self, lines: Iterable[list[str]]) -> np.ndarray:
        """Emission of each token of the lines."""
        if len(self.number) > TOKENS:
            self.number.clear()
            self.emission = np.empty(0)
        numbers = array("q")
        for line in lines:
            numbers.extend(map(self.number.__getitem__, line))
        new = [token.strip(punctuation) for token in islice(self.number, len(self.emission), None)]
        self.emission = np.append(self.emission, self.bias + self._weight(pa.array(new, pa.string())))
        return self.emission[np.array(numbers, np.int64)]

    def _weight(self, words: pa.Array) -> np.ndarray:
        """Sum of the weights of each word's features, compensated as that of the built-in ``sum``."""
        n = pc.utf8_length(words).to_numpy()
        total, lost = np.zeros(len(words)), np.zeros(len(words))
        for kind, k, names, weight in self.weights:
            part = words if kind == "w" else pc.utf8_slice_codeunits(words, 0, k) if kind == "p" else pc.utf8_slice_codeunits(words, -k)
            x = weight[pc.fill_null(pc.index_in(part, value_set=names), len(names)).to_numpy()]
            if k:
                x[n <= k] = 0.0
            after = total + x
            lost += np.where(np.abs(total) >= np.abs(x), (total - after) + x, (x - after) + total)
            total = after
        return total + lost


def marginals(emission: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of "toxic" per token of chains laid end to end; also the forward and backward ratios.

    All chains advance together: at place t the chains longer than t, longest first, take one step.
    """
    lengths = np.asarray(lengths, np.int64)
    psi, push = np.exp(step), np.exp(emission)
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    start, lengths = start[order], lengths[order]
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, (lengths[0] if len(lengths) else 0) + 1))
    ahead, back = np.empty_like(emission), np.ones_like(emission)
    for t, n in enumerate(alive):
        at = start[:n] + t
        if t == 0:
            ahead[at] = push[at]
        else:
            r = ahead[at - 1]
            ahead[at] = push[at] * (psi[0, 1] + r * psi[1, 1]) / (psi[0, 0] + r * psi[1, 0])
    for t in range(len(alive) - 2, -1, -1):
        at = start[:alive[t + 1]] + t
        q = push[at + 1] * back[at + 1]
        back[at] = (psi[1, 0] + psi[1, 1] * q) / (psi[0, 0] + psi[0, 1] * q)
    return np.log(ahead) + np.log(back), ahead, back


def chains_of(text: str) -> list[list[str]]:
    out = []
    for line in text.split("\n"):
        tokens = line.split()
        out += [tokens[i:i + CHAIN] for i in range(0, len(tokens), CHAIN)]
    return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def document_evidence(odds: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Per document: log of the expected number of toxic tokens, and the largest log-odds."""
    n = len(tokens)
    total, top = np.full(n, 1e-9), np.full(n, -LIMIT)
    some = np.flatnonzero(tokens)
    if len(some):
        at = (np.cumsum(tokens) - tokens)[some]
        total[some] += np.add.reduceat(_sigmoid(odds), at)
        top[some] = np.clip(np.maximum.reduceat(odds, at), -LIMIT, LIMIT)
    return np.stack([np.ones(n), np.log(total), top], axis=1)


def score_texts(chain: Chain, memo: _Memo, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Evidence per text, token log-odds, and tokens per line of each text."""
    lines: list[list[int]] = []

    def tokens() -> Iterator[list[str]]:  # a text at a time
        for text in texts:
            split = [line.split() for line in text.lower().split("\n")]  # as many as before: no white space has a case
            lines.append([len(line) for line in split])
            yield from split

    emission = np.clip(memo.emissions(tokens()), -LIMIT, LIMIT)
    lengths = [min(CHAIN, n - i) for text in lines for n in text for i in range(0, n, CHAIN)]
    odds = marginals(emission, np.array(lengths, np.int64), chain.step)[0] if lengths else np.empty(0)
    return document_evidence(odds, np.array([sum(x) for x in lines], np.int64)), odds, lines


def _marked_features(texts: list[str], toxic: np.ndarray) -> set[str]:
    """Features that occur far more often in toxic than in clean documents, by likelihood ratio and precision.

    Near copies (equal MinHash of their word triples) count once, or the rare words of a copied text would stand out.
    """
    seen: set[tuple[int, bool]] = set()
    hits, misses = Counter(), Counter()
    n = [0, 0]
    for wanted in (True, False):  # toxic texts first: only their features need counts in clean ones
        for text, bad in zip(texts, toxic, strict=True):
            if bool(bad) != wanted:
                continue
            s = shingle_set(text, 3)
            key = (int(s.min()) if len(s) else 0, wanted)
            if key in seen:
                continue
            seen.add(key)
            n[wanted] += 1
            found = {f for w in set(text.split()) for f in features(w)}
            if wanted:
                hits.update(found)
            else:
                misses.update(f for f in found if f in hits)
        if wanted:
            hits = Counter({f: t for f, t in hits.items() if t >= 3})
    marked = set()
    share = n[1] / max(1, sum(n))
    for f, t in hits.items():
        c = misses.get(f, 0)
        if t <= c:
            continue
        p = t / (t + c)
        gain = 2 * (t * np.log(p / share) + (c * np.log((1 - p) / (1 - share)) if c else 0.0))
        if gain >= 20:
            marked.add(f)
    return marked


def _training_chains(texts: list[str], toxic: np.ndarray, rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Labelled chains within the token bound: half with toxic tokens, half without, in random order."""
    marked = _marked_features(texts, toxic)
    verdict: dict[str, int] = {}
    one: dict[str, str] = {}
    half, out = TRAIN_TOKENS // 2, []
    room = [half, half]
    for k in rng.permutation(len(texts)):
        for seq in chains_of(texts[k]):
            if toxic[k]:
                for w in seq:
                    if w not in verdict:
                        verdict[w] = int(not marked.isdisjoint(features(w)))
                y = [verdict[w] for w in seq]
            else:
                y = [0] * len(seq)
            side = int(any(y))
            if room[side] > 0:
                room[side] -= len(seq)
                out.append(([one.setdefault(w, w) for w in seq], y))
        if max(room) <= 0:
            break
    rng.shuffle(out)
    return out


def train(texts: list[str], toxic: np.ndarray, prior: float, epochs: int = 10, seed: int = 7) -> Chain:
    """A chain from labelled texts; ``prior`` is the share of toxic documents that scores are calibrated to.

    With texts of one class only, the score is constant: that class's side of the prior.
    """
    toxic = np.asarray(toxic, bool)
    chain = Chain()
    if not toxic.any() or toxic.all():
        chain.calibration = np.array([LIMIT if len(toxic) and toxic.all() else -LIMIT, 0.0, 0.0])
        return chain
    rng = np.random.default_rng(seed)
    chosen = _training_chains(texts, toxic, rng)
    count = Counter(f for seq, _ in chosen for w in set(seq) for f in features(w))
    index = {f: i for i, f in enumerate(sorted(f for f, c in count.items() if c >= 3))}
    del count
    weight, bias, step = np.zeros(len(index)), 0.0, np.zeros((2, 2))
    g_w, g_b, g_s = np.full(len(index), 1e-6), 1e-6, np.full((2, 2), 1e-6)
    batches = []
    for k in range(0, len(chosen), 400):
        part = chosen[k:k + 400]
        known = {w: [index[f] for f in features(w) if f in index] for seq, _ in part for w in seq}
        ids = [known[w] for seq, _ in part for w in seq]
        flat = np.fromiter((i for x in ids for i in x), np.int64)
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        batches.append((flat.astype(np.int32), owner.astype(np.int32), np.array([v for _, y in part for v in y], float), np.array([len(seq) for seq, _ in part], np.int64)))
    for _ in range(epochs):
        for flat, owner, y, lengths in batches:
            e = np.clip(bias + np.bincount(owner, weight[flat], len(y)), -LIMIT, LIMIT)
            odds, ahead, back = marginals(e, lengths, step)
            p = _sigmoid(odds)
            diff = (p - y) / len(lengths)
            d_w = np.bincount(flat, diff[owner], len(weight)) + 1e-4 * weight / len(batches)
            d_b = diff.sum()
            inner = np.ones(len(y), bool)
            inner[np.cumsum(lengths) - lengths] = False  # tokens with a predecessor
            at = np.flatnonzero(inner)
            psi, push = np.exp(step), np.exp(e)
            d_s = np.zeros((2, 2))
            joint = np.stack([psi[i, j] * (ahead[at - 1] if i else 1.0) * ((push[at] * back[at]) if j else 1.0) + np.zeros(len(at)) for i in (0, 1) for j in (0, 1)])
            joint /= joint.sum(axis=0)
            for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                d_s[i, j] = (joint[k].sum() - ((y[at - 1] == i) & (y[at] == j)).sum()) / len(lengths)
            g_w += d_w ** 2
            g_b += d_b ** 2
            g_s += d_s ** 2
            weight -= 0.5 * d_w / np.sqrt(g_w)
            bias -= 0.5 * d_b / np.sqrt(g_b)
            step -= 0.2 * d_s / np.sqrt(g_s)
    chain.weight = {f: float(weight[i]) for f, i in index.items() if abs(weight[i]) > 1e-3}
    chain.bias, chain.step = float(bias), step
    x = score_texts(chain, _Memo(chain), texts)[0]
    balance = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps with a little ridge
        p = _sigmoid(x @ beta)
        grad = x.T @ (balance * (p - toxic)) + 0.5 * beta
        hess = (x * (balance * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -5, 5)
    chain.calibration = beta
    return chain


def _first_ids(known: DataFrame, n: dict[int, int], bounds: dict[int, int]) -> DataFrame:
    """Of each class about twice as many ids as its bound, those of least hash; all ids of a small class."""
    last = {y: min(2 ** 63 - 1, 2 ** 65 * (bound + 50) // max(1, n.get(y, 0)) - 2 ** 63) for y, bound in bounds.items()}
    return known.where(F.col("turn") <= F.when(F.col("y") == 1, last[1]).when(F.col("y") == 0, last[0]))


def _choose(known: DataFrame, texts: DataFrame, n: dict[int, int], bounds: dict[int, int], sample_chars: int) -> tuple[list[tuple], bool]:
    """``(id, h, y)`` of the sample, and whether a class has more ids than its bound but not that many with a text that fits."""
    one = texts.groupBy("id").agg(F.min(F.struct("h", F.length("text").alias("n"))).alias("t"))  # a row per id before any join
    labelled = known.join(one, "id").select("id", "y", "turn", "t.*")
    taken, short = [], False
    for y, bound in bounds.items():
        room = sample_chars
        found = labelled.where((F.col("y") == y) & (F.col("n") <= sample_chars)).orderBy("turn", "id").limit(bound).collect()
        short |= len(found) < min(bound, n.get(y, 0))
        for r in found:
            if r.n <= room:
                room -= r.n
                taken.append((r.id, r.h, r.y))
    return taken, short


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, sample_chars: int = SAMPLE_CHARS) -> Chain:
    """Train on a bounded sample of labelled documents that are not held out.

    Each class has its own order by hash and its own bounds: the first ``toxic_docs`` or ``clean_docs`` ids, as far as
    their whole texts stay within ``sample_chars`` characters; a text that does not fit is passed over. Null labels and
    null ids are left out; a document with several labels is toxic if one of them says so. A class that has labels but
    no text is an error, since the scores would be constant; an empty table is not.
    """
    order = F.xxhash64(F.col("id").cast("string"), F.lit("sample"), F.col("y"))
    known = (labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{toxic}`").cast("int").alias("y"))
             .where("id is not null and y is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y")).withColumn("turn", order))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    bounds = {1: toxic_docs, 0: clean_docs}
    plain = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).where("id is not null")
    # Ids alone decide the order: the rows of the first few are read once and kept. Only if too few of those have a text that fits, all are looked at.
    few = _first_ids(known, n, bounds)
    texts = plain.join(F.broadcast(few.select("id")), "id", "left_semi").withColumn("h", F.xxhash64("text")).persist()
    taken, short = _choose(few, texts, n, bounds, sample_chars)
    if short:
        texts.unpersist()
        texts = plain.withColumn("h", F.xxhash64("text"))
        taken, _ = _choose(known, texts, n, bounds, sample_chars)
    rows = []
    if taken:
        wanted = F.broadcast(docs.sparkSession.createDataFrame(taken, known.join(texts, "id").select("id", "h", "y").schema))
        rows = texts.join(wanted, ["id", "h"]).groupBy("id", "h", "y").agg(F.first("text").alias("text")).collect()  # equal rows give one
    texts.unpersist()
    empty = [y for y in (1, 0) if n.get(y) and not any(r.y == y for r in rows)]
    if empty and not docs.isEmpty():
        raise ValueError(f"no text of at most {sample_chars} characters for the labels {toxic} = {empty}")
    rows.sort(key=lambda r: (str(r.id), r.text))
    prior = n.get(1, 0) / max(1, sum(n.values()))
    return train([r.text for r in rows], np.array([r.y == 1 for r in rows], bool), prior)


def _scorer(chain: Chain):
    def spans_of(text: str, hits: list[int], lines: list[int]) -> str:
        spans: list[tuple[int, int]] = []
        last, first, at = -2, 0, 0  # first token and place of the line; places are looked for in lines that hold a hit
        for line, n in zip(text.split("\n"), lines, strict=True):
            mine = hits[bisect_left(hits, first):bisect_left(hits, first + n)]
            places = list(TOKEN.finditer(line)) if mine else []
            for k in mine:
                start, end = places[k - first].span()
                if k == last + 1 and spans:
                    spans[-1] = (spans[-1][0], at + end)
                else:
                    spans.append((at + start, at + end))
                last = k
            first += n
            at += len(line) + 1
        return ",".join(f"{a}:{b}" for a, b in spans)

    def flush(texts: list[str], memo: _Memo):
        evidence, odds, lines = score_texts(chain, memo, texts)
        score = _sigmoid(evidence @ chain.calibration)
        spans, first = [], 0
        for text, own, hit in zip(texts, lines, evidence[:, 2] >= 0, strict=True):
            n = sum(own)
            spans.append(spans_of(text, np.flatnonzero(odds[first:first + n] >= 0).tolist(), own) if hit else "")
            first += n
        return score, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(chain)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            scores, spans, part, room = [], [], [], SLICE_CHARS
            for value in column:
                part.append(value.as_py() or "")
                room -= len(part[-1])
                if room <= 0:
                    s, p = flush(part, memo)
                    scores += s.tolist()
                    spans += p
                    part, room = [], SLICE_CHARS
            if part:
                s, p = flush(part, memo)
                scores += s.tolist()
                spans += p
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(spans, pa.string())],
                                             names=[*batch.schema.names[:-1], "score", "spans"])
    return run


def score(docs: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``, or all), ``score`` (0 to 1), ``predicted`` and ``spans`` (``start:end`` in code points) of every row.

    One pass, no shuffle; each task keeps one slice of texts in memory, and a very long text is one slice. Null and
    empty texts have no token and get the score that no evidence gives. Repeated rows get equal scores.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    out = rows.mapInArrow(_scorer(chain), f"row {rows.schema['row'].dataType.simpleString()}, score double, spans string")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those that the chain, trained on the labels that are not held out, scores as toxic."""
    kept = score(docs, fit(docs, labels)).where("predicted = 0")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
