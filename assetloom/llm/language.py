"""Language of documents by a string kernel: presence of shared n-grams, Nystroem landmarks, kernel ridge regression.

A text is lower-cased and every run of characters that are not letters becomes one space. The blended-spectrum kernel
of two texts is the number of n-grams of 1 to ``ORDER`` characters that are present in both, over the geometric mean of
the numbers present in each. It is defined on the n-grams that stand in at least ``MIN_DOCS`` texts of the training
sample. Landmarks are texts of the sample; the kernel between them gives the Nystroem map, and one ridge regression per
language against all others is solved on the mapped sample. Scoring is two products of matrices per block of
documents: presence by landmarks, landmarks by languages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .toxicity import held_out

UNDETERMINED = "und"
#: Longest n-gram; texts of the sample in which an n-gram stands; most n-grams, the commonest first.
ORDER, MIN_DOCS, VOCABULARY = 4, 5, 32_768
#: Bounds of the training sample: languages (the commonest), texts in all, characters of a text. Longer texts are not trained on.
LANGUAGES, SAMPLE_DOCS, SAMPLE_CHARS = 200, 1600, 20_000
LANDMARKS, RIDGE = 64, 0.05
#: Documents of one block; characters whose n-grams are hashed at a time.
BLOCK, SLICE_CHARS = 64, 1 << 20

_OTHER = re.compile(r"[\W\d_]+")
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_BITS = 18
#: Largest table of a tree; a vocabulary with more letters than fit is looked up by hash.
TREE_CELLS = 1 << 24
_SPACE = 1


def plain(text: str) -> str:
    """Letters in lower case, with one space for each run of anything else and at both ends."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def ngram_hashes(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each length, the 64-bit hash of the n-gram that starts at each code point."""
    wide = codes.astype(np.uint64) + np.uint64(1)
    h = wide * _STEP
    yield h
    for n in range(2, ORDER + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _STEP + wide[n - 1:]
        yield h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Index:
    """N-gram hash to column: tables addressed by bits of the hash, each holding what found no place in the one before."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))  # the last place is that of no n-gram
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        left = np.arange(len(keys), dtype=np.int32)
        turn = 0
        while len(left):
            by = _SPREAD[turn % len(_SPREAD)] + np.uint64(2 * (turn // len(_SPREAD)))
            table = np.full(1 << _BITS, len(keys), np.int32)
            at = self._at(keys[left], by)
            table[at] = left
            self.tables.append((by, table))
            left = left[table[at] != left]
            turn += 1

    @staticmethod
    def _at(h: np.ndarray, by: np.uint64) -> np.ndarray:
        return ((h * by) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known hashes in ``h``, and their columns."""
        places, columns = [], []
        for by, table in self.tables:
            column = table[self._at(h, by)]
            hit = np.flatnonzero(self.keys[column] == h)
            places.append(hit[column[hit] < len(self.keys) - 1])
            columns.append(column[places[-1]])
        return np.concatenate(places), np.concatenate(columns)


    @property
    def nodes(self) -> int:
        return len(self.keys)

    def codes(self, text: str) -> np.ndarray:
        """Code points of a lower-case text in its plain form, and a zero."""
        return np.append(_codes(plain(text)), np.uint32(0))

    def columns(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """For each length, the column of the n-gram that starts at each place; the last one if it is unknown."""
        for h in ngram_hashes(codes):
            out = np.full(len(h), len(self.keys) - 1)
            places, columns = self.find(h)
            out[places] = columns
            yield out


class Tree:
    """The n-grams as a tree of letters: ``step[node, letter]`` is the node of the n-gram that is one letter longer.

    The first nodes are the columns of the n-grams. Behind them stand one for all that is unknown, the root, and
    beginnings of n-grams that are no n-grams of the kernel themselves. Letter 0 is in no n-gram, ``_SPACE`` is
    whatever is not a letter.
    """

    def __init__(self, grams: list[str]):
        alphabet = sorted(set("".join(grams)) - {" "})
        every = "".join(map(chr, range(0x110000)))
        self.letters = np.zeros(len(every), np.uint16)
        for m in _OTHER.finditer(every):
            self.letters[m.start():m.end()] = _SPACE
        number = {" ": _SPACE} | {c: k for k, c in enumerate(alphabet, _SPACE + 1)}
        self.letters[[ord(c) for c in alphabet]] = list(number.values())[1:]
        node = {g: k for k, g in enumerate(grams)}
        self.unknown, self.root = len(grams), len(grams) + 1
        node[""] = self.root
        for g in grams:
            for n in range(1, len(g)):
                node.setdefault(g[:n], len(node) + 1)
        self.nodes = len(node) + 1
        self.step = np.full((self.nodes, len(alphabet) + 2), self.unknown, np.int32)
        for g, k in node.items():
            if g:
                self.step[node[g[:-1]], number[g[-1]]] = k

    @staticmethod
    def fits(grams: list[str]) -> bool:
        return (len({g[:n] for g in grams for n in range(ORDER + 1)}) + 1) * (len(set("".join(grams))) + 2) <= TREE_CELLS

    def codes(self, text: str) -> np.ndarray:
        """Letters of a lower-case text in its plain form, and a zero."""
        codes = self.letters[_codes(f" {text} ")]
        space = codes == _SPACE
        return np.append(codes[np.append(True, ~(space[1:] & space[:-1]))], np.uint16(0))

    def columns(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """For each length, the node of the n-gram that starts at each place."""
        codes = codes.astype(np.intp)
        step, letters = self.step.reshape(-1), self.step.shape[1]
        node = self.step[self.root].take(codes)
        yield node
        for n in range(2, ORDER + 1):
            node = step.take(node[:-1] * letters + codes[n - 1:])
            yield node


class Model:
    """``languages``, ``index`` of n-grams and how they are found (``finder``), ``landmarks`` (scaled presence, n-grams by landmarks), ``weights``, ``sharpness``."""

    languages: list[str]

    def presence(self, texts: list[str]) -> np.ndarray:
        """Which n-grams of the kernel stand in each lower-case text: whole texts, in slices that overlap by an n-gram."""
        nodes = self.finder.nodes
        out = np.zeros((len(texts), nodes), bool)
        flat = out.reshape(-1)
        part, owner, room = [], [], SLICE_CHARS

        def mark():
            codes, rows = np.concatenate(part), np.repeat(np.array(owner) * nodes, [len(x) for x in part])
            for columns in self.finder.columns(codes):  # an n-gram that crosses from one text to the next holds a zero and is unknown
                flat[rows[:len(columns)] + columns] = True

        for row, text in enumerate(texts):
            codes = self.finder.codes(text)
            for start in range(0, len(codes), SLICE_CHARS):
                piece = codes[start:start + SLICE_CHARS + ORDER]
                part.append(piece)
                owner.append(row)
                room -= len(piece)
                if room <= 0:
                    mark()
                    part, owner, room = [], [], SLICE_CHARS
        if part:
            mark()
        return out[:, :len(self.index.keys) - 1].astype(np.float32)

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        """Kernel of rows and landmarks; a row without a known n-gram is like none of them."""
        own = np.sqrt(np.maximum(presence.sum(axis=1).astype(np.float64), 1.0))  # sums of ones, exact
        return (presence @ self.landmarks) / own[:, None]

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language and its share of the weight, for lower-case texts."""
        f = self.kernel(self.presence(texts)) @ self.weights + self.intercept
        e = np.exp(self.sharpness * (f - f.max(axis=1, keepdims=True)))
        best = f.argmax(axis=1)
        return best, e[np.arange(len(f)), best] / e.sum(axis=1)


def _spelled(index: Index, texts: list[str]) -> list[str]:
    """The n-grams of an index, as they stand in the plain texts that it was made from."""
    grams = [""] * (len(index.keys) - 1)
    missing = np.ones(len(grams), bool)
    for text in texts:
        for n, h in enumerate(ngram_hashes(_codes(text)), 1):
            places, columns = index.find(h)
            new = missing[columns]
            for place, column in zip(places[new].tolist(), columns[new].tolist(), strict=True):
                grams[column] = text[place:place + n]
            missing[columns] = False
        if not missing.any():
            break
    return grams


def train(rows: list[tuple[str, str]]) -> Model:
    """Fit on ``(language, text)``; the order of the rows picks the landmarks, in turn by language."""
    model = Model()
    model.languages = sorted({lang for lang, _ in rows})
    if not rows:
        return model
    texts = [plain(t) for _, t in rows]
    seen, times = np.unique(np.concatenate([np.unique(np.concatenate(list(ngram_hashes(_codes(t))))) for t in texts]), return_counts=True)
    enough = times >= min(MIN_DOCS, max(1, len(texts) // 4))
    seen, times = seen[enough], times[enough]
    model.index = Index(np.sort(seen[np.lexsort((seen, -times))[:VOCABULARY]]))
    grams = _spelled(model.index, texts)
    model.finder = Tree(grams) if Tree.fits(grams) else model.index
    presence = model.presence(texts)
    label = np.array([model.languages.index(lang) for lang, _ in rows])
    size = presence.sum(axis=1)
    turns = np.empty(len(rows), np.int64)
    for k in range(len(model.languages)):  # texts with many n-grams make the better landmarks
        mine = np.flatnonzero(label == k)
        mine = mine[np.argsort(size[mine] < np.median(size[mine]), kind="stable")]
        turns[mine] = np.arange(len(mine))
    chosen = np.lexsort((label, turns))[:max(LANDMARKS, len(model.languages))]
    marks = presence[chosen]
    model.landmarks = np.ascontiguousarray((marks / np.sqrt(np.maximum(marks.sum(axis=1), 1.0))[:, None]).T, np.float32)
    values, vectors = np.linalg.eigh(model.kernel(marks).astype(float))
    good = values > 1e-6 * values.max()
    to_features = vectors[:, good] / np.sqrt(values[good])
    x = model.kernel(presence) @ to_features
    y = np.where(label[:, None] == np.arange(len(model.languages)), 1.0, -1.0)
    x_mean, y_mean = x.mean(axis=0), y.mean(axis=0)
    xc = x - x_mean
    beta = np.linalg.solve(xc.T @ xc + RIDGE * np.eye(x.shape[1]), xc.T @ (y - y_mean))
    model.weights, model.intercept = to_features @ beta, y_mean - x_mean @ beta
    f = x @ beta + model.intercept

    def loss(sharpness: float) -> float:
        e = sharpness * (f - f.max(axis=1, keepdims=True))
        return float(np.mean(np.log(np.exp(e).sum(axis=1)) - e[np.arange(len(f)), label]))
    model.sharpness = min((0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0), key=loss)
    return model


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS,
        sample_chars: int = SAMPLE_CHARS) -> Model:
    """Train on a bounded sample of the rows that have a language, a text with a letter, and are not held out.

    Each of the (at most ``LANGUAGES``, the commonest) languages gives equally many distinct texts of at most
    ``sample_chars`` characters, those of least hash. Equal texts of a language count once, whatever their number.
    """
    known = (docs.where(~held_out(F.col(f"`{doc_id}`"))).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
             .where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= sample_chars)).withColumn("h", F.xxhash64("text")))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return train([])
    each = max(1, sample_docs // len(counts))
    # twice the share that is needed, so that the window below sees a few rows of each language, not all of them
    share = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, 2.0 * (each + 50) / max(1, r.n))))])
    drawn = (known.where(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).groupBy("lang", "h").agg(F.min("text").alias("text"))
             .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each))
    rows = sorted(drawn.select("lang", "h", "text").collect(), key=lambda r: (r.lang, r.h))
    return train([(r.lang, r.text) for r in rows])


def _scorer(model: Model):
    def flush(texts: list[str | None]) -> tuple[list[str], list[float]]:
        read = [(t or "").lower() for t in texts]
        known = [i for i, t in enumerate(read) if model.languages and any(map(str.isalpha, t))]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if known:
            best, share = model.score([read[i] for i in known])
            for i, b, s in zip(known, best.tolist(), share.tolist(), strict=True):
                names[i], scores[i] = model.languages[b], s
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            names: list[str] = []
            scores: list[float] = []
            for start in range(0, batch.num_rows, BLOCK):
                n, s = flush(column.slice(start, BLOCK).to_pylist())
                names += n
                scores += s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names[:-1], "lang_pred", "score"])
    return run


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns in ``keep``, or all), ``lang_pred`` and ``score`` (0 to 1) of every row of ``docs``.

    One pass, no shuffle, whole texts. A null text, one without a letter, and any text if no language was learned give
    ``und`` with score 0. A text with letters of which no n-gram is known gets the language that the intercepts favour,
    with a low score; ties go to the first language in order. Repeated rows get equal results; an empty table gives none.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(model), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
