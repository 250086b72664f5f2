"""Spelling variants: words one edit apart, found by probing generated edits against broadcast Bloom filters.

The vocabulary is sharded by length; a blocked Bloom filter per shard (blocks of eight 32-bit lanes, one bit in each)
is built by the tasks, merged block by block, and broadcast. Every word generates its edits as hashes: those with one
code point deleted, to be looked up among the shorter words, and those with one replaced by a larger one, among the
words of its own length. Insertions and smaller replacements are the same pairs seen from the other word. Only the
edits that a filter admits become strings; they are joined to the vocabulary, which removes what is admitted wrongly.

Filters are broadcast within ``BROADCAST_BYTES``: if all shards together are larger, they go in several passes, and a
shard that is larger by itself is cut by hash. Each pass reads only the words whose edits can be in its shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Shortest word, fewest occurrences, how many times commoner a form must be; every DAMAGE-th run loses a code point.
LEAST_LENGTH, LEAST_COUNT, FACTOR, DAMAGE = 7, 2, 10, 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}+"
#: Filter bits for a word; bytes of filters in one broadcast; edits hashed at a time.
WORD_BITS, BROADCAST_BYTES, EDITS = 16, 64 << 20, 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)  # odd numbers
_LANES = [f"l{i}" for i in range(8)]


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` (occurrences) of all words of whole texts, as a written table.

    Words are runs of letters with A-Z lower-cased; of the runs whose crc32 of ``id:run`` is divisible by ``DAMAGE``,
    one code point goes. Null texts have no words; a null id counts as ''.
    """
    runs = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("d"),
                       F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("d", F.translate("run", UPPER, LOWER).alias("w"))
    h = F.crc32(F.concat("d", F.lit(":"), "w").cast("binary"))
    cut = (h % F.length("w")).cast("int")
    word = F.when(h % DAMAGE == 0, F.concat(F.substr("w", F.lit(1), cut), F.substr("w", cut + 2))).otherwise(F.col("w"))
    counted = low.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return written(counted.where(F.col("n") >= LEAST_COUNT), "vocabulary")


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.cumprod(np.full(n - 1, _BASE, np.uint64), dtype=np.uint64)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their code points as rows."""
    sizes = np.array([len(w) for w in words])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.frombuffer("".join([words[i] for i in at]).encode("utf-32-le"), np.uint32).reshape(len(at), n)


class Shards:
    """Where the filters of one pass lie: by length, the first block, the number of blocks, and which hash parts are here."""

    def __init__(self):
        self.at: dict[int, tuple[int, int, int, int]] = {}  # length: first block, blocks, part, parts
        self.blocks = 0

    def add(self, length: int, blocks: int, part: int, parts: int) -> None:
        self.at[length] = (self.blocks, blocks, part, parts)
        self.blocks += blocks

    def places(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For mixed hashes: which belong to the part here, their block, and the 32 bits that choose the lanes' bits."""
        first, blocks, part, parts = self.at[length]
        here = np.flatnonzero(h % np.uint64(parts) == part) if parts > 1 else np.arange(len(h))
        h = h[here]
        return here, first + ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), h.astype(np.uint32)


def planned(counts: list[tuple[int, int]], broadcast_bytes: int = BROADCAST_BYTES) -> list[Shards]:
    """Passes over the shards of ``(length, words)``: filters of at most ``broadcast_bytes`` in each."""
    most = max(1, broadcast_bytes // 32)
    passes = [Shards()]
    for length, n in sorted(counts):
        blocks = max(4, -(-n * WORD_BITS // 256))
        parts = -(-blocks // most)
        for part in range(parts):
            size = -(-blocks // parts)
            if passes[-1].blocks + size > most or length in passes[-1].at:
                passes.append(Shards())
            passes[-1].add(length, size, part, parts)
    return passes


def _filter_rows(shards: Shards):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, lanes = [], []
            for _, codes in _by_length(batch.column(0).to_pylist()):
                h = _mixed(((codes.astype(np.uint64) + np.uint64(1)) * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64))
                _, block, bits = shards.places(codes.shape[1], h)
                blocks.append(block)
                lanes.append(np.uint32(1) << ((bits[:, None] * _SALTS) >> np.uint32(27)))
            block, lane = np.concatenate([*blocks, np.empty(0, np.int64)]), np.concatenate([*lanes, np.empty((0, 8), np.uint32)])
            if not len(block):
                continue
            order = np.argsort(block, kind="stable")
            start = np.flatnonzero(np.diff(block[order], prepend=-1))
            merged = np.bitwise_or.reduceat(lane[order], start).view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block[order][start]), *[pa.array(np.ascontiguousarray(merged[:, i])) for i in range(8)]], names=["block", *_LANES])
    return run


def built(words: DataFrame, shards: Shards) -> np.ndarray:
    """The filters of one pass, ``blocks x 8`` lanes: at most ``BROADCAST_BYTES`` reach the driver."""
    rows = words.where(F.col("len").isin(*shards.at)).select("word").mapInArrow(_filter_rows(shards), f"block bigint, {', '.join(f'{x} int' for x in _LANES)}")
    merged = rows.groupBy("block").agg(*[F.bit_or(x).alias(x) for x in _LANES]).toArrow()
    out = np.zeros((shards.blocks, 8), np.uint32)
    out[merged["block"].to_numpy()] = np.stack([merged[x].to_numpy().view(np.uint32) for x in _LANES], axis=1)
    return out


def _admitted(shards: Shards, filters: np.ndarray, length: int, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter of ``length`` admits."""
    here, block, bits = shards.places(length, _mixed(h))
    for lane in range(8):
        bit = (filters[block, lane] >> ((bits * _SALTS[lane]) >> np.uint32(27))) & np.uint32(1)
        hit = np.flatnonzero(bit)
        here, block, bits = here[hit], block[hit], bits[hit]
    return here


def _prober(shards: Shards, shared, alphabet: np.ndarray):
    def edits_of(codes: np.ndarray, filters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Admitted edits of words of one length: row, position, and the new code point, 0 for a deletion."""
        n = codes.shape[1]
        power = _powers(n)
        wide = codes.astype(np.uint64) + np.uint64(1)
        total = (wide * power).sum(axis=1, dtype=np.uint64)
        if n - 1 in shards.at:
            before = np.cumsum(wide * power, axis=1, dtype=np.uint64)
            # what follows the deleted place moves down by one power; of a run of equal code points only the first is deleted
            h = before - wide * power + (total[:, None] - before) * _INVERSE
            row, place = np.nonzero(np.diff(codes.astype(np.int64), axis=1, prepend=-1))
            hit = _admitted(shards, filters, n - 1, h[row, place])
            yield row[hit], place[hit], np.zeros(len(hit), np.uint32)
        if n not in shards.at:
            return
        wide_step = max(1, EDITS // (len(codes) * len(alphabet)))
        for p in range(0, n, wide_step):
            old = codes[:, p:p + wide_step]
            row, place, letter = np.nonzero(alphabet[None, None, :] > old[:, :, None])
            new = alphabet[letter]
            h = total[row] + (new.astype(np.uint64) - old[row, place].astype(np.uint64)) * power[p + place]
            hit = _admitted(shards, filters, n, h)
            yield row[hit], p + place[hit], new[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for batch in batches:
            words, counts = batch["word"].to_pylist(), batch["n"].to_pylist()
            out: list[tuple[str, int, str]] = []
            for at, codes in _by_length(words):
                step = max(1, EDITS // (codes.shape[1] * len(alphabet)))
                for start in range(0, len(at), step):
                    for row, place, new in edits_of(codes[start:start + step], filters):
                        for r, p, c in zip(row.tolist(), place.tolist(), new.tolist(), strict=True):
                            i = at[start + r]
                            w = words[i]
                            out.append((w, counts[i], w[:p] + (chr(c) if c else "") + w[p + 1:]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
                                             names=["a", "n_a", "b"])
    return run


def near_pairs(words: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``a, n_a, b, n_b``: every pair of different words that one inserted, deleted or replaced code point tells apart, once.

    ``words`` has ``word`` (unique) and ``n``.
    """
    spark = words.sparkSession
    sized = words.select("word", "n", F.length("word").alias("len"))
    # lengths are few: with k of them, the words alone hold k * k / 2 code points
    counts = [(r.len, r.n) for r in sized.groupBy("len").agg(F.count("*").alias("n")).collect()]
    letters = sorted(ord(r.c) for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().where("c <> ''").collect())
    found = None
    for shards in planned(counts, broadcast_bytes):
        shared = spark.sparkContext.broadcast(built(sized, shards))
        probing = sized.where(F.col("len").isin(*sorted({*shards.at, *[n + 1 for n in shards.at]})))
        hits = probing.select("word", "n").mapInArrow(_prober(shards, shared, np.array(letters, np.uint32)), "a string, n_a bigint, b string")
        found = hits if found is None else found.union(hits)
    return found.join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b").select("a", "n_a", "b", "n_b")


def variants(words: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, factor: int = FACTOR) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every word of a vocabulary (``word`` unique, ``n``).

    ``form`` is the near word of largest ``n`` (ties: the smallest word) if it is at least ``factor`` times as common,
    else null; ``root`` is the end of the chain of forms, the word itself if it has none. Words without a near word have
    ``n_near`` 0. Chains multiply ``n`` by ``factor`` at each step, so their length is known from the largest ``n``.
    An empty vocabulary gives an empty result.
    """
    pairs = near_pairs(words, broadcast_bytes)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")),
                                          F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("x")).select("x.*")
    best = written(both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
                   .select("word", "n_near", F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best.other")).alias("form"),
                           F.when(-F.col("best.m") >= factor * F.col("n"), -F.col("best.m")).alias("form_n")), "near")
    roots = written(best.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    most, steps = words.agg(F.max("n")).first()[0] or 0, 0
    while LEAST_COUNT * factor ** (steps + 1) <= most:
        steps += 1
    for _ in range(max(0, steps - 1).bit_length()):  # each round doubles the length of the chain that is followed
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return (words.join(best, "word", "left").join(roots, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")))
