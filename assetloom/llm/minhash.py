"""MinHash near-dedup with circulant permutations and exact verification.

A document's set is that of its distinct word shingles, as 64-bit hashes. One permutation (the mixing of the hash)
scatters the set over a ring of 2**32 places; a second one, shifted circularly by k places, ranks the places for
signature coordinate k. All coordinates thus come from two permutations. Coordinates are cut into bands; documents that
agree in a band are candidates, and candidates become links only if their full sets are similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import connected_components, field, numbered, restored, with_heads

WORDS = 5
#: Similarity of a link, as whole numbers: JACCARD[0] * intersection >= JACCARD[1] * union.
JACCARD = (100, 80)
BANDS, ROWS = 20, 5
#: Members verified against one copy of their hub's text.
HUB_SHARE = 256
#: Members of a bucket in one block of the remaining comparisons.
BLOCK = 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20250101).integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), _BASE, np.uint64), dtype=np.uint64)])[:n]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash per word; words are runs of bytes other than ASCII white space, with A-Z lower-cased."""
    raw = np.frombuffer(text.lower(), np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    lengths = end - start
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.concatenate([start, [len(raw)]]))) if start[0] == 0 else \
        np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(raw)) - np.repeat(start, np.diff(np.concatenate([start, [len(raw)]])))])
    value = _BYTES[raw] * _powers(int(place.max()) + 1)[place]
    value[space] = 0
    return _mixed(np.add.reduceat(value, start) + lengths.astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, one without words has none."""
    if not text:
        return np.empty(0, np.uint64)
    h = word_hashes(text.encode("utf-8", "surrogatepass"))
    n = len(h)
    if n == 0:
        return h
    if n < words:
        words = n
    total = np.zeros(n - words + 1, np.uint64)
    for k in range(words):
        total = total * _BASE + h[k:n - words + 1 + k]
    return np.unique(_mixed(total + np.uint64(words)))


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least rank of the set's places on the ring shifted by k."""
    places = (shingles >> np.uint64(32)).astype(np.uint32)  # the first permutation is in the hash
    shift = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    best = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(places), 1024):
        x = places[None, at:at + 1024] - shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(best, x.min(axis=1), out=best)
    return best


def _sketcher(words: int, bands: int, rows: int):
    fold = _powers(rows + 1)[1:]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, size, same, band = [], [], [], []
            for u, text in zip(batch.column(0), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), words)
                uid.append(u.as_py())
                size.append(len(s))
                if not len(s):
                    same.append(None)
                    band.append(None)
                    continue
                sig = signature(s, bands * rows).reshape(bands, rows).astype(np.uint64)
                same.append(np.array([s.sum(dtype=np.uint64), _mixed(s + _BASE).sum(dtype=np.uint64)]).tobytes() + len(s).to_bytes(4, "little"))
                band.append(_mixed((sig * fold).sum(axis=1) + np.arange(bands, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid, pa.int64()), pa.array(size, pa.int64()), pa.array(same, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
                names=["uid", "n_shingles", "same", "bands"])
    return sketch


def _verifier(words: int, jaccard: tuple[int, int]):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = None, None
        for batch in batches:
            a, b = [], []
            for key, member, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                s = shingle_set(text, words)
                if member is None:
                    hub, mine = key, s
                elif key == hub:
                    common = len(np.intersect1d(mine, s, assume_unique=True))
                    if jaccard[0] * common >= jaccard[1] * (len(mine) + len(s) - common):
                        a.append(hub)
                        b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return verify


def _block_linker(words: int, jaccard: tuple[int, int]):
    def run(key, rows):
        h, i, j = key[0].as_py(), key[1].as_py(), key[2].as_py()
        own, group, n = rows["own"].to_numpy(), rows["g"].to_numpy(), rows["n"].to_numpy()
        bands = np.array(rows["bands"].to_pylist(), np.int64)
        sets = [shingle_set(x, words) for x in rows["text"].to_pylist()]
        here = int(np.flatnonzero((bands == h).all(axis=0))[0])  # the band that this bucket is of
        root = {int(g): int(g) for g in group}

        def find(g: int) -> int:
            while root[g] != g:
                root[g] = root[root[g]]
                g = root[g]
            return g
        out = []
        for a in np.flatnonzero(own == i):
            other = (own == j) & (group != group[a]) & (jaccard[0] * np.minimum(n, n[a]) >= jaccard[1] * np.maximum(n, n[a]))
            if i == j:
                other &= np.arange(len(own)) > a
            for b in np.flatnonzero(other & ~(bands[:, :here] == bands[a, :here]).any(axis=1)):
                x, y = find(int(group[a])), find(int(group[b]))
                if x != y:
                    common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if jaccard[0] * common >= jaccard[1] * (len(sets[a]) + len(sets[b]) - common):
                        out.append((int(group[a]), int(group[b])))
                        root[max(x, y)] = min(x, y)
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run


def linked_groups(members: DataFrame, sketches: DataFrame, texts: DataFrame, words: int, jaccard: tuple[int, int], block: int = BLOCK) -> DataFrame:
    """Pairs of groups ``a, b`` that are linked by members of one bucket: ``members`` has ``h, uid, g``.

    The members of a bucket are dealt to blocks of about ``block``, and every pair of blocks is compared in one task,
    which holds two blocks at most and returns only links that join groups. A pair of members is looked at in the first
    bucket they share. No pair leaves a task unless it is such a link.
    """
    sizes = members.groupBy("h").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "h").withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("h", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "uid", "g")
    open_ = members.select("uid").distinct()
    facts = texts.join(open_, "uid", "left_semi").join(sketches.select("uid", F.col("n_shingles").alias("n"), "bands").join(open_, "uid", "left_semi"), "uid")
    full = tiles.join(facts, "uid")
    return full.select("h", "i", "j", "own", "g", "n", "bands", "text").groupBy("h", "i", "j").applyInArrow(_block_linker(words, jaccard), "a bigint, b bigint")


def verified(pairs: DataFrame, texts: DataFrame, words: int, jaccard: tuple[int, int]) -> DataFrame:
    """Of the pairs ``a, b`` of uids, those whose full shingle sets are similar enough.

    The texts of all b that share an a are streamed past the set of a; an a with very many b is copied once for each
    :data:`HUB_SHARE` of them, so that no group has to be held, sorted or computed in one task.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("c"))
    dealt = (pairs.join(counts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / HUB_SHARE).cast("long")))
             .select("a", "part", F.col("b").alias("member")))
    hubs = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / HUB_SHARE).cast("long") - 1)).alias("part"))
    members = dealt.join(texts.withColumnRenamed("uid", "member"), "member").select("a", "part", "member", "text")
    leads = hubs.join(texts.withColumnRenamed("uid", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("member"), "text")
    return (members.union(leads).repartition("a", "part").sortWithinPartitions("a", "part", F.col("member").asc_nulls_first())
            .select("a", "member", "text").mapInArrow(_verifier(words, jaccard), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, words: int = WORDS, jaccard: tuple[int, int] = JACCARD, bands: int = BANDS, rows: int = ROWS,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``uid``, ``row`` (all columns), ``n_shingles``, ``component_id`` and ``kept`` for every row.

    Rows are linked if ``jaccard[0] * |A & B| >= jaccard[1] * |A | B|`` on their sets of ``words``-word shingles.
    Rows of equal sets collapse first, by a 160-bit digest of the full set. In each band bucket every class is then
    compared with the smallest one. What is left are buckets with several components: their members are compared block
    by block, so no pair that shares a bucket goes unseen unless it is linked already.

    ``component_id`` is the smallest doc_id reachable and ``kept`` marks one row of each component: that of the
    smallest doc_id (nulls last), the first one if rows repeat it. Null, empty and blank texts have no set and are
    linked with nothing; each is its own component. Very long texts are hashed in slices. An empty table gives an
    empty result.
    """
    source = numbered(docs, "documents")
    texts = source.select("uid", field("row", text).alias("text"))
    sketches = written(texts.mapInArrow(_sketcher(words, bands, rows), "uid bigint, n_shingles bigint, same binary, bands array<bigint>"), "sketches")
    classes = written(sketches.where("same is not null").groupBy("same").agg(F.min("uid").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = sketches.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
    buckets = reps.select("uid", F.explode("bands").alias("h"))  # the band is part of the hash
    lead = written(buckets.groupBy("h").agg(F.min("uid").alias("a"), F.count("*").alias("c")).where("c > 1").select("h", "a"), "leads")
    shared = written(buckets.join(lead, "h"), "buckets")
    # whole texts cross one shuffle here, at every size; the comparisons below read only those of candidates
    texts = written(texts.join(shared.select("uid").distinct().hint("shuffle_hash"), "uid", "left_semi"), "texts")
    first = written(verified(shared.where("uid <> a").select("a", F.col("uid").alias("b")).distinct(), texts, words, jaccard), "links")
    groups = written(connected_components(first), "groups")
    held = shared.join(groups.withColumnRenamed("node", "uid"), "uid", "left").select("h", "uid", F.coalesce("component", "uid").alias("g"))
    several = held.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("h")
    left = written(held.join(several, "h"), "open")
    joined = connected_components(written(linked_groups(left, sketches, texts, words, jaccard), "links"))
    over = (groups.select(F.col("node").alias("rep"), "component")
            .join(joined.select(F.col("node").alias("component"), F.col("component").alias("c2")), "component", "full")
            .select(F.coalesce("rep", "component").alias("rep"), F.coalesce("c2", "component").alias("component")).distinct())
    rep_group = classes.join(over, "rep", "left").select("same", F.coalesce("component", "rep").alias("grp"))
    member = sketches.join(rep_group, "same", "left").select("uid", "n_shingles", F.coalesce("grp", -F.col("uid") - 1).alias("grp"))
    out = member.join(source.select("uid", field("row", doc_id).alias("id")), "uid")
    decided = with_heads(out).select("uid", "n_shingles", "component_id", "kept")
    return source.join(decided, "uid")


def deduplicated(docs: DataFrame, words: int = WORDS, jaccard: tuple[int, int] = JACCARD) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates."""
    return restored(near_duplicates(docs, words, jaccard).where("kept"), docs.columns)
