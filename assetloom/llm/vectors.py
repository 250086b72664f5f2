"""Embedding near-dedup by sign hashing, and nearest neighbours by quantised block products."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import connected_components, field, numbered, with_heads

#: Sign hashing: hyperplanes per table and tables. A pair at cosine 0.93 agrees in one sign with probability 0.88, so it
#: meets in a table of 10 signs with 0.28 and misses all 24 tables with 0.0004; closer pairs miss less often.
BITS, TABLES = 10, 24
COSINE = 0.93
#: Rows of a bucket compared by one task at once; larger buckets are split into blocks of about this size.
BLOCK = 1024
#: Rows of a query block and of a candidate block in the search.
QUERY_BLOCK, BASE_BLOCK = 1024, 8192
#: Numbers of survivors' vectors that a tile holds at a time.
SLICE = 1 << 22


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def planes(dims: int, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dims, bits * tables))


def _matrix(column) -> np.ndarray:
    """A list column whose lists have equal length as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _coder(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = (1 << np.arange(bits, dtype=np.int64))
        normals: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(1)
            size = column.value_lengths().to_numpy(zero_copy_only=False)
            codes = np.zeros((len(size), tables), np.int64)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                if d not in normals:
                    normals[d] = planes(int(d), bits, tables)
                signs = _matrix(column.take(pa.array(at))) @ normals[d] >= 0
                codes[at] = signs.reshape(len(at), tables, bits) @ weight
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * tables, pa.int32()), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["rep", "codes"])
    return run


class _Side:
    """Unit vectors, class numbers, copies and codes of some rows."""

    def __init__(self, rows: pa.Table):
        vector = _matrix(rows["vector"])
        self.unit = vector / np.linalg.norm(vector, axis=1, keepdims=True)
        self.rep = rows["rep"].to_numpy()
        self.copies = rows["copies"].to_numpy()
        self.codes = _matrix(rows["codes"]).astype(np.int32)

    def part(self, at) -> _Side:
        new = object.__new__(_Side)
        new.unit, new.rep, new.copies, new.codes = self.unit[at], self.rep[at], self.copies[at], self.codes[at]
        return new


def _compare(a: _Side, b: _Side, table: int, cosine: float, out: list):
    """Append ``rep, links, low`` of the rows of ``a`` (and 0 links, low of ``b``) that are linked across a and b.

    A pair counts in the first table in which its codes agree, so that no pair counts twice. ``low`` is the smallest
    number that a row reaches over the links of this block: as edges, these keep the components of all its links.
    """
    close = a.unit @ b.unit.T >= cosine
    close &= a.rep[:, None] != b.rep[None, :]
    if not close.any():
        return
    for t in range(table):
        close &= a.codes[:, t][:, None] != b.codes[:, t][None, :]
    rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if not len(rows):
        return
    links = close[rows] @ b.copies
    near = close[np.ix_(rows, columns)]
    top = np.iinfo(np.int64).max
    la, lb = a.rep[rows].copy(), b.rep[columns].copy()
    while True:
        na = np.minimum(la, np.where(near, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(near, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    out.append((a.rep[rows], links, la))
    if a is not b:
        out.append((b.rep[columns], np.zeros(len(columns), np.int64), lb))


def _links(out: list) -> pa.Table:
    if not out:
        out = [(np.empty(0, np.int64),) * 3]
    return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], names=["rep", "links", "low"])


def _inside_buckets(cosine: float):
    def run(key, rows):
        out: list = []
        table = key[0].as_py()
        rows = rows.sort_by("bucket")
        bucket = rows["bucket"].to_numpy()
        cut = np.flatnonzero(np.diff(bucket)) + 1
        for begin, end in zip([0, *cut], [*cut, len(bucket)], strict=True):
            if end - begin > 1:
                side = _Side(rows.slice(begin, end - begin))
                _compare(side, side, table, cosine, out)
        return _links(out)
    return run


def _between_blocks(cosine: float):
    def run(key, left, right):
        out: list = []
        if left.num_rows and right.num_rows:
            _compare(_Side(left), _Side(right), key[0].as_py(), cosine, out)
        return _links(out)
    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, bits: int = BITS, tables: int = TABLES, block: int = BLOCK,
                    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``uid``, ``row`` (all columns), ``n_links``, ``component_id`` and ``kept`` for every row.

    Rows of equal, known label link at a cosine of at least ``cosine``. Equal vectors of a label collapse first and
    count as linked with each other. The rest meet in buckets of equal sign codes; all pairs of a bucket are computed as
    matrix products, large buckets in blocks of about ``block`` rows against blocks, and only sums and component
    minima leave a task. Vectors that are null, empty, zero or hold null or non-finite components, and rows without a
    label, link with nothing; nor do vectors of different length.

    ``component_id`` is the smallest vec_id reachable and ``kept`` marks one row of each component: that of the
    smallest vec_id (nulls last), the first one if rows repeat it. An empty table gives an empty result.
    """
    source = numbered(vectors, "vectors")
    rows = source.select("uid", field("row", vec_id).alias("id"), field("row", label).alias("label"), field("row", embedding).alias("vector"))
    fit = rows.where(usable(F.col("vector")) & F.col("label").isNotNull())
    # +0.0 and -0.0 are equal components
    same = F.xxhash64(F.transform("vector", lambda x: x + F.lit(0.0).cast("float")))
    keyed = fit.select("uid", "label", "vector", same.alias("h"), F.md5(F.to_json(F.struct(F.transform("vector", lambda x: x + F.lit(0.0)).alias("v")))).alias("m"))
    classes = written(keyed.groupBy("label", "h", "m").agg(F.min("uid").alias("rep"), F.count("*").alias("copies")), "classes")
    member = keyed.join(classes.withColumnsRenamed({"label": "l2", "h": "h2", "m": "m2"}),
                        (F.col("label") == F.col("l2")) & (F.col("h") == F.col("h2")) & (F.col("m") == F.col("m2"))).select("uid", "rep", "copies")
    reps = fit.join(classes.select(F.col("rep").alias("uid"), "copies"), "uid").select(F.col("uid").alias("rep"), "label", "copies", "vector")
    codes = reps.select("rep", "vector").mapInArrow(_coder(bits, tables), "rep bigint, codes array<int>")
    coded = written(reps.join(codes, "rep"), "codes")
    dealt = coded.select("*", F.posexplode("codes").alias("table", "code")).withColumn("bucket", F.xxhash64("label", "code", F.size("vector")))
    large = written(dealt.groupBy("table", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
                    .select("table", "bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    dealt = dealt.join(large, ["table", "bucket"], "left")
    shards = max(1, -(-coded.count() // (4 * block)))
    cols = ["rep", "copies", "vector", "codes", "table", "bucket"]
    small = (dealt.where("blocks is null").select(*cols, F.pmod("bucket", F.lit(shards)).alias("shard"))
             .groupBy("table", "shard").applyInArrow(_inside_buckets(cosine), "rep bigint, links bigint, low bigint"))
    big = dealt.where("blocks is not null").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = big.select(*cols, F.col("own").alias("i"), every.alias("j")).groupBy("table", "bucket", "i", "j")
    right = big.select(*[F.col(c).alias(c) for c in cols], F.col("own").alias("j"), every.alias("i")).groupBy("table", "bucket", "i", "j")
    crossed = left.cogroup(right).applyInArrow(_between_blocks(cosine), "rep bigint, links bigint, low bigint")
    found = written(small.union(crossed).groupBy("rep", "low").agg(F.sum("links").alias("links")), "links")
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    count = found.groupBy("rep").agg(F.sum("links").alias("links"))
    state = (member.join(count, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
             .select("uid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("grp")))
    all_ = rows.select("uid", "id").join(state, "uid", "left").withColumns(
        {"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "grp": F.coalesce("grp", F.col("uid"))})
    return source.join(with_heads(all_).select("uid", "n_links", "component_id", "kept"), "uid")


def _tile(k: int):
    def run(key, queries, base):
        found: list[tuple[int, int, int | None, float]] = []
        if queries.num_rows and base.num_rows:
            x, y = _matrix(queries["vector"]), _matrix(base["vector"])
            quid, buid, vec = queries["uid"].to_numpy(), base["uid"].to_numpy(), base["id"].to_pylist()
            bound, approx = _bounds(x, y)
            own = quid[:, None] == buid[None, :]
            low = np.where(own, -np.inf, approx - bound)
            kth = np.partition(low, len(buid) - k, axis=1)[:, len(buid) - k] if len(buid) > k else np.full(len(quid), -np.inf)
            survives = (approx + bound >= kth[:, None]) & ~own
            del approx, bound, low, own
            step = max(1, SLICE // (len(buid) * x.shape[1]))  # where many candidates tie, all of them survive
            for start in range(0, len(quid), step):
                r, c = np.nonzero(survives[start:start + step])
                exact = np.einsum("ij,ij->i", x[start + r], y[c])
                cut = np.searchsorted(r, np.arange(min(step, len(quid) - start) + 1))
                for i in range(len(cut) - 1):
                    best = heapq.nsmallest(k, ((-exact[p], vec[c[p]] is None, vec[c[p]] or 0, p) for p in range(cut[i], cut[i + 1])))
                    found += [(int(quid[start + i]), int(buid[c[p]]), vec[c[p]], -s) for s, _, _, p in best]
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(list(v), t) for v, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                        names=["quid", "uid", "vec_id", "score"])
    return run


def _bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Error bound and approximate inner products from int8 codes.

    x = x' + e with x' = scale * code, so <x, y> - <x', y'> = <e, y> + <x', f> is at most |e||y| + |x'||f|. Products of
    codes are whole numbers and exact in float32 up to 2**24, in float64 beyond; a small margin covers the rounding of
    the scaled products.
    """
    def coded(v):
        scale = np.abs(v).max(axis=1, keepdims=True) / 127.0
        code = np.rint(v / scale)
        near = code * scale
        return code.astype(np.int8), scale[:, 0], np.linalg.norm(v - near, axis=1), np.linalg.norm(near, axis=1)
    (cx, sx, ex, nx), (cy, sy, ey, _) = coded(x), coded(y)
    kind = np.float32 if 127 * 127 * x.shape[1] < 2 ** 24 else np.float64
    approx = (cx.astype(kind) @ cy.astype(kind).T) * (sx[:, None] * sy[None, :])
    size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
    bound = ex[:, None] * np.linalg.norm(y, axis=1)[None, :] + nx[:, None] * ey[None, :] + 1e-9 * size
    return bound, approx


def _heaps(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for q, u, v, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                heap = heaps.setdefault(q, [])
                item = (s, v is not None, -(v or 0), -u)  # the worst is on top: small score, then null or large id
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        rows = [(q, n + 1, -v if known else None, s) for q, heap in heaps.items() for n, (s, known, v, _) in enumerate(sorted(heap, reverse=True))]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)],
                                         names=["quid", "rank", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, query_block: int = QUERY_BLOCK, base_block: int = BASE_BLOCK,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product for every row that ``queries`` marks.

    Exact: each tile (a block of queries and a block of candidates) bounds all its products from int8 codes, recomputes
    in double precision whatever can be among the k best, and keeps k per query in a heap; the tiles' lists meet in
    one heap per query, streamed, so memory stays at k entries per query. Ties go to the smaller vec_id (nulls last).
    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of different
    length with each other. Rows that repeat a vec_id are rows of their own; a query never finds its own row.
    """
    rows = numbered(vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
                    .where(usable(F.col("vector"))), "vectors").select("uid", "row.*").withColumn("dims", F.size("vector"))
    counts = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).first()
    across, down = max(1, -(-(counts.q or 0) // query_block)), max(1, -(-counts.n // base_block))
    asked = rows.where("asks")
    left = asked.select("uid", "vector", "dims", F.pmod(F.xxhash64("uid"), F.lit(across)).alias("qb"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("bb"))
    right = rows.select("uid", "id", "vector", "dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("qb"),
                        F.pmod(F.xxhash64("uid"), F.lit(down)).alias("bb"))
    keys = ["dims", "qb", "bb"]
    tiles = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k), "quid bigint, uid bigint, vec_id bigint, score double")
    best = tiles.repartition("quid").mapInArrow(_heaps(k), "quid bigint, rank int, vec_id bigint, score double")
    return best.join(asked.select(F.col("uid").alias("quid"), F.col("id").alias("query_id")), "quid").select("query_id", "rank", "vec_id", "score")
