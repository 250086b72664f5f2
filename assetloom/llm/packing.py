"""Conflict-constrained best-fit packing of documents into training sequences.

A sequence (bin) holds pieces of documents up to ``capacity`` tokens. Two pieces of one duplicate cluster never share a
bin, nor do more than ``source_slots`` pieces of one source. Bins are kept ordered by what is left in them; the search
starts at the tightest bin that fits and goes on to its successors until one has no conflict.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

CAPACITY = 2048
SOURCE_SLOTS = 4
#: Tokens packed by one task: about 500 bins, enough for tight fits and small in memory.
SHARD_TOKENS = 1_000_000

#: Ids travel as strings through pandas, which has no integers with nulls.
OUTPUT = "doc_id string, copy int, piece int, start_token int, n_tokens int, bin_id bigint, position int"


def word_count(text: Column) -> Column:
    """Tokens are runs of characters other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def best_fit(items: list[tuple[int, int, int]], capacity: int, source_slots: int) -> list[int]:
    """The bin of each item ``(n_tokens, source, cluster)``, in the order given; a negative cluster is that item's own.

    ``source`` and ``cluster`` are small numbers: bit ``source * source_slots + s`` of a bin's bitmap says that slot s
    of the source is taken, bit ``cluster`` of the other that the cluster is present. While size and source (and
    cluster) of the items stay the same, what a search has passed over stays in conflict, so the next one starts behind.
    """
    by_residual: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    chosen = []
    full = (1 << source_slots) - 1
    end = (capacity + 1, 0)
    run = alike = None
    open_from = tried_from = end  # before these, no bin has a slot of the source; or none is free of the cluster
    for need, source, cluster in items:
        shift, mark = source * source_slots, 1 << cluster if cluster >= 0 else 0
        if run != (need, source):
            run, alike, open_from = (need, source), None, (need, -1)
        at = bisect_left(by_residual, open_from)
        while at < len(by_residual) and (sources[by_residual[at][1]] >> shift) & full == full:
            at += 1
        open_from = by_residual[at] if at < len(by_residual) else end
        if mark and alike == cluster and tried_from > open_from:
            at = bisect_left(by_residual, tried_from)
        while at < len(by_residual):
            b = by_residual[at][1]
            if not clusters[b] & mark and (sources[b] >> shift) & full != full:
                break
            at += 1
        if at < len(by_residual):
            left, b = tried_from = by_residual.pop(at)
        else:
            left, b = capacity, len(sources)
            tried_from = end
            sources.append(0)
            clusters.append(0)
        alike = cluster
        taken = (sources[b] >> shift) & full
        sources[b] |= (taken + 1) << shift  # slots fill from the lowest bit
        clusters[b] |= mark
        if left > need:
            insort(by_residual, (left - need, b))
            if left - need >= need and (sources[b] >> shift) & full != full:
                open_from = min(open_from, (left - need, b))
        chosen.append(b)
    return chosen


def _pack_shard(capacity: int, source_slots: int):
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_tokens", "source", "cluster", "doc_id", "copy", "piece"], ascending=[False, True, True, True, True, True], ignore_index=True)
        source = pd.factorize(shard["source"], use_na_sentinel=False)[0]
        # only what stands more than once can be in conflict and needs a bit
        cluster = np.where(shard["cluster"].duplicated(keep=False), shard["cluster"].where(shard["cluster"].duplicated(keep=False)).factorize()[0], -1)
        shard["bin"] = best_fit(list(zip(shard["n_tokens"].tolist(), source.tolist(), cluster.tolist(), strict=True)), capacity, source_slots)
        shard["position"] = shard.groupby("bin").cumcount()
        shard["bin_id"] = shard["shard"].astype("int64") * 2 ** 32 + shard["bin"]
        return shard[["doc_id", "copy", "piece", "start_token", "n_tokens", "bin_id", "position"]]
    return pack


def pack(docs: DataFrame, capacity: int = CAPACITY, source_slots: int = SOURCE_SLOTS, shard_tokens: int = SHARD_TOKENS,
         doc_id: str = "doc_id", source: str = "source", text: str = "text", n_tokens: Column | None = None,
         cluster: Column | None = None) -> DataFrame:
    """Pieces of all documents with their bins: ``doc_id, copy, piece, start_token, n_tokens, bin_id, position``.

    A document longer than ``capacity`` is cut into full pieces and a rest. ``cluster`` says which documents count as
    duplicates of each other; without it, those with equal text. Rows that are equal in id, source, text and length are
    counted first and told apart by ``copy`` (from 1), so that a document repeated very often does not fall into one
    task. Documents are dealt to shards of about ``shard_tokens`` tokens by a hash of id, text and copy; each shard is
    packed by one task, longest first. Null or empty texts hold no token: they come back with ``bin_id`` null. A null
    source or cluster is a value like any other; a null id stays null. An empty table gives an empty result.
    """
    one = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("string").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        (F.xxhash64(F.coalesce(one, F.lit(""))) if cluster is None else cluster.cast("long")).alias("cluster"),
        (word_count(one) if n_tokens is None else n_tokens).cast("int").alias("total"))
    counted = written(rows.groupBy("doc_id", "source", "cluster", "total").agg(F.count("*").cast("int").alias("times")), "lengths")
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    pieces = (each.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("total") / capacity).cast("int") - 1))))
              .withColumn("start_token", F.col("piece") * capacity)
              .withColumn("n_tokens", F.least(F.lit(capacity), F.col("total") - F.col("start_token"))))
    tokens = counted.agg(F.sum(F.col("total").cast("long") * F.col("times"))).first()[0] or 0
    shards = max(1, -(-int(tokens) // shard_tokens))
    keyed = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "copy", "piece"), F.lit(shards)))
    packed = keyed.where("n_tokens > 0").groupBy("shard").applyInPandas(_pack_shard(capacity, source_slots), OUTPUT)
    empty = keyed.where("n_tokens = 0").select("doc_id", "copy", "piece", "start_token", "n_tokens",
                                               F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("position"))
    kind = docs.schema[doc_id].dataType
    return packed.union(empty).withColumn("doc_id", F.col("doc_id").cast(kind))
