"""Helpers of the training-data operators: stable row numbers and distributed connected components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``uid`` (unique, stable) and ``row`` (a struct of all columns) of a frame, as a written table.

    The struct keeps the caller's columns apart from the operator's own, whatever their names; writing the table
    fixes the numbers, so a recomputed task sees the same ones.
    """
    return written(df.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")), name)


def field(row: str, name: str) -> Column:
    return F.col(row).getField(name)


def restored(df: DataFrame, columns: Iterable[str], row: str = "row", **changed: Column) -> DataFrame:
    """The original columns out of ``row``, in their order, with some of them replaced."""
    return df.select(*[changed.get(c, field(row, c)).alias(c) for c in columns])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) of every node of ``edges`` (``a``, ``b``: long).

    Alternates large-star and small-star rounds until the edges form stars. Each round is two pre-aggregated minima
    and joins on them, so a node with very many links is never gathered; the joins are ones that AQE can split. Every
    round's edges are a written table in the shared folder, so lineage stays short and lost executors cost one round.
    """
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = written(edges.where("a <> b").select(big, small).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        star = (large.join(floor, "u")
                .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                .select("e.*").where("u <> v").distinct())
        now = written(star, "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen.n, seen.s) == mark:
            break
        mark = (seen.n, seen.s)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_heads(rows: DataFrame) -> DataFrame:
    """Adds ``component_id`` and ``kept`` to rows of ``uid``, ``id`` and group ``grp``.

    ``component_id`` is the smallest id of the group; ``kept`` marks its first row by (id, nulls last; uid). Two
    pre-aggregated minima and joins, so that no group is gathered.
    """
    lowest = rows.groupBy("grp").agg(F.min("id").alias("component_id"))
    named = rows.join(lowest, "grp")
    head = named.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("grp").agg(F.min("uid").alias("head"))
    return named.join(head, "grp").withColumn("kept", F.col("uid") == F.col("head"))
