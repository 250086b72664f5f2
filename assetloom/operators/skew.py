"""Joins that move wide rows to keys which very many rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def dealt_join(many: DataFrame, one: DataFrame, key: str, spread: list[str], rows_per_task: int = 100_000) -> DataFrame:
    """Inner join of ``many`` rows with the rows of ``one`` on ``key``, popular keys dealt to several tasks.

    Keys of ``many`` are counted first, with partial counts before the shuffle. A key of more than ``rows_per_task`` rows
    is dealt, by a hash of its ``spread`` columns, in as many parts as its count asks for, and its rows of ``one`` are
    copied once per part; every other key meets its row once. Rows equal in all ``spread`` columns share a part. There is
    at most one dealt key per ``rows_per_task`` rows, so what is joined to find the parts stays small. NULL keys meet nothing.
    """
    parts = F.ceil(C("_n") / rows_per_task).cast("int")
    hot = many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((C("_n") > rows_per_task) & C(key).isNotNull()).select(key, parts.alias("_parts"))
    dealt = many.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), C("_parts")).cast("int"), F.lit(0)))
    last = F.coalesce(C("_parts") - 1, F.lit(0))
    copied = one.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), last))).drop("_parts")
    return dealt.drop("_parts").join(copied, [key, "_part"]).drop("_part")
