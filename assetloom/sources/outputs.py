"""Sinks and row-level failure handling."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import expand_template


def split_failures(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, failed): a batch goes on; failed rows carry the first failing check's name."""
    marked = mark_failures(df, checks)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def mark_failures(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add ``error``: the first check that holds, in order."""
    chain = reduce(lambda acc, kv: F.when(kv[1], F.lit(kv[0])) if acc is None else acc.when(kv[1], F.lit(kv[0])),
                   checks.items(), None)
    return df.withColumn("error", chain)


def failure_summary(marked: DataFrame) -> DataFrame:
    """One row: total, failed, and 'n of m failed'."""
    out = marked.agg(F.count(F.lit(1)).alias("total"), F.count("error").alias("failed"))
    return out.withColumn("line", F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" failed")))


def unsafe_name(name: Column) -> Column:
    """Reason an output name may not be joined to a directory (NULL when safe)."""
    return (F.when(name == "", "empty").when(name.startswith("/"), "absolute")
            .when(F.contains(name, F.lit("/")) | F.contains(name, F.lit("\\")), "separator").when(name.isin(".", ".."), "parent"))


def safe_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Add ``reason`` for unsafe names."""
    return df.withColumn("reason", unsafe_name(F.col(name)))


def named_outputs(df: DataFrame, template: str, ext: Column, path: str = "path") -> DataFrame:
    """Add ``out_name``; rows whose name is unsafe are refused by ``reason``."""
    return safe_names(df.withColumn("out_name", expand_template(template, F.col(path), ext)), "out_name")


def write_outputs(df: DataFrame, directory: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    """One row per output as Parquet; an existing directory is refused unless allowed."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(directory)


def write_files(df: DataFrame, directory: str, name: str = "out_name", payload: str = "payload", overwrite: bool = False) -> None:
    """Loose files in a folder all executors share; each task writes its own rows, whole or not at all.

    Names that would leave the folder are refused before the first file is written.
    """
    bad = df.select(name, unsafe_name(F.coalesce(F.col(name), F.lit(""))).alias("reason")).where("reason is not null").limit(1).collect()
    if bad:
        raise ValueError(f"unsafe output name {bad[0][name]!r}: {bad[0]['reason']}")

    def emit(rows) -> None:
        os.makedirs(directory, exist_ok=True)
        for row in rows:
            target = os.path.join(directory, row[name])
            if os.path.exists(target) and not overwrite:
                raise FileExistsError(target)
            part = f"{target}.part-{os.getpid()}"
            with open(part, "wb") as sink:
                sink.write(bytes(row[payload]))
            os.replace(part, target)

    df.select(name, payload).foreachPartition(emit)
