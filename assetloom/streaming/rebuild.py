"""Streaming rebuilds: the batch build re-run on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import build as B
from ..operators.render import RENDERED, split_errors


def run_available(stream: DataFrame, checkpoint: str, out: str | None = None,
                  each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """Process everything now available, into Parquet or through ``each``, then stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query: StreamingQuery = writer.foreachBatch(each).start() if each else writer.format("parquet").start(out)
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@dataclass
class ConfigHolder:
    """Config re-read per batch; the last good one is kept when reading fails."""
    load: Callable[[], object]
    current: object = None
    errors: list[str] = field(default_factory=list)

    def refresh(self) -> object:
        try:
            self.current = self.load()
        except Exception as exc:  # a broken edit must not stop the loop
            if self.current is None:
                raise
            self.errors.append(str(exc))
        return self.current


class StreamBuilder:
    """``foreachBatch`` body over a cache and an output folder, both Parquet tables.

    Every batch writes under its own epoch in overwrite mode and reads the cache of
    other epochs only, so a replayed batch produces the same files again. Outputs
    refresh; the lock is left alone. Set aside with a reason, while the loop goes on:
    rows that fail ``checks`` (NULL does not fail), later claimants of an output path,
    and rows for whose key ``render`` returned an ``error`` or nothing (see
    ``operators.render``). An exception of the render job itself (lost executors, a full
    disk, a broken renderer) is no row's fault: it ends the batch, which sets nothing
    aside and is repeated under the same epoch when the stream starts again.
    """

    def __init__(self, spark: SparkSession, root: str, targets: Callable[[], list[B.Target]], prepare: Callable[[DataFrame], DataFrame],
                 render: Callable[[DataFrame], DataFrame], failing: Callable[[], F.Column] | None = None) -> None:
        self.spark, self.root = spark, root
        self.config = ConfigHolder(targets)
        self.prepare, self.render, self.failing = prepare, render, failing

    def _read(self, table: str, schema: str, before: int) -> DataFrame:
        schema += ", epoch BIGINT"
        try:
            stored = self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except Exception as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], schema)
        return stored.where(F.col("epoch") < before)

    def cache(self, before: int = 2 ** 62, keys: DataFrame | None = None) -> DataFrame:
        """Sound cache entries of earlier epochs, the newest per key; with ``keys`` only those are read and hashed."""
        sound = B.verify_cache(split_errors(self._read("cache", RENDERED, before))[0], keys)
        columns = [c for c in sound.columns if c not in ("key", "epoch")]
        return sound.groupBy("key").agg(F.max_by(F.struct(*columns), "epoch").alias("_e")).select("key", "_e.*")

    def outputs(self) -> DataFrame:
        """Everything produced, latest epoch per path."""
        rows = self.spark.read.parquet(f"{self.root}/outputs")
        latest = F.max(F.struct("epoch", "key", "payload_len", "payload_hash", "status")).alias("_l")
        return rows.groupBy("out_path").agg(latest).select("out_path", "_l.*")

    def quarantined(self) -> DataFrame:
        """Rows set aside, with ``reason`` and, where rendering failed, ``error``."""
        return self.spark.read.parquet(f"{self.root}/quarantine")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        targets = self.config.refresh()
        bad = F.coalesce(self.failing(), F.lit(False)) if self.failing else F.lit(False)
        rows = self._write(B.hash_contents(batch).withColumn("_bad", bad), "batch", epoch)  # source read and content hashed once
        placed = B.output_paths(B.expand_targets(rows.where("not _bad").drop("_bad"), targets), "webp")
        claim = F.struct("target_idx", "pattern_idx", "path", "content_hash")
        first = placed.groupBy("out_path").agg(F.min(claim).alias("_first"))
        claimed = placed.join(first, "out_path").withColumn("_second", claim != F.col("_first")).drop("_first")
        won = claimed.where("not _second").drop("_second").dropDuplicates(["out_path"])
        inputs = self._write(self.prepare(won), "inputs", epoch)
        known = self.cache(before=epoch, keys=inputs)
        plan = B.plan_build(inputs, known)
        todo = plan.where("status = 'rebuild'").dropDuplicates(["key"])  # render once per key
        self._write(self._padded(self.render(todo)), "cache", epoch)
        fresh, failed = split_errors(self._read("cache", RENDERED, epoch + 1).where(F.col("epoch") == epoch).drop("epoch"))
        done = known.unionByName(fresh)
        made = B.materialize(plan, done).select("out_path", "key", "payload_len", "payload_hash", "status")
        self._write(made, "outputs", epoch)
        lost = (plan.join(done.select("key"), "key", "left_anti").join(failed.groupBy("key").agg(F.min("error").alias("error")), "key", "left")
                .withColumn("error", F.coalesce("error", F.lit("nothing rendered"))))
        aside = (rows.where("_bad").withColumn("reason", F.lit("check failed"))
                 .unionByName(claimed.where("_second").withColumn("reason", F.concat(F.lit("output claimed twice: "), "out_path")), allowMissingColumns=True)
                 .unionByName(lost.withColumn("reason", F.lit("render failed")), allowMissingColumns=True))
        self._write(aside.select(*batch.columns, "reason", "error"), "quarantine", epoch)

    @staticmethod
    def _padded(rendered: DataFrame) -> DataFrame:
        """Rendered rows with an ``error`` column, which a renderer that cannot fail need not have."""
        return rendered if "error" in rendered.columns else rendered.withColumn("error", F.lit(None).cast("string"))

    def _write(self, df: DataFrame, table: str, epoch: int) -> DataFrame:
        path = f"{self.root}/{table}/epoch={epoch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
