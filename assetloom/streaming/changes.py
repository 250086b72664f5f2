"""Change feeds: watch roots, exclusion, debouncing, deduplication, windows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import containing_dir, lexical_clean, literal_root
from ..schemas import require

C = F.col
CHUNK_BUCKETS = 4096
STATIC_SHALLOW = ["."]
STATIC_EXCLUDED = [".cache", "build.lock"]


def watch_roots(targets: DataFrame, shallow: list[str] | None = None,
                excluded: list[str] | None = None) -> DataFrame:
    """Distinct ``kind, path`` rows to watch: recursive sources, shallow config dirs, own outputs."""
    require(targets, "source", "recipe", "out")
    one = lambda kind, path: F.struct(F.lit(kind).alias("kind"), path.alias("path"))
    fixed_ = [one("shallow", F.lit(p)) for p in (shallow or STATIC_SHALLOW)] + [
        one("excluded", F.lit(p)) for p in (excluded or STATIC_EXCLUDED)]
    rows = F.concat(
        F.transform("source", lambda s: one("recursive", literal_root(s))),
        F.array(one("shallow", containing_dir(C("recipe"))), one("excluded", lexical_clean(C("out"))), *fixed_))
    roots = targets.select(F.explode(rows).alias("_r")).select("_r.*").distinct()
    deep = roots.where("kind = 'recursive'").select("path", F.lit("shallow").alias("kind"))
    return roots.join(deep, ["kind", "path"], "left_anti")


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it (bounded by depth)."""
    parts = F.split(lexical_clean(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def exclude_own_writes(changes: DataFrame, excluded: list[str], path: str = "path") -> DataFrame:
    """Drop changes under any excluded directory, compared by component; stream-safe, no join."""
    if not excluded:
        return changes
    return changes.where(~F.arrays_overlap(ancestors(C(path)), F.array(*[F.lit(e) for e in excluded])))


def debounce(changes: DataFrame, gap_seconds: float, keys: list[str] | None = None,
             time: str = "event_time") -> DataFrame:
    """Batch form: bursts separated by more than ``gap_seconds`` of silence.

    Events first collapse into buckets one gap wide (all inside one burst by
    construction). Buckets are joined to bursts inside chunks of 4096 buckets, and
    only chunk edges are then chained, so no task ever orders the whole feed, not
    even when one key, or no key at all, holds every event.
    """
    keys = keys or []
    gap = int(gap_seconds * 1_000_000)
    at = F.unix_micros(C(time).cast("timestamp"))
    out = _chained(_cells(changes.select(*keys, at.alias("_s"), at.alias("_e"), F.lit(1).alias("_n")), gap, keys), gap, keys)
    return out.select(*keys, F.timestamp_micros("_s").alias("first_change"), F.timestamp_micros("_e").alias("last_change"), C("_n").alias("changes"))


def _cells(spans: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """Spans ``_s, _e, _n`` in buckets ``_b`` one gap wide, by where they end; spans of a bucket belong to one burst."""
    return spans.groupBy(*keys, F.floor(C("_e") / gap).alias("_b")).agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"))


def _chained(cells: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """Cells joined to bursts ``_s, _e, _n`` inside chunks, then over the edges of chunks."""
    part = lambda *more: Window.partitionBy(*keys, *more) if keys or more else Window.partitionBy()
    cells = cells.withColumn("_c", F.floor(C("_b") / CHUNK_BUCKETS))
    inside = part("_c").orderBy("_b")
    opened = F.coalesce(C("_s") - F.lag("_e").over(inside) > gap, F.lit(True))
    bursts = cells.withColumn("_o", opened.cast("int")).withColumn("_i", F.sum("_o").over(inside)).groupBy(*keys, "_c", "_i").agg(
        F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"))
    edges = bursts.groupBy(*keys, "_c").agg(F.min("_s").alias("_cs"), F.max("_e").alias("_ce"), F.max("_i").alias("_k"))
    along = part().orderBy("_c")
    linked = F.coalesce(C("_cs") - F.lag("_ce").over(along) <= gap, F.lit(False))
    edges = edges.withColumns({"_linked": linked, "_pk": F.lag("_k").over(along)})
    edges = edges.withColumn("_new", (~C("_linked") | (C("_pk") > 1)).cast("int"))
    edges = edges.withColumns({"_run": F.sum("_new").over(along), "_next": F.coalesce(F.lead("_linked").over(along), F.lit(False))})
    placed = bursts.join(edges.select(*keys, "_c", "_k", "_run", "_next"), [*keys, "_c"])
    chained = (F.when(C("_i") == 1, C("_run")).when((C("_i") == C("_k")) & C("_next"), C("_run") + 1))
    own = F.when(chained.isNull(), F.struct("_c", "_i"))
    return placed.withColumns({"_g": chained, "_own": own}).groupBy(*keys, "_g", "_own").agg(
        F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"))


def debounce_stream(changes: DataFrame, gap: str, delay: str, keys: list[str]) -> DataFrame:
    """Streaming form by key: session windows closed once the watermark passes them. :class:`BurstFeed` is for a feed without keys."""
    if not keys:
        raise ValueError("without keys the whole feed would be one state group: use BurstFeed")
    grouped = changes.withWatermark("event_time", delay).groupBy(F.session_window("event_time", gap).alias("_w"), *keys)
    return grouped.agg(F.min("event_time").alias("first_change"), F.max("event_time").alias("last_change"),
                       F.count(F.lit(1)).alias("changes")).drop("_w")


class BurstFeed:
    """``foreachBatch`` body that debounces a feed without keys; no task sees the whole feed.

    Every batch collapses its events and the open cells of the batch before to gap-wide cells, joins them in chunks as
    :func:`debounce` does, and writes the bursts that the watermark (largest event time less ``delay_seconds``, to the
    millisecond) has closed. State are the cells that can still change, one per gap since the watermark, and one for all
    that came before in a burst that goes on; so it is bounded however long a burst lasts. Events so late that their own
    burst would have closed are dropped. A replayed epoch reads the state of the epoch before it and overwrites its own
    files.
    """

    SPANS = "_s BIGINT, _e BIGINT, _n BIGINT"

    def __init__(self, spark: SparkSession, root: str, gap_seconds: float, delay_seconds: float, time: str = "event_time") -> None:
        self.spark, self.root, self.time = spark, root, time
        self.gap, self.delay = int(gap_seconds * 1_000_000), int(delay_seconds * 1_000_000)

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema + ", epoch BIGINT").parquet(f"{self.root}/{name}")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema + ", epoch BIGINT")

    def _write(self, df: DataFrame, name: str, epoch: int) -> DataFrame:
        path = f"{self.root}/{name}/epoch={epoch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        before = self._table("marks", "mark BIGINT").where(C("epoch") < epoch).orderBy(F.desc("epoch")).first()
        at = F.unix_micros(C(self.time).cast("timestamp"))
        spans = batch.where(C(self.time).isNotNull()).select(at.alias("_s"), at.alias("_e"), F.lit(1).cast("bigint").alias("_n"))
        if before:
            spans = spans.where(C("_e") + self.gap > before.mark).union(self._table("open", self.SPANS).where(C("epoch") == before.epoch).drop("epoch"))
        cells = self._write(_cells(spans, self.gap, []), "cells", epoch)
        newest = cells.agg(F.max("_e")).first()[0]
        marks = ([] if newest is None else [newest // 1000 * 1000 - self.delay]) + ([before.mark] if before else [])
        if not marks:  # nothing has come yet
            return
        mark = max(marks)
        bursts = self._write(_chained(cells, self.gap, []).select("_s", "_e", "_n"), "joined", epoch)
        closed = C("_e") + self.gap <= mark
        self._write(bursts.where(closed), "closed", epoch)
        low = bursts.where(~closed).agg(F.min("_s")).first()[0]
        rest = cells.where(C("_s") >= low) if low is not None else cells.limit(0)  # bursts do not overlap: from here on all are open
        # no event can come any more where the watermark lies a gap behind: those cells are one span of the burst that goes on
        settled = F.when(C("_e") + self.gap <= mark, F.lit(None)).otherwise(C("_b"))
        self._write(rest.groupBy(settled.alias("_b")).agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n")).select("_s", "_e", "_n"), "open", epoch)
        self._write(self.spark.createDataFrame([(mark,)], "mark BIGINT"), "marks", epoch)

    def bursts(self) -> DataFrame:
        """``first_change, last_change, changes`` of all closed bursts."""
        return self._table("closed", self.SPANS).select(F.timestamp_micros("_s").alias("first_change"), F.timestamp_micros("_e").alias("last_change"), C("_n").alias("changes"))


def dedup_stream(changes: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The same key arriving again within the watermark is a no-op; state stays bounded."""
    return changes.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(changes: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes",
                    keys: list[str] | None = None) -> DataFrame:
    """Tumbling (or sliding) counts with a watermark; also works on batch frames."""
    win = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    return changes.withWatermark("event_time", delay).groupBy(win.alias("_w"), *(keys or [])).agg(
        F.count(F.lit(1)).alias("changes")).select(*(keys or []), C("_w.start").alias("start"), C("_w.end").alias("end"), "changes")


def asset_stream(spark: SparkSession, root: str, schema: str | None = None, glob: str | None = None,
                 fmt: str = "binaryFile", max_files: int | None = None) -> DataFrame:
    """Continuous arrivals: loose files, or tables with an explicit schema."""
    reader = spark.readStream.format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if schema:
        reader = reader.schema(schema)
    return reader.load(root)


def check_watch_args(watch: bool, check: bool = False, strict: bool = False) -> None:
    """Watching cannot be combined with verifying."""
    if watch and (check or strict):
        raise ValueError("watch cannot be combined with check or strict")
