"""Renderers as row functions: a payload or an error for every row, in one pass over Arrow batches."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CACHE

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its Python functions travel with the job

RENDERED = CACHE + ", error STRING"
#: What a machine does to a row is not the row's fault: these fail the task, which Spark repeats elsewhere, and in the end the batch.
FAULTS = (OSError, MemoryError, ImportError)
#: Bytes of payload in one batch.
BATCH_BYTES = 32 << 20


class RenderError(Exception):
    """For renderers to say that a row cannot be rendered, whatever the cause."""

    of_row = True  # told by this mark, since a task may hold the class twice, imported and sent along


def _renderer(fn: Callable[[dict], tuple[str, bytes]], faults: tuple[type[BaseException], ...], key_type: pa.DataType):
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = ["key", "ext", "payload", "payload_len", "payload_hash", "error"]

    def one(row: dict) -> tuple:
        try:
            ext, payload = fn(row)
            payload = bytes(payload)
        except Exception as exc:
            if getattr(exc, "of_row", False):
                return (None, None, None, None, str(exc) or "RenderError")
            if isinstance(exc, faults):
                raise
            return (None, None, None, None, f"{type(exc).__name__}: {exc}")
        return (ext, payload, len(payload), hashlib.sha256(payload).hexdigest(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, done, held = [], [], 0
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                keys.append(row["key"])
                done.append(one(row))
                held += done[-1][2] or 0
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), *[pa.array([x[j] for x in done], t) for j, t in enumerate(kinds)]], names=names)
                    keys, done, held = [], [], 0
    return run


def render_rows(todo: DataFrame, fn: Callable[[dict], tuple[str, bytes]], columns: list[str],
                faults: tuple[type[BaseException], ...] = FAULTS) -> DataFrame:
    """``key, ext, payload, payload_len, payload_hash, error`` of every row: ``fn(row)`` gives extension and payload.

    ``fn`` sees ``key`` and ``columns`` as a dict. If it raises, the row has its message as ``error`` and no payload, and
    the rows beside it go on: one job, however many rows fail. ``faults`` are raised as they are.
    """
    names = ["key", *[c for c in columns if c != "key"]]
    return todo.select(*names).mapInArrow(_renderer(fn, faults, pa.string()), RENDERED)


def split_errors(rendered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cache rows, and ``key, error`` of the rows without a payload."""
    if "error" not in rendered.columns:
        rendered = rendered.withColumn("error", F.lit(None).cast("string"))
    failed = F.col("error").isNotNull() | F.col("payload").isNull()
    return (rendered.where(~failed).drop("error"),
            rendered.where(failed).select("key", F.coalesce("error", F.lit("no payload")).alias("error")))
