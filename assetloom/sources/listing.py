"""A data source that lists directory trees of a mounted file system: metadata only, links resolved, empty files included.

Planning walks directories, not files, until there is enough to deal out; each partition then walks its own subtrees.
A very wide directory is listed by several partitions, each of which looks at its share of the names. No file is
opened.
"""

from __future__ import annotations

import os
import stat
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its classes travel with the job

NAME = "asset_listing"
SCHEMA = "path string, real_path string, bytes bigint, mtime timestamp, linked boolean"
#: Partitions to plan for; entries from which a directory is listed by several of them; rows of a batch.
SLICES, WIDE, BATCH = 64, 50_000, 8192


@dataclass
class Slice(InputPartition):
    """Directories of one partition: path, whether to descend, and which share of its names (``part`` of ``parts``)."""
    jobs: list[tuple[str, bool, int, int]]


def inside(real: str, root: str) -> bool:
    return real == root or real.startswith(root if root.endswith("/") else root + "/")


def _subdirectories(top: str) -> list[str]:
    """Real directories in ``top`` (links to directories are never followed, so no walk is endless); none if unreadable."""
    try:
        with os.scandir(top) as entries:
            return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
    except OSError:
        return []


def _entries(top: str) -> int:
    """An upper bound for planning: a directory's own size grows with its names, 24 bytes at least for each."""
    try:
        return os.stat(top).st_size // 24
    except OSError:
        return 0


class Listing(DataSourceReader):
    def __init__(self, options):
        self.given = options["path"]
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.slices, self.wide = int(options.get("slices", SLICES)), int(options.get("wide", WIDE))

    def partitions(self) -> list[Slice]:
        if not os.path.isdir(self.given):
            return [Slice([(self.given, False, 0, 1)])]
        shallow: list[str] = [self.given]  # listed here by itself, subtrees apart
        subtrees: list[str] = _subdirectories(self.given) if self.recursive else []
        while subtrees and len(subtrees) < self.slices:
            below = [x for top in subtrees for x in _subdirectories(top)]
            shallow += subtrees
            subtrees = below
        jobs = [(d, True, 0, 1) for d in subtrees]
        for d in shallow:
            parts = min(self.slices, 1 + _entries(d) // self.wide)
            jobs += [(d, False, k, parts) for k in range(parts)]
        dealt: list[list] = [[] for _ in range(min(self.slices, len(jobs)))]
        for k, job in enumerate(jobs):
            dealt[k % len(dealt)].append(job)
        return [Slice(x) for x in dealt]

    def _walk(self, top: str, descend: bool, part: int, parts: int) -> Iterator[tuple[str, bool]]:
        todo = [top]
        while todo:
            here = todo.pop()
            try:
                entries = os.scandir(here)
            except OSError:  # one directory that cannot be read does not end the scan
                continue
            with entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        if descend:
                            todo.append(e.path)
                    elif parts == 1 or zlib.crc32(os.fsencode(e.name)) % parts == part:
                        yield e.path, e.is_symlink()

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        root = os.path.realpath(self.given)
        named = not os.path.isdir(root)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                              names=["path", "real_path", "bytes", "mtime", "linked"])
        for top, descend, part, parts in partition.jobs:
            found = [(top, os.path.islink(top))] if named else self._walk(top, descend, part, parts)
            for path, linked in found:
                try:
                    real = os.path.realpath(path, strict=True) if linked else path
                    facts = os.stat(real)
                except OSError:  # a link to nothing, or a file that went meanwhile
                    continue
                if not stat.S_ISREG(facts.st_mode) or (linked and not named and not inside(real, root)):
                    continue
                rows.append((path, real, facts.st_size, datetime.fromtimestamp(facts.st_mtime, timezone.utc), linked))
                if len(rows) >= BATCH:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class AssetListing(DataSource):
    """``path, real_path, bytes, mtime, linked`` of the regular files at ``path``; links out of the tree are left out."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Listing:
        return Listing(self.options)


def list_tree(spark: SparkSession, root: str, recursive: bool = False, slices: int = SLICES, wide: int = WIDE) -> DataFrame:
    """Files of a directory, of its whole tree, or the named file itself; every executor must see ``root``.

    A file that a link names is taken under the link's path if its real path lies in the tree. A root that does not
    exist is an error; an empty one gives no rows.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(f"nothing at {root}")
    spark.dataSource.register(AssetListing)
    return spark.read.format(NAME).options(path=root, recursive=str(recursive).lower(), slices=slices, wide=wide).load()


def _contents(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, parts = 0, 0, []
            for i, real in enumerate(batch["real_path"].to_pylist()):
                with open(real, "rb") as f:
                    parts.append(f.read())
                held += len(parts[-1])
                if held >= limit or i + 1 == batch.num_rows:
                    piece = batch.slice(start, len(parts))
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(parts, pa.binary())], names=[*piece.schema.names, "content"])
                    start, held, parts = i + 1, 0, []
    return run


def with_content(files: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """Adds ``content``, read by the tasks from ``real_path`` in batches of about ``limit`` bytes."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(_contents(limit), f"{fields}, content binary")
