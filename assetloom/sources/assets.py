"""Corpus scans and path-level filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import paths
from ..functions.scalars import is_image_ext
from .listing import list_tree, with_content


def path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Add ``name, stem, ext, parent``."""
    p = F.col(path)
    return df.withColumns({"name": paths.file_name(p), "stem": paths.stem(p), "ext": paths.extension(p),
                           "parent": paths.parent_name(p)})


def filter_asset_ext(df: DataFrame, ext: str = "ext", extra: list[str] | None = None) -> DataFrame:
    """Case-insensitive allow-list; webp inputs need ``extra=['webp']``."""
    return df.where(is_image_ext(F.col(ext), extra))


def contained_in(df: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Rows whose cleaned path lies inside the cleaned root, compared by component."""
    return df.where(paths.under(paths.lexical_clean(F.col(path)), paths.lexical_clean(F.lit(root))))


def resolved_in(df: DataFrame, real_root: str, real_path: str = "real_path") -> DataFrame:
    """Rows whose resolved path lies inside the resolved root, compared by component."""
    return df.where(paths.under(F.col(real_path), F.lit(real_root)))


def _indexed(spark: SparkSession, root: str, recursive: bool, content: bool) -> DataFrame:
    """Rows of Spark's own file index, for stores that only Spark reads; it leaves out empty and hidden files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return rows.select("path", F.col("path").alias("real_path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"),
                       F.lit(False).alias("linked"), *(["content"] if content else []))


def scan_assets(spark: SparkSession, root: str, recursive: bool = False, glob: str | None = None,
                content: bool = False, extra: list[str] | None = None) -> DataFrame:
    """Asset rows of a file, directory or glob, by path (which is also the ``asset_id``).

    A named file is taken whatever its extension. A directory lists its top level unless
    ``recursive``; an empty one gives an empty result, a glob that matches nothing is an
    error. ``**`` crosses directories. Zero-byte files are rows like any other. A link is
    taken under its own path if what it names lies under the root (of a glob: under its
    literal part), and ``real_path`` is where it leads; links that lead elsewhere or nowhere
    are left out, links to directories are not followed. Content is only read when asked
    for, otherwise no file is opened.

    A root with a scheme other than ``file`` is listed by Spark's file index: such stores
    have no links, but empty files do not appear.
    """
    root = root.rstrip("/") or "/"
    remote = "://" in root and not root.startswith("file://")
    if not remote:
        root = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root
    top, deep = root, recursive
    if glob is not None:
        literal = re.split(r"[*?\[]", glob, maxsplit=1)[0]
        folder = literal.rpartition("/")[0] if literal != glob else glob
        top = f"{root}/{folder}".rstrip("/")
        deep = "/" in glob[len(folder):].lstrip("/") or "**" in glob
    rows = _indexed(spark, top, deep, content) if remote else list_tree(spark, top, deep)
    if glob is not None and top != f"{root}/{glob}":
        rows = rows.where(paths.glob_matches(F.substring("path", F.lit(len(root) + 2), F.length("path")), glob, crosses_slash=False))
    rows = path_parts(rows)
    rows = rows.where(is_image_ext(F.col("ext"), extra) | (F.col("path") == root)).withColumn("asset_id", F.col("path"))
    if glob and rows.limit(1).isEmpty():
        raise FileNotFoundError(f"no assets under {root} matching {glob}")
    return with_content(rows) if content and not remote else rows


def within_pixel_budget(df: DataFrame, w: str = "w", h: str = "h") -> DataFrame:
    """Reason a declared size is over the decode budget (NULL when within)."""
    area = F.col(w).cast("bigint") * F.col(h).cast("bigint")
    side = F.greatest(w, h) > fixed.MAX_IMAGE_DIMENSION
    return df.withColumn("reason", F.when(side, "side over limit").when(
        area > fixed.MAX_IMAGE_PIXELS, F.concat(F.lit("image "), F.col(w).cast("string"), F.lit("x"), F.col(h).cast("string"),
                                                F.lit(" would hold "), area.cast("string"), F.lit(" pixels"))))


def container_label(pixel_format: Column, container: Column) -> Column:
    """The real container where the pixel format is only a stand-in for it."""
    return F.when(container.isin(*fixed.LIVE_CONTAINERS), container).otherwise(pixel_format)
