"""Metadata as tag and segment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..schemas import require
from .skew import dealt_join

TAG_BLOCK = 4096


def tags_nested(tags: DataFrame, block: int = TAG_BLOCK) -> DataFrame:
    """Tag rows -> arrays of structs, ordered by tag.

    (asset, ifd, tag) is unique, so cutting the tag range into blocks bounds each
    array at ``block`` entries whatever one asset carries.
    """
    require(tags, "asset_id", "ifd", "tag", "value")
    return tags.groupBy("asset_id", "ifd", F.floor(F.col("tag") / block).alias("tag_block")).agg(
        F.array_sort(F.collect_list(F.struct("tag", "value"))).alias("tags"))


def tags_long(nested: DataFrame) -> DataFrame:
    """Arrays of structs -> tag rows."""
    return nested.select("asset_id", "ifd", F.explode("tags").alias("_t")).select(
        "asset_id", "ifd", "_t.tag", "_t.value")


def stripped_kind(fmt: Column, kind: Column) -> Column:
    """Segment kinds that carry metadata, per container."""
    return ((fmt == "jpeg") & kind.isin(*fixed.JPEG_STRIPPED_KINDS)) | (
        (fmt == "png") & kind.isin(*fixed.PNG_STRIPPED_KINDS))


def manifest_kind(fmt: Column, kind: Column) -> Column:
    """Provenance manifest segments."""
    return ((fmt == "jpeg") & (kind == fixed.JPEG_MANIFEST_KIND)) | (
        (fmt == "png") & (kind == fixed.PNG_MANIFEST_KIND))


def strip_all(segments: DataFrame) -> DataFrame:
    """Drop every metadata segment; render-relevant ones stay."""
    return segments.where(~stripped_kind(F.col("fmt"), F.col("kind")))


def clean_gps(tags: DataFrame) -> DataFrame:
    """Drop the GPS directory only."""
    return tags.where(F.col("ifd") != "GPS")


def set_tags(tags: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert tags: new values win, others stay, missing directories appear."""
    new = updates.select("asset_id", "ifd", "tag", F.col("value").alias("_new"))
    merged = tags.join(new, ["asset_id", "ifd", "tag"], "full")
    return merged.select("asset_id", "ifd", "tag", F.coalesce("_new", "value").alias("value"))


def copy_metadata(tags: DataFrame, pairs: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """Replace each target's tags by its source's; an empty source clears the target.

    ``pairs``: ``target_id, source_id`` with one source per target. The targets of a popular source are dealt to several tasks.
    """
    kept = tags.join(pairs.select(F.col("target_id").alias("asset_id")), "asset_id", "left_anti")
    given = tags.select(F.col("asset_id").alias("source_id"), "ifd", "tag", "value")
    grafted = (dealt_join(pairs.select("target_id", "source_id"), given, "source_id", ["target_id"], rows_per_task)
               .select(F.col("target_id").alias("asset_id"), "ifd", "tag", "value"))
    return kept.select("asset_id", "ifd", "tag", "value").unionByName(grafted)


def manifest_dropped(before: DataFrame, after: DataFrame) -> DataFrame:
    """Assets that carried a provenance manifest before and no longer do."""
    carrying = lambda segs: segs.where(manifest_kind(F.col("fmt"), F.col("kind"))).select("asset_id").distinct()
    return carrying(before).join(carrying(after), "asset_id", "left_anti")


def exif_facts(tags: DataFrame) -> DataFrame:
    """GPS presence, identifying camera tags and orientation per asset."""
    primary = F.col("ifd") == "PRIMARY"
    orient = primary & (F.col("tag") == fixed.TAG_ORIENTATION)
    return tags.groupBy("asset_id").agg(
        F.bool_or(F.col("ifd") == "GPS").alias("has_gps"),
        F.bool_or(primary & F.col("tag").isin(*fixed.CAMERA_TAGS)).alias("has_camera"),
        F.max(F.when(orient, F.col("value").try_cast("int"))).alias("orientation"))


def preservation_policy(tags: DataFrame, keep_gps: bool = False) -> DataFrame:
    """What re-encoding carries over: orientation, copyright and artist; GPS on request."""
    keep = F.col("tag").isin(*fixed.KEPT_TAGS) & (F.col("ifd") != "GPS")
    return tags.where(keep | (F.col("ifd") == "GPS") if keep_gps else keep)


def metadata_audit(segments: DataFrame) -> DataFrame:
    """Segments and bytes by container and kind, with every subtotal."""
    return segments.cube("fmt", "kind").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("length").alias("bytes"),
        F.count_if(stripped_kind(F.col("fmt"), F.col("kind"))).alias("strippable"),
        F.grouping_id().alias("level"))


def ext_for_metadata(ext: Column, sniffed: Column) -> Column:
    """Keep the input's extension in lower case, else 'png' for a sniffed PNG and 'jpg' for the rest."""
    return F.coalesce(F.nullif(F.lower(ext), F.lit("")), F.when(sniffed == "png", "png").otherwise("jpg"))
