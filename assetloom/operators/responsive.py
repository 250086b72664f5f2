"""Responsive variant sets.

A row's requested widths are a short list it carries itself, so survival,
resizing, naming and markup are array expressions: no shuffle anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions.scalars import U32_MAX, ext_for_format, mime_for_format
from ..schemas import require
from .raster import planned_dims

C = F.col
FIT_HEIGHT = 1_000_000


def parse_widths(text: Column) -> Column:
    """Comma list -> sorted distinct positive ints; NULL when any entry is invalid."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p))
    numbers = F.transform(parts, lambda p: F.when(p.rlike(r"^\+?[0-9]{1,11}$"), p.try_cast("bigint")))
    valid = F.forall(numbers, lambda n: F.coalesce(n.between(1, U32_MAX), F.lit(False)))
    return F.when(valid, F.array_sort(F.array_distinct(numbers)))


def surviving_widths(df: DataFrame) -> DataFrame:
    """Requested ``widths`` no wider than ``src_w``, and a reason when none is left."""
    require(df, "widths", "src_w")
    kept = F.filter("widths", lambda w: w <= C("src_w"))
    none = F.concat(F.lit("no requested width is ≤ the source width ("), C("src_w").cast("string"), F.lit("px)"))
    return df.withColumn("kept", kept).withColumn(
        "reason", F.when(C("widths").isNull(), "invalid widths").when(F.size("kept") == 0, none))


def variant_dims(df: DataFrame) -> DataFrame:
    """Actual sizes of the surviving widths, first occurrence per actual width."""
    def fit(w: Column) -> Column:
        dw, dh = planned_dims(F.lit("fit"), C("src_w"), C("src_h"), w, F.lit(FIT_HEIGHT), F.lit(None).cast("double"))
        return F.struct(w.alias("requested"), dw.alias("w"), dh.alias("h"))

    sized = df.withColumn("_v", F.transform("kept", fit))
    actual = F.transform("_v", lambda v: v["w"])
    first = F.filter("_v", lambda v, i: F.array_position(actual, v["w"]) == i + 1)
    return sized.withColumn("variants", first).drop("_v")


def variant_name(stem: Column, w: Column, fmt: Column) -> Column:
    """'{stem}-{w}w.{ext}'."""
    return F.concat(stem, F.lit("-"), w.cast("string"), F.lit("w."), ext_for_format(fmt))


def variant_matrix(df: DataFrame, formats: list[str]) -> DataFrame:
    """One row per asset, variant and format (both bounded lists)."""
    rows = df.select("asset_id", "stem", F.explode("variants").alias("v"))
    return rows.select("asset_id", "stem", "v.w", "v.h", F.posexplode(F.array(*[F.lit(f) for f in formats])).alias("fmt_ord", "fmt")).withColumn(
        "name", variant_name(C("stem"), C("w"), C("fmt")))


def _srcset(fmt: str) -> Column:
    return F.array_join(F.transform("variants", lambda v: F.concat(
        variant_name(C("stem"), v["w"], F.lit(fmt)), F.lit(" "), v["w"].cast("string"), F.lit("w"))), ", ")


def srcset(df: DataFrame, formats: list[str]) -> DataFrame:
    """Per asset and format the ascending candidate list."""
    sets = F.array(*[F.struct(F.lit(f).alias("fmt"), _srcset(f).alias("srcset")) for f in formats])
    return df.where(F.size("variants") > 0).select("asset_id", F.explode(sets).alias("_s")).select("asset_id", "_s.*")


def fallback(df: DataFrame, formats: list[str]) -> DataFrame:
    """Widest variant in the last format."""
    widest = F.element_at("variants", -1)
    return df.where(F.size("variants") > 0).withColumns({
        "fallback_file": variant_name(C("stem"), widest["w"], F.lit(formats[-1])),
        "fallback_w": widest["w"], "fallback_h": widest["h"]})


def picture_html(df: DataFrame, formats: list[str]) -> DataFrame:
    """``<img srcset>`` for one format, else ``<picture>`` with typed sources in format order."""
    q = F.lit('"')
    attrs = F.concat(F.lit('src="'), C("fallback_file"), F.lit('" width="'), C("fallback_w").cast("string"),
                     F.lit('" height="'), C("fallback_h").cast("string"), F.lit('" alt="">'))
    if len(formats) == 1:
        html = F.concat(F.lit('<img srcset="'), _srcset(formats[0]), q, F.lit(" "), attrs)
    else:
        sources = [F.concat(F.lit('  <source type="'), mime_for_format(F.lit(f)), F.lit('" srcset="'), _srcset(f), F.lit('">\n'))
                   for f in formats]
        html = F.concat(F.lit("<picture>\n"), *sources, F.lit("  <img "), attrs, F.lit("\n</picture>"))
    return fallback(df, formats).select("asset_id", html.alias("html"))


def responsive_quality(fmt: Column, requested: Column) -> Column:
    """Encoder quality of a variant: lossy formats only."""
    return F.when(fmt.isin("jpeg", "avif", "webp"), F.coalesce(requested, F.lit(fixed.RESPONSIVE_QUALITY)))
