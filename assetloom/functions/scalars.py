"""Scalar parsers and formatters as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

U32_MAX = 4_294_967_295


def lookup(col: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Map a column through a small fixed table as one CASE expression."""
    out = None
    for key, value in table.items():
        test, hit = col == key, F.lit(value)
        out = F.when(test, hit) if out is None else out.when(test, hit)
    return out if default is None else out.otherwise(default)


def fixed_decimals(value: Column, digits: int) -> Column:
    """Exactly rounded fixed-point text, without grouping commas."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def parse_size(text: Column) -> Column:
    """'200KB' -> bytes; NULL when empty, not positive or of an unknown unit."""
    trimmed = F.trim(text)
    number = F.regexp_extract(trimmed, r"^([0-9.]*)", 1)
    unit = F.lower(F.trim(F.substring(trimmed, F.length(number) + 1, F.length(trimmed) + 1)))
    factor = (F.when(unit.isin("", "b"), F.lit(1.0))
              .when(unit.isin("k", "kb"), F.lit(1000.0))
              .when(unit.isin("m", "mb"), F.lit(1_000_000.0))
              .when(unit == "kib", F.lit(1024.0))
              .when(unit == "mib", F.lit(1_048_576.0)))
    size = F.when(number.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), number.try_cast("double")) * factor
    return F.when((size >= 1.0) & (size < 9.2e18), F.round(size).cast("bigint"))


def fmt_bytes(n: Column) -> Column:
    """'512 B', '6.0 KB', '1.5 MB' in decimal units."""
    mega, kilo = n.cast("double") / 1e6, n.cast("double") / 1e3
    return (F.when(n >= 1_000_000, F.concat(fixed_decimals(mega, 1), F.lit(" MB")))
            .when(n >= 1000, F.concat(fixed_decimals(kilo, 1), F.lit(" KB")))
            .otherwise(F.concat(n.cast("string"), F.lit(" B"))))


def _u32(text: Column) -> Column:
    value = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("bigint"))
    return F.when(value.between(1, U32_MAX), value)


def parse_wxh(text: Column) -> tuple[Column, Column]:
    """'800x600' -> (width, height); both NULL unless both parse as positive."""
    shape = r"^([^xX]+)[xX]([^xX]+)$"
    w, h = _u32(F.regexp_extract(text, shape, 1)), _u32(F.regexp_extract(text, shape, 2))
    ok = w.isNotNull() & h.isNotNull()
    return F.when(ok, w), F.when(ok, h)


def parse_color(text: Column) -> tuple[Column, Column, Column, Column]:
    """'[#]RRGGBB[AA]' -> four channel ints; all NULL when malformed."""
    digits = F.regexp_extract(text, r"^#?([0-9A-Fa-f]{6}(?:[0-9A-Fa-f]{2})?)$", 1)
    ok = digits != ""

    def channel(start: int) -> Column:
        pair = F.substring(digits, start, 2)
        return F.when(ok & (pair != ""), F.conv(pair, 16, 10).cast("int"))

    return channel(1), channel(3), channel(5), F.when(ok, F.coalesce(channel(7), F.lit(255)))


def parse_threshold(text: Column) -> tuple[Column, Column]:
    """'BYTES:PERCENT' -> (min_bytes, min_percent), percent at most 100."""
    first = F.trim(F.regexp_extract(text, r"^([^:]*):", 1))
    second = F.trim(F.regexp_extract(text, r"^[^:]*:(.*)$", 1))
    size = F.when(first.rlike(r"^\+?[0-9]+$"), first.try_cast("bigint"))
    pct = F.when(second.rlike(r"^\+?[0-9]+$"), second.try_cast("bigint"))
    ok = size.isNotNull() & (pct <= 100)
    return F.when(ok, size), F.when(ok, pct)


def format_from_ext(ext: Column) -> Column:
    """Format named by an extension, any case; NULL when unknown."""
    return lookup(F.lower(ext), fixed.FORMAT_OF_EXT)


def ext_for_format(fmt: Column) -> Column:
    """Conventional extension of a format, 'bin' when it has none."""
    return lookup(fmt, fixed.EXT_OF_FORMAT, F.lit("bin"))


def mime_for_format(fmt: Column) -> Column:
    """Media type; unlisted formats fall back to their extension."""
    return lookup(fmt, fixed.MIME_OF_FORMAT, F.concat(F.lit("image/"), ext_for_format(fmt)))


def is_raw_ext(ext: Column) -> Column:
    """Camera-raw extension, any case."""
    return F.lower(ext).isin(*fixed.RAW_EXTENSIONS)


def is_image_ext(ext: Column, extra: list[str] | None = None) -> Column:
    """On the input allow-list, any case."""
    return F.lower(ext).isin(*fixed.IMAGE_EXTENSIONS, *(extra or []))


def escape_json(text: Column) -> Column:
    """Quoted JSON text of a string (Spark's own, equivalent escapes)."""
    quoted = F.to_json(F.struct(text.alias("v")))
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def short_hash(digest: Column) -> Column:
    """First 12 characters."""
    return F.left(digest, F.lit(12))


def plural(n: Column, noun: str) -> Column:
    """'1 target', '2 targets'."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"),
                    F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def format_label(fmt: Column) -> Column:
    """Stable lower-case display name."""
    return F.lower(fmt)


def color_type_label(channels: Column, depth: Column) -> Column:
    """'l8' ... 'rgba32f' from channel count and bits per channel."""
    base = F.element_at(F.array(*[F.lit(v) for v in ("l", "la", "rgb", "rgba")]), channels)
    return F.concat(base, depth.cast("string"), F.when(depth == 32, F.lit("f")).otherwise(F.lit("")))
