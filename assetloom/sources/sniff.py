"""Format sniffing from leading bytes, on the JVM side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed


def _hex(content: Column, start: int, length: int) -> Column:
    return F.hex(F.substring(content, start + 1, length))


def be(content: Column, start: int, length: int) -> Column:
    """Big-endian unsigned integer."""
    return F.conv(F.nullif(_hex(content, start, length), F.lit("")), 16, 10).cast("bigint")


def le(content: Column, start: int, length: int) -> Column:
    """Little-endian unsigned integer."""
    pairs = [F.hex(F.substring(content, start + i + 1, 1)) for i in reversed(range(length))]
    return F.conv(F.nullif(F.concat(*pairs), F.lit("")), 16, 10).cast("bigint")


def has_brand(content: Column, brands: list[str]) -> Column:
    """ISO media file whose major or a compatible brand is listed; scan clamped to its box."""
    names = [b.encode().hex().upper() for b in brands]
    end = F.least(F.greatest(be(content, 0, 4), F.lit(8)), F.octet_length(content).cast("bigint"))
    slots = F.when(end >= 20, F.sequence(F.lit(16).cast("bigint"), end - 4, F.lit(4).cast("bigint")))
    other = F.exists(slots, lambda i: F.hex(F.substring(content, i.cast("int") + 1, F.lit(4))).isin(*names))
    is_ftyp = (_hex(content, 4, 4) == b"ftyp".hex().upper()) & (F.octet_length(content) >= 12)
    return is_ftyp & (_hex(content, 8, 4).isin(*names) | F.coalesce(other, F.lit(False)))


def is_svg(content: Column, window: int | None = None) -> Column:
    """``<svg`` at the start, or an XML prolog with ``<svg`` after it.

    Only what starts with a prolog is read beyond its first bytes: to its end, or up to ``window`` characters.
    """
    head = _hex(content, 0, 3)
    bom = F.when(head == "EFBBBF", 3).when(F.left(head, F.lit(4)).isin("FFFE", "FEFF"), 2).otherwise(0)
    space = r"\A[ \t\n\f\r]*"
    trimmed = lambda length: F.regexp_replace(F.decode(F.substring(content, bom + 1, length), "ISO-8859-1"), space, "")
    near = trimmed(F.lit(256))
    whole = trimmed(F.octet_length(content))
    head_text = F.when(F.length(near) >= 16, near).otherwise(whole)  # all white space, or a short file
    root = r"<svg(?:[ \t\n\f\r>/]|\z)"
    body = whole if window is None else F.substring(whole, 1, window)
    return head_text.rlike(r"(?i)\A" + root) | F.when(head_text.rlike(r"(?i)\A<\?xml"), body.rlike("(?i)" + root)).otherwise(False)


def sniff_format(content: Column) -> Column:
    """Format by brand or signature, then SVG; NULL if none.

    Text is looked at last: no SVG starts like any of the others, so the order only saves decoding.
    """
    h = _hex(content, 0, 12)
    starts = lambda *sig: reduce(lambda a, b: a | b, [h.startswith(s) for s in sig])
    return (F.when(has_brand(content, fixed.AVIF_BRANDS), "avif")
            .when(has_brand(content, fixed.HEIC_BRANDS), "heic")
            .when(starts("89504E470D0A1A0A"), "png").when(starts("FFD8FF"), "jpeg")
            .when(starts("474946383961", "474946383761"), "gif")
            .when(starts("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
            .when(starts("424D"), "bmp").when(starts("49492A00", "4D4D002A"), "tiff")
            .when(starts("00000100"), "ico").when(is_svg(content), "svg"))


def jpeg_truncated(content: Column) -> Column:
    """JPEG without its end-of-image marker."""
    return _hex(content, 0, 3).eqNullSafe(F.lit("FFD8FF")) & (F.hex(F.substring(content, -2, 2)) != "FFD9")


def _magnitude(v: Column) -> Column:
    """Absolute value of a 32-bit number read without its sign: bitmaps stored top-down have a negative height."""
    return F.when(v >= 2 ** 31, 2 ** 32 - v).otherwise(v)


def _icon_side(v: Column) -> Column:
    """Icon directories write 256 as 0."""
    return F.when(v == 0, F.lit(256).cast("bigint")).otherwise(v)


def header_dims(df: DataFrame, content: str = "content", fmt: str = "format") -> DataFrame:
    """Declared size at fixed offsets for PNG, GIF, BMP, ICO (first image) and WebP; JPEG needs its segments."""
    c, f = F.col(content), F.col(fmt)
    kind = _hex(c, 12, 4)
    packed = le(c, 21, 4)
    vp8x, vp8l = kind == b"VP8X".hex().upper(), kind == b"VP8L".hex().upper()
    low14 = lambda v: v.bitwiseAND(F.lit(16383))
    w = (F.when(f == "png", be(c, 16, 4)).when(f == "gif", le(c, 6, 2)).when(f == "bmp", _magnitude(le(c, 18, 4))).when(f == "ico", _icon_side(le(c, 6, 1)))
         .when((f == "webp") & vp8x, le(c, 24, 3) + 1).when((f == "webp") & vp8l, low14(packed) + 1)
         .when(f == "webp", low14(le(c, 26, 2))))
    h = (F.when(f == "png", be(c, 20, 4)).when(f == "gif", le(c, 8, 2)).when(f == "ico", _icon_side(le(c, 7, 1))).when(f == "bmp", _magnitude(le(c, 22, 4)))
         .when((f == "webp") & vp8x, le(c, 27, 3) + 1).when((f == "webp") & vp8l, low14(F.shiftright(packed, 14)) + 1)
         .when(f == "webp", low14(le(c, 28, 2))))
    return df.withColumns({"width": w, "height": h})
