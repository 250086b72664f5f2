"""Container segment inventory.

Walking a container is sequential, so one small Python function over Arrow batches
lists the segments of a row; everything after it is relational.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .sniff import header_dims, sniff_format

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its Python functions travel with the job

HEAD, INFO_HEAD = 32, 64
JPEG_NAMES = {0xFE: "COM", 0xDB: "DQT", 0xC4: "DHT", 0xDD: "DRI", 0xDA: "SOS"}
STANDALONE = {0x01, 0xD8, 0xD9, *range(0xD0, 0xD8)}


def _jpeg_kind(marker: int) -> str:
    if 0xE0 <= marker <= 0xEF:
        return f"APP{marker - 0xE0}"
    if marker in JPEG_NAMES:
        return JPEG_NAMES[marker]
    return f"SOF{marker - 0xC0}" if 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC) else f"M{marker:02X}"


def _jpeg(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    pos = 2
    while pos + 4 <= len(data) and data[pos] == 0xFF:
        marker = data[pos + 1]
        if marker in STANDALONE:
            pos += 2
            continue
        size = int.from_bytes(data[pos + 2:pos + 4], "big")
        if size < 2 or pos + 2 + size > len(data):
            return
        yield _jpeg_kind(marker), pos, size - 2, pos + 4
        if marker == 0xDA:
            return
        pos += 2 + size


def _png(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    pos = 8
    while pos + 12 <= len(data):
        size, kind = int.from_bytes(data[pos:pos + 4], "big"), bytes(data[pos + 4:pos + 8]).decode("latin-1")
        if pos + 12 + size > len(data):
            return
        yield kind, pos, size, pos + 8
        if kind == "IEND":
            return
        pos += 12 + size


def _riff(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    pos = 12
    while pos + 8 <= len(data):
        kind, size = bytes(data[pos:pos + 4]).decode("latin-1"), int.from_bytes(data[pos + 4:pos + 8], "little")
        if pos + 8 + size > len(data):
            return
        yield kind, pos, size, pos + 8
        pos += 8 + size + size % 2


def _sub_blocks(data: bytes, pos: int) -> int:
    while pos < len(data) and data[pos]:
        pos += data[pos] + 1
    return pos + 1


def _color_table(flags: int) -> int:
    return 3 << ((flags & 7) + 1) if flags & 0x80 else 0


def _gif(data: bytes) -> Iterator[tuple[str, int, int, int]]:
    if len(data) < 13:
        return
    pos = 13 + _color_table(data[10])
    while pos < len(data):
        start, tag = pos, data[pos]
        if tag == 0x21:
            pos = _sub_blocks(data, pos + 2)
            kind = "extension"
        elif tag == 0x2C and pos + 10 < len(data):
            pos = _sub_blocks(data, pos + 11 + _color_table(data[pos + 9]))
            kind = "image"
        else:
            return
        if pos > len(data):
            return
        yield kind, start, pos - start, start + 1


#: Readers by leading bytes: a test of the first 16 bytes, and a function from a container to its segments.
READERS: list[tuple[Callable[[bytes], bool], Callable[[bytes], Iterator[tuple[str, int, int, int]]]]] = [
    (lambda h: h[:3] == b"\xff\xd8\xff", _jpeg),
    (lambda h: h[:8] == b"\x89PNG\r\n\x1a\n", _png),
    (lambda h: h[:3] == b"GIF", _gif),
    (lambda h: h[:4] == b"RIFF" and h[8:12] == b"WEBP", _riff),
]
#: Readers of trees, whose nodes are no segments: only their declared facts are wanted.
TREE_READERS = [
    (lambda h: h[:4] in (b"II*\0", b"MM\0*"), trees.tiff),
    (lambda h: h[4:8] == b"ftyp", trees.heif),
]


def register_reader(test: Callable[[bytes], bool], read: Callable[[bytes], Iterator[tuple[str, int, int, int]]]) -> None:
    """Add a reader of segments: ``test`` sees the first 16 bytes, ``read`` yields (kind, offset, length, payload start)."""
    READERS.insert(0, (test, read))


def walk(data: bytes, readers=None) -> Iterator[tuple[str, int, int, int]]:
    """(kind, offset, payload length, payload start) until the end or the first malformed length."""
    head = bytes(data[:16])
    for test, read in READERS if readers is None else readers:
        if test(head):
            return read(data)
    return iter(())


SEGMENT = "array<struct<seg_idx: int, kind: string, offset: bigint, length: bigint, head: binary>>"


def _walker(head: int, readers):
    kind = pa.list_(pa.struct([("seg_idx", pa.int32()), ("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("head", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(batch.num_columns - 1):
                data = memoryview(value.as_buffer()).cast("B") if value.is_valid else memoryview(b"")
                out.append([(i, k, o, n, bytes(data[at:at + min(n, head)])) for i, (k, o, n, at) in enumerate(walk(data, readers))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=[*batch.schema.names[:-1], "segs"])
    return run


def with_segments(df: DataFrame, content: str = "content", head: int = HEAD, readers=None) -> DataFrame:
    """``df`` with ``segs`` in place of the content: the segments of each row, with ``head`` bytes of every payload.

    Containers arrive as Arrow buffers and are walked in place; nothing is copied but the heads.
    """
    rest = [c for c in df.columns if c != content]
    wide = df.select(*rest, F.col(content).cast("binary").alias(content))
    schema = ", ".join(f"`{c}` {wide.schema[c].dataType.simpleString()}" for c in rest)
    return wide.mapInArrow(_walker(head, list(READERS if readers is None else readers)), f"{schema}, segs {SEGMENT}")


def segments(df: DataFrame, content: str = "content", key: str = "asset_id", head: int = HEAD) -> DataFrame:
    """One row per (asset, segment); the content itself goes no further."""
    return with_segments(df.select(key, content), content, head).select(key, F.explode("segs").alias("s")).select(key, "s.*")


def _be16(head: Column, start: int) -> Column:
    return F.conv(F.hex(F.substring(head, start + 1, 2)), 16, 10).cast("bigint")


def _byte(head: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(head, at + 1, 1)), 16, 10).cast("int")


def _tests(kind: Column, head: Column) -> dict[str, Column]:
    """What a single segment says about its container."""
    starts = lambda text: F.startswith(F.hex(head), F.lit(text.encode().hex().upper()))
    flags = lambda bit: _byte(head, 0).bitwiseAND(F.lit(bit)) != 0
    return {
        "has_exif": (kind == "eXIf") | ((kind == "APP1") & starts("Exif")) | (kind == "EXIF"),
        "has_icc": (kind == "iCCP") | ((kind == "APP2") & starts("ICC_PROFILE")) | (kind == "ICCP"),
        "has_actl": kind == "acTL", "webp_anim": (kind == "ANIM") | ((kind == "VP8X") & flags(2)),
        "webp_alpha": ((kind == "VP8X") & flags(16)) | ((kind == "VP8L") & (_byte(head, 4).bitwiseAND(F.lit(16)) != 0)),
        "has_trns": kind == "tRNS",
    }


def _frame(kind: Column, head: Column) -> dict[str, Column]:
    """Numbers that a JPEG frame header states."""
    sof = kind.rlike("^SOF")
    return {"sof_width": F.when(sof, _be16(head, 3)), "sof_height": F.when(sof, _be16(head, 1)), "components": F.when(sof, _byte(head, 5))}


def _segment_aggregates() -> list[Column]:
    kind, head = F.col("kind"), F.col("head")
    return [*[F.bool_or(c).alias(n) for n, c in _tests(kind, head).items()], *[F.max(c).alias(n) for n, c in _frame(kind, head).items()],
            F.count_if(kind == "image").alias("frames")]


def _segment_columns() -> dict[str, Column]:
    """The same facts from the array of one row, so that nothing is shuffled."""
    numbers = {n: F.array_max(F.transform("segs", _frame_number(n))) for n in ("sof_width", "sof_height", "components")}
    return {**_any_segment(), **numbers, "frames": F.size(F.filter("segs", lambda s: s["kind"] == "image"))}


def _any_segment() -> dict[str, Column]:
    def holds(name: str) -> Column:
        return F.exists("segs", lambda s: F.coalesce(_tests(s["kind"], s["head"])[name], F.lit(False)))
    return {n: holds(n) for n in ("has_exif", "has_icc", "has_actl", "webp_anim", "webp_alpha", "has_trns")}


def _frame_number(name: str):
    return lambda s: _frame(s["kind"], s["head"])[name]


def segment_facts(segs: DataFrame, key: str = "asset_id") -> DataFrame:
    """Per asset: EXIF / ICC presence, animation, JPEG size and component count."""
    return segs.groupBy(key).agg(*_segment_aggregates())


def is_animated(facts: DataFrame, fmt: str = "format") -> DataFrame:
    """GIF with two frames, PNG with an animation chunk, animated WebP."""
    f, no = F.col(fmt), F.lit(False)
    return facts.withColumn("animated", F.coalesce(
        F.when(f == "gif", F.col("frames") >= 2).when(f == "png", F.col("has_actl")).when(f == "webp", F.col("webp_anim")), no))


def _declared_columns() -> dict[str, Column]:
    """Size, samples and depth of the first TIFF directory, or of the primary item of an AVIF or HEIC file."""
    def first(test, value):
        return F.get(F.transform(F.filter("segs", test), value), F.lit(0))

    def tag(number: int):
        """First value of a tag, a SHORT or a LONG in the file's byte order."""
        def value(s):
            raw = F.substring(s["head"], 1, F.when(s["kind"].endswith(":4"), 4).otherwise(2))
            turned = F.when(s["kind"].startswith("II"), F.array_join(F.reverse(F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))), "")).otherwise(F.hex(raw))
            return F.conv(turned, 16, 10).cast("bigint")
        return first(lambda s: s["kind"].rlike(f"^(II|MM)0:{number}:[34]$"), value)

    be = lambda s, at, n: F.conv(F.hex(F.substring(s["head"], at + 1, n)), 16, 10).cast("bigint")
    item = lambda name, at, n: first(lambda s: s["kind"] == name, lambda s: be(s, at, n))
    turned = F.coalesce(item("irot*", 0, 1) % 2 == 1, F.lit(False))
    w, h = item("ispe*", 4, 4), item("ispe*", 8, 4)
    alpha = F.exists("segs", lambda s: (s["kind"] == "auxC") & F.contains(F.hex(s["head"]), F.lit(b"alpha".hex().upper())))
    return {"tree_width": F.coalesce(tag(256), F.when(turned, h).otherwise(w)), "tree_height": F.coalesce(tag(257), F.when(turned, w).otherwise(h)),
            "tree_bits": F.coalesce(tag(258), item("pixi*", 5, 1)), "samples": tag(277), "ink": F.coalesce(tag(262) == 5, F.lit(False)), "aux_alpha": alpha}


def asset_info(df: DataFrame, content: str = "content", key: str = "asset_id") -> DataFrame:
    """Format, size, colour layout and metadata presence of every asset, without decoding.

    Sizes of TIFF come from the first directory, those of AVIF and HEIC from the primary item's properties, turned as
    they say. Header facts are expressions, segment facts are read off the walked segments of the same row: one pass over the
    bytes and no shuffle. Assets without any segment keep their row.
    """
    body = F.col(content)
    byte = lambda i: F.conv(F.hex(F.substring(body, i + 1, 1)), 16, 10).cast("int")
    base = header_dims(df.withColumn("format", sniff_format(body)), content)
    png = F.col("format") == "png"
    known = F.col("format").isin("png", "jpeg", "gif", "webp", "tiff", "avif", "heic")
    flat = base.select(key, "format", F.octet_length(body).cast("bigint").alias("file_bytes"), "width", "height",
                       F.when(png, F.greatest(byte(24), F.lit(8))).otherwise(F.lit(8)).alias("bit_depth"),
                       F.when(png, byte(25)).alias("_ct"), F.when(known, body).alias("_content"))  # only what has segments goes to Python
    walked = with_segments(flat, "_content", INFO_HEAD, [*READERS, *TREE_READERS])
    joined = is_animated(walked.withColumns({**_segment_columns(), **_declared_columns()}).drop("segs"))
    fmt = F.col("format")
    channels = (F.when(fmt == "png", F.when(F.col("_ct") == 0, F.when(F.col("has_trns"), 2).otherwise(1)).when(F.col("_ct") == 4, 2)
                       .when((F.col("_ct") == 6) | F.col("has_trns"), 4).otherwise(3))
                .when(fmt == "jpeg", F.when(F.col("components") == 1, 1).otherwise(3))
                .when(fmt == "gif", 4).when(fmt == "webp", F.when(F.col("webp_alpha"), 4).otherwise(3)).when(fmt == "bmp", 3)
                .when(fmt == "tiff", F.coalesce("samples", F.lit(1))).when(fmt.isin("avif", "heic"), F.when(F.col("aux_alpha"), 4).otherwise(3)))
    w, h = F.coalesce("width", "sof_width", "tree_width"), F.coalesce("height", "sof_height", "tree_height")
    depth = F.coalesce(F.when(fmt.isin("tiff", "avif", "heic"), F.col("tree_bits")), F.col("bit_depth")).cast("int")
    return joined.select(
        key, "format", w.alias("width"), h.alias("height"), "file_bytes",
        (w * h * channels * F.greatest(F.lit(1), F.ceil(depth / 8))).alias("decoded_bytes"), channels.alias("channels"), depth.alias("bit_depth"),
        (channels.isin(2, 4) & ~F.col("ink")).alias("has_alpha"), F.coalesce("has_exif", F.lit(False)).alias("has_exif"),
        F.coalesce("has_icc", F.lit(False)).alias("has_icc"), "animated")
