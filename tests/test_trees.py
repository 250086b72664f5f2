"""Declared sizes of containers that are trees: boxes of AVIF and HEIC, directories of TIFF."""

from __future__ import annotations

import struct

from assetloom.sources import segments as SG
from assetloom.sources import trees


def box(kind: bytes, body: bytes, large: bool = False) -> bytes:
    if large:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def ispe(w, h):
    return box(b"ispe", struct.pack(">III", 0, w, h))


def heif(brand, properties, links, primary=1, wide=False, alpha=False, late=False):
    """A file of items with properties; ``links`` has the property numbers of each item."""
    entry = lambda i, ps: struct.pack(">HB", i, len(ps)) + b"".join(struct.pack(">H", 0x8000 | p) if wide else bytes([0x80 | p]) for p in ps)
    ipma = box(b"ipma", struct.pack(">II", int(wide), len(links)) + b"".join(entry(i, ps) for i, ps in links.items()))
    pitm = box(b"pitm", struct.pack(">IH", 0, primary)) if primary else b""
    meta = box(b"meta", bytes(4) + pitm + box(b"iprp", box(b"ipco", b"".join(properties)) + ipma))
    mdat = box(b"mdat", b"ispe" * 50, large=True)
    return box(b"ftyp", brand + bytes(4) + b"mif1") + (mdat + meta if late else meta + mdat)


def tiff(order, entries, at=8, extra=b""):
    e = "<" if order == b"II" else ">"
    ifd = struct.pack(e + "H", len(entries)) + b"".join(struct.pack(e + "HHI", tag, kind, n) + value for tag, kind, n, value in entries) + struct.pack(e + "I", at)
    return order + struct.pack(e + "HI", 42, 8) + ifd + extra


def test_sizes(spark):
    short = lambda e, v: struct.pack(e + "HH", v, 0)
    long = lambda e, v: struct.pack(e + "I", v)
    bits_at = 8 + 2 + 12 * 4 + 4
    files = {
        "a.avif": (heif(b"avif", [ispe(640, 480), ispe(1920, 1080), box(b"pixi", bytes([0, 0, 0, 0, 3, 10, 10, 10]))], {1: [2, 3], 2: [1]}), ("avif", 1920, 1080, 3, 10, False)),
        "thumb first, wide links, late": (heif(b"heic", [ispe(160, 120), ispe(4032, 3024), box(b"irot", b"\1")], {7: [2, 3], 1: [1]}, primary=7, wide=True, late=True), ("heic", 3024, 4032, 3, 8, False)),
        "alpha": (heif(b"avif", [ispe(20, 10), box(b"auxC", bytes(4) + b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha\0")], {1: [1], 2: [2]}), ("avif", 20, 10, 4, 8, True)),
        "no primary": (heif(b"avif", [ispe(20, 10), ispe(300, 200), ispe(5, 5)], {}, primary=0), ("avif", 300, 200, 3, 8, False)),
        "cut": (heif(b"avif", [ispe(20, 10)], {1: [1]})[:40], ("avif", None, None, 3, 8, False)),
        "II": (tiff(b"II", [(256, 3, 1, short("<", 300)), (257, 4, 1, long("<", 70000)), (258, 3, 3, long("<", bits_at)), (277, 3, 1, short("<", 3))], 0, struct.pack("<HHH", 16, 16, 16)),
               ("tiff", 300, 70000, 3, 16, False)),
        "MM": (tiff(b"MM", [(256, 4, 1, long(">", 99)), (257, 3, 1, short(">", 7)), (258, 3, 1, short(">", 8)), (277, 3, 1, short(">", 4)), (262, 3, 1, short(">", 2))]), ("tiff", 99, 7, 4, 8, True)),
        "ink, chain that turns back": (tiff(b"MM", [(256, 3, 1, short(">", 9)), (257, 3, 1, short(">", 7)), (262, 3, 1, short(">", 5)), (277, 3, 1, short(">", 4))], 8), ("tiff", 9, 7, 4, 8, False)),
        "empty directory": (b"II*\0" + struct.pack("<I", 4000), ("tiff", None, None, 1, 8, False)),
    }
    df = spark.createDataFrame([(n, bytearray(b)) for n, (b, _) in files.items()], "asset_id STRING, content BINARY")
    got = {r.asset_id: (r.format, r.width, r.height, r.channels, r.bit_depth, r.has_alpha) for r in SG.asset_info(df).collect()}
    assert got == {n: want for n, (_, want) in files.items()}


def test_malformed_trees_end():
    good = heif(b"avif", [ispe(20, 10)], {1: [1]})
    for cut in range(len(good)):
        list(trees.heif(good[:cut]))
        damaged = bytearray(good)
        damaged[cut] ^= 0xFF
        list(trees.heif(bytes(damaged)))
    page = tiff(b"II", [(256, 3, 1, struct.pack("<HH", 5, 0))] * 3)
    for cut in range(len(page)):
        list(trees.tiff(page[:cut]))
