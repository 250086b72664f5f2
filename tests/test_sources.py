from __future__ import annotations

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from assetloom.sources import assets as SA
from assetloom.sources import outputs as SO
from assetloom.sources import segments as SG
from assetloom.sources import sniff as SN


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(w=3, h=2, extra=b"", depth=8, color=2) -> bytes:
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + extra
            + chunk(b"IDAT", zlib.compress(b"\x00" * 20)) + chunk(b"IEND", b""))


def jpeg(w=40, h=30, comps=3, app=b"", end=b"\xff\xd9") -> bytes:
    seg = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    sof = struct.pack(">BHHB", 8, h, w, comps) + b"\x01\x11\x00" * comps
    return b"\xff\xd8" + seg(0xE0, b"JFIF\0" + b"\0" * 9) + app + seg(0xC0, sof) + b"\xff\xda\x00\x03\x00data" + end


EXIF = b"\xff\xe1" + struct.pack(">H", 10) + b"Exif\0\0II"
GIF = b"GIF89a" + struct.pack("<HH", 7, 5) + b"\0\0\0"
FRAME = b"\x2c" + b"\0" * 9 + b"\x02\x01D\0"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    files = {
        "a.PNG": png(), "b.jpg": jpeg(app=EXIF), "cut.jpeg": jpeg(end=b""), "anim.gif": GIF + FRAME * 2 + b"\x3b",
        "still.gif": GIF + FRAME + b"\x3b", "apng.png": png(extra=chunk(b"acTL", b"\0" * 8)), "fake.png": b"just text",
        "v.svg": b"\xef\xbb\xbf  <?xml version='1.0'?>\n<svg width='1'/>", "notes.txt": b"x", "w.webp": b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x12\0\0\0\x63\0\0\x31\0\0",
        "deep/c.png": png(9, 9, depth=16, color=6), "deep/er/d.nef": b"II*\0raw",
        "m.avif": b"\0\0\0\x18ftypmif1\0\0\0\0miafavif", "h.heic": b"\0\0\0\x14ftypmif1\0\0\0\0heic",
    }
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


def names(df):
    return sorted(r["name"] for r in df.select("name").collect())


def test_directory_is_top_level_only(spark, corpus):
    got = names(SA.scan_assets(spark, str(corpus)))
    assert "c.png" not in got and "notes.txt" not in got and "w.webp" not in got
    assert {"a.PNG", "b.jpg", "fake.png", "v.svg"} <= set(got)


def test_recursion_globs_and_extras(spark, corpus):
    assert {"c.png", "d.nef"} <= set(names(SA.scan_assets(spark, str(corpus), recursive=True)))
    assert names(SA.scan_assets(spark, str(corpus), glob="deep/*.png")) == ["c.png"]
    assert "w.webp" in names(SA.scan_assets(spark, str(corpus), extra=["webp"]))


def test_nothing_found_is_an_error(spark, corpus):
    with pytest.raises(FileNotFoundError):
        SA.scan_assets(spark, str(corpus), glob="*.txt")


def test_named_files_deep_globs_and_empty_directories(spark, tmp_path):
    for name in ("a/one.png", "a/b/two.png", "three.png", "notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "none").mkdir()
    assert names(SA.scan_assets(spark, str(tmp_path / "notes.txt"))) == ["notes.txt"]
    assert sorted(names(SA.scan_assets(spark, str(tmp_path), glob="**/*.png"))) == ["one.png", "three.png", "two.png"]
    assert sorted(names(SA.scan_assets(spark, str(tmp_path), glob="a/**/*.png"))) == ["one.png", "two.png"]
    assert names(SA.scan_assets(spark, str(tmp_path / "none"))) == []


def test_scan_prunes_content(spark, corpus):
    plan = SA.scan_assets(spark, str(corpus))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_facts_from_bytes(spark, corpus):
    rows = SA.scan_assets(spark, str(corpus), recursive=True, content=True, extra=["webp"])
    info = {r["name"]: r for r in SG.asset_info(rows).join(rows.select("asset_id", "name"), "asset_id").collect()}
    got = {n: (r["format"], r["width"], r["height"]) for n, r in info.items()}
    assert got["a.PNG"] == ("png", 3, 2) and got["b.jpg"] == ("jpeg", 40, 30) and got["anim.gif"] == ("gif", 7, 5)
    assert got["w.webp"] == ("webp", 100, 50) and got["v.svg"][0] == "svg" and got["m.avif"][0] == "avif" and got["h.heic"][0] == "heic"
    assert got["fake.png"] == (None, None, None)
    assert info["b.jpg"]["has_exif"] and not info["a.PNG"]["has_exif"]
    assert [info[n]["animated"] for n in ("anim.gif", "still.gif", "apng.png", "a.PNG", "w.webp")] == [True, False, True, False, True]
    deep = info["c.png"]
    assert (deep["bit_depth"], deep["channels"], deep["has_alpha"], deep["decoded_bytes"]) == (16, 4, True, 9 * 9 * 4 * 2)


def test_truncated_jpeg_only(spark, corpus):
    rows = SA.scan_assets(spark, str(corpus), content=True)
    cut = rows.where(SN.jpeg_truncated(F.col("content")))
    assert names(cut) == ["cut.jpeg"]


def test_malformed_length_stops_the_walk():
    good, bad = jpeg(), b"\xff\xd8\xff\xe0\x00\x01rest"
    assert [k for k, *_ in SG.walk(good)] == ["APP0", "SOF0", "SOS"]
    assert list(SG.walk(bad)) == [] and list(SG.walk(b"")) == [] and list(SG.walk(b"\x89PNG\r\n\x1a\n\xff")) == []


def test_svg_needs_a_root_boundary(spark):
    docs = {"<svg>": True, " <SVG/>": True, "<svgx>": False, "<html><svg>": False, "<?xml?><a/><svg a=''>": True,
            "<?xml?>" + " " * 1100 + "<svg>": False, "<svg": True, "": False}
    df = spark.createDataFrame(list(docs.items()), "doc STRING, want BOOLEAN")
    bad = df.where(SN.is_svg(F.encode("doc", "UTF-8"), window=1024) != F.col("want")).collect()
    assert bad == []
    found = {r.doc for r in df.where(SN.is_svg(F.encode("doc", "UTF-8"))).collect()}  # without a window the prolog may be long
    assert found == {d for d, want in docs.items() if want or len(d) > 1024}


def test_writing_refuses_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("a.webp", bytearray(b"1")), ("b.webp", bytearray(b"22"))], "out_name STRING, payload BINARY")
    SO.write_files(df, str(tmp_path / "loose"))
    assert (tmp_path / "loose" / "b.webp").read_bytes() == b"22"
    with pytest.raises(Exception, match="FileExistsError"):
        SO.write_files(df, str(tmp_path / "loose"))
    SO.write_files(df, str(tmp_path / "loose"), overwrite=True)
    SO.write_outputs(df, str(tmp_path / "table"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        SO.write_outputs(df, str(tmp_path / "table"))


def test_parent_reference_inside_root(spark):
    df = spark.createDataFrame([("r/a/../b",), ("r/../x",), ("rr/a",), ("r",), ("./r//c",)], "path STRING")
    assert sorted(r.path for r in SA.contained_in(df, "./r").collect()) == ["./r//c", "r", "r/a/../b"]
