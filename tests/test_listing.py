"""Listings of trees with links, empty files and wide directories."""

from __future__ import annotations

import os

import pytest

from assetloom.sources import assets as SA
from assetloom.sources import listing


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for name in ("a.png", "empty.png", "_hidden.png", ".dot.png", "sub/b.jpg", "sub/deep/c.gif", "sub/deep/none.jpeg", "notes.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "empty" in name or "none" in name else name.encode())
    (tmp_path / "rootless").mkdir()
    (tmp_path / "rootless" / "x.png").write_bytes(b"outside")
    os.symlink(root / "sub/b.jpg", root / "inner.jpg")
    os.symlink(tmp_path / "rootless/x.png", root / "escapes.png")
    os.symlink(tmp_path / "rootless", root / "away")
    os.symlink(root, root / "sub/loop")
    os.symlink(root / "gone.png", root / "dangling.png")
    return root


def relative(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.select("path").collect())


def test_empty_hidden_and_linked_files(spark, tree):
    rows = SA.scan_assets(spark, str(tree))
    assert relative(rows, tree) == [".dot.png", "_hidden.png", "a.png", "empty.png", "inner.jpg"]
    facts = {r["name"]: r for r in rows.collect()}
    assert facts["empty.png"].bytes == 0 and facts["a.png"].bytes == 5
    assert facts["inner.jpg"].real_path == os.path.realpath(tree / "sub/b.jpg") and facts["inner.jpg"].linked


def test_whole_trees_follow_no_linked_directory(spark, tree):
    rows = SA.scan_assets(spark, str(tree), recursive=True)
    assert relative(rows, tree) == [".dot.png", "_hidden.png", "a.png", "empty.png", "inner.jpg", "sub/b.jpg", "sub/deep/c.gif", "sub/deep/none.jpeg"]
    assert {r.path for r in SA.resolved_in(rows, os.path.realpath(tree / "sub")).collect()} == {str(tree / x) for x in ("inner.jpg", "sub/b.jpg", "sub/deep/c.gif", "sub/deep/none.jpeg")}


def test_a_glob_is_held_to_its_literal_part(spark, tree):
    os.symlink(tree / "a.png", tree / "sub/up.png")
    assert relative(SA.scan_assets(spark, str(tree), glob="sub/*"), tree) == ["sub/b.jpg"]
    assert relative(SA.scan_assets(spark, str(tree), glob="s*/*"), tree) == ["sub/b.jpg", "sub/up.png"]
    assert relative(SA.scan_assets(spark, str(tree), glob="sub/**/*.gif"), tree) == ["sub/deep/c.gif"]
    with pytest.raises(FileNotFoundError):
        SA.scan_assets(spark, str(tree), glob="sub/*.tiff")


def test_named_files_and_missing_roots(spark, tree):
    assert relative(SA.scan_assets(spark, str(tree / "notes.txt")), tree) == ["notes.txt"]
    assert relative(SA.scan_assets(spark, f"file://{tree}/escapes.png"), tree) == ["escapes.png"]
    with pytest.raises(FileNotFoundError):
        SA.scan_assets(spark, str(tree / "gone.png"))


def test_content_is_read_only_when_asked(spark, tree):
    (tree / "locked.png").write_bytes(b"x")
    rows = SA.scan_assets(spark, str(tree), recursive=True, content=True)
    assert {r["name"]: bytes(r.content) for r in rows.collect()}["inner.jpg"] == b"sub/b.jpg"
    assert {bytes(r.content) for r in rows.where("bytes = 0").collect()} == {b""}
    bare = SA.scan_assets(spark, str(tree), recursive=True)
    (tree / "locked.png").unlink()  # gone after planning: a listing opens nothing and leaves it out
    assert "locked.png" not in relative(bare, tree)


def test_slices_share_wide_directories_and_subtrees(spark, tmp_path):
    want = set()
    for d in range(12):
        for k in range(40):
            path = tmp_path / f"d{d}" / ("e" if k % 2 else "") / f"{k}.png"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"")
            want.add(str(path))
    for k in range(300):
        (tmp_path / f"wide{k}.png").write_bytes(b"1")
        want.add(str(tmp_path / f"wide{k}.png"))
    for slices, wide in ((1, 50_000), (5, 10), (64, 3)):
        df = listing.list_tree(spark, str(tmp_path), recursive=True, slices=slices, wide=wide)
        got = [r.path for r in df.collect()]
        assert len(got) == len(want) and set(got) == want
        assert df.rdd.getNumPartitions() <= slices
    parts = listing.Listing({"path": str(tmp_path), "recursive": "true", "slices": "5", "wide": "10"}).partitions()
    assert sum(job[0] == str(tmp_path) for p in parts for job in p.jobs) == 5
