import os

import pytest

from siftline.functions.fixed_values import TREE_DEPTH
from siftline.sources import tree


def made(tmp_path, files):
    for path, body in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(tmp_path)


def test_listing_by_levels(spark, tmp_path):
    root = made(tmp_path, {p: "x" for p in ("a.js", ".env", "d/b.js", "d/e/f/g.js", "node_modules/x.js", ".cache/y", ".git/z", "d/.hid/q", "w/.git", "d/node_modules/r")})
    assert sorted(r.path for r in tree.listing(spark, root).collect()) == [".env", "a.js", "d/b.js", "d/e/f/g.js"]
    assert sorted(r.path for r in tree.listing(spark, root, "d").collect()) == ["d/b.js", "d/e/f/g.js"]
    assert [r.path for r in tree.listing(spark, root, ".cache").collect()] == [".cache/y"]
    assert [(r.path, r.size) for r in tree.listing(spark, root, "d/.hid/q").collect()] == [("d/.hid/q", 1)]
    assert tree.listing(spark, root, "nowhere").collect() == []


def test_wide_and_deep(spark, tmp_path):
    files = {f"d{i % 7}/s{i % 40}/f{i}.txt": str(i) for i in range(900)} | {"/".join(["x"] * (TREE_DEPTH + k)) + "/end.txt": "" for k in (0, 1)}
    root = made(tmp_path, files)
    got = {r.path for r in tree.listing(spark, root).collect()}
    assert got == {p for p in files if p.count("/") <= TREE_DEPTH}


def test_links(spark, tmp_path):
    root = made(tmp_path, {"real/a.txt": "x", "b.txt": "y"})
    os.symlink(tmp_path / "real", tmp_path / "link")
    os.symlink(tmp_path, tmp_path / "real" / "loop")
    os.symlink(tmp_path / "b.txt", tmp_path / "c.txt")
    os.symlink(tmp_path / "nothing", tmp_path / "broken")
    assert sorted(r.path for r in tree.listing(spark, root).collect()) == ["b.txt", "real/a.txt"]
    assert sorted(r.path for r in tree.listing(spark, root, follow=True).collect()) == ["b.txt", "c.txt", "link/a.txt"]


def read(body, most):
    """The same decisions for one file's bytes, plainly."""
    if b"\0" in body[:8192]:
        return "binary", None, None, False
    cut = body[:most]
    if len(body) > most:
        cut = cut[: cut.rfind(b"\n") + 1] or cut
    text = cut.decode(errors="replace").removeprefix("﻿")
    if not text.strip():
        return "empty", None, None, False
    return "text", text, len(cut), len(body) > most


BODIES = [b"", b" \n\t\n", b"one\n", b"one\ntwo\nthree", b"x" * 40, b"ab\0c", b"a" * 9000 + b"\0", b"\xef\xbb\xbfmark\nmore text here\n", b"\xff\xfe bad\nbytes here", "é\nüüüüüüüüüüü\n".encode(), b"0123456789\n", b"01234567890\n", b"012345678901\n34", b"\n" * 30 + b"end"]


@pytest.mark.parametrize("most", [11, 12, 30, 4 << 20])
def test_bounded_reads(spark, tmp_path, most):
    root = made(tmp_path, {f"f{i:02}": b for i, b in enumerate(BODIES)})
    listed = tree.listing(spark, root).unionByName(spark.createDataFrame([("gone", 5, None)], tree.LISTED))
    rows = {r.path: (r.status, r.text, r.bytes, r.truncated) for r in tree.reads(listed, root, most).collect()}
    assert rows.pop("gone") == ("io", None, None, False)
    assert rows == {f"f{i:02}": read(b, most) for i, b in enumerate(BODIES)}


def test_large_file_is_cut_not_left_out(spark, tmp_path):
    root = made(tmp_path, {"big": b"line of text\n" * 400_000, "small": "x\n"})
    rows = {r.path: r for r in tree.reads(tree.listing(spark, root), root).collect()}
    assert rows["big"].truncated and rows["big"].bytes == (4 << 20) // 13 * 13 and not rows["small"].truncated
