"""The folder source: empty files, closed folders, partitions by bytes."""

import os

from lodeseam.sources import corpus, files


def _tree(root):
    for name, data in {
        "empty.py": b"", "src/a.py": b"x = 1\n", "src/deep/er/b.md": b"# t\n\nx", "src/c.bin": b"\x00" * 50, "node_modules/x/y.js": b"1", "build": b"a file of that name\n",
        "big.md": b"l\n" * 500, "big.bin": b"y" * 999, "ré sumé.txt": "é\n".encode(), ".gitignore": b"", "a b/%20.txt": b"q",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink(root, root / "src" / "loop")


def test_empty_files_are_rows_and_ignored_folders_stay_closed(spark, tmp_path):
    _tree(tmp_path)
    (tmp_path / "node_modules" / "x").chmod(0)
    opened = []
    walk = files.pafs.FileSelector
    files.pafs.FileSelector = lambda path: opened.append(path) or walk(path)
    try:
        rows = sorted(files.FolderReader({"path": str(tmp_path)})._walk())
    finally:
        files.pafs.FileSelector = walk
        (tmp_path / "node_modules" / "x").chmod(0o700)
    assert sorted(os.path.relpath(p, tmp_path) for p in opened) == [".", "a b", "src", "src/deep", "src/deep/er"]
    assert [r[0] for r in rows] == sorted(["empty.py", "src/a.py", "src/deep/er/b.md", "src/c.bin", "build", "big.md", "big.bin", "ré sumé.txt", ".gitignore", "a b/%20.txt"])
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        got = {r["path"]: r for r in corpus.scan_files(spark, root, max_bytes=100).collect()}
        assert sorted(got) == [r[0] for r in rows]
        assert (got["empty.py"]["length"], got["empty.py"]["indexable"], got["empty.py"]["line_count"], got["empty.py"]["text"]) == (0, True, 0, "")
        assert got["big.bin"]["content_sha1"] is None and got["big.md"]["line_count"] == 500 and got["src/c.bin"]["file_type"] == "binary"
        assert got["build"]["ignored_reason"] == "unsupported_file_type" and got["a b/%20.txt"]["text"] == "q"
    assert {r["path"] for r in corpus.list_files(spark, str(tmp_path)).collect()} == set(got)


def test_both_routes_agree_but_for_empty_files(spark, tmp_path, monkeypatch):
    _tree(tmp_path)
    os.unlink(tmp_path / "src" / "loop")
    columns = ["path", "length", "language", "is_test", "is_binary", "indexable", "ignored_reason", "file_type", "content_sha1", "line_count", "text"]
    rows = lambda: {r["path"]: tuple(r[c] for c in columns) for r in corpus.scan_files(spark, str(tmp_path), max_bytes=100).collect()}
    new = rows()
    monkeypatch.setattr(files, "reaches", lambda root: False)
    old = rows()
    assert {k: v for k, v in new.items() if v[1]} == old and set(new) - set(old) == {"empty.py", ".gitignore"}


def test_partitions_by_bytes(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"f{k:02d}.txt").write_bytes(b"x" * (1000 if k else 500_000))
    parts = files.FolderReader({"path": str(tmp_path), "partition_bytes": str(400_000)}).partitions()
    assert [len(p.rows) for p in parts] == [1, 6, 6, 6, 6, 6, 6, 3] and sum(len(p.rows) for p in parts) == 40
    monkeypatch.setattr(files, "BATCH_BYTES", 3000)
    batches = list(files.FolderReader({"path": str(tmp_path)}).read(files.Files([r for p in parts for r in p.rows])))
    assert len(batches) == 14 and sum(b.num_rows for b in batches) == 40
    (tmp_path / "f01.txt").unlink()
    assert sum(b.num_rows for b in files.FolderReader({"path": str(tmp_path)}).read(parts[1])) == 5
    nothing = tmp_path / "nothing"
    nothing.mkdir()
    assert corpus.scan_files(spark, str(nothing)).count() == 0
