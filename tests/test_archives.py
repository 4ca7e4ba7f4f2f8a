"""Archives as a source: all members, filters that reach the reader, damaged ones, and a round trip."""

import io
import tarfile
import zipfile

from pyspark.sql import functions as F

from rulespan.sources import archives

TREE = {"top/README.md": b"a\r\nb", "top/src/a.py": b"x = 1", "top/src/b.py": b"y", "top/.env.local": b"", "top/bad.bin": b"\xff\xfe", "top/node_modules/m.js": b"n"}


def zipped(path, tree):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("top/src/", b"")
        for n, t in tree.items():
            z.writestr(n, t)


def tarred(path, tree, mode):
    with tarfile.open(path, mode) as t:
        for n, data in tree.items():
            i = tarfile.TarInfo(n)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))


def folder(tmp_path):
    zipped(tmp_path / "a.zip", TREE)
    tarred(tmp_path / "b.tar", TREE, "w")
    tarred(tmp_path / "c.tar.gz", TREE, "w:gz")
    zipped(tmp_path / "none.zip", {})
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / "note.txt").write_text("x")
    return f"file://{tmp_path}"


def test_members(spark, tmp_path):
    at = folder(tmp_path)
    archives.register(spark)
    rows = spark.read.format("repoarchive").load(at).collect()
    files = {(r["repo"], r["path"]): r for r in rows if not r["is_dir"]}
    paths = {"README.md", "src/a.py", "src/b.py", ".env.local", "bad.bin"}
    for repo in "abc":
        assert {p for r, p in files if r == repo} == paths
        assert files[repo, "README.md"]["content"] == "a\nb" and files[repo, "src/a.py"]["ext"] == "py"
        assert files[repo, "bad.bin"]["content"] is None and not files[repo, "bad.bin"]["decode_ok"]
    assert [(r["repo"], r["path"]) for r in rows if r["is_dir"]] == [("a", "src"), ("none", "src")]
    assert ("broken", None) in files and len(rows) == 18
    big = spark.read.format("repoarchive").option("largest", "1").option("strip", "0").option("skip", "").load(at).filter("repo = 'a' AND size > 1")
    assert {(r["path"], r["content"]) for r in big.collect()} == {(p, None) for p, t in TREE.items() if len(t) > 1}


def test_paths_and_filters(spark, tmp_path):
    """Patterns reach the reader; filters of several queries on one DataFrame do not meet each other."""
    at = folder(tmp_path)
    archives.register(spark)
    df = spark.read.format("repoarchive").load(at)
    every = [(r["repo"], r["path"]) for r in df.collect()]
    for test, holds in (("path = 'src/a.py'", lambda p: p == "src/a.py"), ("path LIKE '%.py' AND size < 2", lambda p: p == "src/b.py"), ("path IS NULL", lambda p: p is None)):
        assert sorted((r["repo"], r["path"] or "") for r in df.filter(test).collect()) == sorted((a, p or "") for a, p in every if holds(p))
    some = spark.read.format("repoarchive").option("members", "src/*.py\nREADME.md").load(at)
    assert sorted((r["repo"], r["path"]) for r in some.collect()) == sorted((a, p) for a, p in every if p in ("src/a.py", "src/b.py", "README.md"))


def test_a_path_inflates_one_member(tmp_path, monkeypatch):
    at = folder(tmp_path)
    read = []
    plain = zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, i: read.append(i.filename) or plain(self, i))
    reader = archives.ArchiveReader({"path": at, "members": "src/a.py"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert read == ["top/src/a.py"] and {(r[0], r[1], r[6]) for r in rows} == {(x, "src/a.py", "x = 1") for x in "abc"}


def test_round_trip(spark, tmp_path):
    rows = [(f"r{i % 5}", f"d/{i}.txt", "é" * i if i % 7 else None) for i in range(60)]
    rows += [("r1", "d/1.txt", "again"), ("long", "x", "line\n" * 200_000), (None, "p", "x"), ("r1", None, "x")]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    told = archives.write_archives(files, f"file://{tmp_path}")
    kept = [r for r in rows if r[0] and r[1]]
    assert {(r["repo"], r["members"], r["bytes"]) for r in told.collect()} == {(n, sum(r[0] == n for r in kept), sum(len((r[2] or "").encode()) for r in kept if r[0] == n)) for n in ("r0", "r1", "r2", "r3", "r4", "long")}
    archives.register(spark)
    back = spark.read.format("repoarchive").load(f"file://{tmp_path}")
    assert sorted((r["repo"], r["path"], r["content"]) for r in back.collect()) == sorted((a, b, c or "") for a, b, c in kept)
    none = tmp_path / "none"
    none.mkdir()
    assert archives.write_archives(files.limit(0), f"file://{none}").count() == 0
    assert spark.read.format("repoarchive").load(f"file://{none}").select(F.count("*")).first()[0] == 0
