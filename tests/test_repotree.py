"""Files of a tree, hidden ones too, and the engine on them."""


def test_tree(spark, tmp_path):
    from rulespan.sources.repotree import register

    for p, t in {"a/.github/workflows/ci.yml": b"x\r\ny", "a/.env.local": b"", "a/src/_under.py": b"x = 1", "a/bad.bin": b"\xff\xfe", "a/node_modules/m.js": b"", "b/README.md": "é".encode()}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(t)
    register(spark)
    rows = {(r["repo"], r["path"]): r for r in spark.read.format("repotree").load(f"file://{tmp_path}").collect()}
    assert {p for r, p in rows if not rows[r, p]["is_dir"]} == {".github/workflows/ci.yml", ".env.local", "src/_under.py", "bad.bin", "README.md"}
    assert rows["a", ".github/workflows/ci.yml"]["content"] == "x\ny" and rows["b", "README.md"]["content"] == "é"
    assert not rows["a", "bad.bin"]["decode_ok"] and rows["a", "src"]["is_dir"]
