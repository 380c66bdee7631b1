"""Saved indexes: buckets, promotions, what an update reads and writes."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import api, schema
from graphloom.sources import store


def files(spark, n, mark="v1"):
    rows = [(f"d{i % 7}/f{i}.py", f"text {i} {mark}", "python", f"{mark}-{i}", i) for i in range(n)]
    return spark.createDataFrame(rows, schema.FILES)


def refs(spark, pairs):
    return spark.createDataFrame([(i, a, b, None, "f", "call", 1, 1.0, False) for i, (a, b) in enumerate(pairs)], schema.REFERENCES)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_an_update_touches_its_buckets_alone(spark, tmp_path):
    at = str(tmp_path / "index")
    was = files(spark, 300)
    store.save(spark, at, {"files": was}, buckets=16)
    before = store.manifest(spark, at)["tables"]["files"]
    assert len(before) == 16 and sum(b["rows"] for b in before.values()) == 300
    changed = spark.createDataFrame([("d1/f1.py", "new", "python", "h", 3), ("fresh.py", "new", "python", "h", 3)], schema.FILES)
    paths = changed.select("path").union(spark.createDataFrame([("d2/f2.py",)], "path string"))
    out = store.update(spark, at, paths, {"files": changed})
    after = store.manifest(spark, at)["tables"]["files"]
    hit = {k for k in after if after[k] != before.get(k)}
    assert 1 <= len(hit) <= 3 and out["files"]["buckets"] == len(hit) and out["files"]["bytes"] < sum(b["bytes"] for b in before.values()) / 3
    kept = [r for r in rows(was) if r[0] not in ("d1/f1.py", "d2/f2.py")]
    assert rows(store.load(spark, at)["files"]) == sorted(kept + rows(changed), key=repr)


def test_random_updates_equal_a_plain_table(spark, tmp_path):
    rng, at = random.Random(4), str(tmp_path / "index")
    held = {f"p{i}": f"v{i}" for i in range(40)}
    table = lambda d: spark.createDataFrame([(p, None, None, h, None) for p, h in d.items()], schema.FILES)
    store.save(spark, at, {"files": table(held)}, buckets=5)
    for turn in range(4):
        changed = {f"p{rng.randrange(60)}": f"t{turn}" for _ in range(rng.randrange(1, 9))}
        gone = {f"p{rng.randrange(60)}" for _ in range(4)} - changed.keys()
        store.update(spark, at, spark.createDataFrame([(p,) for p in [*changed, *gone, *gone]], "path string"), {"files": table(changed)})
        held = {p: h for p, h in (held | changed).items() if p not in gone}
        assert {r.path: r.hash for r in store.load(spark, at)["files"].collect()} == held
    plain = [n for n in store._names(spark, at) if n.startswith("manifest-")]
    assert len(plain) == 2
    named = set().union(*(store.folders(store.manifest(spark, at, n)) for n in plain))
    there = {f"{t}/{b}" for t in store._names(spark, at) if t.startswith("files-") for b in store._names(spark, f"{at}/{t}") if b.startswith("bucket=")}
    assert named == there


def test_both_tables_of_a_checksum_move_together(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "index")
    sums = spark.createDataFrame([("d1/f1.py", "v1-1", 4, 2, "mismatch"), ("d0/f0.py", "v1-0", 1, 0, "synced")], schema.CHECKSUMS)
    store.save(spark, at, {"files": files(spark, 3), "checksums": sums}, buckets=4)
    found = spark.createDataFrame([("d1/f1.py", "h1", 9), ("new.py", "h2", 8), ("new.py", "h1", 1)], "path string, hash string, size long")
    real = store._promote

    def fails(*_):
        raise OSError("on purpose")

    monkeypatch.setattr(store, "_promote", fails)
    with pytest.raises(OSError, match="on purpose"):
        store.upsert_checksums(spark, at, found)
    assert rows(store.load(spark, at)["files"]) == rows(files(spark, 3)) and rows(store.load(spark, at)["checksums"]) == rows(sums)
    monkeypatch.setattr(store, "_promote", real)
    store.upsert_checksums(spark, at, found)
    held = store.load(spark, at)
    assert rows(held["checksums"]) == [("d0/f0.py", "v1-0", 1, 0, "synced"), ("d1/f1.py", "h1", 4, 2, "synced"), ("new.py", "h2", 0, 0, "synced")]
    assert {(r.path, r.text, r.hash, r.size) for r in held["files"].collect()} == {("d0/f0.py", "text 0 v1", "v1-0", 0), ("d1/f1.py", "text 1 v1", "h1", 9), ("d2/f2.py", "text 2 v1", "v1-2", 2), ("new.py", None, "h2", 8)}
    assert len([n for n in store._names(spark, at) if n.startswith("manifest-")]) == 2


def test_deleted_files_take_references_of_both_sides(spark, tmp_path):
    at = str(tmp_path / "index")
    pairs = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "a"), ("e", "c")]
    store.save(spark, at, {"refs": refs(spark, pairs)}, buckets=8)
    gone = spark.createDataFrame([("a",)], "path string")
    store.update(spark, at, gone, {}, either_side=True)
    assert {(r.caller_file, r.callee_file) for r in store.load(spark, at)["refs"].collect()} == {("c", "d"), ("e", "c")}
    store.save(spark, at, {"refs": refs(spark, pairs)})
    store.update(spark, at, gone, {})  # before a re-index: by the caller's file
    assert {(r.caller_file, r.callee_file) for r in store.load(spark, at)["refs"].collect()} == {("b", "a"), ("c", "d"), ("d", "a"), ("e", "c")}


def test_empty_tables_and_odd_paths(spark, tmp_path):
    at = str(tmp_path / "index")
    odd = [(p, None, None, "h", None) for p in ("a=b/%7B[x].py", "", "ünder", "bucket=3")]
    store.save(spark, at, {"files": spark.createDataFrame(odd, schema.FILES), "symbols": spark.createDataFrame([], schema.SYMBOLS)}, buckets=3)
    assert rows(store.load(spark, at)["files"]) == sorted(odd, key=repr) and store.load(spark, at)["symbols"].count() == 0
    every = spark.createDataFrame(odd, schema.FILES)
    store.update(spark, at, every, {})
    assert store.load(spark, at)["files"].count() == 0
    store.update(spark, at, every, {"files": every})
    assert rows(store.load(spark, at)["files"]) == sorted(odd, key=repr)


def test_an_index_follows_its_files(spark, tmp_path):
    root, at = tmp_path / "tree", str(tmp_path / "index")
    (root / "pkg").mkdir(parents=True)
    for i in range(30):
        (root / "pkg" / f"m{i}.py").write_text(f"def f{i}():\n    g{i}('lit{i}')\n")
    g = api.CodeGraph.index(spark, str(root))
    g.save(at)
    assert g.update(at, str(root)) == {}
    (root / "pkg" / "m3.py").write_text("def changed():\n    pass\n")
    (root / "pkg" / "m4.py").unlink()
    (root / "pkg" / "m5.py").write_text("def later():\n    pass\n")
    before = store.manifest(spark, at)["tables"]
    batch = spark.createDataFrame([("pkg/m3.py",), ("pkg/m4.py",), ("pkg/none.py",), ("notes.xyz",)], "path string")
    out = g.update(at, str(root), batch)  # m5 isn't asked for
    after = store.manifest(spark, at)["tables"]
    assert out["symbols"]["buckets"] <= 2 and all(sum(after[t].get(k) != b for k, b in before[t].items()) <= 2 for t in ("symbols", "refs", "files", "literals"))
    names = {r.name for r in api.CodeGraph.load(spark, at).symbols.collect()}
    assert names == {f"f{i}" for i in range(30) if i not in (3, 4)} | {"changed"}
    g.update(at, str(root))
    whole = api.CodeGraph.index(spark, str(root))
    for name in ("symbols", "refs", "imports", "literals", "files"):
        assert rows(g.tables[name].select(sorted(g.tables[name].columns))) == rows(whole.tables[name].select(sorted(g.tables[name].columns))), name
    assert g.tables["checksums"].where(F.col("path") == "pkg/m5.py").first().status == "synced"


def test_a_path_of_many_rows_is_written_by_many_tasks(spark, tmp_path):
    at, conf = str(tmp_path / "index"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    many = spark.range(0, 40_000, 1, 8).selectExpr("id", "'src/main.py' as caller_file", "'' as callee_file", "cast(null as string) as caller_symbol", "sha2(cast(id as string), 256) as callee_symbol", "'call' as ref_kind", "1 as line", "1.0D as confidence", "false as is_dynamic")
    spark.conf.set(conf, "128k")
    try:
        store.save(spark, at, {"refs": many}, buckets=4)
        (entry,) = store.manifest(spark, at)["tables"]["refs"].values()
        files = [n for n in store._names(spark, f"{at}/{entry['folder']}") if n.startswith("part-")]
        assert len(files) > 4 and entry["rows"] == 40_000
        store.update(spark, at, spark.createDataFrame([("other.py",)], "path string"), {}, either_side=True)
        assert store.load(spark, at)["refs"].agg(F.count("id"), F.count_distinct("id")).first()[:] == (40_000, 40_000)
    finally:
        spark.conf.unset(conf)
