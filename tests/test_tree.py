"""Source trees: names, bytes, links, errors, partitions; changes over restarts."""

import os
import random

import pytest

from graphloom.sources import scan, tree


def put(root, path, data=b"x = 1\n"):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(data)


def test_odd_names_and_bytes(spark, tmp_path):
    names = ["pages/[id].tsx", "b{1}.py", "c*?.py", "with space/d%20e.py", "_private/e.py", ".hidden/f.py", "q\\x.py", "ünder/日本.py", "a#b.py", "c:d.py"]
    for n in names:
        put(tmp_path, n, f"# {n}\n".encode())
    put(tmp_path, "latin.py", "s = 'é'\n".encode("latin-1"))
    put(tmp_path, "node_modules/x.js")
    put(tmp_path, "notes.xyz")
    os.symlink("gone.py", tmp_path / "broken.py")
    with open(os.path.join(os.fsencode(tmp_path), b"n\xff.py"), "wb") as f:
        f.write(b"y\n")
    rows = {r.path: r.text for r in scan.scan(spark, str(tmp_path)).collect()}
    assert rows == {n: f"# {n}\n" for n in names} | {"latin.py": "s = '�'\n", "n�.py": "y\n"}
    assert [(r.path, r.error.split(":")[0]) for r in scan.failed(spark, str(tmp_path)).collect()] == [("broken.py", "FileNotFoundError")]
    assert {r.path for r in scan.scan(spark, "file://" + str(tmp_path), ("typescript",)).collect()} == {"pages/[id].tsx"}


def test_files_written_are_read_back(spark, tmp_path):
    rows = [(f"d{i % 3}/[f{i}].py", f"text {i} é".encode() if i % 2 else b"\xff") for i in range(50)]
    assert scan.write_files(spark.createDataFrame(rows, "path string, content binary").repartition(4), str(tmp_path / "out")) == 50
    assert {r.path: r.text for r in scan.scan(spark, str(tmp_path / "out")).collect()} == {p: c.decode("utf-8", "replace") for p, c in rows}
    with pytest.raises(Exception, match="outside"):
        scan.write_files(spark.createDataFrame([("../x.py", b"")], "path string, content binary"), str(tmp_path / "out"))


def test_a_bad_file_is_a_row(spark, tmp_path):
    put(tmp_path, "good.py")
    put(tmp_path, "large.py", b"x" * 100)
    tree.register(spark)
    held = spark.read.format("source_tree").option("largest", 50).load(str(tmp_path))
    assert {(r.path, r.text, r.error is None) for r in held.collect()} == {("good.py", "x = 1\n", True), ("large.py", None, False)}


def test_links(spark, tmp_path):
    put(tmp_path, "a/one.py")
    put(tmp_path, "b/two.py")
    os.symlink("..", tmp_path / "a" / "up")  # encloses itself
    os.symlink("../b", tmp_path / "a" / "other")
    os.symlink("../a", tmp_path / "b" / "back")
    os.symlink("a/one.py", tmp_path / "same.py")
    assert sorted(r.path for r in scan.scan(spark, str(tmp_path)).collect()) == ["a/one.py", "a/other/two.py", "b/back/one.py", "b/two.py", "same.py"]


@pytest.mark.parametrize(("partitions", "per_part"), [(1, 3), (5, 2), (200, 1)])
def test_partitions_cover_each_file_once(tmp_path, partitions, per_part):
    rng = random.Random(3)
    want = set()
    for i in range(120):
        path = "/".join(f"d{rng.randrange(4)}" for _ in range(rng.randrange(4))) + f"/f{i}.py"
        put(tmp_path, path.lstrip("/"))
        want.add(path.lstrip("/"))
    for i in range(30):
        put(tmp_path, f"wide/s{i}/g.py")
        want.add(f"wide/s{i}/g.py")
    options = {"path": str(tmp_path), "partitions": str(partitions), "filespartition": str(per_part)}
    reader = tree.TreeReader(options)
    parts = reader.partitions()
    got = [r["path"] for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == sorted(want) and len(parts) >= min(partitions, 40)
    assert all(len(p.folder) < 40 and not p.folder.endswith(".py") for p in parts)  # folders alone


def test_empty_and_missing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert scan.scan(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="No such file|FileNotFound"):
        scan.scan(spark, str(tmp_path / "missing")).count()


def test_changes_arrive_once_over_restarts(spark, tmp_path):
    root, at = tmp_path / "root", tmp_path / "state"
    for i in range(20):
        put(root, f"p{i % 3}/f{i}.py")
    put(root, "dist/skipped.py")

    def run(fail=False):
        got = []

        def take(df, _epoch):
            got.extend((r.path, r.event_type) for r in df.collect())
            if fail:
                raise RuntimeError("on purpose")

        q = scan.changes(spark, str(root), str(at / "listings"), buckets=4).writeStream.foreachBatch(take).option("checkpointLocation", str(at / "query")).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            assert fail
        return sorted(got)

    assert run() == sorted((f"p{i % 3}/f{i}.py", "create") for i in range(20))
    assert run() == []
    put(root, "p0/f0.py", b"longer than before\n")
    put(root, "new/[x].py")
    (root / "p1/f1.py").unlink()
    want = sorted([("p0/f0.py", "modify_data"), ("new/[x].py", "create"), ("p1/f1.py", "remove")])
    assert run(fail=True) == want
    (root / "p2/f2.py").unlink()  # after the listing of the batch that failed
    assert sorted(run() + run()) == sorted([*want, ("p2/f2.py", "remove")]) and run() == []  # the batch that failed is the same again
    names = [n for n in os.listdir(at / "listings") if n.isdigit()]
    assert len(names) <= 2


def test_changes_equal_the_full_comparison(tmp_path):
    rng = random.Random(9)
    root = tmp_path / "root"
    root.mkdir()
    reader = tree.TreeChanges({"path": str(root), "listings": str(tmp_path / "l"), "buckets": "3"})
    held, at = {}, reader.initialOffset()
    for turn in range(6):
        for _ in range(rng.randrange(0, 15)):
            name = f"d{rng.randrange(3)}/f{rng.randrange(12)}.py"
            if name in held and rng.random() < 0.4:
                (root / name).unlink()
                del held[name]
            else:
                held[name] = f"{turn} " * rng.randrange(1, 50)
                put(root, name, held[name].encode())
                os.utime(root / name, ns=(0, turn * 10**9 + rng.randrange(10**6) * 1000))
        end = reader.latestOffset()
        assert reader.latestOffset() == end
        was = {p: x for k in range(3) for p, x in reader._bucket(at["listing"], k).items()}
        now = {p: x for k in range(3) for p, x in reader._bucket(end["listing"], k).items()}
        assert set(now) == set(held)
        got = {(r["path"], r["event_type"]) for p in reader.partitions(at, end) for b in reader.read(p) for r in b.to_pylist()}
        want = {(p, "create") for p in now.keys() - was.keys()} | {(p, "remove") for p in was.keys() - now.keys()} | {(p, "modify_data") for p in now.keys() & was.keys() if was[p] != now[p]}
        assert got == want
        reader.commit(end)
        at = end
