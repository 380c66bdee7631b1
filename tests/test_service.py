"""Cache, journal, settings, streams, output and the facade."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import api, output
from graphloom.operators import incremental
from graphloom.sources import config, journal, scan
from graphloom.streaming import events as stream


def test_cache():
    now = [1000]
    cache = incremental.ResultCache(500, clock=lambda: now[0])
    assert cache.get("search", {"q": 1}) is None
    cache.set("search", {"q": 1, "a": [2, {"z": 1, "b": 2}]}, {"r": 1})
    assert cache.get("search", {"a": [2, {"b": 2, "z": 1}], "q": 1}) == {"r": 1}
    assert cache.listing()[0][1] == 1
    now[0] = 1500
    assert cache.get("search", {"q": 1, "a": [2, {"z": 1, "b": 2}]}) is None and cache.stats() == {"total": 1, "active": 0, "expired": 1}
    assert cache.purge() == 1
    cache.set("read", {}, {"file": "src/a.py"}, ttl_ms=0)
    assert cache.get("read", {}) is None and cache.invalidate_file("src/a.py") == 1 and not cache.invalidate("read", {})
    assert incremental.cache_key("m", {"b": [1, {"d": None}], "a": "x"}) == 'm:{a="x",b=[1,{d=null}]}'


def test_journal(spark, tmp_path):
    j = journal.Journal(str(tmp_path / "log" / "j.jsonl"), rotate_bytes=600)
    j.append("a.py", "Enqueue", file_hash="1")
    j.append("b.py", "Enqueue", file_hash="2")
    j.append("c.py", "Enqueue")
    j.append("a.py", "Commit", "Committed")
    with j.path.open("a") as f:
        f.write("broken\n{}\n")
    assert [e["seq"] for e in j.entries()] == [1, 2, 3, 4] and len(j.pending()) == 3
    assert journal.Journal(str(j.path)).seq == 4
    disk = spark.createDataFrame([("a.py", "1"), ("b.py", "9")], "path string, hash string")
    got = {r.path: r.action for r in incremental.recover(journal.read_journal(spark, str(j.path)), disk).collect()}
    assert got == {"a.py": "skip_same", "b.py": "reindex", "c.py": "skip_missing"}
    for _ in range(3):
        j.append("d.py", "Enqueue")
    assert list(j.path.parent.glob("*.archive"))
    j.truncate()
    assert j.size() == 0 and j.entries() == []


def test_config(tmp_path):
    assert config.Config.load(str(tmp_path / "none.toml")) == config.Config()
    (tmp_path / "c.toml").write_text('languages = ["python"]\n[watch]\ndebounce_ms = 50\nunknown = 1\n[spark]\nmax_workers = 9\n')
    c = config.Config.load(str(tmp_path / "c.toml"))
    assert (c.languages, c.debounce_ms, c.max_batch, c.spark_conf()["spark.sql.shuffle.partitions"]) == (["python"], 50, 50, "9")


def event_rows(spark):
    rows = [("a.py", 0.0, "modify_data"), ("a.py", 0.1, "modify_name"), ("a.py", 0.25, "remove"), ("a.py", 5.0, "create"), ("b.py", 1.0, "access"), ("c.log", 1.0, "create"), ("target/d.py", 1.0, "create"), ("e.js", 2.0, "create")]
    return spark.createDataFrame(rows, "path string, s double, event_type string").select("path", F.timestamp_millis((F.col("s") * 1000).cast("long") + 1_700_000_000_000).alias("ts"), "event_type")


def test_debounce(spark):
    got = stream.debounced(stream.relevant(event_rows(spark)), "200 milliseconds")
    assert sorted((r.path, r.n, r.last_type) for r in got.collect()) == [("a.py", 1, "Created"), ("a.py", 3, "Removed"), ("e.js", 1, "Created")]
    disk = spark.createDataFrame([("a.py",)], "path string")
    assert {(r.path, r.action) for r in stream.actions(stream.relevant(event_rows(spark)), disk).collect()} == {("a.py", "index"), ("e.js", "skip")}


def test_batches_lose_nothing(spark):
    released = spark.range(120).select(F.concat(F.lit("f"), F.col("id")).alias("path"), F.timestamp_seconds(F.lit(90)).alias("released"))
    rows = stream.batches(released, 60, 50).collect()
    assert len(rows) == 120 and sorted({r.batch for r in rows}) == [0, 1, 2] and sum(r.batch == 2 for r in rows) == 20


def test_toon():
    assert output.to_toon({"rows": [{"a": 1, "b": "x, y"}, {"a": None, "b": True}], "n": []}) == 'rows[2]{a,b}:\n  1,"x, y"\n  null,true\nn[0]:'
    assert json.loads(output.to_json({"a": 1})) == {"a": 1}


def test_grep(spark):
    files = spark.createDataFrame([(f"f{i}.py", "one\ntwo\nneedle here\nfour\nfive\nsix needle") for i in range(5)] + [("g.py", "nothing")], "path string, text string")
    rows = scan.grep(files, "needle").collect()
    assert [(r.path, r.line, r.text) for r in rows] == [(f"f{i}.py", 3, "needle here") for i in range(3)]
    assert rows[0].context == "one\ntwo\nneedle here\nfour\nfive" and rows[0].tokens == len(rows[0].context) // 4
    words = spark.createDataFrame([("needle",), ("six",), ("absent",)], "word string")
    assert {(r.word, r.path, r.line) for r in scan.grep_batch(files, words, 1).collect()} == {("needle", "f0.py", 3), ("six", "f0.py", 6)}


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "app.py").write_text('import db\n\ndef load(path):\n    """Load it."""\n    if path:\n        db.save(path)\n    return parse(path)\n\ndef parse(x):\n    return x\n\ndef main():\n    load("app.load")\n')
    (root / "test_app.py").write_text("def test_load():\n    load(1)\n")
    (root / "web.js").write_text("function load(url) { return fetch(url); }\n")
    g = api.CodeGraph.index(spark, str(root))
    at = str(tmp_path_factory.mktemp("index"))
    g.save(at)
    return api.CodeGraph.load(spark, at), str(root)


def test_facade(code):
    g, root = code
    row = g.stats().first()
    assert row.files == 3 and row.symbols == 6
    assert {r.symbol_name for r in g.rank(max_iter=5).collect()} >= {"load", "parse"}
    assert g.search("load").first().name == "load"
    assert {r.name for r in g.impact("parse").collect()} == {"load"}
    read = g.read("app.load").first().compressed
    assert read.signature == "def load(path):" and read.critical_branches == ["if path:"] and read.return_statement == "return parse(path)"
    assert {r.name for r in g.cross_language().collect()} == {"load"}
    assert {r.string_value for r in g.string_refs("load").collect()} == {"app.load"}
    assert {r.status for r in g.verify(root).collect()} == {"clean"}
    dot = g.dot("parse").first().dot
    assert dot.startswith("digraph") and '"load" -> "parse" [label="call", color=green];' in dot
    assert g.dot().count() == 6 + 2
    first = g.add_override("main", "parse")
    assert g.overrides.count() == 1
    g.remove_override(first)
    assert g.overrides.count() == 0


def test_many_searches_at_once(spark, code, tmp_path):
    g, _ = code
    found = g.search_many(spark.createDataFrame([(1, "laod"), (2, "pasre"), (3, "zzz")], "qid int, query string"))
    assert {(r.qid, r.name) for r in found.where("place = 1").collect()} == {(1, "load"), (2, "parse")}
    g.index_text(str(tmp_path / "grams"))
    held = g.find(str(tmp_path / "grams"), spark.createDataFrame([(1, "db.save"), (2, "LOAD("), (3, "nowhere")], "nid int, needle string"), fold=True)
    assert {(r.nid, r.key) for r in held.collect()} == {(1, "app.py"), (2, "app.py"), (2, "test_app.py"), (2, "web.js")}


def test_service(code):
    g, _ = code
    ask = lambda method, **params: g.serve({"id": 1, "method": method, "params": params})
    assert ask("ping")["result"] == {} and len(ask("tools/list")["result"]["tools"]) == 11 and "tools" in ask("initialize")["result"]["capabilities"]
    found = ask("neighbors", symbol="parse")["result"]["content"]
    assert found["count"] == 1 and found == ask("neighbors", symbol="parse")["result"]["content"]
    small = ask("tools/call", name="search", arguments={"query": "load", "token_budget": 20})["result"]["content"]
    assert small["truncated"] and small["budget_requested"] == 20
    assert ask("tools/call", name="stats", arguments={"preferredFormat": "toon"})["result"]["content"].startswith("results[1]{files,symbols,refs}:")
    assert ask("impact_deep", symbol="parse")["result"]["content"]["layers"][0]["symbols"] == ["load"]
    assert ask("nonsense")["error"]["code"] == -32601 and ask("any.space.stats")["result"]["content"]["count"] == 1
    assert g.serve({"method": "notifications/initialized"}) is None
    shape = {t["name"]: t["inputSchema"] for t in ask("tools/list")["result"]["tools"]}["search"]
    assert shape["required"] == ["query"] and shape["properties"]["limit"] == {"type": "integer"} and shape["properties"]["language"] == {"type": "string"}
    ask("initialize", capabilities={"preferredFormat": "toon"})
    assert isinstance(ask("stats")["result"]["content"], str)
    ask("initialize", capabilities={"preferredFormat": "json"})


def test_http(code):
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from graphloom.server import server

    held = server(code[0])
    threading.Thread(target=held.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{held.server_address[1]}"

    def ask(path, body=None):
        try:
            with urlopen(Request(at + path, body), timeout=120) as r:
                return r.status, r.read().decode()
        except HTTPError as e:
            return e.code, e.read().decode()

    try:
        assert ask("/health") == (200, "OK")
        assert json.loads(ask("/stats")[1])["files"] == 3
        found = json.loads(ask("/search?q=load&limit=1&language=javascript")[1])
        assert (found["count"], found["mode"], found["results"][0]["file_path"]) == (1, "fuzzy", "web.js")
        assert json.loads(ask("/search?q=load&use_like=true")[1])["mode"] == "like"
        assert json.loads(ask("/neighbors?symbol=parse")[1])["neighbors"][0]["caller_symbol"] == "load"
        assert [ask(p)[0] for p in ("/neighbors", "/search", "/search?q=a&limit=x", "/none")] == [400, 400, 400, 404]
        rpc = lambda body: json.loads(ask("/jsonrpc", body)[1])
        assert rpc(b'{"id": 7, "method": "stats"}')["id"] == 7 and rpc(b"{")["error"]["code"] == -32700 and rpc(b"[]")["error"]["code"] == -32600
        assert ask("/other", b"{}")[0] == 404
    finally:
        held.shutdown()
        held.server_close()


def test_index_life_cycle(spark, tmp_path):
    from graphloom.sources import store

    root, at = tmp_path / "tree", str(tmp_path / "index")
    root.mkdir()
    (root / "a.py").write_text("def first():\n    second()\n")
    with pytest.raises(FileNotFoundError):
        api.CodeGraph.load(spark, at)
    g = api.CodeGraph.index(spark, str(root))
    g.save(at)
    g.rank(max_iter=3)
    g.add_override("first", "second")
    g.save(at, "ranks", "overrides")
    before = store.manifest(spark, at)
    for i in range(3):
        (root / f"b{i}.py").write_text(f"def fresh{i}():\n    pass\n")
        (root / "a.py").unlink(missing_ok=True)
        g.reindex(str(root))
        g.save(at)
    held = api.CodeGraph.load(spark, at)
    assert {r.name for r in held.symbols.collect()} == {"fresh0", "fresh1", "fresh2"} and held.refs.count() == 0
    assert held.overrides.count() == 1 and {r.symbol_name for r in held.ranks.collect()} == {"first"}
    assert {r.status for r in held.verify(str(root)).collect()} == {"clean"}
    kept = {p.name for p in (tmp_path / "index").iterdir() if not p.name.startswith(".")}
    assert len([n for n in kept if n.startswith("manifest")]) == 2 and not {f.split('/')[0] for f in store.folders(before)} & kept
    assert len(g.symbols._jdf.queryExecution().toString()) < 20000


def test_command_line(spark, code, tmp_path, capsys):
    from graphloom import cli

    _, root = code
    at = str(tmp_path / "index")
    run = lambda *a: (cli.main(["--index", at, *a], spark), capsys.readouterr().out)
    code_, said = run("init", root)
    assert code_ == 0 and json.loads(said)["results"][0]["files"] == 3
    assert json.loads(run("search", "load", "--limit", "2")[1])["count"] == 2
    assert json.loads(run("neighbors", "parse")[1])["results"][0]["caller_symbol"] == "load"
    assert "digraph" in run("graph", "parse")[1] and "digraph" in run("graph")[1]
    assert len(json.loads(run("rank")[1])["results"]) >= 4
    assert run("--format", "text", "stats")[1].split() == ["3", "6", "5"] or run("--format", "text", "stats")[1].split()[0] == "3"
    assert json.loads(run("search", "load", "--limit", "1")[1])["results"][0]["page_rank"] > 0  # ranks outlive the process that made them
    (tmp_path / "copy").mkdir()
    (tmp_path / "copy" / "app.py").write_text("def fresh():\n    pass\n")
    assert json.loads(run("reindex", str(tmp_path / "copy"))[1])["results"][0]["files"] == 1
    assert json.loads(run("search", "fresh")[1])["count"] == 1 and json.loads(run("search", "load")[1])["count"] == 0
    assert json.loads(run("override", "add", "a", "b", "--reason", "seen")[1]) == {"id": 1} and json.loads(run("override", "add", "c", "d")[1]) == {"id": 2}
    assert [r["id"] for r in json.loads(run("override", "list")[1])["results"]] == [1, 2]
    assert json.loads(run("override", "remove", "1")[1]) == {"removed": 1} and json.loads(run("override", "for-symbol", "a")[1])["results"] == []
    assert [r["callee_symbol"] for r in json.loads(run("override", "for-symbol", "c")[1])["results"]] == ["d"]
    with pytest.raises(SystemExit):
        cli.main(["--index", at, "override", "add", "a"], spark)
    with pytest.raises(SystemExit):
        cli.main(["unknown"], spark)


def test_commits(spark, tmp_path):
    import subprocess

    from graphloom.sources.commits import last_commits

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.com", *a], check=True, capture_output=True)
    assert last_commits(spark, str(tmp_path / "none")).count() == 0
    git("init", "-q")
    for i, name in enumerate(("a.py", "b.py", "a.py")):
        (tmp_path / name).write_text(str(i))
        git("add", ".")
        git("commit", "-qm", f"Change {i}")
    assert {(r.path, r.message) for r in last_commits(spark, str(tmp_path)).collect()} == {("a.py", "Change 2"), ("b.py", "Change 1")}
