"""The command line: ``python -m graphloom.cli COMMAND``; answers go to standard output as json, toon or text."""

from __future__ import annotations

import argparse
import json
import sys

from graphloom import output
from graphloom.functions.language import parse_language

COMMANDS = {
    "init": ["path"],
    "reindex": ["path"],
    "stats": [],
    "search": ["query"],
    "neighbors": ["symbol"],
    "impact": ["symbol"],
    "impact-deep": ["symbol"],
    "graph": ["symbol?"],
    "rank": [],
    "read": ["symbol"],
    "verify": ["root"],
    "dead-code-verify": ["symbol"],
    "cross-module-move": ["symbol", "module"],
    "signature-migration-check": ["symbol", "new_signature"],
    "daemon": ["path", "events?"],
    "override": ["action", "first?", "second?"],
    "serve": [],
    "serve-http": [],
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    top.add_argument("--index", default="graphloom-index", help="folder of the index tables")
    top.add_argument("--format", choices=("json", "toon", "text"), default="json")
    top.add_argument("--token-budget", type=int)
    commands = top.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        sub = commands.add_parser(name)
        for a in args:
            sub.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None)
        if name == "init":
            sub.add_argument("--language", default="auto", type=parse_language)
        if name == "search":
            sub.add_argument("--kind")
            sub.add_argument("--limit", type=int, default=20)
            sub.add_argument("--use-like", action="store_true")
        if name == "impact-deep":
            sub.add_argument("--depth", type=int, default=3)
            sub.add_argument("--include-tests", action="store_true")
        if name == "override":
            sub.add_argument("--kind", default="override")
            sub.add_argument("--confidence", type=float, default=0.9)
            sub.add_argument("--reason")
        if name == "serve-http":
            sub.add_argument("--host", default="127.0.0.1")
            sub.add_argument("--port", type=int, default=8080)
        if name == "read":
            sub.add_argument("--level", default="critical_branches")
    return top


def shown(value, form: str) -> str:
    if form == "toon":
        return output.to_toon(value)
    if form == "text" and isinstance(value, dict) and "results" in value:
        return "\n".join("\t".join(str(v) for v in r.values()) for r in value["results"])
    return output.to_json(value)


def override(g, index: str, action: str, first: str | None, second: str | None, kind: str, confidence: float, reason: str | None) -> dict:
    """add CALLER CALLEE, remove ID, list, for-symbol SYMBOL; changes are saved."""
    from graphloom.operators.relational import overrides_of

    wanted = {"add": 2, "remove": 1, "list": 0, "for-symbol": 1}
    if action not in wanted or sum(x is not None for x in (first, second)) != wanted[action]:
        raise SystemExit("override: add CALLER CALLEE | remove ID | list | for-symbol SYMBOL")
    if action == "add":
        added = g.add_override(first, second, confidence, reason, kind)
        g.save(index, "overrides")
        return {"id": added}
    if action == "remove":
        g.remove_override(int(first))
        g.save(index, "overrides")
        return {"removed": int(first)}
    rows = g.overrides.orderBy("id") if action == "list" else overrides_of(g.overrides, first)
    return {"results": [r.asDict() for r in rows.collect()]}


def main(argv: list[str] | None = None, spark=None) -> int:
    args = vars(parser().parse_args(argv))
    command, index, form, most = args.pop("command"), args.pop("index"), args.pop("format"), args.pop("token_budget")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from graphloom.api import CodeGraph
    from graphloom.sources import scan
    from graphloom.sources.extract import registry

    if command == "init":
        only = (args["language"],) if args["language"] else None
        g = CodeGraph(spark, registry.index(scan.scan(spark, args["path"], only)))
        g.save(index)
        print(shown(g.call("stats"), form))
        return 0
    g = CodeGraph.load(spark, index)
    if command == "reindex":
        g.update(index, args["path"])
        print(shown(g.call("stats"), form))
    elif command == "override":
        print(shown(override(g, index, **args), form))
    elif command == "rank":
        g.rank()
        g.save(index, "ranks")
        print(shown({"results": [r.asDict() for r in g.call_ranks()]}, form))
    elif command == "graph":
        for row in g.dot(args["symbol"]).toLocalIterator():
            print(row[-1])
    elif command == "daemon":
        from graphloom.streaming.events import Watcher

        # without a folder of events the tree is listed again and again, and compared with the listing before
        source = args["events"] or scan.changes(spark, args["path"], index + ".listings")
        Watcher(spark, source, index + ".events", lambda paths: g.update(index, args["path"], paths)).start().awaitTermination()
    elif command == "serve":
        for line in sys.stdin:
            answer = g.serve(json.loads(line)) if line.strip() else None
            if answer is not None:
                print(json.dumps(answer, ensure_ascii=False, default=str), flush=True)
    elif command == "serve-http":
        from graphloom.server import server

        server(g, args["host"], args["port"]).serve_forever()
    else:
        print(shown(g.call(command.replace("-", "_"), {k: v for k, v in args.items() if v is not None}, most), form))
    return 0


if __name__ == "__main__":
    sys.exit(main())
