"""The service over HTTP: GET /health, /stats, /search and /neighbors, POST /jsonrpc. Plans are built and run by the session's driver."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from graphloom.functions.language import parse_language

#: Bytes that a request may hold.
MOST_BYTES = 4_000_000


def answer(graph, path: str, query: dict[str, str]) -> tuple[int, object]:
    """Status and value of a GET request."""
    if path == "/health":
        return 200, "OK"
    if path == "/stats":
        return 200, graph.call("stats")["results"][0]
    if path == "/neighbors":
        symbol = query.get("symbol", "")
        if not symbol:
            return 400, {"error": "Missing 'symbol' parameter"}
        found = graph.call("neighbors", {"symbol": symbol})
        return 200, {"symbol": symbol, "neighbors": found["results"], "count": found["count"]}
    if path == "/search":
        text = query.get("q") or query.get("query") or query.get("symbol") or ""
        if not text:
            return 400, {"error": "Missing 'q' parameter"}
        like = query.get("use_like", "").lower() in ("1", "true", "yes")
        params = {"query": text, "use_like": like}
        try:
            params |= {k: kind(query[k]) for k, kind in (("kind", str), ("limit", int), ("min_score", float), ("language", parse_language)) if k in query}
        except ValueError as e:
            return 400, {"error": str(e)}
        found = graph.call("search", params)
        return 200, {"query": text, "results": found["results"], "count": found["count"], "mode": "like" if like else "fuzzy"}
    return 404, {"error": f"no such path: {path}"}


def server(graph, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A bound server; ``serve_forever`` runs it, and port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, value) -> None:
            plain = isinstance(value, str)
            body = (value if plain else json.dumps(value, ensure_ascii=False, default=str)).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/plain; charset=utf-8" if plain else "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:  # noqa: N802
            at = urlsplit(self.path)
            try:
                self._send(*answer(graph, at.path, {k: v[-1] for k, v in parse_qs(at.query).items()}))
            except Exception as e:  # noqa: BLE001
                self._send(500, {"error": str(e)})

        def do_POST(self) -> None:  # noqa: N802
            try:
                size = int(self.headers.get("Content-Length") or 0)
            except ValueError:
                return self._send(400, {"error": "bad Content-Length"})
            if urlsplit(self.path).path != "/jsonrpc":
                return self._send(404, {"error": f"no such path: {self.path}"})
            if not 0 <= size <= MOST_BYTES:
                return self._send(413, {"error": f"more than {MOST_BYTES} bytes"})
            try:
                request = json.loads(self.rfile.read(size))
            except ValueError as e:
                return self._send(200, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}})
            if not isinstance(request, dict):
                return self._send(200, {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "a request is an object"}})
            value = graph.serve(request)
            self._send(200, value) if value is not None else self._send(202, {})

        def log_message(self, *_args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
