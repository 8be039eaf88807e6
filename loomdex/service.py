"""The service's two verbs and its readiness, and a small JSON transport for them."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from loomdex.config import Settings
from loomdex.functions.options import flag_of
from loomdex.operators.filters import Scope
from loomdex.operators.search import Index, clamp_limit, one_query, respond, search
from loomdex.operators.stats import collection_statistics

MODES = ("hybrid-fused", "sparse", "dense")


class SearchService:
    """One long-lived index; opened on start, warmed up by a query."""

    def __init__(self, settings: Settings, opener: Callable[[], Index]):
        self.settings, self.opener = settings, opener
        self.index: Index | None = None
        self.error: str | None = None

    def start(self, warm_up: str | None = "test") -> None:
        try:
            self.index = self.opener()
            if warm_up:
                self.search(warm_up, limit=1)
            self.error = None
        except Exception as e:  # readiness tells what is wrong
            self.index, self.error = None, str(e)

    def stop(self) -> None:
        self.index = None

    def health(self) -> tuple[int, dict]:
        return 200, {"status": "ok"}

    def ready(self) -> tuple[int, dict]:
        return (200, {"status": "ready"}) if self.index is not None else (503, {"status": "not ready", "error": self.error})

    def search(self, query: str, limit: int | None = None, source: str | None = None, lang: str | None = None, path: str | None = None, mode: str | None = None, include_text: bool = True, max_text_chars: int | None = None) -> dict:
        s = self.settings
        mode = mode or s.mode
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
        n = clamp_limit(limit, s.default_limit, s.max_limit)
        filters = Scope(source=source or s.source, lang=lang, path=path)
        found = search(self.index, one_query(self.index.chunks.sparkSession, query), mode, n, filters)
        rows = respond(found, include_text, max_text_chars or s.max_text_chars).collect()
        results = [r.asDict() for r in rows[0]["results"]] if rows else []
        return {"query": query, "mode": mode, "limit": n, "filters": {name: filters.get(name) for name in ("source", "lang", "path")}, "count": len(results), "results": results}

    def stats(self) -> dict:
        rows = collection_statistics(self.index.chunks).collect()
        return {"chunks": sum(r["chunks"] for r in rows), "sources": len(rows), "profile": self.settings.profile, "mode": self.settings.mode}


ROUTES = {"/healthz": "health", "/readyz": "ready", "/search": "search", "/stats": "stats"}


def answer(service: SearchService, target: str, body: dict | None = None) -> tuple[int, dict]:
    """Status and JSON of a request: arguments come from the address or a JSON body."""
    path = urlsplit(target)
    name = ROUTES.get(path.path.rstrip("/") or "/")
    if name is None:
        return 404, {"error": f"nothing at {path.path}"}
    if name in ("health", "ready"):
        return getattr(service, name)()
    if service.index is None:
        return service.ready()
    given = dict(parse_qsl(path.query)) | (body or {})
    try:
        kinds = {"limit": int, "max_text_chars": int, "include_text": lambda v: flag_of(v) is not False}
        return 200, getattr(service, name)(**{k: kinds[k](v) if k in kinds and v is not None else v for k, v in given.items()})
    except (TypeError, ValueError) as e:
        return 400, {"error": str(e)}


def serve(service: SearchService, host: str = "127.0.0.1", port: int = 8000, started: Callable[[ThreadingHTTPServer], None] | None = None) -> None:
    """Answer until interrupted. The index is opened first; where that fails, /readyz says why."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(length)) if length else None
                status, told = answer(service, self.path, body)
            except json.JSONDecodeError as e:
                status, told = 400, {"error": str(e)}
            except Exception as e:  # one request must not stop the service
                status, told = 500, {"error": str(e)}
            data = json.dumps(told, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    service.start()
    with ThreadingHTTPServer((host, port), Handler) as server:
        if started:
            started(server)
        server.serve_forever()
    service.stop()
