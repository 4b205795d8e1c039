"""The engine over HTTP: sessions that each hold a compiled workbook, and routes that answer in JSON.

Routing is a function of (sessions, method, path, parameters, body), so that it can be tried without a socket; the server from the
standard library is a thin shell around it. Tables come as pages of ``limit`` rows (100 unless asked otherwise) from ``offset`` on, with their true
number of rows. Uploads go to ``folder``, which executors have to reach too.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from typing import Any
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession

from loomgraph import storage
from loomgraph.sources.workbook import WorkbookError

from .session import KEPT, Engine

# How long a session lives without use, in seconds, and how many there are at once.
TTL, MOST = 3600, 20


@dataclass
class Session:
    id: str
    engine: Engine
    mode: str = "workspace"
    used: float = 0.0
    trail: list[str] = field(default_factory=list)  # entities looked at, the last one current


@dataclass
class Sessions:
    """Open sessions; unused ones end after a time, and the longest unused one makes room for a new one."""

    spark: SparkSession
    folder: str
    ttl: float = TTL
    most: int = MOST
    clock: Callable[[], float] = time.time
    held: dict[str, Session] = field(default_factory=dict)

    def sweep(self) -> None:
        now = self.clock()
        for key in [k for k, s in self.held.items() if now - s.used > self.ttl]:
            del self.held[key]

    def add(self, engine: Engine, mode: str = "workspace") -> Session:
        self.sweep()
        while len(self.held) >= self.most:
            del self.held[min(self.held, key=lambda k: self.held[k].used)]
        s = Session(uuid.uuid4().hex, engine, mode, self.clock())
        self.held[s.id] = s
        return s

    def get(self, key: str) -> Session | None:
        self.sweep()
        s = self.held.get(key)
        if s is not None:
            s.used = self.clock()
        return s


def plain(value: Any, limit: int = 100, offset: int = 0) -> Any:
    """What JSON can hold: a table is a page of rows and their number."""
    if isinstance(value, DataFrame):
        rows = value.offset(offset).limit(limit).collect()
        return {"columns": value.columns, "rows": [plain(r.asDict(True)) for r in rows], "total": value.count()}
    if isinstance(value, dict):
        return {str(k): plain(v, limit, offset) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v, limit, offset) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def _need(args: dict[str, str], *names: str) -> list[str]:
    missing = [n for n in names if not args.get(n)]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    return [args[n] for n in names]


def _hops(args: dict[str, str]) -> dict[str, Any]:
    return {"direction": args.get("direction", "out"), "max_hops": int(args.get("max_hops", 6))}


def _look(s: Session, a: dict[str, str]) -> Any:
    """An entity with what can be done from it; it becomes the current one."""
    (token,) = _need(a, "token")
    found = s.engine.discover(token, a.get("context"))
    if found["status"] == "resolved":
        s.trail.append(token)
        return found | {"actions": s.engine.menu(token)}
    return found


def _back(s: Session, a: dict[str, str]) -> Any:
    s.trail = s.trail[:-1]
    return s.engine.discover(s.trail[-1]) if s.trail else {"status": "home", "contexts": s.engine.contexts()}


def _home(s: Session, a: dict[str, str]) -> Any:
    s.trail = []
    return {"status": "home", "contexts": s.engine.contexts(), "registries": s.engine.registry_universe()}


def _asked(s: Session, a: dict[str, str]) -> Any:
    got = s.engine.ask(*_need(a, "text"))
    return {k: got[k] for k in ("query", "operations", "trace", "result")}


def _diagnosed(s: Session, a: dict[str, str]) -> Any:
    d = s.engine.diagnose(*_need(a, "text"))
    return {"layers": d.layers, "health": d.health, "band": d.band}


ROUTES: dict[str, Callable[[Session, dict[str, str]], Any]] = {
    "query": _look,
    "action": lambda s, a: s.engine.explain_relation(*_need(a, "token", "relation")),
    "back": _back,
    "home": _home,
    "search": lambda s, a: s.engine.search(*_need(a, "term")),
    "contexts": lambda s, a: s.engine.contexts(),
    "context_query": lambda s, a: s.engine.query_in_context(*_need(a, "registry", "term")),
    "perspective": lambda s, a: s.engine.perspective(*_need(a, "token"), **_hops(a)),
    "suggest": lambda s, a: s.engine.suggest(*_need(a, "token"), limit=int(a.get("most", 8))),
    "discover": lambda s, a: s.engine.discover(*_need(a, "query"), a.get("context")),
    "ask": _asked,
    "diagnose": _diagnosed,
    "intersect": lambda s, a: s.engine.intersect(*_need(a, "a", "b"), **_hops(a)),
    "session": lambda s, a: {"id": s.id, "mode": s.mode, "trail": s.trail, "registries": s.engine.contexts()},
}


def respond(sessions: Sessions, method: str, path: str, args: dict[str, str], body: bytes = b"") -> tuple[int, str, bytes]:
    """(status, content type, body) of a request: /health, POST /upload?name=, and /ROUTE/SESSION or /export/SESSION."""
    name, _, key = path.strip("/").partition("/")
    send = lambda status, value: (status, "application/json", json.dumps(value, ensure_ascii=False).encode())
    try:
        if name == "health":
            return send(200, {"status": "ok", "sessions": len(sessions.held)})
        if name == "upload":
            if method != "POST":
                return send(405, {"error": "upload by POST"})
            at = Path(sessions.folder) / f"{uuid.uuid4().hex}-{Path(_need(args, 'name')[0]).name}"
            at.write_bytes(body)
            s = sessions.add(Engine.open(sessions.spark, str(at)), args.get("mode", "workspace"))
            return send(200, {"session": s.id, "registries": s.engine.contexts()})
        if name not in ROUTES and name != "export":
            return send(404, {"error": f"there is no route {name!r}"})
        s = sessions.get(key)
        if s is None:
            return send(404, {"error": "there is no such session, or it has ended"})
        if name == "export":
            with tempfile.TemporaryDirectory() as folder, storage.scope(*KEPT):
                s.engine.export(f"{folder}/export.zip")
                return 200, "application/zip", Path(f"{folder}/export.zip").read_bytes()
        with storage.scope(*KEPT):  # levels of searches and the like go with the request
            return send(200, plain(ROUTES[name](s, args), int(args.get("limit", 100)), int(args.get("offset", 0))))
    except WorkbookError as x:
        return send(422, {"error": str(x)})
    except (KeyError, ValueError) as x:
        return send(400, {"error": str(x).strip("'\"")})


def handler(sessions: Sessions) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            url = urlsplit(self.path)
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, out = respond(sessions, self.command, url.path, dict(parse_qsl(url.query)), body)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _answer  # noqa: N815

        def log_message(self, *args: object) -> None:
            """Nothing: requests may name entities."""

    return Handler


def serve(spark: SparkSession, folder: str, port: int = 8765, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that the caller starts by serve_forever; port 0 takes any free one."""
    return ThreadingHTTPServer((host, port), handler(Sessions(spark, folder)))


def start(spark: SparkSession, path: str) -> dict[str, Callable[..., Any]]:
    """The engine of a workbook as its named capabilities."""
    from loomgraph.operators import contracts

    e = Engine.open(spark, path)
    return {
        "query_entity": lambda token, prefer=None: e.query_entity(token, prefer),
        "search": e.search,
        "describe": e.describe,
        "resolve": e.resolve,
        "discover": e.discover,
        "overview": e.overview,
        "ask": e.ask,
        "scan_contract": lambda root, states: contracts.scan(spark, root, states),
    }
