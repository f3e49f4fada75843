"""The engine over HTTP and as tools of a JSON-RPC peer, with the standard
library only.

Requests are small and hold plans and results of bounded size; the data stay in
Spark. ``dispatch`` and ``Tools`` have no sockets, so tests call them directly.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import asdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import RLock
from typing import Any, TextIO
from urllib.parse import parse_qs, unquote, urlsplit

from gleaner.api import Engine, render_report, render_table
from gleaner.model import AGGREGATIONS, FILTERS, GRAINS, Filter, Metric, Query
from gleaner.plans.semantic import QueryError
from gleaner.sources.samples import SAMPLES
from gleaner.sources.text import MAX_BYTES


class RequestError(Exception):
    def __init__(self, status: int, message: str, suggestions: list[str] | None = None):
        super().__init__(message)
        self.status, self.body = status, {"error": message} | ({"suggestions": suggestions} if suggestions else {})


def query_of(body: dict[str, Any]) -> Query:
    """A query from its JSON form: metrics, groupBy, timeGrain, filters, orderBy, limit."""
    get = lambda *names: next((body[n] for n in names if body.get(n) is not None), None)
    metrics = [Metric(m, None) if isinstance(m, str) else Metric(m["measure"], m.get("aggregation")) for m in get("metrics") or []]
    filters = [Filter(f["field"], f.get("operator") or f["op"], f.get("value")) for f in get("filters") or []]
    order = get("orderBy", "order_by") or []
    order = [(o["field"], o.get("direction", "asc")) for o in (order if isinstance(order, list) else [order])]
    return Query(metrics, list(get("groupBy", "group_by") or []), get("timeGrain", "time_grain"), filters, order, get("limit"))


def _result(r) -> dict[str, Any]:
    return asdict(r)


def _need(body: dict[str, Any], *names: str) -> list[Any]:
    missing = [n for n in names if not body.get(n)]
    if missing:
        raise RequestError(400, f"Missing: {', '.join(missing)}.")
    return [body[n] for n in names]


class Service:
    """Routes of the HTTP interface; one request at a time touches the catalogue."""

    def __init__(self, engine: Engine):
        self.engine, self.lock = engine, RLock()

    def dispatch(self, method: str, target: str, body: dict[str, Any] | None = None) -> tuple[int, Any]:
        """(status, JSON value), or (200, iterator of frames) for an analysis."""
        url = urlsplit(target)
        try:
            with self.lock:
                return self._route(method, url.path, parse_qs(url.query), body or {})
        except RequestError as e:
            return e.status, e.body
        except QueryError as e:
            return (404 if "dataset" in str(e) and "There is no" in str(e) else 400), {"error": str(e), "suggestions": e.suggestions}
        except RuntimeError as e:
            return 503, {"error": str(e)}
        except (ValueError, KeyError, TypeError) as e:
            return 400, {"error": str(e)}

    def _route(self, method: str, path: str, params: dict[str, list[str]], body: dict[str, Any]) -> tuple[int, Any]:
        e = self.engine
        match method, path:
            case "GET", "/api/status":
                return 200, {"ok": True, "planner": e.planner is not None, "samples": list(SAMPLES)}
            case "GET", "/api/datasets":
                return 200, {"datasets": e.list_datasets()}
            case "POST", "/api/datasets":
                name, content = _need(body, "name", "content")
                kind = body.get("format")
                key = e.upload_dataset(content, name, None if kind == "auto" else kind)
                return 201, {"dataset": e.describe(key), "warnings": e.dataset(key).warnings}
            case "POST", "/api/samples":
                (name,) = _need(body, "id")
                if name not in SAMPLES:
                    raise RequestError(404, f"There is no sample '{name}'.", list(SAMPLES))
                return 201, {"dataset": e.describe(e.load_sample(name))}
        found = re.fullmatch(r"/api/datasets/([^/]+)(?:/(\w+))?", path)
        if not found:
            raise RequestError(404, f"There is no route {method} {path}.")
        key, part = unquote(found[1]), found[2]
        if method == "DELETE" and part is None:
            return 200, {"deleted": e.delete_dataset(key)}
        e.dataset(key)
        match method, part:
            case "GET", None:
                return 200, {"dataset": e.describe(key)}
            case "PATCH", "semantic":
                patches = {m["name"]: m for m in body.get("measures") or []}
                missed = e.update_semantic_model(key, patches, body.get("reviewed"), body.get("grainDescription"))
                return 200, {"semantic": e.get_semantic_model(key).to_dict(), "unmatched": missed}
            case "GET", "profile":
                return 200, {"columns": [asdict(p) for p in e.profile_dataset(key, params.get("column"))]}
            case "GET", "insights":
                return 200, {"insights": [asdict(x) for x in e.get_insights(key)]}
            case "GET", "analyze":
                return 200, self._frames(key, params.get("focus", [""])[0])
            case "POST", "query":
                return 200, {"result": _result(e.query_data(key, query_of(body)))}
            case "POST", "ask":
                (question,) = _need(body, "question")
                return 200, {"result": _result(e.ask(key, question))}
        raise RequestError(404, f"There is no route {method} {path}.")

    def _frames(self, key: str, focus: str) -> Iterator[str]:
        """Server-sent events of a run; an error is the last of them."""
        try:
            for event in self.engine.analyze_events(key, focus):
                value = {"phase": event.phase, "message": event.message, "progress": event.progress}
                if event.phase == "done":
                    value |= {"insights": [asdict(x) for x in event.payload.insights], "steps": [asdict(s) for s in event.payload.steps]}
                yield f"data: {json.dumps(value, ensure_ascii=False, default=str)}\n\n"
        except Exception as error:
            yield f"data: {json.dumps({'phase': 'error', 'message': str(error), 'progress': 1})}\n\n"


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server that is bound and not yet running: call ``serve_forever``."""
    service = Service(engine)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BYTES:
                status, value = 413, {"error": "The body is larger than 64 MiB."}
            else:
                try:
                    body = json.loads(self.rfile.read(size) or b"{}")
                    status, value = service.dispatch(self.command, self.path, body)
                except ValueError:
                    status, value = 400, {"error": "The body is no JSON."}
            if isinstance(value, dict):
                data = json.dumps(value, ensure_ascii=False, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json; charset=utf-8")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)
                return
            self.send_response(status)
            self.send_header("Content-Type", "text/event-stream; charset=utf-8")
            self.send_header("Cache-Control", "no-cache")
            self.end_headers()
            try:
                for frame in value:
                    self.wfile.write(frame.encode())
                    self.wfile.flush()
            except OSError:  # the client has gone: the run stops here
                value.close()

        do_GET = do_POST = do_PATCH = do_DELETE = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


# Tools


def _schema(required: dict[str, Any], **optional: Any) -> dict[str, Any]:
    return {"type": "object", "properties": required | optional, "required": list(required)}


_TEXT, _LIST = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
_QUERY = {
    "metrics": {"type": "array", "items": _schema({"measure": _TEXT}, aggregation={"enum": list(AGGREGATIONS)})}, "group_by": _LIST, "time_grain": {"enum": list(GRAINS)},
    "filters": {"type": "array", "items": _schema({"field": _TEXT, "operator": {"enum": list(FILTERS)}}, value={})},
    "order_by": {"type": "array", "items": _schema({"field": _TEXT}, direction={"enum": ["asc", "desc"]})}, "limit": {"type": "integer", "minimum": 1, "maximum": 5000},
}


class Tools:
    """The engine as ten named tools and a resource that lists the datasets."""

    RESOURCE = "gleaner://datasets"

    def __init__(self, engine: Engine):
        self.engine = engine
        ds = {"dataset_id": _TEXT}
        self.tools: dict[str, tuple[str, dict, Callable[..., Any]]] = {
            "upload_dataset": ("Load a table from text.", _schema({"name": _TEXT, "content": _TEXT}, format={"enum": ["csv", "tsv", "json", "ndjson"]}), lambda name, content, format=None: engine.describe(engine.upload_dataset(content, name, format))),
            "list_datasets": ("Loaded datasets, newest first.", _schema({}), engine.list_datasets),
            "get_semantic_model": ("What the columns mean.", _schema(ds), lambda dataset_id: engine.describe_semantic_model(dataset_id)),
            "update_semantic_model": ("Patch the meaning of measures.", _schema(ds, measures={"type": "array"}, reviewed={"type": "boolean"}, grain_description=_TEXT), lambda dataset_id, measures=(), reviewed=None, grain_description=None: {"unmatched": engine.update_semantic_model(dataset_id, {m["name"]: m for m in measures}, reviewed, grain_description)}),
            "profile_dataset": ("Profiles of columns.", _schema(ds, columns=_LIST), lambda dataset_id, columns=None: [asdict(p) for p in engine.profile_dataset(dataset_id, columns)]),
            "analyze_dataset": ("Search for findings.", _schema(ds, focus=_TEXT, max_insights={"type": "integer", "minimum": 1, "maximum": 30}), lambda dataset_id, focus="", max_insights=14: render_report(engine.analyze_dataset(dataset_id, focus, most_insights=max(1, min(30, max_insights))))),
            "get_insights": ("Findings of earlier runs.", _schema(ds), lambda dataset_id: [asdict(x) for x in engine.get_insights(dataset_id)]),
            "query_data": ("A structured query.", _schema(ds | {"metrics": _QUERY["metrics"]}, **{k: v for k, v in _QUERY.items() if k != "metrics"}), lambda dataset_id, **q: render_table(engine.query_data(dataset_id, query_of(q)))),
            "ask": ("A question in words.", _schema(ds | {"question": _TEXT}), lambda dataset_id, question: render_table(engine.ask(dataset_id, question))),
            "delete_dataset": ("Forget a dataset.", _schema(ds), lambda dataset_id: {"deleted": engine.delete_dataset(dataset_id)}),
        }

    def call(self, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
        try:
            value = self.tools[name][2](**arguments)
        except Exception as e:  # errors of a tool are its result
            return {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}
        text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
        return {"content": [{"type": "text", "text": text}]}

    def handle(self, message: dict[str, Any]) -> dict[str, Any] | None:
        """The answer to one JSON-RPC message; notifications have none."""
        if "id" not in message:
            return None
        params = message.get("params") or {}
        match message.get("method"):
            case "initialize":
                result = {"protocolVersion": params.get("protocolVersion", "2025-03-26"), "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "gleaner", "version": "0.1"}}
            case "ping":
                result = {}
            case "tools/list":
                result = {"tools": [{"name": n, "description": d, "inputSchema": s} for n, (d, s, _) in self.tools.items()]}
            case "tools/call" if params.get("name") in self.tools:
                result = self.call(params["name"], params.get("arguments") or {})
            case "resources/list":
                result = {"resources": [{"uri": self.RESOURCE, "name": "datasets", "mimeType": "application/json"}]}
            case "resources/read" if params.get("uri") == self.RESOURCE:
                result = {"contents": [{"uri": self.RESOURCE, "mimeType": "application/json", "text": json.dumps(self.engine.list_datasets(), ensure_ascii=False)}]}
            case _:
                return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no such method or name: {message.get('method')}"}}
        return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def serve_lines(engine: Engine, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """One JSON-RPC message a line, until the source ends."""
    tools = Tools(engine)
    for line in source:
        if not line.strip():
            continue
        try:
            answer = tools.handle(json.loads(line))
        except ValueError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if answer is not None:
            sink.write(json.dumps(answer, ensure_ascii=False) + "\n")
            sink.flush()
