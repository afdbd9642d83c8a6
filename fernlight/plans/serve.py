"""The HTTP surface: health, search and retrieval over one store. The driver only parses requests; Spark ranks."""

from __future__ import annotations

import hmac
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from ..operators import catalog, filters
from .config import Config
from .search import search
from .store import Store
from .sync import tables_of

DEFAULT_K, MOST_K, MOST_BODY = 10, 100, 1_000_000
RETRIEVAL = "/retrieval"


class HttpError(Exception):
    def __init__(self, status: int, message: str, code: int | None = None):
        super().__init__(message)
        self.status, self.code = status, code


def expect_text(value: Any, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise HttpError(400, f"{name} is a text that isn't empty")
    return value


def expect_object(value: Any, name: str) -> dict:
    if not isinstance(value, dict):
        raise HttpError(400, f"{name} is an object")
    return value


def top_k(value: Any, name: str = "top_k") -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or int(value) != value or not 1 <= value <= MOST_K:
        raise HttpError(400, f"{name} is a whole number from 1 to {MOST_K}")
    return int(value)


def threshold(value: Any, name: str = "score_threshold") -> float:
    """null is 0; the caller decides what absence is."""
    if value is None:
        return 0.0
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise HttpError(400, f"{name} is a number from 0 to 1")
    return float(value)


def metadata(r: dict, mode: str) -> dict:
    out = {k: r[k] for k in ("path", "slug", "title", "doc_id", "chunk_uid", "seq", "heading_path", "anchor", "tier", "evidence", "token_est", "score", "normalized_score")}
    return out | {"facets": json.loads(r["facets"] or "{}"), "retrieval_mode": mode}


class Service:
    """What the handler answers with; usable without a server."""

    def __init__(self, store: Store, config: Config, knowledge_id: str = "default", api_key: str | None = None, provider=None):
        self.store, self.config, self.knowledge_id, self.api_key, self.provider = store, config, knowledge_id, api_key, provider

    def health(self) -> dict:
        counts = catalog.statistics(*tables_of(self.store).values()).first().asDict()
        own = {k: counts[k] for k in ("retrieval_mode", "documents_active", "chunks")}
        return {"ok": True, "service": "fernlight", "repo_root": self.config.root, "storage_backend": self.config["storage.backend"], "last_sync": self.store.state("last_sync")} | own

    def authorise(self, header: str | None) -> None:
        if not self.api_key:
            return
        kind, _, key = (header or "").partition(" ")
        if kind.lower() != "bearer" or not key:
            raise HttpError(401, "the authorization header is missing or malformed", 1001)
        if not hmac.compare_digest(key.strip().encode(), self.api_key.encode()):
            raise HttpError(401, "the key isn't valid", 1002)

    def _search(self, query: str, k: int, least: float, body: dict) -> dict:
        try:
            return search(self.store, self.config, query, k=k, facets=filters.parse_http(body.get("filters")), condition=body.get("metadata_condition"), pooled=False, least=least, provider=self.provider)
        except filters.FilterError as e:
            raise HttpError(400, str(e)) from None

    def retrieval(self, body: Any) -> dict:
        body = expect_object(body, "the request")
        if expect_text(body.get("knowledge_id"), "knowledge_id") != self.knowledge_id:
            raise HttpError(404, "there is no such knowledge base", 2001)
        query = expect_text(body.get("query"), "query")
        setting = expect_object(body.get("retrieval_setting"), "retrieval_setting")
        if "score_threshold" not in setting:
            raise HttpError(400, "retrieval_setting.score_threshold is needed")
        found = self._search(query, top_k(setting.get("top_k")), threshold(setting["score_threshold"]), {"metadata_condition": body.get("metadata_condition")})
        return {"records": [{"content": r["body"], "score": r["normalized_score"], "title": r["title"], "metadata": metadata(r, found["retrieval_mode"])} for r in found["results"]]}

    def search(self, body: Any) -> dict:
        body = expect_object(body, "the request")
        k = body.get("k") if body.get("k") is not None else body.get("top_k")
        found = self._search(expect_text(body.get("query"), "query"), DEFAULT_K if k is None else top_k(k, "k"), threshold(body.get("score_threshold")), body)
        for r in found["results"]:
            r["facets"] = json.loads(r["facets"] or "{}")
            r["content"], r["score"] = r["body"], r["normalized_score"]
        return found

    def answer(self, method: str, path: str, header: str | None, raw: bytes) -> tuple[int, Any]:
        path = path.split("?")[0].rstrip("/") or "/"
        try:
            if method == "OPTIONS":
                return 204, None
            routes = {"/health": ("GET", lambda _: self.health()), RETRIEVAL: ("POST", self.retrieval), "/search": ("POST", self.search)}
            if path not in routes:
                raise HttpError(404, "there is nothing here")
            wanted, call = routes[path]
            if method != wanted:
                raise HttpError(405, f"{path} takes {wanted}")
            if wanted == "POST":
                self.authorise(header)
            if len(raw) > MOST_BODY:
                raise HttpError(413, f"a request has at most {MOST_BODY} bytes")
            try:
                body = json.loads(raw or b"{}")
            except ValueError:
                raise HttpError(400, "the request isn't JSON") from None
            return 200, call(body)
        except HttpError as e:
            if path == RETRIEVAL:
                return e.status, {"error_code": e.code or e.status, "error_msg": str(e)}
            return e.status, {"error": {"code": e.code or e.status, "message": str(e)}}


def start(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that isn't running yet: call serve_forever(), and shutdown() from another thread."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            length = int(self.headers.get("Content-Length") or 0)
            raw = self.rfile.read(min(length, MOST_BODY + 1))
            status, value = service.answer(self.command, self.path, self.headers.get("Authorization"), raw)
            body = b"" if value is None else json.dumps(value, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            for name, text in (("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(body))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "authorization, content-type"), ("Access-Control-Allow-Methods", "GET, POST, OPTIONS")):
                self.send_header(name, text)
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST = do_OPTIONS = do_PUT = do_DELETE = _reply

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def url_of(host: str, port: int) -> str:
    return f"http://[{host}]:{port}" if ":" in host else f"http://{host}:{port}"
