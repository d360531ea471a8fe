"""Queries on stores over HTTP (JSON): for look-ups by people and tools, not for bulk reads.

    GET /stores                                 names
    GET /indexes                                names of all indexes
    GET /stores/{store}                         [{key, value}], at most ``limit`` rows a page (after=key for the next)
    GET /stores/{store}/indexes                 names
    GET /stores/{store}/indexes/{index}         {index value: [keys]}, at most ``limit`` entries a page, in their order (after=index value
                                                and, to go on within a value, after_key=key)
    GET /stores/{store}/indexes/{index}/{key}   [{key, value}] under an index value, the same way in pages (after=key)
    GET /stores/{store}/{key}                   {key, value}; a missing value is null
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.operators.stores import IndexedStore, Registry, UnknownIndex, UnknownStore

PAGE = 1000


def _plain(x: object) -> object:
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).decode("utf-8", "replace")
    return x if isinstance(x, (str, int, float, bool, dict, type(None))) else str(x)


def answer(registry: Registry, path: str) -> tuple[int, object]:
    """Status and body of a request."""
    url = urlsplit(path)
    parts = [unquote(p) for p in url.path.strip("/").split("/")]
    q = parse_qs(url.query, keep_blank_values=True)  # an empty text may be the last key of a page
    limit = max(1, min(PAGE, int(q.get("limit", [""])[0] or PAGE)))
    after = q.get("after", [None])[0]
    try:
        match parts:
            case ["stores"]:
                return 200, registry.stores()
            case ["indexes"]:
                return 200, registry.indexes()
            case ["stores", name]:
                rows = _after(registry.store(name).df, "key", after)
                return 200, [_plain(r) for r in rows.orderBy("key").select("key", "value").limit(limit).collect()]
            case ["stores", name, "indexes"]:
                return 200, registry.indexes(name)
            case ["stores", name, "indexes", index]:
                d, key = _indexed(registry, name).dump(index), q.get("after_key", [None])[0]
                rest = _after(d, "index_key", after)
                if after is not None and key is not None:
                    rest = rest.unionByName(_after(d.where(F.col("index_key") == F.lit(after).cast(d.schema["index_key"].dataType)), "key", key))
                page: dict[str, list] = {}
                for r in rest.orderBy("index_key", "key").limit(limit).collect():
                    page.setdefault(str(_plain(r["index_key"])), []).append(_plain(r["key"]))
                return 200, page
            case ["stores", name, "indexes", index, key]:
                s = _indexed(registry, name)
                hit = _after(s.df.where(s.index(index).cast("string") == key), "key", after)
                return 200, [_plain(r) for r in hit.orderBy("key").select("key", "value").limit(limit).collect()]
            case ["stores", name, key]:
                s = registry.store(name)
                row = s.df.where(F.col("key") == F.lit(key).try_cast(s.df.schema["key"].dataType)).first()
                return 200, {"key": key, "value": None if row is None else _plain(row["value"])}
    except (UnknownStore, UnknownIndex) as e:
        return 404, {"error": f"unknown: {e.args[0]}"}
    return 404, {"error": "no such route"}


def _after(df: DataFrame, column: str, after: str | None) -> DataFrame:
    """The rows behind the last one of the page before."""
    return df if after is None else df.where(F.col(column) > F.lit(after).cast(df.schema[column].dataType))


def _indexed(registry: Registry, name: str) -> IndexedStore:
    s = registry.store(name)
    if not isinstance(s, IndexedStore):
        raise UnknownIndex(name)
    return s


def serve(registry: Registry, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """Answer requests in the background; the server's ``server_port`` is its port, ``shutdown()`` ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            try:
                status, body = answer(registry, self.path)
            except Exception as e:  # a query's failure is the answer, not the server's end
                status, body = 500, {"error": str(e)[:500]}
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
