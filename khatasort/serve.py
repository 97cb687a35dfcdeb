"""A small local HTTP API over a store: one session, one request at a time.

GET / (the paths), /api/categories, /api/state; POST /api/classify, /api/correct (JSON), /api/categorize, /api/merchants (CSV).  While it
listens on a loopback address it answers loopback hosts only.
"""

from __future__ import annotations

import csv
import io
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from .functions import fixed
from .operators import profile
from .operators.learning import Store
from .sources import export
from .operators.cascade import VERDICT
from .sources.statement import good, metrics, parse, problem_counts, scan

LOOPBACK = ("127.0.0.1", "localhost", "::1")
MOST_BYTES = 32 << 20
TYPES = {"/api/classify": "application/json", "/api/correct": "application/json", "/api/categorize": "text/csv", "/api/merchants": "text/csv"}


class Refused(Exception):
    """A request that gets an error: status and message."""

    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def _csv(frame) -> str:
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(frame.columns)
    for row in frame.toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
    return out.getvalue()


class Api:
    """The answers, apart from HTTP."""

    def __init__(self, store: Store, **layers):
        self.store, self.layers = store, layers
        self._lock = threading.Lock()

    def _rows(self, body: bytes, dedupe: bool):
        files = self.store.spark.createDataFrame([("upload", bytearray(body))], "path string, content binary")
        try:
            found = parse(scan(files), dedupe).persist()
            found.count()
        except Exception as err:
            if "UnresolvedHeaders" in str(err):
                raise Refused(422, "no date or counterparty column") from None
            raise
        return found

    def get(self, path: str):
        if path == "/api/categories":
            return list(fixed.CATEGORIES)
        if path == "/api/state":
            with self._lock:
                return self.store.counts()
        if path == "/":
            return {"service": "khatasort", "get": ["/api/categories", "/api/state"], "post": sorted(TYPES)}
        raise Refused(404, "no such path")

    def post(self, path: str, body: bytes):
        if path not in TYPES:
            raise Refused(404, "no such path")
        if TYPES[path] == "application/json":
            try:
                given = json.loads(body or b"{}")
            except ValueError:
                raise Refused(400, "the body isn't JSON") from None
            if not isinstance(given, dict):
                raise Refused(400, "the body isn't an object")
        with self._lock:
            if path == "/api/classify":
                if not (name := str(given.get("text") or "").strip()):
                    raise Refused(400, "text is needed")
                found = self.store.classify(name, bool(given.get("isCredit")), str(given.get("direction") or ""), **self.layers)
                return {"input": name} | {camel(k): v for k, v in found.items()}
            if path == "/api/correct":
                if given.get("category") not in fixed.CATEGORIES or not given.get("counterparty"):
                    raise Refused(422, "counterparty and a known category are needed")
                return self.store.record_correction(given["counterparty"], given["category"])
            if not body:
                raise Refused(400, "the upload is empty")
            overrides, learned, _ = self.store.state()
            found = self._rows(body, False)
            if path == "/api/merchants":
                return _csv(export.merchant_map(good(found), overrides, learned, **self.layers).select("merchant", "category"))
            return self._categorized(found, export.categorized(found, overrides, learned, **self.layers).persist())

    def _categorized(self, found, judged) -> dict:
        """Summary, counts, rows and the finished CSV of one upload (of at most MOST_BYTES)."""
        ok = judged.where("status = 'ok'")
        summary = profile.web_summary(ok).first().asDict()
        counts, total = export.export_summary(judged).first().asDict(), metrics(found).first().asDict()
        given = ("counterparty", "direction", "amount", "is_credit")
        rows = ok.orderBy("row_number").select(F.date_format("occurred_at", "yyyy-MM-dd").alias("date"), *given, *VERDICT).toLocalIterator()
        first = judged.select("headers").first()
        headers = first.headers if first else []
        return {
            "summary": {
                "inputRows": total["total_rows"],
                "classified": counts["classified"],
                "needsReview": summary["needs_review"],
                "other": summary["other"],
                "skipped": total["skipped"],
                "problems": {r.problem: r["n"] for r in problem_counts(found).collect()},
                "uniqueMerchants": summary["unique_merchants"],
            },
            "byCategory": json.loads(summary["by_category"] or "{}"),
            "bySource": json.loads(summary["by_source"] or "{}"),
            "columns": list(fixed.VERDICT_COLUMNS),
            "rows": [{camel(k): v for k, v in r.asDict().items()} for r in rows],
            "csv": _csv(export.export_rows(judged, headers)),
        }


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.title() for x in rest)


def handler_of(api: Api, loopback_only: bool):
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, make) -> None:
            try:
                name = (self.headers.get("Host") or "").lower()
                name = name[1 : name.find("]")] if name.startswith("[") else name.rsplit(":", 1)[0]
                if loopback_only and name not in LOOPBACK:
                    raise Refused(403, "host not allowed")
                status, body = 200, make()
            except Refused as err:
                status, body = err.status, {"error": str(err)}
            except Exception as err:
                status, body = 500, {"error": type(err).__name__}
            if self.path == "/favicon.ico" and status == 404:
                status, body = 204, ""
            data = body.encode() if isinstance(body, str) else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/csv" if isinstance(body, str) else "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("X-Content-Type-Options", "nosniff")
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer(lambda: api.get(self.path))

        def do_POST(self) -> None:
            def make():
                kind = (self.headers.get("Content-Type") or "").split(";")[0].strip().lower()
                if self.path in TYPES and kind != TYPES[self.path]:
                    raise Refused(415, f"send {TYPES[self.path]}")
                size = self.headers.get("Content-Length") or "0"
                if not size.isdigit() or int(size) > MOST_BYTES:
                    raise Refused(400, "invalid or too large Content-Length")
                return api.post(self.path, self.rfile.read(int(size)))

            self._answer(make)

        def log_message(self, *_) -> None:
            pass

    return Handler


def server(store: Store, host: str = "127.0.0.1", port: int = 0, **layers) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler_of(Api(store, **layers), host in LOOPBACK))


def serve(store: Store, host: str, port: int, **layers) -> None:
    with server(store, host, port, **layers) as http:
        print(f"http://{host}:{http.server_address[1]}")
        http.serve_forever()
