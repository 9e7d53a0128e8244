"""A thin HTTP face: one document for each request, no state kept between requests.

GET /health /policies; POST /inspect /sanitize /restore /review /extract with JSON bodies. The vault travels in the answer
of /sanitize and comes back with /restore. Wrong requests get 400, bodies beyond MAX_BODY are refused.
"""

from __future__ import annotations

import base64
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanloom.operators import policy, restore, risk, sanitize
from spanloom.sources import readers, writers

MAX_BODY = 32 << 20


class Service:
    """What the paths do; usable without a socket."""

    def __init__(self, spark: SparkSession, policies: policy.Registry | None = None):
        self.spark, self.policies = spark, policies or policy.Registry()

    def _made(self, data: dict):
        text = data["text"]
        if not isinstance(text, str):
            raise ValueError("text must be a string")
        docs = self.spark.createDataFrame([(0, text)], "doc_id long, text string")
        rules = [policy.Recognizer.from_dict(r) for r in data.get("recognizers", [])]
        return sanitize.sanitize(docs, self.policies.get(data.get("policy", "maximum")).with_recognizers(rules))

    def get(self, path: str) -> dict:
        return {"/health": lambda: {"ok": True}, "/policies": lambda: {"policies": sorted(self.policies.policies)}}[path]()

    def post(self, path: str, data: dict) -> dict:
        return {"/inspect": self.inspect, "/sanitize": self.sanitize, "/restore": self.restore, "/review": self.review, "/extract": self.extract}[path](data)

    def inspect(self, data: dict) -> dict:
        made = self._made(data)
        rows = [r.asDict() for r in sanitize.entity_report(made).drop("doc_id", "canonical").orderBy("entity_type", "idx").collect()]
        return {"entities": rows, "preview": sanitize.preview(made).first()["preview"]}

    def sanitize(self, data: dict) -> dict:
        row = self._made(data).first()
        return {"text": row.sanitized, "vault": {v.token: v.value for v in row.vault}, "clean": row.leak.clean, "summary": row.leak.summary}

    def restore(self, data: dict) -> dict:
        replies = self.spark.createDataFrame([(0, data["text"])], "doc_id long, response string")
        vault = self.spark.createDataFrame([(0, t, v) for t, v in data["vault"].items()], "doc_id long, token string, value string")
        row = restore.restore(replies, vault).first()
        return {"text": row.text, "restored": row.restored, "invented": row.invented, "dropped": row.dropped}

    def review(self, data: dict) -> dict:
        made = self._made(data)
        row = made.first()
        left = risk.assess(made.select("doc_id", F.col("sanitized").alias("text"))).first()
        return {"html": writers.review_page(row.text, [e.asDict() for e in row.edits], row.leak.summary, left.summary)}

    def extract(self, data: dict) -> dict:
        text, pages = readers.extract(base64.b64decode(data["data"], validate=True), data["ext"], data.get("ocr", "auto"))
        return {"text": text, "ocr_pages": pages}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, code: int, body: dict) -> None:
            raw = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _try(self, make, known: tuple[str, ...]) -> None:
            if self.path not in known:
                return self._answer(404, {"error": "no such path"})
            try:
                return self._answer(200, make())
            except (KeyError, ValueError, RuntimeError, TypeError, AttributeError) as wrong:
                return self._answer(400, {"error": f"{type(wrong).__name__}: {wrong}"})

        def do_GET(self) -> None:  # noqa: N802
            self._try(lambda: service.get(self.path), ("/health", "/policies"))

        def do_POST(self) -> None:  # noqa: N802
            def make() -> dict:
                size = int(self.headers.get("Content-Length", ""))
                if not 0 <= size <= MAX_BODY:
                    raise ValueError("body too large")
                data = json.loads(self.rfile.read(size))
                if not isinstance(data, dict):
                    raise ValueError("the body must be an object")
                return service.post(self.path, data)

            self._try(make, ("/inspect", "/sanitize", "/restore", "/review", "/extract"))

        def log_message(self, *args) -> None:
            """Nothing is logged: requests hold what must stay private."""

    return Handler


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8765, policies: policy.Registry | None = None) -> ThreadingHTTPServer:
    """A server that the caller runs with serve_forever()."""
    return ThreadingHTTPServer((host, port), handler(Service(spark, policies)))
