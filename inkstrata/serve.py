"""A workflow behind HTTP with the standard library: health, schema, extract; and the files to run it in a container."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from inkstrata.engine import Engine


def answer(spark: SparkSession, engine: Engine, method: str, path: str, body: bytes) -> tuple[int, dict]:
    """Status and JSON of a request: GET /health, GET /schema, POST /extract with a document's text as the body."""
    if (method, path) == ("GET", "/health"):
        return 200, {"status": "ok", "workflow": engine.name, "version": engine.version}
    if (method, path) == ("GET", "/schema"):
        return 200, engine.schema.json_schema()
    if (method, path) == ("POST", "/extract"):
        if not body.strip():
            return 400, {"error": "the body is empty"}
        docs = spark.createDataFrame([(0, body.decode("utf-8", "replace"))], "doc_id long, text string")
        results, fields = engine.run(docs)
        result = results.first().asDict(recursive=True)
        own = [r.asDict(recursive=True) for r in fields.orderBy("pos").toLocalIterator()]
        accepted = sum(bool(f["gate"]) for f in own) / len(own) if own else 0.0
        return (200 if result["success"] else 422), {"result": result, "data": {f["field"]: f["value"] for f in own}, "fields": own, "accepted": accepted}
    return 404, {"error": f"no {method} {path}"}


def handler(spark: SparkSession, engine: Engine):
    class Handler(BaseHTTPRequestHandler):
        def _run(self, method: str) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, value = answer(spark, engine, method, self.path, body)
            except Exception as e:  # noqa: BLE001 - a request's failure is its answer
                status, value = 500, {"error": f"{type(e).__name__}: {e}"}
            data = json.dumps(value, default=str, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._run("GET")

        def do_POST(self) -> None:
            self._run("POST")

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def serve(spark: SparkSession, config: str | dict, model: Callable, host: str = "127.0.0.1", port: int = 8000) -> None:
    engine = Engine.from_config(Path(config) if isinstance(config, str) and "\n" not in config else config, model)
    ThreadingHTTPServer((host, port), handler(spark, engine)).serve_forever()


def deployment(config: str, output: str, model: str, port: int = 8000) -> list[Path]:
    """The files of a container that serves a workflow."""
    out = Path(output)
    out.mkdir(parents=True, exist_ok=True)
    extras = ["pyspark", "pandas", "pyarrow", "numpy", "pyyaml", "pyahocorasick"]
    text = {
        "workflow.yaml": Path(config).read_text(encoding="utf-8"), "requirements.txt": "\n".join(extras) + "\n",
        "Dockerfile": f'FROM eclipse-temurin:17-jre\nRUN apt-get update && apt-get install -y python3 python3-pip\nWORKDIR /app\nCOPY . .\nRUN pip3 install --break-system-packages -r requirements.txt\nEXPOSE {port}\nCMD ["python3", "-m", "inkstrata.cli", "serve", "workflow.yaml", "--model", "{model}", "--host", "0.0.0.0", "--port", "{port}"]\n',
        "docker-compose.yml": f'services:\n  workflow:\n    build: .\n    ports: ["{port}:{port}"]\n',
    }
    for name, body in text.items():
        (out / name).write_text(body, encoding="utf-8")
    return [out / n for n in text]
