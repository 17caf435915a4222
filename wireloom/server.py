"""A small server: a picture posted to /api/process is interpreted and answered as JSON."""

from __future__ import annotations

import base64
import json
import tempfile
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wireloom.config import Config
from wireloom.plans.interpret import Given, interpret
from wireloom.sinks import sheets
from wireloom.sources import drawings


def numeric(timings: dict) -> dict:
    """Timings without what isn't a number."""
    return {k: v for k, v in timings.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}


def process(spark: SparkSession, picture: bytes, c: Config, given: Given | None = None) -> dict:
    """json, domain, the overlay as a data address, and timings of one picture. The driver's folder holds it, as the driver alone is asked."""
    with tempfile.TemporaryDirectory() as at:
        (Path(at) / "upload.png").write_bytes(picture)
        schema = "drawing_id string, height int, width int, channels int, data binary"
        rows = [tuple(r) for r in drawings.images(spark, f"file://{at}").collect()]
    if not rows:
        raise ValueError("this isn't a picture")
    images = spark.createDataFrame(rows, schema)
    found = interpret(spark, images, c, given)
    svg = sheets.overlays(found["symbols"].withColumn("type", F.col("class")), images.select("drawing_id", "width", "height")).first().svg
    return {
        "json": json.loads(found["json"].first().json), "domain": found["routes"].first().domain, "overlay": "data:image/svg+xml;base64," + base64.b64encode(svg.encode()).decode(),
        "timing": numeric(found["timings"]),
    }


def server(answer: Callable[[bytes], dict], port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Serves answer(body) as JSON; an error is answered with its name and text, and status 500."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, said = 200, {}
            if self.path != "/api/process":
                status, said = 404, {"error": "not found"}
            else:
                try:
                    said = answer(body)
                except Exception as e:  # told to who asked
                    status, said = 500, {"error": f"{type(e).__name__}: {e}"}
            text = json.dumps(said).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(text)))
            self.end_headers()
            self.wfile.write(text)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
