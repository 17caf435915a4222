"""Second detectors by provider, a hosted one among them, and the cache of their answers.

A detector is a function of a gray picture to boxes, as plans.pictures.boxes takes it.  A hosted one posts the picture
and gets predictions (centre, size, confidence); whatever goes wrong there is told once, and gives no boxes.
"""

from __future__ import annotations

import base64
import json
import logging
import os
import sys
import urllib.request
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from wireloom.sources import readings
from wireloom.sources.domains import Detector

log = logging.getLogger(__name__)
_told: set[str] = set()
#: Where a hosted detector listens, and its key: names in the environment.
URL, KEY = "WIRELOOM_DETECTOR_URL", "WIRELOOM_DETECTOR_KEY"


def environment(path: str = ".env") -> dict[str, str]:
    """The names and values of an environment file: lines of NAME=VALUE, others and comments passed over; {} if there is none."""
    at = Path(path)
    lines = at.read_text().splitlines() if at.is_file() else []
    return {k.strip(): v.strip() for k, e, v in (x.partition("=") for x in lines if not x.lstrip().startswith("#")) if e}


def reading_data(prefix: str = sys.prefix) -> str | None:
    """The folder of a text reader's language data: the environment's, else the first usual place that has it."""
    usual = [Path(prefix) / "share" / "tessdata", Path(prefix) / "Library" / "share" / "tessdata"]
    return os.environ.get("TESSDATA_PREFIX") or next((str(p) for p in usual if (p / "eng.traineddata").is_file()), None)


def within(predictions: list[dict], width: int, height: int) -> list[dict]:
    """Predictions as boxes without a class, cut to the picture; those without area go."""
    out = []
    for p in predictions:
        ends = [int(p["x"] - p["width"] / 2), int(p["y"] - p["height"] / 2), int(p["x"] + p["width"] / 2), int(p["y"] + p["height"] / 2)]
        x0, y0, x1, y1 = max(ends[0], 0), max(ends[1], 0), min(ends[2], width), min(ends[3], height)
        if x1 > x0 and y1 > y0:
            out.append({"x0": x0, "y0": y0, "x1": x1, "y1": y1, "kind": "symbol", "class": None, "confidence": float(p.get("confidence", 0.0)), "source": "real_detector"})
    return out


def once(what: str) -> None:
    if what not in _told:
        _told.add(what)
        log.warning("%s; going on without it", what)


def hosted(spec: Detector, url: str | None = None, key: str | None = None, seconds: float = 60) -> Callable[[np.ndarray], list[dict]]:
    """A detector that posts {model, confidence, overlap, height, width, data} as JSON and reads {"predictions": [...]}."""

    def detect(picture: np.ndarray) -> list[dict]:
        kept = environment()
        at, secret = (given or os.environ.get(name) or kept.get(name) for given, name in ((url, URL), (key, KEY)))
        if not at or not secret:
            once(f"the hosted detector {spec.model_id} has no address or key")
            return []
        body = {"model": spec.model_id, "confidence": spec.conf, "overlap": spec.overlap, "height": picture.shape[0], "width": picture.shape[1], "data": base64.b64encode(picture.tobytes()).decode()}
        try:
            asked = urllib.request.Request(at, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {secret}"})
            with urllib.request.urlopen(asked, timeout=seconds) as answer:
                return within(json.load(answer).get("predictions", []), picture.shape[1], picture.shape[0])
        except Exception as e:  # the network, the key, or what comes back
            once(f"the hosted detector {spec.model_id} failed: {e}")
            return []

    return detect


def provided(spec: Detector | None, local: dict[str, Callable[[np.ndarray], list[dict]]] | None = None) -> Callable[[np.ndarray], list[dict]] | None:
    """The detector of a spec: a local one from those given by model, or a hosted one; none without a spec or for other providers."""
    if spec is None:
        return None
    if spec.provider == "local":
        return (local or {}).get(spec.model_id)
    return hosted(spec) if spec.provider in ("hosted", "roboflow") else None


def answered(spark: SparkSession, asked: DataFrame, cache: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers (key, ...) to the rows of asked, which have a key: from the Parquet cache, and from answer() for the others, which are added to it."""
    from wireloom.sources.library import there

    held = spark.read.parquet(cache) if there(spark, cache) else None
    new = readings.unanswered(asked, held) if held is not None else asked.dropDuplicates(["key"])
    answer(new).write.mode("append").parquet(cache)
    return spark.read.parquet(cache).join(asked.select("key").distinct(), "key", "left_semi")
