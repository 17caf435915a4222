"""Sends this package to the executors, so that it need not be installed there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's files to the session's context, once."""
    context = spark.sparkContext
    if getattr(context, "shipped_wireloom", False):
        return
    here = Path(__file__).parent
    at = Path(tempfile.mkdtemp())
    with zipfile.ZipFile(at / "wireloom.zip", "w") as z:
        for p in sorted([*here.rglob("*.py"), *here.rglob("*.json")]):
            z.write(p, f"wireloom/{p.relative_to(here)}")
    context.addPyFile(str(at / "wireloom.zip"))
    atexit.register(shutil.rmtree, at, True)  # executors fetch it from the driver as they come
    context.shipped_wireloom = True


def shipped(f: Callable) -> Callable:
    """f, whose first argument is a session, after the package has been sent."""

    @wraps(f)
    def call(spark: SparkSession, *rest):
        ship(spark)
        return f(spark, *rest)

    return call
