"""Netlists of drawings as they arrive in a folder.

Each file is one drawing and complete by itself, so no state is kept between batches; a batch
that is run again overwrites its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wireloom.sinks.netlists import netlists
from wireloom.sources.drawings import GOLDEN, stem, symbols


def arriving(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """A stream of drawing files (JSON) as drawing_id, verified, symbols; at most so many files a batch."""
    read = spark.readStream.schema("value string").option("maxFilesPerTrigger", most).text(path, wholetext=True)
    parsed = read.select(stem(F.col("_metadata.file_path")).alias("drawing_id"), F.from_json("value", GOLDEN).alias("d"))
    return parsed.select("drawing_id", F.coalesce("d._connectivity_verified", F.lit(False)).alias("verified"), F.coalesce("d.symbols", F.array()).alias("symbols"))


def run(stream: DataFrame, to: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes the netlist of every drawing that has arrived, then stops; `each` changes a batch's symbols first."""

    def write(batch: DataFrame, number: int) -> None:
        rows = symbols(batch)
        netlists(each(rows) if each else rows).write.mode("overwrite").json(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
