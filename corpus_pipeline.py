"""Documents to packed training sequences: quality rules, toxicity, SimHash near-dedup, packing.

Each stage reads what the one before wrote as Parquet in the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wireloom.llm import packing, quality, simhash, toxicity
from wireloom.llm.shared import folder
from wireloom.shipping import shipped

STAGES = [
    ("quality rules", shipped(quality.stage)),
    ("toxicity", shipped(toxicity.stage)),
    ("simhash near-dedup", shipped(simhash.stage)),
    ("packing", shipped(packing.stage)),
]

#: The classifiers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages keep.

    The classifiers train on the labels of the documents that their stage receives; where none of these has a label, or
    all have the same, the stage keeps what its rules keep.  A stage's table goes once the next one is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{at}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/{k - 1}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return docs
