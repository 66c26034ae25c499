"""From raw documents to a training mix in five stages, which ``firnline.llm.stages`` holds.

Each stage takes (spark, docs, sf_dir) and gives back the documents it keeps; ``run``
writes every stage's rows to the shared folder and reads them again for the next, so a
stage starts from files and a lost executor costs one stage's tasks at most. Rows keep
all their columns up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from firnline.llm.common import read
from firnline.llm.stages import language, leaks, lines, mixture, near
from firnline.session import scratch_path

STAGES = [("language", language), ("line_dedup", lines), ("near_dedup", near), ("decontaminate", leaks), ("mix", mixture)]

#: Forward-backward, alignment and sketches are beyond SQL; tests compare the stages
#: with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents`` of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
