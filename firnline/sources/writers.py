"""Sinks."""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXPERIMENTS


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
    compression: str = "gzip",
    cluster_by: list[str] | None = None,
) -> str:
    """Parquet, gzip unless told otherwise; ``partition_by`` should have few values
    (a water year).

    With ``cluster_by`` rows are dealt by range over ``partition_by`` and then
    ``cluster_by`` and sorted so: a task holds one stretch of that order, so there are
    at most as many files as tasks and folders together, a large folder is spread over
    many tasks, and the least and largest values in a file's footer rule it out for
    other keys. The ranges come from a sample, which reads ``df`` once more.
    """
    if cluster_by:
        order = [F.col(f"`{c}`") for c in [*(partition_by or []), *cluster_by]]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode(mode).option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def water_year(date: str) -> Column:
    """Year in which the water year of a date ends."""
    return F.year(date) + F.when(F.month(date) >= 10, 1).otherwise(0)


def write_by_water_year(df: DataFrame, path: str, date: str = "Date", station: str = "Site") -> str:
    """Partitioned by water year, so year filters skip whole folders, and in order of
    station and date inside (date alone without such a column), so station filters skip
    files and row groups."""
    keys = [c for c in (station, date) if c in df.columns]
    return write_parquet(df.withColumn("water_year", water_year(date)), path, ["water_year"], cluster_by=keys)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def store_split(df: DataFrame, path: str, cluster_by: list[str] | None = None, compression: str = "gzip") -> str:
    """Rows with a ``split`` column, one folder per split. Density and SWE
    targets are columns of the same rows. ``cluster_by`` as in ``write_parquet``."""
    return write_parquet(df, path, ["split"], compression=compression, cluster_by=cluster_by)


def run_id(records: list[dict]) -> str:
    """Digest of what identifies a run: models, variants, encoders, modes, seeds and the
    time stamp of its records."""
    named = [[str(r.get(c)) for c in ("model", "variant", "encoder", "mode", "seed", "timestamp")] for r in records]
    return hashlib.sha256(json.dumps(sorted(named)).encode()).hexdigest()[:16]


def record_experiments(spark: SparkSession, records: list[dict], path: str, run: str | None = None) -> str:
    """Append result records as JSON lines, once per run: a run (``run_id`` of its records
    unless one is given) owns one folder, written aside and renamed, so a repeated or
    broken-off call adds nothing twice and readers never see half a run."""
    rows = [tuple(record.get(field) for field in EXPERIMENTS.fieldNames()) for record in records]
    context = spark.sparkContext
    fs, configuration = context._jvm.org.apache.hadoop.fs, context._jsc.hadoopConfiguration()
    target, staged = (fs.Path(path.rstrip("/"), name) for name in (run or run_id(records), f"_staged-{uuid.uuid4().hex[:12]}"))
    files = target.getFileSystem(configuration)
    if files.exists(target):
        return path
    spark.createDataFrame(rows, EXPERIMENTS).coalesce(1).write.json(staged.toString())
    plain = context._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:  # refused where the same run has been recorded meanwhile
        fs.FileContext.getFileContext(target.getParent().toUri(), configuration).rename(files.makeQualified(staged), files.makeQualified(target), plain)
    except Py4JJavaError:
        files.delete(staged, True)
        if not files.exists(target):
            raise
    return path


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
