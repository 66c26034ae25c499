"""Readers with explicit schemas."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators.quality import nan_columns_to_null, require_columns
from ..schemas import EXPERIMENTS, RAW_OBSERVATIONS

# Variables requested at the source.
OBSERVED_VARIABLES = ("SWE", "MIN AIR TEMP", "MAX AIR TEMP", "AVG AIR TEMP", "SNOWDEPTH", "PRECIPITATION")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet with missing numbers as null. A given schema is enforced."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return nan_columns_to_null(df)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a fixed schema; no inference pass over the files."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return nan_columns_to_null(df)


def select_variables(df: DataFrame, variables: tuple[str, ...] = OBSERVED_VARIABLES) -> DataFrame:
    """Key columns and the requested variables; the rest never leaves the scan."""
    unknown = [v for v in variables if v not in OBSERVED_VARIABLES]
    if unknown:
        raise ValueError(f"Unknown variables: {unknown}. Available: {list(OBSERVED_VARIABLES)}")
    keys = [c for c in ("datetime", "site", "Station Name", "Elevation", "Snow_Class") if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in (*keys, *variables)])


def station_list(spark: SparkSession, triplets: list, names: list, elevations: list, classes: list) -> DataFrame:
    """Station tags from four lists of equal length."""
    if not len(triplets) == len(names) == len(elevations) == len(classes):
        raise ValueError("a station needs a triplet, a name, an elevation and a snow class: the lists differ in length")
    rows = [(t, n, float(e), c) for t, n, e, c in zip(triplets, names, elevations, classes)]
    return spark.createDataFrame(rows, "site string, `Station Name` string, Elevation double, Snow_Class string")


def ingest_daily_records(records: DataFrame, stations: DataFrame, start: str, end: str) -> DataFrame:
    """Daily records of all stations, tagged with name, elevation and class.

    ``records`` is one multi-file scan (``site``, ``datetime``, variables). A
    station without records adds no row; a record of an unlisted site is left
    out. The date range reaches the scan as a pushed filter.
    """
    require_columns(records, ["site", "datetime"])
    ranged = records.where(F.col("datetime").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return ranged.join(stations, "site")


def union_stations(frames: list[DataFrame]) -> DataFrame:
    """Station frames below each other; a variable one lacks becomes null."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def shape_station_metadata(scraped: DataFrame, snow_class: Column | None = None) -> DataFrame:
    """Scraped station list to ``site_name, latitude, longitude, elevation,
    triplets, snowclass``. The class comes from the grid lookup (column
    ``snow_class`` unless given); ocean cells count as maritime."""
    name = F.col("snow_class") if snow_class is None else snow_class
    return (
        scraped.where(F.col("ntwk") == "SNTL")
        .withColumns(
            {
                "triplets": text.compose_triplet(text.station_id(F.col("site_name")), F.col("state"), F.col("ntwk")),
                "snowclass": text.capitalise(name),
            }
        )
        .select("site_name", "lat", "lon", "elev", "triplets", "snowclass")
        .withColumnsRenamed({"lat": "latitude", "lon": "longitude", "elev": "elevation"})
        .replace({"Ocean": "Maritime"}, subset=["snowclass"])
    )


def read_raw_observations(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet(spark, path, RAW_OBSERVATIONS)


def load_split(spark: SparkSession, path: str, final_eval: bool = True) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows of a stored split. ``final_eval`` gives
    train and validation together against test, else train against validation.
    The split is a partition column, so the other parts are never read."""
    rows = spark.read.parquet(path)
    if final_eval:
        return rows.where(F.col("split").isin("train", "val")), rows.where(F.col("split") == "test")
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val")


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).schema(EXPERIMENTS).json(path)  # a folder per run


def collect_lag_results(spark: SparkSession, folder: str, pattern: str = r"climate_(\d+)d_tune_target") -> DataFrame:
    """RMSE per lag from stored results, the lag read from the file path; files
    whose path names no lag are left out."""
    found = spark.read.option("recursiveFileLookup", True).schema(EXPERIMENTS).json(folder)
    lag = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return (
        found.select(F.nullif(lag, F.lit("")).cast("int").alias("lag"), F.col("rmse"))
        .where(F.col("lag").isNotNull())
        .orderBy("lag")
    )


@dataclass(frozen=True)
class ParamSpec:
    """Range of one hyperparameter."""

    type: str
    low: float
    high: float
    step: int | None = None
    log: bool = False

    def __post_init__(self):
        if self.type not in ("int", "float"):
            raise ValueError(f"a setting is drawn as int or float, not as {self.type}")


@dataclass(frozen=True)
class SearchConfig:
    settings: dict
    models: dict[str, dict[str, ParamSpec]]


def default_search_space() -> str:
    return os.path.join(os.path.dirname(os.path.dirname(__file__)), "config", "search_space.json")


def load_search_space(path: str | None = None) -> SearchConfig:
    """Search space with type checks, from JSON (or YAML where a parser exists)."""
    path = path or default_search_space()
    if not os.path.exists(path):
        raise FileNotFoundError(f"no search space is stored at {path}")
    with open(path, encoding="utf-8") as file:
        content = file.read()
    try:
        if path.endswith((".yaml", ".yml")):
            import yaml

            raw = yaml.safe_load(content)
        else:
            raw = json.loads(content)
        models = {
            model: {
                name: ParamSpec(
                    spec["type"], float(spec["low"]), float(spec["high"]), spec.get("step"), bool(spec.get("log", False))
                )
                for name, spec in params.items()
            }
            for model, params in raw["models"].items()
        }
        return SearchConfig(raw["global"], models)
    except (KeyError, TypeError, json.JSONDecodeError) as error:
        raise ValueError(f"{path} does not hold a search space: {error}") from error
