"""Train, validation and test splits without leakage between stations.

Sizes follow the usual stratified allocation; who goes where follows a hashed
order, so a split is the same on every run and every cluster size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import hashed_rank
from .sizes import broadcast_if_small

SPATIAL_SEED = 300
DEFAULT_SEED = 10


def _held_out(size: float | int, total: Column) -> Column:
    return F.lit(size).cast("bigint") if isinstance(size, int) else F.ceil(F.lit(size) * total).cast("bigint")


def _allocate(quotas: DataFrame, strata: str, available: str, held_out: float | int, name: str) -> DataFrame:
    """Adds ``name``: how many units of each stratum are held out. What stays is
    shared in proportion, remainders going to the largest fractions. Runs on one
    row per stratum."""
    everything = Window.partitionBy(F.lit(0))
    total, units = F.sum(available).over(everything), F.col(available)
    q = quotas.withColumn("__total", total).withColumn("__stay", F.col("__total") - _held_out(held_out, F.col("__total")))
    product = units * F.col("__stay")
    q = q.withColumn("__floor", F.floor(product / F.col("__total"))).withColumn("__rest", product % F.col("__total"))
    q = q.withColumn("__short", F.col("__stay") - F.sum("__floor").over(everything))
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__rest"), strata))
    stays = F.col("__floor") + F.when(order <= F.col("__short"), 1).otherwise(0)
    return q.withColumn(name, (units - stays).cast("bigint")).drop("__total", "__stay", "__floor", "__rest", "__short")


def assign_split(
    units: DataFrame,
    keys: list[str],
    strata: str | None,
    test: float | int,
    validation: float | None,
    seed: int | str,
) -> DataFrame:
    """Units (stations or rows) with a ``split`` column. In hashed order within a
    stratum the first go to test, the next to validation, the rest to train."""
    stratum = "__stratum"
    columns = units.columns
    units = units.withColumn(stratum, F.coalesce(F.col(strata).cast("string"), F.lit("")) if strata else F.lit("all"))
    quotas = units.groupBy(stratum).agg(F.count(F.lit(1)).alias("units"))
    quotas = _allocate(quotas, stratum, "units", test, "n_test").withColumn("__left", F.col("units") - F.col("n_test"))
    if validation is not None:
        quotas = _allocate(quotas, stratum, "__left", validation, "n_val")
    else:
        quotas = quotas.withColumn("n_val", F.lit(0))
    ranked = hashed_rank(units, [stratum], keys, seed, "__rank")
    placed = ranked.join(broadcast_if_small(quotas.select(stratum, "n_test", "n_val")), stratum)
    rank = F.col("__rank")
    split = F.when(rank <= F.col("n_test"), "test").when(rank <= F.col("n_test") + F.col("n_val"), "val").otherwise("train")
    return placed.select(*[F.col(f"`{c}`") for c in columns], split.alias("split"))


def split_rows(df: DataFrame, keys: list[str], test: float, seed: int | str, strata: str | None = None) -> DataFrame:
    """Row-wise split into train and test."""
    return assign_split(df, keys, strata, test, None, seed)


def split_by_station(df: DataFrame, station: str, test: float, seed: int | str) -> DataFrame:
    """Unstratified split of stations, carried to their rows."""
    stations = assign_split(df.select(station).distinct(), [station], None, test, None, seed)
    return df.join(stations, station)


@dataclass(frozen=True)
class SpatialSplitter:
    """Stations fully separated: a fifth test, an eighth of the rest validation,
    stratified by class. The seed is fixed whatever ``seed`` says."""

    seed: int = DEFAULT_SEED
    test: float | int = 0.2
    validation: float = 1 / 8

    def assign(self, stations: DataFrame) -> DataFrame:
        return assign_split(stations.select("Station_Name", "Snow_Class"), ["Station_Name"], "Snow_Class", self.test, self.validation, SPATIAL_SEED)

    def split(self, stations: DataFrame, df: DataFrame) -> DataFrame:
        return df.join(broadcast_if_small(self.assign(stations).select("Station_Name", "split")), "Station_Name")


@dataclass(frozen=True)
class HybridSplitter:
    """Test stations separated; the others train up to the cut-off year and
    validate after it."""

    seed: int = DEFAULT_SEED
    test: float | int = 150
    cutoff_year: int = 2021

    def assign(self, stations: DataFrame) -> DataFrame:
        return assign_split(stations.select("Station_Name", "Snow_Class"), ["Station_Name"], "Snow_Class", self.test, None, self.seed)

    def split(self, stations: DataFrame, df: DataFrame) -> DataFrame:
        joined = df.join(self.assign(stations).select("Station_Name", "split"), "Station_Name")
        by_year = F.when(F.year("Date") <= self.cutoff_year, "train").otherwise("val")
        return joined.withColumn("split", F.when(F.col("split") == "test", "test").otherwise(by_year))


SPLITTERS = {"spatial": SpatialSplitter, "hybrid": HybridSplitter}


def create_splitter(strategy: str, seed: int = DEFAULT_SEED, **options):
    if strategy not in SPLITTERS:
        raise ValueError(f"no split is called {strategy}; there are {strategies()}")
    return SPLITTERS[strategy](seed=seed, **options)


def strategies() -> list[str]:
    return list(SPLITTERS)


def leakage(df: DataFrame, station: str = "Station_Name", split: str = "split") -> DataFrame:
    """Stations that are part of more than one split; empty when all is well."""
    return df.groupBy(station).agg(F.count_distinct(split).alias("splits")).where(F.col("splits") > 1)


def features_and_target(df: DataFrame, target: str, geography: bool = True) -> DataFrame:
    """Target as ``label`` next to the features; ``geography=False`` drops the
    coordinates."""
    shaped = df.withColumnRenamed(target, "label")
    return shaped if geography else shaped.drop("Latitude", "Longitude")
