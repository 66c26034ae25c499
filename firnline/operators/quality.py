"""Conditional nulling, row filters and missing-value profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantile
from .sizes import broadcast_if_small

TEMPERATURES = ("TMIN", "TAVG", "TMAX")


def require_columns(df: DataFrame, columns) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def nan_columns_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are null everywhere downstream; NaN is turned into null once."""
    doubles = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(
        *[
            (F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in doubles else F.col(f"`{c}`"))
            for c in df.columns
        ]
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once. History operators need (station, time) to
    be unique; this shows what to aggregate or deduplicate first."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


# -- conditional nulling ------------------------------------------------------


def null_unordered_temperatures(df: DataFrame) -> DataFrame:
    """Unless TMIN < TAVG < TMAX holds strictly, all three go missing. A missing
    value makes the comparison false, so it clears the other two as well."""
    ordered = F.coalesce((F.col("TMIN") < F.col("TAVG")) & (F.col("TAVG") < F.col("TMAX")), F.lit(False))
    return df.withColumns({c: F.when(ordered, F.col(c)) for c in TEMPERATURES})


def null_extreme_temperatures(df: DataFrame, low: float = -40.0, high: float = 40.0) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).between(low, high), F.col(c)) for c in TEMPERATURES})


def null_bad_precipitation(df: DataFrame) -> DataFrame:
    """Null below 0 or above ``threshold``; a missing threshold never nulls."""
    p = F.col("PRECIPITATION")
    bad = F.coalesce((p < 0) | (p > F.col("threshold")), F.lit(False))
    return df.withColumn("PRECIPITATION", F.when(~bad, p))


def null_invalid_values(df: DataFrame) -> DataFrame:
    """Temperature order, then temperature range, then precipitation."""
    require_columns(df, [*TEMPERATURES, "PRECIPITATION", "threshold"])
    return df.transform(null_unordered_temperatures).transform(null_extreme_temperatures).transform(null_bad_precipitation)


def precipitation_threshold(df: DataFrame, station: str, probability: float = 0.999) -> DataFrame:
    """Exact interpolated quantile of precipitation per station."""
    return exact_quantile(df, [station], "PRECIPITATION", probability, "threshold")


def attach_precipitation_threshold(df: DataFrame, station: str, probability: float = 0.999) -> DataFrame:
    """The station's threshold beside every row. The thresholds, a row per station, are
    computed once; while they are few the rows are not shuffled for them."""
    return df.join(broadcast_if_small(precipitation_threshold(df, station, probability)), station, "left")


# -- filters ------------------------------------------------------------------


def minimum_snow(depth: str = "Snow_Depth", swe: str = "SWE") -> Column:
    return (F.col(depth) > 5) & (F.col(swe) > 3)


def physical_density(density: str = "Snow_Density") -> Column:
    return F.col(density).between(0.05, 0.6)


def survey_quality(levels: list[str]) -> Column:
    return F.col("CONFIDENCE_LEVEL").isin(*levels) & (F.col("DENSITY") > 0) & (F.col("DENSITY") < 1)


def not_class(column: str, name: str) -> Column:
    """A missing class passes; complete-case filtering removes it later."""
    return F.coalesce(F.col(column) != name, F.lit(True))


def outside_gap(date: Column, start: str, end: str) -> Column:
    """Keeps dates before ``start`` and after ``end``; both ends are excluded."""
    return ~date.between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=columns)


def in_month(date: Column, month: int) -> Column:
    return F.month(date) == month


def up_to_year(date: Column, year: int) -> Column:
    return F.year(date) <= year


def keep_stations(df: DataFrame, stations: DataFrame, column: str = "Station_Name") -> DataFrame:
    return df.join(stations.select(column), column, "left_semi")


def drop_stations(df: DataFrame, stations: DataFrame, column: str = "Station_Name") -> DataFrame:
    return df.join(stations.select(column), column, "left_anti")


# -- profiles -----------------------------------------------------------------


def missing_profile(df: DataFrame) -> DataFrame:
    """One row per column with its number of missing values, in one pass."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "missing")


def merge_report(before: DataFrame, after: DataFrame, site: str, located: list[str]) -> DataFrame:
    """Rows and distinct sites before and after a merge, and what stayed unlocated."""
    has_all = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in located])
    left = before.agg(F.count(F.lit(1)).alias("rows_before"), F.count_distinct(site).alias("sites_before"))
    right = after.agg(
        F.count(F.lit(1)).alias("rows_after"),
        F.count_distinct(F.when(has_all, F.col(site))).alias("sites_located"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c.lower()}") for c in located],
    )
    return left.join(F.broadcast(right))  # one row each
