"""Frequencies, descriptive statistics, histograms and small reports."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .sizes import broadcast_if_small

def value_counts(df: DataFrame, column: Column, name: str, order: str = "count") -> DataFrame:
    """Rows per value; ``order`` is ``count`` (descending) or ``value``."""
    counts = df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(name) if order == "value" else counts.orderBy(F.desc("count"), name)


def class_share(df: DataFrame, column: str) -> DataFrame:
    """Count and whole percent per class; the window runs over the class table."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.bround(F.col("count") / total * 100, 0).cast("int"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(f"n_{c.lower()}") for c in columns])


def percentiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """Exact percentiles, one row per column, one output column per probability."""
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "column_name", "value")
    found = exact_quantiles(long, ["column_name"], "value", probabilities)
    return found.select("column_name", *[F.col("quantiles")[i].alias(f"p{p * 100:g}") for i, p in enumerate(probabilities)])


def describe(df: DataFrame, columns: list[str], probabilities: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact percentiles, maximum."""
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "column_name", "value")
    moments = long.groupBy("column_name").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return moments.join(percentiles(df, columns, list(probabilities)), "column_name")


def box_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """By class: quartiles, interquartile range, whisker ends (outermost values within 1.5
    ranges of the box) and the number of values beyond them."""
    found = exact_quantiles(df, [by], value, [0.25, 0.5, 0.75]).select(
        by,
        F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"),
    )
    v, iqr = F.col(value), F.col("q3") - F.col("q1")
    inside = v.between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return (
        df.select(by, value)
        .join(broadcast_if_small(found), by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
        .withColumn("iqr", F.col("q3") - F.col("q1"))
    )


def histogram(df: DataFrame, value: str, by: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between each group's extremes, the top edge folded into
    the last bin; empty bins are kept with count 0."""
    v = F.col(value)
    ranges = df.groupBy(by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    ranges = broadcast_if_small(ranges)
    place = F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")) * bins
    bin_no = F.coalesce(F.least(F.floor(place), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = (
        df.where(v.isNotNull())
        .select(by, value)
        .join(ranges, by)
        .groupBy(by, bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    every = ranges.where(F.col("lo").isNotNull()).select(
        by, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return every.join(counts, [by, "bin"], "left").select(
        by, "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"), F.coalesce("count", F.lit(0).cast("bigint")).alias("count")
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair (pairwise complete rows) from one
    aggregate, in long form."""
    pairs = list(combinations_with_replacement(columns, 2))
    corr = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [(a, b) for a in columns for b in columns]
    entries = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}|{b}`" if (a, b) in pairs else f"`{b}|{a}`").alias("corr"))
        for a, b in cells
    ]
    return corr.select(F.inline(F.array(*entries)))


def split_report(df: DataFrame, station: str = "Station_Name", split: str = "split") -> DataFrame:
    """Rows and stations per split, and how many stations there are overall."""
    per_station = df.groupBy(split, station).agg(F.count(F.lit(1)).alias("rows"))
    per_split = per_station.groupBy(split).agg(F.sum("rows").alias("samples"), F.count(station).alias("stations"))
    overall = per_station.agg(F.count_distinct(station).alias("total_stations"))
    return per_split.join(F.broadcast(overall))  # one row


def first_per_station(df: DataFrame, station: str, order: list[str], columns: list[str]) -> DataFrame:
    """First row per station in a stated order. Spark keeps only the leading row
    of each station before the shuffle, so a large station costs no more."""
    first = Window.partitionBy(station).orderBy(*order)
    numbered = df.withColumn("__n", F.row_number().over(first))
    return numbered.where(F.col("__n") == 1).select(station, *columns)


def best_per_group(df: DataFrame, by: list[str], score: str, tie: list[str]) -> DataFrame:
    """Row with the lowest score of each group, ties by the ``tie`` columns."""
    best = Window.partitionBy(*by).orderBy(score, *tie)
    return df.withColumn("__n", F.row_number().over(best)).where(F.col("__n") == 1).drop("__n")


def attribution_means(df: DataFrame, features: list[str], by: str | None = None) -> DataFrame:
    """Mean absolute attribution per feature (and class), from supplied columns."""
    keep = [by] if by else []
    long = df.select(*keep, *features).unpivot(keep, features, "feature", "attribution")
    means = long.groupBy(*keep, "feature").agg(F.avg(F.abs("attribution")).alias("importance"))
    return means.orderBy(*keep, F.desc("importance"), "feature")


def average_gain(df: DataFrame) -> DataFrame:
    """Gain per split, 0 where a feature never split, scaled to sum 1. The input
    has one row per feature."""
    gain = F.when(F.col("splits") != 0, F.col("gain") / F.col("splits")).otherwise(F.lit(0.0))
    total = F.sum("__gain").over(Window.partitionBy(F.lit(0)))
    return df.withColumn("__gain", gain).select("feature", (F.col("__gain") / total).alias("importance")).orderBy(F.desc("importance"), "feature")


def encoder_wins(trials: DataFrame) -> DataFrame:
    """How often each encoder has the lowest RMSE over (model, variant)."""
    place = F.rank().over(Window.partitionBy("model", "variant").orderBy("rmse"))
    return (
        trials.withColumn("__place", place)
        .where(F.col("__place") == 1)
        .groupBy("encoder")
        .agg(F.count(F.lit(1)).alias("wins"))
        .orderBy(F.desc("wins"), "encoder")
    )


def stack_measurements(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "Measurement", "Value")
