"""Climate history of a station: trailing means, annual temperature spread,
winter precipitation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import winter_end, winter_label, winter_of

DAY_US = 86_400_000_000

_US, _SLICE, _MAIN, _FIRST = "__us", "__slice", "__main", "__first_us"


def microseconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def lag_name(column: str, window: int) -> str:
    return f"{column}_lag_{window}d"


def _with_previous(df: DataFrame, station: str, ts: str, columns: list[str], reach_days: int, slice_days: int) -> DataFrame:
    """Rows of ``df`` with ``__prev_{column}``, the value of the station's previous
    row, laid out in time slices (see ``lag_features``)."""
    width, reach = slice_days * DAY_US, reach_days * DAY_US
    if width < reach:
        raise ValueError("slice_days must cover the longest window")
    us, part = F.col(_US), F.col(_SLICE)
    rows = df.withColumn(_US, microseconds(ts)).withColumn(_SLICE, F.floor(us / F.lit(width)))
    in_tail = us > (part + 1) * F.lit(width) - reach

    # One row per (station, slice): its last values, and its last values before the tail.
    head_us = F.when(~in_tail, us)
    edges = rows.groupBy(station, _SLICE).agg(
        F.min(us).alias("first"),
        F.max(us).alias("all_us"),
        F.max(head_us).alias("head_us"),
        *[F.max_by(c, us).alias(f"all_{c}") for c in columns],
        *[F.max_by(c, head_us).alias(f"head_{c}") for c in columns],
    )
    by_slice = Window.partitionBy(station).orderBy(_SLICE)
    adjacent = F.lag(_SLICE, 1).over(by_slice) == part - 1
    head_before = F.lag("head_us", 1).over(by_slice)

    def carried(name: str) -> Column:
        return (
            F.when(~adjacent, F.lag(f"all_{name}", 1).over(by_slice))
            .when(head_before.isNotNull(), F.lag(f"head_{name}", 1).over(by_slice))
            .otherwise(F.lag(f"all_{name}", 2).over(by_slice))
        )

    carry = edges.select(
        station,
        _SLICE,
        carried("us").alias(_US),
        F.min("first").over(Window.partitionBy(station)).alias(_FIRST),
        *[carried(c).alias(c) for c in columns],
        F.lit(False).alias(_MAIN),
    )

    others = [c for c in df.columns if c not in (station, *columns)]
    copies = F.when(in_tail, F.array(part, part + 1)).otherwise(F.array(part))
    spread = (
        rows.withColumn("__own", part)
        .withColumn(_SLICE, F.explode(copies))
        .withColumn(_MAIN, F.col("__own").eqNullSafe(part))
        .select(station, _SLICE, _US, _MAIN, *columns, *[F.when(F.col(_MAIN), F.col(f"`{c}`")).alias(c) for c in others])
    )
    # shuffled by slice even where the rows come partitioned by station; one order
    # for every window, so they are sorted once
    ordered = Window.partitionBy(station, _SLICE).orderBy(_US)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    laid = spread.unionByName(carry, allowMissingColumns=True).repartition(F.col(f"`{station}`"), F.col(_SLICE))
    # Seen in the same sorted slice, so it costs no shuffle: equal times stand side by side.
    named = F.col(f"`{station}`")
    twice = named.isNotNull() & (F.lag(_US, 1).over(ordered) == us)
    refusal = F.raise_error(F.concat_ws(" ", F.lit("several rows of station"), named.cast("string"), F.lit("at"), F.timestamp_micros(us).cast("string")))
    return laid.withColumns(
        {**{f"__prev_{c}": F.when(twice, refusal).when(us.isNotNull(), F.lag(c, 1).over(ordered)) for c in columns}, _FIRST: F.max(_FIRST).over(whole)}
    )


def _slice_days(longest: int, slice_days: int | None) -> int:
    return slice_days or max(4 * longest, 90)


def previous_row(df: DataFrame, station: str, ts: str, columns: list[str], slice_days: int | None = None) -> DataFrame:
    """``{column}_previous``: the value one row (not one day) back in the station. The job
    fails where a station has two rows at one time, since neither is the previous one."""
    laid = _with_previous(df, station, ts, columns, 0, _slice_days(0, slice_days))
    return laid.where(_MAIN).select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.col(f"__prev_{c}").alias(f"{c}_previous") for c in columns]
    )


def lag_features(
    df: DataFrame,
    station: str,
    ts: str,
    columns: list[str],
    windows: list[int],
    slice_days: int | None = None,
) -> DataFrame:
    """Trailing means ``{column}_lag_{w}d`` for every column and window.

    The value of the previous *row* of the station is averaged over the *time*
    range ``(t - w days, t]``; it stays missing until ``w`` days after the
    station's first row. (``station``, ``ts``) must be unique: the job fails where a
    station has two rows at one time (``quality.duplicate_keys`` lists them). Rows
    without a station are not held to that; a row without a time has no history.

    A station's history is cut into time slices so that a station with very many
    rows is not one task. Each row near the end of a slice is copied into the next
    one (that is all a window can reach), and one extra row per slice brings what
    lies further back: the last value before the reach, and the station's first
    timestamp. Extra and copied rows travel in the same single shuffle and are
    dropped after the windows. Inside a slice the mean is a difference of two
    growing sums, so the work is linear however dense the rows are.
    """
    longest = max(windows)
    laid = _with_previous(df, station, ts, columns, longest, _slice_days(longest, slice_days))
    ordered = Window.partitionBy(station, _SLICE).orderBy(_US)
    upto_now = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = {}
    for c in columns:
        p = f"__prev_{c}"
        running[f"__s_{c}"] = F.sum(p).over(upto_now)
        running[f"__n_{c}"] = F.count(p).over(upto_now)
        for w in windows:
            until = ordered.rangeBetween(Window.unboundedPreceding, -w * DAY_US)
            running[f"__s_{c}_{w}"] = F.sum(p).over(until)
            running[f"__n_{c}_{w}"] = F.count(p).over(until)
    summed = laid.withColumns(running).where(_MAIN)

    def mean(c: str, w: int) -> Column:
        total = F.col(f"__s_{c}") - F.coalesce(F.col(f"__s_{c}_{w}"), F.lit(0.0))
        count = F.col(f"__n_{c}") - F.col(f"__n_{c}_{w}")
        warm = F.col(_US) >= F.col(_FIRST) + F.lit(w * DAY_US)
        return F.when(warm & (count > 0), total / count)

    return summed.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[mean(c, w).alias(lag_name(c, w)) for c in columns for w in windows],
    )


def add_multiple_lags(df: DataFrame, columns: list[str], max_lag: int, station: str = "Station Name", ts: str = "datetime") -> DataFrame:
    """All windows from 1 to ``max_lag`` days for every column."""
    return lag_features(df, station, ts, columns, list(range(1, max_lag + 1)))


def monthly_mean_temperature(df: DataFrame, station: str, date: str) -> DataFrame:
    return df.groupBy(station, F.year(date).alias("year"), F.month(date).alias("month")).agg(F.avg("TAVG").alias("mean_temp"))


def temperature_difference(df: DataFrame, station: str, date: str) -> DataFrame:
    """Warmest minus coldest monthly mean per station and calendar year."""
    return (
        monthly_mean_temperature(df, station, date)
        .groupBy(station, "year")
        .agg((F.max("mean_temp") - F.min("mean_temp")).alias("Temp_Diff"))
    )


def attach_temperature_difference(df: DataFrame, station: str, date: str) -> DataFrame:
    spread = temperature_difference(df, station, date).withColumnRenamed("year", "__year")
    return df.withColumn("__year", F.year(date)).join(spread, [station, "__year"], "left").drop("__year")


def winter_totals(df: DataFrame, station: str, date: str) -> DataFrame:
    """Precipitation of December to February per station and winter end year.

    Missing unless all three months have rows (rows without a value count as
    present) and at least one value exists. Only partial aggregates: no distinct,
    no rescan of the table.
    """
    months = df.where(F.month(date).isin(12, 1, 2)).select(
        station, winter_of(F.col(date)).alias("winter_end"), F.month(date).alias("m"), "PRECIPITATION"
    )
    complete = F.bool_or(F.col("m") == 12) & F.bool_or(F.col("m") == 1) & F.bool_or(F.col("m") == 2)
    return months.groupBy(station, "winter_end").agg(F.when(complete, F.sum("PRECIPITATION")).alias("PPTWT"))


def winter_precipitation(df: DataFrame, station: str, date: str) -> DataFrame:
    """``winter_totals`` for every (station, last completed winter) of the rows."""
    keys = df.select(station, winter_label(F.col(date)).alias("winter"), winter_end(F.col(date)).alias("winter_end")).distinct()
    return keys.join(winter_totals(df, station, date), [station, "winter_end"], "left").select(station, "winter", "PPTWT")


def attach_winter_precipitation(df: DataFrame, station: str, date: str) -> DataFrame:
    """Each row gets the total of its last completed winter. The totals cover
    every winter there is, so a left join gives what an inner join with the full
    key set gives, without building that key set."""
    totals = winter_totals(df, station, date).withColumnRenamed("winter_end", "__winter_end")
    return df.withColumn("__winter_end", winter_end(F.col(date))).join(totals, [station, "__winter_end"], "left").drop("__winter_end")
