"""Nearest-cell lookup on a regular grid: index arithmetic and an equi-join."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import current_class_name


@dataclass(frozen=True)
class GridHeader:
    """Centre of the first cell, cell size (``dy`` may be negative) and extent."""

    x0: float
    y0: float
    dx: float
    dy: float
    nx: int
    ny: int


def _axis(value: Column, start, step, cells) -> tuple[Column, Column]:
    """Nearest index and whether the value lies between the outer cell centres.
    A tie between two cells goes to the larger index."""
    place = (value - start) / step
    last = cells - 1
    return F.least(F.floor(place + 0.5), last).cast("int"), place.between(F.lit(0), last)


def with_cell(df: DataFrame, header: GridHeader, x: str = "Longitude", y: str = "Latitude") -> DataFrame:
    """Adds ``ix``, ``iy`` (null outside the grid) and ``in_bounds``."""
    ix, inside_x = _axis(F.col(x), F.lit(header.x0), F.lit(header.dx), F.lit(header.nx))
    iy, inside_y = _axis(F.col(y), F.lit(header.y0), F.lit(header.dy), F.lit(header.ny))
    inside = F.coalesce(inside_x & inside_y, F.lit(False))
    return df.withColumns({"ix": F.when(inside, ix), "iy": F.when(inside, iy), "in_bounds": inside})


def attach_nearest(df: DataFrame, grid: DataFrame, header: GridHeader, values: list[str], x: str = "Longitude", y: str = "Latitude") -> DataFrame:
    """Values of the nearest cell. The join type is left to Spark: a fine grid of
    a continent is far beyond what may be broadcast. Points off the grid have no cell to
    look up and go past the join, so that they do not meet in one task by their null key."""
    located = with_cell(df, header, x, y)
    cells = grid.select("ix", "iy", *values)
    found = located.where("in_bounds").join(cells, ["ix", "iy"], "left").select(*df.columns, "in_bounds", *values)
    missing = [F.lit(None).cast(cells.schema[v].dataType).alias(v) for v in values]
    return found.unionByName(located.where("not in_bounds").select(*df.columns, "in_bounds", *missing))


def attach_snow_class(df: DataFrame, grid: DataFrame, codes: DataFrame, header: GridHeader, x: str = "Longitude", y: str = "Latitude", strict: bool = False) -> DataFrame:
    """Adds ``snow_class`` by nearest cell, with newer names replaced. Points off
    the grid get null and ``in_bounds`` false, or fail the job when ``strict``."""
    named = grid.join(codes.select("code", "meaning"), "code").withColumn(
        "snow_class", current_class_name(F.col("meaning"))
    )
    found = attach_nearest(df, named, header, ["snow_class"], x, y)
    if strict:
        error = F.raise_error(F.lit("point beyond the outer cell centres of the grid")).cast("string")
        found = found.withColumn("snow_class", F.when(~F.col("in_bounds"), error).otherwise(F.col("snow_class")))
    return found


def header_of(grid: DataFrame, x0: float, y0: float, dx: float, dy: float) -> GridHeader:
    """Extent from the cell indices (one small aggregate)."""
    row = grid.agg(F.max("ix").alias("mx"), F.max("iy").alias("my")).first()
    return GridHeader(x0, y0, dx, dy, int(row.mx) + 1, int(row.my) + 1)
