"""Unit conversion and small arithmetic, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import FOOT_IN_METRES, INCH_FACTORS


def fahrenheit_to_celsius(temperature: Column) -> Column:
    return (temperature - 32) * F.lit(5 / 9)


def inches_to_metric(inches: Column, unit: str) -> Column:
    """``unit`` is ``meters``, ``cm`` or ``mm``; anything else is an error."""
    if unit not in INCH_FACTORS:
        raise ValueError(f"{unit} is not a metric length unit here; there are {', '.join(INCH_FACTORS)}")
    return inches * F.lit(INCH_FACTORS[unit])


def feet_to_metres(feet: Column) -> Column:
    return feet * F.lit(FOOT_IN_METRES)


def snow_density(swe: Column, depth: Column, scale: float = 1.0) -> Column:
    """SWE over depth; ``scale=1000`` gives kg/m³. Zero depth gives null."""
    ratio = F.try_divide(swe, depth)
    return ratio if scale == 1.0 else ratio * F.lit(float(scale))


def round_half_even(value: Column, digits: int = 4) -> Column:
    """Rounding for display, ties to the even digit."""
    return F.bround(value, digits)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
