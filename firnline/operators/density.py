"""Bulk density regressions as column expressions (g/cm³)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    JONAS_BAND_EDGES_M,
    JONAS_PARAMETERS,
    PISTOCCHI_BASE,
    PISTOCCHI_DAY_SHIFT,
    STURM_PARAMETERS,
)
from ..functions.dates import validate_day, validate_sturm_day
from ..functions.text import literal_map, month_number, snow_class_name


def sturm_density(depth_cm: Column, day: Column, snow_class: Column) -> Column:
    """``day`` is a valid Sturm day; a missing day or unknown class is missing."""
    name = snow_class_name(snow_class)

    def parameter(key: str) -> Column:
        return F.try_element_at(literal_map({c: p[key] for c, p in STURM_PARAMETERS.items()}), name)

    rho_max, rho_0 = parameter("rho_max"), parameter("rho_0")
    settled = F.lit(1) - F.exp(-parameter("k1") * depth_cm - parameter("k2") * day)
    return (rho_max - rho_0) * settled + rho_0


def sturm_density_checked(depth_cm: Column, day: Column, snow_class: Column, mode: str = "permissive") -> Column:
    """As ``sturm_density``, for a day given as number, text or date."""
    return sturm_density(depth_cm, validate_sturm_day(day, mode), snow_class)


def elevation_band(elevation_m: Column) -> Column:
    """0, 1 or 2. A missing elevation falls into the top band."""
    low, high = JONAS_BAND_EDGES_M
    return F.when(elevation_m < low, 0).when((elevation_m >= low) & (elevation_m < high), 1).otherwise(2)


def jonas_density(depth_m: Column, month: Column, elevation_m: Column) -> Column:
    """``month`` is 1 to 12; an empty cell of the table gives a missing density."""
    cell = month * 3 + elevation_band(elevation_m)

    def parameter(index: int) -> Column:
        table = {m * 3 + band: float(ab[index]) for m, bands in JONAS_PARAMETERS.items() for band, ab in enumerate(bands) if ab}
        return F.try_element_at(literal_map(table), cell)

    return (parameter(0) * depth_m + parameter(1)) / 1000


def jonas_density_checked(depth_m: Column, month: Column, elevation_m: Column, mode: str = "permissive") -> Column:
    """As ``jonas_density``, for a month given as number or name."""
    return jonas_density(depth_m, month_number(month, mode), elevation_m)


def pistocchi_density(day: Column) -> Column:
    """``day`` counts from 1 November."""
    return (F.lit(PISTOCCHI_BASE) + (day + PISTOCCHI_DAY_SHIFT)) / 1000


def pistocchi_density_checked(day: Column, mode: str = "permissive") -> Column:
    return pistocchi_density(validate_day(day, 11, mode))


# A density model is a name and an expression over the clean observation columns.
DENSITY_MODELS: dict[str, Callable[[], Column]] = {
    "Jonas": lambda: jonas_density(F.col("Snow_Depth") * 0.01, F.month("Date"), F.col("Elevation")),
    "Pistochi": lambda: pistocchi_density(F.col("Pistochi_DOWY")),
    "Sturm": lambda: sturm_density(F.col("Snow_Depth"), F.col("Sturm_DOWY"), F.col("Snow_Class")),
}


def register_density_model(name: str, expression: Callable[[], Column]) -> None:
    DENSITY_MODELS[name] = expression


def with_densities(df: DataFrame, models: list[str] | None = None) -> DataFrame:
    """One ``{model}_Density`` column per model."""
    names = models or list(DENSITY_MODELS)
    unknown = [n for n in names if n not in DENSITY_MODELS]
    if unknown:
        raise ValueError(f"Unknown density models: {unknown}. Available: {list(DENSITY_MODELS)}")
    return df.withColumns({f"{n}_Density": DENSITY_MODELS[n]() for n in names})
