"""Snow water equivalent as column expressions (cm)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HILL_ABLATION, HILL_ACCUMULATION, HILL_BLEND_RATE, HILL_PEAK_DAY
from .density import jonas_density_checked, pistocchi_density_checked, sturm_density_checked

ALGORITHMS = ("default", "hill", "sturm", "jonas", "pistochi")


def _power_law(coefficients, pptwt: Column, td: Column, day: Column, depth_mm: Column) -> Column:
    factor, depth_power, precipitation_power, difference_power, day_power = coefficients
    return (
        (F.lit(factor) * F.pow(depth_mm, F.lit(depth_power)))
        * F.pow(pptwt, F.lit(precipitation_power))
        * F.pow(td, F.lit(difference_power))
        * F.pow(day, F.lit(day_power))
    )


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def hill_parts(pptwt: Column, td: Column, day: Column, depth_mm: Column) -> tuple[Column, Column]:
    """Accumulation and ablation SWE in mm. When either is not a finite number
    (zero or negative base) both are missing."""
    accumulation = _power_law(HILL_ACCUMULATION, pptwt, td, day, depth_mm)
    ablation = _power_law(HILL_ABLATION, pptwt, td, day, depth_mm)
    usable = _finite(accumulation) & _finite(ablation)
    return F.when(usable, accumulation), F.when(usable, ablation)


def hill_blend(accumulation: Column, ablation: Column, day: Column, peak_day: int = HILL_PEAK_DAY) -> Column:
    """Smooth change from accumulation to ablation around the peak day, in mm."""
    turn = F.tanh(F.lit(HILL_BLEND_RATE) * (day - F.lit(peak_day)))
    return accumulation * 0.5 * (F.lit(1) - turn) + ablation * 0.5 * (F.lit(1) + turn)


def hill_swe(pptwt: Column, td: Column, day: Column, depth_mm: Column) -> Column:
    accumulation, ablation = hill_parts(pptwt, td, day, depth_mm)
    return hill_blend(accumulation, ablation, day) / 10


def swe_from_density(depth_cm: Column, density: Column) -> Column:
    return depth_cm * density


def swe(algorithm: str, mode: str = "permissive", **columns: Column) -> Column:
    """SWE by algorithm name (any case), with that algorithm's own units:
    depth in cm, but in mm for ``hill`` and in m for ``jonas``."""
    name = algorithm.lower()
    missing = F.lit(None).cast("double")
    depth = columns.get("snow_depth", missing)
    day = columns.get("DOY", F.lit(None).cast("string"))
    if name == "default":
        return swe_from_density(depth, columns.get("snow_density", missing))
    if name == "hill":
        return hill_swe(columns["pptwt"], columns["TD"], columns["DOY"], depth)
    if name == "sturm":
        snow_class = columns.get("snow_class", F.lit(None).cast("string"))
        return swe_from_density(depth, sturm_density_checked(depth, day, snow_class, mode))
    if name == "jonas":
        month = columns.get("month", F.lit(None).cast("string"))
        return swe_from_density(depth * 100, jonas_density_checked(depth, month, columns.get("elevation", missing), mode))
    if name == "pistochi":
        return swe_from_density(depth, pistocchi_density_checked(day, mode))
    raise ValueError(f"no SWE method is called {algorithm}")


def swe_by_name(algorithm: Column, choices: dict[str, Column]) -> Column:
    """Algorithm chosen per row; an unknown name is missing."""
    unknown = [c for c in choices if c not in ALGORITHMS]
    if unknown:
        raise ValueError(f"no SWE method is called {unknown}")
    result = F.lit(None).cast("double")
    for name, value in choices.items():
        result = F.when(F.lower(algorithm) == name, value).otherwise(result)
    return result


def with_swe_products(df: DataFrame, models: list[str], depth: str = "Snow_Depth") -> DataFrame:
    """``{model}_SWE`` from each ``{model}_Density``."""
    return df.withColumns({f"{m}_SWE": swe_from_density(F.col(depth), F.col(f"{m}_Density")) for m in models})


def with_hill_swe(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "Hill_SWE", hill_swe(F.col("PPTWT"), F.col("Temp_Diff"), F.col("DOWY"), F.col("Snow_Depth") * 10)
    )
