"""The row-wise steps on a stream of station-days.

Unit conversion, water-year days, filters and the regressions keep no state, so
the same functions serve a streaming DataFrame. Climate history needs a station's
past and stays in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import density, swe
from ..plans import cleaning

MODELS = ["Jonas", "Pistochi", "Sturm"]


def score_station_days(raw: DataFrame) -> DataFrame:
    """Raw station-days (batch or stream) to densities and SWE by model."""
    derived = cleaning.derive(raw).withColumn("PPTWT", F.lit(None).cast("double"))
    kept = cleaning.shape(cleaning.keep_snow(derived)).drop("PPTWT")
    return kept.transform(density.with_densities, MODELS).transform(swe.with_swe_products, MODELS)
