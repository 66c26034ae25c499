"""Raw station-days to the analysis table, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, units
from ..operators import climate, quality
from ..operators.sizes import broadcast_if_small

RAW_DROPPED = ("SNOWDEPTH", "AVG AIR TEMP", "MIN AIR TEMP", "MAX AIR TEMP", "geometry", "datasource")
LAG_COLUMNS = ("TAVG", "PRECIPITATION")


def derive(raw: DataFrame) -> DataFrame:
    """Metric units, water-year days, calendar parts and winter label."""
    day = F.col("datetime")
    return quality.nan_columns_to_null(raw).withColumns(
        {
            "Station_Name": text.station_name(F.col("Station Name")),
            "SWE": units.inches_to_metric(F.col("SWE"), "cm"),
            "Snow_Depth": units.inches_to_metric(F.col("SNOWDEPTH"), "cm"),
            "Elevation": units.feet_to_metres(F.col("Elevation")),
            "TAVG": units.fahrenheit_to_celsius(F.col("AVG AIR TEMP")),
            "TMAX": units.fahrenheit_to_celsius(F.col("MAX AIR TEMP")),
            "TMIN": units.fahrenheit_to_celsius(F.col("MIN AIR TEMP")),
            "PRECIPITATION": units.inches_to_metric(F.col("PRECIPITATION"), "cm"),
            "Sturm_DOWY": dates.day_number(day, 10, "Sturm"),
            "Pistochi_DOWY": dates.day_number(day, 11),
            "DOWY": dates.day_number(day, 10),
            "month": F.month(day),
            "year": F.year(day),
            "winter": dates.winter_label(day),
            "winter_end": dates.winter_end(day),
            "winter_start": dates.winter_end(day) - 1,
        }
    )


def control(derived: DataFrame) -> DataFrame:
    """Station threshold, then invalid values to null."""
    return derived.transform(quality.attach_precipitation_threshold, "Station Name").transform(quality.null_invalid_values)


def add_history(controlled: DataFrame, windows: list[int]) -> DataFrame:
    """Trailing means, annual spread and winter totals. All are computed from
    every row, before the snow filters, so low-snow days feed the history. Without
    windows the rows are not laid out in time slices at all."""
    with_lags = climate.lag_features(controlled, "Station Name", "datetime", list(LAG_COLUMNS), windows) if windows else controlled
    spread = climate.temperature_difference(controlled, "Station Name", "datetime")
    totals = climate.winter_totals(controlled, "Station_Name", "datetime")
    return with_lags.join(spread, ["Station Name", "year"], "left").join(totals, ["Station_Name", "winter_end"], "left")


def keep_snow(history: DataFrame) -> DataFrame:
    """Minimum snow, density, physical density band; winter totals to mm."""
    return (
        history.where(quality.minimum_snow())
        .withColumn("Snow_Density", units.snow_density(F.col("SWE"), F.col("Snow_Depth")))
        .withColumn("PPTWT", F.col("PPTWT") * 10)
        .where(quality.physical_density())
    )


def shape(kept: DataFrame) -> DataFrame:
    """Final names; working columns dropped."""
    units_columns = [c for c in kept.columns if c.endswith("_units")]
    return kept.withColumnsRenamed({"datetime": "Date", "site": "Site"}).drop(
        *RAW_DROPPED, *units_columns, "threshold", "year", "month", "Station Name", "TAVG", "TMIN", "TMAX",
        "PRECIPITATION", "winter_start", "winter_end", "winter",
    )


def clean_observations(raw: DataFrame, windows: list[int] | None = None) -> DataFrame:
    windows = list(range(1, 31)) if windows is None else windows
    return raw.transform(derive).transform(control).transform(add_history, windows).transform(keep_snow).transform(shape)


def attach_coordinates(clean: DataFrame, stations: DataFrame) -> DataFrame:
    """Latitude and longitude by site triplet."""
    place = stations.select(F.col("triplets"), F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"))
    place = broadcast_if_small(place)  # a row per station
    return clean.join(place, clean.Site == place.triplets, "left").drop("triplets")


def station_table(clean: DataFrame) -> DataFrame:
    """First row of every station (by date, then site): name, class, elevation."""
    first = Window.partitionBy("Station_Name").orderBy("Date", "Site")
    return (
        clean.select("Snow_Class", "Station_Name", "Elevation", "Date", "Site")
        .withColumn("__n", F.row_number().over(first))
        .where(F.col("__n") == 1)
        .select("Snow_Class", "Station_Name", "Elevation")
    )


def clean_survey_maine(survey: DataFrame, levels: tuple[str, ...] = ("GOOD",)) -> DataFrame:
    """Survey rows that carry ``Snow_Class`` and ``Elevation`` already (looked up
    on the grids), brought to the analysis columns and to complete cases."""
    day = F.col("Date")
    return (
        survey.where(quality.survey_quality(list(levels)))
        .withColumn("Date", dates.parse_date(F.col("SURVEY_DATE_TEXT")))
        .withColumns(
            {
                "SWE": units.inches_to_metric(F.col("WATER"), "cm"),
                "Snow_Depth": units.inches_to_metric(F.col("DEPTH"), "cm"),
                "Sturm_DOWY": dates.sturm_day(day),
                "Pistochi_DOWY": dates.day_of_water_year(day, 11),
                "DOWY": dates.day_of_water_year(day, 10),
            }
        )
        .withColumn("Snow_Density", units.snow_density(F.col("SWE"), F.col("Snow_Depth")))
        .where(quality.not_class("Snow_Class", "Ocean") & quality.minimum_snow() & quality.physical_density())
        .transform(quality.complete_cases)
        .withColumnsRenamed({"LATITUDE": "Latitude", "LONGITUDE": "Longitude"})
        .drop("SURVEY_DATE_TEXT", "WATER", "DEPTH", "DENSITY", "CONFIDENCE_LEVEL")
    )


def clean_survey_bc(survey: DataFrame) -> DataFrame:
    """Survey already in metric units, with a class looked up on the grid."""
    day = F.col("Date")
    return (
        survey.withColumn("Date", dates.parse_date(F.col("Date")))
        .withColumns(
            {
                "SWE": F.col("SWE_cm"),
                "Snow_Depth": F.col("SD"),
                "Snow_Density": F.col("rho_g_cm3"),
                "Sturm_DOWY": dates.sturm_day(day),
                "Pistochi_DOWY": dates.day_of_water_year(day, 11),
                "DOWY": dates.day_of_water_year(day, 10),
            }
        )
        .transform(quality.complete_cases)
        .withColumnsRenamed({"LATITUDE": "Latitude", "LONGITUDE": "Longitude", "ELEVATION": "Elevation"})
        .drop("SWE_cm", "SD", "rho_g_cm3")
    )
