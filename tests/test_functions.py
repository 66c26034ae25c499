import datetime

import pytest
from pyspark.sql import functions as F

from firnline.functions import dates, text, units
from firnline.functions.constants import JONAS_PARAMETERS, STURM_PARAMETERS

from conftest import one


def ts(value):
    return F.lit(value).cast("timestamp")


def test_fahrenheit(spark):
    assert one(spark, units.fahrenheit_to_celsius(F.lit(32.0))) == 0
    assert abs(one(spark, units.fahrenheit_to_celsius(F.lit(212.0))) - 100) < 1e-9
    assert one(spark, units.fahrenheit_to_celsius(F.lit(-40.0))) == -40


def test_lengths(spark):
    assert one(spark, units.feet_to_metres(F.lit(1.0))) == 0.3048
    assert one(spark, units.feet_to_metres(F.lit(10.0))) == 3.048
    assert one(spark, units.inches_to_metric(F.lit(10.0), "meters")) == 0.254
    assert one(spark, units.inches_to_metric(F.lit(10.0), "cm")) == 25.4
    assert one(spark, units.inches_to_metric(F.lit(10.0), "mm")) == 254.0
    with pytest.raises(ValueError):
        units.inches_to_metric(F.lit(10.0), "invalid_unit")


@pytest.mark.parametrize("day,origin,want", [("2023-10-01", 10, 1), ("2023-10-02", 10, 2), ("2024-09-30", 10, 366), ("2023-09-30", 10, 365), ("2023-11-15", 11, 15), ("2023-12-01", 11, 31), ("2024-02-29", 10, 152)])
def test_day_of_water_year(spark, day, origin, want):
    assert one(spark, dates.day_number(ts(day), origin)) == want


@pytest.mark.parametrize("day,want", [("2023-10-01", -92), ("2022-10-01", -92), ("2024-01-01", 1), ("2023-12-31", -1), ("2024-02-01", 32), ("1996-11-15", -47), ("2024-06-30", 182), ("2023-06-30", 181), ("2024-07-01", None), ("2024-09-30", None), ("2023-12-31 23:59:59", -1)])
def test_sturm_day(spark, day, want):
    assert one(spark, dates.day_number(ts(day), algorithm="Sturm")) == want


def test_day_dispatch_errors(spark):
    with pytest.raises(TypeError):
        dates.day_number("not-a-date")
    with pytest.raises(ValueError):
        dates.day_number(F.col("x"), algorithm="invalid_algorithm")


@pytest.mark.parametrize("value,want,reason", [("1", 1, None), ("366", 366, None), ("0", None, "out of bounds"), ("367", None, "out of bounds"), ("10.5", None, "not a whole number"), ("100.0", 100, None), (" 7 ", 7, None), ("2023-12-01", 31, None), ("12/01/2023", 31, None), ("junk", None, "not a date"), ("nan", None, "not a whole number"), (None, None, "missing")])
def test_validate_day(spark, value, want, reason):
    column = F.lit(value).cast("string")
    assert one(spark, dates.validate_day(column, 11)) == want
    assert one(spark, dates.validate_day_reason(column)) == reason


@pytest.mark.parametrize("value,want,reason", [("-50", -50, None), ("0", 0, None), ("150", 150, None), ("100", 100, None), ("-100", None, "out of bounds"), ("200", None, "out of bounds"), ("10.5", None, "not a whole number"), ("2023-10-01", -92, None), ("1987-07-01", None, None)])
def test_validate_sturm_day(spark, value, want, reason):
    assert one(spark, dates.validate_sturm_day(F.lit(value))) == want
    assert one(spark, dates.validate_sturm_day_reason(F.lit(value))) == reason


def test_strict_validation_fails_the_job(spark):
    assert one(spark, dates.validate_day(F.lit("5"), 10, "strict")) == 5
    with pytest.raises(Exception, match="out of bounds"):
        one(spark, dates.validate_day(F.lit("400"), 10, "strict"))
    with pytest.raises(ValueError):
        dates.validate_day(F.lit("1"), 13)
    with pytest.raises(ValueError):
        dates.validate_day(F.lit("1"), 10, "lenient")


def test_snow_class(spark):
    for name in STURM_PARAMETERS:
        assert one(spark, text.snow_class_name(F.lit(name.upper()))) == name
    assert one(spark, text.snow_class_name(F.lit("invalid_class"))) is None


def test_parameter_tables():
    assert len(STURM_PARAMETERS) == 5 and STURM_PARAMETERS["tundra"]["k2"] == 0.0049
    assert len(JONAS_PARAMETERS) == 12 and all(len(bands) == 3 for bands in JONAS_PARAMETERS.values())
    assert JONAS_PARAMETERS[1][2] == (52, 206) and JONAS_PARAMETERS[3][0] == (3, 333)
    assert JONAS_PARAMETERS[6] == (None, None, (8, 452)) and JONAS_PARAMETERS[8] == (None, None, None)


@pytest.mark.parametrize("value,want", [("1", 1), ("12", 12), ("01", 1), ("deC", 12), ("JaN", 1), (" may ", 5), ("january", 1), ("janu", None), ("13", None), ("0", None), ("abc", None)])
def test_month_number(spark, value, want):
    assert one(spark, text.month_number(F.lit(value))) == want


def test_month_name_and_strict(spark):
    assert one(spark, text.month_name(F.lit(3))) == "march"
    with pytest.raises(Exception, match="Invalid month"):
        one(spark, text.month_number(F.lit("13"), "strict"))


def test_station_text(spark):
    raw = F.lit("Banner Summit (312)")
    assert one(spark, text.station_name(raw)) == "Banner Summit"
    assert one(spark, text.station_id(raw)) == "312"
    assert one(spark, text.station_id(F.lit("Banner Summit"))) is None
    triplet = text.compose_triplet(F.lit("312"), F.lit("ID"), F.lit("SNTL"))
    assert one(spark, triplet) == "312:ID:SNTL" and one(spark, text.triplet_state(triplet)) == "ID"
    assert one(spark, text.compose_triplet(F.lit(None).cast("string"), F.lit("ID"), F.lit("SNTL"))) is None
    assert one(spark, text.capitalise(F.lit("tAIGA forest"))) == "Taiga forest"
    assert one(spark, text.current_class_name(F.lit("montane_forest"))) == "alpine"
    assert one(spark, text.current_class_name(F.lit("ice"))) == "ice"


@pytest.mark.parametrize("day,label,end,of", [("2005-01-15", "2003-2004", 2004, 2005), ("2005-02-28", "2003-2004", 2004, 2005), ("2005-03-01", "2004-2005", 2005, None), ("2005-12-31", "2004-2005", 2005, 2006)])
def test_winter_labels(spark, day, label, end, of):
    assert one(spark, dates.winter_label(ts(day))) == label
    assert one(spark, dates.winter_end(ts(day))) == end
    assert one(spark, dates.winter_of(ts(day))) == of


def test_seasons(spark):
    args = ("2004-12-01", "2005-05-30")
    assert one(spark, dates.season_tag(ts("2005-05-30"), *args, "a", "b")) == "a"
    assert one(spark, dates.season_tag(ts("2005-12-01"), *args, "a", "b")) == "b"
    assert one(spark, dates.align_season(ts("2004-12-05"), *args)) == datetime.date(2005, 12, 5)
    assert one(spark, dates.align_season(ts("2006-01-05"), *args)) == datetime.date(2006, 1, 5)


def test_small_arithmetic(spark):
    assert one(spark, units.snow_density(F.lit(10.0), F.lit(0.0))) is None
    assert one(spark, units.snow_density(F.lit(10.0), F.lit(40.0), 1000)) == 250.0
    assert one(spark, units.round_half_even(F.lit(2.5), 0)) == 2.0
    assert one(spark, units.nan_to_null(F.lit(float("nan")))) is None
