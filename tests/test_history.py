import datetime
import random

import pytest
from pyspark.sql import functions as F

from firnline.operators import climate, quality

D = datetime.timedelta(days=1)


def brute_lags(rows, windows):
    """Plain definition: previous row's value, averaged over (t - w, t], masked."""
    want = {}
    for station in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == station], key=lambda r: r[1])
        previous = [None] + [r[2] for r in own[:-1]]
        first = own[0][1]
        for i, (_, t, _) in enumerate(own):
            for w in windows:
                values = [p for p, r in zip(previous[: i + 1], own) if r[1] > t - w * D and p is not None]
                masked = t < first + w * D or not values
                want[station, t, w] = None if masked else sum(values) / len(values)
    return want


def series(seed, station, start, n, gaps, missing, step=D):
    generator, t, rows = random.Random(seed), start, []
    for _ in range(n):
        rows.append((station, t, None if generator.random() < missing else round(generator.uniform(-5, 5), 2)))
        t += step * (generator.choice(gaps))
    return rows


START = datetime.datetime(2001, 9, 20)


@pytest.mark.parametrize("slice_days", [None, 30, 45, 400])
def test_lags_equal_brute_force(spark, slice_days):
    rows = series(1, "gapped", START, 150, [1, 1, 1, 2, 9, 40], 0.2)
    rows += series(2, "daily", START, 200, [1], 0.05)
    rows += series(3, "sparse", START, 25, [35, 150, 400], 0.3)
    rows += series(4, "dense", START, 300, [1, 3, 5], 0.1, datetime.timedelta(hours=5))
    rows += [("single", START, 1.0), ("empty", START, None), ("empty", START + 20 * D, None)]
    rows.append(("gapped", START - 500 * D, None))  # a first row without value still starts the warm-up
    windows = [1, 7, 14, 30]
    df = spark.createDataFrame(rows, "station string, ts timestamp, v double")
    got = climate.lag_features(df, "station", "ts", ["v"], windows, slice_days).collect()
    assert len(got) == len(rows)
    want = brute_lags(rows, windows)
    for r in got:
        for w in windows:
            expected, value = want[r.station, r.ts, w], r[f"v_lag_{w}d"]
            assert (value is None) == (expected is None), (r, w, expected)
            if expected is not None:
                assert value == pytest.approx(expected, abs=1e-9)


def test_previous_row(spark):
    rows = series(5, "a", START, 80, [1, 60, 200], 0.2) + series(6, "b", START, 50, [1], 0.2)
    df = spark.createDataFrame(rows, "station string, ts timestamp, v double")
    got = {(r.station, r.ts): r.v_previous for r in climate.previous_row(df, "station", "ts", ["v"], 30).collect()}
    for station in "ab":
        own = sorted([r for r in rows if r[0] == station], key=lambda r: r[1])
        for before, row in zip([(None, None, None)] + own, own):
            assert got[station, row[1]] == before[2]


def test_lags_use_one_large_shuffle_per_row_set(spark):
    df = spark.createDataFrame([("a", START, 1.0)], "station string, ts timestamp, v double")
    plan = climate.add_multiple_lags(df, ["v"], 30, "station", "ts")._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning(station") == 3  # edges, their windows, rows with all 30 frames
    assert initial.count("Window [") == 4  # two over the edges, two over the rows


def test_hot_station_is_split(spark):
    """Rows of one station land in many window partitions."""
    rows = series(7, "hot", START, 900, [1], 0.0)
    df = spark.createDataFrame(rows, "station string, ts timestamp, v double")
    laid = climate._with_previous(df, "station", "ts", ["v"], 30, 120)
    sizes = [r["count"] for r in laid.groupBy("__slice").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 120 + 30 + 2


def test_slice_must_cover_window(spark):
    df = spark.createDataFrame([("a", START, 1.0)], "station string, ts timestamp, v double")
    with pytest.raises(ValueError):
        climate.lag_features(df, "station", "ts", ["v"], [30], 10)


def test_winter_totals(spark):
    day = datetime.datetime
    rows = [
        ("full", day(2000, 12, 5), 1.0), ("full", day(2001, 1, 5), None), ("full", day(2001, 2, 28), 2.0), ("full", day(2001, 3, 1), 50.0),
        ("two months", day(2000, 12, 5), 1.0), ("two months", day(2001, 1, 5), 1.0), ("two months", day(2001, 5, 5), 1.0),
        ("no values", day(2000, 12, 5), None), ("no values", day(2001, 1, 5), None), ("no values", day(2001, 2, 5), None), ("no values", day(2001, 6, 5), 3.0),
    ]
    df = spark.createDataFrame(rows, "Station_Name string, Date timestamp, PRECIPITATION double")
    got = {(r.Station_Name, r.winter): r.PPTWT for r in climate.winter_precipitation(df, "Station_Name", "Date").collect()}
    assert got["full", "2000-2001"] == 3.0  # the March row belongs to the completed winter
    assert got["full", "1999-2000"] is None
    assert got["two months", "2000-2001"] is None and got["no values", "2000-2001"] is None
    attached = climate.attach_winter_precipitation(df, "Station_Name", "Date")
    assert attached.count() == len(rows)
    assert [r.PPTWT for r in attached.where("Date = '2001-03-01'").collect()] == [3.0]


def test_temperature_difference(spark):
    day = datetime.datetime
    rows = [("a", day(2001, 1, 1), -5.0), ("a", day(2001, 1, 2), -7.0), ("a", day(2001, 7, 1), 20.0), ("a", day(2001, 8, 1), None), ("b", day(2001, 1, 1), None)]
    df = spark.createDataFrame(rows, "s string, Date timestamp, TAVG double")
    got = {r.s: r.Temp_Diff for r in climate.temperature_difference(df, "s", "Date").collect()}
    assert got == {"a": 26.0, "b": None}


def test_quality_nulling(spark):
    rows = [
        (1, -5.0, 0.0, 5.0, 1.0, 2.0),  # fine
        (2, 0.0, 0.0, 5.0, 3.0, 2.0),  # not strictly ordered; above threshold
        (3, None, 0.0, 5.0, -0.1, 2.0),  # one missing clears all; negative
        (4, -50.0, 0.0, 45.0, 9.0, None),  # range; missing threshold never nulls
        (5, -40.0, 0.0, 40.0, None, 2.0),  # bounds included
    ]
    df = spark.createDataFrame(rows, "i int, TMIN double, TAVG double, TMAX double, PRECIPITATION double, threshold double")
    got = {r.i: (r.TMIN, r.TAVG, r.TMAX, r.PRECIPITATION) for r in quality.null_invalid_values(df).collect()}
    assert got == {1: (-5.0, 0.0, 5.0, 1.0), 2: (None, None, None, None), 3: (None, None, None, None), 4: (None, 0.0, None, 9.0), 5: (-40.0, 0.0, 40.0, None)}
    with pytest.raises(ValueError):
        quality.null_invalid_values(df.drop("threshold"))


def test_nan_becomes_null_and_filters(spark):
    df = spark.createDataFrame([(float("nan"), "Ocean"), (1.0, None)], "a double, c string")
    assert [r.a for r in quality.nan_columns_to_null(df).collect()] == [None, 1.0]
    assert [r.c for r in df.where(quality.not_class("c", "Ocean")).collect()] == [None]
    gap = spark.createDataFrame([("2005-05-15",), ("2005-05-16",), ("2005-11-30",), ("2005-12-01",)], "d string").select(F.col("d").cast("timestamp").alias("d"))
    assert gap.where(quality.outside_gap(F.col("d"), "2005-05-16", "2005-11-30")).count() == 2
    profile = {r.column_name: r.missing for r in quality.missing_profile(quality.nan_columns_to_null(df)).collect()}
    assert profile == {"a": 1, "c": 1}


@pytest.mark.parametrize("at", [START, START + 29 * D, START + 31 * D])
def test_history_refuses_two_rows_at_one_time(spark, at):
    rows = [("a", START + i * D, float(i)) for i in range(60)] + [("a", at, -1.0)]
    df = spark.createDataFrame(rows, "station string, ts timestamp, v double")
    for result in (climate.previous_row(df, "station", "ts", ["v"], 30), climate.lag_features(df, "station", "ts", ["v"], [7, 30], 30)):
        with pytest.raises(Exception, match="several rows of station a at"):
            result.collect()
    others = spark.createDataFrame([(None, at, 1.0), (None, at, 2.0), ("b", None, 1.0), ("b", None, 2.0), ("b", at, 3.0)], df.schema)
    assert climate.previous_row(others, "station", "ts", ["v"], 30).count() == 5


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "s string, t int")
    assert [(r.s, r.copies) for r in quality.duplicate_keys(df, ["s", "t"]).collect()] == [("a", 2)]
