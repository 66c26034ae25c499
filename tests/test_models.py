import math

import pytest
from pyspark.sql import functions as F

from firnline.operators import density, metrics, swe

from conftest import one



def test_sturm(spark):
    want = (0.5975 - 0.2237) * (1 - math.exp(-0.0012 * 50 - 0.0038 * 1)) + 0.2237
    assert one(spark, density.sturm_density(F.lit(50.0), F.lit(1), F.lit("Alpine"))) == pytest.approx(want, abs=1e-12)
    assert one(spark, density.sturm_density_checked(F.lit(50.0), F.lit("2024-01-01"), F.lit("alpine"))) == pytest.approx(want, abs=1e-12)
    assert one(spark, density.sturm_density(F.lit(50.0), F.lit(None).cast("int"), F.lit("alpine"))) is None
    assert one(spark, density.sturm_density(F.lit(50.0), F.lit(1), F.lit("invalid_class"))) is None
    assert one(spark, density.sturm_density_checked(F.lit(50.0), F.lit("2024-07-01"), F.lit("alpine"))) is None
    assert one(spark, density.sturm_density(F.lit(90.0), F.lit(77), F.lit("taiga"))) == 0.217


@pytest.mark.parametrize("depth,month,elevation,want", [(1.0, "january", 2500.0, 0.258), (0.51, "march", 1600.0, 0.29681), (1.0, "1", 2500.0, 0.258), (1.0, "june", 1200.0, None), (1.0, "jan", 1399.9, 0.266), (1.0, "jan", 1400.0, 0.255), (1.0, "jan", 1999.9, 0.255), (1.0, "jan", 2000.0, 0.258), (1.0, "jan", None, 0.258), (None, "jan", 100.0, None)])
def test_jonas(spark, depth, month, elevation, want):
    value = one(spark, density.jonas_density_checked(F.lit(depth).cast("double"), F.lit(month), F.lit(elevation).cast("double")))
    assert value is None if want is None else value == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("day,want", [("1", 0.262), ("100", 0.361), ("2023-11-15", 0.276), ("2023-12-01", 0.292), ("400", None)])
def test_pistocchi(spark, day, want):
    assert one(spark, density.pistocchi_density_checked(F.lit(day))) == want


def test_hill(spark):
    pptwt, td, day, h = 300.0, 20.0, 150, 1000.0
    acc = 0.0533 * h**0.9480 * pptwt**0.1701 * td**-0.1314 * day**0.2922
    abl = 0.0481 * h**1.0395 * pptwt**0.1699 * td**-0.0461 * day**0.1804
    turn = math.tanh(0.01 * (day - 180))
    want = (acc * 0.5 * (1 - turn) + abl * 0.5 * (1 + turn)) / 10
    assert one(spark, swe.hill_swe(F.lit(pptwt), F.lit(td), F.lit(day), F.lit(h))) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("td,pptwt,h,missing", [(0.0, 300.0, 900.0, True), (-3.0, 300.0, 900.0, True), (20.0, -1.0, 900.0, True), (None, 300.0, 900.0, True), (20.0, 0.0, 900.0, False), (20.0, 300.0, 0.0, False)])
def test_hill_numeric_trouble_is_missing(spark, td, pptwt, h, missing):
    args = [F.lit(x).cast("double") for x in (pptwt, td)] + [F.lit(100), F.lit(h)]
    assert (one(spark, swe.hill_swe(*args)) is None) == missing


def test_swe_dispatch(spark):
    assert one(spark, swe.swe("DEFAULT", snow_depth=F.lit(50.0), snow_density=F.lit(0.3))) == 15.0
    assert one(spark, swe.swe("jonas", snow_depth=F.lit(1.0), month=F.lit("jan"), elevation=F.lit(2500.0))) == pytest.approx(25.8)
    assert one(spark, swe.swe("pistochi", snow_depth=F.lit(100.0), DOY=F.lit(1))) == pytest.approx(26.2)
    assert one(spark, swe.swe("sturm", snow_depth=F.lit(100.0), DOY=F.lit(1), snow_class=F.lit("taiga"))) == pytest.approx(21.7)
    assert one(spark, swe.swe("default", snow_depth=F.lit(50.0))) is None
    with pytest.raises(ValueError):
        swe.swe("unknown")
    with pytest.raises(ValueError):
        swe.swe_by_name(F.lit("x"), {"other": F.lit(1.0)})


def test_model_registry(spark):
    density.register_density_model("Fixed", lambda: F.lit(0.3))
    try:
        row = spark.createDataFrame([(50.0,)], "Snow_Depth double").transform(density.with_densities, ["Fixed"]).transform(swe.with_swe_products, ["Fixed"]).first()
        assert row.Fixed_SWE == 15.0
    finally:
        density.DENSITY_MODELS.pop("Fixed")
    with pytest.raises(ValueError):
        density.with_densities(spark.range(1), ["Nope"])


def test_metrics(spark):
    rows = [(1.0, 1.5, 1.0), (2.0, 2.5, 2.0), (4.0, 3.0, None)]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    scores = {r.model: r for r in metrics.compare_models(df, "y").collect()}
    assert scores["a"].rmse == pytest.approx(math.sqrt((0.25 + 0.25 + 1) / 3))
    assert scores["a"].mbe == pytest.approx(0.0) and scores["a"].n == 3
    mean = 7 / 3
    assert scores["a"].rsq == pytest.approx(1 - 1.5 / sum((y - mean) ** 2 for y in (1, 2, 4)))
    assert scores["b"].n == 2 and scores["b"].rsq == 1.0
    complete = {r.model: r.n for r in metrics.compare_models(df, "y", complete=True).collect()}
    assert complete == {"a": 2, "b": 2}
    wide = {r.metric: r for r in metrics.scores_wide(metrics.compare_models(df, "y"), ["a", "b"]).collect()}
    assert set(wide) == {"RMSE", "MBE", "RSQ"} and wide["RMSE"].b == 0.0


def test_constant_truth(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (1.0, 1.0, 1.0)], "y double, exact double, off double")
    assert {r.model: r.rsq for r in metrics.compare_models(df, "y").collect()} == {"exact": 1.0, "off": 0.0}
