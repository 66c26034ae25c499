import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from firnline.operators import encoders, grid, ordering, splits
from firnline.operators.sizes import broadcast_if_small

HEADER = grid.GridHeader(x0=-120.0, y0=40.0, dx=1.0, dy=-0.5, nx=3, ny=3)


@pytest.mark.parametrize("x,y,want", [(-120.0, 40.0, (0, 0)), (-119.6, 40.0, (0, 0)), (-119.5, 39.75, (1, 1)), (-118.0, 39.0, (2, 2)), (-120.01, 40.0, None), (-118.0, 38.99, None), (-118.0, 40.01, None), (None, 39.0, None)])
def test_nearest_cell(spark, x, y, want):
    df = spark.createDataFrame([(x, y)], "Longitude double, Latitude double")
    row = grid.with_cell(df, HEADER).first()
    assert row.in_bounds == (want is not None)
    assert (row.ix, row.iy) == (want or (None, None))


def test_class_lookup(spark):
    cells = spark.createDataFrame([(0, 0, 6), (1, 1, 2), (2, 2, 8)], "ix int, iy int, code int")
    codes = spark.createDataFrame([(6, "montane_forest"), (2, "boreal_forest"), (8, "ocean")], "code int, meaning string")
    points = spark.createDataFrame([(1, -120.0, 40.0), (2, -119.0, 39.5), (3, -118.0, 39.0), (4, -119.0, 40.0), (5, 0.0, 0.0)], "i int, Longitude double, Latitude double")
    got = {r.i: (r.snow_class, r.in_bounds) for r in grid.attach_snow_class(points, cells, codes, HEADER).collect()}
    assert got == {1: ("alpine", True), 2: ("taiga", True), 3: ("ocean", True), 4: (None, True), 5: (None, False)}
    with pytest.raises(Exception, match="beyond the outer cell"):
        grid.attach_snow_class(points, cells, codes, HEADER, strict=True).collect()


def stations_of(spark, counts):
    rows = [(f"{c}-{i}", c) for c, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "Station_Name string, Snow_Class string")


def test_spatial_split_sizes(spark):
    """864 stations give 604, 87 and 173."""
    stations = stations_of(spark, {"Alpine": 401, "Maritime": 117, "Prairie": 190, "Tundra": 45, "Taiga": 111})
    got = splits.create_splitter("spatial", seed=99).assign(stations).collect()
    sizes = Counter(r.split for r in got)
    assert sizes == {"train": 604, "val": 87, "test": 173}
    tests = Counter(r.Snow_Class for r in got if r.split == "test")
    for name, n in {"Alpine": 401, "Maritime": 117, "Prairie": 190, "Tundra": 45, "Taiga": 111}.items():
        assert abs(tests[name] - n * 0.2) <= 1
    again = splits.create_splitter("spatial", seed=1).assign(stations).collect()
    assert {(r.Station_Name, r.split) for r in got} == {(r.Station_Name, r.split) for r in again}


def test_single_station_classes_are_allowed(spark):
    got = splits.create_splitter("spatial").assign(stations_of(spark, {"A": 1, "B": 1, "C": 2})).collect()
    assert len(got) == 4


def test_hybrid_split(spark):
    stations = stations_of(spark, {"A": 300, "B": 100})
    rows = stations.crossJoin(spark.createDataFrame([(datetime.datetime(y, 6, 1),) for y in (2020, 2021, 2022)], "Date timestamp"))
    got = splits.create_splitter("hybrid").split(stations, rows).collect()
    assert len({r.Station_Name for r in got if r.split == "test"}) == 150
    assert {r.Date.year for r in got if r.split == "train"} == {2020, 2021}
    assert {r.Date.year for r in got if r.split == "val"} == {2022}
    assert {r.Date.year for r in got if r.split == "test"} == {2020, 2021, 2022}


def test_unknown_strategy():
    with pytest.raises(ValueError, match="spatial"):
        splits.create_splitter("temporal")
    assert splits.strategies() == ["spatial", "hybrid"]


def test_row_split_and_leakage(spark):
    rows = [(f"s{i % 7}", i, "hot" if i % 3 else "cold") for i in range(999)]
    df = spark.createDataFrame(rows, "Station_Name string, i int, Snow_Class string")
    sized = {r.split: r["count"] for r in splits.split_rows(df, ["i"], 0.2, 1, "Snow_Class").groupBy("split").count().collect()}
    assert sized == {"test": 200, "train": 799}
    by_station = splits.split_by_station(df, "Station_Name", 0.2, 42)
    assert by_station.count() == 999 and splits.leakage(by_station).count() == 0
    assert splits.leakage(splits.split_rows(df, ["i"], 0.2, 1)).count() > 0


def observations():
    generator = random.Random(2)
    level = {"a": 0.2, "b": 0.4, "c": 0.3}
    rows = []
    for i in range(300):
        c = "a" if i % 3 else generator.choice("bc")
        rows.append((f"s{i % 11:02d}", i, c, level[c] + generator.gauss(0, 0.05)))
    rows.append(("s99", 999, "once", 0.9))
    return rows


def shrunk(own, everything):
    mean = sum(everything) / len(everything)
    if not own:
        return mean
    variance = sum((y - mean) ** 2 for y in everything) / len(everything)
    class_mean = sum(own) / len(own)
    class_variance = sum((y - class_mean) ** 2 for y in own) / len(own)
    weight = len(own) * variance / (len(own) * variance + class_variance)
    return weight * class_mean + (1 - weight) * mean


def test_target_encoding_equals_refitting(spark):
    rows = observations()
    df = spark.createDataFrame(rows, "s string, i int, c string, y double")
    folds = {r.i: r.f for r in df.select("i", ordering.hash_bucket(["i"], 10, 5).alias("f")).collect()}
    assert len(set(folds.values())) == 5
    for r in encoders.cross_fitted_target_encoding(df, "c", "y", ["i"]).collect():
        other = [x for x in rows if folds[x[1]] != folds[r.i]]
        want = shrunk([x[3] for x in other if x[2] == r.c], [x[3] for x in other])
        assert r.encoded == pytest.approx(want, abs=1e-9)
    table = encoders.target_encoding(df, "c", "y")
    fresh = spark.createDataFrame([("a",), ("b",), ("new",), (None,)], "c string")
    got = {r.c: r.encoded for r in encoders.apply_encoding(fresh, table, "c").collect()}
    everything = [x[3] for x in rows]
    assert got["a"] == pytest.approx(shrunk([x[3] for x in rows if x[2] == "a"], everything), abs=1e-9)
    assert got["new"] == got[None] == pytest.approx(sum(everything) / len(everything))


def test_ordered_encoding_equals_loop(spark):
    rows = observations()
    df = spark.createDataFrame(rows, "s string, i int, c string, y double")
    prior = sum(x[3] for x in rows) / len(rows)
    got = {r.i: r.encoded for r in encoders.ordered_encoding(df, "c", "y", ["s"], ["i"]).collect()}
    total, count = Counter(), Counter()
    for s, i, c, y in sorted(rows):
        assert got[i] == pytest.approx((total[c] + prior) / (count[c] + 1), abs=1e-9)
        total[c] += y
        count[c] += 1
    table = {r.c: r.encoded for r in encoders.ordered_encoding_table(df, "c", "y").collect()}
    assert table["a"] == pytest.approx((total["a"] + prior) / (count["a"] + 1))
    assert table["once"] == pytest.approx(prior)


def test_ordered_encoding_spreads_a_dominant_station(spark):
    """A station with nearly all rows: the periods change no value, and no window
    partition holds more than one of its periods."""
    days = spark.range(3000).selectExpr("if(id % 30 = 0, concat('s', id % 7), 'hot') as s", "date_add(date'2000-01-01', cast(id as int)) as d", "'a' as c", "cast(id % 11 as double) as y")
    days = days.withColumn("d", F.when(F.col("y") == 3, None).otherwise(F.col("d"))).withColumn("tie", F.monotonically_increasing_id()).cache()
    plain = encoders.ordered_encoding(days, "c", "y", ["s"], ["d", "tie"])
    cut = encoders.ordered_encoding(days, "c", "y", ["s"], ["d", "tie"], period=F.year("d"))
    assert plain.columns == cut.columns
    both = plain.alias("p").join(cut.alias("q"), "tie").selectExpr("abs(p.encoded - q.encoded) as gap").agg(F.count("gap"), F.max("gap")).first()
    assert both[0] == 3000 and both[1] < 1e-9
    windows = [line for line in cut._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line and "tie#" in line]
    assert windows and all("__period#" in line for line in windows)
    assert days.where("s = 'hot' and d is not null").groupBy(F.year("d")).count().agg(F.max("count")).first()[0] < 366


def test_broadcast_is_checked(spark):
    plans = [broadcast_if_small(spark.range(n), 10)._jdf.queryExecution().analyzed().toString() for n in (10, 11)]
    assert "strategy=broadcast" in plans[0] and "Hint" not in plans[1]


def test_one_hot(spark):
    df = spark.createDataFrame([("Alpine",), ("Taiga",)], "c string")
    rows = encoders.one_hot(df, "c").collect()
    assert rows[0].c_Alpine == 1 and rows[0].c_Taiga == 0 and rows[1].c_Taiga == 1
    with pytest.raises(Exception, match="class without a column"):
        encoders.one_hot(spark.createDataFrame([("Ice",)], "c string"), "c").collect()
    with pytest.raises(ValueError, match="onehot, catboost, target"):
        encoders.check_encoder("ordinal")


def test_target_encoding_keeps_its_digits_far_from_zero(spark):
    generator = random.Random(12)
    rows = [(i, generator.choice("abc"), 1e9 + generator.gauss(0, 0.01) + 0.01 * (i % 3)) for i in range(600)]
    rows += [(600 + i, "rare", 1e9 + 0.5) for i in range(2)] + [(700, None, 1e9), (701, "empty", None)]
    far = spark.createDataFrame(rows, "i int, c string, y double")
    near = spark.createDataFrame([(i, c, None if y is None else y - 1e9) for i, c, y in rows], "i int, c string, y double")
    for fitted in (lambda d: encoders.target_encoding(d, "c", "y").select("c", "encoded"), lambda d: encoders.cross_fitted_target_encoding(d, "c", "y", ["i"]).select("i", "encoded")):
        want = {r[0]: r.encoded for r in fitted(near).collect()}
        got = {r[0]: r.encoded - 1e9 for r in fitted(far).collect()}
        assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-6 for k in want)


def test_points_off_the_grid_do_not_join(spark):
    grid_rows = spark.createDataFrame([(x, y, 10 * x + y) for x in range(3) for y in range(2)], "ix int, iy int, v int")
    header = grid.GridHeader(0.0, 0.0, 1.0, 1.0, 3, 2)
    points = spark.createDataFrame([(1.2, 0.9, "in"), (9.0, 0.0, "off"), (None, 1.0, "null")], "Longitude double, Latitude double, k string")
    found = grid.attach_nearest(points, grid_rows, header, ["v"])
    assert {(r.k, r.v, r.in_bounds) for r in found.collect()} == {("in", 11, True), ("off", None, False), ("null", None, False)}
    assert found.columns == ["Longitude", "Latitude", "k", "in_bounds", "v"]
    assert "isnotnull(ix" in found._jdf.queryExecution().optimizedPlan().toString() or "Union" in found._jdf.queryExecution().optimizedPlan().toString()
