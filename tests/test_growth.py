"""What keeps learning queries in proportion to their input."""

import pytest
from pyspark.sql import functions as F

from firnline.operators import learn, quality, splits
from firnline.plans import catalog_learning
from firnline.plans.standin import LAGS, Tables

NATIONS = [(i, f"N{i}", i % 5) for i in range(5)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("star"))
    spark.createDataFrame(NATIONS, "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{folder}/nation.parquet")
    spark.range(1, 11).selectExpr(
        "cast(id as int) as s_suppkey", "concat('S', id) as s_name", "cast(id % 5 as int) as s_nationkey", "cast(100 * id as double) as s_acctbal"
    ).write.parquet(f"{folder}/supplier.parquet")
    spark.range(600).selectExpr(
        "cast(id % 10 + 1 as int) as l_suppkey", "date_add(date'2001-01-01', cast(id / 10 as int)) as l_shipdate", "cast(10 + id % 30 as double) as l_quantity",
        "cast((id % 7) / 100 as double) as l_tax", "cast((id % 9) / 100 as double) as l_discount", "cast(1000 + id as double) as l_extendedprice", "cast(1 as int) as l_linenumber",
    ).write.parquet(f"{folder}/lineitem.parquet")
    return Tables(spark, folder)


def test_training_rows_land_once_with_what_learners_read(tables):
    rows = catalog_learning._training(tables, LAGS)
    lags = [f"{c}_lag_{w}d" for c in ("TAVG", "PRECIPITATION") for w in LAGS]
    assert set(rows.columns) == {*catalog_learning.LEARNED, *lags, "split"}
    again = catalog_learning._training(Tables(tables.spark, tables.folder), LAGS)
    assert rows.inputFiles() and sorted(rows.inputFiles()) == sorted(again.inputFiles())
    assert rows.count() == tables.clean(LAGS).count() > 0


def test_thresholds_of_many_stations_shuffle_no_rows(spark):
    rows = spark.range(12_000).selectExpr("concat('s', id) as station", "cast(id as double) as PRECIPITATION")
    plan = quality.attach_precipitation_threshold(rows, "station")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_fit_layout_has_few_partitions(spark):
    assert learn.arrange(spark.range(2_500_000).toDF("k"), ["k"]).rdd.getNumPartitions() == 8
    wide = spark.range(1_000_000).select(F.col("id").alias("k"), *[F.lit(0.0).alias(f"c{i}") for i in range(319)])
    assert learn.arrange(wide, ["k"]).rdd.getNumPartitions() == 10


def test_forests_keep_no_vectors(spark):
    rows = spark.range(200).selectExpr("id as k", "cast(id % 7 as double) as a", "if(id % 5 = 0, null, cast(id as double)) as b", "cast(id % 3 as double) as y")
    plain, kept = (learn.assemble(rows, ["a", "b"], "y", ["k"], None, ["b"], x) for x in (False, True))
    assert not kept.vectors.storageLevel.useMemory and kept.rows.storageLevel.useMemory and plain.rows is None
    assert kept.vectors.collect() == plain.vectors.collect()
    own, sliced = ([r.features.toArray().tolist() for r in x.only(["b"]).vectors.collect()] for x in (kept, plain))
    assert own == sliced and len(own[0]) == 2
    forests = [learn.fit_assembled(x, "rf", {"n_estimators": 3, "max_depth": 3}).toDebugString.split("\n", 1)[1] for x in (kept, plain)]
    assert forests[0] == forests[1]
    kept.release(), plain.release()
    assert not kept.rows.storageLevel.useMemory


def test_transfer_fits_one_forest_for_all_regions(spark, monkeypatch):
    fits, fit = [], learn.fit
    monkeypatch.setattr(learn, "fit", lambda *a, **k: fits.append(1) or fit(*a, **k))
    train = spark.range(120).selectExpr(
        "id as survey_id", "date_add(date'2001-01-01', cast(id as int)) as Date", "concat('s', id % 9) as Station_Name", "if(id % 2 = 0, 'Alpine', 'Taiga') as Snow_Class",
        "100.0D + id as Elevation", "40.0D as Latitude", "-110.0D as Longitude", "10.0D + id % 8 as SWE", "50.0D as Snow_Depth", "(10.0D + id % 8) / 50 as Snow_Density",
        "cast(id as int) + 90 as DOWY", "cast(id as int) as Sturm_DOWY", "cast(id as int) + 60 as Pistochi_DOWY",
    )
    parts = catalog_learning._transferred(train, {"bc": train.where("survey_id < 40"), "maine": train.where("survey_id >= 40")})
    scores = {(r.region, r.model): r.n for p in parts for r in p.collect()}
    assert len(fits) == 1 and scores["bc", "Forest_Density"] == 40 and scores["maine", "Forest_SWE"] == 80


def test_station_list_is_computed_once(tables, monkeypatch):
    seen, split = [], splits.SpatialSplitter.split
    monkeypatch.setattr(splits.SpatialSplitter, "split", lambda self, stations, rows: seen.append(stations) or split(self, stations, rows))
    catalog_learning._training(tables, [3])
    assert seen[0].inputFiles() and all("/stations-" in path for path in seen[0].inputFiles())


def test_learners_keep_no_keys(spark):
    rows = spark.range(40).selectExpr("concat('station ', id) as k", "cast(id % 7 as double) as a", "cast(id % 3 as double) as y")
    kept = learn.assemble(rows, ["a"], "y", ["k"], None, None, True)
    assert kept.rows.columns == ["a", "y", "is_validation"]
    kept.release()


def test_importance_scores_every_copy_once(tables, monkeypatch):
    calls, permuted = [], learn.permuted
    monkeypatch.setattr(learn, "permuted", lambda *a: calls.append(a) or permuted(*a))
    found = {(r.Snow_Class, r.feature): r for r in catalog_learning.m12(tables).collect()}
    assert len(calls) == 1
    classes = [r[0] for r in calls[0][0].select("Snow_Class").distinct().collect()]
    assert {c for c, _ in found} == {"all", *classes} and classes
    assert all(r.importance == r.permuted_rmse - r.base_rmse for r in found.values())


def test_residuals_are_in_memory_during_a_fit(spark, monkeypatch):
    seen, fit = [], learn.DecisionTreeRegressor.fit
    monkeypatch.setattr(learn.DecisionTreeRegressor, "fit", lambda self, rows: seen.append((rows, rows.storageLevel.useMemory)) or fit(self, rows))
    rows = spark.range(60).selectExpr("id as k", "cast(id % 7 as double) as a", "cast(id % 3 as double) as y")
    data = learn.assemble(rows, ["a"], "y", ["k"])
    learn.boost(data, {"num_boost_round": 3, "max_depth": 2}, 10)
    assert [kept for _, kept in seen] == [True] * 3 and not any(rows.storageLevel.useMemory for rows, _ in seen)
    data.release()
