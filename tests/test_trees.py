"""Trees over packed rows are MLlib's trees, and rows are laid out once for many fits."""

import pytest
from pyspark.ml import regression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from firnline.operators import learn, sweeps, trees
from firnline.sources import readers

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.range(12_000, numPartitions=3).selectExpr("id as k", "rand(1) as a", "floor(rand(2) * 7) as b", "0.0D as c", "if(rand(3) < 0.4, 0.0D, randn(4)) as d")
    made = made.withColumn("y", F.expr("3 * a + b * 0.2 + d * d + randn(5)")).cache()
    yield made
    made.unpersist()


def body(model):
    return model.toDebugString.split("\n", 1)[1]


def vectors(rows, features):
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", "y")


@pytest.mark.parametrize(
    "params",
    [{"numTrees": 3, "maxDepth": 6, "minInstancesPerNode": 5}, {"numTrees": 2, "maxDepth": 4, "subsamplingRate": 0.6}, {"numTrees": 2, "maxDepth": 3, "bootstrap": False, "subsamplingRate": 0.5}],
)
def test_forest_is_that_of_mllib(rows, params, monkeypatch):
    settings = {"labelCol": "y", "seed": 10, "featureSubsetStrategy": "all", **params}
    points = trees.Points(trees.cells(rows, FEATURES, "y"), FEATURES)
    for sums in (trees.SUMS, 10_000):  # all open nodes in one pass, and a few to a pass
        monkeypatch.setattr(trees, "SUMS", sums)
        for features in (FEATURES, ["a", "d"], ["c"]):
            learner = trees.RandomForestRegressor(**settings)
            learner.features = features
            assert body(learner.fit_points(points)) == body(regression.RandomForestRegressor(**settings).fit(vectors(rows, features)))
    points.release()


def test_first_tree_of_a_booster_is_that_of_mllib(rows):
    data = learn.assemble(rows, FEATURES, "y", ["k"], None, None, True)
    boosted = learn.boost(data, {"num_boost_round": 1, "max_depth": 5}, 10)
    tree = regression.DecisionTreeRegressor(labelCol="y", seed=10, maxDepth=5).fit(data.part(False))
    assert body(boosted.trees[0]) == body(tree)
    data.release()


def test_missing_values_fail(spark):
    for made in ("null", "double('nan')"):
        gaps = spark.range(20).selectExpr(f"if(id = 7, {made}, double(id)) as a", "double(id) as y")
        with pytest.raises(Exception, match="missing or infinite"):
            trees.RandomForestRegressor(labelCol="y", featureSubsetStrategy="all").fit_points(trees.Points(trees.cells(gaps, ["a"], "y"), ["a"]))


def test_a_boosting_round_scores_its_own_tree_only(rows, monkeypatch):
    scored, add = [], trees.Margins.add
    monkeypatch.setattr(trees.Margins, "add", lambda self, tree, *rest: scored.append(tree.uid) or add(self, tree, *rest))
    ensembles, ensemble = [], learn.ensemble
    monkeypatch.setattr(learn, "ensemble", lambda *a: ensembles.append(a) or ensemble(*a))
    data = learn.assemble(rows, FEATURES, "y", ["k"], rows.where("k < 100"), None, True)
    context = rows.sparkSession.sparkContext._jsc
    before = set(context.getPersistentRDDs())
    fitted = learn.boost(data, {"num_boost_round": 4, "max_depth": 2, "eta": 0.5}, 10, 9)
    assert len(scored) == 2 * 4 and len(set(scored)) == 4 and len(ensembles) == 1  # training and validation rows
    errors = fitted.evaluateEachIteration(data.part(True), "squared")
    assert errors[-1] == pytest.approx(learn.score_assembled(data, fitted)["rmse"] ** 2)
    data.release()
    assert set(context.getPersistentRDDs()) <= before  # sums and blocks are given back


def _stations(spark):
    return spark.range(600).selectExpr(
        "concat('s', id % 20) as Station_Name", "date_add(date'2001-01-01', cast(id / 20 as int)) as Date", "element_at(array('Alpine', 'Taiga', 'Tundra'), cast(id % 3 + 1 as int)) as Snow_Class",
        "double(id % 20) as Elevation", "40.0D + id % 11 as Snow_Depth", "cast(id / 20 as int) as DOWY", "if(id % 9 = 0, null, 40.0D + id % 20) as Latitude", "-110.0D as Longitude",
        "if(id < 60, null, double(id % 13)) as TAVG_lag_7d", "double(id % 17) as PRECIPITATION_lag_7d", "0.2D + (id % 11) * 0.01D + (id % 3) * 0.02D as Snow_Density",
    )


def test_a_sweep_lays_rows_out_once(spark, monkeypatch):
    keys, days = ["Station_Name", "Date"], _stations(spark)
    train, val = days.where("Elevation < 15"), days.where("Elevation >= 15")
    calls, made, assemble, init = [], [], learn.assemble, trees.Points.__init__
    monkeypatch.setattr(learn, "assemble", lambda *a: calls.append(a) or assemble(*a))
    monkeypatch.setattr(trees.Points, "__init__", lambda self, *a: made.append(a) or init(self, *a))
    nullable = ["TAVG_lag_7d", "PRECIPITATION_lag_7d", "Latitude"]
    config = readers.load_search_space()
    names = {"variants": ["main", "climate_7d"], "encoders": ["onehot", "catboost", "target"]}
    found = sweeps.sweep(train, val, "Snow_Density", keys, config, models=["rf"], n_trials=2, nullable=nullable, fixed={"n_estimators": 3, "max_depth": 4}, **names)
    assert len(calls) == len(made) == 1
    assert [(r["variant"], r["encoder"]) for r in found] == [(v, e) for v in names["variants"] for e in names["encoders"]]
    for result in found:  # as with a layout of its own
        data = sweeps.prepare(train, [val], result["variant"], result["encoder"], "Snow_Density", keys, 10)
        own = assemble(data.train, data.features, "Snow_Density", keys, data.others[0], [c for c in nullable if c in data.features], True)
        params = {k: v for k, v in result["hyperparameters"].items()}
        assert learn.score_assembled(own, learn.fit_assembled(own, "rf", params, 10))["rmse"] == pytest.approx(result["rmse"], rel=1e-12)
        own.release()


def test_windows_of_the_lag_sweep_share_their_points(spark, monkeypatch):
    days = _stations(spark).withColumnsRenamed({"TAVG_lag_7d": "TAVG_lag_1d", "PRECIPITATION_lag_7d": "PRECIPITATION_lag_1d"})
    days = days.selectExpr("*", "Elevation as TAVG_lag_2d", "double(DOWY % 5) as PRECIPITATION_lag_2d")
    made, packed, init, pack = [], [], trees.Points.__init__, trees.Points.packed
    monkeypatch.setattr(trees.Points, "__init__", lambda self, *a: made.append(a) or init(self, *a))
    monkeypatch.setattr(trees.Points, "packed", lambda self, *a: packed.append(pack(self, *a)) or packed[-1])
    found = sweeps.lag_sweep(days.where("Elevation < 15"), days.where("Elevation >= 15"), "Snow_Density", ["Station_Name", "Date"], [1, 2], "rf", {"n_estimators": 2, "max_depth": 3})
    assert [r["lag"] for r in found] == [1, 2] and len(made) == 1
    assert len(packed) == 2 and packed[0][0] == packed[1][0]  # one set of blocks for both fits


def test_missing_values_are_filled_and_flagged_as_by_the_pipeline(spark):
    rows = spark.range(200).selectExpr("id as k", "double(id % 7) as a", "if(id % 5 = 0, null, if(id % 7 = 0, double('nan'), double(id))) as b", "cast(if(id % 3 = 0, null, id) as int) as c_filled", "double(id % 4) as y")
    data = learn.assemble(rows, ["a", "b", "c_filled"], "y", ["k"], None, ["b", "c_filled"], True)
    blocks = data.points().raw.collect()
    cells = [x for block in blocks for x in block[0]]
    assert cells == [x for r in data.vectors.collect() for x in r.features.toArray().tolist()]
    data.release()


def test_vectors_are_put_together_for_the_rows_scored(rows):
    data = learn.assemble(rows, FEATURES, "y", ["k"], rows.where("k < 100"), None, True)
    for part in (data, data.only(["a", "d"])):
        plan = part.part(True)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert next(i for i, x in enumerate(plan) if "UDF" in x) < next(i for i, x in enumerate(plan) if "Filter" in x)
        assert part.part(True).count() == 100
    data.release()
