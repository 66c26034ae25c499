import datetime
import random

import pytest

from firnline.operators import learn, sweeps
from firnline.schemas import EXPERIMENTS
from firnline.session import scratch_path
from firnline.sources import readers, writers

KEYS = ["Station_Name", "Date"]
FOREST = {"n_estimators": 4, "max_depth": 4}


@pytest.fixture(scope="module")
def days(spark):
    generator = random.Random(8)
    rows = []
    for s in range(12):
        name = ["Alpine", "Maritime", "Prairie"][s % 3]
        for d in range(40):
            dowy = 60 + d * 4
            depth = generator.uniform(10, 200)
            lag = None if d < 2 else generator.uniform(-10, 5)
            y = 0.2 + 0.0008 * dowy + 0.0002 * depth + 0.03 * (s % 3) + generator.gauss(0, 0.01)
            split = "test" if s >= 10 else "val" if s >= 8 else "train"
            rows.append((f"s{s}", datetime.datetime(2001, 1, 1) + datetime.timedelta(days=d), name, 1000.0 + s * 50, depth, dowy, 40.0 + s if s else None, -110.0, lag, lag, y, y * depth, split))
    names = "Station_Name string, Date timestamp, Snow_Class string, Elevation double, Snow_Depth double, DOWY int, Latitude double, Longitude double, TAVG_lag_7d double, PRECIPITATION_lag_7d double, Snow_Density double, SWE double, split string"
    path = writers.store_split(spark.createDataFrame(rows, names), scratch_path(spark, "days"))
    return spark.read.parquet(path), path


def parts(days):
    rows = days[0]
    return rows.where("split = 'train'"), rows.where("split = 'val'")


def test_feature_sets():
    assert learn.variant_columns("main") == ["Elevation", "Snow_Depth", "DOWY", "Latitude", "Longitude", "Snow_Class"]
    assert learn.variant_columns("climate_14d")[-2:] == ["TAVG_lag_14d", "Snow_Class"]
    with pytest.raises(ValueError):
        learn.variant_columns("climate_3d")
    with pytest.raises(ValueError):
        learn.check_model("extratrees")
    assert learn.mllib_parameters({"n_estimators": 5.0, "eta": 0.1, "num_boost_round": 1500}) == {"numTrees": 5, "stepSize": 0.1, "maxIter": 1500}
    with pytest.raises(ValueError, match="num_leaves"):
        learn.mllib_parameters({"num_leaves": 9})
    assert learn.backend_defaults("xgboost", 3)["seed"] == 3


@pytest.mark.parametrize("encoder", ["target", "catboost", "onehot"])
def test_forest_beats_mean_and_is_reproducible(spark, days, encoder):
    train, val = parts(days)
    data = sweeps.prepare(train, [val], "main", encoder, "Snow_Density", KEYS, 10)
    if encoder == "target":
        runs = [learn.train_and_evaluate(data, "Snow_Density", "rf", FOREST, 10, ["Latitude"]) for _ in range(2)]
        assert runs[0]["rmse"] == runs[1]["rmse"]
    else:
        runs = [learn.train_and_evaluate(data, "Snow_Density", "rf", FOREST, 10, ["Latitude"])]
    baseline = sweeps.with_baseline(val, train, "Snow_Density", "mean")
    assert runs[0]["rmse"] < learn.evaluate(baseline, "Snow_Density", "mean")["rmse"]


def test_boosting_stops_early_and_handles_missing_lags(days):
    train, val = parts(days)
    data = sweeps.prepare(train, [val], "climate_7d", "onehot", "Snow_Density", KEYS, 10)
    nullable = ["Latitude", "TAVG_lag_7d", "PRECIPITATION_lag_7d"]
    result = learn.train_and_evaluate(data, "Snow_Density", "xgboost", {"num_boost_round": 12, "max_depth": 3, "eta": 0.5}, 10, nullable)
    assert 1 <= result["best_iteration"] <= 12 and result["rmse"] > 0


def test_patience_picks_the_best_round():
    assert learn.rounds_kept([5, 4, 4.5, 3, 3.5, 3.6, 2], 2) == 4
    assert learn.rounds_kept([5, 4, 4.5, 3, 3.5, 3.6, 2], 3) == 7
    assert learn.rounds_kept([1, 1, 1], 5) == 1


def test_early_stopping_keeps_the_best_of_all_rounds(days):
    train, val = parts(days)
    data = sweeps.prepare(train, [val], "main", "onehot", "Snow_Density", KEYS, 10)
    held = data.others[0]
    settings = {"num_boost_round": 30, "max_depth": 3, "eta": 0.3}
    kept = learn.fit(data.train, data.features, "Snow_Density", "xgboost", settings, KEYS, 10, held, ["Latitude"], patience=30)
    rounds = learn.fit(data.train, data.features, "Snow_Density", "xgboost", settings, KEYS, 10, None, ["Latitude"])
    errors = rounds.stages[-1].evaluateEachIteration(rounds.transform(held).drop("prediction"), "squared")
    assert rounds.stages[-1].getNumTrees == 30
    assert learn.best_iteration(kept) == errors.index(min(errors)) + 1
    assert learn.evaluate(learn.predict(kept, held), "Snow_Density")["rmse"] == pytest.approx(min(errors) ** 0.5, rel=1e-9)


def test_boosting_fits_at_most_patience_rounds_beyond_the_best(days, monkeypatch):
    train, val = parts(days)
    data = sweeps.prepare(train, [val], "main", "onehot", "Snow_Density", KEYS, 10)
    shared = learn.assemble(data.train, data.features, "Snow_Density", KEYS, data.others[0], ["Latitude"])
    fits, fit = [], learn.DecisionTreeRegressor.fit
    monkeypatch.setattr(learn.DecisionTreeRegressor, "fit", lambda self, rows: fits.append(1) or fit(self, rows))
    fitted = learn.fit_assembled(shared, "xgboost", {"num_boost_round": 1500, "max_depth": 3, "eta": 0.5, "subsample": 0.8}, 10, 6)
    assert len(fits) == fitted.getNumTrees + 6 < 100
    errors = fitted.evaluateEachIteration(shared.part(True), "squared")
    assert errors.index(min(errors)) == len(errors) - 1  # the best round is the last one kept
    assert fitted.treeWeights == [1.0] + [0.5] * (len(errors) - 1)
    assert learn.score_assembled(shared, fitted)["rmse"] == pytest.approx(min(errors) ** 0.5, rel=1e-9)
    shared.release()


def test_one_layout_serves_all_windows(days):
    train, val = parts(days)
    data = sweeps.prepare(train, [val], "climate_7d", "onehot", "Snow_Density", KEYS, 10)
    lags = ["TAVG_lag_7d", "PRECIPITATION_lag_7d"]
    shared = learn.assemble(data.train, data.features, "Snow_Density", KEYS, data.others[0], ["Latitude", *lags])
    for names in (lags[:1], ["DOWY", "Latitude"], data.features):
        own = learn.assemble(data.train, names, "Snow_Density", KEYS, data.others[0], [c for c in ("Latitude", *lags) if c in names])
        want, got = ([(r.Snow_Density, sorted(r.features.toArray().tolist())) for r in x.vectors.collect()] for x in (own, shared.only(names)))
        assert sorted(got) == sorted(want)


def test_search_space_names_settings_that_take_effect():
    config = readers.load_search_space()
    for model in config.models:
        assert learn.mllib_parameters(sweeps.draw_trials(config, model, 1, 1)[0])
        assert model == "rf" or "num_boost_round" in config.models[model]


def test_importance_permutation_is_a_permutation(spark, days):
    train, val = parts(days)
    mixed = learn.permuted(train, ["Snow_Depth"], KEYS, 1)
    a = sorted(r[0] for r in mixed.select("Snow_Depth").collect())
    b = sorted(r[0] for r in mixed.select("Snow_Depth_permuted").collect())
    assert a == b and mixed.where("Snow_Depth <> Snow_Depth_permuted").count() > 0.9 * len(a)
    data = sweeps.prepare(train, [val], "main", "target", "Snow_Density", KEYS, 10)
    fitted = learn.fit(data.train, data.features, "Snow_Density", "rf", FOREST, KEYS, 10, None, ["Latitude"])
    found = {r.feature: r.importance for r in learn.permutation_importance(fitted, data.others[0], ["DOWY", "Longitude"], "Snow_Density", KEYS).collect()}
    assert found["DOWY"] > 0 and abs(found["Longitude"]) < 1e-12
    assert learn.feature_importance(fitted)[0][0] == "DOWY"


def test_save_and_load(spark, days):
    train, val = parts(days)
    data = sweeps.prepare(train, [val], "main", "onehot", "Snow_Density", KEYS, 10)
    fitted = learn.fit(data.train, data.features, "Snow_Density", "rf", FOREST, KEYS, 10, None, ["Latitude"])
    loaded = writers.load_model(writers.save_model(fitted, scratch_path(spark, "model")))
    both = learn.predict(loaded, learn.predict(fitted, data.others[0], "a"), "b")
    assert both.where("a <> b").count() == 0


def test_split_storage(spark, days):
    train, test = readers.load_split(spark, days[1], final_eval=True)
    assert (train.count(), test.count()) == (400, 80)
    train, val = readers.load_split(spark, days[1], final_eval=False)
    assert (train.count(), val.count()) == (320, 80)
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()


def test_sweep_records_and_final_refit(spark, days):
    train, val = parts(days)
    config = readers.load_search_space()
    path = scratch_path(spark, "results")
    for mode in ("default", "tune"):
        records = sweeps.sweep(train, val, "Snow_Density", KEYS, config, ["main"], ["onehot"], ["rf"], mode, 2, 2, "t", ["Latitude"], {"n_estimators": 3, "max_depth": 3})
        writers.record_experiments(spark, records, path)
    stored = readers.read_experiments(spark, path)
    assert stored.count() == 2 and {r.mode for r in stored.collect()} == {"default", "tune"}
    assert sweeps.best_experiments(stored).count() == 1
    rows = days[0]
    scored = sweeps.final_refit(stored, rows.where("split <> 'test'"), rows.where("split = 'test'"), "Snow_Density", KEYS, ["Latitude"])
    assert scored.count() == 80 and scored.where("rf_main is null").count() == 0
    with pytest.raises(ValueError):
        sweeps.sweep(train, val, "Snow_Density", KEYS, config, ["main"], ["onehot"], ["rf"], "grid")


def test_trial_draws():
    config = readers.load_search_space()
    drawn = sweeps.draw_trials(config, "rf", 30, 10)
    assert drawn == sweeps.draw_trials(config, "rf", 30, 10)
    assert all(d["n_estimators"] in range(100, 301, 20) and 5 <= d["max_depth"] <= 15 for d in drawn)
    assert all(0.01 <= d["learning_rate"] <= 0.3 for d in sweeps.draw_trials(config, "lightgbm", 30, 10))


def test_search_space_errors(tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.load_search_space(str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text('{"global": {}, "models": {"rf": {"x": {"type": "text", "low": 1, "high": 2}}}}')
    with pytest.raises(ValueError, match="drawn as int or float"):
        readers.load_search_space(str(tmp_path / "bad.json"))
    (tmp_path / "worse.json").write_text("{")
    with pytest.raises(ValueError):
        readers.load_search_space(str(tmp_path / "worse.json"))


def test_collect_lags(spark):
    root = scratch_path(spark, "lags")
    for lag, rmse in ((14, 0.3), (3, 0.1), (7, 0.2)):
        writers.record_experiments(spark, [{"model": "m", "rmse": rmse}], f"{root}/m_climate_{lag}d_tune_target_x.json")
    writers.record_experiments(spark, [{"model": "m", "rmse": 9.0}], f"{root}/m_main_tune_target_x.json")
    assert [(r.lag, r.rmse) for r in readers.collect_lag_results(spark, root).collect()] == [(3, 0.1), (7, 0.2), (14, 0.3)]


def test_learning_curve(spark, days):
    rows = days[0]
    got = sweeps.learning_curve(rows, "Snow_Density", KEYS, ["Station_Name"], "rf", {"n_estimators": 2, "max_depth": 3}, 10, 3, ["Latitude"])
    assert [g["training_percent"] for g in got] == [10, 20, 30]
    assert [g["training_units"] for g in got] == [3, 6, 9]
    assert got[-1]["training_samples"] == 360


def test_relative_gain():
    assert sweeps.relative_gain(5.267, 5.029) == pytest.approx(4.5187, abs=1e-3)


def test_experiment_schema(spark):
    assert sweeps.experiments_table(spark, [{"model": "m"}]).schema == EXPERIMENTS


def test_a_run_is_recorded_once(spark):
    path = scratch_path(spark, "runs")
    first = [{"model": "rf", "variant": "main", "mode": "tune", "rmse": 1.0, "timestamp": "t"}]
    for records in (first, first, [{**first[0], "timestamp": "u"}]):
        writers.record_experiments(spark, records, path)
    writers.record_experiments(spark, [{**first[0], "rmse": 9.0}], path, run="t again")
    writers.record_experiments(spark, [{**first[0], "rmse": 8.0}], path, run="t again")
    assert sorted(r.rmse for r in readers.read_experiments(spark, path).collect()) == [1.0, 1.0, 9.0]
