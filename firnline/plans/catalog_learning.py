"""Splits and encoders (M1 to M7), learning (M8 to M18) and stored results
(S9 to S11).

Learning queries run over all station-days; the functions take any budget. Forests that
are fitted once have fixed parameters, sweeps draw from a search space for MLlib's
learners (``config/tree_space.json``), boosting is asked for 1,500 rounds and stops by
patience. SQL knows no forest, so
beside each query with scores stands one with what is determined in its result (rows,
steps, grids, baselines, regressions), taken from the same run and compared with SQL.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import encoders, learn, metrics, splits, sweeps
from ..operators.climate import lag_name
from ..session import landed, scratch_path
from ..sources import readers, writers
from . import cleaning
from .catalog_explore import ORDERED_SQL
from .catalog_models import SCORES, VIEWS
from .registry import day, query, r
from .splits_sql import FIFTH, SPLIT_VIEWS, split_sql
from .standin import LAGS, _history_sql

KEYS = ["Station_Name", "Date"]
GEO = ["Latitude", "Longitude"]
SEED = 10
FOREST = {"n_estimators": 10, "max_depth": 6, "min_samples_leaf": 5}
BOOSTED = {"num_boost_round": 1500, "max_depth": 5, "learning_rate": 0.3}
TREE_SPACE = os.path.join(os.path.dirname(os.path.dirname(__file__)), "config", "tree_space.json")
CLIMATE = ["TAVG_lag_7d", "PRECIPITATION_lag_7d", "TAVG_lag_14d", "PRECIPITATION_lag_14d"]


def _days(t):
    """Snow rows with the date as a day, the form the hashed order is stated in."""
    return t.snow.withColumn("Date", F.col("Date").cast("date"))


#: What learners, encoders and scores read of a station-day.
LEARNED = [*KEYS, "Snow_Class", "Elevation", *GEO, "SWE", "Snow_Depth", "Snow_Density", "DOWY", "Sturm_DOWY", "Pistochi_DOWY"]


def _training(t, windows=None):
    """Located station-days with their split, with the history of ``windows`` where named,
    stored once a session by split: every fit and every encoder statistic starts from the
    stored table. It holds what learners read, so Spark leaves out the joins and columns
    that nothing asks for."""

    def store(path):
        rows = t.located(t.staged_snow if windows is None else t.clean(windows))
        stations = _stored(t, cleaning.station_table(t.staged_snow), "stations")
        assigned = splits.create_splitter("spatial").split(stations, rows)
        lags = [lag_name(c, w) for c in cleaning.LAG_COLUMNS for w in windows or []]
        return writers.store_split(assigned.select(*LEARNED, *lags, "split"), path, compression="zstd")

    return t.spark.read.parquet(landed(t.spark, "training", (t.staged_path, *(windows or [])), store))


def _split(t, rows):
    """Rows with their split, stored once by split and read back: every encoder statistic
    starts from the stored table."""
    assigned = splits.create_splitter("spatial").split(cleaning.station_table(t.snow), rows)
    return t.spark.read.parquet(writers.store_split(assigned, scratch_path(t.spark, "splits")))


def _parts(rows):
    return [rows.where(F.col("split") == s) for s in ("train", "val", "test")]


# -- splits -------------------------------------------------------------------


@query("m1_spatial_split", "select Station_Name, Snow_Class, split from placed", **SPLIT_VIEWS)
def m1(t):
    return splits.create_splitter("spatial").assign(cleaning.station_table(t.snow)).select("Station_Name", "Snow_Class", "split")


_HYBRID = split_sql("station_table", ["Station_Name"], "Snow_Class", "ceil(cast(0.15 as double) * total)", None, 10)


@query("m2_hybrid_split", """
    select Date, Site, case when p.split = 'test' then 'test' when year(Date) <= 1998 then 'train' else 'val' end as split
    from snow join placed p using (Station_Name)""", **_HYBRID)
def m2(t):
    splitter = splits.create_splitter("hybrid", test=0.15, cutoff_year=1998)
    return splitter.split(cleaning.station_table(t.snow), t.snow).select(day(), "Site", "split")


@query("m3_splitter_dispatch", """
    select 'spatial' as strategy, split, count(*) as stations from placed group by 2""", **SPLIT_VIEWS)
def m3(t):
    assigned = splits.create_splitter("spatial").assign(cleaning.station_table(t.snow))
    return assigned.groupBy(F.lit("spatial").alias("strategy"), "split").agg(F.count(F.lit(1)).alias("stations"))


_ROWS = split_sql("snow", ["Site", "Date"], "Snow_Class", FIFTH, None, 10)


@query("m4_row_split", "select Date, Site, split from placed", **_ROWS)
def m4(t):
    """Rows, stratified by class; exact sizes from ranks within hash blocks."""
    return splits.split_rows(_days(t), ["Site", "Date"], 0.2, SEED, "Snow_Class").select("Date", "Site", "split")


_STATION_SET = "select distinct Station_Name from snow"
_STATIONS = split_sql("station_set", ["Station_Name"], None, "ceil(cast(0.1 as double) * total)", None, 42)


@query("m4_station_split", "select Date, Site, p.split from snow join placed p using (Station_Name)", station_set=_STATION_SET, **_STATIONS)
def m4_stations(t):
    """Stations, unstratified, 90 to 10."""
    return splits.split_by_station(t.snow, "Station_Name", 0.1, 42).select(day(), "Site", "split")


# -- encoders -----------------------------------------------------------------


@query("m5_one_hot", "select Date, Site, " + ", ".join(f"cast(Snow_Class = '{c}' as int) as Snow_Class_{c}" for c in encoders.CLASS_LABELS) + " from snow")
def m5(t):
    return encoders.one_hot(t.snow, "Snow_Class").select(day(), "Site", *encoders.one_hot_names("Snow_Class"))


_FOLD = "cast(concat('0x', substr(md5(concat_ws('|', '10', Site, cast(Date as varchar))), 1, 8)) as bigint) % 5"
_SHRUNK = """
      coalesce(n * v / nullif(n * v + cv, 0) * cm + (1 - n * v / nullif(n * v + cv, 0)) * m, m)"""
_TARGET_VIEWS = {
    "folded": f"select *, {_FOLD} as fold from spatial where split <> 'test'",
    "pairs": "select c.Snow_Class, f.fold from (select distinct Snow_Class from folded) c cross join (select distinct fold from folded) f",
    "fold_stats": """
        select p.Snow_Class, p.fold, count(x.Snow_Density) as n, avg(x.Snow_Density) as cm, var_pop(x.Snow_Density) as cv,
          any_value(m) as m, any_value(v) as v
        from pairs p join (select f.fold, avg(y.Snow_Density) as m, var_pop(y.Snow_Density) as v from (select distinct fold from folded) f
                           join folded y on y.fold <> f.fold group by 1) o on o.fold = p.fold
        left join folded x on x.Snow_Class = p.Snow_Class and x.fold <> p.fold group by 1, 2""",
    "class_stats": """
        select Snow_Class, count(*) as n, avg(Snow_Density) as cm, var_pop(Snow_Density) as cv,
          (select avg(Snow_Density) from folded) as m, (select var_pop(Snow_Density) from folded) as v from folded group by 1""",
}


@query("m6_target_encoding", f"""
    select Date, Site, 'train' as part, round({_SHRUNK}, 6) as encoded from folded join fold_stats using (Snow_Class, fold)
    union all
    select Date, Site, 'test', round(coalesce(e, (select avg(Snow_Density) from folded)), 6) from spatial
      left join (select Snow_Class, {_SHRUNK} as e from class_stats) using (Snow_Class) where split = 'test'""", **SPLIT_VIEWS, **_TARGET_VIEWS)
def m6(t):
    """Cross-fitted on training rows, full statistics on the test rows."""
    rows = _split(t, _days(t))
    train, test = rows.where("split <> 'test'"), rows.where("split = 'test'")
    fitted = encoders.cross_fitted_target_encoding(train, "Snow_Class", "Snow_Density", ["Site", "Date"], SEED)
    applied = encoders.apply_encoding(test, encoders.target_encoding(train, "Snow_Class", "Snow_Density"), "Snow_Class")
    shape = ("Date", "Site")
    return fitted.select(*shape, F.lit("train").alias("part"), r("encoded")).unionByName(
        applied.select(*shape, F.lit("test").alias("part"), r("encoded"))
    )


_TRAINING = "select * from spatial where split <> 'test'"


@query("m7_catboost_encoding", f"""
    select Date, Site, 'train' as part, round({ORDERED_SQL.format(v='training')}, 6) as encoded from training
      window w as (partition by Snow_Class order by Station_Name, Date rows between unbounded preceding and 1 preceding)
    union all
    select Date, Site, 'test', round(coalesce(e, (select avg(Snow_Density) from training)), 6) from spatial
      left join (select Snow_Class, case when count(*) > 1 then (sum(Snow_Density) + (select avg(Snow_Density) from training)) / (count(*) + 1) end as e
                 from training group by 1) using (Snow_Class) where split = 'test'""", **SPLIT_VIEWS, training=_TRAINING)
def m7(t):
    rows = _split(t, _days(t))
    train, test = rows.where("split <> 'test'"), rows.where("split = 'test'")
    fitted = encoders.ordered_encoding(train, "Snow_Class", "Snow_Density", ["Station_Name"], ["Date"], period=F.year("Date"))
    applied = encoders.apply_encoding(test, encoders.ordered_encoding_table(train, "Snow_Class", "Snow_Density"), "Snow_Class")
    return fitted.select("Date", "Site", F.lit("train").alias("part"), r("encoded")).unionByName(
        applied.select("Date", "Site", F.lit("test").alias("part"), r("encoded"))
    )


# -- learning -----------------------------------------------------------------


def _data(t, variant="main", encoder="target", target="Snow_Density", evaluation="val"):
    rows = _training(t, None if variant == "main" else LAGS)
    train, val, test = _parts(rows)
    if evaluation == "test":
        train, held = rows.where("split <> 'test'"), test
    else:
        held = val
    return sweeps.prepare(train, [held], variant, encoder, target, KEYS, SEED)


def _scores(t, rows: list[dict]):
    return t.spark.createDataFrame([tuple(x.values()) for x in rows], list(rows[0]))


@query("m8_train_and_score")
def m8(t):
    """Random forest on the main features, scored next to the mean baseline."""
    data = _data(t)
    fitted = learn.fit(data.train, data.features, "Snow_Density", "rf", FOREST, KEYS, SEED, None, GEO)
    scored = learn.predict(fitted, data.others[0], "rf")
    scored = sweeps.with_baseline(scored, data.train, "Snow_Density", "mean")
    return metrics.compare_models(scored.select("Snow_Density", "rf", "mean"), "Snow_Density")


_HELD = {**SPLIT_VIEWS, "held": "select *, (select avg(Snow_Density) from spatial where split = 'train') as mean from spatial where split = 'val'"}


@query("m8_baseline", """
    select 'mean' as model, round(sqrt(avg((mean - Snow_Density) * (mean - Snow_Density))), 6) as rmse, round(avg(mean - Snow_Density), 6) as mbe, count(*) as n from held
    union all select 'rf', cast(null as double), cast(null as double), count(*) from held""", **_HELD)
def m8_baseline(t):
    """The baseline's scores, and the rows that both models are scored on."""
    known = F.col("model") == "mean"
    return m8(t).select("model", F.when(known, r("rmse")).alias("rmse"), F.when(known, r("mbe")).alias("mbe"), "n")


@query("m9_early_stopping")
def m9(t):
    """Boosting that stops when the validation rows no longer improve."""
    result = learn.train_and_evaluate(_data(t), "Snow_Density", "lightgbm", BOOSTED, SEED, GEO)
    return _scores(t, [{k: result[k] for k in ("rmse", "mbe", "r2", "n", "best_iteration")}])


@query("m9_rounds", "select count(*) as n, true as within from held", **_HELD)
def m9_rounds(t):
    """Rows scored; the rounds kept are some of those asked for."""
    return m9(t).select("n", F.col("best_iteration").between(1, BOOSTED["num_boost_round"]).alias("within"))


@query("m10_default_run")
def m10(t):
    """Default parameters, one-hot classes, climate features with missing lags."""
    result = learn.default_run(_data(t, "climate_7d", "onehot"), "Snow_Density", "rf", SEED, [*CLIMATE[:2], *GEO])
    return _scores(t, [{k: result[k] for k in ("rmse", "mbe", "r2", "n")}])


@query("m10_rows", "select count(*) as n from clean join station_split using (Station_Name) where split = 'val'", **SPLIT_VIEWS)
def m10_rows(t):
    """Rows scored: those with missing lags are among them."""
    return m10(t).select("n")


def _sweep(t, **options):
    train, val, _ = _parts(_training(t, LAGS))
    settings = {"variants": list(learn.VARIANTS), "encoders": list(encoders.ENCODERS), "models": ["rf"], "n_trials": 2, "timestamp": "20250101_000000", "nullable": [*CLIMATE, *GEO]}
    return sweeps.sweep(train, val, "Snow_Density", KEYS, readers.load_search_space(TREE_SPACE), **{**settings, **options})


@query("m11_tuning_sweep")
def m11(t):
    """Random search over every variant and encoder; the best run of each is kept. Also
    S12, M17."""
    return sweeps.experiments_table(t.spark, _sweep(t))


_GRID = "select 'rf' as model, variant, encoder, mode, true as scored from (select unnest(['main', 'climate_7d', 'climate_14d']) as variant), (select unnest([{encoders}]) as encoder), (select unnest([{modes}]) as mode)"


def _grid(records):
    return records.select("model", "variant", "encoder", "mode", (F.col("rmse") > 0).alias("scored"))


@query("m11_grid", _GRID.format(encoders="'onehot', 'catboost', 'target'", modes="'tune'"))
def m11_grid(t):
    """One scored record for each variant and encoder."""
    return _grid(m11(t))


@query("m12_feature_importance")
def m12(t):
    """Permutation importance by class next to the overall one."""
    data = _data(t)
    fitted = learn.fit(data.train, data.features, "Snow_Density", "rf", FOREST, KEYS, SEED, None, GEO)
    held = data.others[0].select(*KEYS, "Snow_Class", "Snow_Density", *data.features)
    scored = _stored(t, learn.permuted_scores(fitted, held, data.features, KEYS, SEED).drop(*KEYS), "importance")
    by_class = learn.permutation_importance(fitted, held, data.features, "Snow_Density", KEYS, "Snow_Class", SEED, scored)
    overall = learn.permutation_importance(fitted, held, data.features, "Snow_Density", KEYS, None, SEED, scored)
    return by_class.unionByName(overall.withColumn("Snow_Class", F.lit("all")))


@query("m12_grid", """
    select Snow_Class, feature from (select distinct Snow_Class from held union all select 'all'),
      (select unnest(['Elevation', 'Snow_Depth', 'DOWY', 'Latitude', 'Longitude', 'Snow_Class_encoded']) as feature)""", **_HELD)
def m12_grid(t):
    """Every class and feature has an importance."""
    return m12(t).where("importance is not null").select("Snow_Class", "feature")


@query("m13_lag_sweep")
def m13(t):
    """One model per averaging window of 1 to 30 days; the best is marked."""
    windows = list(range(1, 31))
    train, val, _ = _parts(_training(t, windows))
    results = sweeps.lag_sweep(train, val, "Snow_Density", KEYS, windows, "rf", FOREST, SEED, 4)
    best = min(results, key=lambda x: (x["rmse"], x["lag"]))["lag"]
    return _scores(t, [{**x, "best": x["lag"] == best} for x in results])


@query("m13_lags", "select cast(unnest(range(1, 31)) as bigint) as lag, cast(1 as bigint) as n_best")
def m13_lags(t):
    """All windows are scored and one of them is the best."""
    scored = m13(t).where("rmse > 0")
    return scored.select("lag", F.sum(F.col("best").cast("long")).over(Window.partitionBy()).alias("n_best"))


@query("m14_learning_curve")
def m14(t):
    """Retraining on 10 to 80 % of the stations, error on a fixed fifth."""
    rows = t.located(t.staged_snow).select(*LEARNED)
    return _scores(t, sweeps.learning_curve(rows, "Snow_Density", KEYS, ["Station_Name"], "rf", {"n_estimators": 3, "max_depth": 4}, SEED, 8, GEO, 4))


_CURVE = split_sql("station_set", ["Station_Name"], None, FIFTH, None, SEED)
_CURVE["station_portions"] = f"select Station_Name, ntile(8) over (order by md5(concat_ws('|', '{SEED}', Station_Name)), Station_Name) as portion from placed where split <> 'test'"


@query("m14_steps", """
    select step * 10 as training_percent, count(distinct Station_Name) as training_units, count(*) as training_samples
    from (select unnest(range(1, 9)) as step) join station_portions on portion <= step join snow using (Station_Name) group by step""", station_set=_STATION_SET, **_CURVE)
def m14_steps(t):
    """Stations and rows that each step of the curve trains on."""
    return m14(t).select("training_percent", "training_units", "training_samples")


@query("m14_learning_curve_rows")
def m14_by_rows(t):
    """Retraining on 10 to 80 % of the rows, error on a fixed fifth."""
    rows = t.located(t.staged_snow.withColumn("Date", F.col("Date").cast("date"))).select(*LEARNED)
    return _scores(t, sweeps.learning_curve(rows, "Snow_Density", KEYS, KEYS, "rf", {"n_estimators": 3, "max_depth": 4}, SEED, 8, GEO, 4))


_ROW_CURVE = split_sql("snow", KEYS, None, FIFTH, None, SEED)
_ROW_CURVE["row_portions"] = f"select ntile(8) over (order by md5(concat_ws('|', '{SEED}', Station_Name, cast(Date as varchar))), Station_Name, Date) as portion from placed where split <> 'test'"


@query("m14_row_steps", """
    select step * 10 as training_percent, count(*) as training_units, count(*) as training_samples
    from (select unnest(range(1, 9)) as step) join row_portions on portion <= step group by step""", **_ROW_CURVE)
def m14_row_steps(t):
    """Rows that each step of the curve trains on."""
    return m14_by_rows(t).select("training_percent", "training_units", "training_samples")


def _surveys(t):
    """Surveys of both regions: region, survey_id and the analysis columns."""
    shared = ["survey_id", "Date", "Station_Name", "Snow_Class", "Elevation", "Latitude", "Longitude", "SWE", "Snow_Depth", "Snow_Density", "DOWY", "Sturm_DOWY", "Pistochi_DOWY"]
    regions = {"bc": t.bc.withColumn("Station_Name", F.col("LOCATION_NAME")), "maine": t.maine.withColumn("Station_Name", F.col("SITE_NAME"))}
    return {name: _stored(t, rows.select(*shared), f"{name}_surveys") for name, rows in regions.items()}


def _stored(t, rows, name):
    """Rows computed once, for what passes over them several times."""
    return t.spark.read.schema(rows.schema).parquet(writers.write_parquet(rows, scratch_path(t.spark, name), compression="zstd"))


def _transferred(train, surveys):
    """A forest fitted on ``train``, scored on the surveys of each region next to the
    regressions and the surveys' mean."""
    keys = ["Station_Name", "Date", "survey_id"]
    data = sweeps.prepare(train, list(surveys.values()), "main", "target", "Snow_Density", keys, SEED)
    fitted = learn.fit(data.train, data.features, "Snow_Density", "rf", FOREST, keys, SEED, None, GEO)
    parts = []
    for (region, rows), encoded in zip(surveys.items(), data.others):
        scored = learn.predict(fitted, encoded, "Forest_Density")
        scores = sweeps.transfer_scores(sweeps.with_baseline(scored, rows, "Snow_Density"), "Forest")
        parts.append(scores.select(F.lit(region).alias("region"), "*"))
    return parts


@query("m15_transfer")
def m15(t):
    """Fitted on stations, scored on all surveys of two other regions next to the
    regressions and the surveys' mean."""
    train = _training(t).where("split <> 'test'").withColumn("survey_id", F.lit(None).cast("long"))
    parts = _transferred(train, _surveys(t))
    return parts[0].unionByName(parts[1])


@query("m15_retrained")
def m15_retrained(t):
    """The same after retraining with a region's own surveys: four fifths of them join
    the stations, the last fifth is scored."""
    parts = []
    for region, rows in _surveys(t).items():
        placed = _stored(t, splits.split_rows(rows, ["survey_id"], 0.2, SEED), f"{region}_placed")
        local, held = placed.where("split = 'train'").drop("split"), placed.where("split = 'test'").drop("split")
        stations = _training(t).where("split <> 'test'").withColumn("survey_id", F.lit(None).cast("long"))
        train = stations.select(*local.columns).unionByName(local)
        parts += _transferred(train, {region: held})
    return parts[0].unionByName(parts[1])


def _reference_sql(where: str) -> str:
    """Regressions and baseline on the surveys of both regions."""
    scores = []
    for region in ("bc", "maine"):
        for model in ("Jonas", "Pistochi", "Sturm", "Baseline"):
            for kind, truth, yhat in (("Density", "Snow_Density", f"{model}_Density"), ("SWE", "SWE", f"{model}_Density * Snow_Depth")):
                scores.append(f"select '{region}' as region, '{model}_{kind}' as model, {SCORES} from (select {truth} as y, {yhat} as yhat from {region}_{where})")
    return " union all ".join(scores)


def _reference_views() -> dict[str, str]:
    views = {k: VIEWS[k] for k in ("sturm", "jonas")}
    for region in ("bc", "maine"):
        split = split_sql(region, ["survey_id"], None, FIFTH, None, SEED)
        named = {name: f"{region}_{name}" for name in split}
        for name, sql in split.items():
            for old, new in named.items():
                sql = re.sub(rf"\b(from|join) {old}\b", rf"\1 {new}", sql)
            views[named[name]] = sql
        modelled = VIEWS["densities"].replace("snow.*", "s.*").replace("from snow ", "from {rows} s ")
        complete = "select * from ({modelled}) where Snow_Density is not null and SWE is not null and Jonas_Density is not null and Pistochi_Density is not null and Sturm_Density is not null"
        for where, rows in (("all", region), ("held", f"(select * from {region}_placed where split = 'test')")):
            mean = f"(select *, avg(Snow_Density) over () as Baseline_Density from {rows})"
            views[f"{region}_{where}"] = complete.format(modelled=modelled.format(rows=mean))
    return views


def _references(scores):
    return scores.where("model not like 'Forest%'").select("region", "model", r("rmse"), r("mbe"), r("rsq"), "n")


@query("m15_references", _reference_sql("all"), **_reference_views())
def m15_references(t):
    """What the transferred forest is compared with, on the rows it is scored on."""
    return _references(m15(t))


@query("m15_retrained_references", _reference_sql("held"), **_reference_views())
def m15_retrained_references(t):
    return _references(m15_retrained(t))


@query("m16_direct_swe")
def m16(t):
    """SWE as the target against SWE from predicted density."""
    density = _data(t, evaluation="test")
    fitted = learn.fit(density.train, density.features, "Snow_Density", "rf", FOREST, KEYS, SEED, None, GEO)
    derived = learn.predict(fitted, density.others[0], "d").withColumn("derived", F.col("d") * F.col("Snow_Depth"))
    derived_scores = learn.evaluate(derived, "SWE", "derived")
    direct = _data(t, target="SWE", evaluation="test")
    direct_fit = learn.fit(direct.train, direct.features, "SWE", "rf", FOREST, KEYS, SEED, None, GEO)
    direct_scores = learn.evaluate(learn.predict(direct_fit, direct.others[0], "direct"), "SWE", "direct")
    gain = sweeps.relative_gain(direct_scores["rmse"], derived_scores["rmse"])
    return _scores(t, [{"direct_rmse": direct_scores["rmse"], "derived_rmse": derived_scores["rmse"], "gain_percent": gain, "n": direct_scores["n"], "derived_n": derived_scores["n"]}])


@query("m16_rows", "select count(*) as n, count(*) as derived_n from spatial where split = 'test'", **SPLIT_VIEWS)
def m16_rows(t):
    """Both ways are scored on the same rows."""
    return m16(t).select("n", "derived_n")


@query("m18_final_refit")
def m18(t):
    """Best stored run of each model refitted on train and validation; scores of
    the held-out predictions side by side."""
    stored = sweeps.experiments_table(t.spark, _sweep(t))
    rows = _training(t, LAGS)
    scored = sweeps.final_refit(stored, rows.where("split <> 'test'"), rows.where("split = 'test'"), "Snow_Density", KEYS, [*CLIMATE, *GEO])
    return metrics.compare_models(scored.select("Snow_Density", *[f"rf_{v}" for v in learn.VARIANTS]), "Snow_Density")


@query("m18_rows", "select concat('rf_', variant) as model, count(*) as n from clean join station_split using (Station_Name), (select unnest(['main', 'climate_7d', 'climate_14d']) as variant) where split = 'test' group by 1", **SPLIT_VIEWS)
def m18_rows(t):
    """A refit for every variant, each scored on all test rows."""
    return m18(t).select("model", "n")


@query("s9_experiment_records")
def s9(t):
    """Default and tuned runs appended to one results table."""
    path = scratch_path(t.spark, "experiments")
    for mode in ("default", "tune"):
        records = _sweep(t, mode=mode, encoders=["target"], n_trials=1)
        writers.record_experiments(t.spark, records, path)
    return readers.read_experiments(t.spark, path)


@query("s9_grid", _GRID.format(encoders="'target'", modes="'default', 'tune'"))
def s9_grid(t):
    """Both runs of every variant are in the table."""
    return _grid(s9(t))


_WINDOWS = list(range(1, 31))
_PERSISTED = " union all ".join(
    f"select cast({w} as int) as lag, round(sqrt(avg((TAVG_lag_{w}d - TAVG) * (TAVG_lag_{w}d - TAVG))), 6) as rmse from history where TAVG_lag_{w}d is not null and TAVG is not null"
    for w in _WINDOWS
)


@query("s10_collect_lag_results", _PERSISTED, history=_history_sql(_WINDOWS))
def s10(t):
    """RMSE of the trailing mean as a forecast, stored per window in a folder of
    its own and collected by the number in the path."""
    root = scratch_path(t.spark, "lags")
    history = t.history(_WINDOWS)
    scores = metrics.compare_models(history.select("TAVG", *[f"TAVG_lag_{w}d" for w in _WINDOWS]), "TAVG").collect()  # one row per window
    for score in scores:
        lag = score.model.removeprefix("TAVG_lag_")
        record = {"model": "trailing_mean", "variant": f"climate_{lag}", "encoder": "target", "mode": "tune", "rmse": score.rmse, "r2": score.rsq, "mbe": score.mbe}
        writers.record_experiments(t.spark, [record], f"{root}/trailing_mean_climate_{lag}_tune_target_20250101.json")
    return readers.collect_lag_results(t.spark, root).select("lag", r("rmse"))


@query("s11_save_and_reuse_model", "select count(*) as n, cast(0 as double) as largest_difference from held", **_HELD)
def s11(t):
    """A saved model with its fill values gives the same predictions when loaded."""
    data = _data(t)
    fitted = learn.fit(data.train, data.features, "Snow_Density", "rf", FOREST, KEYS, SEED, None, GEO)
    path = writers.save_model(fitted, scratch_path(t.spark, "model"))
    scored = learn.predict(fitted, data.others[0], "kept")
    scored = learn.predict(writers.load_model(path), scored, "loaded")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("kept") - F.col("loaded"))).alias("largest_difference"))
