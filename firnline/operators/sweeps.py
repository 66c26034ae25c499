"""Tuning, lag sweep, learning curve, final refit, transfer to other regions.

Each fit is a distributed job; only parameter draws and one score row per fit
live on the driver. Several fits may be in flight at once.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EXPERIMENTS
from ..session import scratch_path
from ..sources.readers import SearchConfig
from ..sources.writers import write_parquet
from . import density, learn, metrics, ordering, splits, swe
from .climate import lag_name


def in_parallel(function, items: list, parallelism: int) -> list:
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(function, items))


def draw_trials(config: SearchConfig, model: str, n_trials: int, seed: int) -> list[dict]:
    """Seeded random draws: whole numbers with a step, floats, log-scaled floats."""
    learn.check_model(model)
    generator = random.Random(f"{seed}|{model}")
    trials = []
    for _ in range(n_trials):
        drawn = {}
        for name, spec in config.models[model].items():
            if spec.type == "int":
                step = int(spec.step or 1)
                drawn[name] = int(spec.low) + step * generator.randint(0, int((spec.high - spec.low) // step))
            elif spec.log:
                drawn[name] = math.exp(generator.uniform(math.log(spec.low), math.log(spec.high)))
            else:
                drawn[name] = generator.uniform(spec.low, spec.high)
        trials.append(drawn)
    return trials


def prepare(train: DataFrame, others: list[DataFrame], variant: str, encoder: str, target: str, keys: list[str], seed: int) -> learn.Encoded:
    numeric = [c for c in learn.variant_columns(variant) if c != learn.NOMINAL_FEATURE]
    return learn.encode(train, others, encoder, target, numeric, keys, seed)


def record(model: str, variant: str, encoder: str, mode: str, scores: dict, params: dict, seed: int, timestamp: str) -> dict:
    return {
        "model": model, "variant": variant, "encoder": encoder, "mode": mode,
        "rmse": scores["rmse"], "r2": scores["r2"], "mbe": scores["mbe"], "best_iteration": scores.get("best_iteration"),
        "hyperparameters": {k: float(v) for k, v in params.items()}, "seed": seed, "timestamp": timestamp,
    }


def sweep(
    train: DataFrame,
    validation: DataFrame,
    target: str,
    keys: list[str],
    config: SearchConfig,
    variants: list[str],
    encoders: list[str],
    models: list[str],
    mode: str = "tune",
    n_trials: int = 100,
    parallelism: int = 2,
    timestamp: str = "",
    nullable: list[str] | None = None,
    fixed: dict | None = None,
) -> list[dict]:
    """Every (variant, encoder, model): default run, or ``n_trials`` draws of
    which the one with the lowest RMSE is kept. ``fixed`` overrides drawn values
    (a budget on trees, say). Rows are encoded, filled and laid out once, with the columns
    of every variant and encoder; each run reads its own of them."""
    if mode not in ("default", "tune"):
        raise ValueError(f"Unknown mode: {mode}. Available: ['default', 'tune']")
    seed, patience = int(config.settings["seed"]), int(config.settings.get("early_stopping_rounds", learn.PATIENCE))
    numeric = {v: [c for c in learn.variant_columns(v) if c != learn.NOMINAL_FEATURE] for v in variants}
    every = list(dict.fromkeys(c for columns in numeric.values() for c in columns))
    data, encoded = learn.encode_each(train, [validation], encoders, target, every, keys, seed)
    usable = [c for c in (nullable or []) if c in data.features]
    runs = []
    for variant in variants:
        for encoder in encoders:
            for model in models:
                trials = [{}] if mode == "default" else draw_trials(config, model, n_trials, seed)
                runs += [(variant, encoder, model, {**t, **(fixed or {})}) for t in trials]
    shared = learn.assemble(data.train, data.features, target, keys, data.others[0], usable, True)

    def run(chosen: tuple) -> dict:
        variant, encoder, model, params = chosen
        part = shared.only([*numeric[variant], *encoded[encoder]])
        fitted = learn.fit_assembled(part, model, params, seed, patience)
        scores = {**learn.score_assembled(part, fitted), "best_iteration": learn.rounds_of(fitted)}
        return record(model, variant, encoder, mode, scores, params, seed, timestamp)

    try:
        results = in_parallel(run, runs, parallelism)
    finally:
        shared.release()
    best = {}
    for result in results:
        place = (result["variant"], result["encoder"], result["model"])
        if place not in best or result["rmse"] < best[place]["rmse"]:
            best[place] = result
    return list(best.values())


def experiments_table(spark: SparkSession, records: list[dict]) -> DataFrame:
    rows = [tuple(r.get(f) for f in EXPERIMENTS.fieldNames()) for r in records]
    return spark.createDataFrame(rows, EXPERIMENTS)


def best_experiments(experiments: DataFrame) -> DataFrame:
    """Best stored run per model and variant."""
    whole = F.struct(*[F.col(c) for c in experiments.columns])
    best = experiments.groupBy("model", "variant").agg(F.min_by(whole, "rmse").alias("best"))
    return best.select("best.*")


def lag_sweep(train: DataFrame, validation: DataFrame, target: str, keys: list[str], windows: list[int], model: str, params: dict, seed: int = 10, parallelism: int = 2) -> list[dict]:
    """RMSE per averaging window: main features, class, and that window's lags."""
    names = {lag_name(c, w) for c in ("PRECIPITATION", "TAVG") for w in windows}
    numeric = list(learn.VARIANTS["main"])
    data = learn.encode(train, [validation], "target", target, [*numeric, *sorted(names)], keys, seed)
    # one layout with every window's lags and their fill values; a window reads its columns of it
    shared = learn.assemble(data.train, data.features, target, keys, data.others[0], [*sorted(names), "Latitude", "Longitude"], True)
    common = [c for c in data.features if c not in names]

    def run(w: int) -> dict:
        window = shared.only([*common, lag_name("PRECIPITATION", w), lag_name("TAVG", w)])
        scores = learn.score_assembled(window, learn.fit_assembled(window, model, params, seed, learn.PATIENCE))
        return {"lag": w, "rmse": scores["rmse"], "r2": scores["r2"], "mbe": scores["mbe"]}

    try:
        return in_parallel(run, windows, parallelism)
    finally:
        shared.release()


def learning_curve(df: DataFrame, target: str, keys: list[str], unit: list[str], model: str, params: dict, seed: int = 10, parts: int = 8, nullable: list[str] | None = None, parallelism: int = 2) -> list[dict]:
    """RMSE on a fixed fifth while training on 10, 20, ... 80 % of the units
    (rows or stations). The encoder is refitted for every step."""
    units = df.select(*unit).distinct() if unit != keys else df.select(*unit)
    assigned = splits.assign_split(units, unit, None, 0.2, None, seed)
    # stored: portions pass over the units three times
    path = write_parquet(assigned, scratch_path(df.sparkSession, "units"), ["split"], compression="zstd")
    assigned = df.sparkSession.read.schema(assigned.schema).parquet(path)
    training = ordering.portions(assigned.where(F.col("split") == "train"), [], unit, seed, parts)
    placed = assigned.where(F.col("split") == "test").withColumn("portion", F.lit(0)).unionByName(training)
    # stored by portion: a step reads the folders of its portions and nothing else
    path = write_parquet(df.join(placed.select(*unit, "portion"), unit), scratch_path(df.sparkSession, "portions"), ["portion"], compression="zstd")
    rows = df.sparkSession.read.parquet(path)
    sizes = rows.groupBy("portion", *unit).agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.groupBy("portion").agg(F.count(F.lit(1)).alias("units"), F.sum("rows").alias("rows")).collect()  # one row per portion
    held = rows.where(F.col("portion") == 0)

    def run(step: int) -> dict:
        part = rows.where(F.col("portion").between(1, step))
        data = prepare(part, [held], "main", "target", target, keys, seed)
        fitted = learn.fit(data.train, data.features, target, model, params, keys, seed, None, nullable)
        scores = learn.evaluate(learn.predict(fitted, data.others[0]), target)
        used = [s for s in sizes if 1 <= s.portion <= step]
        return {
            "training_percent": step * 10,
            "training_units": sum(s.units for s in used),
            "training_samples": sum(s.rows for s in used),
            "rmse": scores["rmse"],
        }

    return in_parallel(run, list(range(1, parts + 1)), parallelism)


def final_refit(experiments: DataFrame, train: DataFrame, test: DataFrame, target: str, keys: list[str], nullable: list[str] | None = None) -> DataFrame:
    """One fit per stored (model, variant) with its best hyperparameters and
    iteration count; the held-out rows with all predictions side by side."""
    scored = test
    for best in sorted(best_experiments(experiments).collect(), key=lambda r: (r.model, r.variant)):  # one row per model and variant
        params = dict(best.hyperparameters or {})
        if best.best_iteration is not None:
            params["num_boost_round"] = best.best_iteration
        data = prepare(train, [scored], best.variant, best.encoder, target, keys, best.seed)
        usable = [c for c in (nullable or []) if c in data.features]
        fitted = learn.fit(data.train, data.features, target, best.model, params, keys, best.seed, None, usable)
        name = f"{best.model}_{best.variant}"
        extra = [c for c in data.others[0].columns if c not in scored.columns]
        scored = learn.predict(fitted, data.others[0], name).drop(*extra)
    return scored


def relative_gain(direct_rmse: float, derived_rmse: float) -> float:
    """Percent by which the second error is below the first."""
    return (direct_rmse - derived_rmse) / direct_rmse * 100


def with_baseline(df: DataFrame, reference: DataFrame, target: str, name: str = "Baseline_Density") -> DataFrame:
    """Constant prediction: the mean of the target over ``reference``."""
    return df.join(F.broadcast(reference.agg(F.avg(target).alias(name))))  # one row


def transfer_scores(surveys: DataFrame, model_column: str, models: tuple[str, ...] = ("Jonas", "Pistochi", "Sturm")) -> DataFrame:
    """Density and SWE scores of a transferred model (column ``{model_column}_Density``),
    the regressions and the baseline on the surveys' complete rows."""
    names = [*models, model_column, "Baseline"]
    scored = surveys.transform(density.with_densities, list(models)).transform(swe.with_swe_products, names)
    scored = scored.dropna("any", subset=["Snow_Density", "SWE", *[f"{n}_Density" for n in names]])
    dens = metrics.compare_models(scored, "Snow_Density", [f"{n}_Density" for n in names])
    water = metrics.compare_models(scored, "SWE", [f"{n}_SWE" for n in names])
    return dens.unionByName(water)
