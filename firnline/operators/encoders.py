"""Snow-class encoders. Statistics are small aggregates joined back by class, so
no fold is refitted and no class is gathered in one task. The tables have one row
per class (and fold); any column can be the class, so they are broadcast only where a
check finds them small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import hash_bucket, null_safe, running_before
from .sizes import broadcast_if_small

ENCODERS = ("onehot", "catboost", "target")
CLASS_LABELS = ("Alpine", "Maritime", "Prairie", "Tundra", "Taiga")


def check_encoder(name: str) -> str:
    if name not in ENCODERS:
        raise ValueError(f"no encoder is called {name}; there are {', '.join(ENCODERS)}")
    return name


# -- one-hot -------------------------------------------------------------------


def one_hot_names(column: str, labels=CLASS_LABELS) -> list[str]:
    return [f"{column}_{label}" for label in labels]


def one_hot(df: DataFrame, column: str, labels=CLASS_LABELS) -> DataFrame:
    """A 0/1 column per class; a class outside ``labels`` fails the job."""
    known = F.col(column).isin(*labels)
    unknown = F.raise_error(F.concat(F.lit("class without a column: "), F.coalesce(F.col(column), F.lit("null")))).cast("int")
    return df.withColumns(
        {
            name: F.when(known, (F.col(column) == label).cast("int")).otherwise(unknown)
            for name, label in zip(one_hot_names(column, labels), labels)
        }
    )


# -- target encoding -------------------------------------------------------------


#: Rows, mean and squared deviations from it: such states merge without ever taking a
#: small difference of two large sums.
_MOMENTS = "struct<n:double,mean:double,m2:double>"


def _moments(y: str) -> Column:
    v = F.col(y).cast("double")
    return F.struct(F.count(v).cast("double").alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2")).cast(_MOMENTS)


def _merged(parts: Column) -> Column:
    """One state for an array of states."""
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "m2")]).cast(_MOMENTS)

    def add(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = F.coalesce(F.try_divide(b["n"], n), F.lit(0.0))
        return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2")).cast(_MOMENTS)

    return F.aggregate(parts, none, add)


def _shrunk(own: Column, every: Column) -> Column:
    """Class mean pulled towards the overall mean, weighted by how much of the
    variance lies between classes (empirical Bayes). An empty class, or one where
    the weight is undefined, gets the overall mean."""
    mean, class_mean = (F.when(x["n"] > 0, x["mean"]) for x in (every, own))
    spread = own["n"] * F.try_divide(every["m2"], every["n"])
    weight = F.try_divide(spread, spread + F.try_divide(own["m2"], own["n"]))
    return F.coalesce(weight * class_mean + (1 - weight) * mean, mean)


def _class_sums(df: DataFrame, column: str, y: str) -> DataFrame:
    v = F.col(y).cast("double")
    return df.groupBy(column).agg(F.count(v).alias("n"), F.sum(v).alias("s"))


def target_encoding(train: DataFrame, column: str, y: str) -> DataFrame:
    """Encoding table fitted on all of ``train``: class, ``encoded``, and the
    overall mean ``fallback`` for classes never seen."""
    both = train.rollup(column).agg(_moments(y).alias("own"), F.grouping(column).alias("overall"))  # classes and their total in one pass
    every = Window.partitionBy(F.lit(0))  # one row per class
    told = both.withColumn("every", F.max(F.when(F.col("overall") == 1, F.col("own"))).over(every)).where("overall = 0")
    return told.select(column, _shrunk(F.col("own"), F.col("every")).alias("encoded"), F.when(F.col("every.n") > 0, F.col("every.mean")).alias("fallback"))


def cross_fitted_target_encoding(train: DataFrame, column: str, y: str, keys: list[str], seed: int = 10, folds: int = 5, name: str = "encoded") -> DataFrame:
    """``train`` with every row encoded from the other folds: the states of the folds, of
    a class and of all classes, come from one aggregate, and those of the other folds
    are merged. Folds come from the hashed row key."""
    rows = train.withColumn("__fold", hash_bucket(keys, seed, folds))
    states = rows.rollup("__fold", column).agg(_moments(y).alias("state"), F.grouping_id().alias("level"))
    states = broadcast_if_small(states.where("level < 2"))  # by fold and class, and by fold
    held = F.struct(F.col("__fold").alias("fold"), F.col("state"))
    of_fold = states.where("level = 1").agg(F.collect_list(held).alias("every"))  # one row, a state per fold
    of_class = states.where("level = 0").groupBy(column).agg(F.collect_list(held).alias("own"))  # a state per fold

    def others(parts: str) -> Column:
        return _merged(F.transform(F.filter(parts, lambda x: x["fold"] != F.col("__fold")), lambda x: x["state"]))

    # every (class, fold) pair, also those without rows: classes times folds
    grid = of_class.join(F.broadcast(of_fold)).withColumn("__fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    table = grid.select(column, "__fold", _shrunk(others("own"), others("every")).alias(name))
    return rows.alias("r").join(broadcast_if_small(table).alias("t"), null_safe("r", "t", [column, "__fold"])).select("r.*", f"t.{name}").drop("__fold")


# -- ordered target statistics ----------------------------------------------------


def ordered_encoding(train: DataFrame, column: str, y: str, blocks: list[str], order: list[str], name: str = "encoded", period: Column | None = None) -> DataFrame:
    """Each row gets the mean target of earlier rows of its class, with the
    overall mean as one prior observation. The order is ``blocks`` then ``order``
    (station, then date); a class is cut at the blocks.

    ``period``, a number that never falls along ``order`` (the year, for dates), cuts
    every block again, so that a station with a large share of all rows is spread over
    its periods; rows without one come first."""
    filled = train.withColumn("__class", F.coalesce(F.col(column), F.lit("")))  # a missing class is a class
    if period is not None:
        filled, blocks = filled.withColumn("__period", F.coalesce(period.cast("long"), F.lit(-(2**62)))), [*blocks, "__period"]
    running = running_before(filled, ["__class"], blocks, order, {"__sum": F.col(y).cast("double"), "__count": F.lit(1)})
    prior = train.agg(F.avg(y).alias("__prior"))
    encoded = (F.col("__sum") + F.col("__prior")) / (F.col("__count") + 1)
    return running.join(F.broadcast(prior)).withColumn(name, encoded).drop("__class", "__period", "__sum", "__count", "__prior")  # one row


def ordered_encoding_table(train: DataFrame, column: str, y: str) -> DataFrame:
    """Encoding of the class for rows outside the training set; a class seen once
    gets the overall mean."""
    sums = _class_sums(train, column, y)
    every = Window.partitionBy(F.lit(0))  # one row per class
    prior = F.sum("s").over(every) / F.sum("n").over(every)
    encoded = F.when(F.col("n") > 1, (F.col("s") + prior) / (F.col("n") + 1)).otherwise(prior)
    return sums.select(column, encoded.alias("encoded"), prior.alias("fallback"))


def apply_encoding(df: DataFrame, table: DataFrame, column: str, name: str = "encoded") -> DataFrame:
    """Encoded class from a fitted table; an unseen class gets the fallback."""
    table = broadcast_if_small(table)
    fallback = table.agg(F.max("fallback").alias("__fallback"))
    joined = df.alias("d").join(table.alias("t"), null_safe("d", "t", [column]), "left").select("d.*", F.col("t.encoded").alias("__encoded"))
    return joined.join(F.broadcast(fallback)).withColumn(name, F.coalesce("__encoded", "__fallback")).drop("__encoded", "__fallback")  # one row
