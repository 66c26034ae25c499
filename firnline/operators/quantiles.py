"""Exact interpolated quantiles whose cost per task stays bounded.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here each rank
that a quantile needs starts from a bracket, its group's whole range, with the number of
values before and inside it. A bracket that holds more than a fixed number of values is
cut by a histogram: rows are counted by bin in one distributed pass, running sums over
the bins show which bin holds the rank, and that bin's smallest and largest value are
the next bracket. Only values of brackets that are small enough are ever put in order,
so no task orders more than a fixed number of distinct values, whatever the group's size.

Bins are alternately of equal width and of equal ratio. Two equal-ratio rounds leave a
bracket within a small factor of its values, and an equal-width round then settles about
ten bits more, so the rounds are few for any distribution; ties end as a bracket whose
two ends are equal. Every count is exact, so there is no bracket a rank could be outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import broadcast_if_small

#: Values that a bracket may hold when they are put in order, and bins of a histogram.
SLICE, BINS = 4096, 1024


def _ratio_scale(v: Column) -> Column:
    """A scale on which equal steps are equal ratios; it never falls as v grows."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))


def _bin(v: Column, low: Column, high: Column, bins: int, by_ratio: bool) -> Column:
    """Bin of a value between ``low`` and ``high``. The two ends have bins of their own,
    so a round gets ahead even if an end is infinite."""
    at, start, end = (_ratio_scale(x) if by_ratio else x / 2 for x in (v, low, high))
    share = F.nanvl(F.try_divide(at - start, end - start), F.lit(0.5)) * (bins - 2)
    inner = F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(bins - 3)) + 1
    return F.when(v == low, F.lit(0)).when(v == high, F.lit(bins - 1)).otherwise(F.coalesce(inner, F.lit(1))).cast("int")


def _position(p: float) -> Column:
    return (F.col("n") - 1) * F.lit(float(p))


def _placed(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beside the bracket that holds them: keys, n, __v, low, high, before."""
    named = brackets.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], "n", "low", "high", "before")
    on = [F.col(f"`{k}`") == F.col(f"__k{i}") for i, k in enumerate(keys)]
    return rows.join(broadcast_if_small(named), [*on, F.col("__v").between(F.col("low"), F.col("high"))]).drop(*[f"__k{i}" for i in range(len(keys))])


def _cut(rows: DataFrame, brackets: DataFrame, keys: list[str], bins: int, by_ratio: bool) -> DataFrame:
    """The bins of each bracket that hold one of its ranks, as brackets."""
    bin_no = _bin(F.col("__v"), F.col("low"), F.col("high"), bins, by_ratio)
    binned = _placed(rows, brackets, keys).withColumn("bin", bin_no).groupBy(*keys, "n", "before", "bin")
    counted = binned.agg(F.count("__v").alias("inside"), F.min("__v").alias("least"), F.max("__v").alias("most"))
    ahead = Window.partitionBy(*keys, "n", "before").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most a row per bin
    start = F.col("before") + F.coalesce(F.sum("inside").over(ahead), F.lit(0))
    parts = counted.withColumn("start", start).join(brackets.select(*keys, "before", "ranks"), [*keys, "before"])
    own = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("inside")))
    found = parts.select(*keys, "n", F.col("least").alias("low"), F.col("most").alias("high"), F.col("start").alias("before"), "inside", own.alias("ranks"))
    return found.where(F.size("ranks") > 0)


def brackets(rows: DataFrame, keys: list[str], probabilities: list[float], most: int = SLICE, bins: int = BINS) -> DataFrame:
    """For rows (keys, __v): disjoint brackets keys, n, low, high, before, inside and the
    ranks that each holds, cut until one holds at most ``most`` values or equal ones."""
    ranks = F.array_distinct(F.array(*[x.cast("long") for p in probabilities for x in (F.floor(_position(p)), F.ceil(_position(p)))]))
    groups = rows.groupBy(*keys).agg(F.count("__v").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")).where("n > 0")
    state = groups.select(*keys, "n", "low", "high", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), ranks.alias("ranks"))
    wide = (F.col("inside") > most) & (F.col("low") < F.col("high"))
    by_ratio = False
    while True:
        state = broadcast_if_small(state)
        if state.where(wide).isEmpty():
            return state
        state = state.where(~wide).unionByName(_cut(rows, state.where(wide), keys, bins, by_ratio))
        by_ratio = not by_ratio


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], most: int = SLICE, bins: int = BINS) -> DataFrame:
    """One row per group: ``by``, ``n`` (non-missing values) and ``quantiles``,
    an array in the order of ``probabilities``. A group whose values are all
    missing keeps its row with null quantiles; a null key is no group."""
    keys = by or ["__all"]
    rows = df.select(*[F.col(f"`{k}`") for k in by], F.col(value).cast("double").alias("__v"))
    if not by:
        rows = rows.withColumn("__all", F.lit(0))
    rows = rows.dropna("any", subset=keys)
    held = brackets(rows, keys, probabilities, most, bins)

    copies = _placed(rows, held, keys).groupBy(*keys, "n", "before", "__v").agg(F.count("*").alias("copies"))
    ahead = Window.partitionBy(*keys, "n", "before").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)  # at most ``most`` values
    ranked = copies.withColumn("first", F.col("before") + F.coalesce(F.sum("copies").over(ahead), F.lit(0)))

    def holds(rank: Column) -> Column:
        return (rank >= F.col("first")) & (rank < F.col("first") + F.col("copies"))

    picks = []
    for i, p in enumerate(probabilities):
        for name, rank in ((f"low{i}", F.floor(_position(p))), (f"high{i}", F.ceil(_position(p)))):
            picks.append(F.max(F.when(holds(rank), F.col("__v"))).alias(name))
    found = ranked.groupBy(*keys, "n").agg(*picks)
    values = [F.col(f"low{i}") + (_position(p) - F.floor(_position(p))) * (F.col(f"high{i}") - F.col(f"low{i}")) for i, p in enumerate(probabilities)]
    told = found.select(*keys, "n", F.array(*values).alias("quantiles"))
    missing = rows.groupBy(*keys).agg(F.count("__v").alias("n")).where("n = 0")
    none = F.array(*[F.lit(None).cast("double") for _ in probabilities])
    return told.unionByName(missing.select(*keys, "n", none.alias("quantiles"))).select(*[F.col(f"`{k}`") for k in by], "n", "quantiles")


def exact_quantile(df: DataFrame, by: list[str], value: str, probability: float, name: str) -> DataFrame:
    return exact_quantiles(df, by, value, [probability]).select(*[F.col(f"`{c}`") for c in by], F.col("quantiles")[0].alias(name))
