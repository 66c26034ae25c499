"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets come from the sources' sizes and weights. A target of r times a source is
floor(r) complete epochs and a fractional selection: every document draws an
exponential key divided by its quality weight, and the documents with the smallest
keys go in until their words fill the rest of the budget. Keys come from a hash of the
document, so reruns agree.

The prefix sum in key order is never a sort of a source. Keys are cut into 4096
intervals of equal probability; sums per (source, interval) are small, their running
totals show the interval where the budget ends, and that interval is cut again. Rows
are numbered only inside one interval of the second cut, a 16-millionth of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, cut

INTERVALS = 4096


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, total: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """source, source_size and target for a table with one row per source.

    Sources by code point, null last, take ``weights`` in turn and share ``total``
    times all words. A target stops at ``most`` times its source; what is over goes to
    the others by weight until none is above. That water level is read off in closed
    form: in order of size / weight, a source is full when the level that would fill
    it is reached by the budget.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.select("source", "source_size", F.row_number().over(by_name).alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    limits = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sums = limits.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(total))).alias("budget"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("filled"),
        F.sum("weight").over(after).alias("open"),
    )
    level = F.greatest((F.col("budget") - F.col("filled")) / F.col("open"), F.lit(0.0))
    full = sums.select("*", level.alias("level"), (level * F.col("weight") >= F.col("cap")).alias("full"))
    first_open = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("fill"), F.col("level").alias("level")))).over(everything)
    return full.select("source", "source_size", F.round(F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * first_open["level"]), 6).alias("target"))


def uniform(column: str, seed: int) -> Column:
    """A number between 0 and 1 drawn by a hash of an id; null draws as one id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null equal to null; ``right`` has a row per source."""
    named = broadcast_if_small(right.withColumnRenamed("source", "_source"))
    return left.join(named, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _crossing(sums: DataFrame, by: str) -> DataFrame:
    """For each source the interval in which its budget ends, and what is left of the
    budget there: (source, <by>_end, rest)."""
    running = F.sum("size").over(Window.partitionBy("source").orderBy(by))
    reached = sums.withColumn("until", running).where("until >= rest")
    left = F.col("rest") - F.col("until") + F.col("size")
    ends = reached.groupBy("source").agg(F.min_by(F.struct(by, left.alias("rest")), by).alias("end"))
    return ends.select("source", F.col(f"end.{by}").alias(f"{by}_end"), "end.rest")


def _keyed(docs: DataFrame, quality: DataFrame | None, seed: int, carried: bool = False) -> DataFrame:
    """Size, key and key intervals of each row, with the row itself if carried."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words().alias("size"), F.xxhash64("text").alias("tie"), *([F.struct("*").alias("row")] if carried else []))
    weight = F.lit(1.0)
    if quality is not None:
        known = quality.where("doc_id is not null and weight > 0").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("weight").cast("double").alias("weight"))
        rows, weight = rows.join(known, "doc_id", "left"), F.coalesce("weight", F.lit(1.0))
    key = -F.log(uniform("doc_id", seed)) / weight
    rows = rows.withColumn("key", key).withColumn("position", -F.expm1(-F.col("key")) * INTERVALS)
    low = F.least(F.floor("position"), F.lit(INTERVALS - 1)).cast("int")
    fine = F.least(F.floor((F.col("position") - low) * INTERVALS), F.lit(INTERVALS - 1)).cast("int")
    return rows.withColumn("low", low).withColumn("fine", fine).drop("weight", "position")


def mix(docs: DataFrame, quality: DataFrame | None = None, total: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0, seed: int = 7, carried: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source,
    source_size, target, epochs (how often the whole document is taken) and taken
    (epochs * size).

    ``quality`` (doc_id, weight) holds positive weights, 1 where it says nothing: a
    document of weight 2 enters the fractional selection as readily as two of weight
    1. The selection ends with the document whose words cross the budget, which goes
    in if that comes as near to the budget as leaving it out. Null text has size 0,
    null source is a source of its own. Rows without doc_id draw one key together, as
    do rows with the same doc_id; ties go in by doc_id, then text hash, and equal rows
    are interchangeable. An empty table gives an empty result. With ``carried`` each
    row also comes back whole as the struct row; other columns are not looked at.
    """
    rows = cut(_keyed(docs, quality, seed))
    sizes = cut(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = targets(sizes, total, weights, most)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))

    coarse_sums = rows.groupBy("source", "low").agg(F.sum("size").alias("size"))
    coarse = cut(_crossing(_beside(coarse_sums, plan.select("source", "rest")), "low"))
    inside = _beside(rows, coarse).where("low = low_end")
    fine_sums = inside.groupBy("source", "fine", "rest").agg(F.sum("size").alias("size"))
    fine_ends = cut(_crossing(fine_sums, "fine"))
    last = _beside(inside.drop("rest"), fine_ends).where("fine = fine_end")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = last.withColumn("until", F.sum("size").over(order)).where("until - rest <= rest - (until - size)")
    edges = near.groupBy("source").agg(F.max(F.struct("key", "doc_id", "tie")).alias("edge"))
    cutoff = cut(_beside(_beside(coarse.select("source", "low_end"), fine_ends.select("source", "fine_end")), edges, "left"))

    every = _keyed(docs, quality, seed, True) if carried else rows
    full = _beside(_beside(every, plan, "left"), cutoff, "left")
    before = F.struct("low", "fine") < F.struct("low_end", "fine_end")
    at_edge = (F.struct("low", "fine") == F.struct("low_end", "fine_end")) & (F.struct("key", "doc_id", "tie") <= F.col("edge"))
    selected = (F.col("rest") > 0) & (before | F.coalesce(at_edge, F.lit(False)))
    epochs = F.col("whole") + F.coalesce(selected, F.lit(False)).cast("long")
    return full.select("doc_id", "size", "source", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"), *(["row"] if carried else []))
