"""How five quality filters interact when they are applied in every order.

A document enters the audit as a mask: bit i says that it fails filter i. Filters A to D
look at the text alone; E, a text that a smaller doc_id holds too, is settled per
distinct text from one aggregate, so a text that a third of the table repeats is
combined before it is shuffled. Documents are then counted into cells of (part, mask),
at most 32 a part, and nothing after that grows with a part's documents.

Each cell folds across the constant array of all orders, which travels with the task:
``transform`` goes over the orders and ``aggregate`` walks one order step by step with
the state "still there". A cell gives one struct per order and step, 600 in all,
weighted by its counts; a part's cells are merged by elementwise sums.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
_STEP = "struct<step:int,filter:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def failures(text: Column, least: int = 200, distinct: int = 50, capitals: int = 3) -> list[Column]:
    """Whether a text, null read as empty, fails A, B, C and D: too few words, too few
    distinct words in percent, too many capitals in percent, a mark of ``#$%&*|``."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < least, 100 * F.size(F.array_distinct(words)) < distinct * n, 100 * upper > capitals * F.length(text), text.rlike(r"[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by (part, mask): n, good and toxic ones. ``part`` is lang, null
    read as the empty string.

    A document fails E if a row with a smaller doc_id has the same text, whatever became
    of that row. Rows that share a doc_id do not precede each other, and a row without
    doc_id neither fails E nor makes others fail. A document is good (toxic) if any row
    of ``labels`` with its doc_id says quality = 1 (toxic = 1).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((F.shiftleft(fails.cast("int"), i) for i, fails in enumerate(failures(text))), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))
    told = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*told)
    single = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("copies")).join(known, "doc_id", "left")
    kind = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    first = [F.sum("copies").alias("n"), F.min("doc_id").alias("low"), F.min_by("copies", "doc_id").alias("at_low"), F.sum(F.when(F.col("doc_id").isNull(), F.col("copies")).otherwise(0)).alias("unnamed")]
    texts = single.select("doc_id", "part", "digest", "mask", "copies", *kind).groupBy("digest", "mask", "part", "good", "toxic").agg(*first)
    # a text has a row here per part and label, not per document
    lowest = F.min("low").over(Window.partitionBy("digest"))
    originals = F.col("unnamed") + F.when(F.col("low") == F.col("lowest"), F.col("at_low")).otherwise(0)
    split = F.inline(F.array(F.struct(F.col("mask").alias("m"), originals.alias("c")), F.struct(F.col("mask").bitwiseOR(16).alias("m"), (F.col("n") - originals).alias("c"))))
    counted = texts.withColumn("lowest", lowest).select("part", "good", "toxic", split)
    sums = [F.sum("c").alias("n"), *[F.sum(F.when(F.col(c), F.col("c")).otherwise(0)).alias(c) for c in ("good", "toxic")]]
    return counted.where("c > 0").groupBy("part", F.col("m").alias("mask")).agg(*sums)


def _walk(names: str, order: Column) -> Column:
    """Steps of one order, its filters' letters, for a cell: columns mask, n, good and toxic."""
    mask = F.col("mask")

    def advance(state: Column, letter: Column) -> Column:
        place = F.instr(F.lit(names), letter) - 1
        fails = F.getbit(mask, place) == 1
        goes = state["there"] & fails
        nothing = F.lit(0).cast("long")
        step = F.struct(
            (F.size(state["told"]) + 1).alias("step"),
            place.alias("filter"),
            F.when(state["there"] & ~fails, F.col("n")).otherwise(nothing).alias("kept"),
            F.when(goes, F.col("n")).otherwise(nothing).alias("removed"),
            F.when(~state["there"] & fails, F.col("n")).otherwise(nothing).alias("redundant"),
            F.when(fails & (F.bit_count(mask) == 1), F.col("n")).otherwise(nothing).alias("unique_fails"),
            F.when(goes, F.col("good")).otherwise(nothing).alias("good_lost"),
            F.when(goes, F.col("toxic")).otherwise(nothing).alias("toxic_lost"),
        )
        return F.struct((state["there"] & ~fails).alias("there"), F.concat(state["told"], F.array(step.cast(_STEP))).alias("told"))

    start = F.struct(F.lit(True).alias("there"), F.array().cast(f"array<{_STEP}>").alias("told"))
    return F.aggregate(F.split(order, ""), start, advance, lambda state: state["told"])


def _added(a: Column, b: Column) -> Column:
    """Elementwise sum of two arrays of steps."""
    return F.zip_with(a, b, lambda x, y: F.struct(x["step"].alias("step"), x["filter"].alias("filter"), *[(x[c] + y[c]).alias(c) for c in COUNTS]).cast(_STEP))


def audit(counted: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step, from ``cells``: part,
    filter_order, step (from 1), filter, and the numbers of documents that are kept
    after the step, removed by it, redundant (failing it, but gone before), failing its
    filter only, good and toxic ones among the removed, and shapley, what its filter
    removes summed over all orders. No part, no rows."""
    orders = F.split(F.lit(",".join(map("".join, permutations(names)))), ",")
    folded = counted.select("part", F.flatten(F.transform(orders, lambda order: _walk(names, order))).alias("steps"))
    # at most a cell per mask
    gathered = folded.groupBy("part").agg(F.collect_list("steps").alias("cells"))
    others = F.slice(F.col("cells"), 2, F.size("cells"))
    merged = gathered.select("part", F.aggregate(others, F.col("cells")[0], _added).alias("steps"))
    owns = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda f: F.aggregate(F.filter("steps", lambda s: s["filter"] == f), F.lit(0).cast("long"), lambda total, s: total + s["removed"]))
    every = merged.select("part", owns.alias("owns"), F.posexplode("steps").alias("at", "s"))
    order = orders[F.floor(F.col("at") / len(names)).cast("int")]
    letter = F.substr(F.lit(names), F.col("s.filter") + 1, F.lit(1))
    return every.select("part", order.alias("filter_order"), "s.step", letter.alias("filter"), *[f"s.{c}" for c in COUNTS], F.element_at("owns", F.col("s.filter") + 1).alias("shapley"))
