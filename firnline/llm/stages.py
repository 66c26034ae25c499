"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and gives back the
documents it keeps, with all their columns up to the mix.

Rows without doc_id cannot be told apart: language ID and mixing judge them like others,
the stages between keep them. An empty table passes through as an empty table. Documents
may have columns of any name: a row travels as one struct, and only ``mix_words`` and
``mix_epoch`` give way to the columns that the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id
from .common import read
from .decontaminate import contaminated
from .line_dedup import shared_lines, without_lines
from .mixing import mix
from .near_dedup import near_duplicates

#: Least share of its words that must speak a document's language.
LEAST_SHARE = 0.3
#: Least share of a text's spelling that must be known, measured by what is usual among
#: the texts learned from. Random letters stay below, clean texts come close to 1.
LEAST_FAMILIAR = 0.5


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, weight): 2 for documents labelled good, a half for those labelled bad."""
    labels = read(spark, sf_dir, "labels")
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5)
    return labels.select("doc_id", weight.alias("weight")).where("weight is not null")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letter, no language that holds ``LEAST_SHARE`` of
    their words, or whose spelling is that of no language learned (``LEAST_FAMILIAR``).
    Where no document is labelled, only those without a letter go."""
    field = language_id.fit(docs)
    if not field.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language_id.predicted(field)
    return docs.where((told["lang_pred"] != language_id.UNDECIDED) & (told["score"] >= LEAST_SHARE) & (told["familiar"] >= LEAST_FAMILIAR))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that earlier documents hold, and without documents that nothing is
    left of; n_chars follows the text."""
    gone = shared_lines(docs).select(F.col("doc_id").alias("of"), F.col("removed").alias("gone"))
    both = as_rows(docs).join(gone, F.col("row.doc_id") == F.col("of"), "left").withColumn("text", F.col("row.text"))
    whole = F.col("gone").isNull()
    shorter = both.withColumn("text", F.when(whole, F.col("text")).otherwise(without_lines("text", "gone")))
    filled = shorter.where(whole | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("text"), "n_chars": F.when(whole, F.col("row.n_chars")).otherwise(F.length("text").cast("long"))}
    return filled.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each near-duplicate group."""
    return without(docs, near_duplicates(docs).where("not kept"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark passage."""
    return without(docs, contaminated(docs, read(spark, sf_dir, "benchmark")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken, with its epoch from 1 and its
    size in words beside the columns of documents."""
    mixed = mix(docs, quality_weights(spark, sf_dir), carried=True)
    taken = mixed.where("epochs > 0").select("row", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs"))).alias("epoch"))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("mix_words", "mix_epoch")]
    return taken.select(*own, F.col("size").alias("mix_words"), F.col("epoch").alias("mix_epoch"))


def as_rows(docs: DataFrame) -> DataFrame:
    """Each document as one struct, ``row``, whose columns clash with none beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among the rejected ones; null ids stay."""
    ids = rejected.select(F.col("doc_id").alias("rejected")).distinct()
    return as_rows(docs).join(ids, F.col("row.doc_id") == F.col("rejected"), "left_anti").select("row.*")
