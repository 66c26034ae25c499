"""Helpers that several operators share: lineage cuts, checked broadcasts,
connected components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import enable_checkpoints

#: Words as the operators count them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast by hint up to this many rows; beyond it the join shuffles.
BROADCAST_ROWS = 10_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder, so that later
    steps and lost executors start from there."""
    enable_checkpoints(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting the rows, up to ``limit``. ``df`` should be
    cheap to count: a checkpoint or a small table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def partitions_for(df: DataFrame, text: str = "text", each: int = 32 << 20) -> int:
    """Number of hash partitions that leaves about ``each`` bytes of text to one."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


def components(edges: DataFrame) -> DataFrame:
    """Connected components: (node, component), the component being its smallest
    node; only nodes that have an edge come back.

    Alternating large and small stars: each round links every neighbour of a node
    to the smallest one. A round is aggregates and equi-joins on the node, so a hub
    with very many neighbours is combined before the shuffle, and the number of
    rounds grows with the logarithm of a component's size. Edges with a null end
    and loops are left out.
    """
    a, b = edges.columns[:2]
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = cut(links)

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least, "u")

    def unfinished(pairs: DataFrame) -> bool:
        """Whether a node has two targets, or is one and has one."""
        ends = pairs.select("u", "v", F.lit(False).alias("target")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("target")))
        nodes = ends.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("target").alias("target"))
        return not nodes.where("low <> high or (low is not null and target)").isEmpty()

    while unfinished(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        stars = star(large)
        small = stars.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        links = cut(small.where("u > v").distinct())
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
