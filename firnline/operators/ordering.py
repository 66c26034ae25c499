"""Exact ranks and running totals without one task per group.

A plain ``row_number`` or running sum over a group puts the whole group into one
task. Here the order is cut into blocks: totals per block are tiny, their running
sums give each block its starting offset, and the window only runs inside a
block. A group that holds a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH = "__hash"
BLOCK = "__block"


def order_hash(keys: list[str], seed: int | str) -> Column:
    """Portable pseudo-random order: md5 of ``seed|key|key...``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def hash_bucket(keys: list[str], seed: int | str, buckets: int) -> Column:
    """Bucket number from the first 8 hex digits of ``order_hash``."""
    return F.pmod(F.conv(F.substring(order_hash(keys, seed), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def null_safe(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def running_before(
    df: DataFrame,
    by: list[str],
    blocks: list[str],
    order: list[str],
    totals: dict[str, Column],
) -> DataFrame:
    """Totals over the rows before the current one, per group ``by``.

    The order inside a group is ``blocks`` (outermost first), then ``order``.
    Every entry of ``totals`` is summed into a column of that name, exclusive of
    the current row; the first row of a group gets 0. Group and block columns
    must not be null. Where the offsets are too many to broadcast, their join and
    the window need the same partitioning, so the rows are shuffled once.
    """
    work = df
    parts = {name: f"__part_{name}" for name in totals}
    for name, value in totals.items():
        work = work.withColumn(parts[name], value)
    sums = [F.sum(F.col(p)).alias(p) for p in parts.values()]

    levels = work.groupBy(*by, *blocks).agg(*sums)
    offsets = levels
    for depth in range(1, len(blocks) + 1):
        keys = by + blocks[:depth]
        outer = [F.col(c) for c in keys[:-1]] or [F.lit(0)]
        ahead = Window.partitionBy(*outer).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        level = levels.groupBy(*keys).agg(*sums) if depth < len(blocks) else levels
        level = level.select(*keys, *[F.coalesce(F.sum(p).over(ahead), F.lit(0)).alias(f"{p}_{depth}") for p in parts.values()])
        offsets = offsets.join(level, keys)
    offsets = offsets.select(
        *by,
        *blocks,
        *[sum((F.col(f"{p}_{d}") for d in range(1, len(blocks) + 1)), F.lit(0)).alias(f"{p}_offset") for p in parts.values()],
    )

    inner = Window.partitionBy(*by, *blocks).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return work.join(offsets, by + blocks).select(
        *df.columns,
        *[(F.coalesce(F.sum(p).over(inner), F.lit(0)) + F.col(f"{p}_offset")).alias(name) for name, p in parts.items()],
    )


def hashed_rank(df: DataFrame, by: list[str], keys: list[str], seed: int | str, name: str = "rank", digits: int = 3) -> DataFrame:
    """Exact 1-based rank in ``order_hash`` order within each group ``by``.

    ``keys`` must identify a row. Blocks are the first ``digits`` hex digits, so
    they are even whatever the keys are.
    """
    hashed = df.withColumn(HASH, order_hash(keys, seed)).withColumn(BLOCK, F.substring(HASH, 1, digits))
    ranked = running_before(hashed, by, [BLOCK], [HASH, *keys], {name: F.lit(1)})
    return ranked.withColumn(name, F.col(name) + 1).drop(HASH, BLOCK)


def group_sizes(df: DataFrame, by: list[str], name: str = "size") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def portions(df: DataFrame, by: list[str], keys: list[str], seed: int | str, parts: int, name: str = "portion") -> DataFrame:
    """Cut each group into ``parts`` nearly equal portions of its hashed order;
    the first portions take the extra rows."""
    rank, size = "__rank", "__size"
    ranked = hashed_rank(df, by, keys, seed, rank)
    sizes = group_sizes(df, by, size)
    if by:
        sized = ranked.join(sizes, by)
    else:
        sized = ranked.join(F.broadcast(sizes))  # one row
    position = F.col(rank) - 1
    small = F.floor(F.col(size) / parts)
    extra = F.col(size) % parts
    cut = extra * (small + 1)
    portion = F.when(position < cut, F.floor(position / (small + 1))).otherwise(
        extra + F.floor(F.try_divide(position - cut, small))
    )
    return sized.withColumn(name, (portion + 1).cast("int")).drop(rank, size)
