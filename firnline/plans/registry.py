"""Named queries over the supplied tables, each with its SQL twin where SQL can
express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .standin import Tables, oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **views: str):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"Query {name} is registered twice")

        def run(spark, folder):
            return build(Tables(spark, folder))

        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, **views)
        return build

    return register


# Means of decimal inputs fall exactly between two roundings now and then, where
# the last bit of a sum decides. This shift, the same on both sides, avoids that.
NUDGE = 3.1e-9


def nudged(column: str, digits: int = 6) -> Column:
    return F.round(F.col(column) + F.lit(NUDGE), digits).alias(column)


def nudged_sql(column: str, digits: int = 6) -> str:
    return f"round({column} + {NUDGE}, {digits}) as {column}"


def r(column: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded double for comparison with the oracle."""
    value = F.col(column) if isinstance(column, str) else column
    rounded = F.round(value.cast("double"), digits)
    return rounded.alias(name or column) if isinstance(column, str) or name else rounded


def day(column: str = "Date") -> Column:
    return F.col(column).cast("date").alias(column)
