"""Column selection and reshaping helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import require_columns


def keep_named(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in that order; absent ones are ignored."""
    return df.select(*[F.col(f"`{c}`") for c in names if c in df.columns])


def keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns first. Rows have no position: the key travels with them."""
    require_columns(df, keys)
    return df.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"`{c}`") for c in df.columns if c not in keys])


def replace_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    return df.replace(mapping, subset=[column])


def cumulative_portions(df: DataFrame, parts: int, portion: str = "portion", step: str = "step") -> DataFrame:
    """Each row once per step that includes its portion (steps 1 to ``parts``)."""
    return df.withColumn(step, F.explode(F.sequence(F.col(portion), F.lit(parts))))


def first_rows(df: DataFrame, order: list[Column | str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)
