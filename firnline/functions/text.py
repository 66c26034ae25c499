"""Station names, site triplets, snow classes and months, Column to Column."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import LEGACY_CLASS_NAMES, MONTH_NAMES, SNOW_CLASSES

BLANKS = " \t\r\n"


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def literal_map(entries: dict) -> Column:
    """Constant map of text, whole numbers and doubles, folded at planning."""

    def literal(value) -> str:
        if isinstance(value, str):
            return f"'{value}'"
        return f"{value!r}D" if isinstance(value, float) else str(value)

    return F.expr("map(" + ", ".join(literal(v) for v in chain.from_iterable(entries.items())) + ")")


def station_name(raw_name: Column) -> Column:
    """Station name without the parenthesised id."""
    return _strip(F.regexp_extract(raw_name, r"([^\(]*)", 1))


def station_id(raw_name: Column) -> Column:
    """Digits inside the parentheses; null when there are none."""
    return F.nullif(F.regexp_extract(raw_name, r"\((\d+)\)", 1), F.lit(""))


def compose_triplet(identifier: Column, state: Column, network: Column) -> Column:
    """``id:state:network``; missing when any part is."""
    return F.concat(identifier, F.lit(":"), state, F.lit(":"), network)


def triplet_part(triplet: Column, part: int) -> Column:
    return F.nullif(F.split_part(triplet, F.lit(":"), F.lit(part)), F.lit(""))


def triplet_state(triplet: Column) -> Column:
    return triplet_part(triplet, 2)


def capitalise(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def snow_class_name(text: Column) -> Column:
    """Lower-case class name; null for a class that does not exist."""
    lowered = F.lower(text)
    return F.when(lowered.isin(*SNOW_CLASSES), lowered)


def current_class_name(text: Column) -> Column:
    """Newer grid names replaced by the five class names; others unchanged."""
    return F.coalesce(F.try_element_at(literal_map(LEGACY_CLASS_NAMES), text), text)


def month_number(text: Column, mode: str = "permissive") -> Column:
    """1 to 12 from ``1``, ``'01'``, ``Jan``, ``january`` or padded text."""
    cleaned = F.lower(_strip(text.cast("string")))
    by_name = literal_map({key: i for i, name in enumerate(MONTH_NAMES, 1) for key in (name, name[:3])})
    digits = F.when(cleaned.rlike(r"^\d+$"), cleaned.try_cast("int"))
    number = F.coalesce(F.when(digits.between(1, 12), digits), F.try_element_at(by_name, cleaned))
    if mode == "permissive":
        return number
    if mode == "strict":
        return F.coalesce(number, F.raise_error(F.concat(F.lit("Invalid month: "), F.coalesce(cleaned, F.lit("null")))).cast("int"))
    raise ValueError(f"Unknown mode: {mode}. Available: ['permissive', 'strict']")


def month_name(text: Column, mode: str = "permissive") -> Column:
    """Full lower-case month name, from the same spellings."""
    return F.try_element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month_number(text, mode))
