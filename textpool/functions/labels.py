"""Label dictionary and polarity normalisation as pure Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from textpool.functions.text import strip_ws

# Class names in label-id order, and the accepted label spellings.
CLASS_NAMES = ["Negative", "Neutral", "Positive"]
NEUTRAL_ID = 1
POLARITY_SPELLINGS = {
    "negative": 0, "neg": 0, "olumsuz": 0,
    "neutral": 1, "neu": 1, "notr": 1, "nötr": 1,
    "positive": 2, "pos": 2, "olumlu": 2,
}


def _spelling_map() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(POLARITY_SPELLINGS.items())])


def polarity_of(c, fill_missing: int | None = 1, is_boolean: bool = False) -> Column:
    """Map a raw label (string or number) to 0/1/2.

    * null → ``fill_missing``
    * a known spelling (after strip + lower) → its id
    * a decimal number (no type suffix) whose truncation toward zero is 0, 1 or 2 → that id
    * anything else (incl. NaN / ±inf) → ``fill_missing`` (null = drop later)
    """
    col = F.col(c) if isinstance(c, str) else c
    if is_boolean:
        col = col.cast("int")
    s = F.lower(strip_ws(col.cast("string")))
    d = F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), s.try_cast("double"))
    numeric = F.when((d > F.lit(-1.0)) & (d < F.lit(3.0)), d.cast("int"))
    fill = F.lit(fill_missing).cast("int") if fill_missing is not None else F.lit(None).cast("int")
    mapped = F.coalesce(F.element_at(_spelling_map(), s).cast("int"), numeric)
    return F.when(col.isNull(), fill).otherwise(F.coalesce(mapped, fill)).cast("int")


def class_name_of(c) -> Column:
    """Label id → class name (null for ids outside 0..2)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.element_at(F.array(*[F.lit(n) for n in CLASS_NAMES]), col.cast("int") + 1)


def class_id_of(c) -> Column:
    """Class name → label id (exact, case-sensitive)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.array_position(F.array(*[F.lit(n) for n in CLASS_NAMES]), col).cast("int") - 1
