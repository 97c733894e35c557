"""Softmax / argmax / confidence fallback over three logit columns.

Three scalar columns instead of an array keep the whole step inside
whole-stage codegen (higher-order array functions break it).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax3(l0: Column, l1: Column, l2: Column) -> tuple[Column, Column, Column]:
    m = F.greatest(l0, l1, l2)
    e0, e1, e2 = F.exp(l0 - m), F.exp(l1 - m), F.exp(l2 - m)
    z = e0 + e1 + e2
    return e0 / z, e1 / z, e2 / z


def argmax3(p0: Column, p1: Column, p2: Column) -> Column:
    """Index of the largest value; the first index wins on ties."""
    return (
        F.when((p0 >= p1) & (p0 >= p2), F.lit(0))
        .when(p1 >= p2, F.lit(1))
        .otherwise(F.lit(2))
        .cast("int")
    )


def fallback_class(raw: Column, confidence: Column, enabled: bool = True,
                   threshold: float = 0.70, label_id: int = 1) -> Column:
    """Replace the raw class by ``label_id`` when ``confidence < threshold`` (strict)."""
    if not enabled:
        return raw
    return F.when(confidence < F.lit(float(threshold)), F.lit(label_id)).otherwise(raw).cast("int")
