"""Array helpers that keep Catalyst from re-evaluating the array expression.

A plain ``explode(arr)`` makes the optimizer infer ``size(arr) > 0 AND arr IS
NOT NULL`` and push it below projections and exchanges, inlining ``arr``'s
whole expression (a regex tokeniser, say) once per reference.  ``explode_outer``
infers nothing; the single null row it emits for an empty array is dropped
right after the generator, so the array is computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_values(df: DataFrame, keep: list, arr: Column, alias: str, pos_alias: str | None = None) -> DataFrame:
    """``df.select(*keep, explode(arr))`` (or ``posexplode``) without the inferred filter.

    Arrays whose elements are never null (token lists, split results) give the
    same rows as ``explode``.
    """
    if pos_alias:
        out = df.select(*keep, F.posexplode_outer(arr).alias(pos_alias, alias))
    else:
        out = df.select(*keep, F.explode_outer(arr).alias(alias))
    return out.filter(F.col(alias).isNotNull())
