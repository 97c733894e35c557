"""Aggregate helpers.

``count_where(c)`` equals ``count_if(c)``.  Spark 4 rewrites ``count_if`` through
per-occurrence common-expression aliases, so two identical aggregations over a
shared input no longer canonicalise equal and their exchange is not reused
(the input is scanned and shuffled twice).  ``count(CASE WHEN c THEN 1 END)``
has no such alias.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_where(cond) -> Column:
    c = F.col(cond) if isinstance(cond, str) else cond
    return F.count(F.when(c, F.lit(1)))
