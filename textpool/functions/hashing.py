"""Seeded, partition-independent ordering keys.

``md5(seed || key)`` gives the same hex string in Spark and DuckDB, so an order
by that string is reproducible in the SQL oracle and independent of how the
data is partitioned (no ``rand()``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hex(seed: int, *cols) -> Column:
    """md5 of the seed and the values as text; a null counts as empty text."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat(F.lit(str(seed)), *parts))


def hex_bucket(hex_col: Column, n_buckets: int) -> Column:
    """Monotone bucket (0..n_buckets-1) of an md5 hex string (its first 32 bits).

    Declared non-null (an md5 hex always converts): a join on the bucket then
    infers no ``isnotnull(bucket)`` filter, which Catalyst would push below an
    aggregate on the hashed key — hashing every raw row instead of every group
    and making otherwise identical branches lose their shared exchange.
    """
    top = F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("long")
    return F.coalesce(((top * F.lit(int(n_buckets))) / F.lit(1 << 32)).cast("long"), F.lit(0).cast("long"))


def digest(col: Column) -> Column:
    """32-byte key that stands for a text in joins and groupings (never null: a null text has a key of its own)."""
    return F.coalesce(F.unhex(F.sha2(col, 256)), F.lit(b""))
