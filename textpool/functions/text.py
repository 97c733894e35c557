"""Text normalisation as Column expressions.

Python's ``str.strip`` removes every Unicode whitespace code point, while
plain Spark ``trim`` removes spaces only and Java's ``\\s`` is ASCII-only.
``trim(BOTH <set> FROM s)`` with the full set is exact and only walks the
leading and trailing runs (no scan of the whole text, unlike a regex).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points for which Python's str.isspace() is true.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class (Java and RE2), used where a pattern is needed.
WS_CLASS = r"[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()`` on a string column (null stays null)."""
    return F.trim(_col(c).cast("string"), F.lit(WHITESPACE))


def exact_key(c) -> Column:
    """Key for exact, case-sensitive identity (majority dedup, split overlap)."""
    return _col(c)


def norm_key(c) -> Column:
    """``lower().strip()`` key used by override merge and the leakage guard."""
    return strip_ws(F.lower(_col(c)))


def norm_join_key(c) -> Column:
    """``norm_key`` declared non-null, for joins on contract text (never null or empty).

    A nullable join key makes Catalyst infer ``isnotnull(key)`` and push it to
    the scan, where the whole key expression (lower-casing every document) is
    evaluated a second time.  Null text cannot reach a join after the
    contract's filter, so the coalesce never changes a key.
    """
    return F.coalesce(norm_key(c), F.lit(""))
