"""Column-expression building blocks (all JVM-side, codegen friendly)."""

from textpool.functions.labels import (  # noqa: F401
    CLASS_NAMES,
    NEUTRAL_ID,
    POLARITY_SPELLINGS,
    class_id_of,
    class_name_of,
    polarity_of,
)
from textpool.functions.scoring import argmax3, fallback_class, softmax3  # noqa: F401
from textpool.functions.text import exact_key, norm_key, strip_ws  # noqa: F401
from textpool.functions.hashing import seeded_hex, hex_bucket  # noqa: F401
