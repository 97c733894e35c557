"""Imports every catalogue module so their ``@register`` calls run."""

from textpool.plans import (  # noqa: F401
    aspect_queries,
    browse_queries,
    experiment_queries,
    feature_queries,
    io_queries,
    metric_queries,
    pool_queries,
    score_queries,
    stream_queries,
)
from textpool.plans.registry import OPERATORS, ORACLE, QUERIES  # noqa: F401
