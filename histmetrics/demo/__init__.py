"""Demonstration queries over the driver's tables."""

from histmetrics.demo import (  # noqa: F401
    extract_queries,
    graph_queries,
    measure_queries,
    read_queries,
    scalar_queries,
    source_queries,
    stream_queries,
)
from histmetrics.demo.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
