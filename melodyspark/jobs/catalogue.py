"""All registered queries of the melody operators."""

from melodyspark.jobs import charts, interval_queries, island_queries, melody, scalar_queries, sequence_queries, source_queries, stat_queries, streaming_queries  # noqa: F401
from melodyspark.jobs.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
