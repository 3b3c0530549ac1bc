"""The query catalogue over the tables of a folder."""

from . import files, filtering, graphs, joining, ranking, reshaping, retrieval, rules, streams, summing  # noqa: F401  they register their queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
