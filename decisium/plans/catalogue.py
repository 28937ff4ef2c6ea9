"""All queries of the decision and corpus engine, with SQL to hold them to."""

from ..operators import converters  # noqa: F401
from . import converter_queries, corpora, decisions, gate_queries, record_queries, response_queries, stream_queries, task_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
