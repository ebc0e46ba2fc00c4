"""Importing this module registers every query of the subpackage."""

from gondola.llm import (  # noqa: F401
    dedup_queries,
    page_queries,
    pipeline_query,
    quality_queries,
    run_queries,
    span_queries,
    token_queries,
    turn_queries,
)
from gondola.llm.registry import ORACLES, QUERIES  # noqa: F401
