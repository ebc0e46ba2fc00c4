"""Importing this module registers every query."""

from gondola.plans import (  # noqa: F401
    catalogue_queries,
    checkout_queries,
    cluster_queries,
    common_queries,
    search_queries,
    source_queries,
    text_queries,
)
