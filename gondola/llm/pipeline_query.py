"""The pipeline as a registered query."""

from __future__ import annotations

import corpus_pipeline
from gondola.llm.registry import query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
