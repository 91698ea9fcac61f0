"""The named queries of the retrieval engine and, for each that SQL can express, its DuckDB twin."""

from __future__ import annotations

from .plans import registry
from .plans import dialogue, rewriting, retrieval, stores, text_ops  # noqa: F401  their queries register themselves
from .plans import twins  # noqa: F401  and the longer SQL twins

QUERIES = registry.QUERIES
ORACLE = registry.ORACLE
