"""The queries of the library by name, with their DuckDB equivalents."""

from __future__ import annotations

from . import cases, chunks, corpus, dedup, facets, fields, personal, records, review, search, state, verify, web  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "exact_duplicates"
