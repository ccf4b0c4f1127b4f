"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from tidemark.plans import audits, decisions, extras, features, linkage, matching, relational, retrieval, texts, variants, windowed  # noqa: F401  each registers its queries
from tidemark.plans.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
