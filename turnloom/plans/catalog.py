"""All registered queries."""

from __future__ import annotations

from turnloom.plans import queries_corpus, queries_eval, queries_examples, queries_logs  # noqa: F401
from turnloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
