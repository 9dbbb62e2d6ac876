"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401
    queries_evaluation,
    queries_management,
    queries_matching,
    queries_search,
    queries_text,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
