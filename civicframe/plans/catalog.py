"""All registered queries."""

from __future__ import annotations

from . import model_queries, relational_queries, source_queries, spatial_queries, study_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
