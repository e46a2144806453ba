"""Registered queries and their check SQL."""

from . import model_checks, model_queries, operator_queries, study_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
