"""Imports every module that registers queries."""

from newsloom.plans import queries_core, queries_store, queries_text  # noqa: F401
from newsloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
