"""Queries, by name, and their SQL."""

from skald.plans import files, planning, script, signal
from skald.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "files", "planning", "script", "signal"]
