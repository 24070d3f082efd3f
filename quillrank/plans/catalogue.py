"""All queries of the catalogue, and their SQL."""

from __future__ import annotations

from . import extraction, features, generation, graphs, profiles, ranking, relational, statistics, text  # noqa: F401
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
