"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from . import queries_baseline, queries_eval, queries_model, queries_text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
