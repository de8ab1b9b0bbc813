"""Registered queries: each applies operators of the library to the driver's tables and states the same in SQL."""

from __future__ import annotations

from . import domain, evaluation, figures, reviews, storage, tallies, texts
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "domain", "evaluation", "figures", "reviews", "storage", "tallies", "texts"]
