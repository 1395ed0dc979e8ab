"""Search settings."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """``max_docs``: postings scored per keyword. ``k1``, ``b``: BM25. ``fuzzy_*``: which terms may stand for an unknown keyword.

    ``proximity_boost``: weight of the smallest window that holds every keyword; 0 switches it off.
    """

    max_docs: int = 500
    k1: float = 1.2
    b: float = 0.75
    fuzzy_prefix_length: int = 3
    fuzzy_max_expansions: int = 50
    fuzzy_distance: int = 2
    proximity_boost: float = 1.0
