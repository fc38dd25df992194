"""Queries over the driver's tables, by name, with their SQL oracles."""

from __future__ import annotations

from kinweave.plans import family, matching, quality, registers, statistics

_ALL = matching.QUERIES | statistics.QUERIES | quality.QUERIES | registers.QUERIES | family.QUERIES

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
