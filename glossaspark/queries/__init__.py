"""Registered queries, each beside its oracle SQL."""

from . import identities, joins, predicates, processes, states
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "identities", "joins", "predicates", "processes", "states"]
