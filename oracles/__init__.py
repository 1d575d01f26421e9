"""Equivalent SQL for the registered queries, for a check by another engine."""

from oracles.statements import STATEMENTS

__all__ = ["STATEMENTS"]
