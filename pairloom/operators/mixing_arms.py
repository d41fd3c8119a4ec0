"""Budgets and seeds of mixing curves."""

from __future__ import annotations

#: Human sentences beside which synthetic ones are mixed; None is all of them.
BUDGETS: list[int | None] = [100, 250, 500, 1000, 2500, None]


def budget_seeds(budget: int | None) -> list[int]:
    """Small budgets vary more and get more draws."""
    return list(range(5 if budget is not None and budget < 500 else 3))
