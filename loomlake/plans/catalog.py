"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import extra, models, more, results, tabular

_PARTS = (tabular, results, models, more, extra)


def queries() -> dict:
    return {k: f for p in _PARTS for k, f in p.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in _PARTS for k, s in p.SQL.items()}
