"""Registered queries over the reference tables, and their SQL."""

from __future__ import annotations

from spanloom.plans import core, notes, scores


def _spans() -> dict:
    return {f"spans_{n.detector.replace(':', '_')}": n for n in notes.NOTES}


def queries() -> dict:
    return {name: notes.spans(n) for name, n in _spans().items()} | core.QUERIES | scores.QUERIES


def oracle_sql() -> dict:
    return {name: notes.spans_sql(n) for name, n in _spans().items()} | core.ORACLES | scores.ORACLES
