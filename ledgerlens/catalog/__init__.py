"""Registered queries with their SQL counterparts."""

from __future__ import annotations

from ledgerlens.catalog import analytics, domain, evaluation, relational  # noqa: F401  (registration)
from ledgerlens.catalog.registry import ORACLES, QUERIES


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
