"""Collects the registered queries of all plan modules."""

from __future__ import annotations

from . import evaluation_queries, factor_queries, flow_queries, market_queries, research_queries, section_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
