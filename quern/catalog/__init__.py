"""The engine's queries over the driver's tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from quern.catalog import control, graphs, logs, pipelines, procedures, searches, texts
from quern.catalog.base import ORACLES, QUERIES

__all__ = ["queries", "oracle_sql", "flagship", "control", "graphs", "logs", "pipelines", "procedures", "searches", "texts"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


def flagship(spark, sf_dir):
    """Filter, sort, limit and project over the event nodes."""
    return QUERIES["flagship"](spark, sf_dir)
