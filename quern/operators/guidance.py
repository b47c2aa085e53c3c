"""Guidance entries (id, category, priority, confidence, ...), source spans and a bounded log of analysis events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.store import overlay

MAX_EVENTS = 50


def upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    return overlay(entries, new)


def remove(entries: DataFrame, ids: list[str]) -> DataFrame:
    return entries.where(~F.col("id").isin(ids))


def by_category(entries: DataFrame, category: str) -> DataFrame:
    """Lowest priority number first, then the most confident."""
    return entries.where(F.col("category") == category).orderBy("priority", F.desc("confidence"), "id")


def spans(table: DataFrame, ids: list[str]) -> DataFrame:
    """Spans in the order in which they are asked for; unknown ids are left out."""
    wanted = table.sparkSession.createDataFrame(list(enumerate(ids)), "position int, id string")
    return wanted.join(table, "id").orderBy("position")


def push(events: DataFrame, new: DataFrame) -> DataFrame:
    """The newest MAX_EVENTS events (seq, ...)."""
    return events.unionByName(new).orderBy(F.desc("seq")).limit(MAX_EVENTS)


def recent(events: DataFrame, limit: int) -> DataFrame:
    return events.orderBy(F.desc("seq")).limit(limit)
