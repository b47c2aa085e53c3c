"""Version timeline: (id, ts seconds, actor, key, action, level, data_hash, parent_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ["debug", "info", "warn", "error"]


def rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), F.lower(level))


def build(events: DataFrame, data: Column) -> DataFrame:
    """Adds data_hash and parent_id: the entry of the same key before this one (ts, then id)."""
    order = Window.partitionBy("key").orderBy("ts", "id")
    return events.withColumn("data_hash", F.sha2(data.cast("binary"), 256)).withColumn("parent_id", F.lag("id").over(order))


def record(timeline: DataFrame, entries: DataFrame, min_level: str = "debug") -> DataFrame:
    """The timeline with the entries that reach the level."""
    return timeline.unionByName(entries.where(rank(F.col("level")) >= rank(F.lit(min_level))), allowMissingColumns=True)


def _newest(df: DataFrame, limit: int | None) -> DataFrame:
    out = df.orderBy(F.desc("ts"), "id")
    return out if limit is None else out.limit(limit)


def history(t: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    return _newest(t.where(F.col("key") == key), limit)


def latest(t: DataFrame, key: str | None = None) -> DataFrame:
    """The newest entry of each key (of equal times the greatest id)."""
    rows = t if key is None else t.where(F.col("key") == key)
    return rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in t.columns if c != "key"]), F.struct("ts", "id")).alias("e")).select("key", "e.*")


def by_actor(t: DataFrame, actor: str, limit: int | None = None) -> DataFrame:
    return _newest(t.where(F.col("actor") == actor), limit)


def in_range(t: DataFrame, start: int, end: int, limit: int | None = None) -> DataFrame:
    return _newest(t.where(F.col("ts").between(start, end)), limit)


def timeline(t: DataFrame, limit: int | None = None, since: int | None = None, level: str | None = None) -> DataFrame:
    if since is not None:
        t = t.where(F.col("ts") >= since)
    if level is not None:
        t = t.where(rank(F.col("level")) >= rank(F.lit(level)))
    return _newest(t, limit)


def recent(t: DataFrame, limit: int | None = None) -> DataFrame:
    return _newest(t, limit)


def replay(t: DataFrame, from_id: str | None = None, to_id: str | None = None) -> DataFrame:
    """Oldest first, from one entry to another, both included. An unknown start or end is the first or last entry."""
    place = F.struct("ts", "id")

    def at(i: str | None) -> DataFrame:
        found = t.where(F.col("id") == i) if i is not None else t.limit(0)
        return found.agg(F.max("ts").alias("bt"), F.max("id").alias("bi"))  # one row, null if unknown

    lo, hi = at(from_id).select(F.col("bt").alias("lt"), F.col("bi").alias("li")), at(to_id).select(F.col("bt").alias("ht"), F.col("bi").alias("hi"))
    rows = t.join(F.broadcast(lo.join(hi)))
    keep = (F.col("lt").isNull() | (place >= F.struct(F.col("lt").alias("ts"), F.col("li").alias("id")))) & (
        F.col("ht").isNull() | (place <= F.struct(F.col("ht").alias("ts"), F.col("hi").alias("id")))
    )
    return rows.where(keep).drop("lt", "li", "ht", "hi").orderBy("ts", "id")
