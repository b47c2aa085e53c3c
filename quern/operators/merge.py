"""Replication and logs: per-field last-write-wins registers, log replay, compaction, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import paths

PRUNE_DAYS = 30


def lww(*replicas: DataFrame) -> DataFrame:
    """Merges registers (soul, field, value_json, state): the higher state wins, of equal states the
    greater JSON text. One aggregation: commutative, associative and idempotent."""
    rows = replicas[0]
    for r in replicas[1:]:
        rows = rows.unionByName(r)
    best = F.max(F.struct(F.coalesce("state", F.lit(0.0)).alias("state"), "value_json"))
    return rows.groupBy("soul", "field").agg(best.alias("b")).select("soul", "field", "b.value_json", "b.state")


def registers(nodes: DataFrame, state: Column) -> DataFrame:
    """Fields of nodes as registers; ``_`` is metadata. Reads STRUCT or VARIANT data."""
    fields = F.from_json(paths.bind(nodes).whole(), "map<string,variant>")
    rows = nodes.select(F.col("id").alias("soul"), state.cast("double").alias("state"), F.explode(fields).alias("field", "v"))
    return rows.where("field != '_'").select("soul", "field", F.to_json("v").alias("value_json"), "state")


def sync(a: DataFrame, b: DataFrame) -> DataFrame:
    """What both peers hold after a two-way sync."""
    return lww(a, b)


def checksum(*columns: Column) -> Column:
    return F.crc32(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).cast("binary"))


def replay(log: DataFrame, actor: str | None = None) -> DataFrame:
    """The state (id, data, seq) that a log (seq, actor, op, id, data, valid) leaves; bad entries are skipped."""
    ok = log.where(F.coalesce("valid", F.lit(False)) & F.col("op").isin("Put", "Delete"))
    if actor is not None:
        ok = ok.where(F.col("actor") == actor)
    last = ok.groupBy("id").agg(F.max_by(F.struct("op", "data", "seq"), "seq").alias("l")).select("id", "l.*")
    return last.where("op = 'Put'").select("id", "data", "seq")


def log_stats(log: DataFrame) -> DataFrame:
    of = lambda c: F.count(F.when(c, 1))
    valid = F.coalesce("valid", F.lit(False))
    n = F.count(F.lit(1))
    return log.agg(
        n.alias("entries"), of(~valid).alias("corrupted"), of(valid & (F.col("op") == "Put")).alias("puts"), of(valid & (F.col("op") == "Delete")).alias("deletes"),
        F.when(n > 0, of(valid) / n).otherwise(1.0).alias("recovery_rate"), F.when(n > 0, of(~valid) / n).otherwise(0.0).alias("corruption_rate"),
    )


class Unhealthy(RuntimeError):
    """A log holds corrupted entries."""


def rebuild(log: DataFrame) -> DataFrame:
    """The replayed state of a log without a corrupted entry."""
    if not log.where(~F.coalesce("valid", F.lit(False))).isEmpty():
        raise Unhealthy("the log has corrupted entries")
    return replay(log)


def compact(log: DataFrame, checkpoint: int) -> DataFrame:
    """Drops segments of which every entry lies before the checkpoint."""
    kept = log.groupBy("segment").agg(F.max("seq").alias("m")).where(F.col("m") >= checkpoint).select("segment")
    return log.join(kept, "segment", "left_semi")


def prune_actors(actors: DataFrame, now: int, days: int = PRUNE_DAYS) -> DataFrame:
    """Actors (actor, last_seen seconds) that were seen within ``days``."""
    return actors.where(F.col("last_seen") >= now - days * 86_400)


def prune_clock(clock: Column, least: int) -> Column:
    return F.map_filter(clock, lambda k, v: v >= least)


def change_log(states: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """State changes (key, old, new) of a table of writes."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return states.withColumn("old_value", before).where(~F.col("old_value").eqNullSafe(F.col(value)))
