"""Change feeds over Structured Streaming, and their batch counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import rules
from quern.plans.staging import cut

CHANGE = "seq long, op string, id string, actor string, data string, ts timestamp"


def feed(spark: SparkSession, folder: str, schema: str = CHANGE, per_batch: int | None = None) -> DataFrame:
    """A stream of the change files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)


def latest_state(changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last change of each key, less the deleted; works on a batch and, in complete or update mode, on a stream."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), F.col(order)).alias("l"))
    return last.select(key, "l.*").where("op = 'Put'")


def subscribe(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Delivers each micro-batch to a handler, at least once."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def violations(actions: DataFrame, constraints: list[rules.Constraint]) -> DataFrame:
    """Only the violated constraints of a stream (or table) of actions; stateless."""
    return rules.evaluate(actions, constraints)


def windowed(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "0 seconds", aggs: dict[str, Column] | None = None) -> DataFrame:
    """Tumbling or sliding windows with a watermark."""
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    cols = [c.alias(n) for n, c in (aggs or {"n": F.count(F.lit(1))}).items()]
    return events.groupBy(w.alias("w"), *keys).agg(*cols).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *[n for n in (aggs or {"n": 0})])


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "0 seconds") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(ts, late)
    grouped = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def poll(events: DataFrame, since: int, ts: str = "ts") -> DataFrame:
    """Events after a time, in order."""
    return events.where(F.col(ts) > since).orderBy(ts, "id")


def watch(states: DataFrame, since: int, ts: str = "ts") -> DataFrame:
    """State changes from a time on."""
    return states.where(F.col(ts) >= since).orderBy(ts, "key")


def state_get(states: DataFrame, key: str | None = None) -> DataFrame:
    """The last value of each key of a table of writes (key, value, ts, id)."""
    rows = states if key is None else states.where(F.col("key") == key)
    return rows.groupBy("key").agg(F.max_by("value", F.struct("ts", "id")).alias("value"), F.max("ts").alias("ts"))


def dispatch(events: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], column: str = "event_type") -> dict[str, DataFrame]:
    """One handler per event type; a type without a handler is an error."""
    types = [r[0] for r in events.select(column).distinct().collect()]  # one row per type
    missing = sorted(set(types) - set(handlers))
    if missing:
        raise KeyError(f"no handler for {missing}")
    return {t: handlers[t](events.where(F.col(column) == t)) for t in types}


def numbered(df: DataFrame, order: str) -> DataFrame:
    """Adds ``k``, the place of each row by ``order`` from 1 on: rows are dealt by ranges of it, and a row's place is that
    in its range and the number of rows in the ranges before."""
    parts = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a count per range
    before = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(every), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.join(before, "_part").withColumn("k", (own + F.col("_before")).cast("long")).drop("_part", "_before")


def queue_zip(queues: list[DataFrame], order: str = "seq", depth: str = "depth", max_depth: int = 25) -> DataFrame:
    """Firings of a procedure that takes one item from each input queue, first in first out: k-th with k-th.
    The output's depth is the largest input depth and one; beyond ``max_depth`` nothing fires. Each table is one queue."""
    out = None
    for i, q in enumerate(queues):
        q = numbered(q, order).select("k", F.col("value").alias(f"value_{i}"), F.col(depth).alias(f"depth_{i}"))
        out = q if out is None else out.join(q, "k")
    depths = [F.col(f"depth_{i}") for i in range(len(queues))]
    out = out.withColumn("depth", (F.greatest(*depths) if len(depths) > 1 else depths[0]) + 1).where(F.col("depth") <= max_depth)
    return out.select("k", *[f"value_{i}" for i in range(len(queues))], "depth")
