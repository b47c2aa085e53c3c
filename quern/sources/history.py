"""Command history and its analytic views.

Rows: command, hostname, shell_type, username, timestamp (ms), duration_ms, exit_code, session_id, ...
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["hostname", "shell_type", "command", "timestamp"]


def _counted() -> list[Column]:
    ok = F.coalesce("is_success", F.lit(False))
    return [F.sum(F.when(ok, 1).otherwise(0)).alias("success_count"), F.sum(F.when(ok, 0).otherwise(1)).alias("failure_count")]


def command_history(rows: DataFrame) -> DataFrame:
    """Unique rows with the generated ``is_success``."""
    return rows.dropDuplicates(KEY).withColumn("is_success", F.col("exit_code") == 0)


def unique(h: DataFrame) -> DataFrame:
    return h.groupBy("command", "hostname", "shell_type").agg(
        F.max("timestamp").alias("last_executed"), F.count(F.lit(1)).alias("execution_count"), *_counted(), F.avg("duration_ms").alias("avg_duration_ms"),
        F.array_join(F.array_sort(F.collect_set("username")), ",").alias("users"),
    )


def frequency(h: DataFrame) -> DataFrame:
    return h.groupBy("command").agg(
        F.count(F.lit(1)).alias("total_executions"), F.countDistinct("hostname").alias("unique_hosts"), F.countDistinct("shell_type").alias("unique_shells"), *_counted(),
        F.avg("duration_ms").alias("avg_duration_ms"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
    )


def failed(h: DataFrame) -> DataFrame:
    return h.where(~F.col("is_success")).select("command", "hostname", "shell_type", "timestamp", "exit_code", "duration_ms")


def sessions(h: DataFrame) -> DataFrame:
    return h.where("session_id is not null").groupBy("session_id").agg(
        F.min("hostname").alias("hostname"), F.min("shell_type").alias("shell_type"), F.min("timestamp").alias("session_start"), F.max("timestamp").alias("session_end"),
        F.count(F.lit(1)).alias("command_count"), *_counted(),
    )


def hosts(h: DataFrame) -> DataFrame:
    day = F.to_date(F.timestamp_millis("timestamp"))
    return h.groupBy("hostname").agg(
        F.countDistinct("shell_type").alias("shell_types"), F.count(F.lit(1)).alias("total_commands"), *_counted(), F.min("timestamp").alias("first_activity"),
        F.max("timestamp").alias("last_activity"), F.countDistinct(day).alias("active_days"),
    )


def search(h: DataFrame, command: str | None = None, host: str | None = None, shell: str | None = None, success: bool | None = None, last: int | None = None, unique_only: bool = False) -> DataFrame:
    """The history filter: LIKE ignores case, as in the embedded engine."""
    if command is not None:
        h = h.where(F.col("command").ilike(f"%{command}%"))
    if host is not None:
        h = h.where(F.col("hostname") == host)
    if shell is not None:
        h = h.where(F.col("shell_type") == shell)
    if success is not None:
        h = h.where(F.col("is_success") == success)
    if unique_only:
        out = unique(h).orderBy(F.desc("last_executed"), "command", "hostname", "shell_type")
    else:
        out = h.orderBy(F.desc("timestamp"), "command", "hostname", "shell_type")
    return out if last is None else out.limit(last)
