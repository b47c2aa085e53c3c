"""Timers (id, kind interval|cron|once, every_ms, cron, next_ms, active): which are due, and what comes next."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRY_CAP_S = 300
_RANGES = [(0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 6)]


class CronError(ValueError):
    """A cron expression that cannot be read."""


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        try:
            by = int(step) if step else 1
            if span == "*":
                a, b = low, high
            elif "-" in span:
                a, b = map(int, span.split("-"))
            else:
                a = int(span)
                b = high if step else a
        except ValueError:
            raise CronError(text) from None
        if by < 1 or not low <= a <= b <= high + (high == 6):
            raise CronError(text)
        out |= {v % 7 if high == 6 else v for v in range(a, b + 1, by)}
    return out


def parse_cron(text: str) -> list[set[int]]:
    """Fields of seconds to week days (0 is Sunday); five fields mean second 0."""
    parts = text.split()
    if len(parts) == 5:
        parts = ["0", *parts]
    if len(parts) != 6:
        raise CronError(text)
    return [_field(p, *r) for p, r in zip(parts, _RANGES)]


def next_fire(cron: str, after_ms: int) -> int | None:
    """The first time after ``after_ms`` (UTC) that a cron expression names, within four years."""
    sec, minute, hour, day, month, week = parse_cron(cron)
    t = datetime.fromtimestamp(after_ms // 1000, timezone.utc) + timedelta(seconds=1)
    end = t + timedelta(days=4 * 366)
    while t < end:
        if t.month not in month or t.day not in day or (t.weekday() + 1) % 7 not in week:
            t = (t + timedelta(days=1)).replace(hour=0, minute=0, second=0)
        elif t.hour not in hour:
            t = (t + timedelta(hours=1)).replace(minute=0, second=0)
        elif t.minute not in minute:
            t = (t + timedelta(minutes=1)).replace(second=0)
        elif t.second not in sec:
            t += timedelta(seconds=1)
        else:
            return int(t.timestamp()) * 1000
    return None


def due(timers: DataFrame, now_ms: int) -> DataFrame:
    return timers.where(F.col("active") & (F.col("next_ms") <= now_ms))


def advance(timers: DataFrame, now_ms: int) -> DataFrame:
    """Timers after the due ones fired: intervals from now, crons to their next time, once-timers off."""

    @F.pandas_udf("long")
    def cron_next(crons: pd.Series) -> pd.Series:
        return crons.map(lambda c: None if c is None else next_fire(c, now_ms)).astype("Int64")

    fired = F.col("active") & (F.col("next_ms") <= now_ms)
    new = F.when(F.col("kind") == "interval", F.lit(now_ms) + F.col("every_ms")).when(F.col("kind") == "cron", cron_next("cron")).otherwise(F.col("next_ms"))
    return timers.withColumn("next_ms", F.when(fired, new).otherwise(F.col("next_ms"))).withColumn("active", F.when(fired & (F.col("kind") == "once"), False).otherwise(F.col("active")))


def retry_delay(attempt: Column) -> Column:
    """Seconds before an attempt: powers of two, five minutes at most."""
    return F.least(F.lit(float(RETRY_CAP_S)), F.pow(F.lit(2.0), attempt))


def claim(timers: DataFrame, claims: DataFrame, now_ms: int, stale_ms: int = 60_000) -> DataFrame:
    """Claims (id, token, at_ms) for the due timers that nobody holds: a claim older than ``stale_ms`` counts as lost, so
    each firing is delivered at least once."""
    held = claims.where(F.col("at_ms") > now_ms - stale_ms).select("id")
    free = due(timers, now_ms).join(held, "id", "left_anti")
    token = F.sha2(F.concat_ws(":", "id", F.col("next_ms").cast("string"), F.lit(str(now_ms))), 256)
    return free.select("id", token.alias("token"), F.lit(now_ms).cast("long").alias("at_ms"))


def backed_off(failures: DataFrame, now_ms: int) -> DataFrame:
    """Timers (id, attempts, failed_ms) that wait until their next attempt."""
    return failures.where(F.col("failed_ms") + retry_delay(F.col("attempts")) * 1000 > now_ms).select("id")
