"""Registry, and the driver's tables as node, edge, timeline and log tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-01-31 00:00:00"


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with SQL that gives the same rows."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table for work that is heavy per row: dealt out if it is scanned in fewer tasks than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def key(col: str, width: int = 12):
    """Ids whose byte order is the numeric order."""
    return F.lpad(F.col(col).cast("string"), width, "0")


def k(col: str, width: int = 12) -> str:
    """The same in SQL."""
    return f"lpad(({col})::VARCHAR, {width}, '0')"


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        key("event_id").alias("id"), F.struct("event_id", "event_type", "user_id", "value", "props", F.col("event_type").alias("category")).alias("data"), F.col("ts").cast("timestamp").alias("timestamp")
    )


def variant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as schemaless nodes: value is left out of every seventh, null in every eleventh; props is nested."""
    e = table(spark, sf_dir, "events")
    body = F.concat(
        F.lit('{"event_type":"'), "event_type", F.lit('","user_id":'), F.col("user_id").cast("string"),
        F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 11 == 0, ',"value":null').otherwise(F.concat(F.lit(',"value":'), F.col("value").cast("string"))),
        F.lit(',"props":'), "props", F.lit("}"),
    )
    return e.select(key("event_id").alias("id"), F.parse_json(body).alias("data"), F.col("ts").cast("timestamp").alias("timestamp"))


#: The same rows in SQL: v is NULL where value is missing or null.
VARIANT_SQL = f"""SELECT {k("event_id")} AS id, event_id, event_type, user_id,
  CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE value END AS v,
  (event_id % 7 = 0) AS missing, (event_id % 7 <> 0 AND event_id % 11 = 0) AS empty,
  json_extract(props, '$.k')::DOUBLE AS pk FROM events"""


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(key("doc_id").alias("id"), F.struct("text", F.col("lang").alias("category"), "source", "n_chars", (F.col("n_chars") / 1000.0).alias("score")).alias("data"))


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, linked to the parts of their orders; strength is the mean discount in tenths."""
    li = table(spark, sf_dir, "lineitem")
    e = li.groupBy("l_suppkey", "l_partkey").agg(F.round(F.avg("l_discount") * 10, 4).alias("strength"))
    src, dst = F.concat(F.lit("s"), key("l_suppkey", 6)), F.concat(F.lit("p"), key("l_partkey", 6))
    return e.select(
        F.concat_ws(":", F.lit("edge"), src, dst).alias("id"), src.alias("src"), dst.alias("dst"), F.when(F.col("l_partkey") % 3 == 0, "related").otherwise("supplies").alias("label"),
        "strength", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("link_type"),
    )


EDGES_SQL = f"""SELECT 'edge:s' || {k("l_suppkey", 6)} || ':p' || {k("l_partkey", 6)} AS id, 's' || {k("l_suppkey", 6)} AS src, 'p' || {k("l_partkey", 6)} AS dst,
  CASE WHEN l_partkey % 3 = 0 THEN 'related' ELSE 'supplies' END AS label, round(avg(l_discount) * 10, 4) AS strength
  FROM lineitem GROUP BY l_suppkey, l_partkey"""


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts as nodes; category is the nation or the brand."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key("s_suppkey", 6)).alias("id"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("category"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), key("p_partkey", 6)).alias("id"), F.col("p_brand").alias("category"))
    return s.unionByName(p).select("id", F.struct("category").alias("data"))


NODES_SQL = f"""SELECT 's' || {k("s_suppkey", 6)} AS id, 'nation' || s_nationkey::VARCHAR AS category FROM supplier
  UNION ALL SELECT 'p' || {k("p_partkey", 6)}, p_brand FROM part"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").when(F.col("event_type") == "view", "debug").otherwise("info")
    return e.select(key("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("actor"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.lit("write").alias("action"), level.alias("level"))


TIMELINE_SQL = f"""SELECT {k("event_id")} AS id, floor(epoch(ts))::BIGINT AS ts, event_type AS actor, 'user:' || user_id::VARCHAR AS key, 'write' AS action,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS level FROM events"""


def write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write-ahead log: ids are users, errors delete, every 97th entry is corrupted."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("actor"), F.when(F.col("event_type") == "error", "Delete").otherwise("Put").alias("op"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.col("props").alias("data"), (F.col("event_id") % 97 != 0).alias("valid"),
        F.floor(F.col("event_id") / 500).cast("long").alias("segment"),
    )


LOG_SQL = """SELECT event_id AS seq, event_type AS actor, CASE WHEN event_type = 'error' THEN 'Delete' ELSE 'Put' END AS op,
  'user:' || user_id::VARCHAR AS id, props AS data, event_id % 97 <> 0 AS valid, (event_id // 500)::BIGINT AS segment FROM events"""


def command_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("hid"), F.concat_ws(" ", F.lit("run"), "event_type").alias("command"), F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("hostname"),
        F.when(F.col("user_id") % 2 == 0, "bash").otherwise("zsh").alias("shell_type"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("username"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.floor("value").cast("long").alias("duration_ms"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"),
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("sess"), F.col("user_id").cast("string"))).alias("session_id"),
    )


HISTORY_SQL = """SELECT * FROM (SELECT event_id AS hid, 'run ' || event_type AS command, 'host' || (user_id % 5)::VARCHAR AS hostname, CASE WHEN user_id % 2 = 0 THEN 'bash' ELSE 'zsh' END AS shell_type,
  'u' || (user_id % 3)::VARCHAR AS username, epoch_us(ts) // 1000 AS timestamp, floor(value)::BIGINT AS duration_ms, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code,
  CASE WHEN user_id % 10 <> 0 THEN 'sess' || user_id::VARCHAR END AS session_id, event_type <> 'error' AS is_success FROM events)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcome = F.when(F.col("value") < 40, "accepted").when(F.col("value") < 70, "corrected").when(F.col("value") < 90, "abandoned").otherwise("continued")
    return e.select(key("event_id").alias("id"), F.col("event_type").alias("route"), outcome.alias("outcome"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("props").alias("input_context"))


DECISIONS_SQL = f"""SELECT {k("event_id")} AS id, event_type AS route, CASE WHEN value < 40 THEN 'accepted' WHEN value < 70 THEN 'corrected' WHEN value < 90 THEN 'abandoned' ELSE 'continued' END AS outcome,
  's' || user_id::VARCHAR AS session_id, props AS input_context FROM events"""
