"""Timeline, merges, logs, state, history views and plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog.base import HISTORY_SQL, LOG_SQL, TIMELINE_SQL, command_history, k, query, table, timeline, write_log
from quern.operators import merge
from quern.operators import timeline as tl
from quern.plans.sqlcompat import Database
from quern.sources import history as hist
from quern.sources import store
from quern.streaming import changes

T = TIMELINE_SQL
E = k("event_id")

# ---------------------------------------------------------------------------- timeline


@query("timeline_history", f"SELECT id, ts FROM ({T}) WHERE key = 'user:7' ORDER BY ts DESC, id LIMIT 10")
def timeline_history(spark, sf_dir):
    return tl.history(timeline(spark, sf_dir), "user:7", 10).select("id", "ts")


@query("timeline_latest", f"SELECT key, arg_max(id, (ts, id)) AS id, max(ts) AS ts FROM ({T}) GROUP BY key")
def timeline_latest(spark, sf_dir):
    return tl.latest(timeline(spark, sf_dir)).select("key", "id", "ts")


@query("timeline_parents", f"SELECT id, lag(id) OVER (PARTITION BY key ORDER BY ts, id) AS parent_id, sha256(actor) AS data_hash FROM ({T})")
def timeline_parents(spark, sf_dir):
    return tl.build(timeline(spark, sf_dir), F.col("actor")).select("id", "parent_id", "data_hash")


@query("timeline_by_actor", f"SELECT id FROM ({T}) WHERE actor = 'signup' ORDER BY ts DESC, id LIMIT 25")
def timeline_by_actor(spark, sf_dir):
    return tl.by_actor(timeline(spark, sf_dir), "signup", 25).select("id")


@query("timeline_in_range", f"SELECT id FROM ({T}) WHERE ts BETWEEN 1704500000 AND 1704600000")
def timeline_in_range(spark, sf_dir):
    return tl.in_range(timeline(spark, sf_dir), 1704500000, 1704600000).select("id")


@query("timeline_level", f"SELECT id FROM ({T}) WHERE ts >= 1705000000 AND level IN ('warn', 'error') ORDER BY ts DESC, id LIMIT 40")
def timeline_level(spark, sf_dir):
    return tl.timeline(timeline(spark, sf_dir), 40, 1705000000, "warn").select("id")


@query("timeline_recent", f"SELECT id FROM ({T}) ORDER BY ts DESC, id LIMIT 15")
def timeline_recent(spark, sf_dir):
    return tl.recent(timeline(spark, sf_dir), 15).select("id")


@query("timeline_record", f"SELECT id FROM ({T}) WHERE level <> 'debug'")
def timeline_record(spark, sf_dir):
    t = timeline(spark, sf_dir)
    return tl.record(t.limit(0), t, "info").select("id")


_R = f"WITH t AS ({T}), a AS (SELECT ts, id FROM t WHERE id = '{100:012d}'), b AS (SELECT ts, id FROM t WHERE id = '{200:012d}')"


@query("timeline_replay", f"{_R} SELECT t.id FROM t, a, b WHERE (t.ts, t.id) >= (a.ts, a.id) AND (t.ts, t.id) <= (b.ts, b.id)")
def timeline_replay(spark, sf_dir):
    return tl.replay(timeline(spark, sf_dir), f"{100:012d}", f"{200:012d}").select("id")


@query("timeline_replay_open", f"{_R} SELECT t.id FROM t, b WHERE (t.ts, t.id) <= (b.ts, b.id)")
def timeline_replay_open(spark, sf_dir):
    return tl.replay(timeline(spark, sf_dir), "nobody", f"{200:012d}").select("id")


# ---------------------------------------------------------------------------- registers and logs


def _registers(spark, sf_dir, part: int):
    e = table(spark, sf_dir, "events").where(f"event_id % 2 = {part}")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("soul"), F.col("event_type").alias("field"), F.col("props").alias("value_json"), (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3600000)).cast("double").alias("state"))


@query(
    "lww_merge",
    """WITH r AS (SELECT 'u' || user_id AS soul, event_type AS field, props AS value_json, floor(epoch_us(ts) // 1000 / 3600000)::DOUBLE AS state FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY soul, field ORDER BY state DESC, value_json DESC) AS n FROM r) SELECT soul, field, value_json, state FROM o WHERE n = 1""",
)
def lww_merge(spark, sf_dir):
    return merge.lww(_registers(spark, sf_dir, 0), _registers(spark, sf_dir, 1))


@query("register_explode", "SELECT event_id::VARCHAR AS soul, 'k' AS field, json_extract_string(props, '$.k') AS value_json, 1.0::DOUBLE AS state FROM events")
def register_explode(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.parse_json("props").alias("data"))
    return merge.registers(e, F.lit(1.0))


@query("wal_replay", f"WITH l AS ({LOG_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM l WHERE valid) SELECT id, data, seq FROM o WHERE n = 1 AND op = 'Put'")
def wal_replay(spark, sf_dir):
    return merge.replay(write_log(spark, sf_dir))


@query("wal_replay_actor", f"WITH l AS ({LOG_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM l WHERE valid AND actor = 'purchase') SELECT id, data, seq FROM o WHERE n = 1 AND op = 'Put'")
def wal_replay_actor(spark, sf_dir):
    return merge.replay(write_log(spark, sf_dir), "purchase")


@query("wal_stats", f"SELECT count(*) AS entries, count(*) FILTER (WHERE NOT valid) AS corrupted, count(*) FILTER (WHERE valid AND op = 'Put') AS puts, count(*) FILTER (WHERE valid AND op = 'Delete') AS deletes, round(count(*) FILTER (WHERE valid) / count(*), 8) AS recovery_rate, round(count(*) FILTER (WHERE NOT valid) / count(*), 8) AS corruption_rate FROM ({LOG_SQL})")
def wal_stats(spark, sf_dir):
    return merge.log_stats(write_log(spark, sf_dir)).withColumns({"recovery_rate": F.round("recovery_rate", 8), "corruption_rate": F.round("corruption_rate", 8)})


@query("wal_compact", f"WITH l AS ({LOG_SQL}) SELECT seq FROM l WHERE segment IN (SELECT segment FROM l GROUP BY segment HAVING max(seq) >= 5200)")
def wal_compact(spark, sf_dir):
    return merge.compact(write_log(spark, sf_dir), 5200).select("seq")


@query("actor_prune", "SELECT user_id AS actor, max(floor(epoch(ts)))::BIGINT AS last_seen FROM events GROUP BY user_id HAVING max(floor(epoch(ts))) >= 1706500000 - 2 * 86400")
def actor_prune(spark, sf_dir):
    a = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("actor")).agg(F.max(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("last_seen"))
    return merge.prune_actors(a, 1706500000, 2)


@query("clock_prune", "SELECT user_id, list(event_type ORDER BY event_type) AS actors FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) >= 5) GROUP BY user_id")
def clock_prune(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("clock"))
    kept = c.select("user_id", F.array_sort(F.map_keys(merge.prune_clock(F.col("clock"), 5))).alias("actors"))
    return kept.where(F.size("actors") > 0)


@query("store_overlay", f"WITH l AS ({LOG_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM l WHERE seq > 5000) SELECT id, data FROM o WHERE n = 1 AND op = 'Put' UNION ALL SELECT 'user:' || user_id, 'old' FROM (SELECT DISTINCT user_id FROM events) WHERE 'user:' || user_id NOT IN (SELECT id FROM l WHERE seq > 5000)")
def store_overlay(spark, sf_dir):
    log = write_log(spark, sf_dir)
    base = log.select("id").distinct().withColumn("data", F.lit("old"))
    return store.apply_changes(base, log.where("seq > 5000").select("seq", "op", "id", "data")).select("id", "data")


@query("blob_store", "SELECT DISTINCT sha256(text) AS hash, text AS content FROM documents")
def blob_store(spark, sf_dir):
    return store.blobs(table(spark, sf_dir, "documents"), "text")


# ---------------------------------------------------------------------------- state and streams


@query("event_poll", f"SELECT {E} AS id, floor(epoch(ts))::BIGINT AS ts FROM events WHERE floor(epoch(ts)) > 1706000000")
def event_poll(spark, sf_dir):
    return changes.poll(timeline(spark, sf_dir), 1706000000).select("id", "ts")


@query("state_latest", f"SELECT key, arg_max(actor, (ts, id)) AS value, max(ts) AS ts FROM ({T}) GROUP BY key")
def state_latest(spark, sf_dir):
    return changes.state_get(timeline(spark, sf_dir).withColumnRenamed("actor", "value"))


@query("state_changes", f"SELECT id, old_value, actor FROM (SELECT id, actor, lag(actor) OVER (PARTITION BY key ORDER BY id) AS old_value FROM ({T})) WHERE old_value IS DISTINCT FROM actor")
def state_changes(spark, sf_dir):
    return merge.change_log(timeline(spark, sf_dir), "key", "actor", "id").select("id", "old_value", "actor")


@query("timers_due", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 1704100000000 + 60000 ELSE event_id * 100000 + 1704000000000 END AS next_ms, event_id % 2 = 0 AS active FROM events WHERE event_id % 5 <> 0 AND event_id * 100000 + 1704000000000 <= 1704100000000")
def timers_due(spark, sf_dir):
    from quern.streaming import timers

    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "interval").otherwise("once").alias("kind"), F.lit(60000).cast("long").alias("every_ms"), F.lit(None).cast("string").alias("cron"),
        (F.col("event_id") * 100000 + 1704000000000).alias("next_ms"), (F.col("event_id") % 5 != 0).alias("active"),
    )
    return timers.advance(timers.due(e, 1704100000000), 1704100000000).select("id", "next_ms", "active")


@query("queue_zip", "WITH a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_type = 'view'), b AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_type = 'click') SELECT a.k, a.event_id AS value_0, b.event_id AS value_1, 1 AS depth FROM a JOIN b USING (k)")
def queue_zip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    q = lambda t: e.where(F.col("event_type") == t).select(F.lit(t).alias("queue"), F.col("event_id").alias("seq"), F.col("event_id").alias("value"), F.lit(0).alias("depth"))
    return changes.queue_zip([q("view"), q("click")])


@query("window_tumbling", "SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.windowed(e, "ts", ["event_type"], "1 day").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("window_sliding", "SELECT b - INTERVAL 1 hour * o AS window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 hour, ts) AS b FROM events) CROSS JOIN range(3) r(o) GROUP BY 1")
def window_sliding(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.windowed(e, "ts", [], "3 hours", "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(
    "window_session",
    """WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 hour THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def window_session(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return changes.sessions(e, "ts", "user_id", "6 hours").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


# ---------------------------------------------------------------------------- command history

H = HISTORY_SQL
_OK = "sum(CASE WHEN is_success THEN 1 ELSE 0 END)::BIGINT AS success_count, sum(CASE WHEN is_success THEN 0 ELSE 1 END)::BIGINT AS failure_count"


def _history(spark, sf_dir):
    return command_history(spark, sf_dir).withColumn("is_success", F.col("exit_code") == 0)


@query("hist_unique", f"SELECT command, hostname, shell_type, max(timestamp) AS last_executed, count(*) AS execution_count, {_OK}, round(avg(duration_ms), 6) AS avg_duration_ms, string_agg(DISTINCT username, ',' ORDER BY username) AS users FROM ({H}) GROUP BY ALL")
def hist_unique(spark, sf_dir):
    return hist.unique(_history(spark, sf_dir)).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@query("hist_frequency", f"SELECT command, count(*) AS total_executions, count(DISTINCT hostname) AS unique_hosts, count(DISTINCT shell_type) AS unique_shells, {_OK}, round(avg(duration_ms), 6) AS avg_duration_ms, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM ({H}) GROUP BY command")
def hist_frequency(spark, sf_dir):
    return hist.frequency(_history(spark, sf_dir)).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@query("hist_failed", f"SELECT command, hostname, shell_type, timestamp, exit_code, duration_ms FROM ({H}) WHERE NOT is_success")
def hist_failed(spark, sf_dir):
    return hist.failed(_history(spark, sf_dir))


@query("hist_sessions", f"SELECT session_id, min(hostname) AS hostname, min(shell_type) AS shell_type, min(timestamp) AS session_start, max(timestamp) AS session_end, count(*) AS command_count, {_OK} FROM ({H}) WHERE session_id IS NOT NULL GROUP BY session_id")
def hist_sessions(spark, sf_dir):
    return hist.sessions(_history(spark, sf_dir))


@query("hist_hosts", f"SELECT hostname, count(DISTINCT shell_type) AS shell_types, count(*) AS total_commands, {_OK}, min(timestamp) AS first_activity, max(timestamp) AS last_activity, count(DISTINCT timestamp // 86400000) AS active_days FROM ({H}) GROUP BY hostname")
def hist_hosts(spark, sf_dir):
    return hist.hosts(_history(spark, sf_dir))


@query("hist_search", f"SELECT command, hostname, timestamp FROM ({H}) WHERE command ILIKE '%VIEW%' AND hostname = 'host1' AND is_success ORDER BY timestamp DESC, command, hostname, shell_type LIMIT 20")
def hist_search(spark, sf_dir):
    return hist.search(_history(spark, sf_dir), command="VIEW", host="host1", success=True, last=20).select("command", "hostname", "timestamp")


@query("hist_insert_ignore", f"SELECT hostname, shell_type, command, timestamp FROM ({H}) GROUP BY ALL")
def hist_insert_ignore(spark, sf_dir):
    h = command_history(spark, sf_dir)
    return hist.command_history(h.union(h)).select("hostname", "shell_type", "command", "timestamp")


# ---------------------------------------------------------------------------- SQL


def _sql(name: str, text: str, oracle: str | None = None, params: list | None = None, tables: tuple[str, ...] = ("customer", "nation", "orders", "events")):
    @query(name, oracle or text)
    def run(spark, sf_dir):
        db = Database(spark)
        for t in tables:
            db.register(t, table(spark, sf_dir, t))
        return db.query(text, params)


_sql("sql_params", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = ?1 AND c_acctbal > ?2", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 1000", [3, 1000])
_sql("sql_join", "SELECT c_custkey, n_name FROM customer INNER JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal BETWEEN 0 AND 500")
_sql("sql_left_join_group", "SELECT c_custkey, COUNT(o_orderkey) AS n_orders, ROUND(SUM(CASE WHEN o_totalprice > 1000 THEN 1 ELSE 0 END), 0) AS big FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "SELECT c_custkey, COUNT(o_orderkey) AS n_orders, SUM(CASE WHEN o_totalprice > 1000 THEN 1 ELSE 0 END)::BIGINT AS big FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_sql("sql_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'build%')", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%')")
_sql("sql_case", "SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band FROM events")
_sql("sql_row_number", "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events", "SELECT event_id, (ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS rn FROM events")
_sql("sql_rank", "SELECT event_id, RANK() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM events", "SELECT event_id, (RANK() OVER (PARTITION BY event_type ORDER BY user_id))::INT AS r FROM events")
_sql("sql_lag", "SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
_sql("sql_recursive", "WITH RECURSIVE r(n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM r WHERE n < 20) SELECT n, s FROM r")
_sql("sql_json_extract", "SELECT event_id, json_extract(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
_sql("sql_union", "SELECT n_regionkey FROM nation UNION SELECT c_nationkey FROM customer")
_sql("sql_intersect", "SELECT n_nationkey FROM nation INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
_sql("sql_except", "SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
_sql("sql_group_concat", "SELECT c_nationkey, COUNT(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 1")
_sql("sql_aggregates", "SELECT o_orderpriority, COUNT(*) AS n, ROUND(AVG(o_totalprice), 4) AS mean, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high FROM orders GROUP BY o_orderpriority")
_sql("sql_numbered_params", "SELECT c_custkey, c_nationkey AS nation FROM customer WHERE c_acctbal > ?2 AND c_nationkey IN (?1, ?3, ?1) AND c_acctbal < ?2 + 9000 AND c_nationkey <> ?", "SELECT c_custkey, c_nationkey AS nation FROM customer WHERE c_acctbal > 500 AND c_nationkey IN (3, 7) AND c_acctbal < 9500 AND c_nationkey <> 5", [3, 500, 7, 5])
_sql("sql_group_concat_distinct", "SELECT c_nationkey, GROUP_CONCAT(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")


@query(
    "sql_statements",
    """WITH a AS (SELECT o_custkey AS id, count(*) AS n, 'old' AS kind FROM orders GROUP BY o_custkey),
    b AS (SELECT id, CASE WHEN n > 15 THEN n * 2 ELSE n END AS n, CASE WHEN n > 15 THEN 'big' ELSE kind END AS kind FROM a WHERE id % 7 <> 0)
    SELECT id, n, kind, NULL::DOUBLE AS share FROM b UNION ALL SELECT * FROM (VALUES (-1, 5, 'a;b', NULL::DOUBLE), (-2, 6, 'new', NULL))""",
)
def sql_statements(spark, sf_dir):
    """Statements that make, fill, change and empty tables."""
    db = Database(spark)
    db.register("orders", table(spark, sf_dir, "orders"))
    db.exec("""CREATE TABLE IF NOT EXISTS totals (id INTEGER PRIMARY KEY, n INTEGER NOT NULL DEFAULT 0, kind TEXT);
        CREATE INDEX IF NOT EXISTS totals_n ON totals (n);
        INSERT INTO totals SELECT o_custkey, COUNT(*), 'old' FROM orders GROUP BY o_custkey;
        UPDATE totals SET n = n * 2, kind = 'big' WHERE n > 15;
        DELETE FROM totals WHERE id % 7 = 0;
        INSERT OR IGNORE INTO totals (id, kind, n) VALUES (-1, 'a;b', 5), (-2, 'new', 6);
        INSERT OR IGNORE INTO totals (id, kind, n) VALUES (-1, 'again', 50);
        ALTER TABLE totals ADD COLUMN part REAL;
        ALTER TABLE totals RENAME COLUMN part TO share;
        CREATE VIEW all_totals AS SELECT * FROM totals""")
    return db.query("SELECT id, n, kind, share FROM all_totals")
