"""Pipelines: predicates, projection, sort, limit, aggregates, control flow, mutation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog.base import VARIANT_SQL, document_nodes, event_nodes, k, query, variant_events
from quern.plans import ir
from quern.plans.builder import Mutations, Query
from quern.plans.compiler import Engine
from quern.plans.ir import P
from quern.sources import store


def _rows(df, *fields):
    return df.select("id", *[F.col("data")[f].alias(f) for f in fields])


def _dsl(name: str, text: str, sql: str, *fields: str, nodes=event_nodes):
    @query(name, sql)
    def run(spark, sf_dir):
        return _rows(Engine(nodes(spark, sf_dir)).dsl(text).df, *fields)


ID = f"{k('event_id')} AS id"
_dsl(
    "flagship", 'filter(event_type == "purchase" and value > 100) |> sort(by: "value", dir: "desc") |> limit(20) |> project(["user_id", "value"])',
    f"SELECT {ID}, user_id, value FROM events WHERE event_type = 'purchase' AND value > 100 ORDER BY value DESC, event_id LIMIT 20", "user_id", "value",
)
for _name, _text, _where in [
    ("filter_eq", 'event_type == "click"', "event_type = 'click'"),
    ("filter_eq_number", "user_id == 7", "user_id = 7"),
    ("filter_eq_type_mismatch", 'user_id == "7"', "false"),
    ("filter_ne", 'event_type != "click"', "event_type <> 'click'"),
    ("filter_ne_missing", 'nothing != "x"', "true"),
    ("filter_eq_null_missing", "nothing == null", "true"),
    ("filter_gt", "value > 95", "value > 95"),
    ("filter_ge", "value >= 95", "value >= 95"),
    ("filter_lt", "value < 5", "value < 5"),
    ("filter_le", "value <= 5", "value <= 5"),
    ("filter_gt_on_text", 'event_type > 5', "false"),
    ("filter_contains", 'event_type contains "ic"', "contains(event_type, 'ic')"),
    ("filter_starts_with", 'event_type starts_with "pu"', "starts_with(event_type, 'pu')"),
    ("filter_matches", 'event_type matches "ie"', "contains(event_type, 'ie')"),
    ("filter_and_or_not", 'event_type == "view" and (value > 50 or not user_id >= 20)', "event_type = 'view' AND (value > 50 OR NOT user_id >= 20)"),
    ("filter_id_attribute", 'id starts_with "00000000001"', f"starts_with({k('event_id')}, '00000000001')"),
]:
    _dsl(_name, f"filter({_text}) |> project([\"event_type\", \"user_id\", \"value\"])", f"SELECT {ID}, event_type, user_id, value FROM events WHERE {_where}", "event_type", "user_id", "value")


def _variant(name: str, text: str, where: str):
    @query(name, f"SELECT id FROM ({VARIANT_SQL}) WHERE {where}")
    def run(spark, sf_dir):
        return Engine(variant_events(spark, sf_dir)).dsl(text).df.select("id")


_variant("variant_filter_gt", "filter(value > 50)", "coalesce(v > 50, false)")
_variant("variant_filter_not_gt", "filter(not value > 50)", "NOT coalesce(v > 50, false)")
_variant("variant_filter_null", "filter(value == null)", "v IS NULL")
_variant("variant_filter_ne", "filter(value != null)", "v IS NOT NULL")
_variant("filter_nested_json", "filter(props.k >= 50 and event_type == \"click\")", "pk >= 50 AND event_type = 'click'")
_variant("sort_missing_first", 'filter(user_id < 30) |> sort(by: "value") |> limit(60)', f"id IN (SELECT id FROM ({VARIANT_SQL}) WHERE user_id < 30 ORDER BY (CASE WHEN missing THEN 0 WHEN empty THEN 1 ELSE 3 END), v, id LIMIT 60)")
_variant("sort_missing_last_desc", 'filter(user_id < 3) |> sort(by: "value", dir: "desc") |> limit(60)', f"id IN (SELECT id FROM ({VARIANT_SQL}) WHERE user_id < 3 ORDER BY (CASE WHEN missing THEN 0 WHEN empty THEN 1 ELSE 3 END) DESC, v DESC NULLS LAST, id LIMIT 60)")


@query("variant_project", f"""SELECT id, CASE WHEN missing THEN '{{"k":' || pk::BIGINT || ',"user_id":' || user_id || '}}' ELSE '{{"k":' || pk::BIGINT || ',"user_id":' || user_id || ',"value":null}}' END AS data
    FROM ({VARIANT_SQL}) WHERE event_id % 7 = 0 OR event_id % 11 = 0""")  # fmt: skip
def variant_project(spark, sf_dir):
    """Absent paths are left out, null ones stay."""
    df = Engine(variant_events(spark, sf_dir)).dsl('filter(value == null) |> project(["props.k", "value", "user_id"])').df
    return df.select("id", F.to_json("data").alias("data"))


@query("project_alias", f"SELECT {ID}, event_type AS kind, value AS amount FROM events")
def project_alias(spark, sf_dir):
    return _rows(Engine(event_nodes(spark, sf_dir)).run(Query().project(kind="event_type", amount="value").to_steps()).df, "kind", "amount")


@query("project_last_name_wins", f"SELECT {ID}, value AS x FROM events")
def project_last(spark, sf_dir):
    steps = [ir.Project((ir.FieldSpec("user_id", "x"), ir.FieldSpec("value", "x")))]
    return _rows(Engine(event_nodes(spark, sf_dir)).run(steps).df, "x")


_dsl("sort_asc_limit", 'sort(by: "value") |> limit(25)', f"SELECT {ID}, value FROM events ORDER BY value, event_id LIMIT 25", "value")
_dsl("sort_desc_limit", 'sort(by: "user_id", dir: "desc") |> limit(25)', f"SELECT {ID}, user_id FROM events ORDER BY user_id DESC, event_id LIMIT 25", "user_id")
_dsl("sort_string", 'sort(by: "event_type") |> limit(40)', f"SELECT {ID}, event_type FROM events ORDER BY event_type, event_id LIMIT 40", "event_type")
_dsl("limit_then_sort", 'filter(value > 10) |> limit(15) |> sort(by: "value")', f"SELECT {ID}, value FROM events WHERE value > 10 ORDER BY value, event_id LIMIT 15", "value")
_dsl("limit_alone", "limit(12)", f"SELECT {ID}, value FROM events ORDER BY event_id LIMIT 12", "value")
_dsl("limit_min", "filter(value > 10) |> limit(9) |> limit(30)", f"SELECT {ID}, value FROM events WHERE value > 10 ORDER BY event_id LIMIT 9", "value")
_dsl("skip_limit", 'sort(by: "value") |> skip(5) |> limit(7)', f"SELECT {ID}, value FROM events ORDER BY value, event_id LIMIT 7 OFFSET 5", "value")
_CURSOR = "(SELECT user_id FROM events WHERE event_id = 5)"
_dsl(
    "sort_cursor", 'sort(by: "user_id", dir: "desc", after: "000000000005") |> limit(30)',
    f"SELECT {ID}, user_id FROM events WHERE user_id < {_CURSOR} OR (user_id = {_CURSOR} AND event_id > 5) ORDER BY user_id DESC, event_id LIMIT 30", "user_id",
)
_dsl("sort_cursor_unknown", 'sort(by: "value", after: "nobody") |> limit(5)', f"SELECT {ID}, value FROM events ORDER BY value, event_id LIMIT 5", "value")

for _fn, _sql in [("count", "count(*)"), ("sum", "round(sum(value), 4)"), ("avg", "round(avg(value), 6)"), ("min", "min(value)"), ("max", "max(value)")]:

    @query(f"agg_{_fn}", f"SELECT {_sql} AS value FROM events WHERE event_type = 'purchase'")
    def _agg(spark, sf_dir, fn=_fn):
        text = f'filter(event_type == "purchase") |> aggregate({fn}{"" if fn == "count" else ", field: " + chr(34) + "value" + chr(34)})'
        df = Engine(event_nodes(spark, sf_dir)).dsl(text).df
        return df.select(F.round("value", {"sum": 4, "avg": 6}[fn]).alias("value")) if fn in ("sum", "avg") else df


@query("agg_empty", "SELECT CAST(NULL AS DOUBLE) AS value")
def agg_empty(spark, sf_dir):
    return Engine(event_nodes(spark, sf_dir)).dsl('filter(event_type == "none") |> aggregate(sum, field: "value")').df


@query("agg_distinct", "SELECT list(j ORDER BY i) AS values FROM (SELECT '\"' || event_type || '\"' AS j, min(event_id) AS i FROM events GROUP BY event_type)")
def agg_distinct(spark, sf_dir):
    return Engine(event_nodes(spark, sf_dir)).dsl('aggregate(distinct, field: "event_type")').df


@query("agg_collect", "SELECT list(user_id::VARCHAR ORDER BY event_id) AS values FROM events WHERE value > 99")
def agg_collect(spark, sf_dir):
    return Engine(event_nodes(spark, sf_dir)).dsl('filter(value > 99) |> aggregate(collect, field: "user_id")').df


@query("limit_then_aggregate", "SELECT round(sum(value), 4) AS value FROM (SELECT value FROM events WHERE value > 50 ORDER BY event_id LIMIT 100)")
def limit_aggregate(spark, sf_dir):
    return Engine(event_nodes(spark, sf_dir)).dsl('filter(value > 50) |> limit(100) |> aggregate(sum, field: "value")').df.select(F.round("value", 4).alias("value"))


@query("count_by_type", "SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type")
def count_by_type(spark, sf_dir):
    from quern.operators.relational import count_by

    return count_by(event_nodes(spark, sf_dir), "event_type")


@query("ir_json", f"SELECT {ID}, value FROM events WHERE event_type = 'view' OR value >= 99 ORDER BY value DESC, event_id LIMIT 10")
def ir_json(spark, sf_dir):
    text = Query().filter((P("event_type") == "view") | (P("value") >= 99)).sort_desc("value").limit(10).to_json()
    return _rows(Engine(event_nodes(spark, sf_dir)).json(text).df, "value")


@query("conditional_then", f"SELECT {ID}, value FROM events WHERE value > 90")
def conditional_then(spark, sf_dir):
    """The first row by id decides: a positive value takes the first branch."""
    return _rows(Engine(event_nodes(spark, sf_dir)).dsl("conditional(value >= 0, then: [filter(value > 90)], else: [limit(3)])").df, "value")


@query("conditional_else", f"SELECT {ID}, value FROM events ORDER BY event_id LIMIT 3")
def conditional_else(spark, sf_dir):
    return _rows(Engine(event_nodes(spark, sf_dir)).dsl('conditional(event_type == "none", then: [filter(value > 90)], else: [limit(3)])').df, "value")


@query("assign_emit", f"SELECT {ID}, value, 'top' AS _label FROM events ORDER BY value DESC, event_id LIMIT 5")
def assign_emit(spark, sf_dir):
    text = 'sort(by: "value", dir: "desc") |> limit(5) |> assign(name: "best") |> filter(value < 1) |> emit(label: "top", from: "best")'
    return _rows_label(Engine(event_nodes(spark, sf_dir)).dsl(text).df)


def _rows_label(df):
    return df.select("id", F.col("data")["value"].alias("value"), "_label")


@query("emit_unknown", "SELECT '' AS id, 0.0::DOUBLE AS value, '' AS _label WHERE false")
def emit_unknown(spark, sf_dir):
    return _rows_label(Engine(event_nodes(spark, sf_dir)).dsl('emit(label: "x", from: "nobody")').df)


@query(
    "mutate_overlay",
    f"""SELECT id, CASE WHEN id = '{1:012d}' THEN 5.0 WHEN id = '{3:012d}' THEN 7.5 ELSE v END AS value, CASE WHEN id = '{1:012d}' THEN 'put' WHEN id = 'new' THEN 'put' ELSE event_type END AS event_type
    FROM (SELECT id, event_type, v FROM ({VARIANT_SQL}) UNION ALL SELECT 'new', 'put', 1.0) WHERE id <> '{2:012d}'""",
)
def mutate_overlay(spark, sf_dir):
    nodes = variant_events(spark, sf_dir)
    m = Mutations().put(f"{1:012d}", {"value": 5.0, "event_type": "put"}).delete(f"{2:012d}").merge(f"{3:012d}", {"value": 7.5}).put("new", {"value": 1.0, "event_type": "put"}).delete("never")
    done = store.Store(nodes).apply(m.ops).nodes
    return done.select("id", F.try_variant_get("data", "$.value", "double").alias("value"), F.try_variant_get("data", "$.event_type", "string").alias("event_type"))


@query("prefix_scan", f"SELECT {ID} FROM events WHERE starts_with({k('event_id')}, '0000000000')")
def prefix_scan(spark, sf_dir):
    return store.Store(event_nodes(spark, sf_dir)).scan_prefix("0000000000").select("id")


@query("range_scan", f"SELECT {ID} FROM events WHERE event_id >= 100 AND event_id < 250")
def range_scan(spark, sf_dir):
    return store.Store(event_nodes(spark, sf_dir)).scan_range(f"{100:012d}", f"{250:012d}").select("id")


@query("point_lookup", f"SELECT {ID}, value FROM events WHERE event_id = 77")
def point_lookup(spark, sf_dir):
    return _rows(store.Store(event_nodes(spark, sf_dir)).get(f"{77:012d}"), "value")


@query("list_by_category", f"SELECT {k('doc_id')} AS id FROM documents WHERE lang = 'de'")
def list_by_category(spark, sf_dir):
    return Engine(document_nodes(spark, sf_dir)).dsl('filter(category == "de")').df.select("id")


@query("store_stats", "SELECT NULL AS type, count(*) AS n FROM events UNION ALL SELECT event_type, count(*) FROM events GROUP BY event_type")
def store_stats(spark, sf_dir):
    e = event_nodes(spark, sf_dir)
    typed = e.withColumn("data", F.struct(F.col("data")["event_type"].alias("type")))
    return store.Store(typed).stats()
