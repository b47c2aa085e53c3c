"""Control flow, records, guidance, corrections, files and subscriptions: what runs on the driver gets its values from plans."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quern.catalog.base import LOG_SQL, QUERIES, TIMELINE_SQL, VARIANT_SQL, document_nodes, event_nodes, k, key, query, table, timeline, variant_events, write_log
from quern.functions import px
from quern.functions import text as tx
from quern.operators import guidance, merge, relational, rules, search
from quern.plans import ir, records
from quern.plans.compiler import Engine
from quern.plans.procedure import Dataflow, Interpreter, ProcedureError
from quern.plans.staging import scratch
from quern.sources import store
from quern.streaming import changes, timers

E = k("event_id")
_T = "(SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type)"


def _types(spark, sf_dir) -> list[dict]:
    """Events by type: a row per type."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").count().orderBy("event_type").collect()
    return [{"type": r[0], "n": r[1]} for r in rows]


def _count(spark, sf_dir):
    """An action that counts the events of a type by a plan."""
    e = table(spark, sf_dir, "events")
    return {"count": lambda p: e.where(F.col("event_type") == p["type"]).count()}


def _frame(spark, rows: list[tuple], schema: str):
    return spark.createDataFrame(rows, schema)


def _ns(spark, sf_dir) -> dict:
    return {t["type"]: t["n"] for t in _types(spark, sf_dir)}


# ---------------------------------------------------------------------------- procedures


@query("proc_define", f"SELECT sum(n)::DOUBLE AS total, (sum(n) * 2)::DOUBLE AS doubled FROM {_T} WHERE type IN ('view', 'click')")
def proc_define(spark, sf_dir):
    steps = [{"kind": "define", "name": "total", "expr": "view + click"}, {"kind": "define", "name": "doubled", "expr": "total * 2"}]
    v = Interpreter().run(steps, _ns(spark, sf_dir)).variables
    return _frame(spark, [(float(v["total"]), float(v["doubled"]))], "total double, doubled double")


@query("proc_append", f"SELECT (row_number() OVER (ORDER BY type) - 1)::INT AS position, type || '!' AS name FROM {_T}")
def proc_append(spark, sf_dir):
    steps = [{"kind": "loop", "over": "types", "as": "t", "steps": [{"kind": "append", "to": "names", "value": "${t.type}!"}]}]
    names = Interpreter().run(steps, {"types": _types(spark, sf_dir)}).variables["names"]
    return _frame(spark, list(enumerate(names)), "position int, name string")


@query("proc_call", f"SELECT n FROM {_T} WHERE type = 'view'")
def proc_call(spark, sf_dir):
    """A named action whose parameters come from variables and whose result goes to one."""
    steps = [{"kind": "call", "name": "count", "params": {"type": "$wanted"}, "output": "found"}]
    return _frame(spark, [(Interpreter(_count(spark, sf_dir)).run(steps, {"wanted": "view"}).variables["found"],)], "n long")


@query("proc_match", f"SELECT type, CASE WHEN n % 3 = 0 THEN 'three' WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS size FROM {_T}")
def proc_match(spark, sf_dir):
    arm = lambda c, v: {"condition": c, "steps": [{"kind": "define", "name": "size", "value": v}]}
    steps = [{"kind": "match", "arms": [arm("n % 3 == 0", "three"), arm("n % 2 == 0", "even"), arm("true", "odd")]}]
    return _frame(spark, [(t["type"], Interpreter().run(steps, t).variables["size"]) for t in _types(spark, sf_dir)], "type string, size string")


@query("proc_match_subject", f"SELECT type, CASE WHEN type IN ('view', 'click') THEN 'look' WHEN n % 2 = 0 THEN 'even ' || type ELSE 'other' END AS label FROM {_T}")
def proc_match_subject(spark, sf_dir):
    arms = [
        {"pattern": '"view" | "click"', "steps": [{"kind": "return", "value": "look"}]},
        {"pattern": "$t", "guard": "n % 2 == 0", "steps": [{"kind": "return", "value": "even ${t}"}]},
        {"pattern": "_", "steps": [{"kind": "return", "value": "other"}]},
    ]
    steps = [{"kind": "match", "subject": "type", "arms": arms}]
    return _frame(spark, [(t["type"], Interpreter().run(steps, t).value) for t in _types(spark, sf_dir)], "type string, label string")


@query("proc_when", f"SELECT type FROM {_T} WHERE n % 2 = 1")
def proc_when(spark, sf_dir):
    steps = [{"kind": "loop", "over": "types", "as": "t", "steps": [{"kind": "when", "condition": "t.n % 2 == 1", "steps": [{"kind": "append", "to": "odd", "value": "$t.type"}]}]}]
    found = Interpreter().run(steps, {"types": _types(spark, sf_dir), "odd": []}).variables["odd"]
    return _frame(spark, [(x,) for x in found], "type string")


@query("proc_loop", f"SELECT (row_number() OVER (ORDER BY type) - 1)::INT AS position, (n * 2 + row_number() OVER (ORDER BY type) - 1)::DOUBLE AS value FROM {_T}")
def proc_loop(spark, sf_dir):
    """A return ends its round; the loop's output is the list of what the rounds gave."""
    steps = [{"kind": "loop", "over": "types", "as": "t", "key": "i", "steps": [{"kind": "return", "expr": "t.n * 2 + i"}], "output": "all"}]
    out = Interpreter().run(steps, {"types": _types(spark, sf_dir)}).variables["all"]
    return _frame(spark, [(i, float(v)) for i, v in enumerate(out)], "position int, value double")


@query("proc_loop_times", "SELECT range::INT AS position, (range * range)::DOUBLE AS value FROM range(7)")
def proc_loop_times(spark, sf_dir):
    steps = [{"kind": "loop", "times": 7, "steps": [{"kind": "return", "expr": "item * index"}], "output": "all"}]
    return _frame(spark, [(i, float(v)) for i, v in enumerate(Interpreter().run(steps).variables["all"])], "position int, value double")


@query("proc_emit", f"SELECT 'counted' AS event, type, n FROM {_T}")
def proc_emit(spark, sf_dir):
    steps = [{"kind": "loop", "over": "types", "as": "t", "steps": [{"kind": "emit", "event": "counted", "data": {"type": "$t.type", "n": "$t.n"}}]}]
    events = Interpreter().run(steps, {"types": _types(spark, sf_dir)}).events
    return _frame(spark, [(e["event"], e["data"]["type"], e["data"]["n"]) for e in events], "event string, type string, n long")


@query("proc_try", f"SELECT n, 3::BIGINT AS attempts, 'it is broken' AS error, [1.0, 2.0]::DOUBLE[] AS waits FROM {_T} WHERE type = 'view'")
def proc_try(spark, sf_dir):
    """Retries with growing waits until the action succeeds; what never does is caught."""
    tried, waits, count = [], [], _count(spark, sf_dir)["count"]

    def flaky(p):
        tried.append(p)
        if len(tried) < 3:
            raise ValueError("not yet")
        return count(p)

    def broken(p):
        raise ValueError("it is broken")

    steps = [
        {"kind": "try", "retry": 5, "delay": 1.0, "backoff": "exponential", "steps": [{"kind": "call", "name": "flaky", "params": {"type": "view"}, "output": "n"}]},
        {"kind": "try", "steps": [{"kind": "call", "name": "broken"}], "catch": [{"kind": "define", "name": "seen", "expr": "error"}]},
    ]
    v = Interpreter({"flaky": flaky, "broken": broken}, sleep=waits.append).run(steps).variables
    return _frame(spark, [(v["n"], len(tried), v["seen"], waits)], "n long, attempts long, error string, waits array<double>")


@query("proc_parallel", f"SELECT type, n FROM {_T}")
def proc_parallel(spark, sf_dir):
    """Branches run at once, each a plan of its own."""
    types = [t["type"] for t in _types(spark, sf_dir)]
    steps = [{"kind": "parallel", "branches": {t: [{"kind": "call", "name": "count", "params": {"type": t}}] for t in types}, "timeout": 600, "output": "n"}]
    found = Interpreter(_count(spark, sf_dir)).run(steps).variables["n"]
    return _frame(spark, list(found.items()), "type string, n long")


@query("proc_parallel_failing", f"SELECT n, 'lost' AS error, 'branch b: lost' AS fast FROM {_T} WHERE type = 'click'")
def proc_parallel_failing(spark, sf_dir):
    """``complete`` keeps what the other branches gave, ``fast`` fails as a whole."""
    branches = {"a": [{"kind": "call", "name": "count", "params": {"type": "click"}}], "b": [{"kind": "abort", "message": "lost"}]}
    i = Interpreter(_count(spark, sf_dir))
    out = i.run([{"kind": "parallel", "branches": branches, "fail": "complete", "timeout": 600, "output": "r"}]).variables["r"]
    fast = i.run([{"kind": "try", "steps": [{"kind": "parallel", "branches": branches, "timeout": 600}], "catch": [{"kind": "return", "expr": "error"}]}]).value
    return _frame(spark, [(out["a"], out["b"]["error"], fast)], "n long, error string, fast string")


@query("proc_return", f"SELECT type AS first_odd FROM {_T} WHERE n % 2 = 1 ORDER BY type LIMIT 1")
def proc_return(spark, sf_dir):
    """A return ends the procedure: later steps do not run."""
    odd = [t["type"] for t in _types(spark, sf_dir) if t["n"] % 2]
    steps = [{"kind": "when", "condition": f'"{t}" in odd', "steps": [{"kind": "return", "value": t}]} for t in odd]
    value = Interpreter().run([*steps, {"kind": "abort", "message": "never"}], {"odd": odd}).value if odd else None
    return _frame(spark, [(value,)] if odd else [], "first_odd string")


@query("proc_abort", f"SELECT 'too many: ' || n AS message, false AS went_on FROM {_T} WHERE type = 'view'")
def proc_abort(spark, sf_dir):
    seen = []
    steps = [{"kind": "abort", "message": "too many: ${view}"}, {"kind": "call", "name": "next"}]
    try:
        Interpreter({"next": seen.append}).run(steps, _ns(spark, sf_dir))
        message = None
    except ProcedureError as e:
        message = str(e)
    return _frame(spark, [(message, bool(seen))], "message string, went_on boolean")


@query("proc_subcall", f"SELECT sum(n)::BIGINT AS both, max(n) FILTER (WHERE type = 'view')::DOUBLE AS view FROM {_T} WHERE type IN ('view', 'click')")
def proc_subcall(spark, sf_dir):
    """A procedure that calls another with parameters; a procedure without a return gives its variables."""
    sub = [{"kind": "call", "name": "count", "params": {"type": "$a"}, "output": "x"}, {"kind": "call", "name": "count", "params": {"type": "$b"}, "output": "y"}, {"kind": "return", "expr": "x + y"}]
    out = Interpreter(_count(spark, sf_dir), {"sum": sub, "vars": [{"kind": "define", "name": "kept", "expr": "n * 1"}]}).run([
        {"kind": "call", "name": "sum", "params": {"a": "view", "b": "click"}, "output": "both"},
        {"kind": "call", "name": "count", "params": {"type": "view"}, "output": "v"},
        {"kind": "call", "name": "vars", "params": {"n": "$v"}, "output": "inner"},
    ]).variables
    return _frame(spark, [(int(out["both"]), float(out["inner"]["kept"]))], "both long, view double")


@query("proc_pipe", f"SELECT ((n + 1) * 2)::DOUBLE AS value FROM {_T} WHERE type = 'purchase'")
def proc_pipe(spark, sf_dir):
    made = {"more": [{"kind": "return", "expr": "input + 1"}], "twice": [{"kind": "return", "expr": "input * 2"}]}
    return _frame(spark, [(float(Interpreter(procedures=made).pipe(["more", "twice"], _ns(spark, sf_dir)["purchase"])),)], "value double")


@query("dataflow_return", f"SELECT type, (n * 10)::BIGINT AS value, 1::INT AS depth FROM {_T}")
def dataflow_return(spark, sf_dir):
    """What a procedure returns goes to its output queue, one step deeper."""
    flow = Dataflow()
    flow.register("tenfold", ["in"], "out", lambda t: {"type": t["type"], "value": t["n"] * 10})
    for t in _types(spark, sf_dir):
        flow.push("in", t)
    flow.run()
    return _frame(spark, [(d.value["type"], d.value["value"], d.depth) for d in flow.queues["out"]], "type string, value long, depth int")


@query("event_dispatch", f"SELECT type, n, CASE WHEN type = 'error' THEN 'alarm' ELSE 'count' END AS handler FROM {_T}")
def event_dispatch(spark, sf_dir):
    """One handler, a plan, per event type."""
    e = table(spark, sf_dir, "events")
    make = lambda name: lambda rows: rows.groupBy(F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).withColumn("handler", F.lit(name))
    handlers = {t["type"]: make("alarm" if t["type"] == "error" else "count") for t in _types(spark, sf_dir)}
    out = None
    for part in changes.dispatch(e, handlers).values():
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------------------- records


def _program() -> records.Program:
    return records.Program.load([
        {"key": "px:fact/reading", "data": {"type": "fact", "name": "reading", "fields": [{"name": "event_id", "type": "int"}, {"name": "event_type", "type": "string"}, {"name": "value", "type": "string"}]}},
        {"key": "px:constraint/cap", "data": {"type": "constraint", "name": "cap", "when": 'event_type == "purchase"', "require": "value <= 90", "message": "${event_type} of ${user_id}"}},
        {"key": "px:constraint/low", "data": {"type": "constraint", "name": "low", "require": "value > 2", "severity": "warning"}},
        {"key": "px:rule/big", "data": {"type": "rule", "name": "big", "priority": 80, "conditions": ["value > 60", "user_id < 50"], "actions": [{"kind": "notify"}, {"kind": "stop", "condition": "value > 95"}]}},
        {"key": "px:procedure/twice", "data": {"type": "procedure", "name": "twice", "params": ["n"], "trigger": {"kind": "tick"}, "steps": [{"kind": "return", "expr": "n * 2"}]}},
        {"key": "px:procedure/bad", "data": {"type": "procedure", "name": "bad", "steps": []}},
        {"key": "px:scenario/s", "data": {"type": "scenario", "name": "s", "given": {"a": 1}, "variables": {"value": 1}, "steps": [
            {"kind": "call", "name": "twice", "params": {"n": 21}, "output": "two"}, {"kind": "call", "name": "put", "params": {"key": "k", "value": "$two"}}, {"kind": "emit", "event": "done"}],
            "expect": [{"check": "has_entry", "params": {"key": "a"}}, {"check": "store_value", "params": {"key": "k", "value": 42}}, {"check": "event_emitted", "params": {"event": "done"}},
                       {"check": "constraint_violated", "params": {"name": "low"}}, {"check": "constraint_violated", "params": {"name": "cap"}}, {"check": "var_equals", "params": {"var": "two", "value": 41}}, {"check": "is_healthy"}]}},
    ])


@query("record_constraints", f"""SELECT {E} AS id, 'cap' AS "constraint", 'error' AS severity, 'purchase of ' || user_id AS message FROM events WHERE event_type = 'purchase' AND value > 90
    UNION ALL SELECT {E}, 'low', 'warning', NULL FROM events WHERE value <= 2""")
def record_constraints(spark, sf_dir):
    return _program().violations(table(spark, sf_dir, "events")).select(key("event_id").alias("id"), "constraint", "severity", "message")


@query("record_rules", f"""SELECT {E} AS id, 'big' AS rule, 80 AS priority, 'notify' AS action FROM events WHERE value > 60 AND user_id < 50
    UNION ALL SELECT {E}, 'big', 80, 'stop' FROM events WHERE value > 95 AND user_id < 50""")
def record_rules(spark, sf_dir):
    return _program().fire(table(spark, sf_dir, "events")).select(key("event_id").alias("id"), "rule", "priority", "action")


@query("record_facts", "SELECT event_id, event_type, value::VARCHAR AS value FROM events")
def record_facts(spark, sf_dir):
    return _program().facts(table(spark, sf_dir, "events"), "reading")


@query("scenario_checks", "SELECT * FROM (VALUES ('0:has_entry', true), ('1:store_value', true), ('2:event_emitted', true), ('3:constraint_violated', true), ('4:constraint_violated', false), ('5:var_equals', false), ('6:is_healthy', true)) t(name, held)")
def scenario_checks(spark, sf_dir):
    return _frame(spark, list(records.run_scenario(_program(), "s").items()), "name string, held boolean")


@query("scenario_own_check", "SELECT true AS held")
def scenario_own_check(spark, sf_dir):
    """A check of the caller's own beside the built-in ones."""
    p = _program()
    p.of("scenario")["s"]["expect"] = [{"check": "large", "params": {"key": "k"}}]
    out = records.run_scenario(p, "s", checks={"large": lambda state, q: state.store[q["key"]] > 40})
    return _frame(spark, [(v,) for v in out.values()], "held boolean")


@query("record_lint", "SELECT * FROM (VALUES ('bad', 'PX-L001')) t(procedure, code)")
def record_lint(spark, sf_dir):
    return _frame(spark, [(f.procedure, f.code) for f in records.lint(_program())], "procedure string, code string")


@query("record_triggers", "SELECT 'twice' AS name")
def record_triggers(spark, sf_dir):
    return _frame(spark, [(n,) for n in _program().triggered("tick")], "name string")


# ---------------------------------------------------------------------------- rules and guidance


@query("correction_applied", f"SELECT {E} AS id, 'N-1' AS constraint_id FROM events WHERE NOT user_id % 5 < 3")
def correction_applied(spark, sf_dir):
    from quern.catalog.procedures import _actions

    book, new, _ = rules.apply_correction({}, "metadata.privilege_level < 3", "N-1")
    assert new and book["N-1"].description.startswith(rules.CORRECTION)
    return rules.evaluate(_actions(spark, sf_dir), list(book.values())).select("id", "constraint_id")


@query("correction_undone", f"SELECT {E} AS id, 'N-2' AS constraint_id FROM events WHERE NOT value / 100 < 0.8")
def correction_undone(spark, sf_dir):
    from quern.catalog.procedures import _actions

    book, _, _ = rules.apply_correction({}, "metadata.privilege_level < 3", "N-1")
    book, _, _ = rules.apply_correction(book, "risk_score < 0.8", "N-2")
    book, gone = rules.undo_correction(book, "N-1")
    assert gone is not None and rules.undo_correction(book, "N-9")[1] is None
    return rules.evaluate(_actions(spark, sf_dir), list(book.values())).select("id", "constraint_id")


def _evidence(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(key("event_id").alias("id"), F.when(F.col("user_id") % 3 == 0, "pass").when(F.col("user_id") % 3 == 1, "unknown").alias("status"))


@query("evidence_gaps", f"SELECT {E} AS id FROM events WHERE user_id % 3 <> 0")
def evidence_gaps(spark, sf_dir):
    return rules.gaps(_evidence(spark, sf_dir)).select("id")


@query("rule_relations", f"SELECT 'C' || (event_id % 3) AS constraint_id, 'A' || (event_id % 6) AS adr_id, {E} AS evidence_id FROM events")
def rule_relations(spark, sf_dir):
    """Constraints name decisions, decisions name evidence."""
    constraints = _frame(spark, [(f"C{i}", [f"A{i}", f"A{i + 3}"]) for i in range(3)], "id string, evidence array<string>")
    e = table(spark, sf_dir, "events")
    decisions = e.groupBy(F.concat(F.lit("A"), (F.col("event_id") % 6).cast("string")).alias("id")).agg(F.collect_list(key("event_id")).alias("evidence"))
    return rules.related(constraints, decisions, _evidence(spark, sf_dir))


@query("guidance_category", f"""SELECT {E} AS id, CASE WHEN user_id = 7 THEN 9 ELSE user_id % 4 END::INT AS priority FROM events WHERE event_type = 'click' AND user_id <> 8""")
def guidance_category(spark, sf_dir):
    """Entries with some replaced and some removed, by category."""
    e = table(spark, sf_dir, "events")
    entries = e.select(key("event_id").alias("id"), F.col("event_type").alias("category"), (F.col("user_id") % 4).cast("int").alias("priority"), (F.col("value") / 100).alias("confidence"))
    own = e.where("user_id = 7").select(key("event_id").alias("id"))
    entries = guidance.upsert(entries, entries.join(own, "id", "left_semi").withColumn("priority", F.lit(9)))
    gone = [r.id for r in e.where("user_id = 8").select(key("event_id").alias("id")).collect()]
    return guidance.by_category(guidance.remove(entries, gone), "click").select("id", "priority")


@query("guidance_events", "SELECT event_id AS seq FROM events ORDER BY event_id DESC LIMIT 50")
def guidance_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    return guidance.recent(guidance.push(e.where("seq % 2 = 0"), e.where("seq % 2 = 1")), 50)


# ---------------------------------------------------------------------------- streams, timers, merges


def _feed(spark, sf_dir, types: tuple[str, ...]):
    """The write log as files, a file per user group, and a stream over them."""
    folder = f"{scratch(spark)}/feed-{uuid.uuid4().hex}"
    write_log(spark, sf_dir).select("seq", "op", "id", "actor", "data").where(F.col("actor").isin(*types)).withColumn("ts", F.lit(None).cast("timestamp")).repartition(4).write.parquet(f"{folder}/in")
    return folder, changes.feed(spark, f"{folder}/in", per_batch=2)


@query("change_subscription", f"SELECT seq, op, id FROM ({LOG_SQL}) WHERE actor IN ('error', 'purchase')")
def change_subscription(spark, sf_dir):
    """Each micro-batch goes to a handler; a batch that comes again replaces itself."""
    folder, stream = _feed(spark, sf_dir, ("error", "purchase"))
    handler = lambda batch, n: batch.select("seq", "op", "id").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    changes.subscribe(stream, handler, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("seq", "op", "id")


@query("constraint_subscription", f"SELECT seq, 'S-1' AS constraint_id FROM ({LOG_SQL}) WHERE actor IN ('error', 'signup') AND op = 'Delete'")
def constraint_subscription(spark, sf_dir):
    """Constraints over a stream of actions: only violations are delivered."""
    folder, stream = _feed(spark, sf_dir, ("error", "signup"))
    actions = stream.select("seq", F.col("op").alias("action_type"), F.struct(F.lit(1).alias("risk_score")).alias("metadata"), F.lit("main").alias("session_type"))
    hits = changes.violations(actions, [rules.Constraint("S-1", rules.Always(), rules.Not(rules.ActionTypeEq("Delete")))])
    handler = lambda batch, n: batch.select("seq", "constraint_id").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    changes.subscribe(hits, handler, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("seq", "constraint_id")


@query("state_watch", "SELECT user_id::VARCHAR AS key, event_id AS ts FROM events WHERE event_id >= 500")
def state_watch(spark, sf_dir):
    states = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("ts"))
    return changes.watch(states, 500)


_TIMERS = "SELECT event_id, (event_id * 1000) AS next_ms, user_id % 2 = 0 AS active FROM events"


def _timers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(key("event_id").alias("id"), (F.col("event_id") * 1000).alias("next_ms"), (F.col("user_id") % 2 == 0).alias("active"), "event_id")


@query("timer_claims", f"SELECT {E} AS id, sha256({E} || ':' || next_ms || ':900000') AS token FROM ({_TIMERS}) WHERE active AND next_ms <= 900000 AND (event_id % 3 <> 0 OR event_id % 6 = 0)")
def timer_claims(spark, sf_dir):
    """Every third due timer is held; of those, every other one's claim is stale and is taken again."""
    t = _timers(spark, sf_dir)
    held = t.where("event_id % 3 = 0").select("id", F.lit("x").alias("token"), F.when(F.col("event_id") % 6 == 0, 800000).otherwise(899000).cast("long").alias("at_ms"))
    return timers.claim(t, held, 900000).select("id", "token")


@query("timer_backoff", f"SELECT {E} AS id FROM events WHERE 1000 * event_id + 1000 * least(300, 2 ** (user_id % 12)) > 600000")
def timer_backoff(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(key("event_id").alias("id"), (F.col("user_id") % 12).alias("attempts"), (F.col("event_id") * 1000).alias("failed_ms"))
    return timers.backed_off(f, 600000)


@query("two_way_sync", f"""SELECT {E} AS soul, 'v' AS field, CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END || user_id AS value_json FROM events""")
def two_way_sync(spark, sf_dir):
    """Two peers hold a register each; the later write wins, at equal times the greater text."""
    e = table(spark, sf_dir, "events")
    peer = lambda name, state: e.select(key("event_id").alias("soul"), F.lit("v").alias("field"), F.concat(F.lit(name), F.col("user_id").cast("string")).alias("value_json"), state.cast("double").alias("state"))
    a, b = peer("a", F.lit(10.0)), peer("b", F.when(F.col("event_id") % 3 == 0, 10.0).otherwise(9.0))
    return merge.sync(a, b).select("soul", "field", "value_json")


@query("rebuild_validated", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM ({LOG_SQL}) WHERE valid)
    SELECT id, seq, true AS refused FROM r WHERE n = 1 AND op = 'Put'""")
def rebuild_validated(spark, sf_dir):
    """A log with corrupted entries is refused; without them it is replayed."""
    log = write_log(spark, sf_dir)
    try:
        merge.rebuild(log)
        refused = False
    except merge.Unhealthy:
        refused = True
    return merge.rebuild(log.where("valid")).select("id", "seq", F.lit(refused).alias("refused"))


# ---------------------------------------------------------------------------- store and files


def _folder(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@query("lookup_with_metadata", f"SELECT {E} AS id, user_id, ts AS timestamp, map {{'local': 1::BIGINT}} AS clock FROM events WHERE event_id = 42")
def lookup_with_metadata(spark, sf_dir):
    e = event_nodes(spark, sf_dir).withColumn("clock", store.bump(F.lit(None).cast("map<string,bigint>"), "local"))
    found = store.Store(e).get(f"{42:012d}")
    return found.select("id", F.col("data")["user_id"].alias("user_id"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "clock")


@query("upsert_with_vector", "SELECT 'new' AS id, [1.0, 2.0]::DOUBLE[] AS embedding UNION ALL SELECT '000000000001', [3.0]")
def upsert_with_vector(spark, sf_dir):
    nodes = variant_events(spark, sf_dir).withColumn("embedding", F.lit(None).cast("array<float>"))
    s = store.Store(nodes).put("new", {"a": 1}, [1.0, 2.0]).put(f"{1:012d}", {"a": 2}, [3.0])
    return s.nodes.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("embedding"))


@query("cli_list", f"SELECT {E} AS id FROM events WHERE event_type = 'view' AND user_id % 2 = 0 ORDER BY event_id LIMIT 20")
def cli_list(spark, sf_dir):
    """By type and tag, the first by id."""
    e = table(spark, sf_dir, "events")
    tags = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("even"), F.lit("x"))).otherwise(F.array(F.lit("odd")))
    nodes = e.select(key("event_id").alias("id"), F.struct(F.col("event_type").alias("type"), tags.alias("tags")).alias("data"))
    return store.Store(nodes).select(type="view", tag="even", limit=20).select("id")


@query("type_catalog", "SELECT 'point' AS name, '{\"x\":\"int\"}' AS schema, 2::BIGINT AS instances")
def type_catalog(spark, sf_dir):
    s = store.Store(variant_events(spark, sf_dir)).define_type("point", {"x": "int"}).put("p1", {"type": "point"}).put("p2", {"type": "point"})
    n = s.instances("point").count()
    return s.types().crossJoin(F.broadcast(s.schema_of("point"))).withColumn("instances", F.lit(n).cast("long"))


@query("backup_restore", f"SELECT id, event_type, v FROM ({VARIANT_SQL})")
def backup_restore(spark, sf_dir):
    path = _folder(spark, "backup")
    store.backup(variant_events(spark, sf_dir), path)
    back = store.restore(spark, path)
    return back.select("id", F.try_variant_get("data", "$.event_type", "string").alias("event_type"), F.try_variant_get("data", "$.value", "double").alias("v"))


@query("migrate_vectors", f"SELECT {k('vec_id')} AS id, embedding::DOUBLE[] AS embedding, true AS ok FROM embeddings UNION ALL SELECT * FROM (VALUES ('bad', NULL::DOUBLE[], false), ('nan', NULL, false), ('odd', NULL, false))")
def migrate_vectors(spark, sf_dir):
    """Vectors as blobs of little-endian 32-bit floats; broken ones become NULL."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, "<f4").tobytes())

    rows = table(spark, sf_dir, "embeddings").select(key("vec_id").alias("id"), pack("embedding").alias("embedding"))
    broken = _frame(spark, [("bad", b""), ("nan", np.array([1, np.nan], "<f4").tobytes()), ("odd", b"abc")], "id string, embedding binary")
    out = store.decode_vectors(rows.unionByName(broken), "embedding")
    return out.select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("embedding").isNotNull().alias("ok"))


@query("snapshot_restore", f"SELECT id, event_type FROM ({VARIANT_SQL})")
def snapshot_restore(spark, sf_dir):
    """Snapshots in content-addressed chunks; a history of two keeps the newer ones; restored by the newest."""
    nodes, history = variant_events(spark, sf_dir), _frame(spark, [], store.HISTORY)
    for n, part in enumerate((nodes.limit(5), nodes.limit(9), nodes)):
        path = _folder(spark, "snapshot")
        manifest = store.snapshot(part, path)
        digest = manifest.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256).alias("hash"))
        history = store.remember(history, digest.select(F.lit(n).cast("long").alias("taken"), F.lit(f"s{n}").alias("label"), F.lit(path).alias("path"), "hash"), 2)
    kept = history.select("label", "hash").orderBy("label").collect()
    assert [r.label for r in kept] == ["s1", "s2"] and store.recall(history, kept[1].hash) == store.recall(history) and store.recall(history, "none") is None
    back = store.restore_snapshot(spark, store.recall(history))
    return back.select("id", F.try_variant_get("data", "$.event_type", "string").alias("event_type"))


@query("timeline_daily", f"SELECT strftime(to_timestamp(ts), '%Y-%m-%d') AS day, count(*) AS n FROM ({TIMELINE_SQL}) GROUP BY 1")
def timeline_daily(spark, sf_dir):
    path = _folder(spark, "daily")
    store.write_daily(timeline(spark, sf_dir), path)
    return spark.read.text(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("log_flush", f"""WITH l AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 256 AS batch FROM ({LOG_SQL}))
    SELECT batch, min(seq) AS first, max(seq) AS last, sha256(string_agg('{{"seq":' || seq || ',"op":"' || op || '"}}', chr(10) ORDER BY seq)) AS hash FROM l GROUP BY batch""")
def log_flush(spark, sf_dir):
    return store.flush(write_log(spark, sf_dir).select("seq", "op")).select("batch", "first", "last", "hash")


@query("blob_life", "SELECT sha256(event_type) AS hash, event_type AS content FROM events WHERE event_type <> 'error' GROUP BY event_type")
def blob_life(spark, sf_dir):
    """Put twice, delete one, look up."""
    import hashlib

    e = table(spark, sf_dir, "events").select("event_type")
    gone = hashlib.sha256(b"error").hexdigest()
    b = store.Blobs(_frame(spark, [], "hash string, content string")).put(e, "event_type").put(e, "event_type")
    assert b.exists(gone)
    b = b.delete([gone])
    assert not b.exists(gone)
    return b.table


@query("csv_round_trip", f"SELECT {E} AS id, event_type || ', \"' || user_id || '\"' AS label, value FROM events")
def csv_round_trip(spark, sf_dir):
    path, e = _folder(spark, "csv"), table(spark, sf_dir, "events")
    label = F.concat("event_type", F.lit(', "'), F.col("user_id").cast("string"), F.lit('"'))
    store.write_csv(e.select(key("event_id").alias("id"), label.alias("label"), "value"), path)
    return store.read_csv(spark, path, "id string, label string, value double")


@query("jsonl_export", f"SELECT {E} AS id, event_type, value FROM events")
def jsonl_export(spark, sf_dir):
    path = _folder(spark, "jsonl")
    store.write_jsonl(table(spark, sf_dir, "events").select(key("event_id").alias("id"), "event_type", "value"), path)
    return spark.read.schema("id string, event_type string, value double").json(path)


class _Admits(store.Plugin):
    """Nodes need a user; what is written is counted."""

    def __init__(self):
        self.written = self.deleted = 0

    def validate(self, nodes):
        return F.when(F.col("data")["user_id"] % 5 == 0, F.lit("no such user"))

    def on_written(self, nodes):
        self.written = nodes.count()

    def on_deleted(self, ids):
        self.deleted = ids.count()


@query("write_hooks", "SELECT count(*) AS rejected, (SELECT count(*) FROM events WHERE user_id % 5 <> 0 AND event_type = 'view') AS written, (SELECT count(*) FROM events WHERE event_type = 'click') AS deleted FROM events WHERE user_id % 5 = 0 AND event_type = 'view'")
def write_hooks(spark, sf_dir):
    e, plugin = event_nodes(spark, sf_dir), _Admits()
    kind = F.col("data")["event_type"]
    _, rejected = store.write_checked(e.where(kind != "view"), e.where(kind == "view"), plugin)
    store.delete_checked(e, e.where(kind == "click").select("id"), plugin)
    n = rejected.agg(F.count(F.lit(1)).alias("rejected"))
    return n.select("rejected", F.lit(plugin.written).cast("long").alias("written"), F.lit(plugin.deleted).cast("long").alias("deleted"))


# ---------------------------------------------------------------------------- pipelines, search, text


@query("dsl_errors", "SELECT * FROM (VALUES ('filter(', true), ('nonsense(1)', true), ('limit(\"x\")', true), ('', true), ('sort(by: \"a\", up: 1)', true), ('limit(3)', false)) t(text, refused)")
def dsl_errors(spark, sf_dir):
    from quern.plans.parser import parse

    def refused(text: str) -> bool:
        try:
            parse(text)
        except ir.QueryError:
            return True
        return False

    texts = ["filter(", "nonsense(1)", 'limit("x")', "", 'sort(by: "a", up: 1)', "limit(3)"]
    return _frame(spark, [(t, refused(t)) for t in texts], "text string, refused boolean")


@query("result_envelope", "SELECT false AS has_rows, false AS has_value, 2::INT AS mutated")
def result_envelope(spark, sf_dir):
    """A mutation's result: no rows, no value, a count."""
    ops = (ir.MutateOp("put", "a", {"x": 1}), ir.MutateOp("delete", f"{1:012d}"), ir.MutateOp("delete", "nobody"))
    r = Engine(variant_events(spark, sf_dir)).run([ir.Mutate(ops)])
    return _frame(spark, [(not r.nodes.isEmpty(), r.aggregate is not None, r.mutated)], "has_rows boolean, has_value boolean, mutated int")


@query("mutate_atomic", "SELECT true AS refused, count(*) AS n FROM events")
def mutate_atomic(spark, sf_dir):
    """A batch that deletes a missing id fails as a whole."""
    nodes = variant_events(spark, sf_dir)
    try:
        nodes = store.Store(nodes).apply([ir.MutateOp("put", "a", {}), ir.MutateOp("delete", "nobody")], atomic=True).nodes
        refused = False
    except store.NotFound:
        refused = True
    return nodes.agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n"))


@query("mutate_dsl", f"SELECT id, CASE WHEN id = '{5:012d}' THEN 1.5 ELSE v END AS value FROM ({VARIANT_SQL}) UNION ALL SELECT 'extra', 9.0")
def mutate_dsl(spark, sf_dir):
    e = Engine(variant_events(spark, sf_dir))
    e = Engine(e.dsl('mutate(put, id: "extra", data: "{\\"value\\": 9.0}")').store)
    done = e.dsl(f'mutate(merge, id: "{5:012d}", patch: "{{\\"value\\": 1.5}}")').store
    return done.select("id", F.try_variant_get("data", "$.value", "double").alias("value"))


@query("vector_api_thresholds", "SELECT * FROM (VALUES (-3.0::DOUBLE, 5::BIGINT), (7.0, 0), ('nan'::DOUBLE, 5)) t(threshold, n)")
def vector_api_thresholds(spark, sf_dir):
    """Thresholds beyond 0 to 1 are moved to the nearer end; what is no number counts as 0."""
    from quern.catalog.searches import NOW, _query_vector, _vectors

    v, q = _vectors(spark, sf_dir), _query_vector(spark, sf_dir)
    return _frame(spark, [(t, search.vector_search(v, q, 5, t, NOW).count()) for t in (-3.0, 7.0, float("nan"))], "threshold double, n long")


@query("embed_texts", f"SELECT {k('doc_id')} AS id, [length(text)::DOUBLE, (length(text) - length(replace(text, ' ', '')))::DOUBLE] AS embedding, 2::INT AS dimension FROM documents")
def embed_texts(spark, sf_dir):
    """Any callable from a text to numbers embeds a column of texts."""
    d = document_nodes(spark, sf_dir)
    out = search.embed(d, lambda t: [float(len(t)), float(t.count(" "))], F.col("data")["text"])
    return out.select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dimension"))


@query("visual_query", f"SELECT {E} AS id FROM events WHERE event_type <> 'view' AND NOT contains(props, '7') AND (ends_with(event_type, 'k') OR (value > 90 AND user_id < 40)) AND props <> ''")
def visual_query(spark, sf_dir):
    n = event_nodes(spark, sf_dir)
    group = {"join": "and", "rules": [
        {"field": "event_type", "op": "not", "value": "view"}, {"field": "props", "op": "not_contains", "value": "7"}, {"field": "props", "op": "is_not_empty"},
        {"join": "or", "rules": [{"field": "event_type", "op": "ends", "value": "k"}, {"rules": [{"field": "value", "op": "gt", "value": 90}, {"field": "user_id", "op": "lt", "value": 40}]}]},
    ]}
    return n.where(relational.visual(n, group)).select("id")


def _text(name: str, column, oracle: str):
    @query(name, f"SELECT {E} AS id, {oracle} AS text FROM events")
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        made, kind = column
        return e.select(key("event_id").alias("id"), tx.compress(made(e), F.lit(kind)).alias("text"))


_PROSE = lambda e: F.concat_ws(" ", *[F.concat(F.lit(f"Sentence {i} of "), "event_type", F.lit(" "), F.col("user_id").cast("string"), F.lit(" goes on for a while.")) for i in range(9)])
_SAID = "'Sentence {} of ' || event_type || ' ' || user_id || ' goes on for a while.'"
_text("compress_prose", (_PROSE, "prose"), " || ' ' || ".join([*[_SAID.format(i) for i in range(3)], "'[… 3 sentences elided …]'", *[_SAID.format(i) for i in range(6, 9)]]))
_text("compress_error", (_PROSE, "error"), " || ' ' || ".join([*[_SAID.format(i) for i in range(3)], "'[… 3 sentences elided …]'", *[_SAID.format(i) for i in range(6, 9)]]))
_CODE = lambda e: F.concat_ws("\n", *[F.concat(F.lit(f"def f{i}_"), "event_type", F.lit(f"(x):\n    y = x + {i}\n    return y * "), F.col("user_id").cast("string")) for i in range(6)])
_text("compress_code", (_CODE, "code"), " || chr(10) || ".join(["'// [headroom: python body elided — 6 signature(s) kept]'", *[f"'def f{i}_' || event_type || '(x):'" for i in range(6)]]))


@query("content_type_kinds", f"SELECT {E} AS id, CASE user_id % 5 WHEN 0 THEN 'log' WHEN 1 THEN 'code' WHEN 2 THEN 'error' WHEN 3 THEN 'json' ELSE 'prose' END AS kind FROM events")
def content_type_kinds(spark, sf_dir):
    """Texts of every kind, made out of events."""
    e, c = table(spark, sf_dir, "events"), F.col("user_id") % 5
    name = F.col("event_type")
    log = F.concat(F.lit("2024-01-02 10:00:00 INFO "), name, F.lit("\r\n2024-01-02 10:00:01 WARN "), name, F.lit("\nplain "), name, F.lit("\n"))
    code = F.concat(F.lit("def "), name, F.lit("(x):\n    return {x};\nclass A:\n    pass\n"))
    error = F.concat(F.lit("Traceback of "), name, F.lit("\nCaused by: it\n at f(x)\n at g(y)"))
    json_ = F.concat(F.lit(' {"a": "'), name, F.lit('"}'))
    text = F.when(c == 0, log).when(c == 1, code).when(c == 2, error).when(c == 3, json_).otherwise(F.concat(F.lit("We saw a "), name, F.lit(".\nIt let us go on.")))
    return e.select(key("event_id").alias("id"), tx.content_type(text).alias("kind"))


def _px(name: str, text: str, sql: str, kind: str = "string", data=lambda e: e):
    @query(f"px_{name}", f"SELECT {E} AS id, ({sql}) AS v FROM events")
    def run(spark, sf_dir):
        e = data(table(spark, sf_dir, "events"))
        v = px.to_column(px.parse(text), px.Scope(e))
        return e.select(key("event_id").alias("id"), {"string": v.string, "number": v.number, "boolean": v.truth}[kind].alias("v"))


_px("coercion", '(user_id | pad_left(6, "0")) * 2 - "1.5"', "user_id * 2 - 1.5::DOUBLE", "number")
_px("default_pipe", 'nothing | default("none") | uppercase', "'NONE'")
_px("default_pipe_kept", 'event_type | default("none")', "event_type")
_px("tuple_pattern", 'match pair { ("view", 0..50) => "early view", (_, $n) if n > 90 => "late", ("click", _) => "click", _ => "rest" }',
    "CASE WHEN event_type = 'view' AND user_id >= 0 AND user_id < 50 THEN 'early view' WHEN user_id > 90 THEN 'late' WHEN event_type = 'click' THEN 'click' ELSE 'rest' END",
    data=lambda e: e.withColumn("pair", F.try_variant_get(F.parse_json(F.concat(F.lit('["'), "event_type", F.lit('",'), F.col("user_id").cast("string"), F.lit("]"))), "$", "array<variant>")))
_px("struct_pattern", 'match node { {kind: "view", at: {user: $u}} => u, {kind: "click"} => "click", _ => "other" }',
    "CASE event_type WHEN 'view' THEN user_id::VARCHAR WHEN 'click' THEN 'click' ELSE 'other' END",
    data=lambda e: e.withColumn("node", F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user")).alias("at"))))
_px("cases_of_columns", '("someValue " + event_type) | snake_case', "'some_value_' || event_type")
_px("type_of_values", "type_of(if_else(user_id > 50, event_type, nothing))", "CASE WHEN user_id > 50 THEN 'string' ELSE 'null' END")
_px("is_empty_values", 'is_empty(event_type | replace("view", ""))', "event_type = 'view'", "boolean")


@query("px_variable", f"SELECT type || ' ' || n AS v FROM {_T}")
def px_variable(spark, sf_dir):
    """``$name`` is a whole value, ``${...}`` a part of a text."""
    steps = [{"kind": "define", "name": "whole", "value": "$n"}, {"kind": "return", "value": "${type} ${whole}"}]
    return _frame(spark, [(Interpreter().run(steps, t).value,) for t in _types(spark, sf_dir)], "v string")


#: The queries of this module.
NAMES = sorted(n for n, f in QUERIES.items() if f.__module__ == __name__)
