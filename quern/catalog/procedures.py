"""Domain procedures: documents, training data, decisions, rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.catalog.base import DECISIONS_SQL, decisions, k, key, query, table
from quern.functions import text as tx
from quern.operators import graph, rules
from quern.operators import procedures as pr

D, E = k("doc_id"), k("event_id")


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(key("doc_id").alias("id"), F.col("text").alias("content"), "lang")


@query("doc_dedup", f"SELECT min({D}) AS id, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content_hash FROM documents GROUP BY 2")
def doc_dedup(spark, sf_dir):
    return pr.store_documents(_documents(spark, sf_dir)).select("id", "content_hash")


@query("doc_chunks", f"WITH c AS (SELECT 'd' || (doc_id % 10) AS parent, {D} AS id, text FROM documents) SELECT parent AS src, min(id) AS dst, 'has_chunk' AS label FROM c GROUP BY parent, text")
def doc_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(key("doc_id").alias("id"), F.concat(F.lit("d"), (F.col("doc_id") % 10).cast("string")).alias("parent_id"), F.col("text").alias("content"))
    return pr.store_chunks(c)[1].select("src", "dst", "label")


@query("doc_link", f"SELECT {D} AS src, {k('doc_id + 1')} AS dst, 'related' AS label, least(1.0, n_chars / 2000.0)::DOUBLE AS strength FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)")
def doc_link(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    links = d.select(key("doc_id").alias("src"), F.lpad((F.col("doc_id") + 1).cast("string"), 12, "0").alias("dst"), F.lit(None).cast("string").alias("label"), (F.col("n_chars") / 2000.0).alias("strength"))
    return pr.link_chunks(links, d.select(key("doc_id").alias("id")))


@query("doc_enrich", f"SELECT {D} AS id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS word_count, length(text)::BIGINT AS char_count, CASE WHEN text = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[.!?]'))) END::BIGINT AS sentence_count FROM documents")
def doc_enrich(spark, sf_dir):
    return pr.enrich(_documents(spark, sf_dir)).select("id", "word_count", "char_count", "sentence_count")


def _memories(spark, sf_dir):
    """Turns of conversations as memories; each turn reinforces the one before, every third contradicts it."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    before = F.lag("id").over(w)
    empty = F.array().cast("array<string>")
    return c.select(
        "id", "text", F.col("role").alias("category"), F.col("conv_id").cast("string").alias("conversation_id"), "turn",
        F.when(before.isNotNull(), F.array(before)).otherwise(empty).alias("reinforces"),
        F.when(before.isNotNull() & (F.col("turn") % 3 == 0), F.array(before)).otherwise(empty).alias("contradicts"),
    )


_MEM = """SELECT conv_id::VARCHAR || '-' || turn::VARCHAR AS id, text, role, conv_id::VARCHAR AS conv, turn,
  lag(conv_id::VARCHAR || '-' || turn::VARCHAR) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations"""


@query("memory_enrich", f"SELECT id, length(text)::BIGINT AS char_count, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS word_count, 'general' AS category FROM ({_MEM})")
def memory_enrich(spark, sf_dir):
    return pr.enrich_memory(_memories(spark, sf_dir)).select("id", "char_count", "word_count", "category")


@query("context_window", f"SELECT id, coalesce(list(id) OVER (PARTITION BY conv ORDER BY turn, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS context FROM ({_MEM})")
def context_window(spark, sf_dir):
    return pr.attach_context(_memories(spark, sf_dir), "conversation_id", "turn").select("id", F.reverse("context_window").alias("context"))


_PAIRS = f"""WITH m AS (SELECT * FROM ({_MEM}) WHERE trim(text) <> '')
  SELECT 'sft' AS format, p.text AS prompt, m.text AS chosen, NULL AS rejected, m.before AS prompt_memory_id FROM m JOIN m p ON m.before = p.id
  UNION ALL SELECT 'dpo', m.text, p.text, p.text, m.id FROM m JOIN m p ON m.before = p.id WHERE m.turn % 3 = 0"""


@query("training_pairs", _PAIRS)
def training_pairs(spark, sf_dir):
    return pr.training_pairs(_memories(spark, sf_dir)).select("format", "prompt", "chosen", "rejected", "prompt_memory_id")


@query("quality_train", f"SELECT id, round((CASE WHEN n >= 5 THEN 0.2 ELSE 0 END) + (CASE WHEN before IS NOT NULL THEN 0.3 ELSE 0 END) + (CASE WHEN before IS NOT NULL AND turn % 3 = 0 THEN 0 ELSE 0.3 END), 6)::DOUBLE AS score FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM ({_MEM}))")
def quality_train(spark, sf_dir):
    m = _memories(spark, sf_dir).withColumn("word_count", tx.word_count(F.col("text"))).withColumn("keywords", F.array().cast("array<string>"))
    return m.select("id", F.round(pr.memory_quality(m), 6).alias("score"))


@query("export_training_set", f"SELECT prompt_memory_id AS id FROM ({_PAIRS}) WHERE format = 'sft' AND prompt_memory_id IN (SELECT id FROM ({_MEM}) WHERE turn >= 2)")
def export_training_set(spark, sf_dir):
    m = _memories(spark, sf_dir).withColumn("quality_score", F.when(F.col("turn") >= 2, 0.9).otherwise(0.1))
    pairs = pr.training_pairs(m)
    out = pr.export_training_set(pairs, m, "sft", 0.5)
    return out.join(pairs.select("id", "prompt_memory_id"), "id").select(F.col("prompt_memory_id").alias("id"))


@query("contradictions", f"""WITH m AS (SELECT id, event_type, CASE WHEN event_type = 'error' THEN true ELSE false END AS neg, event_id FROM (SELECT {E} AS id, event_id, event_type FROM events)),
    p AS (SELECT a.id, b.id AS other, a.neg <> b.neg AS differs, row_number() OVER (PARTITION BY a.id ORDER BY 1.0 - abs(a.event_id - b.event_id) / 100.0 DESC, b.id) AS r FROM m a JOIN m b ON a.id <> b.id AND abs(a.event_id - b.event_id) <= 25)
    SELECT m.id, coalesce(list(other ORDER BY r) FILTER (WHERE differs), []) AS contradicts, coalesce(list(other ORDER BY r) FILTER (WHERE NOT differs AND other IS NOT NULL), []) AS reinforces FROM m LEFT JOIN (SELECT * FROM p WHERE r <= 10) q ON q.id = m.id GROUP BY m.id""")
def contradictions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.select(key("event_id").alias("id"), F.when(F.col("event_type") == "error", "never do it").otherwise("do it").alias("text"), "event_id")
    a, b = m.select("id", F.col("event_id").alias("x")), m.select(F.col("id").alias("other"), F.col("event_id").alias("y"))
    near = a.withColumn("g", F.explode(F.array(*[F.floor(F.col("x") / 25) + d for d in (-1, 0, 1)]))).join(b.withColumn("g", F.floor(F.col("y") / 25)), "g")
    pairs = near.where("abs(x - y) <= 25").select("id", "other", (1.0 - F.abs(F.col("x") - F.col("y")) / 100.0).alias("score"))
    return pr.contradictions(m, pairs).select("id", "contradicts", "reinforces")


# ---------------------------------------------------------------------------- decisions

C = DECISIONS_SQL


@query("decision_audit", f"SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome = 'corrected') AS corrected, count(*) FILTER (WHERE outcome = 'abandoned') AS abandoned, round(count(*) FILTER (WHERE outcome = 'accepted') / count(*), 8) AS accuracy FROM ({C})")
def decision_audit(spark, sf_dir):
    return pr.decision_audit(decisions(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 8))


@query("decision_failures", f"SELECT route, count(*) AS failures FROM ({C}) WHERE outcome IN ('corrected', 'abandoned') GROUP BY route")
def decision_failures(spark, sf_dir):
    return pr.failures_by_route(decisions(spark, sf_dir))


@query("trajectories", f"SELECT id, input_context AS state, route AS action, outcome = 'accepted' AS success FROM ({C})")
def trajectories(spark, sf_dir):
    return pr.trajectories(decisions(spark, sf_dir))


@query("preference_pairs", f"SELECT 'c' || id AS id, input_context AS prompt, route || ' better' AS chosen, route AS rejected FROM ({C}) WHERE outcome = 'corrected'")
def preference_pairs(spark, sf_dir):
    d = decisions(spark, sf_dir)
    c = d.where("outcome = 'corrected'").select(F.concat(F.lit("c"), "id").alias("id"), F.col("route").alias("original_output"), F.concat("route", F.lit(" better")).alias("corrected_output"), F.col("id").alias("decision_id"))
    blank = c.limit(3).withColumn("corrected_output", F.lit("  "))
    return pr.preference_pairs(c.unionByName(blank), d)


def _chained(spark, sf_dir):
    """Decisions of a session, each caused by the one before."""
    d = decisions(spark, sf_dir)
    return d.withColumn("causal_parent", F.lag("id").over(Window.partitionBy("session_id").orderBy("id")))


@query(
    "reward_signal",
    f"""WITH RECURSIVE d AS (SELECT *, lag(id) OVER (PARTITION BY session_id ORDER BY id) AS parent FROM ({C})),
    b AS (SELECT id, parent, CASE outcome WHEN 'accepted' THEN 1.0 WHEN 'continued' THEN 0.5 WHEN 'corrected' THEN -0.5 WHEN 'abandoned' THEN -1.0 ELSE 0.5 END::DOUBLE AS r FROM d),
    w(id, parent, r, h) AS (SELECT id, parent, r, 0 FROM b UNION ALL SELECT b.id, b.parent, w.r * 0.9, h + 1 FROM w JOIN b ON b.id = w.parent WHERE h < 30),
    o AS (SELECT id, r, row_number() OVER (PARTITION BY id ORDER BY abs(r) DESC, h) AS n FROM w) SELECT id, round(r, 6) AS reward FROM o WHERE n = 1""",
)
def reward_signal(spark, sf_dir):
    return pr.reward_signal(_chained(spark, sf_dir)).select("id", F.round("reward", 6).alias("reward"))


@query("route_tune", f"SELECT route, count(*) AS total, round(count(*) FILTER (WHERE outcome = 'accepted') / count(*), 8) AS accuracy, round(greatest(0.1, least(0.99, 1.0 - (0.7 - count(*) FILTER (WHERE outcome = 'accepted') / count(*)))), 8) AS factor FROM ({C}) GROUP BY route HAVING count(*) FILTER (WHERE outcome = 'accepted') / count(*) < 0.7")
def route_tune(spark, sf_dir):
    return pr.tune_routes(decisions(spark, sf_dir)).withColumns({"accuracy": F.round("accuracy", 8), "factor": F.round("factor", 8)})


@query("relevance_tune", "WITH r AS (SELECT event_id AS id, event_type AS category, event_type || (event_id % 3) AS recalled, user_id FROM events WHERE event_id % 2 = 0), u AS (SELECT DISTINCT r.id FROM r JOIN (SELECT user_id, event_type || (event_id % 3) AS text FROM events WHERE event_id % 2 = 1) s ON s.user_id = r.user_id AND contains(s.text, r.recalled)) SELECT category, count(*) AS recalled, count(u.id) AS used, round(count(u.id) / count(*), 8) AS rate, count(u.id) / count(*) < 0.3 AS low FROM r LEFT JOIN u ON u.id = r.id GROUP BY category")
def relevance_tune(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.concat("event_type", (F.col("event_id") % 3).cast("string")))
    recalls = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.col("t").alias("recalled_text"), F.col("user_id").alias("session_id"))
    responses = e.where("event_id % 2 = 1").select(F.col("user_id").alias("session_id"), F.col("t").alias("text"))
    return pr.tune_relevance(recalls, responses).withColumn("rate", F.round("rate", 8))


@query("replay_divergence", f"WITH d AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM ({C}) WHERE session_id = 's1') SELECT id, route, 'purchase' AS new_route, outcome, 'accepted' AS predicted FROM d WHERE route = 'view' AND n BETWEEN 3 AND 11")
def replay_divergence(spark, sf_dir):
    d = _chained(spark, sf_dir)
    root = d.where("session_id = 's1'").orderBy("id").offset(2).limit(1).select("id").first()
    traced = graph.trace_ids(d.select("id", F.struct("causal_parent").alias("data")), None, root.id if root else "", 8, "forward")
    return pr.replay_divergence(d, traced, {"view": "purchase"})


# ---------------------------------------------------------------------------- rules


def _actions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "write_order").when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    owner = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("team"), F.col("user_id").cast("string")))
    meta = F.struct(owner.alias("resource_owner"), (F.col("value") / 100).alias("risk_score"), (F.col("user_id") % 5).alias("privilege_level"))
    return e.select(key("event_id").alias("id"), kind.alias("action_type"), meta.alias("metadata"), F.lit("main").alias("session_type"))


_VIOLATIONS = f"""WITH a AS (SELECT {E} AS id, CASE event_type WHEN 'purchase' THEN 'write_order' WHEN 'error' THEN '' ELSE event_type END AS t, user_id, value / 100 AS risk FROM events)
  SELECT id, 'C-0001' AS constraint_id, 'error' AS severity FROM a WHERE t = '' UNION ALL SELECT id, 'C-0002', 'error' FROM a WHERE starts_with(t, 'write_') AND user_id % 4 = 0
  UNION ALL SELECT id, 'C-0003', 'error' FROM a WHERE user_id % 5 > 2 AND user_id % 5 >= 3 UNION ALL SELECT id, 'C-0004', 'error' FROM a WHERE risk > 0.9 UNION ALL SELECT id, 'C-0005', 'warning' FROM a WHERE risk > 0.5"""


@query("rules_evaluate", _VIOLATIONS)
def rules_evaluate(spark, sf_dir):
    return rules.evaluate(_actions(spark, sf_dir), rules.SEED_RULES).select("id", "constraint_id", "severity")


@query("rules_block", f"SELECT {E} AS id, {E} IN (SELECT id FROM ({_VIOLATIONS}) WHERE severity = 'error') AS blocked, (CASE WHEN value / 100 > 0.5 THEN 1 ELSE 0 END) AS n_warnings FROM events")
def rules_block(spark, sf_dir):
    return rules.on_action(_actions(spark, sf_dir), rules.SEED_RULES).select("id", "blocked", F.size("warnings").alias("n_warnings"))


@query("rules_compiled", f"SELECT {E} AS id FROM events WHERE NOT (user_id % 5 <= 3 AND value / 100 < 0.8)")
def rules_compiled(spark, sf_dir):
    c = rules.compile_nl("metadata.privilege_level <= 3 and risk_score < 0.8", "N-1")
    return rules.evaluate(_actions(spark, sf_dir), [c]).select("id")
