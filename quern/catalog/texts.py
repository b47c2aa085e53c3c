"""Transforms, text measures, compression and the expression language."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog.base import document_nodes, event_nodes, k, key, query, spread, table
from quern.functions import px
from quern.functions import text as tx
from quern.plans.compiler import Engine

D, E = k("doc_id"), k("event_id")


@query("transform_structured", f"SELECT {D} AS id, lang AS category, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS text, n_chars / 1000.0::DOUBLE AS score FROM documents")
def transform_structured(spark, sf_dir):
    return Engine(document_nodes(spark, sf_dir)).dsl('transform(format: "structured", max_chars: 40)').df.select("id", "data.*")




def _scored(spark, sf_dir):
    """Documents whose score never ends in exactly half a tenth, which engines print differently."""
    d = document_nodes(spark, sf_dir)
    return d.withColumn("data", F.col("data").withField("score", F.col("data")["n_chars"] / 1000.0 + 0.00001))


_SCORE = "printf('%.1f', n_chars / 1000.0 + 0.00001)"


@query("transform_toon", f"SELECT {D} AS id, '[?|' || {_SCORE} || '] ' || CASE WHEN length(text) > 25 THEN substr(text, 1, 25) || '…' ELSE text END AS toon FROM documents")
def transform_toon(spark, sf_dir):
    return Engine(_scored(spark, sf_dir)).dsl('transform(format: "toon", max_chars: 25)').df.select("id", "data.toon")


@query(
    "transform_fused",
    f"""WITH l AS (SELECT {D} AS id, lang AS c, '[score ' || {_SCORE} || '] ' || CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '…' ELSE text END AS line FROM documents),
    g AS (SELECT c, '## ' || c || chr(10) || string_agg(line, chr(10) ORDER BY id) AS block, count(*) AS n FROM l GROUP BY c)
    SELECT '__fused__' AS id, string_agg(block, chr(10) ORDER BY c) AS text, sum(n)::BIGINT AS count FROM g""",
)
def transform_fused(spark, sf_dir):
    return Engine(_scored(spark, sf_dir)).dsl('transform(format: "fused", max_chars: 30)').df.select("id", "data.text", "data.count")


@query("word_count", f"SELECT {D} AS id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS n FROM documents")
def word_count(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(key("doc_id").alias("id"), tx.word_count(F.col("text")).alias("n"))


@query("sentence_count", f"SELECT {D} AS id, CASE WHEN text = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[.!?]'))) END::BIGINT AS n FROM documents")
def sentence_count(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(key("doc_id").alias("id"), tx.sentence_count(F.col("text")).alias("n"))


_STOP = "[" + ", ".join("'" + w + "'" for w in tx.STOP_WORDS) + "]"
_SEP = "[\\s!\"#$%&()*+,./:;<=>?@\\[\\\\\\]^_`{|}~]+"


@query(
    "keywords_topk",
    f"""WITH w AS (SELECT {D} AS id, unnest(regexp_split_to_array(text, '{_SEP}')) AS raw FROM documents),
    c AS (SELECT id, regexp_replace(lower(raw), '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g') AS t FROM w),
    n AS (SELECT id, t, count(*) AS n FROM c WHERE strlen(t) >= 3 AND NOT list_contains({_STOP}, t) GROUP BY id, t),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, t) AS r FROM n)
    SELECT id, list(t ORDER BY r) AS keywords FROM r WHERE r <= 10 GROUP BY id""",
)
def keywords_topk(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents")).select(key("doc_id").alias("id"), tx.keywords(F.col("text")).alias("keywords"))
    return d.where(F.size("keywords") > 0)


@query("language_hint", f"SELECT {D} AS id, CASE WHEN len(regexp_extract_all(text, '\\pL')) = 0 OR 2 * len(regexp_extract_all(text, '[A-Za-z]')) >= len(regexp_extract_all(text, '\\pL')) THEN 'latin' ELSE 'other' END AS hint FROM documents")
def language_hint(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(key("doc_id").alias("id"), tx.language_hint(F.col("text")).alias("hint"))


@query("whitespace_collapse", f"SELECT {D} AS id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def whitespace_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(key("doc_id").alias("id"), tx.collapse(F.col("text")).alias("text"))


def _log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO req="), F.hex("event_id"), F.lit(" user "), F.col("user_id").cast("string"), F.lit(" "), "event_type",
        F.lit(" took "), F.floor("value").cast("string"), F.lit("ms from 10.0.0."), (F.col("user_id") % 200).cast("string"),
    )
    return e.select(key("event_id").alias("id"), "event_type", line.alias("line"))


@query("log_template", f"SELECT {E} AS id, '<TS> INFO req=<KV> user <INT> ' || event_type || ' took <DUR> from <IP>' AS template FROM events")
def log_template(spark, sf_dir):
    return _log_lines(spark, sf_dir).select("id", tx.log_template(F.col("line")).alias("template"))


@query(
    "log_collapse",
    f"""WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
    r AS (SELECT *, sum(CASE WHEN before IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM l)
    SELECT user_id::BIGINT AS user_id, run::BIGINT AS run, {k("min(event_id)")} AS first_id, count(*) AS n FROM r GROUP BY user_id, run""",
)
def log_collapse(spark, sf_dir):
    """Runs of lines with one template, per user."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    lines = _log_lines(spark, sf_dir).withColumn("template", tx.log_template(F.col("line"))).join(e.withColumn("id", key("event_id")), "id")
    w = Window.partitionBy("user_id").orderBy("event_id")
    marked = lines.withColumn("run", F.sum(F.when(F.lag("template").over(w).eqNullSafe(F.col("template")), 0).otherwise(1)).over(w))
    return marked.groupBy("user_id", "run").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).select("user_id", "run", "first_id", "n")


@query("content_type", f"SELECT {D} AS id, CASE WHEN starts_with(ltrim(text), '{{') OR starts_with(ltrim(text), '[') THEN 'json' ELSE 'prose' END AS kind FROM documents")
def content_type(spark, sf_dir):
    """The corpus is prose; logs, code and errors are covered by tests."""
    return spread(table(spark, sf_dir, "documents")).select(key("doc_id").alias("id"), tx.content_type(F.col("text")).alias("kind"))


@query("compress_text")
def compress_text(spark, sf_dir):
    """No SQL: sentence rules; tests hold it against the rules' own examples."""
    d = spread(table(spark, sf_dir, "documents")).select(key("doc_id").alias("id"), "text")
    return d.select("id", tx.compress(F.col("text")).alias("text"), F.octet_length("text").alias("before"))


@query("count_tokens", f"SELECT {D} AS id, len(regexp_extract_all(text, '\\pL{{1,6}}|\\pN{{1,3}}|[^\\s\\pL\\pN]'))::BIGINT AS n FROM documents")
def count_tokens(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select(key("doc_id").alias("id"), tx.count_tokens(F.col("text")).alias("n"))


# ---------------------------------------------------------------------------- expressions


def _px(name: str, text: str, sql: str, kind: str = "string"):
    @query(f"px_{name}", f"SELECT {E} AS id, ({sql}) AS v FROM events")
    def run(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        v = px.to_column(px.parse(text), px.Scope(e))
        return e.select(key("event_id").alias("id"), {"string": v.string, "number": v.number, "boolean": v.truth}[kind].alias("v"))


_px("len", "len(event_type) + len(props)", "(strlen(event_type) + strlen(props))::DOUBLE", "number")
_px("trim_case", 'trim("  " + event_type + " ") | uppercase', "upper(event_type)")
_px("capitalize", "capitalize(event_type)", "upper(substr(event_type, 1, 1)) || substr(event_type, 2)")
_px("reverse", "event_type | reverse", "reverse(event_type)")
_px("default", 'default(nothing, event_type)', "event_type")
_px("one_of", 'one_of(event_type, "view", "click")', "event_type IN ('view', 'click')", "boolean")
_px("none_of", 'event_type in ["view", "click"] || none_of(user_id, 1, 2, 3)', "event_type IN ('view', 'click') OR user_id NOT IN (1, 2, 3)", "boolean")
_px("if_else", 'if_else(value > 50, "high", "low")', "CASE WHEN value > 50 THEN 'high' ELSE 'low' END")
_px("coalesce", 'coalesce(nothing, "", event_type)', "event_type")
_px("min_max", "max(min(value, 60), user_id)", "greatest(least(value, 60), user_id)::DOUBLE", "number")
_px("clamp_abs", "clamp(abs(value - 50), 5, 30)", "least(greatest(abs(value - 50), 5), 30)::DOUBLE", "number")
_px("arith", "user_id * 2 + user_id % 7 - 10 / 4", "(user_id * 2 + user_id % 7 - 2.5)::DOUBLE", "number")
_px("divide_by_zero", "user_id / (user_id - user_id)", "NULL::DOUBLE", "number")
_px("ternary", 'value > 90 ? "top" : value > 50 ? "mid" : "rest"', "CASE WHEN value > 90 THEN 'top' WHEN value > 50 THEN 'mid' ELSE 'rest' END")
_px("logic", '!(value > 50) && (user_id < 10 || event_type == "view")', "NOT value > 50 AND (user_id < 10 OR event_type = 'view')", "boolean")
_px("match", 'match event_type { "view" | "click" => "look", "purchase" if value > 50 => "big", "purchase" => "small", _ => "other" }', "CASE WHEN event_type IN ('view', 'click') THEN 'look' WHEN event_type = 'purchase' AND value > 50 THEN 'big' WHEN event_type = 'purchase' THEN 'small' ELSE 'other' END")
_px("match_range", 'match user_id { 0..10 => "a", 10..=20 => "b", $n if $n > 100 => "big", _ => "c" }', "CASE WHEN user_id >= 0 AND user_id < 10 THEN 'a' WHEN user_id BETWEEN 10 AND 20 THEN 'b' WHEN user_id > 100 THEN 'big' ELSE 'c' END")
_px("matches", 'event_type matches "^(v|c)"', "regexp_matches(event_type, '^(v|c)')", "boolean")
_px("contains", 'props contains "7"', "contains(props, '7')", "boolean")
_px("starts_ends", 'starts_with(event_type, "p") || event_type ends_with "k"', "starts_with(event_type, 'p') OR ends_with(event_type, 'k')", "boolean")
_px("pad", 'user_id | pad_left(5, "0") | pad_right(7, "x")', "CASE WHEN length(user_id::VARCHAR) >= 5 THEN user_id::VARCHAR ELSE lpad(user_id::VARCHAR, 5, '0') END || 'xx'")
_px("slice_truncate", "event_type | slice(1, 4) | truncate(2)", "substr(event_type, 2, 2)")
_px("replace_repeat", 'event_type | replace("i", "_") | repeat(2)', "replace(event_type, 'i', '_') || replace(event_type, 'i', '_')")
_px("split", 'props | replace("{", "") | split(":")', """'["' || replace(replace(props, '{', ''), ':', '","') || '"]'""")
_px("cases", '"someBig Name-x" | snake_case', "'some_big__name_x'")
_px("kebab", '"someBig_Name x" | kebab_case', "'some-big--name-x'")
_px("camel", '"Some_big name-x" | camel_case', "'someBigNameX'")
_px("type_of", "type_of(value)", "'number'")
_px("is_empty", "is_empty(nothing) && not_empty(event_type)", "true", "boolean")


@query("px_interpolate", f"SELECT {E} AS id, 'user ' || user_id || ' did ' || upper(event_type) || ' ${{unknown}}' AS v FROM events")
def px_interpolate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(key("event_id").alias("id"), px.interpolate(e, "user ${user_id} did ${event_type | upper} ${unknown}").alias("v"))


@query("px_condition_filter", f"SELECT {E} AS id FROM events WHERE value > 90 AND event_type <> 'error'")
def px_condition_filter(spark, sf_dir):
    n = event_nodes(spark, sf_dir)
    return n.where(px.condition(n, 'value > 90 && event_type != "error"', "data")).select("id")
