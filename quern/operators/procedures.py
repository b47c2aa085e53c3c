"""Domain procedures as joins and column expressions: documents, training data, decision audit."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.plans.staging import cut

# Name spaces, thresholds and weights of the procedures.
PAIR_NAMESPACE = uuid.UUID("7c9e6e1a-3f2b-11ee-8f3d-0242ac130002")
NEAR, NEAR_SCORE, CONTEXT, CONTEXT_INDEX = 10, 0.75, 5, 10
DECAY, ROUNDS = 0.9, 200
REWARDS = {"accepted": 1.0, "continued": 0.5, "corrected": -0.5, "abandoned": -1.0, "frustrated": -1.0}
OTHER_REWARD = 0.5
MIN_WEIGHT, MAX_WEIGHT = 0.1, 0.99


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based UUIDs: version 5, from the SHA-1 of name space and name."""
    h = F.sha1(F.concat(F.lit(namespace.bytes), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


# ---------------------------------------------------------------------------- documents


def store_documents(docs: DataFrame) -> DataFrame:
    """Documents (id, content, ...) once per trimmed content: the least id stays."""
    body = F.regexp_replace(F.col("content"), r"^\s+|\s+$", "")
    keyed = docs.withColumn("content", body).withColumn("content_hash", F.sha2(body.cast("binary"), 256))
    others = [c for c in keyed.columns if c not in ("content_hash",)]
    return keyed.groupBy("content_hash").agg(F.min_by(F.struct(*others), F.col("id")).alias("d")).select("d.*", "content_hash")


def store_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (id, parent_id, content, index) once per parent and content, and their ``has_chunk`` edges."""
    keyed = chunks.withColumn("content_hash", F.sha2(F.concat_ws(":", "parent_id", "content").cast("binary"), 256))
    others = [c for c in keyed.columns if c not in ("content_hash", "parent_id")]
    kept = keyed.groupBy("parent_id", "content_hash").agg(F.min_by(F.struct(*others), F.col("id")).alias("d")).select("d.*", "parent_id", "content_hash")
    edges = kept.select(F.concat_ws(":", F.lit("edge"), "parent_id", "id").alias("id"), F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("has_chunk").alias("label"))
    return kept, edges


def link_chunks(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges of (src, dst, label, strength) between two different chunks; strength is clamped to [0, 1]."""
    known = chunks.select("id")
    ok = links.where("src != dst").join(known, links.src == known.id, "left_semi").join(known, links.dst == known.id, "left_semi")
    return ok.select(
        "src", "dst", F.coalesce("label", F.lit("related")).alias("label"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("strength", F.lit(1.0)))).alias("strength"),
    )


def enrich(df: DataFrame, text: str = "content") -> DataFrame:
    c = F.col(text)
    return df.withColumns({
        "word_count": tx.word_count(c), "char_count": F.char_length(c).cast("long"), "sentence_count": tx.sentence_count(c), "keywords": tx.keywords(c),
    })


# ---------------------------------------------------------------------------- training data


def enrich_memory(df: DataFrame) -> DataFrame:
    c = F.col("text")
    return df.withColumns({
        "word_count": tx.word_count(c), "char_count": F.char_length(c).cast("long"), "keywords": tx.keywords(c),
        "language_hint": tx.language_hint(c), "category": tx.normal_category(F.coalesce("category", F.lit(""))),
    })


def contradictions(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """Memories with ``contradicts`` and ``reinforces``, out of scored pairs (id, other, score).

    Of each memory's ten best pairs with a score of 0.75 or more, those whose negation differs contradict.
    """
    m = memories.select(F.col("id").alias("mid"), tx.is_negated(F.col("text")).alias("neg"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    near = pairs.where((F.col("score") >= NEAR_SCORE) & (F.col("id") != F.col("other"))).withColumn("r", best).where(F.col("r") <= NEAR)
    a = m.select(F.col("mid").alias("id"), F.col("neg").alias("na"))
    b = m.select(F.col("mid").alias("other"), F.col("neg").alias("nb"))
    both = near.join(a, "id").join(b, "other").withColumn("differs", F.col("na") != F.col("nb"))

    def some(flag: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("r", "other")))), lambda s: s["other"])

    grouped = both.groupBy("id").agg(some(F.col("differs")).alias("contradicts"), some(~F.col("differs")).alias("reinforces"))
    empty = F.array().cast("array<string>")
    out = memories.drop("contradicts", "reinforces").join(grouped, "id", "left")
    return out.withColumn("contradicts", F.coalesce("contradicts", empty)).withColumn("reinforces", F.coalesce("reinforces", empty))


def attach_context(df: DataFrame, conversation: str, position: str) -> DataFrame:
    """``context_window``: the five memories before this one in its conversation, newest first."""
    before = Window.partitionBy(conversation).orderBy(position, "id").rowsBetween(-CONTEXT, -1)
    return df.withColumn("context_window", F.when(F.col(conversation).isNotNull(), F.reverse(F.collect_list("id").over(before))).otherwise(F.array().cast("array<string>")))


def training_pairs(memories: DataFrame) -> DataFrame:
    """SFT and DPO pairs of memories (id, text, reinforces, contradicts)."""
    has = F.coalesce(F.trim("text"), F.lit("")) != ""
    m = memories.where(has)
    t = m.select(F.col("id").alias("tid"), F.col("text").alias("ttext"))
    pro, con = F.get("reinforces", F.lit(0)), F.get("contradicts", F.lit(0))
    one = m.select("id", "text", pro.alias("p"), con.alias("c")).where("p is not null")
    withp = one.join(t.select(F.col("tid").alias("p"), F.col("ttext").alias("ptext")), "p")
    sft = withp.select(
        F.lit("sft").alias("format"), F.col("ptext").alias("prompt"), F.col("text").alias("chosen"), F.lit(None).cast("string").alias("rejected"),
        F.col("p").alias("prompt_memory_id"), F.col("id").alias("chosen_memory_id"), F.lit(None).cast("string").alias("rejected_memory_id"),
        uuid5(PAIR_NAMESPACE, F.concat_ws(":", F.lit("sft"), "p", "id")).alias("id"),
    )
    withc = withp.where("c is not null").join(t.select(F.col("tid").alias("c"), F.col("ttext").alias("ctext")), "c")
    dpo = withc.select(
        F.lit("dpo").alias("format"), F.col("text").alias("prompt"), F.col("ptext").alias("chosen"), F.col("ctext").alias("rejected"),
        F.col("id").alias("prompt_memory_id"), F.col("p").alias("chosen_memory_id"), F.col("c").alias("rejected_memory_id"),
        uuid5(PAIR_NAMESPACE, F.concat_ws(":", F.lit("dpo"), "id", "p", "c")).alias("id"),
    )
    return sft.unionByName(dpo)


def memory_quality(df: DataFrame) -> Column:
    yes = lambda c, w: F.when(F.coalesce(c, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    return (
        yes(F.col("word_count") >= 5, 0.2) + yes(F.size("keywords") > 0, 0.2) + yes(F.size("reinforces") > 0, 0.3)
        + F.when(F.coalesce(F.size("contradicts") > 0, F.lit(False)), F.lit(0.0)).otherwise(F.lit(0.3))
    )


def export_training_set(pairs: DataFrame, memories: DataFrame, format: str | None = None, min_quality: float | None = None) -> DataFrame:
    """Pairs as JSON lines; the quality gate looks at the prompt's memory."""
    if format is not None:
        pairs = pairs.where(F.col("format") == format)
    if min_quality is not None:
        good = memories.where(F.col("quality_score") >= min_quality).select(F.col("id").alias("prompt_memory_id"))
        pairs = pairs.join(good, "prompt_memory_id", "left_semi")
    return pairs.select("id", F.to_json(F.struct("format", "prompt", "chosen", "rejected")).alias("line"))


# ---------------------------------------------------------------------------- decisions (id, route, outcome, session_id, ...)


def decision_audit(d: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    of = lambda o: F.count(F.when(F.col("outcome") == o, 1))
    return d.agg(
        n.alias("total"), of("accepted").alias("accepted"), of("corrected").alias("corrected"), of("abandoned").alias("abandoned"),
        F.when(n > 0, of("accepted") / n).otherwise(0.0).alias("accuracy"),
    )


def failures_by_route(d: DataFrame) -> DataFrame:
    return d.where(F.col("outcome").isin("corrected", "abandoned")).groupBy("route").agg(F.count(F.lit(1)).alias("failures"))


def trajectories(d: DataFrame) -> DataFrame:
    return d.select("id", F.col("input_context").alias("state"), F.col("route").alias("action"), F.coalesce(F.col("outcome") == "accepted", F.lit(False)).alias("success"))


def preference_pairs(corrections: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, prompt, chosen, rejected) of corrections (id, original_output, corrected_output, decision_id)."""
    d = decisions.select(F.col("id").alias("decision_id"), F.coalesce("input_context", "route").alias("prompt"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = corrections.where(~blank("original_output") & ~blank("corrected_output")).join(d, "decision_id", "left")
    return rows.select("id", F.coalesce("prompt", F.lit("")).alias("prompt"), F.col("corrected_output").alias("chosen"), F.col("original_output").alias("rejected"))


def reward_signal(d: DataFrame) -> DataFrame:
    """(id, reward): an outcome's reward runs to its causal parents, 0.9 of it each step, where it is larger than theirs."""
    r = F.lit(OTHER_REWARD)
    for outcome, value in REWARDS.items():
        r = F.when(F.col("outcome") == outcome, value).otherwise(r)
    now = cut(d.select("id", "causal_parent", r.alias("reward")))
    for _ in range(ROUNDS):
        sent = now.where("causal_parent is not null").groupBy(F.col("causal_parent").alias("id")).agg(F.max_by(F.col("reward") * DECAY, F.struct(F.abs(F.col("reward")), F.col("reward"))).alias("p"))
        new = cut(now.join(sent, "id", "left").select("id", "causal_parent", F.when(F.abs("p") > F.abs("reward") + 1e-12, F.col("p")).otherwise(F.col("reward")).alias("reward")))
        moved = new.join(now.select("id", F.col("reward").alias("old")), "id").where("reward != old").limit(1).count()
        now = new
        if not moved:
            break
    return now.select("id", "reward")


def tune_routes(d: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(route, total, accuracy, factor) of the routes below the threshold."""
    per = d.groupBy("route").agg(F.count(F.lit(1)).alias("total"), (F.count(F.when(F.col("outcome") == "accepted", 1)) / F.count(F.lit(1))).alias("accuracy"))
    factor = F.greatest(F.lit(MIN_WEIGHT), F.least(F.lit(MAX_WEIGHT), 1.0 - (F.lit(threshold) - F.col("accuracy"))))
    return per.where(F.col("accuracy") < threshold).withColumn("factor", factor).orderBy("route")


def tune_relevance(recalls: DataFrame, responses: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(category, recalled, used, rate): a recall (id, category, recalled_text, session_id) is used if a response of its session holds its text."""
    hit = recalls.join(responses.select("session_id", "text"), "session_id").where(F.col("text").contains(F.col("recalled_text"))).select("id").distinct()
    marked = recalls.join(hit.withColumn("hit", F.lit(1)), "id", "left")
    per = marked.groupBy("category").agg(F.count(F.lit(1)).alias("recalled"), F.count("hit").alias("used"))
    return per.withColumn("rate", F.col("used") / F.col("recalled")).withColumn("low", F.col("rate") < threshold)


def replay_divergence(d: DataFrame, traced: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """(id, route, new_route, outcome, predicted) where an override changes a traced decision's route."""
    if not overrides:
        return d.select("id", "route", F.col("route").alias("new_route"), "outcome", F.col("outcome").alias("predicted")).limit(0)
    new = F.element_at(F.create_map(*[F.lit(x) for p in overrides.items() for x in p]), F.col("route"))
    rows = d.join(traced.select("id"), "id", "left_semi").withColumn("new_route", new).where("new_route is not null and new_route != route")
    return rows.select("id", "route", "new_route", "outcome", F.lit("accepted").alias("predicted"))


def uuid5_python(names: pd.Series) -> pd.Series:
    """The same ids by the standard library, for tests."""
    return names.map(lambda n: str(uuid.uuid5(PAIR_NAMESPACE, n)))
