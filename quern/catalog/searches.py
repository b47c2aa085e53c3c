"""Text, keyword and vector search, quality and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog.base import NOW, document_nodes, event_nodes, k, key, query, table
from quern.operators import search
from quern.plans.compiler import Engine

D = k("doc_id")


@query("text_search", f"SELECT {D} AS id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') ORDER BY doc_id LIMIT 50")
def text_search(spark, sf_dir):
    return Engine(document_nodes(spark, sf_dir)).dsl('text_search("The ING", limit: 50)').df.select("id")


@query("text_search_field", f"SELECT {D} AS id FROM documents WHERE contains(lower(source), 'src1') ORDER BY doc_id LIMIT 30")
def text_search_field(spark, sf_dir):
    return Engine(document_nodes(spark, sf_dir)).dsl('text_search("SRC1", limit: 30, field: "source")').df.select("id")


@query("text_search_empty", "SELECT '' AS id WHERE false")
def text_search_empty(spark, sf_dir):
    return Engine(document_nodes(spark, sf_dir)).dsl('text_search("  ")').df.select("id")


@query("keyword_search", f"SELECT id, score FROM (SELECT {D} AS id, ((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3)::BIGINT AS score FROM documents) WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def keyword_search(spark, sf_dir):
    d = document_nodes(spark, sf_dir)
    return search.keyword_search(d.select("id", F.struct(F.col("data")["text"].alias("text")).alias("data")), "THE", 20)


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    content = F.when(F.col("vec_id") % 3 == 0, F.repeat(F.lit("long text "), 6)).otherwise("short")
    category = F.when(F.col("vec_id") % 5 == 0, "conversation").otherwise("decision")
    source = F.when(F.col("vec_id") % 2 == 0, "origin").when(F.col("vec_id") % 7 == 0, "  ")
    return e.select(
        key("vec_id").alias("id"), F.struct(content.alias("content"), category.alias("category"), source.alias("source"), F.col("label").cast("string").alias("type")).alias("data"),
        F.timestamp_seconds(F.lit(1706659200) - (F.col("vec_id") % 14) * 86400).alias("timestamp"), "embedding",
    )


def _query_vector(spark, sf_dir) -> list[float]:
    return [float(x) for x in table(spark, sf_dir, "embeddings").where("vec_id = 1").select("embedding").first()[0]]


_SIM = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1), s AS (SELECT vec_id, label, greatest(0.0, list_cosine_similarity(embedding::DOUBLE[], q)) AS sim FROM embeddings, q)"
_QUALITY = """(0.2 * ((CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END) + (CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN vec_id % 14 <= 7 THEN 1 ELSE 0 END)))"""


@query("vector_knn", f"{_SIM} SELECT {k('vec_id')} AS id, round(sim, 8) AS similarity FROM s ORDER BY sim DESC, vec_id LIMIT 10")
def vector_knn(spark, sf_dir):
    return search.knn(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 10).select("id", F.round("similarity", 8).alias("similarity"))


@query("vector_blended", f"{_SIM}, c AS (SELECT * FROM s ORDER BY sim DESC, vec_id LIMIT 15), b AS (SELECT vec_id, sim * 0.7 + {_QUALITY} * 0.2 + (CASE WHEN vec_id % 14 <= 7 THEN 0.1 ELSE 0.0 END) AS score FROM c) SELECT {k('vec_id')} AS id, round(score, 8) AS score FROM b WHERE score >= 0.3")
def vector_blended(spark, sf_dir):
    found = search.vector_search(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 15, 0.3, NOW)
    return found.select("id", F.round("score", 8).alias("score"))


@query("quality_score", f"SELECT {k('vec_id')} AS id, round({_QUALITY}, 6)::DOUBLE AS quality FROM embeddings")
def quality_score(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select("id", F.round(search.quality(v, NOW), 6).alias("quality"))


@query("vector_stats", f"SELECT {k('vec_id')} AS id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 8) AS magnitude, round(list_avg(embedding::DOUBLE[]), 8) AS mean, round(list_min(embedding::DOUBLE[]), 8) AS low, round(list_max(embedding::DOUBLE[]), 8) AS high FROM embeddings")
def vector_stats(spark, sf_dir):
    s = table(spark, sf_dir, "embeddings").select(key("vec_id").alias("id"), search.vector_stats(F.col("embedding")).alias("s"))
    return s.select("id", F.round("s.magnitude", 8).alias("magnitude"), F.round("s.mean", 8).alias("mean"), F.round("s.min", 8).alias("low"), F.round("s.max", 8).alias("high"))


@query("valid_vectors", "SELECT count(*) AS n FROM embeddings")
def valid_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where(search.valid_vector(F.col("embedding"))).agg(F.count(F.lit(1)).alias("n"))


@query("vector_search_step")
def vector_search_step(spark, sf_dir):
    """Text through the hashing embedder; tests hold it against a plain ranking."""
    e = search.hashing_embedder(32)
    nodes = search.embed(document_nodes(spark, sf_dir), e, F.col("data")["text"])
    df = Engine(nodes, embedder=e, now=NOW).dsl('vector_search("the thing and the other", limit: 10, category: "en")').df
    return df.select("id", F.round(F.col("data")["_similarity"], 6).alias("similarity"), F.round(F.col("data")["score"], 6).alias("score"))


@query("faceted_search", f"SELECT {k('event_id')} AS id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12' AND contains(props, '7')")
def faceted_search(spark, sf_dir):
    e = event_nodes(spark, sf_dir)
    e = e.withColumn("data", F.struct(F.col("data")["event_type"].alias("type"), F.col("data")["props"].alias("props")))
    hits = search.faceted(e, type="click", since="2024-01-10", until="2024-01-12")
    return hits.where(F.col("data")["props"].contains("7")).select("id")


@query("type_facets", "SELECT event_type AS type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY event_type")
def type_facets(spark, sf_dir):
    from quern.operators.relational import count_by

    return count_by(search.faceted(event_nodes(spark, sf_dir), since="2024-01-20"), "event_type")
