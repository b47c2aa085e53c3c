"""Text, keyword and vector search, the quality score and blended ranking."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import paths

# Weights of the blended score and of the quality score, days that count as recent.
SIMILARITY, QUALITY, RECENT, RECENT_DAYS = 0.7, 0.2, 0.1, 7
LONG_TEXT, QUALITY_PART = 50, 0.2


def text_search(df: DataFrame, query: str, limit: int = 10, field: str = "text") -> DataFrame:
    """Rows whose text holds every term, whatever the case; the first ``limit`` by id."""
    terms = query.lower().split()
    if not terms:
        return df.limit(0)
    text = F.lower(paths.bind(df).value(field).string if "." not in field else F.lit(None).cast("string"))
    hit = reduce(lambda a, b: a & b, (text.contains(t) for t in terms))
    return df.where(F.coalesce(hit, F.lit(False))).orderBy("id").limit(limit)


def occurrences(text: Column, query: str) -> Column:
    """Non-overlapping occurrences of a lower-case string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(query), F.lit("")))) / F.lit(float(len(query)))).cast("long")


def keyword_search(df: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(id, score): how often the query occurs in the JSON text of the data."""
    q = query.lower()
    if not q:
        return df.select("id", F.lit(0).cast("long").alias("score")).limit(0)
    score = occurrences(F.lower(paths.bind(df).whole()), q)
    return df.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def quality(df: DataFrame, now: Column | str) -> Column:
    """0.2 for each of: a long text, a category other than conversation, tags, a source, a recent timestamp."""
    v = lambda p: paths.bind(df).value(p)
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    content, text = v("content").string, v("text").string
    body = F.when(content.isNotNull(), content).otherwise(text)
    source = v("source")
    has_source = F.when(source.string.isNotNull(), F.trim(source.string) != "").otherwise(~source.absent)
    tags = F.coalesce(F.size(F.when(v("tags").strings.isNotNull(), v("tags").strings)) > 0, F.lit(False))
    parts = [
        F.char_length(body) >= LONG_TEXT,
        (v("category").string.isNotNull()) & (F.lower(v("category").string) != "conversation"),
        tags,
        has_source,
        recent(now) if "timestamp" in df.columns else F.lit(False),
    ]
    hits = reduce(lambda a, b: a + b, (F.when(F.coalesce(p, F.lit(False)), 1).otherwise(0) for p in parts))
    return F.least(F.lit(1.0), hits * F.lit(QUALITY_PART))


def recent(now: Column, column: str = "timestamp") -> Column:
    return F.coalesce(F.unix_micros(F.col(column).cast("timestamp")) >= F.unix_micros(now) - RECENT_DAYS * 86_400_000_000, F.lit(False))


def blended(similarity: Column, quality_score: Column, is_recent: Column) -> Column:
    total = similarity * SIMILARITY + quality_score * QUALITY + F.when(is_recent, F.lit(RECENT)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def valid_vector(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine similarity with a literal vector in double precision, negative as 0; NULL for other lengths."""
    norm = math.sqrt(sum(x * x for x in query))
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(F.size(v) == len(query), F.greatest(F.lit(0.0), dot / (own * F.lit(norm))))


def usable(query: list[float] | None) -> bool:
    return bool(query) and all(x is not None and math.isfinite(x) for x in query) and any(query)


def knn(df: DataFrame, query: list[float], limit: int, column: str = "embedding") -> DataFrame:
    """The ``limit`` rows most similar to ``query``, with ``similarity``; exact, a top-k without a shuffle of rows."""
    if not usable(query):
        return df.withColumn("similarity", F.lit(None).cast("double")).limit(0)
    s = df.where(valid_vector(F.col(column))).withColumn("similarity", cosine(F.col(column), query)).where("similarity is not null")
    return s.orderBy(F.desc("similarity"), "id").limit(limit)


def vector_search(df: DataFrame, query: list[float], limit: int = 10, min_score: float = 0.0, now: Column | str | None = None, column: str = "embedding") -> DataFrame:
    """Nearest by similarity first, then ranked by the blended score; adds similarity, quality and score. A threshold
    beyond 0 to 1 is moved to the nearer end, one that is no number counts as 0."""
    min_score = min(1.0, max(0.0, min_score)) if math.isfinite(min_score) else 0.0
    found = knn(df, query, limit, column)
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp") if isinstance(now, str) else now
    q = F.col("quality_score").cast("double") if "quality_score" in df.columns else quality(df, at)
    r = recent(at) if "timestamp" in df.columns else F.lit(False)
    found = found.withColumn("quality", q).withColumn("score", blended(F.col("similarity"), F.col("quality"), r))
    return found.where(F.col("score") >= min_score).orderBy(F.desc("score"), "id")


Embedder = Callable[[str], list[float]]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """A deterministic embedder: signed hashes of lower-case words."""

    def embed(text: str) -> list[float]:
        v = [0.0] * dimension
        for w in text.lower().split():
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "little") % dimension] += 1.0 if h[4] & 1 else -1.0
        return v

    return embed


def embed(df: DataFrame, embedder: Embedder, text: Column, column: str = "embedding") -> DataFrame:
    """Adds vectors of a text column, in Arrow batches."""
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [float(x) for x in embedder(t)])

    return df.withColumn(column, run(text))


def vector_stats(v: Column) -> Column:
    """struct(magnitude, mean, min, max) of a vector."""
    d = F.transform(v, lambda x: x.cast("double"))
    total = F.aggregate(d, F.lit(0.0), lambda a, x: a + x)
    return F.struct(
        F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)).alias("magnitude"),
        (total / F.size(v)).alias("mean"), F.array_min(d).alias("min"), F.array_max(d).alias("max"),
    )


def faceted(df: DataFrame, type: str | None = None, tag: str | None = None, text: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Facets: exact type, tag substring, text in id or JSON, and a date range."""
    b = paths.bind(df)
    if type is not None:
        df = df.where(F.coalesce(b.value("type").string == type, F.lit(False)))
    if tag is not None:
        df = df.where(F.coalesce(F.exists(b.value("tags").strings, lambda t: F.lower(t).contains(tag.lower())), F.lit(False)))
    if text is not None:
        df = df.where(F.lower(F.concat_ws(" ", "id", b.whole())).contains(text.lower()))
    if since is not None:
        df = df.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        df = df.where(F.col("timestamp") <= F.lit(until).cast("timestamp"))
    return df
