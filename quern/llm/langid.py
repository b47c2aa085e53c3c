"""Language identification as inference of a mixture of languages.

Learned from labelled rows: counts of letter trigrams (hashed to 65536 buckets) of each language over
all training texts. A text is taken as trigrams drawn from a mixture; expectation-maximisation finds
the proportions, and the set of languages is the one of nested sets (by proportion) with the best
likelihood less half a logarithm of the trigram count for each language. The prediction is the
language with the largest proportion in that set, the score its proportion.

The model holds, per bucket, the languages that use it and their counts: as many numbers as there are
pairs of a label and a bucket among the training texts, 65536 a label at most and few for a label that few
texts have. It is the only thing that is collected and broadcast, as columns. No matrix of all labels is
made: where there are more than HELD, the mixture of a text is sought among the HELD languages under which
it is likeliest on its own, so junk labels cost only their own entries.

A text is accepted (``accepted``) if its mixture makes it likelier than noise, that is than trigrams drawn
evenly from all buckets, by its penalised likelihood.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if
nothing could be learned (``accepted`` keeps those with a letter then); null labels teach nothing; a label
``und`` is a language like any other; languages with equal proportions rank by label; very long texts are
read piece by piece, with the same trigrams; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

UNKNOWN = "und"
D = 1 << 16
#: Code points read at once, languages counted at once in a task or mixed in a text, smoothing, and EM's rounds and precision.
PIECE, HELD, SMOOTH, ROUNDS, CLOSE = 1 << 18, 64, 0.5, 40, 1e-4
OVERLAP = 3.0  # a letter is in three trigrams, so their likelihood counts a third
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of a text's trigrams with a letter in the middle; none if it has no letter."""
    low, total = f" {(text or '').lower()} ", None
    for at in range(1, len(low) - 1, PIECE):  # with a neighbour on each side
        x = np.frombuffer(low[at - 1 : at + PIECE + 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[x]
        x = np.where(letter, x, 32).astype(np.uint64)
        code = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9))[letter[1:-1]]
        code = ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
        if len(low) <= 20_000:
            return np.unique(code.astype(np.int64), return_counts=True)
        total = np.bincount(code.astype(np.int64), minlength=D) + (0 if total is None else total)
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (at := np.flatnonzero(total)), total[at]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pd.DataFrame]:
        for lang, c in held.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": c[at]})
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if lang not in held and len(held) >= HELD:
                yield from out()
            at, n = trigrams(text)
            held.setdefault(lang, np.zeros(D, np.int64))[at] += n
    yield from out()


class Model:
    """Counts of each bucket's languages, and what inference needs of them."""

    def __init__(self, langs: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        """Entries: ``n`` trigrams of ``langs[lang]`` in ``bucket``."""
        self.langs = langs
        self.sum = np.bincount(lang, weights=n, minlength=len(langs)) + SMOOTH * D
        order = np.lexsort([lang, bucket])
        self.lang, self.n = lang[order].astype(np.int32), n[order].astype(np.float32)
        self.start = np.searchsorted(bucket[order], np.arange(D + 1)).astype(np.int64)

    def _probabilities(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages (HELD at most) and their probabilities of the buckets ``at``, which a text has ``n`` times."""
        size = self.start[at + 1] - self.start[at]
        column = np.repeat(np.arange(len(at)), size)
        entry = np.arange(len(column)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[at], size)
        lang, count = self.lang[entry], self.n[entry].astype(float)
        few = np.arange(len(self.langs))
        if len(few) > HELD:
            fit = np.bincount(lang, weights=n[column] * np.log1p(count / SMOOTH), minlength=len(few)) - n.sum() * np.log(self.sum)
            few = np.sort(np.argsort(-fit, kind="stable")[:HELD])
            row = np.searchsorted(few, lang)
            own = few[np.minimum(row, len(few) - 1)] == lang
            lang, count, column = row[own], count[own], column[own]
        p = np.full((len(few), len(at)), SMOOTH)
        p[lang, column] += count
        return few, p / self.sum[few, None]

    def _em(self, p: np.ndarray, n: np.ndarray, mix: np.ndarray) -> tuple[np.ndarray, float]:
        total = n.sum()
        for _ in range(ROUNDS):
            joint = mix[:, None] * p
            new = (joint * (n / joint.sum(axis=0))).sum(axis=1) / total
            moved, mix = np.abs(new - mix).max(), new
            if moved < CLOSE:
                break
        return mix, float((n * np.log((mix[:, None] * p).sum(axis=0))).sum()) / OVERLAP

    def infer(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its proportion, and whether the text is likelier than noise."""
        at, n = trigrams(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0, bool(len(at))
        n = n.astype(float)
        few, p = self._probabilities(at, n)
        mix, _ = self._em(p, n, np.full(len(few), 1 / len(few)))
        order = np.argsort(-mix, kind="stable")
        best, penalty = None, 0.5 * np.log(n.sum() + 1)
        for k in range(1, int((mix > 0.01).sum() or 1) + 1):
            some = order[:k]
            share, fit = self._em(p[some], n, mix[some] / mix[some].sum()) if k > 1 else (np.ones(1), float((n * np.log(p[some[0]])).sum()) / OVERLAP)
            if best is not None and fit - k * penalty <= best[0]:
                break
            best = (fit - k * penalty, some, share)
        top = int(np.argmax(best[2]))
        return self.langs[few[best[1][top]]], float(min(1.0, best[2][top])), bool(best[0] > -n.sum() * np.log(D) / OVERLAP)


def fit(docs: DataFrame) -> Model:
    """Learns from every row of ``docs`` (text, lang) with a label."""
    known = docs.where(F.col("lang").isNotNull()).select("lang", "text")
    counted = known.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # an entry per label and bucket that it uses
    langs = sorted(set(found["lang"].unique().to_pylist()))
    names = {g: k for k, g in enumerate(langs)}
    coded = found["lang"].combine_chunks().dictionary_encode() if found.num_rows else None
    lang = np.array([names[g] for g in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if coded is not None else np.zeros(0, np.int64)
    return Model(langs, lang, found["bucket"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(float))


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(lang, score, likely) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, likely boolean")
    def infer(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.infer(t) for t in texts], columns=["lang", "score", "likely"])

    return infer(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def accepted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a mixture of the languages, which its labelled rows teach, makes likelier than noise;
    what has no letter is rejected."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return docs.select(F.struct("*").alias("row"), predict(spark, model, F.col("text")).alias("found")).where("found.likely").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: learned from two of three documents by the checksum of their id, predicted for all."""
    docs = common.read_table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(spark, model, F.col("text")).alias("f"))
    return found.select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"))
