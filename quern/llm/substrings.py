"""Removal of repeated passages with Aho-Corasick automata over words.

A passage is a run of 20 consecutive words of one document; each word of an occurrence that is not
the first one (smallest document id, then start) is removed. Documents are dealt into blocks of some
two megabytes by a digest of the row.

1. Candidates: in each run of 20 words the least hash of its 6-word phrases is the run's anchor. Equal
   runs have equal anchors, and about one phrase in eight is one, so only (anchor, block) is shuffled.
   Anchors with one occurrence in all documents are dropped. Whole texts that are copies of a text
   with a smaller id are one passage each, known by the digest of the text.
2. Confirmation: a block emits a 128-bit digest of each run whose anchor recurs, once, with its first
   place in the block. Digests met again are recurring passages; their least place is the first.
3. Location: each block joins neighbouring recurring runs to longer passages, cuts those into pieces
   of ten words (any run of 20 holds one), compiles the pieces into automata over word numbers, so
   many to an automaton, and streams its documents through them. Each hit is extended word by word
   along the passage; what matches 20 words or more and is not the first place is removed.

What a block emits for a run does not depend on how often it occurs there, so a passage in a third of
all documents gives one row per block. Nothing is broadcast or collected.

Defined cases: a null text has no words; white space is not compared; a null id counts as the largest;
rows that share an id are one document for the order of places; repeated rows are first together and
keep their words; documents may be of any length; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

WORDS, PHRASE = 20, 6
#: Words of a piece: any run of WORDS words holds one that starts at a multiple of this.
PIECE = (WORDS + 1) // 2
#: Bytes of text in a block, pieces in an automaton, words whose hashes are kept.
BLOCK, PATTERNS, KEPT = 2 << 20, 50_000, 500_000
#: Ways in which the copies of one text are dealt out.
SALT = 32
LAST = (1 << 63) - 1
A, B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Digests(dict):
    """128-bit hashes of words, kept for the next text."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_128_intdigest(word).to_bytes(16, "little")
        return h


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_HASHES = _Digests()


def _hashes(words: list[bytes]) -> np.ndarray:
    """128-bit hashes of words, as two columns."""
    return np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), np.uint64).reshape(-1, 2)


def _runs(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words: polynomials in ``base``, put together from runs of powers of two."""
    out, width, power, size = np.zeros(len(h) - n + 1, np.uint64), 0, h, 1
    while size <= n:
        if n & size:  # the runs of ``size`` words that follow those in ``out``
            out = out * np.uint64(pow(base, size, 1 << 64)) + power[width : width + len(out)]
            width += size
        if 2 * size <= n:
            power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2
    return (out ^ (out >> np.uint64(31))) * np.uint64(B)


def _anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of every run of WORDS words, and the hash of every phrase."""
    phrases = _runs(h, PHRASE, A)
    least, width, goal = phrases, 1, WORDS - PHRASE + 1
    while width < goal:
        step = min(width, goal - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least, phrases


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found, blocks, counts = [], [], []
        for block, text in zip(batch["block"], batch["text"]):
            words = text.encode().split() if text else ()
            if len(words) < WORDS:
                continue
            least, phrases = _anchors(_hashes(words)[:, 0])
            own = np.unique(least)
            phrases = np.sort(phrases)
            again = phrases[1:][phrases[1:] == phrases[:-1]]
            found.append(own)
            blocks.append(np.full(len(own), block))
            counts.append(1 + np.isin(own, again) if len(again) else np.ones(len(own), np.int64))  # once or again is all that matters
        if found:
            yield pd.DataFrame({
                "anchor": np.concatenate(found).view(np.int64), "block": np.concatenate(blocks), "n": np.concatenate(counts)
            })


def _in_order(docs: pd.DataFrame) -> pd.DataFrame:
    """A block's documents in the order that both passes share."""
    return docs.sort_values(["key", "digest"], kind="stable", ignore_index=True)


def _copies(docs: pd.DataFrame, found: pd.DataFrame) -> np.ndarray:
    """Which documents are copies of a text with a smaller id."""
    known = found[found["digest"] != ""]
    known = set(zip(known["key"].tolist(), known["digest"].tolist()))
    return np.array([kd in known for kd in zip(docs["key"].tolist(), docs["digest"].tolist())], bool)


def _confirm(key: tuple, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Digest, first place in the block and count of each run whose anchor recurs."""
    docs = _in_order(docs)
    copy = _copies(docs, found)
    recurring = np.sort(found.loc[found["digest"] == "", "anchor"].to_numpy(np.int64).view(np.uint64))
    parts = []
    for row, text in enumerate(docs["text"]) if len(recurring) else ():
        words = text.encode().split() if text and not copy[row] else ()
        if len(words) < WORDS:
            continue
        h = _hashes(words)
        least, _ = _anchors(h[:, 0])
        at = np.flatnonzero(recurring[np.minimum(np.searchsorted(recurring, least), len(recurring) - 1)] == least)
        if len(at):
            parts.append((_runs(h[:, 0], WORDS, B)[at], _runs(h[:, 1], WORDS, A)[at], np.full(len(at), row), at))
    a, b, row, start = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    order = np.lexsort([start, row, b, a])
    a, b, row, start = a[order], b[order], row[order], start[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.flatnonzero(first)
    return pd.DataFrame({
        "a": a[place].view(np.int64), "b": b[place].view(np.int64), "block": np.int64(key[0]),
        "row": row[place].astype(np.int32), "start": start[place].astype(np.int32),
        "key": docs["key"].to_numpy(np.int64)[row[place]] if len(place) else np.zeros(0, np.int64),
        "again": np.diff(np.append(place, len(a))) > 1,
    })


def _joined(passages: pd.DataFrame) -> list[tuple[int, int, int, int, int]]:
    """Neighbouring runs whose first places are neighbours too, as (row, start, end, first key, first start)."""
    if not len(passages):
        return []
    p = passages.sort_values(["row", "start"])
    row, start, key, first = (p[c].to_numpy(np.int64) for c in ("row", "start", "first_key", "first_start"))
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(start) != 1) | (key[1:] != key[:-1]) | (np.diff(first) != 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    return list(zip(row[at].tolist(), start[at].tolist(), (start[last] + WORDS).tolist(), key[at].tolist(), first[at].tolist()))


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if not n:
        return 0
    differs = a[:n] != b[:n]
    first = int(differs.argmax())
    return first if differs[first] else n


def _remove(place: int, doc: np.ndarray, key: int, hits, gone: np.ndarray, passages: list, words: list[np.ndarray]) -> None:
    """Extends hits (place in the document, passage, place in the passage) of the document at ``place`` and marks what is
    not first."""
    done: dict[tuple[int, int], int] = {}
    for p, q, o in hits:
        if done.get((q, p - o), -1) >= p + PIECE:
            continue
        row, s, e, first_key, first_start = passages[q]
        if row == place and s == p - o:  # the passage's own place
            left, right = o, e - s - o
        else:
            passage = words[row][s:e]
            left = _reach(doc[:p][::-1], passage[:o][::-1])
            right = PIECE + _reach(doc[p + PIECE :], passage[o + PIECE :])
        done[q, p - o] = p + right
        if left + right >= WORDS and (key, p - left) > (first_key, first_start + o - left):
            gone[p - left : p + right] = True


def _locate(_, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Streams a block's documents through the automata of its recurring passages."""
    import ahocorasick

    docs = _in_order(docs)
    copy = _copies(docs, found)
    texts = [(t or "").encode().split() for t in docs["text"]]
    gone = [np.full(len(t), c and len(t) >= WORDS) for t, c in zip(texts, copy)]
    passages = _joined(found[found["digest"] == ""])
    if passages:
        number = _Numbers().__getitem__
        ids = [() if c else tuple(map(number, t)) for t, c in zip(texts, copy)]
        words = [np.array(x, np.int64) for x in ids]
        slots: dict[tuple, list[tuple[int, int]]] = {}
        for q, (row, s, e, _, _) in enumerate(passages):
            for o in range(0, e - s - PIECE + 1, PIECE):
                slots.setdefault(ids[row][s + o : s + o + PIECE], []).append((q, o))
        pieces = list(slots.items())
        for s in range(0, len(pieces), PATTERNS):
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for piece, places in pieces[s : s + PATTERNS]:
                automaton.add_word(piece, places)
            automaton.make_automaton()
            for row, (key, doc, numbers, mark) in enumerate(zip(docs["key"].tolist(), ids, words, gone)):
                if len(doc) >= WORDS:
                    hits = ((end - PIECE + 1, q, o) for end, places in automaton.iter(doc) for q, o in places)
                    _remove(row, numbers, key, hits, mark, passages, words)
    kept = [hashlib.sha256(b" ".join(compress(t, (~m).tolist()) if m.any() else t)).hexdigest() for t, m in zip(texts, gone)]
    return pd.DataFrame({
        "key": docs["key"], "missing": docs["missing"], "n_words": np.array([len(t) for t in texts], np.int64),
        "n_removed": np.array([int(m.sum()) for m in gone], np.int64), "kept_sha256": kept,
    })


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    digest, zero = F.md5(F.col("text").cast("binary")), F.lit(0).cast("long")
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", digest), F.lit(blocks)).alias("block"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"),
        F.col("doc_id").isNull().alias("missing"), F.coalesce(digest, F.lit("")).alias("digest"), F.col("text").cast("string").alias("text"),
    )
    slim = common.staged(rows.where("digest != ''").select("block", "key", "digest"), "digests")
    least = slim.groupBy("digest").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("most > least").select("digest", "least")
    # the copies of one text may be a third of all: they are dealt out by salt
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = slim.withColumn("salt", F.pmod(F.xxhash64("key", "block"), F.lit(SALT)).cast("int"))
    copies = salted.join(least, ["digest", "salt"]).where("key > least").select("block", "key", "digest").distinct()
    copies = common.staged(copies, "copies", (slim,))
    anchors = common.staged(rows.select("block", "text").mapInPandas(_candidates, "anchor long, block long, n int"), "anchors")
    again = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    recurring = common.staged(anchors.join(again, "anchor", "left_semi").select("block", "anchor"), "recurring-anchors", (anchors,))
    # some blocks to a task, however many there are
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 4))
    texts = rows.repartition(tasks, "block").groupBy("block")
    # no nulls: they would turn 64-bit integers into floats on the way to Python
    known = recurring.withColumns({"key": zero, "digest": F.lit("")}).unionByName(copies.withColumn("anchor", zero))
    known = known.repartition(tasks, "block").groupBy("block")
    runs = texts.cogroup(known).applyInPandas(_confirm, "a long, b long, block long, row int, start int, key long, again boolean")
    same = Window.partitionBy("a", "b").orderBy("key", "start")  # a row per block at most
    place = F.struct(F.col("key").alias("first_key"), F.col("start").alias("first_start"))
    firsts = runs.withColumn("nth", F.row_number().over(same)).withColumn("first", F.first(place).over(same.rowsBetween(Window.unboundedPreceding, 0)))
    passages = common.staged(firsts.where("nth > 1 or again").select("block", "row", "start", "first.*"), "passages", (recurring,))
    nowhere = {"row": zero.cast("int"), "start": zero.cast("int"), "first_key": zero, "first_start": zero.cast("int")}
    known = passages.withColumns({"key": zero, "digest": F.lit("")}).unionByName(copies.withColumns(nowhere))
    known = known.repartition(tasks, "block").groupBy("block")
    out = texts.cogroup(known).applyInPandas(_locate, "key long, missing boolean, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.when(~F.col("missing"), F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents, passages of 20 words."""
    return remove_repeats(common.read_table(spark, sf_dir, "documents"))


#: Every window of every document, by its words.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
k AS (SELECT doc_id, s, array_to_string(ws[s + 1 : s + {WORDS}], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(len(ws) - {WORDS - 1})) AS s FROM d WHERE len(ws) >= {WORDS})),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS n FROM k),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM r, range({WORDS}) t(i) WHERE n > 1),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
