"""Benchmark decontamination by greedy string tiling.

A document is a candidate for a benchmark item if they share a seed of five consecutive words. Words
are lower-case runs of letters, digits and underscores. For each candidate the longest common run of
unmarked words is found by Karp-Rabin hashing and marked in both, again and again, until no run of
five words is left. The share of the item's words that lie in tiles is its coverage. Tiles may come in
any order, so passages whose parts were moved are caught; a coverage of 0.8 or more is a leak.

Seeds are joined, not compared: one pass over the documents keeps the seeds that may be the benchmark's, by
a Bloom filter of fixed size over all its seeds; an equi-join on the seeds' hashes, salted, gives the pairs
that share some; a pair is tiled if the seeds it shares could make up the coverage at all (each seed counted
as often as it stands in the item, which no tiling exceeds). Only documents with such a seed are kept for
the join, with their texts. Nothing of the benchmark or the documents reaches the driver but the filter.

Defined cases: a null or empty item matches nothing; an item of fewer words than five is one seed and
one tile; repeated items are found each by its id; of runs of equal length the first in the item, then the
first in the document is marked; a null text has no leak; very long texts are read whole, piece by piece;
repeated rows each give their leaks; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

SEED_WORDS, COVERAGE = 5, 0.8
#: Code points of a text that are cut into words at once, words whose hashes are kept, copies of the seed table in the join.
PIECE, KEPT, SALT = 1 << 20, 500_000, 8
#: Bits of the filter over the benchmark's seeds, and bits that a seed sets.
FILTER, SET = 1 << 25, 3
BASE = 0x5851F42D4C957F2D
_WORD = re.compile(r"\w+")
FOUND = "array<struct<item_words: int, tiled_words: int, tiles: int, coverage: double, first_word: int>>"
_HASHES: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _rolling(ids: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin values of all windows of ``s`` ids, modulo 2**64."""
    powers = np.array([pow(BASE, k, 1 << 64) for k in range(s)], np.uint64)[::-1]
    return np.lib.stride_tricks.sliding_window_view(ids.astype(np.uint64) + np.uint64(2), s) @ powers


def _matches(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, item position, document position) of at least ``s`` unmarked words."""
    if len(item) < s or len(doc) < s:
        return []
    open_i = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(free_i, s).all(axis=1))
    open_d = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(free_d, s).all(axis=1))
    table = defaultdict(list)
    for i, h in zip(open_i.tolist(), _rolling(item, s)[open_i].tolist()):
        table[h].append(i)
    out = []
    for d, h in zip(open_d.tolist(), _rolling(doc, s)[open_d].tolist()):
        for i in table.get(h, ()):
            if i and d and free_i[i - 1] and free_d[d - 1] and item[i - 1] == doc[d - 1]:
                continue  # not the start of a maximal run
            k = 0
            while i + k < len(item) and d + k < len(doc) and free_i[i + k] and free_d[d + k] and item[i + k] == doc[d + k]:
                k += 1
            if k >= s:
                out.append((k, i, d))
    return out


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, item position, document position), longest first. Ids below zero match nothing."""
    free_i, free_d, tiles = item >= 0, doc >= 0, []
    search = max(least, min(20, len(item)))
    while True:
        found = _matches(item, doc, free_i, free_d, search)
        longest = max((k for k, _, _ in found), default=0)
        if longest > 2 * search:
            search = longest  # a very long run: look for its like first
            continue
        for k, i, d in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_i[i : i + k].all() and free_d[d : d + k].all():
                tiles.append((k, i, d))
                free_i[i : i + k] = free_d[d : d + k] = False
            # what is left of an overlapped run is found again by a search of its own length
        if found and _matches(item, doc, free_i, free_d, search):
            continue
        if search == least:
            return tiles
        search = max(least, search // 2)


class Block:
    """Items with their words as numbers and an index of their seeds."""

    def __init__(self, items: list[tuple[str, list[str]]]):
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.items = [(item_id, np.array([self.vocabulary[w] for w in ws], np.int64)) for item_id, ws in items]
        self.seeds: dict[int, dict[int, list[int]]] = {}
        for k, (_, ids) in enumerate(self.items):
            s = min(SEED_WORDS, len(ids))
            index = self.seeds.setdefault(s, {})
            for h in set(_rolling(ids, s).tolist()):
                index.setdefault(h, []).append(k)
        self.keys = {s: np.sort(np.fromiter(index, np.uint64, len(index))) for s, index in self.seeds.items()}

    def _ids(self, text: str) -> Iterator[np.ndarray]:
        """Word numbers of a text piece by piece, unknown words as -1; pieces are cut between words."""
        get, at = self.vocabulary.get, 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and not text[end].isspace():
                end += 1
            yield np.array([get(w, -1) for w in words(text[at:end])], np.int64)
            at = end

    def find(self, text: str | None) -> list[tuple]:
        ids = list(self._ids(text or ""))
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        near: dict[int, list[int]] = {}
        for s, keys in self.keys.items():
            known = ids >= 0
            if len(ids) < s or np.count_nonzero(known) < s:
                continue
            run = np.concatenate([[0], np.cumsum(known)])
            at = np.flatnonzero(run[s:] - run[:-s] == s)
            if not len(at):
                continue
            window = at[:, None] + np.arange(s)
            powers = np.array([pow(BASE, k, 1 << 64) for k in range(s)], np.uint64)[::-1]
            h = (ids[window].astype(np.uint64) + np.uint64(2)) @ powers
            hit = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
            for p, x in zip(at[hit].tolist(), h[hit].tolist()):
                for k in self.seeds[s][x]:
                    near.setdefault(k, []).append(p)
        out = []
        for k, seeds in near.items():
            item_id, item = self.items[k]
            s = min(SEED_WORDS, len(item))
            if len(seeds) + s - 1 < len(item) * COVERAGE / s:
                continue  # too few seeds to tile so much: a tile of n words has n - s + 1
            keep = np.zeros(len(ids), bool)
            for p in seeds:
                keep[p : p + s] = True
            at = np.flatnonzero(keep)
            # runs of words in seeds, with one word that matches nothing between them
            gap = np.flatnonzero(np.diff(at) > 1) + 1
            doc = np.insert(ids[at], gap, -1)
            where = np.insert(at, gap, -1)
            tiles = tile(item, doc, s)
            tiled = sum(n for n, _, _ in tiles)
            if tiled >= COVERAGE * len(item):
                out.append((item_id, len(item), tiled, len(tiles), tiled / len(item), int(min(where[d] for _, _, d in tiles))))
        return out


def _numbers(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, which is cut between words piece by piece."""
    text, out, at = text or "", [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        for w in words(text[at:end]):
            if (h := _HASHES.get(w)) is None:
                if len(_HASHES) >= KEPT:
                    _HASHES.clear()
                h = _HASHES[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        at = end
    return np.array(out, np.uint64)


def _seeds(numbers: np.ndarray, s: int) -> np.ndarray:
    """Hashes of all runs of ``s`` words, the length being part of them."""
    h = _rolling(numbers, s) + np.uint64(s)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _bit(seeds: np.ndarray, k: int) -> np.ndarray:
    """The k-th bit of the SET that each seed sets in the filter."""
    return ((seeds >> np.uint64(19 * k)) & np.uint64(FILTER - 1)).astype(np.int64)


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for item, text in zip(batch["item"], batch["text"]):
            numbers = _numbers(text)
            if len(numbers):
                s = min(SEED_WORDS, len(numbers))
                seeds, weight = np.unique(_seeds(numbers, s), return_counts=True)
                yield pd.DataFrame({"item": item, "size": s, "n": len(numbers), "seed": seeds.view(np.int64), "weight": weight, "bits": list(np.stack([_bit(seeds, k) for k in range(SET)], axis=1))})


def _filter(seeds: DataFrame) -> tuple[list[int], np.ndarray]:
    """Lengths of the seeds and the filter: FILTER bits at most reach the driver, as bitmaps."""
    place = F.explode(F.transform("bits", lambda b: b + 1)).alias("bit")  # bitmaps count from 1
    maps = seeds.select("size", place).groupBy("size", F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    bits, sizes = np.zeros(FILTER // 8 + 4096, np.uint8), set()
    for r in maps.toLocalIterator():
        sizes.add(r.size)
        at = (r.part - 1) * 4096
        bits[at : at + 4096] |= np.frombuffer(r.map, np.uint8)
    return sorted(sizes), bits


def _shared(spark: SparkSession, seeds: DataFrame, text: Column) -> Column:
    """The seeds of a text, without repeats, that may be the benchmark's."""
    shared = spark.sparkContext.broadcast(_filter(seeds))

    @F.pandas_udf("array<long>")
    def find(texts: pd.Series) -> pd.Series:
        sizes, bits = shared.value
        out = []
        for text in texts:
            numbers, own = _numbers(text) if sizes else (), []
            for s in sizes:
                if len(numbers) >= s:
                    found = _seeds(numbers, s)
                    for k in range(SET):
                        if len(found):
                            bit = _bit(found, k)
                            found = found[(bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                    own.append(np.unique(found))
            out.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
        return pd.Series(out, dtype=object)

    return find(text)


@functools.lru_cache(maxsize=64)
def _single(text: str) -> "Block":
    return Block([("", words(text))])


def _tiled(found: DataFrame, items: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id, item, f: what was tiled) of each leak into the documents ``found`` (id, text, seeds)."""
    salted = seeds.select("item", "size", "n", "seed", "weight").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = found.select("id", F.explode("seeds").alias("seed"), F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt"))
    pairs = own.join(salted, ["seed", "salt"]).groupBy("id", "item").agg(F.sum("weight").alias("weight"), F.first("n").alias("n"), F.first("size").alias("size"))
    pairs = common.staged(pairs.where(F.col("weight") >= F.col("n") * COVERAGE / F.col("size") - 1e-9).select("id", "item"), "seed-pairs")

    @F.pandas_udf(FOUND)
    def tiles(texts: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([[f[1:] for f in _single(i).find(t)] for t, i in zip(texts, of)], dtype=object)

    both = pairs.join(items.select("item", F.col("text").alias("of")), "item").join(found.select("id", "text"), "id")
    return both.select("id", "item", F.explode(tiles("text", "of")).alias("f"))


def _benchmark(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with a number each, and their seeds."""
    items = common.staged(benchmark.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    rows = items.where(F.col("text").isNotNull()).select("item", "text")
    return items, common.staged(rows.mapInPandas(_item_seeds, "item long, size int, n int, seed long, weight int, bits array<long>"), "item-seeds")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and each item that leaks into it."""
    items, seeds = _benchmark(benchmark)
    found = docs.select("doc_id", "text", _shared(spark, seeds, F.col("text")).alias("seeds")).where(F.size("seeds") > 0)
    found = common.staged(found.withColumn("id", F.monotonically_increasing_id()), "seeded")
    out = _tiled(found, items, seeds).join(items.select("item", "item_id"), "item").join(found.select("id", "doc_id"), "id")
    return out.select("doc_id", "item_id", "f.*")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` into which no item leaks."""
    items, seeds = _benchmark(benchmark)
    rows = docs.select(F.struct("*").alias("row"), _shared(spark, seeds, F.col("text")).alias("seeds"))
    rows = common.staged(rows.withColumn("id", F.when(F.size("seeds") > 0, F.monotonically_increasing_id())), "seeded")
    found = rows.where(F.col("id").isNotNull())
    leaks = _tiled(found.select("id", F.col("row.text").alias("text"), "seeds"), items, seeds).select("id").distinct()
    return rows.where(F.col("id").isNull()).select("row.*").unionByName(found.join(leaks, "id", "left_anti").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every benchmark item that leaks into a document."""
    return contaminated(spark, common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
