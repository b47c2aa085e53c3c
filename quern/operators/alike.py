"""Counts of similar sets (Jaccard) without a row for any pair.

Tokens are their XXH64 values. Sets are dealt, ordered by size, into blocks of about BLOCK tokens, which are written once into
the folder that all executors share; each two blocks whose sizes can meet are one piece of work. It joins the rare tokens of the
one with those of the other (prefix and positional filter), drops pairs by a bound from parity bitmaps, counts the common tokens
of the rest exactly, and gives only a sum for each set. The order of tokens is by counts of BINS bins; any order gives the same
result. Equal sets are one set with a number of copies.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.staging import cut, scratch

#: Tokens of a block, bins of the token counts, and pairs that a task holds at once.
BLOCK, BINS, CHUNK = 1 << 21, 1 << 18, 1 << 19


def _folder(spark) -> str:
    found = f"{scratch(spark)}/alike-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()


def _digest(tokens: np.ndarray) -> str:
    return hashlib.md5(np.ascontiguousarray(tokens)).hexdigest()


class _Block:
    """The distinct sets of a block by size: name, copies, size, and tokens with their owner and the tokens from each on."""

    def __init__(self, folder: str, number: int):
        fs, path = pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", folder)))
        path = f"{path}/block={number}"
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.path.endswith(".parquet")]
        table = pd.concat([pq.read_table(f, filesystem=fs, partitioning=None).to_pandas() for f in sorted(files)], ignore_index=True)
        copies = table.groupby("digest").size()
        table = table[table["k"] > 0].drop_duplicates("digest").sort_values(["k", "digest"])
        self.digest, self.k = table["digest"].to_numpy(), table["k"].to_numpy().astype(np.int64)
        self.copies = copies.loc[self.digest].to_numpy().astype(np.int64)
        self.flat = np.concatenate(table["o"].to_list())
        self.start = np.cumsum(self.k) - self.k
        self.owner = np.repeat(np.arange(len(self.k), dtype=np.int32), self.k)
        self.rest = np.repeat((self.start + self.k).astype(np.int32), self.k) - np.arange(len(self.flat), dtype=np.int32)

    def bitmaps(self, bits: int) -> np.ndarray:
        """For each set, the parity of the number of its tokens in each of ``bits`` places."""
        out, step = [], max(1, (1 << 21) // bits)
        place = (self.flat.view(np.uint64) >> np.uint64(32)).astype(np.int64) & (bits - 1)
        for i in range(0, len(self.k), step):
            n = min(step, len(self.k) - i)
            own = slice(self.start[i], self.start[i + n - 1] + self.k[i + n - 1])
            odd = np.bincount((self.owner[own] - i) * bits + place[own], minlength=n * bits) & 1
            out.append(np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.uint64))
        return np.concatenate(out)


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] numbers, then those of start[1], ..."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


def _met(a: _Block, b: _Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (of a, of b) that share a token where the rest of both can still reach the threshold, each once; a's sets
    are not larger than b's, and a block's pairs with itself are in order."""
    c, same = threshold / (1 + threshold), a is b
    ka, kb = a.k[a.owner], b.k[b.owner]
    at = np.flatnonzero(b.rest >= c * (kb + np.maximum(threshold * kb, a.k[0])) - 1e-9)
    at = at[np.argsort(b.flat[at], kind="stable")]
    if not len(at):
        return
    names, number = np.unique(b.flat[at], return_inverse=True)
    wide = int(b.k[-1]) + 2
    keys = number * wide + kb[at]
    mine = np.flatnonzero(a.rest >= c * (ka + np.maximum(ka, b.k[0])) - 1e-9)
    number = np.minimum(np.searchsorted(names, a.flat[mine]), len(names) - 1)
    known = names[number] == a.flat[mine]
    mine, number = mine[known], number[known]
    most = np.minimum(np.floor(a.rest[mine] / c - ka[mine] + 1e-6).astype(np.int64), wide - 1)
    low = np.searchsorted(keys, number * wide + ka[mine])
    n = np.maximum(np.searchsorted(keys, number * wide + most, "right") - low, 0)
    of = a.owner[mine]
    before = np.concatenate([[0], np.cumsum(np.bincount(of, n, len(a.k)))]).astype(np.int64)  # by set of a
    ends = np.searchsorted(of, np.arange(len(a.k) + 1))
    first = 0
    while first < len(a.k):
        last = max(first + 1, int(np.searchsorted(before, before[first] + CHUNK, "right")) - 1)
        part = slice(ends[first], ends[last])
        i, j = np.repeat(mine[part], n[part]), at[_spans(low[part], n[part])]
        x, y = a.owner[i], b.owner[j]
        ok = b.rest[j] >= c * (a.k[x] + b.k[y]) - 1e-9
        if same:
            ok &= x < y
        code = np.unique(x[ok].astype(np.int64) * len(b.k) + y[ok])
        if len(code):
            yield code // len(b.k), code % len(b.k)
        first = last


def _sums(a: _Block, b: _Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set of a and of b, the copies of the sets of the other that are similar (a may be b)."""
    for_a, for_b = np.zeros(len(a.k), np.int64), np.zeros(len(b.k), np.int64)
    bits = min(1 << 15, max(64, 1 << int(a.k[-1] + b.k[-1] - 1).bit_length()))
    maps_a = a.bitmaps(bits)
    maps_b = maps_a if a is b else b.bitmaps(bits)
    ids = None
    for x, y in _met(a, b, threshold):
        step, keep = max(1, (1 << 20) // (bits // 64)), []
        for i in range(0, len(x), step):
            p, q = x[i : i + step], y[i : i + step]
            apart = np.bitwise_count(maps_a[p] ^ maps_b[q]).sum(axis=1, dtype=np.int64)
            keep.append(i + np.flatnonzero(apart <= (1 - threshold) / (1 + threshold) * (a.k[p] + b.k[q]) + 1e-6))
        keep = np.concatenate(keep)
        x, y = x[keep], y[keep]
        if not len(x):
            continue
        if ids is None:
            names, ids = np.unique(b.flat, return_inverse=True)
            mark = np.zeros(len(names), np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own, others = x[i], y[i:j]
            tokens = a.flat[a.start[own] : a.start[own] + a.k[own]]
            at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
            at = at[names[at] == tokens]
            mark[at] = 1
            k = b.k[others]
            both = np.add.reduceat(mark[ids[_spans(b.start[others], k)]], np.cumsum(k) - k)
            mark[at] = 0
            others = others[both / (a.k[own] + k - both) >= threshold]
            for_a[own] += b.copies[others].sum()
            for_b[others] += a.copies[own]
    return for_a, for_b


def counted(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, class, links) of each row (id, tokens) with tokens: the least id of its equal sets, and the number of other rows
    whose sets have a Jaccard similarity of ``threshold`` at least."""
    if threshold <= 0:
        raise ValueError("the similarity threshold must be above 0")
    spark = sets.sparkSession
    sets = sets.where(F.size("tokens") > 0).select("id", F.sort_array(F.transform("tokens", lambda t: F.xxhash64(t))).alias("h"))
    bins = BINS

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(bins, np.int64)
        for rows in batches:
            if len(rows):
                count += np.bincount(np.concatenate(rows["h"].to_list()) & (bins - 1), minlength=bins)
            yield pd.DataFrame({"id": rows["id"], "digest": [_digest(h) for h in rows["h"]], "k": rows["h"].map(len), "counts": None})
        yield pd.DataFrame({"id": [None], "digest": [None], "k": [0], "counts": [count]})  # of this task

    both = cut(sets.mapInPandas(name, f"id {sets.schema['id'].dataType.simpleString()}, digest string, k int, counts array<long>"))
    member = both.where("k > 0").select("id", "digest", "k")
    sizes = member.groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy("k").toPandas()  # a row for each size
    classes = member.groupBy("digest").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
    if not len(sizes):
        return member.select("id", F.col("id").alias("class"), F.lit(0).cast("long").alias("links"))
    ks, tokens = sizes["k"].to_numpy().astype(np.int64), (sizes["k"] * sizes["n"]).to_numpy().astype(np.int64)
    before = np.cumsum(tokens) - tokens
    counts = both.where("k = 0").select(F.posexplode("counts").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    count, size = np.zeros(bins, np.int64), BLOCK
    count[counts["bin"].to_numpy()] = counts["n"].to_numpy()

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for batch in batches:
            for i in range(0, len(batch), 1000):
                held = batch["h"].iloc[i : i + 1000].to_list()
                n, names = np.array([len(h) for h in held]), [_digest(h) for h in held]
                at = np.searchsorted(ks, n)
                share = np.array([int(d[:8], 16) for d in names]) / 2**32
                block = (before[at] + (share * tokens[at]).astype(np.int64)) // size
                flat = np.concatenate(held)
                flat = flat[np.lexsort((flat, count[flat & (bins - 1)], np.repeat(np.arange(len(n)), n)))]
                out, k = np.split(flat, np.cumsum(n)[:-1]), n.copy()
                for x, d in enumerate(names):  # a copy is a row without tokens
                    if d in seen:
                        out[x], k[x] = flat[:0], 0
                    seen.add(d)
                yield pd.DataFrame({"block": block, "digest": names, "k": k, "o": out})

    last = (before + tokens - 1) // size
    low, high = {}, {}
    for k, i, j in zip(ks.tolist(), (before // size).tolist(), last.tolist()):
        for block in range(i, j + 1):
            low.setdefault(block, k)
            high[block] = k
    pairs = [(i, j) for i in low for j in low if i <= j and threshold * low[j] <= high[i] + 1e-9]
    folder = _folder(spark)
    dealt = sets.select("h").mapInPandas(deal, "block long, digest string, k int, o array<long>")
    dealt.repartition(len(low), "block").write.partitionBy("block").parquet(folder)
    full = {r[0] for r in spark.read.parquet(folder).select("block").distinct().collect()}
    pairs = [(i, j) for i, j in pairs if i in full and j in full]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i, j in zip(rows["i"].tolist(), rows["j"].tolist()):
                a = _Block(folder, i)
                b = a if i == j else _Block(folder, j)
                for of, n in zip((a, b), _sums(a, b, threshold)):
                    yield pd.DataFrame({"digest": of.digest[n > 0], "n": n[n > 0]})

    todo = spark.sparkContext.parallelize(pairs, len(pairs)).toDF("i long, j long")
    found = cut(todo.mapInPandas(work, "digest string, n long").groupBy("digest").agg(F.sum("n").alias("others")))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    links = (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    return member.join(classes.join(found, "digest", "left"), "digest").select("id", "class", links)
