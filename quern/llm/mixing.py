"""Mixing sources to target weights by cube-method balanced sampling.

Sources share a multiple of all words by weight; no source gives more than ``cap`` times its words,
what is above is shared out again by weight (one water level for all, found in closed form). A source
with rate ``target / size`` takes ``floor(rate)`` copies of each of its documents and one more of a
balanced sample: inclusion probabilities, all the fractional part of the rate, move at random along
null-space directions of the constraints (words, documents) until they are 0 or 1.

The flight runs in blocks of some hundred documents of one source. Each block keeps its word and
document totals exactly and leaves two undecided documents at most; these meet in blocks of the next
level, until one block per source is left. Its two last documents land on the rounding that misses
the word total least. So a source misses its target by half of one of its documents at most.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last in
order; repeated rows are drawn one by one, whatever their number; texts of any length are only counted;
sources of equal level are filled in code point order; with no words at all every target is 0; an empty table
gives no rows. Other columns are ignored. Draws depend on the rows and the seed alone, not on how
rows are dealt to tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
SEED = 20
#: Documents of one source in a block of the first level, blocks that meet in one of the next.
BLOCK, MEET = 512, 128
EPS = 1e-9


def allot(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to a table of one row per source (skey, source_size, blocks)."""
    every = Window.partitionBy(F.lit(0))  # one row per source of the mixture
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(every.orderBy("skey")) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("level", F.col("most") / F.col("w"))
    by_level = every.orderBy("level", "skey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("goal", F.sum("source_size").over(every) * F.lit(share))
    s = s.withColumn("below", F.sum("most").over(by_level) - F.col("most")).withColumn("w_left", F.sum("w").over(every) - F.sum("w").over(by_level) + F.col("w"))
    s = s.withColumn("full", F.col("below") + F.col("level") * F.col("w_left") <= F.col("goal"))
    free_w = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(every)
    water = (F.col("goal") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)) / F.when(free_w > 0, free_w)
    return s.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.col("w") * water)).cast("double")).select("skey", "source_size", "blocks", "target")


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities, keeping sum(p) and sum(p * size), until two at most lie between 0 and 1."""
    p = p.astype(float).copy()
    size = size.astype(float)
    todo = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS][::-1]
    held: list[int] = []
    while True:
        while len(held) < 3 and todo:
            held.append(todo.pop())
        if len(held) == 3:
            a, b, c = (size[i] for i in held)
            u = [b - c, c - a, a - b]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        elif len(held) == 2 and size[held[0]] == size[held[1]]:
            u = [1.0, -1.0]
        else:
            return p
        big = max(map(abs, u))
        u = [x / big for x in u]
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(held, u) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(held, u) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(held, u):
            p[i] += step * x
            if p[i] <= EPS:
                p[i] = 0.0
            elif p[i] >= 1 - EPS:
                p[i] = 1.0
        held = [i for i in held if 0 < p[i] < 1]


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rounds the two at most that are undecided so that the word total is missed least, then the count."""
    p = p.copy()
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    want, count = sum(p[i] * size[i] for i in open_), sum(p[i] for i in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[i] for k, i in enumerate(open_) if m >> k & 1) - want), abs(m.bit_count() - count), m))
    for k, i in enumerate(open_):
        p[i] = best >> k & 1
    return p


def _fly(level: int, last: bool, seed: int):
    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["uid", "i"], kind="stable")
        rng = np.random.default_rng(xxhash.xxh64_intdigest(repr((seed, level, key[0], int(key[1]))).encode()))
        size = rows["size"].to_numpy(dtype=float)
        p = flight(size, rows["p"].to_numpy(dtype=float), rng)
        return rows.assign(p=land(size, p) if last else p)

    return fly


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, uid (digest of the row), i (number among its like), size, source_size, target and copies of each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType
    slim = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), common.null_safe(F.col("source")).alias("skey"),
        common.n_words(F.col("text")).alias("size"), common.row_uid(docs).alias("uid"),
    )
    # rows alike in every column are counted, and told apart by a number
    counted = common.staged(slim.groupBy("doc_id", "skey", "size", "uid").agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    per_source = counted.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    per_source = common.staged(per_source, "mix-sources")
    blocks = per_source.agg(F.max("blocks")).first()[0] or 1  # of the largest source
    salt = max(16, min(1024, blocks // 64))  # copies of the source table that the rows of a source are dealt over
    sources = allot(per_source, weights, share, cap)
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = (
        common.repeated(counted, "n", "i")
        .withColumn("salt", F.pmod(F.xxhash64("uid", "i"), F.lit(salt)).cast("int"))
        .join(salted, ["skey", "salt"])
        .withColumn("whole", F.floor(rate + EPS).cast("int"))
        .withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
        .withColumn("block", F.pmod(F.xxhash64("uid", "i", F.lit(seed)), F.col("blocks")))
        .select("doc_id", "uid", "i", "skey", "block", "size", "source_size", "target", "whole", "p")
    )
    done, level = [], 0
    while True:
        flown = common.staged(units.groupBy("skey", "block").applyInPandas(_fly(level, blocks == 1, seed), units.schema), f"mix-{level}")
        decided = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(flown.where(decided))
        if blocks == 1:
            break
        blocks, level = math.ceil(blocks / MEET), level + 1
        units = flown.where(~decided).withColumn("block", F.floor(F.col("block") / MEET))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "uid", "i", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def repeat_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with each row as often as ``mixed`` (of the same table) takes it and its like together."""
    taken = mixed.groupBy("uid").agg(F.sum("copies").alias("c")).where("c > 0")
    taken = common.repeated(common.staged(taken, "taken"), "c", "i").select("uid")
    return common.whole_rows(docs).join(taken, "uid").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents, weights 3, 1, 2 in turn, 150% of all words, twice a source at most."""
    return mix(common.read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies"
    )
