"""Nearest neighbours by largest inner product, through cross-polytope hashing.

Rows are held in bands of norms that differ by a factor of 1.42 at most, and every band is searched for
every query: in a band the largest inner products are among the smallest angles, so directions are
hashed. A table turns them by pseudo-random rotations (three rounds of random signs and a fast Hadamard
transform) and assigns each to its nearest signed axis; several such cross-polytopes together, of 128
signed axes at most, are a cell's code. A band of ``n`` rows has ``2**ceil(log2(n / CELL))`` cells in each of its
tables, so a cell holds some hundred rows however large the table grows. A query probes, in every
table, the square root of the cells' number, those whose axes lie nearest to it together: the share of
rows that it meets falls as the table grows. What it meets is reranked by the inner product of the
original vectors in double precision, summed in order of the components.

The same law holds at every size. In a band of two cells or one the square root is all of them: one table
meets every row there, and the answer is exact.

Every row is indexed. Rows are sent to one cell of each table, queries to the cells that they probe. A
cell that holds far more rows or queries than others, by its own counts, is dealt into chunks of bounded
rows and queries, and only the rows and queries of that cell are copied for it. Copies of a vector beyond
the first ``k + 1`` distinct ids cannot be among the ``k`` nearest and are left out of the index exactly.

Recall against brute force is measured in the tests (0.9 at least).

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
neither do rows without an id; vectors of different lengths do not meet; repeated rows of an id count
once, with their best score; ties go to the smaller id; an empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import common

K, TABLES, AXES, CELL, SEED = 20, 10, 64, 256, 7
#: Indexed rows and queries that meet in one group; a cell with more is dealt into several.
ROWS, QUERIES = 4096, 2048
#: Place of the table's number in a cell's code.
SHIFT = 48
SLACK = 1e-9
#: Bands are powers of this factor.
BAND = math.sqrt(2)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; their length is a power of two."""
    n, d, h = len(x), x.shape[1], 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def rotate(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """The first AXES components of a pseudo-random rotation."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng([seed, table, d])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], d))
    return x[:, :AXES]


def bits_of(n: int) -> int:
    """Bits of a cell's code in a table over ``n`` rows."""
    return max(0, math.ceil(math.log2(max(1, n) / CELL)))


def probes_of(bits: int) -> int:
    return math.ceil(math.sqrt(1 << bits))


def tables_of(bits: int, tables: int = TABLES) -> int:
    """Where every cell is probed, one table is enough."""
    return tables if probes_of(bits) < 1 << bits else 1


def _polytopes(unit: np.ndarray, bits: int, table: int, seed: int):
    """Components along the signed axes of each of a table's cross-polytopes."""
    most = min(2 * AXES, 2 << max(0, (unit.shape[1] - 1).bit_length())).bit_length() - 1
    count = -(-bits // most)
    for j in range(count):
        axes = 1 << (bits // count + (j < bits % count) - 1)
        r = rotate(unit, table * 64 + j, seed)[:, :axes]
        yield np.concatenate([r, -r], axis=1)


def cells(x: np.ndarray, bits: int, probes: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Codes (rows x tables * probes) of the cells of vectors of one length: the ``probes`` nearest, nearest first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for t in range(tables):
        code, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for along in _polytopes(unit, bits, t, seed):
            if probes == 1:
                code = code * along.shape[1] + along.argmax(axis=1)[:, None]
                continue
            away = (along.max(axis=1, keepdims=True) - along) ** 2
            cost = (cost[:, :, None] + away[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * along.shape[1] + np.arange(along.shape[1])).reshape(len(x), -1)
            order = np.argsort(cost, axis=1, kind="stable")[:, :probes]  # the best of a sum are among the best of its parts
            cost, code = np.take_along_axis(cost, order, axis=1), np.take_along_axis(code, order, axis=1)
        out.append(code | (t << SHIFT))
    return np.concatenate(out, axis=1)


def valid(v: Column) -> Column:
    ok = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(v.isNotNull() & ok, F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = K, tables: int = TABLES, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each row of ``vectors`` (vec_id,
    embedding) for which ``is_query`` holds."""
    kind = vectors.schema["embedding"].dataType
    v = F.col("embedding") if kind == T.ArrayType(T.FloatType(), kind.containsNull) else F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), is_query.alias("q"))
    # the largest component is divided out first, so no square overflows or vanishes
    wide = F.col("v").cast("array<double>")
    rows, most = rows.where(valid(F.col("v"))).withColumn("most", F.array_max(F.transform(wide, F.abs))), F.col("most")
    norm = F.log(most) + 0.5 * F.log(F.aggregate(wide, F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    rows = rows.withColumn("band", F.round(norm / math.log(BAND)).cast("int")).withColumn("d", F.size("v")).drop("most")
    rows = common.staged(rows, "vectors")
    seen = rows.groupBy("d", "band").count().collect()  # a row per length and band of norms, some thousand bands at most
    sizes = [(d, band, bits_of(n), probes_of(bits_of(n)), tables_of(bits_of(n), tables)) for d, band, n in seen]
    bands = vectors.sparkSession.createDataFrame(sizes, "d int, band int, bits int, probes int, tables int")

    @F.pandas_udf("array<long>")
    def assign(vs: pd.Series, bits: pd.Series, probes: pd.Series, tables: pd.Series) -> pd.Series:
        out = np.empty(len(vs), object)
        shape = pd.DataFrame({"d": vs.map(len).to_numpy(), "bits": bits, "probes": probes, "tables": tables})
        for (_, b, p, t), at in shape.groupby(["d", "bits", "probes", "tables"]).indices.items():
            step = max(1, 2_000_000 // (int(p) * 2 * AXES))
            for s in range(0, len(at), step):
                part = at[s : s + step]
                for i, c in zip(part, cells(np.stack([vs.iloc[i] for i in part]).astype(float), int(b), int(p), int(t), seed)):
                    out[i] = c
        return pd.Series(out)

    first = Window.partitionBy("v").orderBy("id")
    distinct = rows.select("id", "v", "d", "band").distinct().withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)
    one = F.lit(1)
    index = distinct.join(bands, ["d", "band"]).select("d", "band", "id", "v", assign("v", "bits", one, "tables").alias("cells"))
    queries = rows.where("q").select("id", "v", "d").distinct().join(bands, "d").select("d", "band", "id", "v", assign("v", "bits", "probes", "tables").alias("cells"))
    index = common.staged(index, "vector-cells")
    queries = common.staged(queries, "query-cells", (rows,))
    cell = ["d", "band", "cell"]
    index, queries = (t.select("d", "band", F.explode("cells").alias("cell"), "id", "v") for t in (index, queries))
    sizes = index.select(*cell, F.lit(1).alias("m"), F.lit(0).alias("c")).unionByName(queries.select(*cell, F.lit(0).alias("m"), F.lit(1).alias("c")))
    sizes = sizes.groupBy(*cell).agg(F.ceil(F.sum("m") / ROWS).cast("int").alias("cm"), F.ceil(F.sum("c") / QUERIES).cast("int").alias("cq"))
    hot = common.staged(sizes.where("cm > 1 or cq > 1"), "hot-cells")  # most cells are not

    def dealt(t: DataFrame, query: bool) -> DataFrame:
        """Rows of a hot cell go to one of its chunks of rows for each of its chunks of queries, and queries the other way round."""
        own, other = ("cq", "cm") if query else ("cm", "cq")
        t = t.join(hot, cell, "left").withColumn("own", F.pmod(F.xxhash64("id", F.hash("v")), F.greatest(F.coalesce(own, F.lit(1)), F.lit(1))).cast("int"))
        t = t.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(other, F.lit(1)), F.lit(1)) - 1)))
        return t.select(*cell, F.col("other" if query else "own").alias("m"), F.col("own" if query else "other").alias("c"), F.lit(query).alias("q"), "id", "v")

    both = dealt(index, False).unionByName(dealt(queries, True))

    def nearest(rows: pd.DataFrame) -> pd.DataFrame:
        is_q = rows["q"].to_numpy()
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        if is_q.all() or not is_q.any():
            return none
        x = np.stack(rows["v"].to_numpy()).astype(float)
        ids = rows["id"].to_numpy()
        a, a_ids, b, b_ids = x[is_q], ids[is_q], x[~is_q], ids[~is_q]
        order = np.argsort(b_ids, kind="stable")
        b, b_ids = b[order], b_ids[order]
        firsts = np.flatnonzero(np.r_[True, b_ids[1:] != b_ids[:-1]])  # an id may have several vectors
        out = []
        step = max(1, 4_000_000 // len(b))
        for s in range(0, len(a), step):
            rough = a[s : s + step] @ b.T
            rough[a_ids[s : s + step, None] == b_ids[None, :]] = -np.inf
            per_id = rough if len(firsts) == len(b) else np.maximum.reduceat(rough, firsts, axis=1)
            least = np.partition(per_id, -min(k, len(firsts)), axis=1)[:, -min(k, len(firsts))]
            least = least - SLACK * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
            qi, bi = np.nonzero((rough >= least[:, None]) & np.isfinite(rough))
            exact = np.cumsum(a[s + qi] * b[bi], axis=1)[:, -1]
            order = np.lexsort([b_ids[bi], -exact, qi])
            qi, bi, exact = qi[order], bi[order], exact[order]
            if len(firsts) < len(b):  # the best of each id stands first
                _, best = np.unique(np.stack([qi, b_ids[bi]]), axis=1, return_index=True)
                best.sort()
                qi, bi, exact = qi[best], bi[best], exact[best]
            near = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            out.append((a_ids[s + qi[near]], b_ids[bi[near]], exact[near]))
        query, vec, score = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})

    found = both.groupBy(*cell, "m", "c").applyInPandas(nearest, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the 20 nearest of every row whose id is divisible by 20."""
    return search(common.read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: The exact answer, which the search equals on tables of up to ``2 * CELL`` rows, which have two cells at most.
ORACLE_SQL = """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 20
"""
