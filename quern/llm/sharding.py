"""Proportional stratified interleaving into shards, by DataFrame expressions only.

Rows of each source are shuffled by a seeded MD5 of their id and ranked; rank ``r`` of a source of
``n`` rows gets the fraction ``(r + u) / n``, ``u`` being a seeded offset of that source in [0, 1).
All rows are sorted by fraction and cut into runs whose lengths differ by one at most (law ``rows``),
so any run holds each source in proportion, give or take one row.

No rank is computed in one task. Rows are dealt into 4096 buckets by the first digits of their
shuffle key (or by fraction), counts per bucket give each bucket's first rank, and rows are numbered
within their bucket. A source that holds a third of all rows is 4096 buckets like any other.

Defined cases: a null source is a stratum of its own, after the others; a null text has size 8 and
crc32 0, as the empty text; a null id shuffles as the empty id, and rows without one are dealt into
buckets by the checksum of their text; rows with equal shuffle keys are ordered by id, checksum and size;
repeated rows each get a place; of a text only its length and checksum are moved, however long it is; an
empty table gives no rows. Other columns are ignored, whatever their names; ``place`` keeps them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common

SEED = "quern-shards-1"
N_SHARDS = 24
#: Buckets are the first three hexadecimal digits of a key.
HEX, BUCKETS = 3, 16**3


def interleave(docs: DataFrame, n_shards: int = N_SHARDS, seed: str = SEED, uid: bool = False) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text, source), and the
    digest of the row (``common.row_uid``) if asked for."""
    text, more = F.coalesce(F.col("text"), F.lit("")), ["uid"] if uid else []
    nobody = F.lit(hashlib.md5(f"{seed}:".encode()).hexdigest())  # the shuffle key of null ids, whose buckets are cut by checksum
    within = F.when(F.col("h") < nobody, 0).when(F.col("h") > nobody, 4097).otherwise(F.shiftright("text_crc32", 20) + 1)
    keyed = docs.select(
        "doc_id",
        "source",
        common.null_safe(F.col("source")).alias("skey"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("h"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *([common.row_uid(docs).alias("uid")] if uid else []),
    ).withColumn("b", (F.conv(F.substring("h", 1, HEX), 16, 10).cast("long") * 4098 + within))

    per_source = Window.partitionBy("skey")
    strata = (
        keyed.groupBy("skey", "b").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "skey", "b",
            (F.sum("n").over(per_source.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
            F.sum("n").over(per_source).alias("n_source"),
        )
    )
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), "skey").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    in_bucket = Window.partitionBy("skey", "b").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = (
        keyed.join(strata, ["skey", "b"])
        .withColumn("rank", F.col("before") + F.row_number().over(in_bucket) - 1)
        .withColumn("fraction", (F.col("rank").cast("double") + offset) / F.col("n_source").cast("double"))
        .withColumn("g", F.least(F.floor(F.col("fraction") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
        .select("doc_id", "source", "size", "text_crc32", "skey", "rank", "fraction", "g", *more)
    )
    ranked = common.staged(ranked, "shard-ranks")

    everything = Window.partitionBy(F.lit(0))  # over 4096 counts at most
    cuts = (
        ranked.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        .select(
            "g",
            (F.sum("n").over(everything.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"),
            F.sum("n").over(everything).alias("total"),
        )
    )
    in_cut = Window.partitionBy("g").orderBy("fraction", "skey", "rank")
    placed = ranked.join(F.broadcast(cuts), "g").withColumn("pos", F.col("first") + F.row_number().over(in_cut) - 1)
    return placed.withColumn("shard", F.expr(f"(pos * {n_shards}) div total")).select(
        "doc_id", "source", "size", "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"pos - (shard * total + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"), *more,
    )


def place(docs: DataFrame, n_shards: int = N_SHARDS, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` with all its columns, and its shard and slot. Columns of ``docs`` that have these names
    already are kept as ``input_shard`` and ``input_slot``."""
    docs = docs.withColumnsRenamed({c: f"input_{c}" for c in docs.columns if c.lower() in ("shard", "slot")})
    placed = interleave(docs, n_shards, seed, uid=True).select("uid", "shard", "slot")
    return common.whole_rows(docs).join(placed, "uid").select("row.*", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents into 24 shards under the law ``rows``."""
    return digest(interleave(common.read_table(spark, sf_dir, "documents")))


def digest(placed: DataFrame) -> DataFrame:
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: CRC-32 is folded over the bytes of a text with the table of the reflected polynomial 0xEDB88320.
CRC_SQL = """
steps AS (SELECT i AS b, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
          FROM range(256) t(i)),
crc_table AS (SELECT list(c ORDER BY b) AS tab FROM steps),
"""

ORACLE_SQL = f"""
WITH {CRC_SQL.strip()}
base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN chr(1) ELSE chr(0) || source END AS skey,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
         (strlen(coalesce(text, '')) + 8)::BIGINT AS size,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT)),
            lambda c, x: xor(c // 256, tab[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM documents, crc_table),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY skey) AS n FROM base),
placed AS (
  SELECT *, (r::DOUBLE + ('0x' || substr(md5('{SEED}/' || skey), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE) / n::DOUBLE AS fraction FROM ranked),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY fraction, skey, r) - 1 AS pos, count(*) OVER () AS total FROM placed),
cut AS (SELECT *, (pos * {N_SHARDS}) // total AS s FROM numbered)
SELECT doc_id, size, text_crc32, 'rows' AS law, s::INT AS shard, (pos - (s * total + {N_SHARDS - 1}) // {N_SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM cut
"""
