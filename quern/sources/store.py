"""A functional node store: a table and overlays of changes.

Writes make a new store; the base is never touched. Later changes shadow earlier rows by id, which is
one anti-join and a union. Ids are byte-ordered strings.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import paths
from quern.operators import relational
from quern.plans import ir

NODE = "id string, data variant, timestamp timestamp"


class NotFound(KeyError):
    """No node has that id."""


def nodes_from_json(spark: SparkSession, rows: list[tuple[str, Any]], timestamp: str | None = None) -> DataFrame:
    """A VARIANT node table of (id, data) rows, for fixtures and change sets."""
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in rows], "id string, j string")
    at = F.lit(timestamp).cast("timestamp") if timestamp else F.current_timestamp()
    return df.select("id", F.parse_json("j").alias("data"), at.alias("timestamp"))


def overlay(base: DataFrame, top: DataFrame) -> DataFrame:
    """Rows of ``top``, and those of ``base`` that it does not shadow."""
    return base.join(top.select("id"), "id", "left_anti").unionByName(top, allowMissingColumns=True)


class Store:
    def __init__(self, nodes: DataFrame, actor: str = "local"):
        self.nodes, self.actor = nodes, actor

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    # -------------------------------------------------------------- reads

    def list(self) -> DataFrame:
        return self.nodes

    def get(self, id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id)

    def scan_prefix(self, prefix: str) -> DataFrame:
        return self.nodes.where(F.col("id").startswith(prefix)).orderBy("id")

    def scan_range(self, start: str, end: str | None = None) -> DataFrame:
        rows = self.nodes.where(F.col("id") >= start)
        return (rows if end is None else rows.where(F.col("id") < end)).orderBy("id")

    def by_type(self, type: str) -> DataFrame:
        return self.nodes.where(relational.equals(paths.bind(self.nodes).value("type"), type))

    def select(self, type: str | None = None, tag: str | None = None, limit: int | None = None) -> DataFrame:
        """Filtered listing, the first ``limit`` by id."""
        rows, b = self.nodes, paths.bind(self.nodes)
        if type is not None:
            rows = rows.where(relational.equals(b.value("type"), type))
        if tag is not None:
            rows = rows.where(F.coalesce(F.array_contains(b.value("tags").strings, tag), F.lit(False)))
        return rows if limit is None else rows.orderBy("id").limit(limit)

    def stats(self) -> DataFrame:
        """(type, n) of every type, and the total under a null type."""
        per = relational.count_by(self.nodes, "type")
        total = self.nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("type"), "n")
        return total.unionByName(per)

    # -------------------------------------------------------------- type catalog

    def define_type(self, name: str, schema: Any) -> "Store":
        return self.put(f"type:{name}", {"type": "__type_definition__", "name": name, "schema": schema})

    def types(self) -> DataFrame:
        rows = self.by_type("__type_definition__")
        return rows.select(paths.bind(rows).value("name").string.alias("name")).orderBy("name")

    def instances(self, name: str, limit: int | None = None) -> DataFrame:
        return self.select(type=name, limit=limit)

    def schema_of(self, name: str) -> DataFrame:
        rows = self.get(f"type:{name}")
        return rows.select(paths.bind(rows).value("schema").json.alias("schema"))

    # -------------------------------------------------------------- writes

    def _clock(self, id: str) -> Column | None:
        return F.col("clock") if "clock" in self.nodes.columns else None

    def put(self, id: str, data: Any, embedding: list[float] | None = None) -> "Store":
        return self.apply([ir.MutateOp("put", id, data)], embedding=embedding)

    def delete(self, id: str) -> "Store":
        if self.get(id).isEmpty():
            raise NotFound(id)
        return Store(self.nodes.where(F.col("id") != id), self.actor)

    def apply(self, ops, atomic: bool = False, embedding: list[float] | None = None) -> "Store":
        return Store(mutate(self.nodes, tuple(ops), atomic, self.actor, embedding)[0], self.actor)


def _edge_id(op: ir.MutateOp) -> str:
    return f"edge:{op.src}:{op.dst}"


def mutate(nodes: DataFrame, ops: tuple[ir.MutateOp, ...], atomic: bool = False, actor: str = "local", embedding=None) -> tuple[DataFrame, int]:
    """Applies operations in order to a VARIANT node table; (new table, operations that counted).

    Deletes of missing ids do not count. Merges overwrite top-level fields. An atomic batch fails as a
    whole if an id that it deletes or merges is missing.
    """
    spark = nodes.sparkSession
    touched = sorted({_edge_id(o) if o.op.endswith("_edge") else o.id for o in ops})
    # only the touched rows reach the driver: as many as there are operations, at most
    old = {r.id: json.loads(r.j) for r in nodes.where(F.col("id").isin(touched)).select("id", paths.bind(nodes).whole().alias("j")).collect()}
    if atomic:
        lost = [o.id for o in ops if o.op in ("delete", "merge") and o.id not in old]
        if lost:
            raise NotFound(", ".join(lost))
    new, count = dict(old), 0
    for o in ops:
        match o.op:
            case "put":
                new[o.id] = o.data
            case "delete":
                if o.id not in new:
                    continue
                del new[o.id]
            case "merge":
                base = new.get(o.id, {})
                new[o.id] = {**base, **o.data} if isinstance(base, dict) and isinstance(o.data, dict) else o.data
            case "put_edge":
                new[_edge_id(o)] = {"_edge": True, "from": o.src, "to": o.dst, "label": o.label}
            case "delete_edge":
                new.pop(_edge_id(o), None)
        count += 1
    rest = nodes.where(~F.col("id").isin(touched))
    changed = nodes_from_json(spark, [(i, d) for i, d in new.items() if i not in old or d != old[i] or any(o.op == "put" and o.id == i for o in ops)])
    same = nodes.where(F.col("id").isin([i for i in new if i in old and new[i] == old[i] and not any(o.op == "put" and o.id == i for o in ops)]))
    if "clock" in nodes.columns:
        clocks = nodes.where(F.col("id").isin(touched)).select("id", "clock")
        changed = changed.join(clocks, "id", "left").withColumn("clock", bump(F.col("clock"), actor))
    if "embedding" in nodes.columns:
        vector = F.lit(None).cast("array<float>") if embedding is None else F.array(*[F.lit(float(x)) for x in embedding]).cast("array<float>")
        changed = changed.withColumn("embedding", vector)
    return rest.unionByName(same).unionByName(changed, allowMissingColumns=True), count


def bump(clock: Column, actor: str) -> Column:
    """A vector clock with one more update of ``actor``."""
    clock = F.coalesce(clock, F.create_map().cast("map<string,bigint>"))
    mine = F.coalesce(F.element_at(clock, F.lit(actor)), F.lit(0)).cast("bigint") + 1
    return F.map_concat(F.map_filter(clock, lambda k, v: k != actor), F.create_map(F.lit(actor), mine))


def merge_clocks(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


def apply_changes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Folds a change table (seq, op Put or Delete, id, data) of any size into a node table."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
    final = changes.withColumn("_n", last).where("_n = 1").drop("_n")
    kept = nodes.join(final.select("id"), "id", "left_anti")
    return kept.unionByName(final.where("op = 'Put'").drop("op", "seq"), allowMissingColumns=True)


# ------------------------------------------------------------------ files


def backup(nodes: DataFrame, path: str) -> None:
    """One JSON object per node."""
    nodes.select("id", paths.bind(nodes).whole().alias("data"), "timestamp").write.json(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, data string, timestamp timestamp").json(path).withColumn("data", F.parse_json("data"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def snapshot(nodes: DataFrame, path: str, chunk: int = 1000) -> DataFrame:
    """Writes nodes in chunks and returns the manifest (chunk, n, hash): content-addressed by the digests of the rows."""
    body = paths.bind(nodes).whole()
    rows = nodes.select("id", body.alias("data"), "timestamp").withColumn("row_hash", F.sha2(F.concat_ws("\x1f", "id", "data"), 256))
    n = max(1, -(-rows.count() // chunk))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    rows.repartition("chunk").write.partitionBy("chunk").parquet(f"{path}/data")
    stored = nodes.sparkSession.read.parquet(f"{path}/data")
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("row_hash")), ""), 256)
    manifest = stored.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), digest.alias("hash"))
    manifest.write.parquet(f"{path}/manifest")
    return nodes.sparkSession.read.parquet(f"{path}/manifest")


def restore_snapshot(spark: SparkSession, path: str, hashes: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/data")
    if hashes is not None:
        chunks = spark.read.parquet(f"{path}/manifest").where(F.col("hash").isin(hashes)).select("chunk")
        rows = rows.join(chunks, "chunk", "left_semi")
    return rows.select("id", F.parse_json("data").alias("data"), "timestamp")


def blobs(df: DataFrame, content: str) -> DataFrame:
    """Content-addressed: one row (hash, content) per distinct content."""
    return df.select(F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.col(content).alias("content")).dropDuplicates(["hash"])


class Blobs:
    """A content-addressed table (hash, content); writes make a new one."""

    def __init__(self, table: DataFrame):
        self.table = table

    def put(self, df: DataFrame, content: str) -> "Blobs":
        new = blobs(df, content)
        return Blobs(self.table.unionByName(new.join(self.table.select("hash"), "hash", "left_anti")))

    def get(self, hashes: list[str]) -> DataFrame:
        return self.table.where(F.col("hash").isin(hashes))

    def exists(self, hash: str) -> bool:
        return not self.get([hash]).isEmpty()

    def delete(self, hashes: list[str]) -> "Blobs":
        return Blobs(self.table.where(~F.col("hash").isin(hashes)))


FLUSH = 256


def flush(log: DataFrame, order: str = "seq", batch: int = FLUSH) -> DataFrame:
    """A log as blobs of ``batch`` entries each, in order: (batch, first, last, hash, content), content being JSON lines."""
    from quern.streaming.changes import numbered

    rows = numbered(log, order).withColumn("batch", F.floor((F.col("k") - 1) / batch))
    line = F.struct("k", F.to_json(F.struct(*log.columns)).alias("line"))
    lines = rows.groupBy("batch").agg(F.array_sort(F.collect_list(line)).alias("l"), F.min(order).alias("first"), F.max(order).alias("last"))  # of bounded size
    content = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return lines.select("batch", "first", "last", F.sha2(content.cast("binary"), 256).alias("hash"), content.alias("content"))


HISTORY = "taken long, label string, path string, hash string"


def remember(history: DataFrame, entry: DataFrame, keep: int = 100) -> DataFrame:
    """The newest ``keep`` snapshots (HISTORY) with one more; the oldest goes."""
    return history.unionByName(entry).orderBy(F.desc("taken")).limit(keep)


def recall(history: DataFrame, hash: str | None = None) -> str | None:
    """Where the newest snapshot lies, or that of a hash; None if there is none."""
    rows = history if hash is None else history.where(F.col("hash") == hash)
    found = rows.orderBy(F.desc("taken")).select("path").head()
    return found and found.path


def write_daily(timeline: DataFrame, path: str, ts: str = "ts") -> None:
    """One JSON line per entry, in a folder per day (UTC)."""
    day = F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")
    timeline.select(day.alias("day"), F.to_json(F.struct(*timeline.columns)).alias("value")).write.partitionBy("day").text(path)


class Plugin:
    """Hooks on writes. Each default does nothing; a check is a column that is NULL for nodes that may be written."""

    def validate(self, nodes: DataFrame) -> Column:
        return F.lit(None).cast("string")

    def schema_version(self, nodes: DataFrame) -> Column:
        return F.lit(None).cast("string")

    def on_written(self, nodes: DataFrame) -> None: ...

    def on_deleted(self, ids: DataFrame) -> None: ...


def write_checked(nodes: DataFrame, new: DataFrame, plugin: Plugin) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with those of ``new`` that the plugin admits, and (id, error) of the others."""
    checked = new.withColumn("_error", plugin.validate(new))
    good = checked.where("_error is null").drop("_error")
    plugin.on_written(good)
    return overlay(nodes, good), checked.where("_error is not null").select("id", F.col("_error").alias("error"))


def delete_checked(nodes: DataFrame, ids: DataFrame, plugin: Plugin) -> DataFrame:
    gone = nodes.join(ids, "id", "left_semi").select("id")
    plugin.on_deleted(gone)
    return nodes.join(ids, "id", "left_anti")


def decode_vectors(df: DataFrame, column: str) -> DataFrame:
    """Little-endian 32-bit float blobs as vectors; those that are not valid become NULL."""
    @F.pandas_udf("array<float>")
    def decode(blobs_: pd.Series) -> pd.Series:
        def one(b):
            if b is None or not len(b) or len(b) % 4:
                return None
            v = np.frombuffer(b, "<f4")
            return v if np.isfinite(v).all() else None

        return blobs_.map(one)

    return df.withColumn(column, decode(column))
