"""Shared helpers: table access, staged tables, null-safe keys and the corpus word rule."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of every contract: runs of anything but ASCII white space. ``bytes.split()`` is this rule.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI with its scheme: ``spark.checkpoint.dir``; only a session without
    one (tests on one machine) gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not re.match(r"[A-Za-z][\w+.-]*:", found):  # on the default file system, which only Spark knows
        path = _hadoop_path(spark, found)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return found.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _tidy(df: DataFrame) -> DataFrame:
    """The same plan in a copy of its session, in which a write's shuffle files go when it ends: the table that it
    wrote needs them no more. The caller's session keeps its settings."""
    spark = df.sparkSession
    copy = spark._jsparkSession.cloneSession()
    plan = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy, df._jdf.logicalPlan())
    own = spark.__class__(spark.sparkContext, copy)
    own.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return DataFrame(plan, own)


def staged(df: DataFrame, what: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: lineage is cut there, and a lost
    executor costs a reread, not a recomputation. Staged tables that only this one reads, ``done``, are removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _tidy(df).write.parquet(path)
    for table in done:
        old = _hadoop_path(spark, table.staged_path)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def null_safe(col: Column) -> Column:
    """A non-null string key that keeps null apart from every string and sorts it last."""
    return F.when(col.isNull(), F.lit("\x01")).otherwise(F.concat(F.lit("\x00"), col.cast("string")))


def n_words(col: Column) -> Column:
    """Number of words of the corpus rule; null text: 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def row_uid(docs: DataFrame) -> Column:
    """A 128-bit digest, as 32 hexadecimal digits, of all columns of a row. Null differs from every value,
    and nested columns and maps count with all that they hold."""

    def piece(field: T.StructField) -> Column:
        col = F.col("`" + field.name.replace("`", "``") + "`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            stamps = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
            value = F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"} | stamps)
        else:
            value = col if isinstance(field.dataType, T.BinaryType) else col.cast("string")
        return F.when(col.isNull(), F.lit("-")).otherwise(F.md5(value.cast("binary")))

    return F.md5(F.concat_ws(",", *[piece(f) for f in sorted(docs.schema, key=lambda f: f.name)]).cast("binary"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(uid, row): each distinct row of ``docs`` once. Rows alike in every column meet before the shuffle."""
    return docs.select(row_uid(docs).alias("uid"), F.struct("*").alias("row")).groupBy("uid").agg(F.first("row").alias("row"))


def repeated(counted: DataFrame, n: str, i: str, chunk: int = 1 << 16) -> DataFrame:
    """Each row of ``counted`` (with ``uid``) as often as its column ``n`` says, numbered from 0 as ``i``. What is
    repeated very often is dealt over many tasks first."""
    few = counted.where(F.col(n).between(1, chunk)).withColumn(i, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)))
    many = counted.where(F.col(n) > chunk)
    if many.isEmpty():
        return few
    many = many.withColumn(i, F.explode(F.expr(f"sequence(0L, bigint(`{n}` - 1), {chunk}L)"))).repartition("uid", i)
    return few.unionByName(many.withColumn(i, F.explode(F.expr(f"sequence(`{i}`, least(`{i}` + {chunk}L, bigint(`{n}`)) - 1)"))))
