"""Dotted paths into node data, bound to Spark columns.

A node table has ``id``, ``data`` and maybe ``timestamp``. ``data`` is a STRUCT (columnar sources: paths
become plain columns, so filters and projections reach the scan) or a VARIANT (schemaless JSON). A
path yields a :class:`Value`: one column per JSON type, NULL where the value is not of that type, so
comparisons never coerce. In a STRUCT a NULL field counts as missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


@dataclass(frozen=True)
class Value:
    """What a path holds. ``rank`` orders kinds: missing, null, boolean, number, string, array, object."""

    string: Column
    number: Column
    boolean: Column
    missing: Column
    null: Column
    rank: Column
    json: Column
    strings: Column  # the string elements of an array
    plain: Column | None = None  # a numeric column as it is, for comparisons that the scan can do

    @cached_property
    def absent(self) -> Column:
        return self.missing | self.null


def scalar_json(col: Column) -> Column:
    """JSON text of any column."""
    text = F.to_json(F.struct(col.alias("v")))
    return F.when(col.isNotNull(), F.substr(text, F.lit(6), F.length(text) - 6))


class StructBinding:
    """Paths into a STRUCT column (or, with ``root=None``, the top-level columns)."""

    def __init__(self, df: DataFrame, root: str | None = "data"):
        self.root = root
        self.schema = df.schema[root].dataType if root else df.schema

    def column(self, path: str) -> tuple[Column, T.DataType] | None:
        kind: T.DataType = self.schema
        col = F.col(f"`{self.root}`") if self.root else None
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            kind = kind[part].dataType
            col = F.col(f"`{part}`") if col is None else col.getField(part)
        return col, kind

    def value(self, path: str) -> Value:
        found = self.column(path)
        if found is None:
            return Value(none("string"), none("double"), none("boolean"), F.lit(True), F.lit(False), F.lit(0), none("string"), none("array<string>"))
        col, kind = found
        if isinstance(kind, T.VariantType):
            return variant_value(col)
        rank, plain = 6, None
        string, number, boolean, strings = none("string"), none("double"), none("boolean"), none("array<string>")
        if isinstance(kind, (T.StringType, T.CharType, T.VarcharType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            rank, string = 4, col.cast("string")
        elif isinstance(kind, T.NumericType):
            rank, number, plain = 3, col.cast("double"), col
        elif isinstance(kind, T.BooleanType):
            rank, boolean = 2, col
        elif isinstance(kind, T.ArrayType):
            rank = 5
            if isinstance(kind.elementType, T.StringType):
                strings = col
        return Value(string, number, boolean, col.isNull(), F.lit(False), F.when(col.isNull(), 0).otherwise(rank), scalar_json(col), strings, plain)

    def fields(self) -> list[str]:
        return list(self.schema.names)

    def whole(self) -> Column:
        return F.to_json(F.col(self.root)) if self.root else F.to_json(F.struct("*"))


def variant_value(sub: Column) -> Value:
    kind = F.schema_of_variant(sub)
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    null = F.coalesce(F.is_variant_null(sub) & sub.isNotNull(), F.lit(False))
    rank = (
        F.when(sub.isNull(), 0).when(null, 1).when(kind == "BOOLEAN", 2).when(is_number, 3)
        .when(kind == "STRING", 4).when(kind.startswith("ARRAY"), 5).otherwise(6)
    )
    return Value(
        F.when(kind == "STRING", F.try_variant_get(sub, "$", "string")),
        F.when(is_number, F.try_variant_get(sub, "$", "double")),
        F.when(kind == "BOOLEAN", F.try_variant_get(sub, "$", "boolean")),
        sub.isNull(), null, rank, F.to_json(sub),
        F.when(kind.startswith("ARRAY"), F.try_variant_get(sub, "$", "array<string>")),
    )


class VariantBinding:
    """Paths into a VARIANT column."""

    def __init__(self, df: DataFrame, root: str = "data"):
        self.root = root

    def sub(self, path: str) -> Column:
        return F.try_variant_get(F.col(self.root), "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")

    def value(self, path: str) -> Value:
        return variant_value(self.sub(path))

    def whole(self) -> Column:
        return F.to_json(F.col(self.root))


def bind(df: DataFrame, root: str = "data"):
    """The binding that a node table's ``data`` column needs."""
    return VariantBinding(df, root) if isinstance(df.schema[root].dataType, T.VariantType) else StructBinding(df, root)


def lookup(df: DataFrame, path: str, root: str = "data") -> Value:
    """A path inside ``data``; ``id`` and ``timestamp`` also mean the record's own where data lacks them."""
    b = bind(df, root)
    if path in ("id", "timestamp") and path in df.columns and (isinstance(b, VariantBinding) or b.column(path) is None):
        own = F.col(path).cast("string")
        if isinstance(b, StructBinding):
            return Value(own, none("double"), none("boolean"), own.isNull(), F.lit(False), F.when(own.isNull(), 0).otherwise(4), scalar_json(own), none("array<string>"))
        v = b.value(path)
        use = v.missing
        return Value(
            F.when(use, own).otherwise(v.string), v.number, v.boolean, use & own.isNull(), v.null,
            F.when(use, F.when(own.isNull(), 0).otherwise(4)).otherwise(v.rank), F.when(use, scalar_json(own)).otherwise(v.json), v.strings,
        )
    return b.value(path)
