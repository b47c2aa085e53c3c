"""Filter, sort, project and aggregate as columns.

Predicates are two-valued: every comparison is coalesced at the leaf, so a missing or mistyped field
is false and ``!=`` and ``not`` of it are true.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import paths
from quern.plans import ir


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _number(v: paths.Value) -> Column:
    return v.number if v.plain is None else v.plain


def _raw(v: paths.Value, op: str, literal, regex: bool = False) -> Column:
    """A comparison that is NULL, not false, where the field is missing or of another type."""
    if op == "==":
        if literal is None:
            return v.absent
        if isinstance(literal, bool):
            return v.boolean == F.lit(literal)
        return _number(v) == F.lit(literal) if isinstance(literal, (int, float)) else v.string == F.lit(literal)
    if op in (">", ">=", "<", "<="):
        if isinstance(literal, bool) or not isinstance(literal, (int, float)):
            return F.lit(False)
        n, x = _number(v), F.lit(literal)
        return {">": n > x, ">=": n >= x, "<": n < x, "<=": n <= x}[op]
    if not isinstance(literal, str):
        return F.lit(False)
    if op == "starts_with":
        return v.string.startswith(literal)
    return v.string.rlike(literal) if op == "matches" and regex else v.string.contains(literal)


def equals(v: paths.Value, literal) -> Column:
    """Strictly typed equality; a missing field equals null."""
    return _false(_raw(v, "==", literal))


def compare(v: paths.Value, op: str, literal, regex: bool = False) -> Column:
    return ~equals(v, literal) if op == "!=" else _false(_raw(v, op, literal, regex))


#: Operators of a visual query builder, by what they mean here.
VISUAL = {
    "equals": lambda v, x: equals(v, x), "not": lambda v, x: ~equals(v, x), "contains": lambda v, x: compare(v, "contains", x),
    "not_contains": lambda v, x: ~compare(v, "contains", x), "starts": lambda v, x: compare(v, "starts_with", x),
    "ends": lambda v, x: _false(v.string.endswith(x)), "gt": lambda v, x: compare(v, ">", x), "lt": lambda v, x: compare(v, "<", x),
    "is_empty": lambda v, x: v.absent | _false(v.string == ""), "is_not_empty": lambda v, x: ~(v.absent | _false(v.string == "")),
}


def visual(df: DataFrame, group: dict) -> Column:
    """The condition of a group ``{"join": "and" or "or", "rules": [...]}`` of rules (field, op, value) and groups."""
    parts = [visual(df, r) if "rules" in r else VISUAL[r["op"]](paths.lookup(df, r["field"]), r.get("value")) for r in group["rules"]]
    if not parts:
        return F.lit(True)
    return reduce(lambda a, b: a & b if group.get("join", "and") == "and" else a | b, parts)


def predicate(df: DataFrame, p: ir.Predicate) -> Column:
    """A column that is true or false, never NULL."""
    match p:
        case ir.Compare():
            return compare(paths.lookup(df, p.field), p.op, p.value, p.regex)
        case ir.And():
            return reduce(lambda a, b: a & b, (predicate(df, x) for x in p.parts), F.lit(True))
        case ir.Or():
            return reduce(lambda a, b: a | b, (predicate(df, x) for x in p.parts), F.lit(False))
        case ir.Not():
            return ~predicate(df, p.part)
    raise ir.QueryError("not a predicate")


def where(df: DataFrame, p: ir.Predicate) -> DataFrame:
    """Rows for which a predicate holds. Outside of negations NULL and false select alike, so comparisons
    stay bare there and reach the scan."""

    def bare(p: ir.Predicate) -> Column:
        match p:
            case ir.Compare() if p.op != "!=":
                return _raw(paths.lookup(df, p.field), p.op, p.value, p.regex)
            case ir.And() if p.parts:
                return reduce(lambda a, b: a & b, map(bare, p.parts))
            case ir.Or() if p.parts:
                return reduce(lambda a, b: a | b, map(bare, p.parts))
        return predicate(df, p)

    return df.where(bare(p))


def order_by(df: DataFrame, path: str, direction: str) -> list[Column]:
    """Sort keys: kind, then value; ties by ascending id in either direction. A statically typed field
    is one native key (missing sorts lowest), so a limit becomes a top-k."""
    b = paths.bind(df)
    static = isinstance(b, paths.StructBinding) and (path not in ("id", "timestamp") or b.column(path) is not None)
    found = b.column(path) if static else None
    if found and isinstance(found[1], (T.NumericType, T.StringType, T.BooleanType)):
        col = found[0].cast("double") if isinstance(found[1], T.NumericType) else found[0]
        return [col.asc_nulls_first() if direction == "asc" else col.desc_nulls_last(), F.col("id").asc()]
    v = paths.lookup(df, path)
    keys = [v.rank, v.boolean, v.number, v.string]
    return [k.asc_nulls_first() if direction == "asc" else k.desc_nulls_last() for k in keys] + [F.col("id").asc()]


def after_cursor(df: DataFrame, path: str, direction: str, cursor: str) -> DataFrame:
    """Rows that sort after the row with id ``cursor``; all rows if there is none. The cursor's keys are
    one row, joined as a scalar; no ranking over all rows is needed."""
    v = paths.lookup(df, path)
    key = F.struct(v.rank.alias("k"), v.boolean.alias("b"), v.number.alias("n"), v.string.alias("s"))
    at = df.where(F.col("id") == cursor).select(key.alias("_at")).limit(1)
    # one row always, with a null key if the cursor is unknown
    one = df.sparkSession.range(1).select(F.lit(1).alias("_one")).join(at.select("_at", F.lit(1).alias("_one")), "_one", "left").drop("_one")
    keyed = df.withColumn("_key", key).join(F.broadcast(one))
    further = F.col("_key") > F.col("_at") if direction == "asc" else F.col("_key") < F.col("_at")
    tied = F.col("_key").eqNullSafe(F.col("_at")) & (F.col("id") > F.lit(cursor))
    keep = F.col("_at").isNull() | further | tied
    return keyed.where(keep).drop("_key", "_at")


def project(df: DataFrame, specs: tuple[ir.FieldSpec, ...]) -> DataFrame:
    """``data`` becomes the chosen fields; absent ones are left out, of equal names the last counts."""
    last = {s.name: s.path for s in specs}
    b = paths.bind(df)
    if isinstance(b, paths.StructBinding):
        cols = []
        for name, path in last.items():
            found = b.column(path)
            if found is None and path in ("id", "timestamp") and path in df.columns:
                found = (F.col(path), df.schema[path].dataType)
            if found is not None:
                cols.append(found[0].alias(name))
        data = F.struct(*cols) if cols else F.struct(F.lit(None).cast("string").alias("_"))
        return df.withColumn("data", data)
    parts = []
    for name, path in last.items():
        sub = b.sub(path)
        if path in ("id", "timestamp") and path in df.columns:
            sub = F.coalesce(sub, F.parse_json(paths.scalar_json(F.col(path).cast("string"))))
        parts += [F.lit(name), sub]
    present = F.map_filter(F.create_map(*parts), lambda k, v: v.isNotNull())
    return df.withColumn("data", F.to_variant_object(present))


def aggregate(df: DataFrame, fn: str, field: str | None) -> DataFrame:
    """One row with ``value``; distinct and collect give ``values``, JSON texts in input order (id order)."""
    if fn == "count":
        return df.agg(F.count(F.lit(1)).alias("value"))
    if fn == "collect" and field is None:
        text = paths.bind(df).whole()
        return df.agg(_collected(text, F.lit(True)).alias("values"))
    if field is None:
        raise ir.QueryError(f"{fn} needs a field")
    v = paths.lookup(df, field)
    if fn in ("sum", "avg", "min", "max"):
        return df.agg(getattr(F, fn)(v.number).alias("value"))
    if fn == "collect":
        return df.agg(_collected(v.json, ~v.missing).alias("values"))
    firsts = df.where(~v.missing).select("id", v.json.alias("j")).groupBy("j").agg(F.min("id").alias("id"))
    return firsts.agg(_collected(F.col("j"), F.lit(True)).alias("values"))


def _collected(text: Column, keep: Column) -> Column:
    rows = F.collect_list(F.when(keep, F.struct(F.col("id"), text.alias("j"))))
    return F.transform(F.array_sort(rows), lambda r: r["j"])


def count_by(df: DataFrame, path: str) -> DataFrame:
    """Rows per string value of a path; rows without one are left out."""
    v = paths.lookup(df, path)
    return df.select(v.string.alias("type")).where("type is not null").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
