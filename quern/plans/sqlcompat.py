"""SQL pass-through: statements of the embedded engine's dialect, run by Spark SQL."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Functions that only differ in name or shape, outside of string literals.
_REWRITES = [
    (re.compile(r"\bGROUP_CONCAT\s*\(\s*(DISTINCT\s+)?([A-Za-z_][\w.]*)\s*\)", re.I), r"listagg(\1CAST(\2 AS STRING), ',') WITHIN GROUP (ORDER BY CAST(\2 AS STRING))"),
    (re.compile(r"\bjson_extract\s*\(", re.I), "get_json_object("),
    (re.compile(r"\bunixepoch\s*\(\s*\)", re.I), "unix_timestamp()"),
    (re.compile(r"\bDATE\s*\(\s*([^(),]+?)\s*,\s*'unixepoch'\s*\)", re.I), r"to_date(timestamp_seconds(\1))"),
    (re.compile(r"\bNOT\s+LIKE\b", re.I), "NOT ILIKE"),
    (re.compile(r"(?<!NOT )\bLIKE\b", re.I), "ILIKE"),
    (re.compile(r"\bIFNULL\s*\(", re.I), "coalesce("),
    (re.compile(r"\bWITHOUT\s+ROWID\b", re.I), ""),
]
_LITERAL = re.compile(r"('(?:[^']|'')*')")


#: ``?`` is the parameter after the highest so far, ``?3`` the third.
_MARKER = re.compile(r"\?(\d*)")
_TYPES = [("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "bigint")]


def rewrite(sql: str) -> str:
    """The statement in Spark's dialect, parameters as ``:p1``, ``:p2``, ...; string literals stay as they are, but for
    those the rewrites name."""
    dated = re.compile(r"unixepoch")
    index = next(k for k, (pattern, _) in enumerate(_REWRITES) if dated.search(pattern.pattern) and "DATE" in pattern.pattern)
    sql = _REWRITES[index][0].sub(_REWRITES[index][1], sql)
    parts, last = _LITERAL.split(sql), 0

    def marker(m: re.Match) -> str:
        nonlocal last
        n = int(m[1]) if m[1] else last + 1
        last = max(last, n)
        return f":p{n}"

    for i in range(0, len(parts), 2):
        for k, (pattern, new) in enumerate(_REWRITES):
            if k != index:
                parts[i] = pattern.sub(new, parts[i])
        parts[i] = _MARKER.sub(marker, parts[i])
    return "".join(parts)


def bind(value: Any) -> Any:
    """Parameters: booleans as 0 and 1, arrays and objects as JSON text."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (list, dict)):
        return json.dumps(value, separators=(",", ":"))
    return value


def _split(text: str, at: str) -> list[str]:
    """Parts between ``at`` outside of literals and brackets."""
    out, depth, quoted, part = [], 0, False, ""
    for c in text:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == at and not quoted and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [p.strip() for p in [*out, part] if p.strip()]


class Database:
    """Tables by name, queried with positional parameters. Tables that statements make or change are lazy plans: an
    insert is a union, an update a projection, a delete a filter."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.unique: dict[str, list[str]] = {}

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def query(self, sql: str, params: list[Any] | None = None) -> DataFrame:
        text = rewrite(sql)
        named = {f"p{i}": bind(p) for i, p in enumerate(params or [], 1) if re.search(rf":p{i}\b", text)}
        return self.spark.sql(text, args=named or None)

    def columns(self, sql: str, params: list[Any] | None = None) -> list[str]:
        return self.query(sql, params).columns

    def get(self, sql: str, params: list[Any] | None = None) -> dict | None:
        row = self.query(sql, params).head()
        return None if row is None else row.asDict()

    def exec(self, script: str) -> None:
        """Statements that make, change or drop tables and views. Indexes and triggers change no result and are skipped."""
        for statement in _split(script, ";"):
            self._statement(statement)

    def _statement(self, text: str) -> None:
        m = re.match(r"(?is)CREATE\s+(?:UNIQUE\s+)?(INDEX|TRIGGER)\b", text)
        if m:
            return
        if m := re.match(r"(?is)CREATE\s+(?:TEMP\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+AS\s+(.*)", text):
            return self.register(m[1], self.query(m[2]))
        if m := re.match(r"(?is)CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s*\((.*)\)[^)]*$", text):
            return None if m[1] and m[2] in self.tables else self._create(m[2], m[3])
        if m := re.match(r"(?is)DROP\s+(?:TABLE|VIEW)\s+(IF\s+EXISTS\s+)?(\w+)$", text):
            if not m[1] and m[2] not in self.tables:
                raise ValueError(f"no table {m[2]}")
            self.tables.pop(m[2], None)
            self.spark.catalog.dropTempView(m[2])
            return None
        if m := re.match(r"(?is)ALTER\s+TABLE\s+(\w+)\s+ADD\s+(?:COLUMN\s+)?(\w+)\s+(\w+)", text):
            return self.register(m[1], self.tables[m[1]].withColumn(m[2], F.lit(None).cast(_type(m[3]))))
        if m := re.match(r"(?is)ALTER\s+TABLE\s+(\w+)\s+RENAME\s+(?:COLUMN\s+)?(\w+)\s+TO\s+(\w+)", text):
            return self.register(m[1], self.tables[m[1]].withColumnRenamed(m[2], m[3]))
        if m := re.match(r"(?is)INSERT\s+(OR\s+IGNORE\s+)?INTO\s+(\w+)\s*(?:\(([^)]*)\)\s*)?(VALUES|SELECT|WITH)\b(.*)", text):
            return self._insert(m[2], [c.strip() for c in m[3].split(",")] if m[3] else None, m[4] + m[5], bool(m[1]))
        if m := re.match(r"(?is)UPDATE\s+(\w+)\s+SET\s+(.*?)(?:\s+WHERE\s+(.*))?$", text):
            return self._update(m[1], m[2], m[3])
        if m := re.match(r"(?is)DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*))?$", text):
            t = self.tables[m[1]]
            hit = F.expr(rewrite(m[2])) if m[2] else F.lit(True)
            return self.register(m[1], t.where(~F.coalesce(hit, F.lit(False))))
        raise ValueError(f"cannot run {text[:40]!r}")

    def _create(self, name: str, body: str) -> None:
        columns = []
        for part in _split(body, ","):
            if m := re.match(r"(?is)(?:UNIQUE|PRIMARY\s+KEY)\s*\(([^)]*)\)", part):
                self.unique[name] = [c.strip() for c in m[1].split(",")]
            elif not re.match(r"(?i)(CONSTRAINT|FOREIGN|CHECK)\b", part):
                column, _, rest = part.partition(" ")
                if re.search(r"(?i)\b(UNIQUE|PRIMARY\s+KEY)\b", rest):
                    self.unique.setdefault(name, [column])
                columns.append(f"`{column}` {_type(rest)}")
        self.register(name, self.spark.createDataFrame([], ", ".join(columns)))

    def _insert(self, name: str, columns: list[str] | None, source: str, ignore: bool) -> None:
        t = self.tables[name]
        columns = columns or t.columns
        rows = self.query(f"SELECT * FROM ({source})" if source[:6].upper() == "VALUES" else source).toDF(*columns)
        kinds = dict(t.dtypes)
        rows = rows.select(*[(F.col(c) if c in columns else F.lit(None)).cast(kinds[c]).alias(c) for c in t.columns])
        key = self.unique.get(name)
        if ignore and key:
            rows = rows.dropDuplicates(key).join(t.select(*key), key, "left_anti").select(*t.columns)
        self.register(name, t.unionByName(rows))

    def _update(self, name: str, changes: str, where: str | None) -> None:
        t = self.tables[name]
        hit = F.coalesce(F.expr(rewrite(where)), F.lit(False)) if where else F.lit(True)
        new = dict(re.match(r"(?s)\s*(\w+)\s*=\s*(.*)", c).groups() for c in _split(changes, ","))
        kinds = dict(t.dtypes)
        self.register(name, t.select(*[F.when(hit, F.expr(rewrite(new[c])).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in t.columns]))


def _type(declared: str) -> str:
    return next((kind for sign, kind in _TYPES if sign in declared.upper()), "string")
