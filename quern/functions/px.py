"""The rule language's expressions: parsed once, then compiled to columns or evaluated in Python.

Operators by rising precedence: ``? :``, ``||``, ``&&``, comparisons (``== != >= <= > < contains in matches
starts_with ends_with``), ``+ -``, ``* / %``, unary ``! -``, pipes ``x | filter(args)``, then paths ``a.b[0]["k"]``,
calls and ``match`` expressions. Equality compares numbers if both sides are numbers or read as such,
else text. Lengths are in bytes. A division by zero and an unresolved path are null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import paths


class PxError(ValueError):
    """An expression that cannot be read."""


# ---------------------------------------------------------------------------- parser

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>\$?[A-Za-z_][A-Za-z0-9_]*)
    |(?P<mark>\.\.=|\.\.|=>|==|!=|>=|<=|&&|\|\||[-+*/%!<>?:()\[\]{}.,|]))""",
    re.X,
)
_WORD_OPS = {"contains", "in", "matches", "starts_with", "ends_with"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise PxError(f"cannot read {text[at:at + 20]!r}")
        token = m[m.lastgroup]
        out.append((m.lastgroup, token))
        at = m.start(m.lastgroup) + len(token)
    return out


class _Parser:
    def __init__(self, text: str):
        self.t, self.i = _tokens(text), 0

    def at(self, *values: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][0] != "string" and self.t[self.i][1] in values

    def take(self, value: str | None = None) -> str:
        if self.i >= len(self.t) or value is not None and not self.at(value):
            raise PxError(f"expected {value or 'more'}" + (f", got {self.t[self.i][1]!r}" if self.i < len(self.t) else ""))
        self.i += 1
        return self.t[self.i - 1][1]

    def whole(self) -> tuple:
        e = self.expression()
        if self.i < len(self.t):
            raise PxError(f"unexpected {self.t[self.i][1]!r}")
        return e

    def expression(self) -> tuple:
        c = self.either()
        if self.at("?"):
            self.take()
            a = self.expression()
            self.take(":")
            return ("if", c, a, self.expression())
        return c

    def either(self) -> tuple:
        e = self.both()
        while self.at("||"):
            self.take()
            e = ("or", e, self.both())
        return e

    def both(self) -> tuple:
        e = self.comparison()
        while self.at("&&"):
            self.take()
            e = ("and", e, self.comparison())
        return e

    def comparison(self) -> tuple:
        e = self.sum()
        if self.at("==", "!=", ">=", "<=", ">", "<", *_WORD_OPS):
            op = self.take()
            return (op, e, self.sum())
        return e

    def sum(self) -> tuple:
        e = self.product()
        while self.at("+", "-"):
            e = (self.take(), e, self.product())
        return e

    def product(self) -> tuple:
        e = self.unary()
        while self.at("*", "/", "%"):
            e = (self.take(), e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.at("!"):
            self.take()
            return ("not", self.unary())
        if self.at("-"):
            self.take()
            return ("neg", self.unary())
        return self.piped()

    def piped(self) -> tuple:
        e = self.primary()
        while self.at("|"):
            self.take()
            name = self.take()
            e = ("filter", name, e, self.arguments() if self.at("(") else ())
        return e

    def arguments(self) -> tuple:
        self.take("(")
        out = []
        while not self.at(")"):
            if out:
                self.take(",")
            out.append(self.expression())
        self.take(")")
        return tuple(out)

    def string(self) -> str:
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), self.take()[1:-1])

    def primary(self) -> tuple:
        if self.i >= len(self.t):
            raise PxError("expected a value")
        kind, v = self.t[self.i]
        if kind == "string":
            return ("value", self.string())
        if kind == "number":
            self.take()
            return ("value", float(v) if "." in v else int(v))
        if self.at("("):
            self.take()
            e = self.expression()
            self.take(")")
            return e
        if self.at("["):
            self.take()
            items = []
            while not self.at("]"):
                if items:
                    self.take(",")
                items.append(self.expression())
            self.take("]")
            return ("list", tuple(items))
        if kind != "name":
            raise PxError(f"unexpected {v!r}")
        if v in ("true", "false", "null"):
            self.take()
            return ("value", {"true": True, "false": False, "null": None}[v])
        if v == "match":
            return self.match()
        self.take()
        if self.at("("):
            return ("call", v, self.arguments())
        return self.path(v)

    def path(self, first: str) -> tuple:
        parts: list[str | int] = [first.lstrip("$")]
        while self.at(".", "["):
            if self.take() == ".":
                parts.append(self.take())
            else:
                kind, v = self.t[self.i]
                parts.append(self.string() if kind == "string" else int(self.take()))
                self.take("]")
        return ("path", tuple(parts))

    def match(self) -> tuple:
        self.take("match")
        subject, arms = self.either(), []
        self.take("{")
        while not self.at("}"):
            alternatives = [self.pattern()]
            while self.at("|"):
                self.take()
                alternatives.append(self.pattern())
            guard = None
            if self.at("if"):
                self.take()
                guard = self.either()
            self.take("=>")
            arms.append((tuple(alternatives), guard, self.expression()))
            if self.at(","):
                self.take()
        self.take("}")
        return ("match", subject, tuple(arms))

    def pattern(self) -> tuple:
        if self.at("_"):
            self.take()
            return ("any",)
        if self.at("("):
            self.take()
            parts = []
            while not self.at(")"):
                if parts:
                    self.take(",")
                parts.append(self.pattern())
            self.take(")")
            return ("tuple", tuple(parts))
        if self.at("{"):
            self.take()
            fields = []
            while not self.at("}"):
                if fields:
                    self.take(",")
                name = self.take()
                self.take(":")
                fields.append((name, self.pattern()))
            self.take("}")
            return ("struct", tuple(fields))
        kind, v = self.t[self.i]
        if kind == "name" and v.startswith("$"):
            self.take()
            return ("bind", v[1:])
        e = self.unary_literal()
        if self.at("..", "..="):
            closed = self.take() == "..="
            return ("range", e, self.unary_literal(), closed)
        return ("equal", e)

    def unary_literal(self) -> Any:
        sign = -1 if self.at("-") else 1
        if sign < 0:
            self.take()
        kind, v = self.t[self.i]
        if kind == "string":
            return self.string()
        self.take()
        if kind == "number":
            return sign * (float(v) if "." in v else int(v))
        return {"true": True, "false": False, "null": None}.get(v, v)


def parse(text: str) -> tuple:
    return _Parser(text).whole()


# ---------------------------------------------------------------------------- columns


@dataclass(frozen=True)
class Px:
    """A column with its kind: string, number, boolean, array, object, null or variant."""

    col: Column
    kind: str

    @property
    def number(self) -> Column:
        match self.kind:
            case "number":
                return self.col.cast("double")
            case "boolean":
                return self.col.cast("int").cast("double")
            case "string":
                return self.col.try_cast("double")
            case "variant":
                v = paths.variant_value(self.col)
                return F.coalesce(v.number, v.string.try_cast("double"), v.boolean.cast("int").cast("double"))
        return F.lit(None).cast("double")

    @property
    def string(self) -> Column:
        match self.kind:
            case "string":
                return self.col
            case "number":
                return number_text(self.col.cast("double"))
            case "boolean":
                return self.col.cast("string")
            case "variant":
                v = paths.variant_value(self.col)
                return F.coalesce(v.string, number_text(v.number), v.boolean.cast("string"), F.when(~v.missing, v.json))
            case "null":
                return F.lit(None).cast("string")
        return F.to_json(self.col)

    @property
    def truth(self) -> Column:
        match self.kind:
            case "boolean":
                t = self.col
            case "number":
                t = self.col != 0
            case "string":
                t = self.col != ""
            case "variant":
                v = paths.variant_value(self.col)
                t = F.when(v.absent, False).otherwise(F.coalesce(v.boolean, v.number != 0, v.string != "", F.lit(True)))
            case "null":
                t = F.lit(False)
            case _:
                t = self.col.isNotNull()
        return F.coalesce(t, F.lit(False))

    @property
    def empty(self) -> Column:
        match self.kind:
            case "boolean":
                t = ~self.col
            case "number":
                t = F.lit(False)
            case "string":
                t = self.col == ""
            case "array":
                t = F.size(self.col) == 0
            case "variant":
                v = paths.variant_value(self.col)
                t = v.absent | F.coalesce(v.string == "", ~v.boolean, v.json.isin("[]", "{}"))
            case "null":
                t = F.lit(True)
            case _:
                t = F.lit(False)
        return F.coalesce(F.when(self.col.isNull(), True).otherwise(t), F.lit(True))


def number_text(n: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("bigint").cast("string")).otherwise(n.cast("string"))


def _text(c: Column) -> Px:
    return Px(c, "string")


def _num(c: Column) -> Px:
    return Px(c, "number")


def _bool(c: Column) -> Px:
    return Px(F.coalesce(c, F.lit(False)), "boolean")


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.StructType, T.MapType)):
        return "object"
    if isinstance(t, T.VariantType):
        return "variant"
    return "null" if isinstance(t, T.NullType) else "string"


def _literal(v: Any) -> Px:
    if v is None:
        return Px(F.lit(None).cast("string"), "null")
    if isinstance(v, bool):
        return Px(F.lit(v), "boolean")
    if isinstance(v, (int, float)):
        return Px(F.lit(float(v)), "number")
    return Px(F.lit(v), "string")


def _same(a: Px, b: Px) -> Column:
    """Equality: both numbers if both read as numbers, else text; null equals null."""
    if "null" in (a.kind, b.kind):
        other = b if a.kind == "null" else a
        return F.lit(True) if other.kind == "null" else other.string.isNull()
    if "boolean" in (a.kind, b.kind) and a.kind == b.kind:
        return F.coalesce(a.col == b.col, F.lit(False))
    if a.kind == b.kind == "string":
        x, y = a.number, b.number
        return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a.string == b.string), F.lit(False))
    if "number" in (a.kind, b.kind):
        return F.coalesce(a.number == b.number, F.lit(False))
    return F.coalesce(a.string == b.string, F.lit(False))


def _if(c: Column, a: Px, b: Px) -> Px:
    if a.kind == b.kind or b.kind == "null":
        return Px(F.when(c, a.col).otherwise(b.col.cast("string") if b.kind == "null" and a.kind == "string" else b.col if a.kind == b.kind else F.lit(None)), a.kind)
    if a.kind == "null":
        return Px(F.when(~c, b.col), b.kind)
    return _text(F.when(c, a.string).otherwise(b.string))


def _contains(h: Px, n: Px) -> Column:
    if h.kind == "array":
        return F.exists(h.col.cast("array<string>"), lambda x: x == n.string)
    if h.kind == "variant":
        v = paths.variant_value(h.col)
        return F.coalesce(F.array_contains(v.strings, n.string), h.string.contains(n.string))
    return h.string.contains(n.string)


def _humps(s: Column, joint: str, drop: str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(s, r"(?<!^)([A-Z])", f"{joint}$1"), f"[ {drop}]", joint))


def camel(s: Column) -> Column:
    parts = F.split(s, r"[_\- ]")
    joined = F.array_join(F.transform(parts, lambda w, i: F.when(i > 0, F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))).otherwise(w)), "")
    return F.concat(F.lower(F.left(joined, F.lit(1))), F.substring(joined, 2, 1 << 30))


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _pad(s: Column, width: Column, fill: Column, left: bool) -> Column:
    need = F.greatest(F.lit(0), width.cast("int") - F.octet_length(s))
    pad = F.repeat(F.left(fill, F.lit(1)), need)
    return F.concat(pad, s) if left else F.concat(s, pad)


_ALIASES = {
    "upper": "uppercase", "lower": "lowercase", "cap": "capitalize", "rev": "reverse", "length": "len", "empty": "is_empty", "fallback": "default", "typeof": "type_of",
    "any_of": "one_of", "in_list": "one_of", "not_in": "none_of", "ternary": "if_else", "cond": "if_else", "first_of": "coalesce", "snake": "snake_case", "camel": "camel_case",
    "kebab": "kebab_case", "trunc": "truncate", "pad_start": "pad_left", "pad_end": "pad_right",
}

_COLUMN_FILTERS: dict[str, Callable[..., Px]] = {
    "uppercase": lambda v: _text(F.upper(v.string)),
    "lowercase": lambda v: _text(F.lower(v.string)),
    "trim": lambda v: _text(strip(v.string)),
    "capitalize": lambda v: _text(capitalize(v.string)),
    "reverse": lambda v: _text(F.reverse(v.string)),
    "len": lambda v: _num(F.octet_length(v.string)) if v.kind != "array" else _num(F.size(v.col)),
    "snake_case": lambda v: _text(_humps(v.string, "_", "-")),
    "kebab_case": lambda v: _text(_humps(v.string, "-", "_")),
    "camel_case": lambda v: _text(camel(v.string)),
    "default": lambda v, x: _text(F.when(F.coalesce(v.string, F.lit("")).isin("", "null", "undefined"), x.string).otherwise(v.string)),
    "truncate": lambda v, n: _text(F.when(F.octet_length(v.string) > n.number, F.left(v.string, n.number.cast("int"))).otherwise(v.string)),
    "replace": lambda v, a, b: _text(F.replace(v.string, a.string, b.string)),
    "split": lambda v, s: _text(F.concat(F.lit('["'), F.array_join(_split(v.string, s.string), '","'), F.lit('"]'))),
    "pad_left": lambda v, w, c=None: _text(_pad(v.string, w.number, c.string if c else F.lit(" "), True)),
    "pad_right": lambda v, w, c=None: _text(_pad(v.string, w.number, c.string if c else F.lit(" "), False)),
    "repeat": lambda v, n: _text(F.repeat(v.string, n.number.cast("int"))),
    "slice": lambda v, a, b=None: _text(F.substr(v.string, a.number.cast("int") + 1, F.greatest(F.lit(0), (b.number if b else F.char_length(v.string)).cast("int") - a.number.cast("int")))),
}


def _split(s: Column, separator: Column) -> Column:
    return F.split(s, F.concat(F.lit(r"\Q"), separator, F.lit(r"\E")))



def _len(v: Px) -> Px:
    match v.kind:
        case "array":
            return _num(F.coalesce(F.size(v.col), F.lit(0)))
        case "null":
            return _num(F.lit(0))
        case "variant":
            x = paths.variant_value(v.col)
            items = F.coalesce(F.size(F.try_variant_get(v.col, "$", "array<variant>")), F.size(F.try_variant_get(v.col, "$", "map<string,variant>")))
            return _num(F.coalesce(F.octet_length(x.string), F.when(x.rank >= 5, items), F.when(x.absent, 0), F.octet_length(v.string)))
    return _num(F.coalesce(F.octet_length(v.string), F.lit(0)))


def _type_of(v: Px) -> Px:
    if v.kind == "variant":
        r = paths.variant_value(v.col).rank
        names = F.array(*map(F.lit, ["null", "null", "boolean", "number", "string", "array", "object"]))
        return _text(F.element_at(names, r + 1))
    return _text(F.when(v.col.isNull(), "null").otherwise(v.kind))


def _extreme(pick, args: tuple[Px, ...]) -> Px:
    nums = [a.number for a in args]
    return _num(nums[0] if len(nums) == 1 else pick(*nums))


def _first_true(args: tuple[Px, ...]) -> Px:
    out = Px(F.lit(None).cast("string"), "null")
    for a in reversed(args):
        out = _if(a.truth, a, out)
    return out


def _any_equal(v: Px, args: tuple[Px, ...]) -> Column:
    if len(args) == 1 and args[0].kind == "array":
        return _contains(args[0], v)
    out = F.lit(False)
    for a in args:
        out = out | F.coalesce(v.string == a.string, F.lit(False))
    return out


_COLUMN_CALLS: dict[str, Callable[..., Px]] = {
    "len": _len,
    "is_empty": lambda v: _bool(v.empty),
    "not_empty": lambda v: _bool(~v.empty),
    "contains": lambda h, n: _bool(_contains(h, n)),
    "starts_with": lambda a, b: _bool(a.string.startswith(b.string)),
    "ends_with": lambda a, b: _bool(a.string.endswith(b.string)),
    "trim": _COLUMN_FILTERS["trim"], "uppercase": _COLUMN_FILTERS["uppercase"], "lowercase": _COLUMN_FILTERS["lowercase"],
    "capitalize": _COLUMN_FILTERS["capitalize"], "reverse": _COLUMN_FILTERS["reverse"],
    "default": lambda v, f: _if(v.truth, v, f),
    "type_of": _type_of,
    "one_of": lambda v, *a: _bool(_any_equal(v, a)),
    "none_of": lambda v, *a: _bool(~_any_equal(v, a)),
    "if_else": lambda c, a, b: _if(c.truth, a, b),
    "coalesce": lambda *a: _first_true(a),
    "min": lambda *a: _extreme(F.least, a),
    "max": lambda *a: _extreme(F.greatest, a),
    "abs": lambda v: _num(F.abs(v.number)),
    "clamp": lambda v, lo, hi: _num(F.least(F.greatest(v.number, lo.number), hi.number)),
}


def _arithmetic(op: str, a: Px, b: Px) -> Px:
    if op == "+" and {a.kind, b.kind} <= {"string", "variant"}:
        # joined if both are texts, else added
        s, t = (paths.variant_value(p.col).string if p.kind == "variant" else p.col for p in (a, b))
        if a.kind == b.kind == "string":
            return _text(F.concat(s, t))
        return _text(F.when(s.isNotNull() & t.isNotNull(), F.concat(s, t)).otherwise(number_text(a.number + b.number)))
    x, y = a.number, b.number
    match op:
        case "+":
            return _num(x + y)
        case "-":
            return _num(x - y)
        case "*":
            return _num(x * y)
        case "/":
            return _num(x / F.nullif(y, F.lit(0.0)))
    return _num(x % F.nullif(y, F.lit(0.0)))


class Scope:
    """Resolves paths: local bindings first, then the columns of a table."""

    def __init__(self, df: DataFrame, root: str | None = None, local: Mapping[str, Px] | None = None):
        self.df, self.root, self.local = df, root, dict(local or {})
        self.schema = df.schema[root].dataType if root else df.schema

    def bind(self, more: Mapping[str, Px]) -> "Scope":
        return Scope(self.df, self.root, {**self.local, **more})

    def path(self, parts: tuple[str | int, ...]) -> Px:
        if parts[0] in self.local:
            at, rest = self.local[parts[0]], parts[1:]
            kind: T.DataType | None = None
            return self._walk(at.col, at.kind, kind, rest)
        if isinstance(self.schema, T.VariantType):
            steps = "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in parts)
            return Px(F.try_variant_get(F.col(self.root), "$" + steps, "variant"), "variant")
        if parts[0] not in self.schema.names:
            return Px(F.lit(None).cast("string"), "null")
        kind = self.schema[parts[0]].dataType
        col = F.col(self.root)[parts[0]] if self.root else F.col(f"`{parts[0]}`")
        return self._walk(col, _kind(kind), kind, parts[1:])

    def _walk(self, col: Column, kind: str, t: T.DataType | None, rest: tuple) -> Px:
        for k, p in enumerate(rest):
            if kind == "variant":
                steps = "".join(f"[{q}]" if isinstance(q, int) else f"['{q}']" for q in rest[k:])
                return Px(F.try_variant_get(col, "$" + steps, "variant"), "variant")
            if isinstance(t, T.StructType) and p in t.names:
                col, t = col.getField(p), t[p].dataType
            elif isinstance(t, T.ArrayType) and isinstance(p, int):
                col, t = F.get(col, F.lit(p)), t.elementType
            elif isinstance(t, T.MapType):
                col, t = F.try_element_at(col, F.lit(p)), t.valueType
            else:
                return Px(F.lit(None).cast("string"), "null")
            kind = _kind(t)
        return Px(col, kind)


def _pattern(p: tuple, v: Px, scope: Scope, t: T.DataType | None) -> tuple[Column, dict[str, Px]]:
    match p[0]:
        case "any":
            return F.lit(True), {}
        case "bind":
            return F.lit(True), {p[1]: v}
        case "equal":
            return _same(v, _literal(p[1])), {}
        case "range":
            n = v.number
            high = n <= float(p[2]) if p[3] else n < float(p[2])
            return F.coalesce((n >= float(p[1])) & high, F.lit(False)), {}
        case "tuple":
            if v.kind not in ("array", "variant"):
                return F.lit(False), {}
            items = v.col if v.kind == "array" else F.try_variant_get(v.col, "$", "array<variant>")
            inner = t.elementType if isinstance(t, T.ArrayType) else T.VariantType()
            hit, found = F.coalesce(F.size(items) == len(p[1]), F.lit(False)), {}
            for i, q in enumerate(p[1]):
                h, b = _pattern(q, Px(F.get(items, F.lit(i)), _kind(inner)), scope, inner)
                hit, found = hit & h, found | b
            return hit, found
        case "struct":
            hit, found = F.lit(v.kind in ("object", "variant")), {}
            for name, q in p[1]:
                if v.kind == "variant":
                    at, inner = F.try_variant_get(v.col, f"$['{name}']", "variant"), T.VariantType()
                elif isinstance(t, T.StructType) and name in t.names:
                    at, inner = v.col.getField(name), t[name].dataType
                else:
                    return F.lit(False), {}
                h, b = _pattern(q, Px(at, _kind(inner)), scope, inner)
                hit, found = hit & at.isNotNull() & h, found | b
            return hit, found
    raise PxError(f"unknown pattern {p!r}")


def _type_at(e: tuple, scope: Scope) -> T.DataType | None:
    if e[0] != "path" or e[1][0] in scope.local or not isinstance(scope.schema, T.StructType):
        return None
    t: T.DataType | None = scope.schema
    for p in e[1]:
        if isinstance(t, T.StructType) and p in t.names:
            t = t[p].dataType
        elif isinstance(t, T.ArrayType):
            t = t.elementType
        else:
            return None
    return t


def to_column(e: tuple, scope: Scope) -> Px:
    """Compiles a parsed expression over the columns of a scope."""
    go = lambda x: to_column(x, scope)
    match e[0]:
        case "value":
            return _literal(e[1])
        case "list":
            return Px(F.array(*[go(x).string for x in e[1]]), "array")
        case "path":
            return scope.path(e[1])
        case "call" | "filter":
            name = _ALIASES.get(e[1], e[1])
            table, args = (_COLUMN_CALLS, e[2]) if e[0] == "call" else (_COLUMN_FILTERS, (e[2], *e[3]))
            if name not in table:
                raise PxError(f"unknown {'function' if e[0] == 'call' else 'filter'} {e[1]!r}")
            return table[name](*map(go, args))
        case "if":
            return _if(go(e[1]).truth, go(e[2]), go(e[3]))
        case "or":
            return _bool(go(e[1]).truth | go(e[2]).truth)
        case "and":
            return _bool(go(e[1]).truth & go(e[2]).truth)
        case "not":
            return _bool(~go(e[1]).truth)
        case "neg":
            return _num(-go(e[1]).number)
        case "==":
            return _bool(_same(go(e[1]), go(e[2])))
        case "!=":
            return _bool(~_same(go(e[1]), go(e[2])))
        case ">" | ">=" | "<" | "<=":
            a, b = go(e[1]).number, go(e[2]).number
            return _bool({">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[e[0]])
        case "contains":
            return _bool(_contains(go(e[1]), go(e[2])))
        case "in":
            return _bool(_contains(go(e[2]), go(e[1])))
        case "matches":
            return _bool(F.rlike(go(e[1]).string, go(e[2]).string))
        case "starts_with":
            return _bool(go(e[1]).string.startswith(go(e[2]).string))
        case "ends_with":
            return _bool(go(e[1]).string.endswith(go(e[2]).string))
        case "+" | "-" | "*" | "/" | "%":
            return _arithmetic(e[0], go(e[1]), go(e[2]))
        case "match":
            subject, t, out = go(e[1]), _type_at(e[1], scope), Px(F.lit(None).cast("string"), "null")
            for alternatives, guard, result in reversed(e[2]):
                for p in reversed(alternatives):
                    hit, found = _pattern(p, subject, scope, t)
                    inner = scope.bind(found)
                    if guard is not None:
                        hit = hit & to_column(guard, inner).truth
                    out = _if(hit, to_column(result, inner), out)
            return out
    raise PxError(f"unknown expression {e!r}")


def column(df: DataFrame, text: str, root: str | None = None) -> Column:
    """The column of an expression over a table's columns (or the fields of ``root``)."""
    return to_column(parse(text), Scope(df, root)).col


def condition(df: DataFrame, text: str, root: str | None = None) -> Column:
    return to_column(parse(text), Scope(df, root)).truth


_HOLE = re.compile(r"\$\{([^}]*)\}")


def interpolate(df: DataFrame, template: str, root: str | None = None) -> Column:
    """A template's text with ``${expression}`` filled in; what cannot be resolved stays as it is."""
    parts, at = [], 0
    for m in _HOLE.finditer(template):
        parts += [F.lit(template[at : m.start()])]
        try:
            parts += [F.coalesce(to_column(parse(m[1]), Scope(df, root)).string, F.lit(m[0]))]
        except PxError:
            parts += [F.lit(m[0])]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


# ---------------------------------------------------------------------------- Python


def as_number(v: Any) -> float | None:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v)
    if isinstance(v, str):
        try:
            return float(v)
        except ValueError:
            return None
    return None


def as_text(v: Any) -> str | None:
    import json

    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(int(v)) if float(v).is_integer() else repr(float(v))
    return json.dumps(v, separators=(",", ":"))


def truthy(v: Any) -> bool:
    if isinstance(v, bool):
        return v
    return v is not None and v != "" and not (isinstance(v, (int, float)) and v == 0)


def _py_len(v: Any) -> int:
    return 0 if v is None else len(v) if isinstance(v, (list, dict)) else len(as_text(v).encode())


def _py_empty(v: Any) -> bool:
    return not v if isinstance(v, bool) else v is None or v == "" or isinstance(v, (list, dict)) and not v


def _py_same(a: Any, b: Any) -> bool:
    if a is None or b is None:
        return a is b
    x, y = as_number(a), as_number(b)
    if x is not None and y is not None and not (isinstance(a, bool) and isinstance(b, str)):
        return x == y
    return as_text(a) == as_text(b)


def _py_contains(h: Any, n: Any) -> bool:
    return any(as_text(x) == as_text(n) for x in h) if isinstance(h, list) else as_text(n) in (as_text(h) or "") if n is not None else False


def _py_nums(args) -> list[float]:
    return [n for n in map(as_number, args) if n is not None]


_PY_CALLS: dict[str, Callable] = {
    "len": _py_len, "is_empty": _py_empty, "not_empty": lambda v: not _py_empty(v), "contains": _py_contains,
    "starts_with": lambda a, b: (as_text(a) or "").startswith(as_text(b)), "ends_with": lambda a, b: (as_text(a) or "").endswith(as_text(b)),
    "trim": lambda v: as_text(v).strip(), "uppercase": lambda v: as_text(v).upper(), "lowercase": lambda v: as_text(v).lower(),
    "capitalize": lambda v: as_text(v)[:1].upper() + as_text(v)[1:], "reverse": lambda v: as_text(v)[::-1], "default": lambda v, f: v if truthy(v) else f,
    "type_of": lambda v: "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object",
    "one_of": lambda v, *a: any(as_text(v) == as_text(x) for x in (a[0] if len(a) == 1 and isinstance(a[0], list) else a)),
    "none_of": lambda v, *a: not _PY_CALLS["one_of"](v, *a), "if_else": lambda c, a, b: a if truthy(c) else b,
    "coalesce": lambda *a: next((x for x in a if truthy(x)), None), "min": lambda *a: min(_py_nums(a), default=None), "max": lambda *a: max(_py_nums(a), default=None),
    "abs": lambda v: abs(as_number(v)), "clamp": lambda v, lo, hi: min(max(as_number(v), as_number(lo)), as_number(hi)),
}


def _py_humps(s: str, joint: str, drop: str) -> str:
    return re.sub(f"[ {drop}]", joint, re.sub(r"(?<!^)([A-Z])", rf"{joint}\1", s)).lower()


def _py_camel(s: str) -> str:
    parts = re.split(r"[_\- ]", s)
    out = parts[0] + "".join(p[:1].upper() + p[1:] for p in parts[1:])
    return out[:1].lower() + out[1:]


def _py_pad(s: str, width, fill, left: bool) -> str:
    pad = (as_text(fill) or " ")[:1] * max(0, int(as_number(width)) - len(s.encode()))
    return pad + s if left else s + pad


_PY_FILTERS: dict[str, Callable] = {
    "uppercase": str.upper, "lowercase": str.lower, "trim": str.strip, "capitalize": _PY_CALLS["capitalize"], "reverse": lambda s: s[::-1], "len": lambda s: len(s.encode()),
    "snake_case": lambda s: _py_humps(s, "_", "-"), "kebab_case": lambda s: _py_humps(s, "-", "_"), "camel_case": _py_camel,
    "default": lambda s, x: as_text(x) if s in ("", "null", "undefined") else s, "truncate": lambda s, n: s[: int(n)] if len(s.encode()) > n else s,
    "replace": lambda s, a, b: s.replace(as_text(a), as_text(b)), "split": lambda s, sep: '["' + '","'.join(s.split(as_text(sep))) + '"]',
    "pad_left": lambda s, w, c=" ": _py_pad(s, w, c, True), "pad_right": lambda s, w, c=" ": _py_pad(s, w, c, False), "repeat": lambda s, n: s * int(n),
    "slice": lambda s, a, b=None: s[int(a) : None if b is None else int(b)],
}


def _py_pattern(p: tuple, v: Any, found: dict) -> bool:
    match p[0]:
        case "any":
            return True
        case "bind":
            found[p[1]] = v
            return True
        case "equal":
            return _py_same(v, p[1])
        case "range":
            n = as_number(v)
            return n is not None and p[1] <= n and (n <= p[2] if p[3] else n < p[2])
        case "tuple":
            return isinstance(v, list) and len(v) == len(p[1]) and all(_py_pattern(q, x, found) for q, x in zip(p[1], v))
        case "struct":
            return isinstance(v, dict) and all(k in v and _py_pattern(q, v[k], found) for k, q in p[1])
    raise PxError(f"unknown pattern {p!r}")


def evaluate(e: tuple | str, env: Mapping[str, Any]) -> Any:
    """The value of an expression over a variable map."""
    if isinstance(e, str):
        e = parse(e)
    go = lambda x: evaluate(x, env)
    match e[0]:
        case "value":
            return e[1]
        case "list":
            return [go(x) for x in e[1]]
        case "path":
            v: Any = env
            for p in e[1]:
                if isinstance(v, Mapping) and p in v or isinstance(v, list) and isinstance(p, int) and p < len(v):
                    v = v[p]
                else:
                    return None
            return v
        case "call" | "filter":
            name = _ALIASES.get(e[1], e[1])
            table, args = (_PY_CALLS, [go(x) for x in e[2]]) if e[0] == "call" else (_PY_FILTERS, [as_text(go(e[2])) or "", *[go(x) for x in e[3]]])
            if name not in table:
                raise PxError(f"unknown {'function' if e[0] == 'call' else 'filter'} {e[1]!r}")
            return table[name](*args)
        case "if":
            return go(e[2]) if truthy(go(e[1])) else go(e[3])
        case "or":
            return truthy(go(e[1])) or truthy(go(e[2]))
        case "and":
            return truthy(go(e[1])) and truthy(go(e[2]))
        case "not":
            return not truthy(go(e[1]))
        case "neg":
            n = as_number(go(e[1]))
            return None if n is None else -n
        case "==":
            return _py_same(go(e[1]), go(e[2]))
        case "!=":
            return not _py_same(go(e[1]), go(e[2]))
        case ">" | ">=" | "<" | "<=":
            a, b = as_number(go(e[1])), as_number(go(e[2]))
            return a is not None and b is not None and {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[e[0]]
        case "contains":
            return _py_contains(go(e[1]), go(e[2]))
        case "in":
            return _py_contains(go(e[2]), go(e[1]))
        case "matches":
            try:
                return re.search(as_text(go(e[2])) or "", as_text(go(e[1])) or "") is not None
            except re.error:
                return False
        case "starts_with" | "ends_with":
            return _PY_CALLS[e[0]](go(e[1]), go(e[2]))
        case "+" | "-" | "*" | "/" | "%":
            x, y = go(e[1]), go(e[2])
            if e[0] == "+" and isinstance(x, str) and isinstance(y, str):
                return x + y
            a, b = as_number(x), as_number(y)
            if a is None or b is None or e[0] in "/%" and b == 0:
                return None
            import math

            r = a + b if e[0] == "+" else a - b if e[0] == "-" else a * b if e[0] == "*" else a / b if e[0] == "/" else math.fmod(a, b)
            return int(r) if float(r).is_integer() else r
        case "match":
            subject = go(e[1])
            for alternatives, guard, result in e[2]:
                for p in alternatives:
                    found: dict = {}
                    if _py_pattern(p, subject, found):
                        inner = {**env, **found}
                        if guard is None or truthy(evaluate(guard, inner)):
                            return evaluate(result, inner)
            return None
    raise PxError(f"unknown expression {e!r}")
