"""The text form of pipelines: ``filter(a == 1) |> sort(by: "a") |> limit(5)``.

A tokenizer feeds a recursive-descent parser. Steps take positional and ``key: value`` arguments; a
table per step says which keys there are and what they may hold.
"""

from __future__ import annotations

import json
import re
from typing import Any

from quern.plans import ir
from quern.plans.ir import QueryError

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<pipe>\|>)
    | (?P<op>==|!=|>=|<=|>|<)
    | (?P<string>"(?:[^"\\]|\\["\\ntrbf]|\\u[0-9a-fA-F]{4})*")
    | (?P<number>-?\d+(?:\.\d+)?)
    | (?P<name>[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z][A-Za-z0-9_]*)*)
    | (?P<mark>[()\[\],:])
    )""",
    re.X,
)

#: Keys of each step: name in the text -> (field, type).
_KEYS: dict[str, dict[str, tuple[str, type]]] = {
    "sort": {"by": ("by", str), "dir": ("dir", str), "after": ("after", str)},
    "aggregate": {"field": ("field", str)},
    "graph_clusters": {"algorithm": ("algorithm", str), "min_size": ("min_size", int), "min_strength": ("min_strength", float)},
    "graph_path": {"from": ("src", str), "to": ("dst", str), "max_hops": ("max_hops", int)},
    "graph_pagerank": {"damping": ("damping", float), "iterations": ("iterations", int)},
    "graph_stats": {},
    "graph_neighbors": {"depth": ("depth", int), "min_strength": ("min_strength", float), "type": ("type", str), "bidirectional": ("bidirectional", bool)},
    "graph_links": {"from": ("src", str), "to": ("dst", str), "min_strength": ("min_strength", float), "type": ("type", str)},
    "auto_link": {"algorithms": ("algorithms", list), "min_strength": ("min_strength", float)},
    "chronicle_trace": {"max_depth": ("max_depth", int), "direction": ("direction", str)},
    "vector_search": {"limit": ("limit", int), "min_score": ("min_score", float), "category": ("category", str), "prefilter": ("prefilter", bool)},
    "text_search": {"limit": ("limit", int), "field": ("field", str)},
    "transform": {"format": ("format", str), "max_chars": ("max_chars", int)},
    "assign": {"name": ("name", str)},
    "emit": {"label": ("label", str), "from": ("source", str)},
}
#: Steps whose first argument is a bare string, and its field.
_FIRST = {"graph_neighbors": "root", "vector_search": "query", "text_search": "query", "chronicle_trace": "root"}
_KIND = {op: kind for kind, op in ir.OPS.items()}


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"cannot read the query at {at}: {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, value: str | None = None, kind: str | None = None, ahead: int = 0) -> bool:
        if self.at + ahead >= len(self.tokens):
            return False
        k, v, _ = self.tokens[self.at + ahead]
        return (value is None or v == value) and (kind is None or k == kind)

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        if not self.peek(value, kind):
            got = f"{self.tokens[self.at][1]!r} at {self.tokens[self.at][2]}" if self.at < len(self.tokens) else "the end"
            raise QueryError(f"expected {value or kind}, got {got}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def query(self) -> list[ir.Step]:
        steps = [self.step()]
        while self.peek("|>"):
            self.take()
            steps.append(self.step())
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.tokens[self.at][1]!r} at {self.tokens[self.at][2]}")
        return steps

    def literal(self) -> Any:
        if self.peek(kind="string"):
            return json.loads(self.take(), strict=False)
        if self.peek(kind="number"):
            t = self.take()
            return float(t) if "." in t else int(t)
        word = self.take(kind="name")
        if word not in ("true", "false", "null"):
            raise QueryError(f"{word!r} is not a value")
        return {"true": True, "false": False, "null": None}[word]

    def strings(self) -> list[str]:
        self.take("[")
        out = []
        while not self.peek("]"):
            if out:
                self.take(",")
            out.append(json.loads(self.take(kind="string"), strict=False))
        self.take("]")
        return out

    def step(self) -> ir.Step:
        name = self.take(kind="name")
        self.take("(")
        step = self.body(name)
        self.take(")")
        return step

    def body(self, name: str) -> ir.Step:
        if name == "filter":
            return ir.Filter(self.predicate())
        if name == "conditional":
            return self.conditional()
        if name in ("limit", "skip"):
            n = self.literal()
            if not isinstance(n, int) or isinstance(n, bool) or n < 0:
                raise QueryError(f"{name} takes a whole number")
            return (ir.Limit if name == "limit" else ir.Skip)(n)
        if name == "project":
            return ir.Project(tuple(map(ir.FieldSpec, self.strings())))
        if name == "mutate":
            return self.mutate()
        if name not in _KEYS:
            raise QueryError(f"unknown step {name!r}")
        args: dict[str, Any] = {}
        if name == "aggregate":
            args["fn"] = self.take(kind="name")
        elif name in _FIRST:
            args[_FIRST[name]] = json.loads(self.take(kind="string"), strict=False)
        args |= self.keys(name, bool(args))
        try:
            return _KIND[name](**args)
        except TypeError as e:
            raise QueryError(f"{name}: {e}") from None

    def keys(self, name: str, more: bool) -> dict[str, Any]:
        args: dict[str, Any] = {}
        while not self.peek(")"):
            if more:
                self.take(",")
            more = True
            key = self.take(kind="name")
            if key not in _KEYS[name]:
                raise QueryError(f"{name} does not take {key!r}")
            self.take(":")
            field, kind = _KEYS[name][key]
            v = tuple(self.strings()) if kind is list else self.literal()
            if kind is float and isinstance(v, int) and not isinstance(v, bool):
                v = float(v)
            if kind is not list and (not isinstance(v, kind) or kind is int and isinstance(v, bool)):
                raise QueryError(f"{name}: {key} must be of type {kind.__name__}")
            args[field] = v
        return args

    def conditional(self) -> ir.Step:
        predicate, branches = self.predicate(), {}
        while self.peek(","):
            self.take()
            key = self.take(kind="name")
            if key not in ("then", "else") or key in branches:
                raise QueryError(f"conditional does not take {key!r}")
            self.take(":")
            self.take("[")
            steps: list[ir.Step] = []
            while not self.peek("]"):
                if steps:
                    self.take(",")
                steps.append(self.step())
            self.take("]")
            branches[key] = tuple(steps)
        return ir.Conditional(predicate, branches.get("then", ()), branches.get("else", ()))

    def mutate(self) -> ir.Step:
        op, args = self.take(kind="name"), {}
        while self.peek(","):
            self.take()
            key = self.take(kind="name")
            self.take(":")
            args[key] = self.literal()
        data = args.pop("data", args.pop("patch", None))
        if isinstance(data, str):  # objects come as JSON text
            try:
                data = json.loads(data)
            except json.JSONDecodeError:
                pass
        atomic = args.pop("atomic", False)
        known = {"id": "id", "from": "src", "to": "dst", "label": "label"}
        if set(args) - set(known):
            raise QueryError(f"mutate does not take {sorted(set(args) - set(known))}")
        return ir.Mutate((ir.MutateOp(op, data=data, **{known[k]: v for k, v in args.items()}),), atomic)

    def predicate(self) -> ir.Predicate:
        parts = [self.conjunction()]
        while self.peek("or", "name"):
            self.take()
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else ir.Or(tuple(parts))

    def conjunction(self) -> ir.Predicate:
        parts = [self.negation()]
        while self.peek("and", "name"):
            self.take()
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else ir.And(tuple(parts))

    def negation(self) -> ir.Predicate:
        if self.peek("not", "name"):
            self.take()
            return ir.Not(self.atom())
        return self.atom()

    def atom(self) -> ir.Predicate:
        if self.peek("("):
            self.take()
            p = self.predicate()
            self.take(")")
            return p
        path = self.take(kind="name")
        if self.peek(kind="op") or any(self.peek(w, "name") for w in ("contains", "starts_with", "matches")):
            return ir.Compare(path, self.take(), self.literal())
        raise QueryError(f"expected a comparison after {path!r}")


def parse(text: str) -> list[ir.Step]:
    """Steps of a query text."""
    if not text.strip():
        raise QueryError("the query is empty")
    return _Parser(text).query()


def parse_predicate(text: str) -> ir.Predicate:
    p = _Parser(text)
    out = p.predicate()
    if p.at < len(p.tokens):
        raise QueryError(f"unexpected {p.tokens[p.at][1]!r}")
    return out
