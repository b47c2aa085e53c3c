"""Steps of a pipeline as plain data, with their JSON form."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, is_dataclass
from typing import Any

Literal = str | float | int | bool | None


class QueryError(ValueError):
    """A query that cannot be read or run."""


# ---------------------------------------------------------------------------- predicates

COMPARISONS = ("==", "!=", ">=", "<=", ">", "<", "contains", "starts_with", "matches")


@dataclass(frozen=True)
class Predicate:
    def __and__(self, other: "Predicate") -> "Predicate":
        return And((self, other))

    def __or__(self, other: "Predicate") -> "Predicate":
        return Or((self, other))

    def __invert__(self) -> "Predicate":
        return Not(self)


@dataclass(frozen=True)
class Compare(Predicate):
    field: str
    op: str
    value: Literal
    regex: bool = False

    def __post_init__(self):
        if self.op not in COMPARISONS:
            raise QueryError(f"unknown comparison {self.op!r}")


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


class Field:
    """``P("a.b") == "x"`` and the like build predicates."""

    def __init__(self, path: str):
        self.path = path

    def __eq__(self, v):  # type: ignore[override]
        return Compare(self.path, "==", v)

    def __ne__(self, v):  # type: ignore[override]
        return Compare(self.path, "!=", v)

    def __gt__(self, v):
        return Compare(self.path, ">", v)

    def __ge__(self, v):
        return Compare(self.path, ">=", v)

    def __lt__(self, v):
        return Compare(self.path, "<", v)

    def __le__(self, v):
        return Compare(self.path, "<=", v)

    def contains(self, v: str):
        return Compare(self.path, "contains", v)

    def starts_with(self, v: str):
        return Compare(self.path, "starts_with", v)

    def matches(self, v: str, regex: bool = False):
        return Compare(self.path, "matches", v, regex)

    __hash__ = None  # type: ignore[assignment]


P = Field


# ---------------------------------------------------------------------------- steps


@dataclass(frozen=True)
class Step:
    pass


@dataclass(frozen=True)
class Filter(Step):
    predicate: Predicate


@dataclass(frozen=True)
class Sort(Step):
    by: str
    dir: str = "asc"
    after: str | None = None

    def __post_init__(self):
        if self.dir not in ("asc", "desc"):
            raise QueryError(f"unknown sort direction {self.dir!r}")


@dataclass(frozen=True)
class Limit(Step):
    n: int

    def __post_init__(self):
        if not 0 <= self.n < 1 << 63:
            raise QueryError("limit is out of range")


@dataclass(frozen=True)
class Skip(Step):
    n: int


@dataclass(frozen=True)
class FieldSpec:
    path: str
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.path.rsplit(".", 1)[-1]


@dataclass(frozen=True)
class Project(Step):
    specs: tuple[FieldSpec, ...]


AGGREGATES = ("count", "sum", "avg", "min", "max", "distinct", "collect")


@dataclass(frozen=True)
class Aggregate(Step):
    fn: str
    field: str | None = None

    def __post_init__(self):
        if self.fn not in AGGREGATES:
            raise QueryError(f"unknown aggregate {self.fn!r}")


@dataclass(frozen=True)
class MutateOp:
    op: str  # put, delete, merge, put_edge, delete_edge
    id: str | None = None
    data: Any = None
    src: str | None = None
    dst: str | None = None
    label: str = ""

    def __post_init__(self):
        need = ("src", "dst") if self.op.endswith("_edge") else ("id",)
        if self.op not in ("put", "delete", "merge", "put_edge", "delete_edge"):
            raise QueryError(f"unknown mutation {self.op!r}")
        for n in need:
            if not getattr(self, n):
                raise QueryError(f"{self.op} needs {n}")


@dataclass(frozen=True)
class Mutate(Step):
    ops: tuple[MutateOp, ...]
    atomic: bool = False


@dataclass(frozen=True)
class GraphLinks(Step):
    src: str | None = None
    dst: str | None = None
    min_strength: float | None = None
    type: str | None = None


@dataclass(frozen=True)
class GraphNeighbors(Step):
    root: str
    depth: int = 1
    min_strength: float | None = None
    type: str | None = None
    bidirectional: bool = False


@dataclass(frozen=True)
class GraphPath(Step):
    src: str
    dst: str
    max_hops: int = 10


@dataclass(frozen=True)
class GraphPageRank(Step):
    damping: float = 0.85
    iterations: int = 100

    def __post_init__(self):
        if not 0 < self.damping < 1:
            raise QueryError("damping must lie between 0 and 1")


@dataclass(frozen=True)
class GraphClusters(Step):
    algorithm: str
    min_size: int = 2
    min_strength: float | None = None

    def __post_init__(self):
        if self.algorithm not in ("louvain", "semantic", "temporal"):
            raise QueryError(f"unknown clustering {self.algorithm!r}")
        if self.min_strength is not None and self.min_strength < 0:
            raise QueryError("min_strength must not be negative")


@dataclass(frozen=True)
class GraphStats(Step):
    pass


@dataclass(frozen=True)
class AutoLink(Step):
    algorithms: tuple[str, ...] = ("semantic", "category", "temporal")
    min_strength: float = 0.5


@dataclass(frozen=True)
class ChronicleTrace(Step):
    root: str
    max_depth: int = 50
    direction: str = "backward"

    def __post_init__(self):
        if self.direction not in ("backward", "forward", "both"):
            raise QueryError(f"unknown direction {self.direction!r}")


@dataclass(frozen=True)
class VectorSearch(Step):
    query: str
    limit: int = 10
    min_score: float = 0.0
    category: str | None = None
    prefilter: bool = False


@dataclass(frozen=True)
class TextSearch(Step):
    query: str
    limit: int = 10
    field: str = "text"


@dataclass(frozen=True)
class Transform(Step):
    format: str
    max_chars: int = 0

    def __post_init__(self):
        if self.format not in ("structured", "fused", "toon"):
            raise QueryError(f"unknown format {self.format!r}")


@dataclass(frozen=True)
class Conditional(Step):
    predicate: Predicate
    then: tuple[Step, ...] = ()
    otherwise: tuple[Step, ...] = ()

    def __post_init__(self):
        for s in (*self.then, *self.otherwise):
            if not isinstance(s, (Filter, Sort, Limit, Project, Transform, Assign, Emit)):
                raise QueryError(f"{OPS[type(s)]} is not allowed in a branch")


@dataclass(frozen=True)
class Assign(Step):
    name: str


@dataclass(frozen=True)
class Emit(Step):
    label: str
    source: str | None = None


OPS: dict[type, str] = {
    Filter: "filter", Sort: "sort", Limit: "limit", Skip: "skip", Project: "project", Aggregate: "aggregate", Mutate: "mutate",
    GraphLinks: "graph_links", GraphNeighbors: "graph_neighbors", GraphPath: "graph_path", GraphPageRank: "graph_pagerank",
    GraphClusters: "graph_clusters", GraphStats: "graph_stats", AutoLink: "auto_link", ChronicleTrace: "chronicle_trace",
    VectorSearch: "vector_search", TextSearch: "text_search", Transform: "transform", Conditional: "conditional", Assign: "assign", Emit: "emit",
}
_BY_OP = {v: k for k, v in OPS.items()}
#: Field names that JSON spells differently.
_JSON_NAMES = {"src": "from", "dst": "to", "otherwise": "else", "source": "from", "alias": "as"}


def predicate_to_json(p: Predicate) -> dict:
    match p:
        case Compare():
            return {"field": p.field, "cmp": p.op, "value": p.value} | ({"regex": True} if p.regex else {})
        case And():
            return {"and": [predicate_to_json(x) for x in p.parts]}
        case Or():
            return {"or": [predicate_to_json(x) for x in p.parts]}
        case Not():
            return {"not": predicate_to_json(p.part)}
    raise QueryError("not a predicate")


def predicate_from_json(j: dict) -> Predicate:
    if "and" in j:
        return And(tuple(map(predicate_from_json, j["and"])))
    if "or" in j:
        return Or(tuple(map(predicate_from_json, j["or"])))
    if "not" in j:
        return Not(predicate_from_json(j["not"]))
    try:
        return Compare(j["field"], j["cmp"], j["value"], j.get("regex", False))
    except KeyError as e:
        raise QueryError(f"a predicate lacks {e}") from None


def _out(v: Any) -> Any:
    if isinstance(v, Predicate):
        return predicate_to_json(v)
    if isinstance(v, Step):
        return to_json(v)
    if isinstance(v, tuple):
        return [_out(x) for x in v]
    if is_dataclass(v):
        return {_JSON_NAMES.get(k, k): x for k, x in asdict(v).items() if x is not None}
    return v


def to_json(step: Step) -> dict:
    body = {_JSON_NAMES.get(f.name, f.name): _out(getattr(step, f.name)) for f in fields(step) if getattr(step, f.name) is not None}
    return {"op": OPS[type(step)]} | body


def from_json(j: dict) -> Step:
    kind = _BY_OP.get(j.get("op", ""))
    if kind is None:
        raise QueryError(f"unknown step {j.get('op')!r}")
    args = {}
    for f in fields(kind):
        name = _JSON_NAMES.get(f.name, f.name)
        if name not in j:
            continue
        v = j[name]
        if f.name == "predicate":
            v = predicate_from_json(v)
        elif f.name in ("then", "otherwise"):
            v = tuple(map(from_json, v))
        elif f.name == "specs":
            v = tuple(FieldSpec(x) if isinstance(x, str) else FieldSpec(x["path"], x.get("as")) for x in v)
        elif f.name == "ops":
            v = tuple(MutateOp(**{{"from": "src", "to": "dst"}.get(k, k): x for k, x in o.items()}) for o in v)
        elif isinstance(v, list):
            v = tuple(v)
        args[f.name] = v
    unknown = set(j) - {"op"} - {_JSON_NAMES.get(f.name, f.name) for f in fields(kind)}
    if unknown:
        raise QueryError(f"{j['op']} does not take {sorted(unknown)}")
    try:
        return kind(**args)
    except TypeError as e:
        raise QueryError(str(e)) from None


def dumps(steps: list[Step]) -> str:
    return json.dumps([to_json(s) for s in steps])


def loads(text: str) -> list[Step]:
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise QueryError(str(e)) from None
    if not isinstance(found, list):
        raise QueryError("a pipeline is a list of steps")
    return [from_json(j) for j in found]
