"""Constraints over actions: condition trees compiled to columns, evaluated in one pass over the actions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import paths
from quern.operators.relational import equals


class Condition:
    """A tree over an action: action_type, session_type and metadata fields."""

    def column(self, df: DataFrame) -> Column:
        raise NotImplementedError


def _meta(df: DataFrame, name: str) -> paths.Value:
    return paths.bind(df, "metadata").value(name)


@dataclass(frozen=True)
class Always(Condition):
    def column(self, df):
        return F.lit(True)


@dataclass(frozen=True)
class ActionTypeEq(Condition):
    value: str

    def column(self, df):
        return F.coalesce(F.col("action_type") == self.value, F.lit(False))


@dataclass(frozen=True)
class ActionStartsWith(Condition):
    prefix: str

    def column(self, df):
        return F.coalesce(F.col("action_type").startswith(self.prefix), F.lit(False))


@dataclass(frozen=True)
class SessionIs(Condition):
    session: str

    def column(self, df):
        return F.coalesce(F.col("session_type") == self.session, F.lit(False))


@dataclass(frozen=True)
class FieldExists(Condition):
    field: str

    def column(self, df):
        return ~_meta(df, self.field).missing


@dataclass(frozen=True)
class FieldEq(Condition):
    field: str
    value: Any

    def column(self, df):
        v = _meta(df, self.field)
        return ~v.missing & equals(v, self.value)


@dataclass(frozen=True)
class FieldGt(Condition):
    field: str
    threshold: float

    def column(self, df):
        return F.coalesce(_meta(df, self.field).number > float(self.threshold), F.lit(False))


@dataclass(frozen=True)
class FieldLt(Condition):
    field: str
    threshold: float

    def column(self, df):
        return F.coalesce(_meta(df, self.field).number < float(self.threshold), F.lit(False))


@dataclass(frozen=True)
class All(Condition):
    conditions: tuple[Condition, ...]

    def column(self, df):
        return reduce(lambda a, b: a & b, (c.column(df) for c in self.conditions), F.lit(True))


@dataclass(frozen=True)
class AnyOf(Condition):
    conditions: tuple[Condition, ...]

    def column(self, df):
        return reduce(lambda a, b: a | b, (c.column(df) for c in self.conditions), F.lit(False))


@dataclass(frozen=True)
class Not(Condition):
    condition: Condition

    def column(self, df):
        return ~self.condition.column(df)


@dataclass(frozen=True)
class Constraint:
    id: str
    when: Condition
    require: Condition
    severity: str = "error"
    description: str = ""
    fix: str = ""
    evidence: tuple[str, ...] = field(default=())


# The prefixes of mutating actions and the limits of the seeded rules.
MUTATING = ["write_", "delete_", "update_", "create_", "publish_", "send_", "post_"]
SEED_RULES = [
    Constraint("C-0001", Always(), Not(ActionTypeEq("")), "error", "an action has a type"),
    Constraint("C-0002", AnyOf(tuple(map(ActionStartsWith, MUTATING))), Not(AnyOf((Not(FieldExists("resource_owner")), FieldEq("resource_owner", "")))), "error", "a mutation names its owner"),
    Constraint("C-0003", FieldGt("privilege_level", 2.0), FieldLt("privilege_level", 3.0), "error", "high privileges need approval"),
    Constraint("C-0004", FieldGt("risk_score", 0.9), FieldLt("risk_score", 0.9), "error", "extreme risk is blocked"),
    Constraint("C-0005", FieldGt("risk_score", 0.5), FieldLt("risk_score", 0.5), "warning", "raised risk is warned of"),
]


def evaluate(actions: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """A row (action columns, constraint_id, severity) for each violated constraint: when and not require."""
    if not constraints:
        return actions.withColumn("constraint_id", F.lit(None).cast("string")).withColumn("severity", F.lit(None).cast("string")).limit(0)
    hits = [F.when(c.when.column(actions) & ~c.require.column(actions), F.struct(F.lit(c.id).alias("id"), F.lit(c.severity).alias("severity"))) for c in constraints]
    rows = actions.withColumn("_v", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return rows.select(*actions.columns, F.col("_v.id").alias("constraint_id"), F.col("_v.severity").alias("severity"))


def on_action(actions: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """Actions with ``blocked`` (an error is violated) and their ``warnings``."""
    def ids(severity: str) -> Column:
        hits = [F.when(c.when.column(actions) & ~c.require.column(actions), F.lit(c.id)) for c in constraints if c.severity == severity]
        return F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")

    return actions.withColumns({"blocked": F.size(ids("error")) > 0, "errors": ids("error"), "warnings": ids("warning")})


UNPARSED = "[UNPARSED — NOT ENFORCED]"
_COMPARISON = re.compile(r"^\s*(?:metadata\.)?([A-Za-z_]\w*)\s*(==|!=|<=|>=|<|>)\s*(\"[^\"]*\"|'[^']*'|-?\d+(?:\.\d+)?|true|false)\s*$")


def _comparison(text: str) -> Condition | None:
    m = _COMPARISON.match(text)
    if not m:
        return None
    name, op, raw = m.groups()
    value: Any = raw[1:-1] if raw[0] in "\"'" else raw == "true" if raw in ("true", "false") else float(raw)
    if op in ("==", "!="):
        c: Condition = ActionTypeEq(value) if name == "action_type" else FieldEq(name, value)
        return c if op == "==" else Not(c)
    if not isinstance(value, float):
        return None
    return {"<": FieldLt(name, value), ">": FieldGt(name, value), "<=": Not(FieldGt(name, value)), ">=": Not(FieldLt(name, value))}[op]


def _structured(text: str) -> Condition | None:
    """Comparisons joined by either ``and`` or ``or``."""
    for word, kind in ((r"\s+and\s+|&&", All), (r"\s+or\s+|\|\|", AnyOf)):
        parts = re.split(word, text)
        if len(parts) > 1:
            found = [_comparison(p) for p in parts]
            return kind(tuple(found)) if all(found) else None  # type: ignore[arg-type]
    return _comparison(text)


def compile_nl(text: str, id: str) -> Constraint:
    """A constraint out of free text: a structured predicate, a known phrase, or one marked as not enforced."""
    low, text = text.lower(), text.strip()
    severity = "error" if any(w in low for w in ("error", "block", "must")) else "warning"
    prefixes = tuple(ActionStartsWith(p) for p in MUTATING if p in low or re.search(rf"\b{p[:-1]}\b", low))
    when: Condition | None = AnyOf(prefixes) if prefixes else None
    require = _structured(text)
    if require is None:
        if "resource_owner" in low:
            require = Not(FieldEq("resource_owner", ""))
        elif "privilege_level" in low:
            require = FieldLt("privilege_level", 3.0)
        elif "risk_score" in low:
            require = FieldLt("risk_score", 0.9)
    if require is None:
        return Constraint(id, Always(), Always(), severity, f"{UNPARSED} {text}")
    return Constraint(id, when or Always(), require, severity, text)


CORRECTION = "[correction] "


def apply_correction(book: dict[str, Constraint], text: str, id: str) -> tuple[dict[str, Constraint], bool, str]:
    """The constraints with one that a user's words make, under ``id``; whether it is new; and what to tell the user."""
    made = compile_nl(text, id)
    rule = replace(made, description=CORRECTION + made.description)
    return {**book, id: rule}, id not in book, f"Got it, I'll remember to {made.description} going forward."


def undo_correction(book: dict[str, Constraint], id: str) -> tuple[dict[str, Constraint], Constraint | None]:
    """The constraints without that of ``id``, and that one if there was any."""
    return {k: c for k, c in book.items() if k != id}, book.get(id)


def gaps(evidence: DataFrame) -> DataFrame:
    """Evidence whose status is unknown."""
    return evidence.where(F.coalesce(F.col("status"), F.lit("unknown")) == "unknown")


def related(constraints: DataFrame, decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """constraint_id, adr_id and evidence_id, by the lists of ids that each names."""
    a = constraints.select(F.col("id").alias("constraint_id"), F.explode("evidence").alias("adr_id"))
    b = decisions.select(F.col("id").alias("adr_id"), F.explode_outer("evidence").alias("evidence_id"))
    return a.join(b, "adr_id").join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi").select("constraint_id", "adr_id", "evidence_id")
