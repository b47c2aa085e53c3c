"""Fluent builder of pipelines; gives the same steps as the text and JSON forms."""

from __future__ import annotations

from typing import Any

from quern.plans import ir


class Query:
    def __init__(self, steps: tuple[ir.Step, ...] = ()):
        self.steps = steps

    def _add(self, step: ir.Step) -> "Query":
        return Query((*self.steps, step))

    def filter(self, predicate: ir.Predicate) -> "Query":
        return self._add(ir.Filter(predicate))

    def sort(self, by: str, dir: str = "asc", after: str | None = None) -> "Query":
        return self._add(ir.Sort(by, dir, after))

    def sort_desc(self, by: str) -> "Query":
        return self.sort(by, "desc")

    def sort_after(self, by: str, dir: str, after: str) -> "Query":
        return self.sort(by, dir, after)

    def limit(self, n: int) -> "Query":
        return self._add(ir.Limit(n))

    def skip(self, n: int) -> "Query":
        return self._add(ir.Skip(n))

    def project(self, *paths: str, **aliases: str) -> "Query":
        return self._add(ir.Project((*map(ir.FieldSpec, paths), *(ir.FieldSpec(p, a) for a, p in aliases.items()))))

    def aggregate(self, fn: str, field: str | None = None) -> "Query":
        return self._add(ir.Aggregate(fn, field))

    def mutate(self, *ops: ir.MutateOp, atomic: bool = False) -> "Query":
        return self._add(ir.Mutate(ops, atomic))

    def mutate_atomic(self, *ops: ir.MutateOp) -> "Query":
        return self.mutate(*ops, atomic=True)

    def conditional(self, predicate: ir.Predicate, then: "Query | None" = None, otherwise: "Query | None" = None) -> "Query":
        return self._add(ir.Conditional(predicate, then.steps if then else (), otherwise.steps if otherwise else ()))

    def assign(self, name: str) -> "Query":
        return self._add(ir.Assign(name))

    def emit(self, label: str, source: str | None = None) -> "Query":
        return self._add(ir.Emit(label, source))

    def transform(self, format: str, max_chars: int = 0) -> "Query":
        return self._add(ir.Transform(format, max_chars))

    def step(self, step: ir.Step) -> "Query":
        """Any other step: graph and search steps are used as they are."""
        return self._add(step)

    def to_steps(self) -> list[ir.Step]:
        return list(self.steps)

    def to_json(self) -> str:
        return ir.dumps(list(self.steps))


class Mutations:
    """Collects mutation operations."""

    def __init__(self):
        self.ops: list[ir.MutateOp] = []

    def put(self, id: str, data: Any) -> "Mutations":
        self.ops.append(ir.MutateOp("put", id, data))
        return self

    def delete(self, id: str) -> "Mutations":
        self.ops.append(ir.MutateOp("delete", id))
        return self

    def merge(self, id: str, patch: Any) -> "Mutations":
        self.ops.append(ir.MutateOp("merge", id, patch))
        return self

    def put_edge(self, src: str, dst: str, label: str = "") -> "Mutations":
        self.ops.append(ir.MutateOp("put_edge", src=src, dst=dst, label=label))
        return self

    def delete_edge(self, src: str, dst: str) -> "Mutations":
        self.ops.append(ir.MutateOp("delete_edge", src=src, dst=dst))
        return self
