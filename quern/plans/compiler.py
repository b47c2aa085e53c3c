"""Compiles steps to lazy DataFrame plans.

``limit`` waits for the next sort (which makes it a top-k) or for the end of the pipeline, where it
takes the first rows by the order in force, by id if there is none. Only ``conditional`` and the
iterative graph steps run anything before the result is read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import paths
from quern.operators import graph, relational, search, transform
from quern.plans import ir
from quern.plans.parser import parse
from quern.sources import store


@dataclass
class Result:
    """``nodes`` unless the pipeline ended in an aggregate; ``mutated`` counts the operations of a mutate step."""

    nodes: DataFrame | None = None
    aggregate: DataFrame | None = None
    mutated: int | None = None
    store: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        return self.nodes if self.aggregate is None else self.aggregate


@dataclass
class _State:
    df: DataFrame
    order: list[Column] = field(default_factory=list)
    limit: int | None = None
    skip: int = 0
    names: dict[str, DataFrame] = field(default_factory=dict)


class Engine:
    """Runs pipelines over a node table (id, data, timestamp; maybe embedding and quality_score)."""

    def __init__(self, nodes: DataFrame, edges: DataFrame | None = None, embedder: search.Embedder | None = None, now: str | None = None):
        self.nodes, self.embedder, self.now = nodes, embedder, now
        self._edges = edges

    @property
    def edges(self) -> DataFrame:
        return graph.edges_of(self.nodes) if self._edges is None else self._edges

    def dsl(self, text: str) -> Result:
        return self.run(parse(text))

    def json(self, text: str) -> Result:
        return self.run(ir.loads(text))

    def run(self, steps: Iterable[ir.Step]) -> Result:
        state = _State(self.nodes)
        for step in steps:
            done = self._step(state, step)
            if done is not None:
                return done
        return Result(self._settle(state))

    # ---------------------------------------------------------------- helpers

    def _settle(self, s: _State) -> DataFrame:
        """Applies the waiting limit and order."""
        if s.limit is None and not s.skip:
            return s.df.orderBy(*s.order) if s.order else s.df
        df = s.df.orderBy(*(s.order or [F.col("id")]))
        if s.skip:
            df = df.offset(s.skip)
        return df if s.limit is None else df.limit(s.limit)

    def _replace(self, s: _State, df: DataFrame) -> None:
        """A step that replaces the set: nothing waits any more, the new rows have no order."""
        s.df, s.order = df, []

    def _step(self, s: _State, step: ir.Step) -> Result | None:
        e = self.edges if isinstance(step, (ir.GraphLinks, ir.GraphNeighbors, ir.GraphPath, ir.GraphPageRank, ir.GraphClusters, ir.GraphStats, ir.ChronicleTrace)) else None
        match step:
            case ir.Filter():
                s.df = relational.where(s.df, step.predicate)
            case ir.Sort():
                if step.after is not None:
                    s.df = relational.after_cursor(s.df, step.by, step.dir, step.after)
                s.order = relational.order_by(s.df, step.by, step.dir)
                if s.limit is not None or s.skip:
                    s.df = self._settle(s)
                    s.limit, s.skip = None, 0
            case ir.Limit():
                s.limit = step.n if s.limit is None else min(s.limit, step.n)
            case ir.Skip():
                s.skip += step.n
            case ir.Project():
                if s.order:  # the order may need fields that go: it is fixed before
                    s.df = s.df.orderBy(*s.order) if s.limit is None and not s.skip else self._settle(s)
                    s.order, s.limit, s.skip = [], None, 0
                    s.df = relational.project(s.df, step.specs)
                    return None
                s.df = relational.project(s.df, step.specs)
            case ir.Aggregate():
                df = self._settle(s) if s.limit is not None or s.skip else s.df
                return Result(aggregate=relational.aggregate(df, step.fn, step.field))
            case ir.Mutate():
                new, n = store.mutate(self.nodes, step.ops, step.atomic)
                return Result(nodes=self.nodes.limit(0), mutated=n, store=new)
            case ir.GraphLinks():
                ids = graph.links(e, step.src, step.dst, step.min_strength, step.type)
                self._replace(s, self.nodes.join(ids.select("id"), "id", "left_semi") if self._edges is None else self._as_nodes(ids))
            case ir.GraphNeighbors():
                self._replace(s, graph.neighbors(self.nodes, e, step.root, step.depth, step.min_strength, step.type, step.bidirectional))
            case ir.GraphPath():
                s.df, s.order = graph.path(self.nodes, e, step.src, step.dst, step.max_hops), [F.col("position")]
            case ir.GraphPageRank():
                ranks = graph.pagerank(self.nodes, e, step.damping, step.iterations)
                df = self._inject(graph.data_nodes(self.nodes).join(ranks, "id"), "pagerank_score")
                s.df, s.order = df, [F.desc("pagerank_score"), F.col("id")]
            case ir.GraphClusters():
                c = graph.clusters(self.nodes, e, step.algorithm, step.min_size, step.min_strength)
                s.df = c.select(F.col("cluster_id").alias("id"), F.struct("*").alias("data"))
                s.order = [F.col("id")]
            case ir.GraphStats():
                self._replace(s, graph.stats(self.nodes, e).select(F.lit("__graph_stats__").alias("id"), F.struct("*").alias("data")))
            case ir.AutoLink():
                made = graph.auto_link(s.df, step.algorithms, step.min_strength)
                self._replace(s, made.select("id", F.struct(F.lit(True).alias("_edge"), F.col("src").alias("from"), F.col("dst").alias("to"), "strength", "link_type").alias("data")))
            case ir.ChronicleTrace():
                s.df, s.order = graph.trace(self.nodes, e, step.root, step.max_depth, step.direction), [F.col("depth"), F.col("id")]
            case ir.VectorSearch():
                self._vector_search(s, step)
            case ir.TextSearch():
                s.df, s.order = search.text_search(self.nodes, step.query, step.limit, step.field), [F.col("id")]
            case ir.Transform():
                if s.order or s.limit is not None or s.skip:
                    s.df = self._settle(s)
                    s.order, s.limit, s.skip = [], None, 0
                s.df = transform.transform(s.df, step.format, step.max_chars)
            case ir.Conditional():
                first = self._settle(s) if s.order else s.df.orderBy("id")
                holds = not first.limit(1).where(relational.predicate(first, step.predicate)).isEmpty()
                for inner in step.then if holds else step.otherwise:
                    done = self._step(s, inner)
                    if done is not None:
                        return done
            case ir.Assign():
                s.names[step.name] = self._settle(s)
            case ir.Emit():
                df = self._settle(s) if step.source is None else s.names.get(step.source, s.df.limit(0))
                return Result(df.withColumn("_label", F.lit(step.label)))
            case _:
                raise ir.QueryError(f"cannot run {step!r}")
        return None

    def _as_nodes(self, edges: DataFrame) -> DataFrame:
        data = F.struct(F.lit(True).alias("_edge"), F.col("src").alias("from"), F.col("dst").alias("to"), "label", "strength", "weight", "link_type")
        return edges.select("id", data.alias("data"))

    def _inject(self, df: DataFrame, *names: str) -> DataFrame:
        """Top-level columns as fields of ``data``."""
        b = paths.bind(df)
        if isinstance(b, paths.StructBinding):
            return df.withColumn("data", F.struct(*[F.col("data")[f].alias(f) for f in b.fields() if f not in names], *names))
        extra = F.parse_json(F.to_json(F.struct(*names)))
        both = F.map_concat(F.map_filter(F.try_variant_get("data", "$", "map<string,variant>"), lambda k, v: ~k.isin(*names)), F.try_variant_get(extra, "$", "map<string,variant>"))
        return df.withColumn("data", F.to_variant_object(both))

    def _vector_search(self, s: _State, step: ir.VectorSearch) -> None:
        """Twice as many candidates, then the category, unless ``prefilter`` asks for the category first."""
        if self.embedder is None or "embedding" not in self.nodes.columns:
            return self._replace(s, self.nodes.limit(0))
        base, cat = self.nodes, None
        if step.category is not None:
            cat = relational.equals(paths.bind(base).value("category"), step.category)
            if step.prefilter:
                base, cat = base.where(cat), None
        found = search.vector_search(base, self.embedder(step.query), 2 * step.limit, step.min_score, self.now)
        if cat is not None:
            found = found.where(cat)
        found = found.orderBy(F.desc("score"), "id").limit(step.limit)
        found = found.withColumn("_score", F.col("score")).withColumn("_similarity", F.col("similarity")).withColumn("_quality", F.col("quality"))
        found = self._inject(found, "score", "_score", "_similarity", "_quality")
        s.df, s.order = found, [F.desc("score"), F.col("id")]
        return None
