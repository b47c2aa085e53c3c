"""Property-graph operators over an edge table (id, src, dst, label, strength, weight, link_type).

Traversals are frontier joins, one per hop, that carry only ids; iterative operators cut their lineage
in the checkpoint folder. Pair operators are equi-joins on tokens, categories or time buckets, never
all pairs.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import paths
from quern.operators import alike
from quern.plans.staging import cut

EDGE_COLUMNS = ["id", "src", "dst", "label", "strength", "weight", "link_type"]
HOUR_MS, DAY_S = 3_600_000, 86_400
#: Bytes of a component's links from which they are in a file, and links that are read from there at once.
HELD, PIECE = 1 << 26, 1 << 20


def edges_of(nodes: DataFrame) -> DataFrame:
    """The edge nodes of a node table: ``data._edge`` is true."""
    v = lambda p: paths.lookup(nodes, p)
    return nodes.where(F.coalesce(v("_edge").boolean, F.lit(False))).select(
        F.col("id"), v("from").string.alias("src"), v("to").string.alias("dst"), v("label").string.alias("label"),
        v("strength").number.alias("strength"), v("weight").number.alias("weight"), v("link_type").string.alias("link_type"),
    )


def data_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.coalesce(paths.lookup(nodes, "_edge").boolean, F.lit(False)))


def _sound(edges: DataFrame) -> DataFrame:
    """Edges with both ends."""
    return edges.where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != ""))


def _strength() -> Column:
    """Of links and neighbours: ``weight`` does not count."""
    return F.coalesce("strength", F.lit(1.0))


def _weight() -> Column:
    """Of clusters: ``weight``, else ``strength``, else 1."""
    return F.coalesce("weight", "strength", F.lit(1.0))


def links(edges: DataFrame, src=None, dst=None, min_strength=None, type=None) -> DataFrame:
    out = edges
    if src is not None:
        out = out.where(F.col("src") == src)
    if dst is not None:
        out = out.where(F.col("dst") == dst)
    if min_strength is not None:
        out = out.where(_strength() >= float(min_strength))
    if type is not None:
        out = out.where(F.col("label") == type)
    return out


def neighbor_ids(edges: DataFrame, root: str, depth: int = 1, min_strength=None, type=None, bidirectional: bool = False) -> DataFrame:
    """(id, hops) of what ``root`` reaches in ``depth`` hops, without ``root``."""
    e = _sound(links(edges, None, None, min_strength, type)).select("src", "dst")
    if bidirectional:
        e = e.union(e.select("dst", "src"))
    e = e.distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(root, 0)], "id string, hops int")
    front = seen
    for hop in range(1, depth + 1):
        front = front.join(e, front.id == e.src).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hops"))
        if hop % 3 == 0:
            front = cut(front)
            if front.isEmpty():
                break
            seen = cut(seen.unionByName(front))
        else:
            seen = seen.unionByName(front)
    return seen.where("hops > 0")


def neighbors(nodes: DataFrame, edges: DataFrame, *args, **kw) -> DataFrame:
    return data_nodes(nodes).join(neighbor_ids(edges, *args, **kw).select("id"), "id", "left_semi")


def path_ids(edges: DataFrame, src: str, dst: str, max_hops: int = 10) -> list[str]:
    """Ids of a shortest undirected path, the smallest in order of ids if there are several; empty if none."""
    if src == dst:
        return [src]
    e = _sound(edges).select("src", "dst")
    e = e.union(e.select("dst", "src")).where("src != dst").distinct()
    front = edges.sparkSession.createDataFrame([(src, [src])], "at string, path array<string>")
    seen = front.select("at")
    for _ in range(max_hops):
        steps = front.join(e, front["at"] == e.src).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        front = cut(steps.join(seen, "at", "left_anti").groupBy("at").agg(F.min("path").alias("path")))
        hit = front.where(F.col("at") == dst).select("path").head()
        if hit:
            return list(hit.path)
        if front.isEmpty():
            return []
        seen = seen.union(front.select("at"))
    return []


def path(nodes: DataFrame, edges: DataFrame, src: str, dst: str, max_hops: int = 10) -> DataFrame:
    """Nodes of the path with ``position``; ids that are not in the store have null data."""
    ids = path_ids(edges, src, dst, max_hops)
    places = nodes.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], "position int, id string")
    return places.join(nodes, "id", "left").select(*nodes.columns, "position").orderBy("position")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, cut_every: int = 5) -> DataFrame:
    """(id, pagerank_score): directed, parallel edges count, dangling mass is spread evenly."""
    e = _sound(edges).select("src", "dst")
    vertices = data_nodes(nodes).select("id").union(e.select("src")).union(e.select("dst")).distinct()
    out_degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # dealt once: rounds join what lies together
    vertices = cut(vertices.join(out_degree, vertices.id == out_degree.src, "left").select("id", "out").repartition(tasks, "id"))
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("pagerank_score"))
    # parallel edges are one row with a count
    e = cut(e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).repartition(tasks, "src"))
    ranks = vertices.select("id", "out", F.lit(1.0 / n).alias("r"))
    for i in range(iterations):
        sent = ranks.where("out is not null").join(e, ranks.id == e.src).groupBy("dst").agg(F.sum(F.col("r") * F.col("k") / F.col("out")).alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("r"))), F.lit(0.0)).alias("lost"))
        ranks = (
            vertices.join(sent, vertices.id == sent.dst, "left").join(F.broadcast(lost))
            .select("id", "out", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.lit(float(n)))).alias("r"))
        )
        if (i + 1) % cut_every == 0:
            ranks = cut(ranks)
    return ranks.select("id", F.col("r").alias("pagerank_score"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, avg_degree, max_degree, orphan_count, density."""
    d = data_nodes(nodes).select("id")
    ends = _sound(edges).select(F.explode(F.array("src", "dst")).alias("id"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    counted = d.join(degree, "id", "left").agg(
        F.count(F.lit(1)).alias("node_count"), F.sum(F.coalesce("deg", F.lit(0))).alias("total"), F.count(F.when(F.col("deg").isNull(), 1)).alias("orphan_count")
    )
    m = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    top = degree.agg(F.coalesce(F.max("deg"), F.lit(0)).alias("max_degree"))
    n = F.col("node_count")
    pairs = n.cast("double") * (n - 1) / 2
    return counted.join(F.broadcast(m)).join(F.broadcast(top)).select(
        "node_count", "edge_count", F.when(n > 0, F.col("total") / n).otherwise(0.0).alias("avg_degree"), "max_degree", "orphan_count",
        F.when(n < 2, 0.0).otherwise(F.col("edge_count") / pairs).alias("density"),
    )


# ---------------------------------------------------------------------------- clusters


def cluster_table(members: DataFrame, edges: DataFrame, algorithm: str, min_size: int) -> DataFrame:
    """Cluster records of (id, key): members, size, coherence over all edges; numbered by size, then least member."""
    w = _sound(edges).select("src", "dst", _weight().alias("w"))
    a = members.select(F.col("id").alias("src"), F.col("key").alias("ka"))
    b = members.select(F.col("id").alias("dst"), F.col("key").alias("kb"))
    ends = w.join(a, "src", "left").join(b, "dst", "left")
    inner = ends.where("ka = kb").groupBy(F.col("ka").alias("key")).agg(F.sum("w").alias("inside"))
    touch = ends.select("w", F.explode(F.array_distinct(F.array("ka", "kb"))).alias("key")).where("key is not null").groupBy("key").agg(F.sum("w").alias("incident"))
    sizes = members.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).cast("int").alias("size")).where(F.col("size") >= min_size)
    number = F.row_number().over(Window.orderBy(F.desc("size"), "least"))  # one slim row per cluster
    numbers = sizes.select("key", "size", (number - 1).alias("number"))
    groups = members.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("member_ids")).join(numbers, "key")
    c = groups.join(inner, "key", "left").join(touch, "key", "left")
    score = F.least(F.lit(1.0), F.coalesce("inside", F.lit(0.0)) / F.greatest(F.lit(1.0), F.coalesce("incident", F.lit(0.0))))
    return c.select(
        F.format_string("%s-%03d", F.lit(algorithm), "number").alias("cluster_id"), F.lit(algorithm).alias("algorithm"), "member_ids", "size", score.alias("coherence_score")
    )


def _incident(edges: DataFrame, min_strength) -> DataFrame:
    e = _sound(edges)
    return e if min_strength is None else e.where(_weight() >= float(min_strength))


def semantic_members(nodes: DataFrame, edges: DataFrame, min_strength=None) -> DataFrame:
    """Nodes at an edge, by category ("unknown" if none). An id that several nodes share is once in each of their categories."""
    ends = _incident(edges, min_strength).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    have = nodes.select("id", F.coalesce(paths.lookup(nodes, "category").string, F.lit("unknown")).alias("c")).distinct()
    return ends.join(have, "id", "left").select("id", F.coalesce("c", F.lit("unknown")).alias("key"))


def temporal_members(nodes: DataFrame, edges: DataFrame, min_strength=None) -> DataFrame:
    """Nodes at an edge, by hour of ``created_at`` (ms), else of the record's timestamp."""
    ends = _incident(edges, min_strength).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ms = paths.lookup(nodes, "created_at").number
    if "timestamp" in nodes.columns:
        ms = F.coalesce(ms, F.unix_millis("timestamp").cast("double"))
    have = nodes.select("id", F.floor(ms / HOUR_MS).cast("string").alias("h"))
    return ends.join(have, "id", "left").select("id", F.coalesce("h", F.lit("0")).alias("key"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that is reachable, by alternating large and small stars."""
    e = _sound(edges).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    loops = e.where("u = v").select(F.col("u").alias("id"))
    now, before = cut(e.where("u != v")), None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(large.join(least, "u").select(F.explode(F.expr("array(struct(v as u, m as v), struct(u, m as v))")).alias("e")).select("e.*").where("u != v").distinct())
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
    return found.union(loops.join(found, "id", "left_anti").select("id", F.col("id").alias("component")))


def louvain_local(src: np.ndarray, dst: np.ndarray, w: np.ndarray, total: float | None = None, passes: int = 100) -> dict:
    """Single-level modularity moving of one connected component; ids in ascending order, ties to the least
    community. ``total``: the sum of degrees in the whole graph."""
    ids = sorted(set(src) | set(dst))
    near: dict = {i: {} for i in ids}
    for a, b, x in zip(src, dst, w):
        near[a][b] = near[a].get(b, 0.0) + x
        if a != b:
            near[b][a] = near[b].get(a, 0.0) + x
    degree = {i: sum(near[i].values()) for i in ids}
    total = sum(degree.values()) if total is None else total
    of, mass = {i: i for i in ids}, dict(degree)
    if total <= 0:
        return of
    for _ in range(passes):
        moved = False
        for i in ids:
            to: dict = {}
            for j, x in near[i].items():
                if j != i:
                    to[of[j]] = to.get(of[j], 0.0) + x
            own = of[i]
            mass[own] -= degree[i]
            best, gain = own, to.get(own, 0.0) - mass[own] * degree[i] / total
            for c in sorted(to):
                g = to[c] - mass[c] * degree[i] / total
                if g > gain + 1e-12:
                    best, gain = c, g
            mass[best] += degree[i]
            moved |= best != own
            of[i] = best
        if not moved:
            break
    return of


class _Adjacency:
    """The links (j, w) of a component's nodes 0, 1, ... in order: in a file if there are many, so that only a few numbers
    for each node stay in memory."""

    LINK = np.dtype([("j", "<i4"), ("w", "<f8")])

    def __init__(self):
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.file, self.n = tempfile.SpooledTemporaryFile(HELD, dir=folder if os.path.isdir(folder) else None), []

    def add(self, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> None:
        rows = np.empty(len(i), self.LINK)
        rows["j"], rows["w"] = j, w
        self.file.write(rows.tobytes())
        first = len(self.n) - 1 if self.n and i[0] == len(self.n) - 1 else len(self.n)
        n = np.bincount(i - first).tolist()
        if first < len(self.n):
            self.n[-1] += n.pop(0)
        self.n += n

    def nodes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(i, j, w) of each node, read in pieces of about PIECE links."""
        self.file.seek(0)
        i = 0
        while i < len(self.n):
            last, links = i, 0
            while last < len(self.n) and (last == i or links + self.n[last] <= PIECE):
                links += self.n[last]
                last += 1
            rows = np.frombuffer(self.file.read(links * self.LINK.itemsize), self.LINK)
            j, w, at = rows["j"].astype(np.int64), rows["w"].copy(), 0
            for k in range(i, last):
                end = at + self.n[k]
                yield k, j[at:end], w[at:end]
                at = end
            i = last


def _moved(near: _Adjacency, total: float, passes: int = 100) -> np.ndarray:
    """What ``louvain_local`` gives, for nodes by number."""
    n = len(near.n)
    degree = np.array([w.sum() for _, _, w in near.nodes()])
    of, mass = np.arange(n), degree.copy()
    if total <= 0:
        return of
    for _ in range(passes):
        moved = False
        for i, j, w in near.nodes():
            own, d = of[i], degree[i]
            mass[own] -= d
            c, at = np.unique(of[j], return_inverse=True)
            if (j == i).any():  # a loop links to no community
                w = np.where(j == i, 0.0, w)
                bare = np.bincount(at, j != i) == 0
            else:
                bare = None
            to = np.bincount(at, w)
            gains = to - mass[c] * d / total
            if bare is not None:
                gains[bare] = -np.inf
            x = np.searchsorted(c, own)
            linked = x < len(c) and c[x] == own
            best, gain = own, (to[x] if linked else 0.0) - mass[own] * d / total
            # only what exceeds all before it can be taken
            top = np.maximum.accumulate(gains)
            for k in np.flatnonzero((gains > gain + 1e-12) & (np.append(True, gains[1:] > top[:-1]))).tolist():
                if gains[k] > gain + 1e-12:
                    best, gain = c[k], gains[k]
            mass[best] += d
            moved |= bool(best != own)
            of[i] = best
        if not moved:
            break
    return of


def louvain_members(edges: DataFrame, min_strength=None) -> DataFrame:
    """Communities by modularity, within each connected component (modularity never joins two). A component's nodes are
    numbered in order of their ids; one task moves them, and reads their links in order, from a file if there are many."""
    e = _incident(edges, min_strength).select("src", "dst", _weight().alias("w"))
    total = e.agg(F.sum(F.col("w") * F.when(F.col("src") == F.col("dst"), 1).otherwise(2))).first()[0] or 0.0
    comp = cut(components(e))
    heads = cut(comp.select("component").distinct().withColumn("c", F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy("c").orderBy("id")) - 1
    places = cut(comp.join(heads, "component").select("c", "id", place.alias("i")))
    ends = e.join(places.withColumnRenamed("id", "src"), "src").select("c", "i", "dst", "w")
    ends = ends.join(places.select(F.col("id").alias("dst"), F.col("i").alias("j")), "dst")
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    rows = ends.select("c", F.explode(both).alias("e"), "w").select("c", "e.i", "e.j", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(c: int, near: _Adjacency) -> pa.RecordBatch:
            of = _moved(near, total)
            near.file.close()
            return pa.RecordBatch.from_pydict({"c": np.full(len(of), c), "i": np.arange(len(of), dtype=np.int32), "k": of.astype(np.int32)})

        now, near = None, None
        for batch in batches:
            c, i, j, w = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            starts = np.flatnonzero(np.append(True, c[1:] != c[:-1])).tolist() if len(c) else []
            for a, b in zip(starts, [*starts[1:], len(c)]):
                if c[a] != now:
                    if near is not None:
                        yield done(now, near)
                    now, near = c[a], _Adjacency()
                near.add(i[a:b], j[a:b], w[a:b])
        if near is not None:
            yield done(now, near)

    found = rows.repartition("c").sortWithinPartitions("c", "i", "j").mapInArrow(run, "c long, i int, k int")
    return cut(found.join(places, ["c", "i"]).select("id", F.concat_ws(":", "c", "k").alias("key")))  # read several times, moved once


def clusters(nodes: DataFrame, edges: DataFrame, algorithm: str, min_size: int = 2, min_strength=None) -> DataFrame:
    if algorithm == "louvain":
        members = louvain_members(edges, min_strength)
    elif algorithm == "semantic":
        members = semantic_members(nodes, edges, min_strength)
    else:
        members = temporal_members(nodes, edges, min_strength)
    return cluster_table(members, edges, algorithm, min_size)


# ---------------------------------------------------------------------------- linking


def token_sets(nodes: DataFrame) -> DataFrame:
    """(id, tokens): distinct lower-case words of text, the category and the tags."""
    text, cat, tags = (paths.lookup(nodes, p) for p in ("text", "category", "tags"))
    empty = F.array().cast("array<string>")
    words = F.filter(F.split(F.lower(F.coalesce(text.string, F.lit(""))), r"\s+"), lambda w: w != "")
    more = F.when(cat.string.isNotNull(), F.array(F.lower(cat.string))).otherwise(empty)
    tagged = F.transform(F.coalesce(tags.strings, empty), lambda t: F.lower(t))
    return nodes.select("id", F.array_distinct(F.concat(words, more, F.filter(tagged, lambda t: t.isNotNull()))).alias("tokens"))


def semantic_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, strength): pairs src < dst with a Jaccard similarity of ``threshold`` at least.

    Prefix filter: tokens are ordered by rarity, and two sets can only be that similar if they share one
    of the first ``n - ceil(t * n) + 1`` tokens of each. Sets that are alike are joined once.
    """
    member, sims = semantic_classes(sets, threshold)
    m, w = member.select(F.col("c").alias("a"), F.col("id").alias("i")), member.select(F.col("c").alias("b"), F.col("id").alias("j"))
    across = sims.join(m, "a").join(w, "b").select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "s")
    alike = m.join(w, F.col("a") == F.col("b")).where("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("s"))
    return across.unionByName(alike).withColumnRenamed("s", "strength")


def semantic_classes(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(c, id): members of each class of equal sets, by its least id; and (a, b, s): similar classes."""
    if threshold <= 0:
        raise ValueError("the similarity threshold must be above 0")
    whole = cut(sets.where(F.size("tokens") > 0).select(F.array_sort("tokens").alias("tokens"), "id"))
    classes = whole.groupBy("tokens").agg(F.min("id").alias("c"))
    df = classes.select("c", F.explode("tokens").alias("t"))
    rarity = cut(df.groupBy("t").agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.monotonically_increasing_id()))  # tokens as numbers
    ordered = df.join(rarity, "t").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("n", "i"))).alias("o")).select("c", F.transform("o", lambda x: x["i"]).alias("o"))
    ordered = cut(ordered.withColumn("k", F.size("o")))
    keep = F.col("k") - F.ceil(F.col("k") * F.lit(threshold) - 1e-9) + 1
    prefix = ordered.select("c", "k", F.posexplode(F.slice("o", 1, keep.cast("int"))).alias("p", "t"))
    side = lambda c, k, p: prefix.select("t", F.col("c").alias(c), F.col("k").alias(k), F.col("p").alias(p))
    both = side("a", "ka", "pa").join(side("b", "kb", "pb"), "t").where((F.col("a") < F.col("b")) & (F.least("ka", "kb") >= F.greatest("ka", "kb") * F.lit(threshold) - 1e-9))
    # at the first token that two sets share, no more than the rest of the shorter one can follow
    most = F.least(F.col("ka") - F.col("pa"), F.col("kb") - F.col("pb"))
    near = both.where(most >= F.lit(threshold / (1 + threshold)) * (F.col("ka") + F.col("kb")) - 1e-9).select("a", "b").distinct()
    oa, ob = ordered.select(F.col("c").alias("a"), F.col("o").alias("x")), ordered.select(F.col("c").alias("b"), F.col("o").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    sims = near.join(oa, "a").join(ob, "b").select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("s")).where(F.col("s") >= threshold)
    return whole.join(classes, "tokens").select("c", "id"), sims


def semantic_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, class, links): what ``semantic_pairs`` links, one row per node: its class of equal sets and its number of links."""
    return alike.counted(token_sets(nodes), threshold)


def category_links(nodes: DataFrame) -> DataFrame:
    """(id, class, links): what ``category_pairs`` links, one row per node: the least id of its category and its links."""
    n = nodes.select("id", paths.lookup(nodes, "category").string.alias("c")).where("c is not null and c != ''")
    per = n.groupBy("c").agg(F.min("id").alias("class"), (F.count(F.lit(1)) - 1).alias("links"))
    return n.join(per, "c").select("id", "class", "links")


def temporal_links(nodes: DataFrame, min_strength: float) -> DataFrame:
    """(id, links, apart, strength): what ``temporal_pairs`` links, one row per node: its number of links, the seconds
    that these are apart together, and their strengths' sum. Nodes are counted per second first, so a task holds three days of seconds at most, however many nodes."""
    n = nodes.select("id", F.unix_timestamp("timestamp").alias("t")).where("t is not null")
    seconds = n.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    near = seconds.withColumn("own", F.floor(F.col("t") / DAY_S)).withColumn("d", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 1)))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        t, k = rows["t"].to_numpy(), rows["n"].to_numpy()
        at = np.flatnonzero((rows["own"] == rows["d"]).to_numpy())
        base = t[0]
        sums, moments = np.concatenate([[0], np.cumsum(k)]), np.concatenate([[0], np.cumsum(k * (t - base))])
        low, high = np.searchsorted(t, t[at] - DAY_S), np.searchsorted(t, t[at] + DAY_S, "right")
        links = sums[high] - sums[low]
        apart = (moments[high] - moments[at]) - (sums[high] - sums[at]) * (t[at] - base) + (sums[at] - sums[low]) * (t[at] - base) - (moments[at] - moments[low])
        return pd.DataFrame({"t": t[at], "links": links - 1, "apart": apart})

    per = near.groupBy("d").applyInPandas(count, "t long, links long, apart long")
    strength = F.col("links") - F.lit(1.0 - min_strength) * F.col("apart") / DAY_S
    return n.join(per, "t").select("id", "links", "apart", strength.alias("strength"))


def category_pairs(nodes: DataFrame) -> DataFrame:
    n = nodes.select("id", paths.lookup(nodes, "category").string.alias("c")).where("c is not null and c != ''")
    a, b = n.select("c", F.col("id").alias("src")), n.select("c", F.col("id").alias("dst"))
    return a.join(b, "c").where("src < dst").select("src", "dst", F.lit(1.0).alias("strength"))


def temporal_pairs(nodes: DataFrame, min_strength: float, seconds: Column | None = None) -> DataFrame:
    """Pairs at most a day apart: a range join through day buckets (each row meets its day and the next)."""
    t = F.unix_timestamp("timestamp") if seconds is None else seconds
    n = nodes.select("id", t.alias("t")).where("t is not null").withColumn("d", F.floor(F.col("t") / DAY_S))
    a = n.select(F.col("id").alias("i"), F.col("t").alias("ti"), "d")
    b = n.select(F.col("id").alias("j"), F.col("t").alias("tj"), F.explode(F.array(F.col("d"), F.col("d") + 1)).alias("d"))
    # each unordered pair is met once: in the later row's day
    near = a.join(b, "d").where(((F.col("ti") > F.col("tj")) | ((F.col("ti") == F.col("tj")) & (F.col("i") > F.col("j")))) & (F.col("ti") - F.col("tj") <= DAY_S))
    strength = 1.0 - F.lit(1.0 - min_strength) * (F.col("ti") - F.col("tj")) / DAY_S
    return near.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), strength.alias("strength"))


def auto_link(nodes: DataFrame, algorithms=("semantic", "category", "temporal"), min_strength: float = 0.5) -> DataFrame:
    """Edges (id, src, dst, strength, link_type, algorithm order) that the algorithms make."""
    d, out = data_nodes(nodes), None
    make = {
        "semantic": lambda: semantic_pairs(token_sets(d), min_strength),
        "category": lambda: category_pairs(d),
        "temporal": lambda: temporal_pairs(d, min_strength),
    }
    for k, name in enumerate(algorithms):
        if name not in make:
            continue
        part = make[name]().select(
            F.concat(F.lit("edge::"), "src", F.lit("::"), "dst").alias("id"), "src", "dst", F.col("strength").cast("double").alias("strength"), F.lit(name).alias("link_type"), F.lit(k).alias("step")
        )
        out = part if out is None else out.unionByName(part)
    return out if out is not None else d.sparkSession.createDataFrame([], "id string, src string, dst string, strength double, link_type string, step int")


def causal_edges(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(child, parent): ``causal_parent`` fields; causal edges count where a node has no field."""
    field = nodes.select(F.col("id").alias("child"), paths.lookup(nodes, "causal_parent").string.alias("parent")).where("coalesce(parent, '') != ''")
    if edges is None:
        return field
    linked = _sound(edges).where(F.col("link_type") == "causal").select(F.col("dst").alias("child"), F.col("src").alias("parent"))
    return field.unionByName(linked.join(field.select("child"), "child", "left_anti"))


def trace_ids(nodes: DataFrame, edges: DataFrame | None, root: str, max_depth: int = 50, direction: str = "backward") -> DataFrame:
    """(id, depth) over the causal graph, root first."""
    c = causal_edges(nodes, edges)
    steps = []
    if direction in ("backward", "both"):
        steps.append(c.select(F.col("child").alias("a"), F.col("parent").alias("b")))
    if direction in ("forward", "both"):
        steps.append(c.select(F.col("parent").alias("a"), F.col("child").alias("b")))
    e = steps[0] if len(steps) == 1 else steps[0].union(steps[1])
    e = cut(e.distinct())
    front = nodes.where(F.col("id") == root).select("id", F.lit(0).alias("depth")).limit(1)
    seen = front
    for hop in range(1, max_depth + 1):
        front = cut(front.join(e, front.id == e.a).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(hop).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def trace(nodes: DataFrame, edges: DataFrame | None, root: str, max_depth: int = 50, direction: str = "backward") -> DataFrame:
    return nodes.join(trace_ids(nodes, edges, root, max_depth, direction), "id").orderBy("depth", "id")
