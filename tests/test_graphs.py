"""Graph operators on hand-computed graphs."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import graph
from quern.plans.compiler import Engine
from quern.sources import store

NODES = [("n1", "dev", "rust async programming", 0.9), ("n2", "dev", "rust sync programming", 0.7), ("n3", "design", "ui layout wireframe", 0.5), ("n4", "dev", "python async scripting", 0.6), ("n5", "ops", "kubernetes deployment", 0.8), ("n6", "ops", "docker compose setup", 0.4)]
LINKS = [("n1", "n2", "related", 0.9), ("n2", "n3", "related", 0.5), ("n3", "n4", "blocks", 0.8), ("n1", "n4", "depends", 0.7), ("n5", "n6", "related", 0.9)]


LOCAL = graph.louvain_local


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(i, {"category": c, "text": t, "score": s}) for i, c, t, s in NODES]
    rows += [(f"e{k}", {"_edge": True, "from": a, "to": b, "label": lb, "strength": s}) for k, (a, b, lb, s) in enumerate(LINKS)]
    return Engine(store.nodes_from_json(spark, rows, "2024-01-01"))


def ids(r):
    return sorted(x.id for x in r.df.collect())


def test_neighbors(engine):
    assert ids(engine.dsl('graph_neighbors("n1")')) == ["n2", "n4"]
    assert ids(engine.dsl('graph_neighbors("n1", depth: 2)')) == ["n2", "n3", "n4"]
    assert ids(engine.dsl('graph_neighbors("n1", depth: 3, type: "related")')) == ["n2", "n3"]
    assert ids(engine.dsl('graph_neighbors("n4", bidirectional: true)')) == ["n1", "n3"]
    assert ids(engine.dsl('graph_neighbors("n1", depth: 0)')) == []
    assert ids(engine.dsl('graph_neighbors("n1", depth: 2) |> filter(category == "dev") |> sort(by: "score")')) == ["n2", "n4"]


def test_links_path_stats(engine):
    assert ids(engine.dsl("graph_links(min_strength: 0.8)")) == ["e0", "e2", "e4"]
    assert [r.id for r in engine.dsl('graph_path(from: "n1", to: "n3")').df.collect()] == ["n1", "n2", "n3"]
    assert ids(engine.dsl('graph_path(from: "n1", to: "n6")')) == []
    assert [r.id for r in engine.dsl('graph_path(from: "zz", to: "zz")').df.collect()] == ["zz"]
    s = graph.stats(engine.nodes, engine.edges).first()
    assert (s.node_count, s.edge_count, s.max_degree, s.orphan_count) == (6, 5, 2, 0) and s.avg_degree == pytest.approx(10 / 6) and s.density == pytest.approx(5 / 15)


def test_pagerank_against_numpy(engine):
    got = {r.id: r.pagerank_score for r in graph.pagerank(engine.nodes, engine.edges, 0.85, 20).collect()}
    ids_ = sorted(got)
    n, r = len(ids_), np.full(len(ids_), 1 / len(ids_))
    out = {i: [b for a, b, _, _ in LINKS if a == i] for i in ids_}
    for _ in range(20):
        new = np.full(n, 0.15 / n)
        for k, i in enumerate(ids_):
            for b in out[i] or ids_:
                new[ids_.index(b)] += 0.85 * r[k] / len(out[i] or ids_)
        r = new
    assert sum(got.values()) == pytest.approx(1) and [got[i] for i in ids_] == pytest.approx(list(r), abs=1e-12)
    top = engine.dsl('graph_pagerank(iterations: 3) |> sort(by: "pagerank_score", dir: "desc") |> limit(2)').df
    assert top.count() == 2


def test_clusters(engine):
    two = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w")]
    of = graph.louvain_local(np.array([a for a, _ in two]), np.array([b for _, b in two]), np.ones(len(two)))
    assert len({of[x] for x in "abcd"}) == 1 and len({of[x] for x in "wxyz"}) == 1 and of["a"] != of["w"]
    rows = engine.dsl('graph_clusters(algorithm: "louvain")').df.select("data.*").collect()
    assert sorted(x for r in rows for x in r.member_ids) == ["n1", "n2", "n3", "n4", "n5", "n6"] and all(0 <= r.coherence_score <= 1 for r in rows)
    sem = {tuple(r.member_ids) for r in graph.clusters(engine.nodes, engine.edges, "semantic").collect()}
    assert sem == {("n1", "n2", "n4"), ("n5", "n6")}


@pytest.mark.parametrize("held, piece", [(1 << 26, 1 << 20), (100, 7)])
def test_louvain_from_a_file_is_louvain_in_memory(spark, monkeypatch, held, piece):
    monkeypatch.setattr(graph, "HELD", held, raising=False)
    monkeypatch.setattr(graph, "PIECE", piece, raising=False)
    monkeypatch.setattr(graph, "louvain_local", None)  # no dicts of a whole component
    rng, rows = np.random.default_rng(3), []
    for g in range(4):
        for _ in range(150 if g else 0):  # links within six groups are likelier; some are loops, some are there twice
            a = int(rng.integers(60))
            b = int(rng.integers(60)) if rng.random() < 0.3 else (a + 6 * int(rng.integers(10))) % 60
            rows.append((f"g{g}n{a:02d}", f"g{g}n{b:02d}", float(rng.integers(1, 9))))
    rows += [("x", "x", 2.0), ("y", "z", 1.0)]
    frame = spark.createDataFrame(rows, "src string, dst string, strength double").selectExpr("*", "cast(null as double) as weight")
    got = {}
    for r in graph.louvain_members(frame).collect():
        got.setdefault(r.key, set()).add(r.id)
    src, dst, w = (np.array(c, object) for c in zip(*rows))
    want, of = {}, LOCAL(src, dst, w)
    for i, key in of.items():
        want.setdefault(key, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and 10 < len(got) < 120


def test_auto_link(engine, spark):
    d = graph.data_nodes(engine.nodes)
    assert graph.category_pairs(d).count() == 4
    pairs = {(r.src, r.dst): r.strength for r in graph.semantic_pairs(graph.token_sets(d), 0.5).collect()}
    assert pairs == {("n1", "n2"): pytest.approx(3 / 5)}
    rows = [(f"a{i:02d}", {"category": "alpha" if i < 25 else "beta"}) for i in range(50)]
    assert Engine(store.nodes_from_json(spark, rows)).dsl('auto_link(algorithms: ["category", "unknown"])').df.count() == 600


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=0, max_size=6), min_size=2, max_size=14), st.sampled_from([0.3, 0.5, 0.8, 1.0]))
def test_jaccard_join_like_all_pairs(spark, sets, t):
    rows = [(f"s{i:02d}", sorted(set(s))) for i, s in enumerate(sets)]
    got = {(r.src, r.dst): r.strength for r in graph.semantic_pairs(spark.createDataFrame(rows, "id string, tokens array<string>"), t).collect()}
    want = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if set(x) | set(y) and (j := len(set(x) & set(y)) / len(set(x) | set(y))) >= t:
                want[a, b] = pytest.approx(j)
    assert got == want


def test_trace(spark):
    rows = [("d1", {}), ("d2", {"causal_parent": "d1"}), ("d3", {"causal_parent": "d2"}), ("d4", {"causal_parent": "lost"}), ("d5", {})]
    rows += [("x1", {"_edge": True, "from": "d3", "to": "d5", "link_type": "causal"}), ("x2", {"_edge": True, "from": "d5", "to": "d2", "link_type": "causal"})]
    e = Engine(store.nodes_from_json(spark, rows))
    walk = lambda root, d: [(r.id, r.depth) for r in graph.trace(e.nodes, e.edges, root, 50, d).select("id", "depth").collect()]
    assert walk("d3", "backward") == [("d3", 0), ("d2", 1), ("d1", 2)]
    assert walk("d1", "forward") == [("d1", 0), ("d2", 1), ("d3", 2), ("d5", 3)]
    assert walk("d4", "backward") == [("d4", 0)] and walk("gone", "both") == []


def test_temporal_pairs(spark):
    t = [0, 3600, 86400, 86401, 200000, 286400]
    df = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(t)], "id string, s long").withColumn("timestamp", F.timestamp_seconds("s"))
    got = {(r.src, r.dst): r.strength for r in graph.temporal_pairs(df, 0.5).collect()}
    want = {(f"t{i}", f"t{j}"): pytest.approx(1 - 0.5 * (t[j] - t[i]) / 86400) for i in range(6) for j in range(i + 1, 6) if t[j] - t[i] <= 86400}
    assert got == want
    links = {r.id: (r.links, r.strength) for r in graph.temporal_links(df, 0.5).collect()}
    for i in range(6):
        own = [1 - 0.5 * abs(t[j] - t[i]) / 86400 for j in range(6) if j != i and abs(t[j] - t[i]) <= 86400]
        assert links[f"t{i}"] == (len(own), pytest.approx(sum(own)))


def test_compact_links_count_the_pairs(spark):
    rows = [(f"a{i:02d}", {"category": "alpha" if i < 9 else "beta", "text": " ".join("abcdefgh"[: 1 + i % 6])}) for i in range(15)] + [("z", {"text": "x"})]
    d = store.nodes_from_json(spark, rows)
    for pairs, compact in ((graph.category_pairs(d), graph.category_links(d)), (graph.semantic_pairs(graph.token_sets(d), 0.5), graph.semantic_links(d, 0.5))):
        n = {}
        for r in pairs.collect():
            n[r.src], n[r.dst] = n.get(r.src, 0) + 1, n.get(r.dst, 0) + 1
        assert {r.id: r.links for r in compact.collect() if r.links} == n and n
