import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import nearest
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, axis int, q string"


def brute(rows, k=20):
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    out = {}
    for i in x:
        if i % 20 == 0:
            near = sorted(((-sum(a * b for a, b in zip(x[i], x[j])), j) for j in x if j != i and len(x[j]) == len(x[i])))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in rows], SCHEMA)


def test_rotation_keeps_inner_products():
    x = np.random.default_rng(0).normal(size=(5, 37))
    r = nearest.rotate(x, 1, 7)
    assert r.shape == (5, 64) and np.allclose(r @ r.T, x @ x.T)


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    rows = [(i, base[i % 60] * (1 + i % 3)) for i in range(150)] + [(400 + i, base[0]) for i in range(30)]
    got = found(nearest.search(frame(spark, rows), F.col("vec_id") % 20 == 0))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_edges(spark):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    ok = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (140, [1.0, 2.0, 3.0])]
    got = found(nearest.search(frame(spark, bad + ok), F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 0.5), (2, -1.0)]}
    assert nearest.search(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    x = np.array([v for _, v in rows]).astype(float)
    ids = np.array([i for i, _ in rows])
    got = found(nearest.query(spark, folder))
    recall = []
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = ids[np.lexsort([ids, -s])[: min(20, len(ids) - 1)]]
        assert len(got[q]) == len(want)
        recall.append(len(set(want) & {j for j, _ in got[q]}) / len(want))
    assert np.mean(recall) >= 0.9


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(2)
    base, far = rng.normal(size=16), rng.normal(size=(40, 16)) * 0.1
    rows = [(i, base) for i in range(1, 31)] * 2 + [(0, base * 0.9)] * 2 + [(50 + i, far[i]) for i in range(40)]
    got, want = found(nearest.search(frame(spark, rows), F.col("vec_id") == 0))[0], brute(dict(rows).items())[0]
    assert [j for j, _ in got] == [j for j, _ in want] == list(range(1, 21))
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-12)
    # one id with 30 vectors nearer than all others is one neighbour
    rows = [(0, base), (7, base * 3)] + [(7, base * (2 + i / 30)) for i in range(30)] + [(100 + i, base * (1 - i / 100)) for i in range(30)]
    got = found(nearest.search(frame(spark, rows), F.col("vec_id") == 0))[0]
    assert [j for j, _ in got] == [7, *range(100, 119)]


@pytest.mark.parametrize("norms", ["outlier", "varied"])
def test_recall_with_uneven_norms(spark, norms):
    rng = np.random.default_rng(3)
    n = 24_000  # a query probes 12 of 128 cells in a table where all norms are alike
    x = rng.normal(size=(n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "outlier":
        x[7] *= 10
    else:
        x *= rng.lognormal(0, 0.5, (n, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = found(nearest.search(df, F.col("vec_id") % 800 == 0))
    recall, x = [], x.astype(float)
    for q in range(0, n, 800):
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(set(np.argsort(-s)[:20].tolist()) & {j for j, _ in got[q]}) / 20)
    print(norms, np.mean(recall))
    assert np.mean(recall) >= 0.9


def test_share_of_rows_met_falls_as_the_table_grows():
    rng = np.random.default_rng(6)
    shares = []
    for n in (1_000, 4_000, 16_000, 64_000):
        x = rng.normal(size=(n, 32))
        bits = nearest.bits_of(n)
        tables, probes = nearest.tables_of(bits), nearest.probes_of(bits)
        own, probed = nearest.cells(x, bits, 1, tables), nearest.cells(x[:30], bits, probes, tables)
        assert own.shape == (n, tables) and probed.shape == (30, tables * probes)
        assert all(len(set(p)) == len(p) for p in probed.tolist()) and (own[:30, 0] == probed[:, 0]).all()
        assert ((own & ((1 << nearest.SHIFT) - 1)) < 1 << bits).all()
        shares.append(np.mean([np.isin(own, p).any(axis=1).mean() for p in probed]))
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.6 * shares[0]


def test_probes_are_the_best_sums_of_their_polytopes():
    x = np.random.default_rng(8).normal(size=(5, 16))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts = list(nearest._polytopes(unit, 9, 0, nearest.SEED))
    assert [p.shape[1] for p in parts] == [32, 16]
    found = nearest.cells(x, 9, 23, 1)
    for i in range(5):
        cost = [[(p[i].max() - v) ** 2 for v in p[i]] for p in parts]
        every = sorted((a + b, 16 * j + k) for j, a in enumerate(cost[0]) for k, b in enumerate(cost[1]))
        assert set(found[i].tolist()) == {c for _, c in every[:23]}


def test_repeated_rows_take_no_places_where_rows_are_hashed(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6_000, 16)).astype(np.float32)
    rows = [(i, x[0] if 1 <= i <= 25 else x[i]) for i in range(6_000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")
    alike = df.where("vec_id between 1 and 25")
    df = df.unionByName(alike).unionByName(alike)
    got = found(nearest.search(df, F.col("vec_id") == 0))
    assert nearest.probes_of(nearest.bits_of(6_000)) < 1 << nearest.bits_of(6_000)
    assert [j for j, _ in got[0]] == list(range(1, 21))


def test_hot_cells_are_dealt_out_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(2_400, 12))
    x[:800] = x[0] + rng.normal(size=(800, 12)) * 1e-3  # a third of all rows in a cell
    df = frame(spark, list(enumerate(x.astype(np.float32))))
    want = found(nearest.search(df, F.col("vec_id") % 20 == 0))
    monkeypatch.setattr(nearest, "ROWS", 64)
    monkeypatch.setattr(nearest, "QUERIES", 16)
    assert found(nearest.search(df, F.col("vec_id") % 20 == 0)) == want
