import random

import numpy as np
import pytest
import xxhash

from quern.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string, root int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], SCHEMA)


def brute_fingerprint(text):
    b = (text or "").encode().lower().split()
    if not b:
        return 0
    sh = [b" ".join(b[i : i + 3]) for i in range(max(1, len(b) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def brute_components(fps):
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if comp[b] < comp[a] and (fps[a] ^ fps[b]).bit_count() <= 3:
                    comp[a], changed = comp[b], True
    return comp


def test_fingerprint(monkeypatch):
    texts = [None, "", "  \t", "One", "one TWO", "a b c", "a  b\nc d\xa0e É", "x " * 500, "ä Ö " * 9 + "end"]
    monkeypatch.setattr(simhash, "PIECE", 7)  # pieces must not change a fingerprint
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_anchors_reach_every_link(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(120):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(3):
            for k in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << k
            fps.add(x)
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    for hot in (4096, 1):
        simhash.HOT = hot
        edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
        found = {r.node: r.root for r in simhash.components(edges).collect()}
        want = brute_components(signed)
        assert {s: found.get(s, s) for s in signed} == want
    simhash.HOT = 4096


def test_forest_of_a_large_anchor():
    rng = np.random.default_rng(0)
    fps = np.unique(np.array([sum(1 << int(k) for k in rng.choice(12, 3, replace=False)) for _ in range(300)], np.uint64))
    edges = simhash._forest(fps, np.ones(len(fps), bool))
    assert len(edges) == len(fps) - len(set(brute_components(dict(enumerate(fps.tolist()))).values()))


def test_labels_and_dedup(spark):
    base = " ".join(f"word{i * 7 % 1000}" for i in range(400))
    rows = [(5, base), (3, base + " tail"), (9, base.upper()), (1, "quite another text of some words"), (2, None), (4, ""), (5, base), (None, "lonely one here"), (None, None)]
    got = simhash.label(docs(spark, rows)).collect()
    fps = {k: brute_fingerprint(t) for k, (_, t) in enumerate(rows)}
    comp = brute_components(fps)
    assert len(got) == len(rows) and len({r.root for r in got}) == len(set(comp.values()))
    kept = simhash.dedup(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "fp", "root"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["3", "1", "2", "None"])


def test_empty(spark):
    assert simhash.label(docs(spark, [])).count() == 0 and simhash.dedup(docs(spark, [])).count() == 0


def test_query(spark):
    from tests.conftest import SF

    got = {r.doc_id: r for r in simhash.query(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    comp = brute_components(fps)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def edited(rng, words, share):
    out = list(words)
    for p in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[p] = f"edit{rng.integers(10**6)}"
    return out


def plain_sets(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def kept_by_brute_force(rows):
    """The smallest id of every group that five-word similarity of 0.8 joins, by comparing all pairs."""
    sets, parent = [plain_sets(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] == sets[j] or same and same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append((d is None, d))
    return sorted(min(g)[1] for g in groups.values() if not min(g)[0])


@pytest.mark.parametrize("hot", [4096, 40])
def test_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(600)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, "Two words"), (5, "two WORDS"), (6, "one two three four five six"), (7, "one two three four five seven")]
    for k in range(60):
        base = rng.choice(vocabulary, rng.integers(60, 400)).tolist()
        rows.append((100 + 20 * k, " ".join(base)))
        for c, share in enumerate([0.004, 0.01, 0.015, 0.05, 0.1][: rng.integers(0, 6)]):
            rows.append((101 + 20 * k + c, " ".join(edited(rng, base, share))))
    base = rng.choice(vocabulary, 300).tolist()
    rows += [(5000 + k, " ".join(edited(rng, base, 0.012))) for k in range(120)]  # a large group of near copies
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    d = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], "doc_id long, text string, uid string, node string, a int")
    got = simhash.dedup(d)
    assert got.columns == d.columns
    got, want = sorted(r.doc_id for r in got.collect()), kept_by_brute_force(rows)
    assert set(want) <= set(got)  # nothing goes that should stay
    assert len(rows) - len(got) >= 0.95 * (len(rows) - len(want))


def test_least_tree_joins_what_a_path_of_close_links_joins():
    rng = np.random.default_rng(4)
    for _ in range(20):
        base = rng.integers(0, 1 << 63, 3).astype(np.uint64)
        flip = lambda x, k: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64))
        a = np.array([flip(base[i % 3], int(rng.integers(1, 14))) for i in range(40)], np.uint64)
        b = np.zeros(40, np.uint64)
        edges = simhash._least_tree(a, b)
        near = {(i, j) for i in range(40) for j in range(i) if np.bitwise_count(a[i] ^ a[j]) <= simhash.NEAR}
        assert {(max(e), min(e)) for e in edges} <= near

        def groups(links):
            parent = list(range(40))

            def root(i):
                return i if parent[i] == i else root(parent[i])

            for i, j in links:
                parent[root(i)] = root(j)
            return [root(i) == root(j) for i in range(40) for j in range(i)]

        assert groups(edges) == groups(near) and len(edges) == len({tuple(sorted(e)) for e in edges})
