"""Near copies whose candidates' forest holds a link that is not confirmed."""

import numpy as np
import pytest

from quern.llm import simhash
from tests.llm.test_simhash import kept_by_brute_force


def variants(seed):
    """Ten texts of 200 words with one to four words edited: some pairs are just similar enough, some just not."""
    rng = np.random.default_rng(seed)
    base, out = [f"w{i}" for i in rng.integers(0, 600, 200)], []
    for _ in range(10):
        words = list(base)
        for p in rng.choice(200, rng.integers(1, 5), replace=False):
            words[p] = f"e{rng.integers(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_a_link_that_fails_hides_no_other(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rows = [(100 * seed + k, t) for seed in (1, 9, 44, 48, 61) for k, t in enumerate(variants(seed))]
    got = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == kept_by_brute_force(rows)


def test_pairs_of_different_groups():
    import pandas as pd

    rows = pd.DataFrame({"key": [1, 1, 1, 2, 2, 3], "part": 0, "value": 0, "a": [0, 1, -1, 0, 3, 0], "b": 0, "ga": [5, 6, 6, 5, 5, 7], "gb": 0, "n": [10, 9, 10, 10, 10, 10]})
    found = pd.concat(simhash._across(iter([rows[:4], rows[4:]])))
    assert found[["ua", "va"]].to_numpy().tolist() == [[0, 1]]  # not -1, which is far; not key 2, which is one group


@pytest.mark.parametrize("block", [1024, 3])
def test_a_group_gives_a_forest_and_not_its_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    base = list(range(100))
    held = [[*base[:90], 1000 + k] for k in range(12)] + [[*range(200, 300)], [*range(200, 299), 7]] + [[*base[:40], *range(500 + 50 * k, 550 + 50 * k)] for k in range(2)] + [[]]
    rows = [(f"{k:032d}", 0, k % 3, sorted(h)) for k, h in enumerate(held)]
    held = spark.createDataFrame([(r[0], r[3]) for r in rows], "node string, held array<long>")
    nodes = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "node string, a long, b long")
    tree = spark.createDataFrame([(r[0], "root", r[0]) for r in rows], "node string, root string, own string")
    found = [(int(r.u), int(r.v)) for r in simhash.united(tree, nodes, held).collect()]
    of = list(range(len(rows)))
    for u, v in found:
        of = [of[v] if x == of[u] else x for x in of]
    assert len(set(of[:12])) == 1 and len(set(of[12:14])) == 1 and len(set(of)) == 5
    assert len(found) == 12 if block == 1024 else len(found) <= 66  # 66 pairs of the first twelve alone, and one
    joined = tree.selectExpr("node", "root", "'one' as own")
    assert simhash.united(joined, nodes, held).count() == 0


def test_components_read_no_more_links_than_sketches(spark, monkeypatch):
    components, read = simhash.components, []

    def counted(edges):
        read.append((edges.count(), edges.selectExpr("explode(array(u, v)) as u").distinct().count()))
        return components(edges)

    monkeypatch.setattr(simhash, "components", counted)
    rows = [(100 * seed + k, t) for seed in (1, 9, 44) for k, t in enumerate(variants(seed))]
    got = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == kept_by_brute_force(rows)
    assert len(read) > 1 and all(links < ends for links, ends in read)


@pytest.mark.parametrize("at_once", [1 << 19, 40])
def test_stars_connect_what_links_connect(spark, monkeypatch, at_once):
    monkeypatch.setattr(simhash, "LINKS", at_once, raising=False)
    pairs = [(f"{g}{i:02d}", f"{g}{j:02d}") for g in "ab" for i in range(30) for j in range(i)] + [("c1", "c0")]
    edges = spark.createDataFrame(pairs, "u string, v string")
    found = simhash.starred(edges)
    assert found.count() == 59 if at_once > 999 else 59 < found.count() < len(pairs)
    got = {(r.node, r.root) for r in simhash.components(found).collect()}
    assert got == {(r.node, r.root) for r in simhash.components(edges).collect()} and len(got) == 59
    assert simhash.starred(edges.limit(0)).count() == 0
