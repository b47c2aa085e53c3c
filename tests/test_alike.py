"""Counts of similar sets against all pairs, with small and with large blocks."""

import numpy as np
import pytest

from quern.operators import alike


def sets(seed):
    rng, out = np.random.default_rng(seed), []
    for k in range(60):
        base = [f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 40)) % 200]
        out += [base] + [[w for w in base if rng.random() < 0.8] + [f"e{k}"] for _ in range(3)]
    return [(f"s{i:03d}", sorted(set(s))) for i, s in enumerate(out + out[:20] + [["x"]] * 9)] + [("none", [])]


@pytest.mark.parametrize("block,chunk", [(1 << 22, 1 << 20), (300, 50)])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 1.0])
def test_like_all_pairs(spark, monkeypatch, block, chunk, threshold):
    monkeypatch.setattr(alike, "BLOCK", block)
    monkeypatch.setattr(alike, "CHUNK", chunk)
    rows = sets(5)
    plain = [(i, set(s)) for i, s in rows if s]
    want = {(i, min(j for j, t in plain if t == s), sum(len(s & t) / len(s | t) >= threshold for j, t in plain if j != i)) for i, s in plain}
    got = alike.counted(spark.createDataFrame(rows, "id string, tokens array<string>"), threshold)
    assert {tuple(r) for r in got.collect()} == want and sum(w[2] for w in want) > 100


def test_a_pair_makes_no_row(spark):
    """A group of similar sets gives a row for each set, not for each pair."""
    rows = [(f"s{i:03d}", [*[f"w{k}" for k in range(50)], f"e{i}"]) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, tokens array<string>")
    plan = alike.counted(df, 0.5)
    seen = [r.links for r in plan.collect()]
    assert seen == [299] * 300 and "array_intersect" not in plan._jdf.queryExecution().toString()
