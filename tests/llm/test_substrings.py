import hashlib
import random

import pytest

from quern.llm import substrings
from tests.conftest import SF

SCHEMA = "doc_id long, text string, block int, key string"


def brute(rows):
    """Every window of every document, in a dictionary."""
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, w in docs:
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            first[k] = min(first.get(k, (order(i), s)), (order(i), s))
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (order(i), s):
                gone |= set(range(s, s + 20))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def run(spark, rows):
    got = substrings.remove_repeats(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(repr(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("patterns, block", [(40_000, 2 << 20), (7, 900)])
def test_random_copies(spark, monkeypatch, patterns, block):
    monkeypatch.setattr(substrings, "PATTERNS", patterns)
    monkeypatch.setattr(substrings, "BLOCK", block)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    pool = [" ".join(rng.choices(words, k=rng.randint(15, 45))) for _ in range(6)]
    rows = []
    for i in rng.sample(range(1000), 40):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(2000, "same " * 70), (2001, "Same " * 30 + "same " * 25), (2002, "one two " * 40)]
    rows += [(5, None), (6, ""), (None, pool[0] + " " + pool[0]), (None, pool[1]), (3000, "é ü ö " * 30)]
    rows += [rows[0], (rows[1][0], pool[2] + " " + pool[3])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(repr(tuple(r)) for r in substrings.query(spark, SF).collect()) == brute(rows)
