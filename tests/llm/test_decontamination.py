import numpy as np

from quern.llm import decontamination as dec
from tests.conftest import SF

DOCS = "doc_id long, text string, item_id string, coverage int"
ITEMS = "item_id long, text string, doc_id int"
ITEM = "the quick brown fox jumps over a lazy dog while seven wise owls look down from their old oak tree tonight"


def brute_tile(a, b, least):
    """Greedy string tiling by trying every pair of positions."""
    fa, fb, total = [x >= 0 for x in a], [x >= 0 for x in b], 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and fa[i + k] and fb[j + k] and a[i + k] == b[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return total
        total += k
        fa[i : i + k] = fb[j : j + k] = [False] * k


def test_tiles_like_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a = rng.integers(0, 6, rng.integers(3, 60))
        b = np.concatenate([rng.integers(-1, 6, 15), np.roll(a, rng.integers(0, 9))[: rng.integers(1, 60)], rng.integers(0, 6, 15)])
        tiles = dec.tile(a, b, 3)
        for k, i, d in tiles:
            assert (a[i : i + k] == b[d : d + k]).all()
        used = [p for k, i, _ in tiles for p in range(i, i + k)]
        assert len(used) == len(set(used))
        assert abs(sum(k for k, _, _ in tiles) - brute_tile(a.tolist(), b.tolist(), 3)) <= 3  # equal lengths may be taken in another order


def test_leaks(spark):
    w = ITEM.split()
    moved = " ".join(w[10:] + ["filler"] + w[:10])
    rows = [(1, f"some text before {ITEM.upper()}! and after"), (2, moved), (3, " ".join(w[:12])), (4, None), (5, ""), (6, "Tiny item."), (7, "x " * 300_000 + ITEM), (8, "nothing of it"), (None, ITEM), (1, ITEM)]
    docs = spark.createDataFrame([(i, t, "q", 0) for i, t in rows], DOCS)
    items = spark.createDataFrame([(10, ITEM, 1), (11, "tiny item", 1), (12, None, 1), (13, " ", 1), (14, ITEM, 1)], ITEMS)
    got = sorted((str(r.doc_id), r.item_id) for r in dec.contaminated(spark, docs, items).collect())
    hit = ["1", "1", "2", "7", "None"]
    assert got == sorted([(d, i) for d in hit for i in (10, 14)] + [("6", 11)])
    kept = dec.clean(spark, docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]
    assert dec.contaminated(spark, docs, items.limit(0)).count() == 0 and dec.clean(spark, docs, items.limit(0)).count() == len(rows)
    assert dec.contaminated(spark, docs.limit(0), items).count() == 0


def test_query_against_brute_force(spark):
    got = {(r.doc_id, r.item_id) for r in dec.query(spark, SF).collect()}
    docs = {r.doc_id: dec.words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: dec.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for d, dw in docs.items():
        grams = {tuple(dw[k : k + 5]) for k in range(len(dw) - 4)}
        for i, iw in items.items():
            seeds = [tuple(iw[k : k + 5]) in grams for k in range(max(0, len(iw) - 4))]
            # upper bound on coverage: words in seeds
            cover = {p for k, hit in enumerate(seeds) if hit for p in range(k, k + 5)}
            if len(cover) >= 0.8 * len(iw) and len(iw) >= 5:
                ids = {w: n for n, w in enumerate(sorted(set(dw) | set(iw)))}
                keep = set(iw)
                a, b = [ids[w] for w in iw], [ids[w] if w in keep else -1 for w in dw]
                if brute_tile(a, b, 5) >= 0.8 * len(iw):
                    want.add((d, i))
    assert got == want and got


def test_repeated_rows_and_a_seed_that_all_share(spark):
    common = "of the first and the last of them all"
    rows = [(i, f"{common} word{i} {ITEM if i % 50 == 0 else ''} {common}") for i in range(200)] + [(50, f"{common} word50 {ITEM} {common}")] * 2
    items = [(i, f"{common} question{i} with some more words {i}x {i}y {i}z {i}w {i}v {i}u") for i in range(30)] + [(99, ITEM), (99, ITEM)]
    docs = spark.createDataFrame([(i, t, "q", 0) for i, t in rows], DOCS)
    got = [(r.doc_id, r.item_id) for r in dec.contaminated(spark, docs, spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)).collect()]
    assert sorted(got) == sorted([(d, 99) for d in (0, 50, 50, 50, 100, 150)] * 2)
    assert dec.clean(spark, docs, spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)).count() == 196
