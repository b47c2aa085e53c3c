import numpy as np
import pytest

from quern.llm import common, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, skey int, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "x") for i, t, s in rows], SCHEMA)


def water(sizes, weights, share=1.5, cap=2.0):
    """Excess shared again by weight until no source is above its cap, round by round."""
    goal, full = sum(sizes) * share, set()
    while True:
        rest = goal - sum(cap * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        t = [cap * sizes[i] if i in full else rest * weights[i] / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in full and t[i] > cap * sizes[i]}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize("sizes", [[10, 200, 30, 5], [100, 100, 100], [7], [1000, 1, 1, 1, 500], [0, 5, 0, 9]])
def test_allot_is_resharing_by_weight(spark, sizes):
    df = spark.createDataFrame([(f"\x00s{i}", s, 1) for i, s in enumerate(sizes)], "skey string, source_size long, blocks long")
    got = [r.target for r in mixing.allot(df).orderBy("skey").collect()]
    assert got == pytest.approx(water(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]))


def test_flight_keeps_totals_and_probabilities():
    rng = np.random.default_rng(1)
    size, p = rng.integers(0, 500, 400), rng.random(400)
    out = mixing.flight(size, p, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    mean = np.mean([mixing.flight(size[:5], p[:5], rng) for _ in range(3000)], axis=0)
    assert np.allclose(mean, p[:5], atol=0.05)  # a martingale


def test_mix_meets_targets_and_agrees_with_itself(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "MEET", 4)
    rows = [(i, "w " * (i * 37 % 90), f"s{i % 5 if i % 3 else 0}") for i in range(900)] + [(5000, None, None), (5001, "a b", None)]
    got = mixing.mix(docs(spark, rows)).collect()
    again = mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.copies <= 2
        by.setdefault(r.source_size, []).append(r)
    for rs in by.values():
        taken, target, most = sum(r.size * r.copies for r in rs), rs[0].target, max(r.size for r in rs)
        assert abs(taken - target) <= most


def test_repeat_rows(spark):
    rows = [(i, f"t {i}", "a") for i in range(30)] + [(99, "same same", "b")] * 7 + [(None, None, None)] * 2
    d = docs(spark, rows)
    mixed = common.staged(mixing.mix(d), "t")
    out = mixing.repeat_rows(d, mixed)
    assert out.columns == d.columns
    assert out.count() == sum(r.copies for r in mixed.collect())


def test_empty(spark):
    assert mixing.mix(docs(spark, [])).count() == 0


def test_pipeline(spark):
    from pyspark.sql import functions as F

    import corpus_pipeline as cp
    from tests.conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        out = common.staged(stage(spark, docs, SF), name)
        assert 0 < out.count() <= 2 * docs.count()
        assert out.columns == docs.columns + (["shard", "slot"] if name == "shard" else [])
        docs = out
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, docs.collect()))
    few = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    clash = few.withColumns({n: F.lit("x") for n in ("row", "uid", "i", "c", "n", "copy", "times", "leaks", "found", "fp", "skey", "size", "rank")})
    for name, stage in cp.STAGES:
        assert stage(spark, few.limit(0), SF).count() == 0
        assert stage(spark, clash, SF).count() == stage(spark, few, SF).count()


def test_row_identity(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(
        [("en", None, {"a": 1}, [1, None]), (None, "en", {"a": 1}, [1, None]), ("en", None, {"a": 2}, [1, None]), ("en", None, {"a": 1}, [None, 1]), ("en", None, None, [1, None]), ("en", None, {"a": 1}, [1, None])],
        "lang string, source string, m map<string,int>, v array<int>",
    )
    got = [r.uid for r in rows.select(common.row_uid(rows).alias("uid")).collect()]
    assert len(set(got)) == 5 and got[0] == got[5] and all(len(u) == 32 for u in got)
    assert common.whole_rows(rows).count() == 5
    counted = spark.createDataFrame([("a", 7), ("b", 0), ("c", 1)], "uid string, n int")
    assert sorted((r.uid, r.i) for r in common.repeated(counted, "n", "i", 3).collect()) == [("a", i) for i in range(7)] + [("c", 0)]
    mixed = spark.createDataFrame([(got[0], 2), (got[5], 0), (got[1], 1)], "uid string, copies int")
    out = mixing.repeat_rows(rows, mixed).groupBy(F.col("lang").alias("l"), "source").count().collect()
    assert sorted(map(str, out)) == sorted(map(str, [type(out[0])(l="en", source=None, count=2), type(out[0])(l=None, source="en", count=1)]))


def test_large_ids_beside_null_ids(spark):
    big = (1 << 60) + 1
    got = mixing.mix(docs(spark, [(big, "a b c", "s"), (None, "a b", "s"), (big + 1, "x", "s")])).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["None", str(big), str(big + 1)])


def test_query_against_brute_force(spark):
    """Sizes, targets and bounds of every row of a whole table, and the totals of sources, from plain Python."""
    import re

    from tests.conftest import SF

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    names = sorted({r.source for r in rows if r.source is not None}, key=lambda s: [ord(c) for c in s]) + [None] * any(r.source is None for r in rows)
    total = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in names}
    target = dict(zip(names, water([total[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))])))
    source = {r.doc_id: r.source for r in rows}
    got = mixing.query(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken, count, expected = dict.fromkeys(names, 0), dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == total[s] and r.target == pytest.approx(target[s])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"] and r.copies in (int(target[s] / total[s] + 1e-9), int(target[s] / total[s] + 1e-9) + 1)
        taken[s] += r.taken
        count[s] += r.copies
        expected[s] += target[s] / total[s]
    most = {s: max(size[i] for i in size if source[i] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 and abs(count[s] - expected[s]) <= 2 for s in names)
