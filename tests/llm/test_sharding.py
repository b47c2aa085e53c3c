import zlib
from collections import Counter

from quern.llm import sharding

SCHEMA = "doc_id long, text string, source string, rank string, b int, pos long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 1) for i, t, s in rows], SCHEMA)


def test_every_shard_holds_the_mixture(spark):
    rows = [(i, f"täxt {i}", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(997)] + [(None, None, None), (7, "", "s1"), (7, "", "s1")]
    got = sharding.interleave(docs(spark, rows), 10).collect()
    n, share, total = Counter(r.shard for r in got), Counter((r.shard, r.source) for r in got), Counter(r.source for r in got)
    assert len(got) == len(rows) and set(n.values()) <= {100}
    for (s, source), k in share.items():
        assert abs(k - total[source] / 10) <= 2
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    want = Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t, _ in rows)
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in got) == want


def test_placement_does_not_depend_on_dealing(spark):
    d = docs(spark, [(i, str(i), f"s{i % 4}") for i in range(300)])
    assert sorted(map(tuple, sharding.interleave(d).collect())) == sorted(map(tuple, sharding.interleave(d.repartition(9)).collect()))


def test_empty_and_fewer_rows_than_shards(spark):
    assert sharding.interleave(docs(spark, [])).count() == 0
    got = sharding.interleave(docs(spark, [(1, "a", "x"), (2, None, "y")])).collect()
    assert len({r.shard for r in got}) == 2 and {r.slot for r in got} == {0}


def test_place_keeps_rows_and_many_null_ids_are_dealt_out(spark):
    rows = [(None if i % 3 == 0 else i, f"t {i % 200}", f"s{i % 2}") for i in range(600)] + [(None, "same", "s0")] * 5
    d = docs(spark, rows).withColumnRenamed("b", "Shard")
    got = sharding.place(d, 6)
    assert got.columns == [c if c != "Shard" else "input_Shard" for c in d.columns] + ["shard", "slot"]
    got = got.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    plain = Counter((r.doc_id, r.source, r.text_crc32, r["size"], r.shard, r.slot) for r in sharding.interleave(d, 6).collect())
    assert plain == Counter((r.doc_id, r.source, zlib.crc32(r.text.encode()), len(r.text) + 8, r.shard, r.slot) for r in got)
