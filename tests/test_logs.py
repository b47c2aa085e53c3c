"""Timeline, merges, stores on disk, SQL compatibility, timers and streams."""

import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import merge
from quern.operators import procedures as pr
from quern.operators import timeline as tl
from quern.plans.sqlcompat import Database, rewrite
from quern.sources import store
from quern.streaming import changes, timers

REG = "soul string, field string, value_json string, state double"
register = st.tuples(st.sampled_from("ab"), st.sampled_from("xy"), st.sampled_from(['"p"', '"q"', "1"]), st.sampled_from([0.0, 1.0, 2.0]))


def regs(spark, rows):
    return spark.createDataFrame(rows, REG)


def seen(df):
    return {(r.soul, r.field): (r.value_json, r.state) for r in df.collect()}


@settings(max_examples=8, deadline=None)
@given(st.lists(register, max_size=6), st.lists(register, max_size=6), st.lists(register, max_size=6))
def test_lww_laws(spark, a, b, c):
    a, b, c = (regs(spark, x) for x in (a, b, c))
    assert seen(merge.lww(a, b)) == seen(merge.lww(b, a))
    assert seen(merge.lww(merge.lww(a, b), c)) == seen(merge.lww(a, merge.lww(b, c)))
    assert seen(merge.lww(a, a)) == seen(merge.lww(a))


def test_lww_golden(spark):
    a = regs(spark, [("s", "status", '"online"', 100.0), ("s", "score", "42", 100.0), ("s", "tie", '"a"', 5.0)])
    b = regs(spark, [("s", "status", '"offline"', 200.0), ("s", "size", '"large"', 50.0), ("s", "tie", '"b"', 5.0), ("s", "none", "1", None)])
    assert seen(merge.sync(a, b)) == {("s", "status"): ('"offline"', 200.0), ("s", "score"): ("42", 100.0), ("s", "size"): ('"large"', 50.0), ("s", "tie"): ('"b"', 5.0), ("s", "none"): ("1", 0.0)}


def test_replay_like_a_fold(spark):
    rng = random.Random(1)
    log = [(s, rng.choice("ab"), rng.choice(["Put", "Put", "Delete", "Checkpoint"]), f"k{rng.randrange(6)}", f"d{s}", rng.random() > 0.1, s // 7) for s in range(80)]
    df = spark.createDataFrame(log, "seq long, actor string, op string, id string, data string, valid boolean, segment long")
    for actor in (None, "a"):
        state = {}
        for s, who, op, i, d, ok, _ in log:
            if ok and actor in (None, who):
                if op == "Put":
                    state[i] = d
                elif op == "Delete":
                    state.pop(i, None)
        assert {r.id: r.data for r in merge.replay(df, actor).collect()} == state
    stats = merge.log_stats(df).first()
    assert stats.entries == 80 and stats.corrupted == sum(not r[5] for r in log)
    assert merge.compact(df, 30).agg(F.min("segment")).first()[0] == 30 // 7
    with pytest.raises(merge.Unhealthy):
        merge.rebuild(df)
    assert merge.rebuild(df.where("valid")).count() == merge.replay(df).count()


def test_timeline(spark):
    rows = [("e1", 10, "ann", "k", "info"), ("e2", 20, "bob", "k", "error"), ("e3", 20, "ann", "j", "debug"), ("e4", 30, "ann", "k", "warn")]
    t = spark.createDataFrame(rows, "id string, ts long, actor string, key string, level string")
    ids = lambda df: [r.id for r in df.collect()]
    built = {r.id: r.parent_id for r in tl.build(t, F.col("actor")).collect()}
    assert built == {"e1": None, "e2": "e1", "e4": "e2", "e3": None}
    assert ids(tl.history(t, "k", 2)) == ["e4", "e2"] and ids(tl.latest(t, "k")) == ["e4"]
    assert ids(tl.by_actor(t, "ann")) == ["e4", "e3", "e1"] and ids(tl.in_range(t, 10, 20)) == ["e2", "e3", "e1"]
    assert ids(tl.timeline(t, since=20, level="info")) == ["e4", "e2"]
    assert ids(tl.replay(t, "e2", "e4")) == ["e2", "e3", "e4"] and ids(tl.replay(t, "e4", "e1")) == [] and ids(tl.replay(t, "zz", "zz")) == ["e1", "e2", "e3", "e4"]
    assert tl.record(t.limit(0), t, "warn").count() == 2


def test_store_files(spark, tmp_path):
    df = store.nodes_from_json(spark, [(f"n{i}", {"v": i, "type": "t" if i % 2 else "u", "tags": ["x"] if i % 3 == 0 else []}) for i in range(25)], "2024-01-01")
    data = lambda d: {r.id: json.loads(r.j) for r in d.select("id", F.to_json("data").alias("j")).collect()}
    store.backup(df, f"{tmp_path}/b")
    assert data(store.restore(spark, f"{tmp_path}/b")) == data(df)
    manifest = store.snapshot(df, f"{tmp_path}/s", 10)
    assert manifest.agg(F.sum("n")).first()[0] == 25 and manifest.count() == 3
    assert data(store.restore_snapshot(spark, f"{tmp_path}/s")) == data(df)
    one = manifest.first()
    assert store.restore_snapshot(spark, f"{tmp_path}/s", [one.hash]).count() == one.n
    s = store.Store(df).define_type("t", {"v": "int"})
    assert [r.name for r in s.types().collect()] == ["t"] and s.instances("t").count() == 12 and json.loads(s.schema_of("t").first().schema) == {"v": "int"}
    assert s.select(tag="x", limit=3).count() == 3 and store.Store(df).scan_range("n2", "n3").count() == 6
    table = df.select("id", F.lit('a "b", c').alias("x"))
    store.write_csv(table, f"{tmp_path}/c")
    assert store.read_csv(spark, f"{tmp_path}/c", "id string, x string").where("x = 'a \"b\", c'").count() == 25
    blob = spark.createDataFrame([(bytearray(b"\x00\x00\x80\x3f\x00\x00\x00\x40"),), (bytearray(b"\x00\x00\xc0\x7f"),), (bytearray(b"\x01"),), (None,)], "v binary")
    assert [r.v for r in store.decode_vectors(blob, "v").collect()] == [[1.0, 2.0], None, None, None]


def test_clocks(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2},), (None,)], "c map<string,bigint>")
    got = [r[0] for r in df.select(store.bump(F.col("c"), "a")).collect()]
    assert got == [{"a": 2, "b": 2}, {"a": 1}]
    both = spark.createDataFrame([({"a": 1, "b": 5}, {"a": 3, "c": 1})], "x map<string,bigint>, y map<string,bigint>").select(store.merge_clocks(F.col("x"), F.col("y"))).first()[0]
    assert both == {"a": 3, "b": 5, "c": 1}


def test_sql(spark):
    db = Database(spark)
    db.register("users", spark.createDataFrame([(1, "Ann", 31, '{"a": [1, 2]}'), (2, "bob", 25, "{}"), (3, "Bea", 25, "{}")], "id int, name string, age int, j string"))
    assert [r.name for r in db.query("SELECT name FROM users WHERE name LIKE 'b%' AND age = ?1 ORDER BY id", [25]).collect()] == ["bob", "Bea"]
    assert db.get("SELECT GROUP_CONCAT(DISTINCT age) AS a FROM users WHERE age = 25") == {"a": "25"}
    assert db.get("SELECT json_extract(j, '$.a[1]') AS v FROM users WHERE id = ?", [True]) == {"v": "2"}
    assert db.columns("SELECT id, age FROM users") == ["id", "age"] and db.get("SELECT id FROM users WHERE id = 9") is None
    assert rewrite("SELECT 'x LIKE ?1', a LIKE 'b'") == "SELECT 'x LIKE ?1', a ILIKE 'b'"
    db.exec("CREATE VIEW IF NOT EXISTS young AS SELECT * FROM users WHERE age < 30; CREATE VIEW olds AS SELECT * FROM users WHERE age >= 30")
    assert db.query("SELECT * FROM young").count() == 2


def test_timers(spark):
    base = 1_704_067_200_000  # Monday, 2024-01-01 00:00:00 UTC
    assert timers.next_fire("*/15 * * * *", base) == base + 15 * 60_000
    assert timers.next_fire("30 0 9 * * 1-5", base) == base + (9 * 3600 + 30) * 1000
    assert timers.next_fire("0 12 1 2 *", base) == base + (31 * 86400 + 12 * 3600) * 1000
    assert timers.next_fire("0 0 30 2 *", base) is None
    for bad in ("* * *", "61 * * * *", "a * * * *", "*/0 * * * *"):
        with pytest.raises(timers.CronError):
            timers.parse_cron(bad)
    rows = [("i", "interval", 5000, None, base - 1, True), ("c", "cron", None, "0 * * * *", base, True), ("o", "once", None, None, base, True), ("x", "once", None, None, base, False), ("f", "interval", 5, None, base + 9, True)]
    df = spark.createDataFrame(rows, "id string, kind string, every_ms long, cron string, next_ms long, active boolean")
    assert {r.id for r in timers.due(df, base).collect()} == {"i", "c", "o"}
    after = {r.id: (r.next_ms, r.active) for r in timers.advance(df, base).collect()}
    assert after == {"i": (base + 5000, True), "c": (base + 3_600_000, True), "o": (base, False), "x": (base, False), "f": (base + 9, True)}
    assert [r[0] for r in spark.createDataFrame([(0,), (3,), (20,)], "n int").select(timers.retry_delay(F.col("n"))).collect()] == [1.0, 8.0, 300.0]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, "Delete" if s % 5 == 0 else "Put", f"k{s % 4}", "a", f"d{s}", f"2024-01-01 00:{s:02d}:00") for s in range(30)]
    df = spark.createDataFrame(rows, "seq long, op string, id string, actor string, data string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    for k in range(3):
        df.where(f"seq % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    q = changes.subscribe(changes.feed(spark, f"{tmp_path}/in", per_batch=1), lambda batch, n: got.extend(r.seq for r in batch.collect()), f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert sorted(got) == list(range(30))
    name = f"latest_{os.getpid()}"
    stream = changes.latest_state(changes.feed(spark, f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.id: r.data for r in changes.latest_state(df).collect()}
    assert {r.id: r.data for r in spark.table(name).collect()} == want
    windows = changes.windowed(df, "ts", [], "10 minutes").orderBy("window_start").collect()
    assert [r.n for r in windows] == [10, 10, 10]


def test_queue_zip_and_dispatch(spark):
    q = lambda n, d: spark.createDataFrame([(i, f"v{i}", d) for i in range(n)], "seq int, value string, depth int")
    assert [(r.k, r.value_0, r.value_1, r.depth) for r in changes.queue_zip([q(3, 1), q(2, 4)]).orderBy("k").collect()] == [(1, "v0", "v0", 5), (2, "v1", "v1", 5)]
    assert changes.queue_zip([q(3, 25)]).count() == 0
    e = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "event_type string, n int")
    out = changes.dispatch(e, {"a": lambda d: d, "b": lambda d: d})
    assert out["a"].count() == 2
    with pytest.raises(KeyError):
        changes.dispatch(e, {"a": lambda d: d})


def test_decisions(spark):
    rows = [("d1", "analytical", "accepted", "s1", None, "p1"), ("d2", "creative", "corrected", "s1", "d1", None), ("d3", "quick", "abandoned", "s2", "d2", None), ("d4", "analytical", "accepted", "s2", "d3", "p4")]
    d = spark.createDataFrame(rows, "id string, route string, outcome string, session_id string, causal_parent string, input_context string")
    a = pr.decision_audit(d).first()
    assert (a.total, a.accepted, a.corrected, a.abandoned, a.accuracy) == (4, 2, 1, 1, 0.5)
    assert pr.decision_audit(d.limit(0)).first().accuracy == 0.0
    # abandoned -1 reaches d2 as -0.9, which is larger than its -0.5; 1.0 stays at d1, the ends keep theirs
    assert {r.id: pytest.approx(r.reward) for r in pr.reward_signal(d).collect()} == {"d1": 1.0, "d2": -0.9, "d3": -1.0, "d4": 1.0}
    c = spark.createDataFrame([("c1", "bad", "good", "d1"), ("c2", " ", "good", "d1"), ("c3", "x", "y", "gone")], "id string, original_output string, corrected_output string, decision_id string")
    assert {(r.id, r.prompt, r.chosen, r.rejected) for r in pr.preference_pairs(c, d).collect()} == {("c1", "p1", "good", "bad"), ("c3", "", "y", "x")}
    assert [(r.route, round(r.factor, 2)) for r in pr.tune_routes(d, 0.7).collect()] == [("creative", 0.3), ("quick", 0.3)]
