import math
from collections import Counter

import numpy as np
import pytest

from quern.llm import langid
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def test_held_out_accuracy(spark):
    got = langid.query(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = [r for r in got if r.held_out]
    assert len(got) == len(truth) and len(out) > 30
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_proportions(spark):
    rows = [(i, "the house and the garden of the " * 3, "en") for i in range(20)] + [(i, "der garten und das haus zu der ", "de") for i in range(20, 60)]
    m = langid.fit(spark.createDataFrame([(i, t, g, "s", "x") for i, t, g in rows], SCHEMA))
    assert m.infer("the house and the garden " * 8)[0] == "en"
    lang, share, _ = m.infer("der garten und das haus " * 8 + "the house of the garden " * 5)
    assert lang == "de" and 0.5 < share < 0.75
    long = "the garden of the house " * 40_000
    assert m.infer(long) == ("en", 1.0, True)


def test_edges(spark):
    rows = [(1, "une maison", "fr"), (None, "one house", "en"), (3, None, "en"), (4, "", "fr"), (5, "123 !?", "en"), (6, "maison", None), (6, "maison", None)]
    d = spark.createDataFrame([(i, t, g, "s", "x") for i, t, g in rows], SCHEMA)
    m = langid.fit(d)
    found = {r.text: r.f for r in d.select("text", langid.predict(spark, m, d.text).alias("f")).collect()}
    assert found[None].lang == found[""].lang == found["123 !?"].lang == "und" and found[None].score == 0
    assert found["maison"].lang == "fr"
    kept = langid.accepted(spark, d)
    assert kept.columns == d.columns and sorted(r.text for r in kept.collect()) == ["maison", "maison", "one house", "une maison"]
    none = d.limit(0)
    assert langid.fit(none).infer("a text") == ("und", 0.0, True) and langid.accepted(spark, none).count() == 0


def plain_inference(counts, text):
    """EM and the penalised choice in plain Python, over the buckets of a text."""
    at, n = langid.trigrams(text)
    langs = sorted(counts)
    if not len(at) or not langs:
        return "und", 0.0, bool(len(at))
    n = dict(zip(at.tolist(), n.tolist()))
    total = sum(n.values())
    p = {g: {b: (counts[g][b] + langid.SMOOTH) / (sum(counts[g].values()) + langid.SMOOTH * langid.D) for b in n} for g in langs}

    def em(mix):
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(mix, 0.0)
            for b, k in n.items():
                whole = sum(mix[g] * p[g][b] for g in mix)
                for g in mix:
                    new[g] += k * mix[g] * p[g][b] / whole / total
            moved, mix = max(abs(new[g] - mix[g]) for g in mix), new
            if moved < langid.CLOSE:
                break
        return mix, sum(k * math.log(sum(mix[g] * p[g][b] for g in mix)) for b, k in n.items()) / langid.OVERLAP

    mix, _ = em({g: 1 / len(langs) for g in langs})
    order, best = sorted(langs, key=lambda g: (-mix[g], g)), None
    for size in range(1, max(1, sum(v > 0.01 for v in mix.values())) + 1):
        some = order[:size]
        share, fit = em({g: mix[g] / sum(mix[h] for h in some) for g in some})
        value = fit - size * 0.5 * math.log(total + 1)
        if best is not None and value <= best[0]:
            break
        best = (value, share)
    top = max(best[1], key=lambda g: best[1][g])
    return top, min(1.0, best[1][top]), best[0] > -total * math.log(langid.D) / langid.OVERLAP


def test_query_against_a_plain_implementation(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    import zlib

    counts = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            at, n = langid.trigrams(r.text)
            counts.setdefault(r.lang, Counter()).update(dict(zip(at.tolist(), n.tolist())))
    got = {r.doc_id: r for r in langid.query(spark, SF).collect()}
    for r in rows[:120]:
        lang, score, _ = plain_inference(counts, r.text)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == (lang, pytest.approx(score, abs=1e-9))


def test_long_texts_have_the_trigrams_of_the_whole(monkeypatch):
    text = "Straße ÉTÉ ΟΔΟΣ  a1b " * 1500
    whole = [x.tolist() for x in langid.trigrams(text)]
    for piece in (1000, 997, 64):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert [x.tolist() for x in langid.trigrams(text)] == whole


def test_many_labels_and_noise(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7))
    rows = [(i, "the house and the garden of the " * 5, "en") for i in range(20)] + [(i, "der garten und das haus zu der " * 5, "de") for i in range(20)]
    rows += [(i, word(), f"junk{i}") for i in range(500)] + [(7, "Qxzv wjkq vvkx zzqj xkcd jqqw bvnx wqzz kjxv", None), (8, "the garden", None)]
    d = spark.createDataFrame([(i, t, g, "s", "x") for i, t, g in rows], SCHEMA)
    m = langid.fit(d)
    assert len(m.langs) == 502 and len(m.n) < 20_000
    lang, share, likely = m.infer("der garten und das haus " * 8 + "the house of the garden " * 5)
    assert lang == "de" and 0.5 < share < 0.75 and likely
    assert not m.infer(rows[-2][1])[2] and m.infer(rows[-1][1])[2]
    nothing = d.where("lang is null")
    assert langid.accepted(spark, nothing).count() == 2
