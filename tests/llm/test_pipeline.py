"""Each stage of the corpus pipeline against plain Python over the stage's own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import common, decontamination, langid, mixing, sharding
from tests.conftest import SF
from tests.llm.test_decontamination import brute_tile
from tests.llm.test_langid import plain_inference
from tests.llm.test_mixing import water
from tests.llm.test_simhash import kept_by_brute_force, plain_sets


@pytest.fixture(scope="module")
def stages(spark):
    """(rows in, rows out) of each stage."""
    docs, out = common.read_table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.staged(stage(spark, docs, SF), name)
        assert after.columns == docs.columns + (["shard", "slot"] if name == "shard" else [])
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_language_id(stages):
    before, after = stages["language_id"]
    counts = {}
    for r in before:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            at, n = langid.trigrams(r.text)
            counts.setdefault(r.lang, Counter()).update(dict(zip(at.tolist(), n.tolist())))
    assert ids(after) == sorted(r.doc_id for r in before if plain_inference(counts, r.text)[2])


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    want, got = set(kept_by_brute_force([(r.doc_id, r.text) for r in before])), set(ids(after))
    assert want <= got and len(before) - len(got) >= 0.9 * (len(before) - len(want))
    assert len({frozenset(plain_sets(r.text)) for r in after}) == len(after)  # no equal texts are left


def test_decontaminate(stages, spark):
    before, after = stages["decontaminate"]
    items = [decontamination.words(r.text) for r in common.read_table(spark, SF, "benchmark").collect()]
    kept = []
    for r in before:
        words = decontamination.words(r.text)
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        leaks = False
        for item in items:
            s = min(5, len(item))
            cover = {p for i in range(len(item) - s + 1) if s < 5 or tuple(item[i : i + s]) in grams for p in range(i, i + s)}
            if s and len(cover) >= 0.8 * len(item):
                number = {w: k for k, w in enumerate(set(item))}
                leaks |= brute_tile([number[w] for w in item], [number.get(w, -1) for w in words], s) >= 0.8 * len(item)
        if not leaks:
            kept.append(r.doc_id)
    assert ids(after) == sorted(kept)


def test_mix_sources(stages):
    before, after = stages["mix_sources"]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted({r.source for r in before}, key=lambda s: (s is None, s or ""))
    total = [sum(size(r) for r in before if r.source == s) for s in names]
    target = dict(zip(names, water(total, [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    n, most = Counter(r.doc_id for r in after), {s: max(size(r) for r in before if r.source == s) for s in names}
    for s, t in zip(names, total):
        low = int(target[s] / t + 1e-9)
        assert all(n[r.doc_id] in (low, low + 1) for r in before if r.source == s)
        assert abs(sum(size(r) for r in after if r.source == s) - target[s]) <= most[s] / 2 + 1


def test_shard(stages):
    before, after = stages["shard"]
    assert Counter(map(tuple, before)) == Counter(tuple(r)[:-2] for r in after)
    n = Counter(r.shard for r in after)
    assert set(n) == set(range(sharding.N_SHARDS)) and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r.slot for r in after if r.shard == s) == list(range(n[s])) for s in n)
    share = Counter(r.source for r in after)
    for s in n:
        own = Counter(r.source for r in after if r.shard == s)
        assert all(abs(own[x] - share[x] / sharding.N_SHARDS) <= 2 for x in share)


def test_run_is_its_stages(stages, spark):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages["shard"][1]))
    assert np.array([r.text is not None for r in stages["shard"][1]]).all()
