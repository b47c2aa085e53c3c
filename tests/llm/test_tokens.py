import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import common, tokens
from quern.llm.elias_fano import EliasFano
from tests.conftest import SF

SCHEMA = "doc_id long, text string, start int, path string"
TEXTS = [None, "", "Hello, world!! Don't  stop.\n\tÉté été <|endoftext|>. it's I'LL x1.5 ... a.b, (c). naïve İstanbul ΣΑΣ    a\x1cb 漢字。"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=700))
def test_elias_fano(gaps):
    v = np.cumsum(gaps)
    ef, end = EliasFano.from_bytes(memoryview(b"xx" + EliasFano.build(v).to_bytes()), 2)
    assert (ef.decode() == v).all()
    for i in range(0, len(v), 1 + len(v) // 9):
        assert ef.select(i) == v[i]
    assert len(ef.low) + len(ef.high) + 4 * len(ef.samples) <= len(v) * (2 + np.log2(v[-1] / len(v) + 2)) / 8 + len(v) / 50 + 16


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abZé'.,!? \n\t1(<|>sſ́ ")), max_size=40))
def test_encoding_is_the_librarys(text):
    enc = tokens.encoder(tokens.vocabulary())
    assert enc.by_words and enc.plain
    want = enc.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == want


def brute(rows):
    from tokenizers import Tokenizer

    tk, out, start = Tokenizer.from_file(tokens.vocabulary()), [], 0
    for doc_id, text in rows:
        ids = tk.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("limit", [1, 50, 4_000_000])
def test_round_trip(spark, monkeypatch, limit):
    rows = [(7 * i % 101, f"Text number {i}. " * (i % 5)) for i in range(40)] + list(enumerate(TEXTS, 200)) + [(None, "no id"), (300, "word " * 300_000)]
    monkeypatch.setattr(tokens, "FILE_IDS", limit if limit > 1 else 30)
    folder = f"{common.shared_dir(spark)}/t-{limit}"
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA).repartition(3)
    got = tokens.read(spark, folder, tokens.write(d, tokens.vocabulary(), folder)).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute(sorted(rows, key=lambda r: -1 if r[0] is None else r[0]))


def test_documents_by_select():
    data = tokens.pack_file([None, 3, 3], [b"\1\0\2\0", b"", b"\7\0"], 2)
    f = tokens.TokenFile(data)
    assert f.doc_ids == [None, 3, 3] and [f.document(i).tolist() for i in range(3)] == [[1, 2], [], [7]]


def test_empty(spark):
    folder = f"{common.shared_dir(spark)}/t-none"
    assert tokens.read(spark, folder, tokens.write(spark.createDataFrame([], SCHEMA), tokens.vocabulary(), folder)).count() == 0


def test_query(spark):
    got = tokens.query(spark, SF).orderBy("start").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert [tuple(r) for r in got] == brute(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 1 << 62)), min_size=1, max_size=600))
def test_select_of_many(values):
    v = np.sort(np.array(values, np.uint64))
    ef, _ = EliasFano.from_bytes(memoryview(EliasFano.build(v).to_bytes()))
    at = np.arange(len(v))
    assert (ef.select_many(at) == v).all() and (ef.select_many(at[::-3]) == v[::-3]).all()
    assert all(ef.select(i) == int(v[i]) for i in range(0, len(v), 1 + len(v) // 5))


def test_document_ids_of_any_size():
    ids = [None, None, -(1 << 63), -5, 0, 7, 7, (1 << 63) - 1]
    assert tokens.TokenFile(tokens.pack_file(ids, [b"\1\0"] * len(ids), 2)).doc_ids == ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30))
def test_encoding_of_any_text_is_the_librarys(text):
    enc = tokens.encoder(tokens.vocabulary())
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
