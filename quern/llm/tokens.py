"""Token ids in a binary format with Elias-Fano document boundaries.

A file holds the ids of consecutive documents in one array of 16-bit numbers (32-bit if the
vocabulary needs it), and two Elias-Fano codes with select structures: of the documents' ids, less the
least, and of the array offsets at which documents begin. Files are written in ascending document order:
rows are range-partitioned by id (and by a digest of the text, so that equal ids can be dealt out), and
each task writes files of bounded size under names that depend on its place in that order alone. A task
that is run again writes the same bytes under the same names.

File: ``QTOK2``, id width in bytes, number of documents, number of leading null document ids, the least
document id (signed), the code of the other document ids, the code of the n + 1 boundaries, the ids.

Encoding is that of the ``tokenizers`` library without special tokens of its own. Ids of words that were
met before are kept if the tokenizer never joins over white space: its normalizer works on each run
between white space by itself, no added token holds or strips white space, nothing is cut or padded, and
all pairs of kinds of characters encode the same with each white space between them as apart. Words of
letters alone go to the model directly if its pieces are bytes of letter runs. Each of this is checked
(``Encoder``); a tokenizer for which it does not hold encodes whole texts.

Defined cases: a null text is empty and has the end id alone; documents with a null id come first;
documents with equal ids are ordered by text digest, then text, so repeated rows stand together; very long texts are encoded piece by
piece; an empty table writes no file. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common
from quern.llm.elias_fano import EliasFano

MAGIC, HEAD, END = b"QTOK2", "<BQQq", 2
#: Ids in a file, words whose ids are kept twice (in use, and those before), and bytes of a text that are cut into words at once.
FILE_IDS, KEPT, PIECE = 4_000_000, 150_000, 1 << 20
_ENCODERS: dict[str, "Encoder"] = {}


#: Normalizer steps that treat each run between white space by itself.
APART = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
KINDS = ["a", "Z", "é", "ſ", "1", ".", "'s", "'", "_", "漢", "|", "-", "<", "|>"]
SPACES = " \t\n\x0b\x0c\r"


def _steps(part: dict | None, inner: str) -> list[dict]:
    if part is None:
        return []
    return [x for p in part[inner] for x in _steps(p, inner)] if part["type"] == "Sequence" else [part]


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level models: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Kept(dict):
    """Ids of words; a word that is not there is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        return self.encode(word)


class Encoder:
    """Little-endian id bytes of texts, word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = "<u2" if self.code == "H" else "<u4"
        self.kept = _Kept(self._word)
        self.older: dict[bytes, bytes] = {}  # those kept before, of which the ones in use come back
        parts = json.loads(self.tokenizer.to_str())
        normal = _steps(parts["normalizer"], "normalizers")
        alone = all(s["type"] in APART or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in normal)
        bare = not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in parts["added_tokens"])
        whole = parts["truncation"] is None and parts["padding"] is None
        self.by_words = alone and bare and whole and all(self._ids(x + s + y) == self._ids(x) + self._ids(y) for x in KINDS for y in KINDS for s in SPACES)
        self.folds = any(s["type"] == "Lowercase" for s in normal)
        self.composes = {s["type"] for s in normal} <= {"NFC", "Lowercase", "Replace"}  # composed lower-case letters stay as they are
        # letters alone: one run of letters for the pre-tokenizer, whose bytes the model gets
        before = _steps(parts["pre_tokenizer"], "pretokenizers")
        self.bytes = _byte_letters()
        probe = ["a", "thinking", "zq", "ofantition", "é", "straße", "漢字", "οδος", "ofé", "naïve"]
        bytewise = bool(before) and before[-1]["type"] == "ByteLevel" and not before[-1]["add_prefix_space"] and not before[-1]["use_regex"]
        self.plain = self.by_words and bytewise and all(self._letters(w.encode()) == self._ids(w) for w in probe)

    def _pack(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _ids(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _letters(self, word: bytes) -> bytes:
        text = word.decode() if word.isascii() else word.decode("latin-1").translate(self.bytes)
        return self._pack([t.id for t in self.tokenizer.model.tokenize(text)])

    def _word(self, word: bytes) -> bytes:
        """Ids of a word; closing punctuation after a plain letter is a word of its own to the tokenizer. A word that is
        made of others is kept only if these were met before."""
        kept = self.kept
        out = self.older.get(word)
        if out is None and word.isalpha():  # ASCII letters alone
            if self.folds and not word.islower():
                low = word.lower()
                out = kept.get(low)
                if out is None:
                    return self._word(low)
            else:
                out = self._letters(word) if self.plain else self._ids(word.decode())
        elif out is None:
            core = word.rstrip(b".,!?;:")
            if core and core != word and core[-1:].isalpha():
                end, known = kept[word[len(core) :]], kept.get(core)
                if known is None:
                    return self._word(core) + end
                out = known + end
            else:
                out = self._other(word.decode())
        if len(kept) >= KEPT:
            self.older = dict(kept)
            kept.clear()
        kept[word] = out
        return out

    def _other(self, text: str) -> bytes:
        if not self.plain or not text.isalpha():
            return self._ids(text)
        if self.composes and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return self._letters(text.encode())
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return self._letters(normal.encode()) if normal.isalpha() else self._ids(text)

    def encode(self, text: str | None) -> bytes:
        if not self.by_words:
            return self._ids(text or "")
        data, ids, out, at = (text or "").encode(), self.kept.__getitem__, [], 0
        while at < len(data):
            end = at + PIECE
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            out.append(b"".join(map(ids, data[at:end].split())))
            at = end
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_file(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A file of documents in order; null ids lead."""
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    numbers = EliasFano.build(np.array([d - least for d in known], np.uint64))
    bounds = EliasFano.build(np.concatenate([[0], np.cumsum([len(x) // width for x in ids])]))
    return b"".join([MAGIC, struct.pack(HEAD, width, len(doc_ids), len(doc_ids) - len(known), least), numbers.to_bytes(), bounds.to_bytes(), *ids])


class TokenFile:
    """Documents of one file by position."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token file")
        width, self.n, self.nulls, self.least = struct.unpack_from(HEAD, view, len(MAGIC))
        self.numbers, at = EliasFano.from_bytes(view, len(MAGIC) + struct.calcsize(HEAD))
        self.bounds, at = EliasFano.from_bytes(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", -1, at) if at < len(view) else np.zeros(0, f"<u{width}")

    @property
    def doc_ids(self) -> list[int | None]:
        known = self.numbers.select_many(np.arange(self.n - self.nulls))
        return [None] * self.nulls + (known + np.uint64(self.least % (1 << 64))).view(np.int64).tolist()

    def offsets(self) -> np.ndarray:
        """Where each document begins, and where the last ends, by select."""
        return self.bounds.select_many(np.arange(self.n + 1)).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _save(folder: str, name: str, data: bytes) -> None:
    """Whole files only: a file gets its name when it is complete."""
    fs, path = pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", folder)))
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, f"{path}/{name}")


def write(docs: DataFrame, path: str, folder: str, end: int = END) -> DataFrame:
    """Writes token files of ``docs`` (doc_id, text) into ``folder``; a row (part, seq, n_docs, n_ids) per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        width, stop = np.dtype(enc.dtype).itemsize, np.array([end], enc.dtype).tobytes()
        doc_ids, ids, held, seq = [], [], 0, 0

        def close() -> pd.DataFrame:
            _save(folder, f"part-{part:08d}-{seq:06d}.tok", pack_file(doc_ids, ids, width))
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_ids": [held]})

        for batch in batches:
            for doc_id, missing, text in zip(batch["doc_id"], batch["missing"], batch["text"]):
                found = enc.encode(text) + stop
                doc_ids.append(None if missing else int(doc_id))
                ids.append(found)
                held += len(found) // width
                if held >= FILE_IDS:
                    yield close()
                    doc_ids, ids, held, seq = [], [], 0, seq + 1
        if doc_ids:
            yield close()

    digest = F.xxhash64("text")
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.col("doc_id").isNull().alias("missing"), digest.alias("h"), "text")
    order = [F.col("missing").desc(), F.col("doc_id"), F.col("h")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return common.staged(rows.select("doc_id", "missing", "text").mapInPandas(run, "part long, seq long, n_docs long, n_ids long"), "token-files")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row per document of the files in ``folder``: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                part, seq = (int(x) for x in name.rpartition("/part-")[2].removesuffix(".tok").split("-"))
                file = TokenFile(data)
                bounds = file.offsets()
                crc = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pd.DataFrame({
                    "part": part, "seq": seq, "doc_id": pd.array(file.doc_ids, "Int64"),
                    "at": bounds[:-1], "n_tokens": np.diff(bounds), "ids_crc32": np.array(crc, np.int64),
                })

    before = F.sum("n_ids").over(Window.partitionBy(F.lit(0)).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    files = manifest.select("part", "seq", before.alias("before"))  # one row per file
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(folder).select("path", "content")
    rows = found.mapInPandas(run, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(files, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op7: all documents, written and read back."""
    folder = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = write(common.read_table(spark, sf_dir, "documents"), path or vocabulary(), folder)
    return read(spark, folder, manifest)
