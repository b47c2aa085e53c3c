"""Secret scans: patterns propose, a random forest trained on labelled findings removes false positives.

Candidates are known key formats, values assigned to names such as ``password``, and long runs that
mix letters and digits. The forest sees their length, transitions between character classes, the
share of letters that dictionary words cover, paths and addresses around them, and neighbouring
words. It is trained here, on a bounded set of labelled findings (``TRAIN`` rows) that a seeded
generator writes: true keys, passwords and tokens, and the usual false ones (checksums, commit ids,
identifiers, paths, card and phone numbers, placeholders).

The dictionary is learned from the corpus: document frequencies of all its words, hashed to BUCKETS
counters; words in COMMON of all documents, and in three at least, are in it, beside the fixed code words.

Each task scans whole documents on its own; only the forest and the dictionary's bits, both of fixed
size, are sent to the tasks.

Defined cases: null and empty texts have no finding; a secret that occurs twice is two findings; values of
any length are whole, private keys with all their lines; where candidates overlap, formats go before
assignments and those before long runs, earlier ones first; a score of exactly SCORE is a finding;
repeated rows each give theirs; very long texts are scanned whole; an empty table gives no rows.
Other columns are ignored. Findings carry a digest of the secret, not the secret.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

TRAIN, TREES, DEPTH, SEED, SCORE = 4000, 40, 9, 11, 0.5
#: Counters of the dictionary, and the share of documents from which a word is in it.
BUCKETS, COMMON = 1 << 20, 1e-5

# Public key formats, and words that stand near secrets or near what only looks like one.
FORMATS = [
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google_key", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]*(?:-(?!----)[^-]*)*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
]
NAMES = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential"]
NEAR_TRUE = {"password", "passwd", "pwd", "secret", "token", "apikey", "api", "key", "access", "auth", "bearer", "credential", "credentials", "login", "private"}
NEAR_FALSE = {"sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "commit", "revision", "rev", "uuid", "guid", "id", "example", "sample", "dummy", "version", "card", "phone", "order", "isbn", "build", "blob", "etag", "class", "function", "file", "path", "see"}
DICTIONARY = {
    "access", "account", "admin", "and", "api", "app", "auth", "base", "build", "change", "changeme", "class", "client", "code", "config", "data", "default", "demo", "dummy", "example", "file", "for", "from", "function",
    "handler", "here", "image", "index", "insert", "internal", "key", "list", "login", "main", "manager", "my", "name", "node", "none", "null", "object", "page", "pass", "password", "path", "placeholder", "public",
    "redacted", "request", "response", "sample", "secret", "server", "service", "session", "some", "src", "string", "table", "test", "text", "the", "this", "token", "type", "undefined", "update", "user", "utils",
    "value", "version", "view", "with", "your",
}

_FORMATS = [(name, re.compile(p)) for name, p in FORMATS]
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:[\w-]{0,32}(?:" + "|".join(map(re.escape, NAMES)) + r")[\w-]{0,16})[\"']?[ \t]{0,3}(?:=|:|=>)[ \t]{0,3}[\"']?([^\s\"',;]{6,})")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_=.\-])[A-Za-z0-9+/_=.\-]{16,}(?![A-Za-z0-9+/_=\-])")
_WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")
_NEAR = re.compile(r"[A-Za-z0-9]+")
_TOKENS = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][a-z]{2,}(?![A-Za-z0-9])")

FEATURES = ["format", "assigned", "length", "digits", "upper", "lower", "other", "transitions", "hexadecimal", "distinct", "vowels", "dictionary", "path", "dots", "address", "near_true", "near_false", "grouped"]


def candidates(text: str) -> list[tuple[int, str, str]]:
    """(start, rule, value), without overlaps: formats before assignments before long runs."""
    out: list[tuple[int, str, str]] = []
    taken: list[tuple[int, int]] = []  # in order, none of which overlap

    def add(start: int, rule: str, value: str) -> None:
        end = start + len(value)
        at = bisect_left(taken, (start, end))
        if value and (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            taken.insert(at, (start, end))
            out.append((start, rule, value))

    for rule, pattern in _FORMATS:
        for m in pattern.finditer(text):
            add(m.start(), rule, m[0])
    low = text.lower()
    if any(n in low for n in NAMES):
        for m in _ASSIGNED.finditer(text):
            add(m.start(1), "assigned", m[1])
    for m in _LONG.finditer(text):
        value = m[0].strip(".")
        if any(c.isdigit() for c in value):
            add(m.start() + m[0].index(value), "long_run", value)
    return out


class Words:
    """The dictionary: fixed code words, and hashed words of a corpus."""

    def __init__(self, common: np.ndarray | None = None):
        self.common = common

    def __contains__(self, word: str) -> bool:
        return word in DICTIONARY or self.common is not None and len(word) > 2 and bool(self.common[_bucket(word)])


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per counter, and of all (counter -1)."""
    counts, docs, place = np.zeros(BUCKETS, np.int64), 0, {}
    for batch in batches:
        for text in batch["text"]:
            own = set()
            for w in set(_TOKENS.findall(text or "")):
                w = w.lower()
                if (k := place.get(w)) is None:
                    if len(place) >= 500_000:
                        place.clear()
                    k = place[w] = _bucket(w)
                own.add(k)
            counts[np.fromiter(own, np.int64, len(own))] += 1
            docs += 1
    at = np.flatnonzero(counts)
    yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(counts[at], docs)})


def learn_words(docs: DataFrame) -> Words:
    """The dictionary of all of ``docs`` (text). At most BUCKETS numbers reach the driver."""
    counted = docs.select("text").mapInPandas(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counted = common.staged(counted, "word-frequencies")
    total = counted.where("bucket < 0").agg(F.sum("n")).first()[0] or 0
    found = counted.where((F.col("bucket") >= 0) & (F.col("n") >= max(3, COMMON * total))).select("bucket").toPandas()["bucket"]
    bits = np.zeros(BUCKETS, bool)
    bits[found.to_numpy(np.int64)] = True
    return Words(bits)


def features(text: str, start: int, rule: str, value: str, words: Words | None = None) -> list[float]:
    n, words = len(value), words or Words()
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    count = {k: kinds.count(k) / n for k in "dulo"}
    letters = [c for c in value.lower() if c.isalpha()]
    covered = sum(len(w) for w in _WORDS.findall(value) if w.lower() in words)
    before, after = text[max(0, start - 48) : start], text[start + n : start + n + 16]
    near = {w.lower() for w in _NEAR.findall(before)[-4:]} | {w.lower() for w in _NEAR.findall(after)[:1]}
    return [
        float(rule not in ("assigned", "long_run")), float(rule == "assigned"), float(min(n, 100)),
        count["d"], count["u"], count["l"], count["o"],
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        sum(c in "0123456789abcdefABCDEF" for c in value) / n, len(set(value)) / n,
        sum(c in "aeiou" for c in letters) / max(1, len(letters)), covered / max(1, len(letters)),
        float(value.count("/") + before.endswith("/")), float(value.count(".")), float("://" in before[-40:] or "@" in after[:1] or before.endswith("@")),
        float(bool(near & NEAR_TRUE)), float(bool(near & NEAR_FALSE)), float(bool(re.search(r"[0-9a-f]{8}-[0-9a-f]{4}", value.lower()))),
    ]


def labelled(n: int = TRAIN, seed: int = SEED) -> Iterator[tuple[str, bool]]:
    """Texts that hold one finding each, and whether it is a secret."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower, digits = upper.lower(), "0123456789"
    mixed = upper + lower + digits
    of = lambda *x: str(rng.choice(x))
    syllables = ["on", "er", "the", "la", "be", "ti", "mo", "ra", "ing", "es", "ou", "qu", "en", "sch", "de"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    true = [
        lambda: "AKIA" + pick(upper + digits, 16),
        lambda: f"gh{of('p', 'o', 's')}_" + pick(mixed, 36),
        lambda: "xoxb-" + pick(digits, 11) + "-" + pick(mixed, 24),
        lambda: "AIza" + pick(mixed + "_-", 35),
        lambda: f"{of('password', 'passwd', 'db_password', 'PWD')}{of('=', ': ', ' = ')}" + pick(of(hexa, mixed, mixed + "!#%&*"), rng.integers(10, 24)),
        lambda: f"{of('token', 'api_key', 'secret', 'auth_token', 'API_KEY', 'client_secret')}{of('=', ': ', ' = ')}{of('', chr(34))}" + pick(of(hexa, mixed), rng.integers(20, 48)) + of("", '"'),
        lambda: f"{of('bearer', 'api key', 'secret key', 'login')} " + pick(mixed, rng.integers(24, 44)),
    ]
    false = [
        lambda: f"{of('commit', 'sha1', 'revision', 'blob')} " + pick(hexa, 40),
        lambda: f"{of('md5', 'checksum', 'hash', 'etag', 'digest')}{of(' ', ': ', '=')}" + pick(hexa, int(of("32", "64"))),
        lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: pick(digits, rng.integers(16, 20)),
        lambda: f"{of('src', 'usr', 'https://host', 'data')}/{word()}/{word()}{rng.integers(0, 99)}/{word()}.{of('py', 'html', 'json', 'txt')}",
        lambda: f"{of('password', 'token', 'secret', 'api_key')}{of('=', ': ')}" + of("changeme", "your_token_here", "password123", "example_value", "xxxxxxxxxx", "**********", "<redacted>", "${PASSWORD}", "undefined", "default_password", "test_secret_1"),
        lambda: f"{of('password', 'token', 'secret', 'auth')}: " + word() + word() + word(),
        lambda: "".join(w.capitalize() for w in rng.choice(sorted(DICTIONARY), 4)) + str(rng.integers(0, 99)),
        lambda: "_".join(rng.choice(sorted(DICTIONARY), 4)) + "_" + str(rng.integers(0, 999)),
        lambda: f"{rng.integers(2000, 2030)}-{rng.integers(10, 12)}-{rng.integers(10, 28)}T{rng.integers(10, 23)}.{rng.integers(10, 59)}.{rng.integers(10, 59)}",
        lambda: f"v{rng.integers(0, 9)}.{rng.integers(0, 99)}.{rng.integers(0, 9)}-{word()}-{word()}.{rng.integers(100, 999)}",
        lambda: word() + word() + word() + word() + word() + word() + str(rng.integers(0, 99)),
    ]
    for k in range(n):
        good = k % 2 == 0
        made = true if good else false
        text = f"{' '.join(word() for _ in range(rng.integers(2, 8)))} {made[k // 2 % len(made)]()} {' '.join(word() for _ in range(rng.integers(2, 8)))}"
        yield text, good


class Forest:
    """A random forest of binary trees over numeric features; nodes are (feature, threshold, left, right, share)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        self.rng, self.depth = np.random.default_rng(seed), depth
        self.width = max(1, round(np.sqrt(x.shape[1])))
        self.trees = []
        for _ in range(trees):
            own = self.rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[own], y[own].astype(float), 0, nodes)
            self.trees.append(np.array(nodes))
        del self.rng

    def _grow(self, x: np.ndarray, y: np.ndarray, level: int, nodes: list) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, y.mean()])
        if level == self.depth or len(y) < 4 or y.min() == y.max():
            return me
        best = (y.var() * len(y) - 1e-9, -1, 0.0)
        for f in self.rng.choice(x.shape[1], self.width, replace=False):
            values = np.unique(x[:, f])
            cuts = (values[1:] + values[:-1]) / 2
            for cut in cuts if len(cuts) <= 24 else np.quantile(cuts, np.linspace(0, 1, 24)):
                left = x[:, f] <= cut
                k = left.sum()
                if 0 < k < len(y):
                    loss = y[left].var() * k + y[~left].var() * (len(y) - k)
                    best = min(best, (loss, int(f), float(cut)))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            a = self._grow(x[left], y[left], level + 1, nodes)
            b = self._grow(x[~left], y[~left], level + 1, nodes)
            nodes[me][:4] = [best[1], best[2], a, b]
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for nodes in self.trees:
            at = np.zeros(len(x), np.int64)
            while (open_ := nodes[at, 0] >= 0).any():
                f = np.where(open_, nodes[at, 0], 0).astype(np.int64)
                go = x[np.arange(len(x)), f] <= nodes[at, 1]
                at = np.where(open_, np.where(go, nodes[at, 2], nodes[at, 3]).astype(np.int64), at)
            total += nodes[at, 4]
        return total / len(self.trees)


@functools.cache
def train(n: int = TRAIN, seed: int = SEED) -> Forest:
    x, y = [], []
    for text, good in labelled(n, seed):
        for c in candidates(text):
            x.append(features(text, *c))
            y.append(good)
    return Forest(np.array(x), np.array(y))


def find(docs: DataFrame, forest: Forest | None = None, words: Words | None = None) -> DataFrame:
    """A row per secret: doc_id, start (code points), length, rule, secret_sha256, score. The dictionary is that of ``docs``
    if none is given."""
    shared = docs.sparkSession.sparkContext.broadcast((forest or train(), words or learn_words(docs)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "missing", "start", "length", "rule", "secret_sha256", "score"]
        forest, words = shared.value
        for batch in batches:
            rows, x = [], []
            for doc_id, missing, text in zip(batch["doc_id"], batch["missing"], batch["text"]):
                for start, rule, value in candidates(text or ""):
                    rows.append((doc_id, missing, start, len(value), rule, hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()))
                    x.append(features(text, start, rule, value, words))
            if rows:
                score = forest.score(np.array(x))
                yield pd.DataFrame([(*r, s) for r, s in zip(rows, score.tolist()) if s >= SCORE], columns=names)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), "text")
    out = rows.mapInPandas(run, "doc_id long, missing boolean, start long, length int, rule string, secret_sha256 string, score double")
    return out.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every secret in a document."""
    return find(common.read_table(spark, sf_dir, "documents"))
