"""SimHash near-dedup by anchor-point covering.

Fingerprint: 64 bits, each set if it is set in over half of the XXH64 values (seed 42) of a text's
three-word shingles. Two fingerprints link at three differing bits or fewer, so one half of 32 bits
holds one difference at most. The anchors of a half are the codewords of the Hamming code of length
31 (covering radius 1) over its first 31 bits. A fingerprint's home is the one codeword within the
radius; it is also copied to every codeword within radius plus threshold, 2. If two fingerprints
differ in one of the 31 bits at most, the second lies within 2 of the first's home, so comparing, per
anchor, those at home with all who came finds every link.

Only distinct fingerprints are compared; copies join them again at the end. An anchor that very many
distinct fingerprints reach is split by the other half, which differs in three bits at most: one of
its four bytes agrees. Per anchor only a spanning forest of the links leaves the task, never all
pairs. Components come from alternating large and small stars over staged tables.

``dedup``, the pipeline's stage, links texts by five-word similarity: the same covering over longer
fingerprints finds candidates, which are confirmed by their sets of shingles (see there).

Defined cases: null, empty and blank texts have fingerprint 0 and link like any other; fewer words
than three give one shingle; texts of any length are read whole, piece by piece; a bit on which exactly
half of the hashes agree is 0; the smallest id stands for a component, among rows of one id that with the
least digest; repeated rows share a component; a component whose ids are all null has
a null id; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bytes of a text that are cut into words at once, and fingerprints from which an anchor is split.
PIECE, HOT = 1 << 20, 4096
CODE = 31
#: The pipeline's stage: words of a long fingerprint, differing bits of its first 128 up to which a pair is a candidate,
#: and words of a shingle and similarity of what is confirmed.
SKETCH, NEAR, CONFIRM, LEAST = 3, 31, 5, 0.8
#: Sketches of a group whose links failed that are compared at once, and links that are made into stars at once.
BLOCK, LINKS = 1024, 1 << 19
MIX = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece, each piece cut at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a text."""
    ones, n, tail, digest = np.zeros(64, np.int64), 0, [], xxhash.xxh64_intdigest
    for words in _pieces((text or "").encode().lower()):
        words = tail + words
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            length = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(length + 1) - 1
            starts = (ends - length)[: 1 - SHINGLE].tolist()
            hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)
            for i in range(0, len(hashes), 1 << 14):
                part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
                ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
        tail = words[1 - SHINGLE :] if len(words) >= SHINGLE else words
    if not n:
        return digest(b" ".join(tail), SEED) if tail else 0
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column) -> Column:
    """Fingerprints of a text column, as signed 64-bit numbers."""

    @F.pandas_udf("long")
    def take(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return take(text)


def _to_anchors(fps: DataFrame, words: list[str], parts: int) -> DataFrame:
    """(half, anchor, *words, home) for each anchor that a fingerprint of 64-bit ``words`` is copied to. Its ``parts``
    halves begin at bits 0, 32, 64, ...; positions in the code are 1 to 31."""
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = fps.repartition(tasks)  # a few files of fingerprints become many copies
    half = F.explode(F.array(*[F.lit(32 * k) for k in range(parts)])).alias("half")
    word = f"element_at(array({', '.join(words)}), int(half div 64) + 1)" if len(words) > 1 else words[0]
    x = fps.select(*words, half).withColumn("x", F.expr(f"shiftrightunsigned({word}, half % 64) & {2**CODE - 1}L"))
    masks = [sum(1 << (i - 1) for i in range(1, CODE + 1) if i >> k & 1) for k in range(5)]
    syndrome = " + ".join(f"(bit_count(x & {m}L) & 1) * {1 << k}" for k, m in enumerate(masks))
    x = x.withColumn("s", F.expr(f"cast({syndrome} as int)"))
    home = "struct(if(s = 0, x, x ^ shiftleft(1L, s - 1)) as anchor, true as home)"
    others = (
        f"transform(filter(sequence(1, {CODE}), i -> s > 0 and i < (i ^ s)), "
        "i -> struct(x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1) as anchor, false as home))"
    )
    return x.withColumn("to", F.explode(F.expr(f"concat(array({home}), {others})"))).select("half", "to.anchor", *words, "to.home")


def _forest(fps: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between those at home and all, of one anchor."""
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in np.flatnonzero(home).tolist():
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= RADIUS).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                edges.append((i, j))
    return edges


def _whole(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole groups, and where each group starts. Rows come sorted by ``names``; a group's may reach over batches."""
    left: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[names].to_numpy()
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if left and (left[-1][names].to_numpy()[-1] != keys[0]).any():
            whole = pd.concat(left, ignore_index=True)
            yield whole, _starts(whole[names].to_numpy())
            left = []
        if not len(new):
            left.append(batch)
            continue
        head = pd.concat([*left, batch.iloc[: new[-1]]], ignore_index=True)
        yield head, _starts(head[names].to_numpy())
        left = [batch.iloc[new[-1] :]]
    if left:
        whole = pd.concat(left, ignore_index=True)
        yield whole, _starts(whole[names].to_numpy())


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows, starts in _whole(batches, ["half", "anchor", "part", "value"]):
        fps, home = rows["fp"].to_numpy().view(np.uint64), rows["home"].to_numpy()
        size = np.diff(np.append(starts, len(rows)))
        a, b = [], []
        owner = np.repeat(np.arange(len(starts)), size)
        small = (size <= 64)[owner]
        for d in range(1, min(64, int(size.max(initial=1)))):
            same = (owner[d:] == owner[:-d]) & small[d:] & (home[d:] | home[:-d])
            i = np.flatnonzero(same)
            i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= RADIUS]
            a.append(i)
            b.append(i + d)
        for g in np.flatnonzero(size > 64):
            s = starts[g]
            e = _forest(fps[s : s + size[g]], home[s : s + size[g]])
            a.append(np.array([s + i for i, _ in e], np.int64))
            b.append(np.array([s + j for _, j in e], np.int64))
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        x, y = fps.view(np.int64)[i], fps.view(np.int64)[j]
        found = pd.DataFrame({"u": np.maximum(x, y), "v": np.minimum(x, y)}).drop_duplicates()
        yield found[found.u != found.v]


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])


def links(fps: DataFrame) -> DataFrame:
    """Edges (u > v) between distinct fingerprints ``fp`` that connect all that link."""
    reach = _to_anchors(fps, ["fp"], 2)
    hot = reach.groupBy("half", "anchor").count().where(F.col("count") > HOT).select("half", "anchor", F.lit(True).alias("hot"))
    other = "cast(shiftrightunsigned(fp, 32 - half + 8 * i) & 255L as int)"
    parts = F.expr(f"if(hot, transform(sequence(0, 3), i -> struct(i as part, {other} as value)), array(struct(0 as part, -1 as value)))")
    rows = reach.join(hot, ["half", "anchor"], "left").select("half", "anchor", "fp", "home", F.explode(parts).alias("p"))
    rows = rows.select("half", "anchor", "p.part", "p.value", "fp", "home")
    rows = rows.repartition("half", "anchor", "part", "value").sortWithinPartitions("half", "anchor", "part", "value")
    return rows.mapInPandas(_links, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u > v): the smallest node that is reachable."""
    edges, before = common.staged(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.expr("array(struct(v as u, m as v), struct(u, m as v))")).alias("e")).select("e.*").where("u > v").distinct()
        edges = common.staged(small, "stars", (edges,))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A link from each end of a task's links to the least that they reach."""
    some = [batch for batch in batches if len(batch)]
    if not some:
        return
    ends = np.concatenate([batch[c].to_numpy() for c in ("u", "v") for batch in some])
    at, names = pd.factorize(ends, sort=True)
    parent, n = list(range(len(names))), len(at) // 2

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(at[:n].tolist(), at[n:].tolist()):
        x, y = root(i), root(j)
        parent[max(x, y)] = min(x, y)
    of = np.array([root(i) for i in range(len(parent))])
    far = np.flatnonzero(of != np.arange(len(of)))
    yield pd.DataFrame({"u": names[far], "v": names[of[far]]})


def starred(edges: DataFrame) -> DataFrame:
    """Links (u > v) that connect what the staged ``edges`` connect, for ``components``. Of each LINKS links, of which a
    sketch has up to one for every anchor, fewer than there are ends leave a task."""
    tasks = -(-edges.count() // LINKS) or 1
    return edges.repartition(tasks).mapInPandas(_stars, edges.schema).distinct()


def fingerprinted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp) of ``docs``, and (fp, root): a fingerprint of the component of each fingerprint that links."""
    rows = common.staged(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "fingerprints")
    roots = components(links(common.staged(rows.select("fp").distinct(), "distinct-fingerprints")))
    return rows, roots.withColumnRenamed("node", "fp")


def least_of(rows: DataFrame, roots: DataFrame, value: Column) -> DataFrame:
    """(fp, root, least): the least ``value`` of each component, found over fingerprints, not over rows."""
    per_fp = rows.groupBy("fp").agg(F.min(value).alias("v")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return per_fp.join(per_fp.groupBy("root").agg(F.min("v").alias("least")), "root").select("fp", "root", "least")


def label(docs: DataFrame) -> DataFrame:
    """doc_id, fp and root of every row of ``docs``."""
    rows, roots = fingerprinted(docs)
    return rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles of ``n`` words (fewer words: one shingle; none: none), sorted."""
    words = [w for part in _pieces((text or "").encode().lower()) for w in part]
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    h = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w, SEED)) for w in words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(MIX[0]) + h[k : k + len(out)]
    return np.unique(_mixed(out))


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in MIX[1:]:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(m)
    return h ^ (h >> np.uint64(32))


def sketch(text: str | None) -> list[int]:
    """A long fingerprint of a text as SKETCH words of 64 bits; no words: zero."""
    h, out = shingles(text, SHINGLE), []
    for k in range(SKETCH):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), 1 << 14):
            part = _mixed(h[i : i + (1 << 14)] + np.uint64((k + 1) * MIX[0] % (1 << 64)))
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0]))
    return out


def _least_tree(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links of a minimum spanning forest, by differing bits, of one group (Prim's method)."""
    n, out = len(a), []
    away, near, open_, at = np.full(n, 255, np.int64), np.zeros(n, np.int64), np.ones(n, bool), 0
    for _ in range(n - 1):
        open_[at] = False
        d = (np.bitwise_count(a ^ a[at]) + np.bitwise_count(b ^ b[at])).astype(np.int64)
        closer = open_ & (d < away)
        away[closer], near[closer] = d[closer], at
        at = int(np.where(open_, away, 256).argmin())
        if away[at] <= NEAR:
            out.append((at, int(near[at])))
    return out


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of a minimum spanning forest of each anchor's sketches, by the first 128 bits."""
    for rows, starts in _whole(batches, ["key", "part", "value"]):
        a, b = (rows[c].to_numpy().view(np.uint64) for c in ("a", "b"))
        size = np.diff(np.append(starts, len(rows)))
        owner = np.repeat(np.arange(len(starts)), size)
        small, found = (size <= 64)[owner], []
        for d in range(1, min(64, int(size.max(initial=1)))):
            i = np.flatnonzero((owner[d:] == owner[:-d]) & small[d:])
            if not len(i):
                break
            away = np.bitwise_count(a[i] ^ a[i + d]) + np.bitwise_count(b[i] ^ b[i + d])
            i, away = i[away <= NEAR], away[away <= NEAR]
            found.append(np.stack([away.astype(np.int64), i, i + d]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := parent.get(i, i)) != i:
                parent[i] = i = parent.get(up, up)
            return i

        edges = []
        for i, j in pairs[1:, np.argsort(pairs[0], kind="stable")].T.tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[x] = y
                edges.append((i, j))
        for g in np.flatnonzero(size > 64):
            s = starts[g]
            edges += [(s + i, s + j) for i, j in _least_tree(a[s : s + size[g]], b[s : s + size[g]])]
        i, j = np.array(edges, np.int64).reshape(-1, 2).T
        a, b = a.view(np.int64), b.view(np.int64)
        yield pd.DataFrame({"ua": a[i], "ub": b[i], "va": a[j], "vb": b[j]}).drop_duplicates()


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All pairs of each anchor's sketches that may be alike and whose groups (ga, gb) differ."""
    for rows, starts in _whole(batches, ["key", "part", "value"]):
        a, b, ga, gb, n = (rows[c].to_numpy() for c in ("a", "b", "ga", "gb", "n"))
        ends, us, vs = np.append(starts[1:], len(rows)), [], []
        first = np.repeat(starts, ends - starts)
        mixed = np.logical_or.reduceat((ga != ga[first]) | (gb != gb[first]), starts)
        for start, end in zip(starts[mixed].tolist(), ends[mixed].tolist()):
            for i in range(start, end - 1):
                j = slice(i + 1, end)
                ok = ((ga[j] != ga[i]) | (gb[j] != gb[i])) & (np.minimum(n[j], n[i]) >= LEAST * np.maximum(n[j], n[i]) - 1e-9)
                ok &= np.bitwise_count((a[j] ^ a[i]).view(np.uint64)) + np.bitwise_count((b[j] ^ b[i]).view(np.uint64)) <= NEAR
                v = i + 1 + np.flatnonzero(ok)
                us.append(np.full(len(v), i))
                vs.append(v)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        yield pd.DataFrame({"ua": a[i], "ub": b[i], "va": a[j], "vb": b[j]}).drop_duplicates()


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each two blocks (i, j) of a group, the links of a spanning forest of what is alike and not joined yet (``own``).
    Like ``_across`` it compares all pairs, but confirms them at once, so no more links leave than there are sketches."""
    for rows, starts in _whole(batches, ["root", "i", "j"]):
        nodes, us, vs = rows["node"].to_numpy(), [], []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            part = rows.iloc[start:end]
            own = np.unique(part["own"].to_numpy(), return_inverse=True)[1]
            if not own.any():
                continue
            a, b, block = (part[c].to_numpy() for c in ("a", "b", "block"))
            held = part["held"].to_list()
            n = np.array([len(h) for h in held])
            if not n.any():
                continue
            names, flat = np.unique(np.concatenate(held), return_inverse=True)
            ends, mark = np.cumsum(n), np.zeros(len(names), np.int64)
            within = part["i"].iloc[0] == part["j"].iloc[0]
            for x in range(len(part)) if within else np.flatnonzero(block == part["i"].iloc[0]).tolist():
                ok = (own != own[x]) & (np.minimum(n, n[x]) >= LEAST * np.maximum(n, n[x]) - 1e-9) & (n > 0)
                ok &= np.arange(len(part)) > x if within else block != block[x]
                ok &= np.bitwise_count((a ^ a[x]).view(np.uint64)) + np.bitwise_count((b ^ b[x]).view(np.uint64)) <= NEAR
                ys = np.flatnonzero(ok)
                if not len(ys):
                    continue
                mine = flat[ends[x] - n[x] : ends[x]]
                mark[mine] = 1
                first = np.cumsum(n[ys]) - n[ys]
                at = np.arange(n[ys].sum()) + np.repeat(ends[ys] - n[ys] - first, n[ys])
                common = np.add.reduceat(mark[flat[at]], first)
                mark[mine] = 0
                for y in ys[common >= LEAST * (n[x] + n[ys] - common) - 1e-9].tolist():
                    if own[y] != own[x]:
                        own[own == own[y]] = own[x]
                        us.append(start + x)
                        vs.append(start + y)
        yield pd.DataFrame({"u": nodes[us], "v": nodes[vs]}, dtype=object)


def united(tree: DataFrame, nodes: DataFrame, held: DataFrame) -> DataFrame:
    """Confirmed links (u > v) that join all of ``tree`` (node, root, own) that is alike, has one root and not yet one own.
    A root's sketches are dealt into blocks, and each two blocks are one piece of work."""
    dealt = tree.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    rows = tree.join(dealt, "root").join(nodes, "node").join(held, "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "own", "a", "b", "held")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = rows.mapInPandas(_united, "u string, v string")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def near_links(nodes: DataFrame) -> DataFrame:
    """Candidate links (u > v, nodes by name) between sketches (a, b, c), to be confirmed: a forest of each anchor."""
    reach = _to_anchors(nodes, list("abc"), 2 * SKETCH).select(F.expr("shiftleft(bigint(half), 32) | anchor").alias("key"), "a", "b")
    hot = reach.groupBy("key").count().where(F.col("count") > HOT).select("key", F.lit(True).alias("hot"))
    # of NEAR + 1 parts one at least agrees
    bits = 128 // (NEAR + 1)
    value = f"cast(shiftrightunsigned(if(i < {64 // bits}, a, b), {bits} * (i % {64 // bits})) & {2**bits - 1}L as int)"
    parts = F.expr(f"if(hot, transform(sequence(0, {NEAR}), i -> struct(i as part, {value} as value)), array(struct(0 as part, -1 as value)))")
    rows = reach.join(hot, "key", "left").select("key", "a", "b", F.explode(parts).alias("p")).select("key", "p.part", "p.value", "a", "b")
    rows = rows.repartition("key", "part", "value").sortWithinPartitions("key", "part", "value")
    found = rows.mapInPandas(_near, "ua long, ub long, va long, vb long")
    u, v = _name("ua", "ub"), _name("va", "vb")
    return found.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()


def _name(a: str, b: str) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def near_copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, least): distinct sketches of ``docs`` and the least row of each, as (id is null, id, row digest); and
    (node, root) of the nodes that confirmed links join."""

    @F.pandas_udf("a long, b long, c long")
    def sketches(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(np.array([sketch(t) for t in texts], np.int64).reshape(-1, SKETCH), columns=list("abc"))

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, CONFIRM).view(np.int64) for t in texts], dtype=object)

    uid = common.row_uid(docs).alias("uid")
    rows = common.staged(docs.select("doc_id", uid, sketches("text").alias("s")).select("doc_id", "uid", "s.*"), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("least")
    nodes = common.staged(rows.groupBy("a", "b").agg(F.min("c").alias("c"), least), "sketch-nodes")
    edges = common.staged(near_links(nodes), "near-links")
    named = nodes.select(_name("a", "b").alias("node"), "least")
    ends = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ends = named.join(ends, "node").select("node", F.col("least.uid").alias("uid"))
    held = docs.select(uid, "text").join(ends, "uid").dropDuplicates(["uid"]).select("node", sets("text").alias("held"))
    held = common.staged(held, "shingle-sets")
    judged = common.staged(_judged(edges, held), "judged-links")
    alike = judged.where("alike").select("u", "v")
    if judged.where("not alike").isEmpty():
        return named, components(starred(alike))
    # a forest's link that is not confirmed may have stood for others: what it left apart is compared pair by pair
    tree = held.select("node")
    for name, found in (("root", components(starred(edges))), ("own", components(starred(alike)))):  # which leave out the least node
        tree = tree.join(found.withColumnRenamed("root", name), "node", "left").withColumn(name, F.coalesce(name, "node"))
    open_ = tree.groupBy("root").agg((F.min("own") != F.max("own")).alias("open")).where("open").select("root")
    open_ = common.staged(tree.join(open_, "root", "left_semi"), "open-sketches")
    rest = common.staged(united(open_, nodes.select(_name("a", "b").alias("node"), "a", "b"), held), "rest-links")
    return named, components(starred(alike.unionByName(rest)))


def _judged(edges: DataFrame, held: DataFrame) -> DataFrame:
    """(u, v, alike): whether the sets of a link's ends are similar enough."""
    both = edges.join(held.select(F.col("node").alias("u"), F.col("held").alias("x")), "u").join(held.select(F.col("node").alias("v"), F.col("held").alias("y")), "v")
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.select("u", "v", (F.col("common") >= LEAST * (F.size("x") + F.size("y") - F.col("common")) - 1e-9).alias("alike"))


def dedup(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of every group of near copies, with the columns of ``docs``.

    Near copies have a Jaccard similarity of LEAST or more between their sets of five-word shingles. Candidates
    are found by covering anchors over long fingerprints, with a wider radius than that of ``links``: six halves of
    31 bits, all that meet at an anchor within two bits compared. Each anchor first keeps a minimum spanning forest of
    its candidates, and every link of it is confirmed exactly. Where one fails, all pairs within NEAR bits that the
    forests connect and confirmed links have left apart are confirmed, so every similar pair of candidates is joined;
    of these only a spanning forest of each two blocks leaves a task. Texts with equal 128-bit fingerprints are one."""
    nodes, roots = near_copies(docs)
    groups = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = groups.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.uid").alias("uid"))
    return common.whole_rows(docs).join(kept, "uid", "left_semi").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: fingerprint and component of all documents."""
    rows, roots = fingerprinted(common.read_table(spark, sf_dir, "documents"))
    ids = least_of(rows, roots, F.col("doc_id")).select("fp", F.col("least").alias("component_id"))
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
