import random

import numpy as np

from quern.llm import licenses
from tests.conftest import SF

SCHEMA = "doc_id long, text string, license string, times int"


def test_alignment_is_a_common_subsequence():
    rng = random.Random(2)
    for _ in range(80):
        a = [rng.randrange(12) for _ in range(rng.randrange(25))]
        b = [rng.randrange(12) for _ in range(rng.randrange(25))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) <= len(licenses._common(a, b))
    c = list(range(40))
    assert licenses.align([99, *c, 98], c) == [(i + 1, i) for i in range(40)]
    assert licenses._rising([3, 1, 2, 9, 4, 5]) == [1, 2, 4, 5]


def test_findings(spark):
    t = licenses.TEMPLATES
    mit = t["MIT"].split()
    edited = " ".join(w for k, w in enumerate(mit) if k % 9)
    noise = " ".join(np.random.default_rng(0).choice(sorted({w for x in t.values() for w in x.split()}), 3000))
    rows = [
        (1, "some words. " + t["Apache-2.0 notice"].upper() + " more"), (2, f"head {edited} tail"), (3, " ".join(mit[: len(mit) // 2])), (4, None), (5, ""),
        (6, (t["MIT notice"] + " pad " * 40) * 3), (7, noise), (8, "x " * 200_000 + t["ISC"]), (None, t["All rights reserved"]), (9, "all of them have rights that were reserved"),
        (8, "x " * 200_000 + t["ISC"]), (10, t["GPL-3.0-or-later"]),
    ]
    got = licenses.find(spark.createDataFrame([(i, x, "q", 0) for i, x in rows], SCHEMA)).collect()
    found = sorted((str(r.doc_id), r.license) for r in got)
    assert [f for f in found if f[0] not in ("10", "9")] == sorted([
        ("1", "Apache-2.0 notice"), ("2", "MIT"), ("6", "MIT notice"), ("8", "ISC"), ("8", "ISC"), ("None", "All rights reserved")
    ])
    assert ("10", "GPL-3.0-or-later") in found and [r.times for r in got if r.doc_id == 6] == [3]
    assert all(r.coverage >= 0.8 for r in got) and [r.first_word for r in got if r.doc_id == 8] == [200_000] * 2
    assert licenses.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_finds_each_planted_line(spark):
    got = {(r.doc_id, r.license) for r in licenses.query(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for name, t in licenses.TEMPLATES.items():
            if t in r.text:
                assert (r.doc_id, name) in got


def test_stretched_notices_are_found_wherever_they_start():
    name, rng = "MIT", np.random.default_rng(5)
    ws = licenses.words(licenses.TEMPLATES[name])
    scanner = licenses.Scanner({name: licenses.TEMPLATES[name]})
    for stretch, share in ((1.5, 0.9), (2, 1), (1.2, 0.85)):
        for offset in range(0, 100, 3):
            kept = sorted(rng.choice(len(ws), round(share * len(ws)), replace=False))
            out = ["zz"] * int(stretch * len(ws))
            between = sorted(rng.choice(np.arange(1, len(out) - 1), len(kept) - 2, replace=False))
            for p, w in zip([0, *between, len(out) - 1], kept):
                out[p] = ws[w]
            got = scanner.scan(" ".join(["pad"] * offset + out + ["pad"] * 300))
            assert [(f[0], f[2]) for f in got] == [(name, 1)]
            assert offset <= got[0][3] and got[0][3] + got[0][4] <= offset + len(out)


def test_copies_are_counted_wherever_they_start():
    for name, text in licenses.TEMPLATES.items():
        scanner, ws = licenses.Scanner({name: text}), licenses.words(text)
        thin = [w for k, w in enumerate(ws) if len(ws) < 9 or k % 9 != 4]
        for offset in range(0, len(ws), max(1, len(ws) // 9)):
            pad = ["pad"] * offset
            for copies in ([thin], [ws, ws], [ws, ws, thin], [ws, ["pad"] * 7, thin]):
                got = scanner.scan(" ".join(pad + [w for c in copies for w in c] + ["pad"] * 30))
                assert [(f[0], f[2]) for f in got] == [(name, sum(c[0] != "pad" for c in copies))], (name, offset, len(copies))
                assert offset <= got[0][3] and got[0][4] <= len(ws)


def test_findings_against_every_window():
    """A template is found if any window of any place and of a width up to twice its length holds it. Foreign words between
    change nothing; the template's own words, strewn in, may hide a copy from patience, but never make one."""
    rng = np.random.default_rng(11)
    text = licenses.TEMPLATES["Apache-2.0 notice"] + " " + licenses.TEMPLATES["CC-BY-4.0 notice"]
    template = licenses.words(text)
    scanner, n = licenses.Scanner({"t": text}), len(template)
    for k in range(120):
        noise = ["pad", "zz"] if k % 2 else ["pad", "the", "license", "version"]
        out = []
        for i in sorted(rng.choice(n, rng.integers(n // 2, n + 1), replace=False)):
            out += rng.choice(noise, rng.integers(0, 3)).tolist() + [template[i]]
        out = ["pad"] * int(rng.integers(0, 2 * n)) + out + rng.choice(noise, rng.integers(0, n)).tolist()
        every = any(
            len(licenses.align(out[s:e], template)) >= 0.8 * n
            for s in range(len(out)) if out[s] in template for e in range(s + 1, min(len(out), s + 2 * n) + 1) if out[e - 1] in template
        )
        found = bool(scanner.scan(" ".join(out)))
        assert found == every if k % 2 else found <= every


def test_the_better_of_two_licenses_is_reported():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name in ("GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later"):
        assert [f[0] for f in scanner.scan("x " * 50 + licenses.TEMPLATES[name] + " y" * 50)] == [name]


def test_query_against_single_scans(spark):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    want = [(r.doc_id, *f) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for f in scanner.scan(r.text)]
    got = [(r.doc_id, r.license, r.coverage, r.times, r.first_word, r.span) for r in licenses.query(spark, SF).collect()]
    assert sorted(got) == sorted(want) and got
