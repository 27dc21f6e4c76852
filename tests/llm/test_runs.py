"""Periodic runs against a search of every period, on words made to be periodic and on a given table."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from resalio.llm import runs


def brute(words):
    """(start, length, period) of every run, by every period: stretches of words that equal the word a period on."""
    code = {}
    x = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
    n, out = len(x), []
    for q in range(1, n // 3 + 1):
        edges = np.flatnonzero(np.concatenate([[True], x[:-q] != x[q:], [True]]))
        for s, e in ((s, e - 1 + q) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()) if e - 1 - s >= 2 * q):
            if e - s >= max(24, 3 * q) and not any((x[s : e - p] == x[s + p : e]).all() for p in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng):
    """Words with runs of many kinds: within one another, next to one another, almost periodic."""
    kind, n, pick = rng.randrange(7), rng.randrange(260), lambda k, of: [rng.choice(of) for _ in range(k)]
    if kind == 0:
        return pick(n, "ab")
    if kind == 1:
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return [*b[:n]]
    if kind == 2:
        q = rng.randrange(1, 60)
        return pick(rng.randrange(20), "abc") + (pick(q, "abc") * 8)[: rng.randrange(3 * q, 8 * q)] + pick(20, "abc")
    if kind == 3:
        v = pick(rng.randrange(1, 5), "ab")
        u = v * rng.randrange(1, 12) + ["c"] * rng.randrange(2) + v * rng.randrange(3)
        return u * rng.randrange(3, 7) + ["x"] + u * 4
    if kind == 4:
        w = ["a"] * (n + 1)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "b"
        return w
    q = rng.randrange(9, 400 if kind == 5 else 70)
    u = pick(q, "abcdefgh")
    return [str(rng.randrange(1000)) for _ in range(n)] + u * 3 + u[: rng.randrange(q)] + [str(rng.randrange(9)) for _ in range(n)]


def test_runs_equal_a_search_of_every_period():
    rng, seen = random.Random(3), 0
    for _ in range(150):
        docs = [made(rng) for _ in range(rng.randrange(1, 6))]
        for words, (found, kept) in zip(docs, runs._together([[w.encode() for w in d] for d in docs])):
            want = brute(words)
            assert found == want, words
            assert b" ".join(kept).decode() == collapsed(words, want)
            seen += len(want)
    assert seen > 500


def expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(words, found)), n)


def test_query_equals_brute_force(spark, sf):
    got = sorted(map(tuple, runs.op13_runs(spark, sf).collect()))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(expected(r.doc_id, r.text) for r in rows)
    assert sum(r[1] > 0 for r in got) >= 10


def test_awkward_rows(spark, tmp_path):
    unit = [f"w{k}" for k in range(700)]
    rows = [(None, "a " * 30), (1, None), (2, ""), (3, " \t\n"), (4, "x y z " * 20), (4, "x y z " * 20), (5, " ".join(unit * 4)), (6, "b " * 300_000), (7, "ß é " * 40), (None, None), (20, "one"), (21, "p q")]
    rows += [(k, " ".join(f"{k % 3}{j * j % 11}" for j in range(90))) for k in range(100, 160)]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, periodic string, row int").write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = runs.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "periodic", "row", "periodic_"] and out.count() == len(rows)
    key = lambda r: tuple(str(v) for v in r)
    got = sorted(map(tuple, runs.op13_runs(spark, str(tmp_path)).collect()), key=key)
    few = [r for r in rows if r[0] != 6]
    assert [r for r in got if r[0] != 6] == sorted((expected(*r) for r in few), key=key)
    assert [r[1:6] for r in got if r[0] == 6] == [(1, 0, 300_000, 1, 300_000_000)]
    assert runs.periodic_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("words", [[], ["a"], ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, [*"abcdefgh"] * 3, [*"abcdefghi"] * 3])
def test_shortest_runs(words):
    assert runs._together([[w.encode() for w in words]])[0][0] == brute(words)
