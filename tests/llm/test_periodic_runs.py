"""Periodic runs against plain definitions, over random and periodic words and over the smallest tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from oracle import TINY
from tidemark.llm import periodic_runs
from tidemark.llm.periodic_runs import Suffixes, blocks, runs, vocabulary


def plain_runs(x, least=2, words=0):
    """Every (start, length, period) of a stretch that can't be extended, smallest periods only."""
    n, out = len(x), {}
    for q in range(1, n // least + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and x[k] == x[k + q]:
                k += 1
            if k - i + q >= max(words, least * q):
                out.setdefault((i, k - i + q), q)
            i = max(k, i) + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def strings():
    rng = np.random.default_rng(4)
    for k in range(300):
        yield list(rng.integers(0, 1 + k % 4, rng.integers(1, 50)))
    for _ in range(100):
        x = []
        for _ in range(3):
            base = list(rng.integers(0, 3, rng.integers(1, 9)))
            x += (base * 6)[: rng.integers(1, 40)]
        yield x
    a, b = [0], [0, 1]
    for _ in range(7):
        a, b = b, b + a
    yield b
    yield [0] * 70
    yield ([0, 0, 1] * 9 + [2]) * 4


def test_all_runs_of_small_strings():
    for x in strings():
        assert list(map(tuple, runs(np.array([*x, 99])).tolist())) == plain_runs(x), x


def test_blocks_are_the_longest_that_begin_further_left():
    for x in strings():
        x = [*x, 99]
        edges, at = [], 0
        while at < len(x):
            edges.append(at)
            at += max([1, *(next(k for k in range(len(x) - at + 1) if x[j : j + k + 1] != x[at : at + k + 1] or k == len(x) - at) for j in range(at))])
        assert blocks(Suffixes(np.array(x))).tolist() == [*edges, len(x)]


def test_the_vocabulary_has_every_square_once():
    for x in strings():
        x = [*x, 99]
        s = Suffixes(np.array(x))
        lo, hi, root = vocabulary(s)
        got = [(tuple(x[s.order[a] : s.order[a] + 2 * k]), b - a) for a, b, k in zip(lo, hi, root, strict=True)]
        want = Counter(tuple(x[i : i + 2 * k]) for k in range(1, len(x) // 2 + 1) for i in range(len(x) - 2 * k + 1) if x[i : i + k] == x[i + k : i + 2 * k] and not any(k % d == 0 and x[i : i + k] == x[i : i + d] * (k // d) for d in range(1, k)))
        assert sorted(got) == sorted(want.items())


def plain(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 3, 24) if n < 4000 else None
    if found is None:  # periods by numbers instead of words, for the long texts
        x, found = np.unique(words, return_inverse=True)[1], {}
        for q in range(1, n // 3 + 1):
            same = np.concatenate(([False], x[q:] == x[:-q], [False])).astype(np.int8)
            a, b = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
            for i, k in zip(a, b, strict=True):
                if k - i + q >= max(24, 3 * q):
                    found.setdefault((int(i), int(k - i + q)), q)
        found = sorted((a, m, q) for (a, m), q in found.items())
    gone = {k for a, m, q in found for k in range(a + q, a + m)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in found)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("which", ["tiny", "odd", "empty", "periodic"])
def test_equals_brute_force(spark, request, which):
    if which == "tiny":
        df = spark.read.parquet(f"{TINY}/documents.parquet")
    elif which == "periodic":
        rng = np.random.default_rng(6)
        rows = []
        for i in range(300):
            base = [f"w{k}" for k in rng.integers(0, 3 + i % 5, rng.integers(1, 30))]
            rows.append((i, " \t".join(f"v{k}" for k in rng.integers(0, 9, i % 7)) + "\n" + " ".join((base * 30)[: rng.integers(0, 120)]) + " end " + " ".join((base * 20)[3 : rng.integers(4, 90)])))
        rows += [(1000, "a " * 3000), (1001, "a b " * 900 + "c " * 60), (1002, "a " * 24), (1003, "a " * 23), (None, "x y z " * 20)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    else:
        df = request.getfixturevalue(which)
    got = periodic_runs.report(df)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "start " + "one two three " * 12 + "end")], "doc_id bigint, text string")
    r = periodic_runs.find(df).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 36, 3)] and r["collapsed"] == "start one two three end"


def test_a_very_long_text():
    words = [b"w%d" % k for k in np.random.default_rng(1).integers(0, 50, 150_000)]
    words[40_000:140_000] = (words[40_000:70_000] * 4)[:100_000]
    assert [tuple(r) for r in periodic_runs.runs_of_texts([words])[0].tolist() if r[2] > 100] == [(40_000, 100_000, 30_000)]
