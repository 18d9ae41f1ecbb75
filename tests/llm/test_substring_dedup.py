"""Repeated passages: the index against plain searches, the operator against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import substring_dedup
from tidemark.llm.substring_dedup import FMIndex, WaveletMatrix, matches, segments, sorted_suffixes


def brute(rows):
    """rows: (doc_id, text); a Counter of the contract's rows."""
    first = {}
    split = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    for i, ws in split:
        if i is not None:
            for s in range(len(ws) - 12):
                key = tuple(ws[s : s + 13])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, ws in split:
        gone = set()
        for s in range(len(ws) - 12):
            if i is not None and first[tuple(ws[s : s + 13])] < i:
                gone |= set(range(s, s + 13))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def made(seed, n=60):
    """Texts of few words with copied, touching and overlapping passages, of 12 to 60 words, and periodic ones."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["é漢", "😀", "w1\x1cx", "\x85"]
    passages = [list(rng.choice(vocabulary, k)) for k in (12, 13, 14, 25, 60)]
    rows = []
    for i in rng.permutation(n):
        words = []
        for _ in range(rng.integers(0, 6)):
            words += list(rng.choice(vocabulary, rng.integers(0, 15)))
            p = passages[rng.integers(len(passages))]
            a = rng.integers(0, 3)
            words += p[a : len(p) - rng.integers(0, 3)] * rng.integers(1, 3)
        rows.append((int(i), " \t\n\x0b".join([" ".join(words)] * rng.integers(1, 3))))
    return rows + [(500, "a " * 40), (501, "a " * 13), (502, "b " * 12), (503, "a b " * 30), (504, "b a " * 30)]


@pytest.mark.parametrize("hot", [5000, 3])
def test_equals_brute_force(spark, monkeypatch, hot):
    """With hot runs of words and small shards too."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SEGMENTS", 50)
    rows = made(1) + [(None, "a " * 40), (None, None), (7, None), (8, ""), (9, "\n \t"), (5, made(1)[3][1]), (5, made(1)[3][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    assert Counter(map(tuple, substring_dedup.report(df).collect())) == brute(rows)


def test_a_passage_in_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 50)
    rng = np.random.default_rng(5)
    passage = " ".join(rng.choice([f"p{k}" for k in range(90)], 40))
    rows = [(i, " ".join(rng.choice([f"v{k}" for k in range(3000)], 30)) + (" " + passage + " " if i % 3 == 0 else " ") + " ".join(rng.choice([f"v{k}" for k in range(3000)], 30))) for i in range(600)]
    got = substring_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(32))
    got = Counter(map(tuple, got.collect()))
    assert got == brute(rows) and sum(n for (_, _, gone, _), n in got.items() if gone) == 199


@pytest.mark.parametrize("where", ["odd", "empty"])
def test_awkward_tables(request, where):
    df = request.getfixturevalue(where)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert Counter(map(tuple, substring_dedup.report(df).collect())) == brute(rows)


def test_segments_hold_each_window_that_may_repeat_once():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = rng.integers(1, 60)
        maybe, least = rng.random(n) < 0.7, np.repeat(rng.integers(0, 9, n), rng.integers(1, 25, n))[:n]
        hot = maybe & (least < 3)
        start, count = segments(maybe, least, hot)
        held = np.concatenate([np.arange(a, a + k) for a, k in zip(start, count, strict=True)] or [np.zeros(0, int)])
        assert sorted(held) == list(np.flatnonzero(maybe)) and (count <= 9).all()
        assert all(len(set(least[a : a + k])) == 1 for a, k in zip(start, count, strict=True))
        assert all(k == 1 for a, k in zip(start, count, strict=True) if hot[a])


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000])
def test_wavelet_ranks(size):
    rng = np.random.default_rng(size)
    for n in (1, 63, 64, 65, 700):
        x = rng.integers(0, size, n)
        number, at = rng.integers(0, size, 300), rng.integers(0, n + 1, 300)
        assert list(WaveletMatrix(x, size).rank(number, at)) == [int((x[:a] == c).sum()) for c, a in zip(number, at, strict=True)]


def test_matching_statistics_equal_plain_search():
    rng = np.random.default_rng(8)
    for _ in range(60):
        texts = [list(rng.integers(1, 4, rng.integers(1, 14))) for _ in range(rng.integers(1, 25))]
        docs = rng.integers(0, 10, len(texts))
        window = int(rng.integers(1, 6))
        got = {(t, k) for t, a, b in zip(*matches(np.concatenate(texts), np.array(list(map(len, texts))), docs, window), strict=True) for k in range(a, b)}
        want = set()
        for t, x in enumerate(texts):
            for s in range(len(x) - window + 1):
                if any(docs[o] < docs[t] and x[s : s + window] == y[k : k + window] for o, y in enumerate(texts) for k in range(len(y) - window + 1)):
                    want |= {(t, k) for k in range(s, s + window)}
        assert got == want


def test_suffixes_and_search():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 4, 80)
    order = sorted_suffixes(np.append(text, 0), 128)
    assert list(order) == sorted(range(81), key=lambda k: list(np.append(text, 0)[k:]))
    index = FMIndex(text, np.array([30, 50]), np.array([4, 2]))
    lo, hi = np.array([0]), np.array([index.n])
    for c in (2, 1):
        lo, hi = index.extend(np.array([c]), lo, hi)
    places = [k for k in range(79) if list(text[k : k + 2]) == [1, 2] and k != 29]
    assert hi[0] - lo[0] == len(places)
    assert index.least_document(lo, hi)[0] == min(4 if k < 30 else 2 for k in places)
