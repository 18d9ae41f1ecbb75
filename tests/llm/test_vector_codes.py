"""Vector codes against plain Python over awkward vectors."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, pos int, part string, error string, uid int, entries int"


def plain(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label) of one length. The contract, word by word."""
    x = [(i, [math.floor(256 * v) for v in e], label) for i, e, label in rows if e is not None and all(v is not None and math.isfinite(v) for v in e)]
    if not x:
        return []
    x.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(x[0][1]) // parts
    cut = [[e[p * width : (p + 1) * width] for p in range(parts)] for _, e, _ in x]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(near(p, c[p])[1], []).append(c[p])
            for k, vs in own.items():
                new = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
                own[k] = new
            books[p] = [own.get(k, e) for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = []
    for (i, _, label), c in zip(x, cut, strict=True):
        got = [near(p, c[p]) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label])
    sums = {}
    for _, _, e, label in out:
        sums[label] = sums.get(label, 0) + e
    return [(i, code, e, sums[label], digest) for i, code, e, label in out]


def order(rows):
    return sorted(rows, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], SCHEMA)


def vectors(n, width, seed, values=None):
    rng = np.random.default_rng(seed)
    e = rng.choice(values, (n, width)) if values else rng.normal(0, 0.3, (n, width))
    return [[float(np.float32(v)) for v in r] for r in e]


@pytest.mark.parametrize("n, width", [(300, 32), (40, 64), (1, 16), (200, 16)])
def test_equals_plain_python(spark, n, width):
    """Also with fewer vectors than entries, hot parts, ties, repeated rows and null labels and ids."""
    e = vectors(n, width, 7) if width != 16 else vectors(n, width, 3, [-0.5, 0.25, 0.251])
    rows = [(int(i) * 3 - 50, v, [None, 1, 2][i % 3]) for i, v in enumerate(e)]
    rows += [(rows[0][0], v, 5) for v in vectors(2, width, 9)] + [rows[-1], rows[-1]]
    rows += [(None, v, 2) for v in vectors(1, width, 11)]
    rows += [(900 + k, e[0], None) for k in range(150)]
    bad = [(-99, None, 1), (-98, [None] * width, 1), (-97, [float("nan")] * width, 1), (-96, [float("inf")] + [0.0] * (width - 1), 1)]
    got = vector_codes.report(frame(spark, rows + bad).repartition(5)).collect()
    assert order(map(tuple, got)) == order(plain(rows))


def test_other_lengths_and_sizes_are_left_out(spark):
    e = vectors(20, 16, 1)
    rows = [(i, v, 1) for i, v in enumerate(e)]
    odd = [(50, [0.5] * 32, 1), (51, [0.5] * 15, 1), (52, [], 1), (53, [1e30] + [0.0] * 15, 1)]
    assert order(map(tuple, vector_codes.report(frame(spark, rows + odd)).collect())) == order(plain(rows))


def test_no_vectors(spark):
    out = vector_codes.report(frame(spark, []))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    assert vector_codes.report(frame(spark, [(1, None, 1)])).count() == 0


def test_codes_give_back_the_vectors_up_to_the_error(spark):
    e = vectors(100, 32, 2)
    rows, books = vector_codes.compress(frame(spark, [(i, v, 1) for i, v in enumerate(e)]))
    for r in rows.collect():
        back = np.concatenate([books[p, k] for p, k in enumerate(r["entries"])])
        assert ((back - np.floor(np.array(e[r["vec_id"]]) * 256)) ** 2).sum() == r["error"]
