"""Global ranks and resampling over many range partitions, against NumPy."""

import numpy as np
import pytest

from tidemark.operators import inference, ranking


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """300,000 rows in 8 files: two groups of values with many ties, a third of all values the same."""
    rng = np.random.default_rng(21)
    n = 300_000
    a, b = np.round(rng.normal(size=n), 3), np.round(rng.normal(0.01, 1.0, n), 3)
    a[rng.random(n) < 0.33] = 0.5
    path = str(tmp_path_factory.mktemp("many") / "t")
    import pandas as pd

    spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "fold": np.where(np.arange(n) % 3, "x", "y"), "a": a, "b": b})).repartition(8).write.parquet(path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield spark.read.parquet(path), a, b
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quarters_lose_no_row(many):
    df, _, b = many
    got = ranking.quarters(df, "b", "id").toPandas()
    assert len(got) == len(b)
    order = np.lexsort((np.arange(len(b)), b))
    want = np.empty(len(b), int)
    want[order] = np.minimum(np.arange(len(b)) // (len(b) // 4), 3) + 1
    assert (want[got["id"].to_numpy()] == got["quarter"].to_numpy()).all()


def test_cliffs_delta_of_all_pairs(many):
    df, a, b = many
    long = df.selectExpr("'a' AS g", "a AS v").unionByName(df.selectExpr("'b' AS g", "b AS v"))
    s = np.sort(b)
    want = (np.searchsorted(s, a, "left") - (len(s) - np.searchsorted(s, a, "right"))).sum() / len(a) / len(b)
    assert inference.cliffs_delta(long, "g", "v", "a", "b").first()["delta"] == pytest.approx(want, abs=1e-12)


def _signed(d):
    d = d[d != 0]
    values, at, n = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - n + (n + 1) / 2)[at]
    return len(d), rank[d > 0].sum(), rank[d < 0].sum(), float((n.astype(float) ** 3 - n).sum())


@pytest.mark.parametrize("keys", [[], ["fold"]])
def test_signed_ranks_of_all_rows(many, keys):
    df, a, b = many
    fold = np.where(np.arange(len(a)) % 3, "x", "y")
    for r in inference.signed_ranks(df, *keys).collect():
        mine = fold == r["fold"] if keys else np.ones(len(a), bool)
        n, plus, minus, ties = _signed(a[mine] - b[mine])
        assert (r["n"], r["w_plus"], r["w_minus"], r["tie_term"]) == (n, pytest.approx(plus, rel=1e-12), pytest.approx(minus, rel=1e-12), pytest.approx(ties, rel=1e-12))


def test_bootstrap_in_blocks(many, monkeypatch):
    """In blocks the interval is as wide as the normal one."""
    df, a, b = many
    monkeypatch.setattr(inference, "BLOCK", 40_000)
    r = inference.bootstrap(df.filter("fold = 'y'"), ["fold"], draws=400).first()
    d = (a - b)[::3]
    half = 1.96 * d.std() / np.sqrt(len(d))
    assert r["mean_difference"] == pytest.approx(d.mean(), abs=1e-12)
    assert r["low"] == pytest.approx(d.mean() - half, abs=0.25 * half) and r["high"] == pytest.approx(d.mean() + half, abs=0.25 * half)


def test_bootstrap_of_one_block_is_the_seeded_one(spark):
    d = np.array([0.3, -0.1, 0.7, 0.2, -0.4])
    df = spark.createDataFrame([("k", float(x), 0.0) for x in d], "k string, a double, b double")
    r = inference.bootstrap(df, ["k"], draws=1000, seed=7).first()
    rng = np.random.default_rng(7)
    means = np.concatenate([np.sort(d)[rng.integers(0, 5, (500, 5))].mean(axis=1) for _ in range(2)])
    assert (r["low"], r["high"]) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975)))
