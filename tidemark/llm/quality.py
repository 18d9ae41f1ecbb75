"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The trees are fitted on the driver from a bounded sample of labelled rows (``MOST_ROWS``, chosen by a hash of doc_id), by
logistic loss, level by level: gradients are summed in a histogram for each node, feature and bin. A fitted model is
three arrays (feature, threshold, leaf value), complete binary trees one beside the other, so that a batch of documents
goes down all trees by array indexing.

Inputs are numbers computed from the text alone: lengths, shares of kinds of characters, repetition of words, word pairs
and lines, compressibility.

Defined results: null and empty texts have statistics 0 and are scored like others; without labels (or with one class
only) the score is the share of label 1 (0.5 without labels). Labels with null doc_id or quality are ignored; repeated
rows give repeated rows (a doc_id that repeats: each of its rows is scored by its own text; learnt from is the one with the
least statistics, with the mean of its labels). Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filter_texts, held_out, map_texts, sampled

#: Labelled rows to learn from, about.
MOST_ROWS = 40_000
#: Documents with a lower score are rejected.
LEAST_SCORE = 0.3
FEATURES = (
    "log_chars log_words word_length longest_word unique_words top_word unique_pairs upper_share digit_share space_share "
    "symbol_share stop_share mark_share other_share log_lines repeated_lines line_length compressed capital_words"
).split()
_KIND = np.zeros(256, np.int64)  # others: 0
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?", b"!\"'()-", b"#$%&*+/<=>@[\\]^_`{|}~"), 1):
    _KIND[list(_chars)] = _k
_KIND[0x80:] = 8


def statistics(text: str) -> list[float]:
    data = text.encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    if not words:
        return [0.0] * len(FEATURES)
    n, n_words = len(data), len(words)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=9) / n
    counts = Counter(words)
    sizes = [len(w) for w in words]
    letters = kinds[1] + kinds[2] + kinds[8]
    return [
        np.log1p(len(text)),
        np.log1p(n_words),
        sum(sizes) / n_words,
        np.log1p(max(sizes)),
        len(counts) / n_words,
        max(counts.values()) / n_words,
        len(set(zip(words, words[1:], strict=False))) / max(1, n_words - 1),
        kinds[2] / letters if letters else 0.0,
        kinds[3],
        kinds[4],
        kinds[7],
        kinds[5],
        kinds[6],
        kinds[0] + kinds[8],
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        len(zlib.compress(data, 1)) / n,
        sum(c for w, c in counts.items() if w.isupper()) / n_words,
    ]


class Trees:
    """Boosted trees of equal depth in flat arrays: node k has the children 2k + 1 and 2k + 2 (larger values)."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            raw += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-raw))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
        n, f = x.shape
        share = y.mean() if n else 0.5
        inner, leaves = 2**depth - 1, 2**depth
        if n == 0 or share in (0.0, 1.0):
            return cls(float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j]) for j in range(f)], axis=1)  # bin b: value <= edges[b]
        base = float(np.log(share / (1 - share)))
        raw = np.full(n, base)
        out = cls(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
        for t in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                width = 2**level
                best, pick, cut = np.zeros(width), np.zeros(width, np.int64), np.full(width, bins)
                total_g, total_h = np.bincount(node, g, width), np.bincount(node, h, width)
                whole = total_g**2 / (total_h + l2)
                for j in range(f):
                    if not len(edges[j]):
                        continue
                    at = node * bins + binned[:, j]
                    lg = np.bincount(at, g, width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1]
                    lh = np.bincount(at, h, width * bins).reshape(width, bins).cumsum(axis=1)[:, :-1]
                    rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
                    gain = lg**2 / (lh + l2) + rg**2 / (rh + l2) - whole[:, None]
                    gain[(lh < least) | (rh < least)] = 0
                    gain = gain[:, : len(edges[j])]
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(width), k]
                    better = top > best + 1e-9
                    best[better], pick[better], cut[better] = top[better], j, k[better]
                for i in range(width):
                    if cut[i] < bins:
                        out.feature[t, width - 1 + i] = pick[i]
                        out.threshold[t, width - 1 + i] = edges[pick[i]][cut[i]]
                node = 2 * node + (binned[np.arange(n), pick[node]] > cut[node])
            value = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + l2)
            out.leaf[t] = value
            raw += value[node]
        return out


def _table(texts: list[str]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Trees:
    """Fit to labels.quality of rows that aren't held out, one row for each doc_id: the sample is bounded by ``most_rows``
    whatever repeats, so its join is a broadcast and what reaches the driver has that bound."""
    usable = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(0, 5))
    usable = usable.groupBy("doc_id").agg(F.avg(F.col("quality").cast("int")).alias("quality"))
    sample = usable.filter(sampled(most_rows, usable.count()))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    found = map_texts(texts, lambda: lambda ids, x: {"doc_id": ids, "x": list(_table(x))}, "doc_id bigint, x array<double>")
    rows = found.groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(sample), "doc_id").toArrow()
    if not rows.num_rows:
        return Trees.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(rows.column("x").to_pylist(), np.float64)
    y = rows.column("quality").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, rows.column("doc_id").to_numpy()))
    return Trees.fit(x[order], y[order])


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score (0 to 1; higher: good quality likelier)."""
    return map_texts(docs, lambda: lambda ids, texts: {"doc_id": ids, "score": model.score(_table(texts))}, "doc_id bigint, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(0, 5).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns; each row is judged by its own text."""
    model = train(docs, labels)
    return filter_texts(docs, lambda: lambda texts: model.score(_table(texts)) >= LEAST_SCORE)
