"""Periodic runs of words by tandem repeats: blocks, a vocabulary of squares, located occurrences.

A run is a stretch of words with smallest period q (words q apart are equal) of ``LEAST_WORDS`` words and ``LEAST_TIMES`` periods
or more, which no neighbouring word extends. The method is that of Gusfield and Stoye, in arrays over many texts at a time
(one string, each text ended by a mark of its own):

1. Lempel-Ziv blocks: each is the longest stretch that also begins further left (from the neighbours in suffix order).
2. Around the borders of each block, common extensions to both sides find squares of every root up to the length of the block
   and the next one. They cover the leftmost occurrence of every square.
3. From each of them a walk along suffix links (one word to the right, in the suffix tree whose nodes are ranges of the suffix
   array with their common prefix) gives its rotations, and so completes the vocabulary: a node for each different square.
   Squares whose root is itself a repetition are left out, so that periods are smallest ones.
4. The occurrences below each node are located; those of one root length that follow one another make a run.

Suffixes are sorted by doubling, so that steps 1 to 4 take time in proportion to n log n, and memory of some 300 bytes a word of
what is looked at. A text without 16 words that occur twice in it can't hold a run (words of a run equal those q on, over 16
words at least) and doesn't go through the steps.

Words are runs of characters other than ASCII white space.

Defined results: null and empty texts have no words and no run. Rows are judged each by itself, whatever their doc_id (null too).
An empty table gives an empty result. Extra columns are ignored. A very long text is a string by itself.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts
from tidemark.llm.suffix_dedup import run_hashes

LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words at the start of a run that stand again a period further on, at least: the lesser of 24 - q and 2 q over all q.
SAME = LEAST_WORDS * (LEAST_TIMES - 1) // LEAST_TIMES


class Suffixes:
    """Suffix order of a string whose last number occurs once, with common extensions of any two places."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        self.ranks = [rank.astype(np.int32)]  # of the stretch of 1, 2, 4, ... numbers from each place
        size = 1
        while True:
            key = rank * (self.n + 1)
            key[:-size] += rank[size:] + 1
            order = np.argsort(key, kind="stable")
            sorted_keys = key[order]
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], sorted_keys[1:] != sorted_keys[:-1])))
            size *= 2
            if rank[order[-1]] == self.n - 1:
                break
            self.ranks.append(rank.astype(np.int32))
        self.order, self.rank = order, rank

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on equal those from j on (i and j differ)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for level in range(len(self.ranks) - 1, -1, -1):
            r = self.ranks[level]
            same = (r[i] == r[j]) * (1 << level)
            i += same
            j += same
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers up to and with i equal those up to j; either may be -1."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for level in range(len(self.ranks) - 1, -1, -1):
            r, size = self.ranks[level], 1 << level
            a, b = i - size + 1, j - size + 1
            same = ((a >= 0) & (b >= 0) & (r[np.maximum(a, 0)] == r[np.maximum(b, 0)])) * size
            i -= same
            j -= same
        return start - i

    def common(self) -> list[np.ndarray]:
        """Common prefix of each suffix with the one before it in order, and the least over each 2, 4, ... of them."""
        out = [np.concatenate(([0], self.forward(self.order[:-1], self.order[1:]))).astype(np.int32)]
        while len(out[-1]) > 1 << len(out) - 1:
            half = 1 << len(out) - 1
            out.append(np.minimum(out[-1][:-half], out[-1][half:]))
        return out


def nodes(common: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range in suffix order of those that share the first ``depth`` numbers with the suffix at each place of it."""
    lo, hi = at.copy(), at.copy()
    last = len(common[0]) - 1
    for level in range(len(common) - 1, -1, -1):
        least, size = common[level], 1 << level
        first = lo - size + 1
        lo -= ((first > 0) & (least[np.maximum(first, 0)] >= depth)) * size
        ahead = hi + size
        hi += ((ahead <= last) & (least[np.minimum(hi + 1, len(least) - 1)] >= depth)) * size
    return lo, hi + 1


def blocks(s: Suffixes) -> np.ndarray:
    """First places of the Lempel-Ziv blocks, and the end."""
    before, after = np.full(s.n, -1), np.full(s.n, -1)
    before[s.order[1:]], after[s.order[:-1]] = s.order[:-1], s.order[1:]
    left, right = before.tolist(), after.tolist()
    for i in range(s.n - 1, -1, -1):  # what is left of the list are the places before i, in suffix order
        p, q = left[i], right[i]
        if p >= 0:
            right[p] = q
        if q >= 0:
            left[q] = p
    i = np.arange(s.n)
    longest = np.ones(s.n, np.int64)
    for near in (np.array(left), np.array(right)):
        some = near >= 0
        longest[some] = np.maximum(longest[some], s.forward(i[some], near[some]))
    longest, starts, at = longest.tolist(), [], 0
    while at < s.n:
        starts.append(at)
        at += longest[at]
    return np.array([*starts, s.n])


def _counted(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each count c: its index c times, and the numbers 0 to c - 1."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def covering_squares(s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, root, count: places first, first + 1, ... where squares of that root length stand; the leftmost of each square is there."""
    edges = blocks(s)
    size = np.diff(edges)
    found = []
    # Squares around the border with the next block, with a root up to the length of the block.
    block, k = _counted(size[:-1])
    found.append((edges[block + 1] - k - 1, edges[block + 1], k + 1))
    # Squares around the start of the block, with a root up to the lengths of the block and the next.
    block, k = _counted(size + np.append(size[1:], 0))
    inside = edges[block] + k + 1 < s.n
    found.append((edges[block][inside], (edges[block] + k + 1)[inside], k[inside] + 1))
    i, j, root = map(np.concatenate, zip(*found, strict=True))
    right, left = s.forward(i, j), s.backward(i - 1, j - 1)
    square = left + right >= root
    first, root, count = (i - left)[square], root[square], (left + right - root + 1)[square]
    one = np.unique(first * (s.n + 1) + root, return_index=True)[1]
    return first[one], root[one], count[one]


def primitive(s: Suffixes, first: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Whether the root of each square isn't itself a repetition."""
    most = int(root.max(initial=1))
    least_prime = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if least_prime[p] == p:
            multiples = least_prime[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    out, rest = np.ones(len(root), bool), root.copy()
    while (more := np.flatnonzero(rest > 1)).size:
        p = least_prime[rest[more]]
        d = root[more] // p
        out[more] &= s.forward(first[more], first[more] + d) < 2 * root[more] - d
        rest[more] //= p
    return out


def vocabulary(s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (range in suffix order) of the different squares with primitive roots, and the root lengths."""
    first, root, count = covering_squares(s)
    real = primitive(s, first, root)
    first, root, count = first[real], root[real], count[real]
    which, step = _counted(np.minimum(count, root))  # after as many steps as the root has numbers, the walk is where it began
    root = root[which]
    lo, hi = nodes(s.common(), s.rank[first[which] + step], 2 * root)
    one = np.unique(lo * (s.n + 1) + root, return_index=True)[1]
    return lo[one], hi[one], root[one]


def runs(text: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all runs of two periods or more; the last number of the text must
    occur once."""
    s = Suffixes(text)
    lo, hi, root = vocabulary(s)
    which, k = _counted(hi - lo)
    place = s.order[lo[which] + k]
    key = np.sort(root[which] * (s.n + 1) + place)
    opens = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    ends = np.append(opens[1:], len(key)) - 1 if len(opens) else opens
    period, start = np.divmod(key[opens], s.n + 1)
    out = np.stack((start, key[ends] - key[opens] + 2 * period, period), 1)
    return out[np.lexsort((period, start))]


def may_have_run(words: list[bytes]) -> bool:
    if len(words) < LEAST_WORDS:
        return False
    same = np.sort(run_hashes(np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64), SAME)[0])
    return bool((same[1:] == same[:-1]).any())


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text (a list of words) its runs of LEAST_WORDS words and LEAST_TIMES periods or more."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(texts)
    some = [k for k, words in enumerate(texts) if may_have_run(words)]
    if not some:
        return out
    known: dict[bytes, int] = {}
    sizes = np.array([len(texts[k]) + 1 for k in some])
    first = np.cumsum(sizes) - sizes
    joined = np.fromiter((known.setdefault(w, len(known)) for k in some for w in (*texts[k], b"%d \n" % k)), np.int64, int(sizes.sum()))
    found = runs(joined)  # no word holds white space, so that the marks differ from all words
    found = found[(found[:, 1] >= LEAST_WORDS) & (found[:, 1] >= LEAST_TIMES * found[:, 2])]
    at = np.searchsorted(found[:, 0], np.append(first, len(joined)))
    for j, k in enumerate(some):
        out[k] = found[at[j] : at[j + 1]] - [first[j], 0, 0]
    return out


def collapse(words: list[bytes], found: np.ndarray) -> bytes:
    """The words but for those that a run repeats after its first period, joined by a space."""
    if not len(found):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return b" ".join(itertools.compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))


def _found(ids: list, texts: list[str]) -> dict:
    split = [t.encode().split() for t in texts]
    found = runs_of_texts(split)
    rows = [[{"start": a, "length": n, "period": q} for a, n, q in f.tolist()] for f in found]
    return {"doc_id": ids, "runs": rows, "collapsed": [collapse(w, f).decode() for w, f in zip(split, found, strict=True)]}


def find(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period), collapsed (the text with each run cut to one period)."""
    return map_texts(docs, lambda: _found, "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id, text: the texts in which the query looks for runs. Of a tenth of the documents, by the checksum of doc_id, the
    words from one place on are replaced by repetitions of those that stand there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    text = F.col("text").cast("string")
    some = docs.select("doc_id", text.alias("text"), h.alias("h"), F.floor(h / 10).cast("bigint").alias("g"), F.when(h % 10 == 0, F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).alias("words"))
    some = some.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.expr("int(g % n)")))
    some = some.withColumn("p", F.expr("int(1 + floor((n - a) / (3 + g % 8)))"))
    looped = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), int(ceil((n - a) / p)))), 1, n - a))")
    return some.select("doc_id", F.when(F.col("n") > 0, F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""
    found = find(with_loops(docs))
    # Runs come by start and period, so that of equal exponents the first stays.
    greatest = F.expr("aggregate(slice(runs, 2, greatest(0, size(runs) - 1)), get(runs, 0), (m, r) -> IF(r.length * m.period > m.length * r.period, r, m))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("*", greatest.alias("m")).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "m.start", "m.length", "m.period",
        F.expr("m.length * 1000 DIV m.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
