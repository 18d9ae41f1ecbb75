"""Repeated passages by compressed FM-indexes, one for each shard of the text.

A window is 13 consecutive words. A word is removed if it's in a window whose words also start in a document with a smaller
doc_id.

*Which windows may repeat.* Of the runs of 5 words, those with a hash under ``SAMPLED`` and those that have the least hash in
some window are counted by document (partial sums before the shuffle). A window that occurs in two documents has only shared
ones among its sampled runs, and its least one is shared as well. The shared ones go to the workers as a bitmap, of which the
size is bounded; where it's full, more windows go on, and none is lost.

*Shards.* Neighbouring windows that may repeat and have the same least run are one segment (21 words at most), and segments are
dealt out by that run: equal windows meet in one shard, and each window is in one shard only, so that the work grows with the
text and not with the number of pairs of shards. A shard has about ``SEGMENTS`` segments. In a shard, distinct segments are put
one after another, and suffixes are sorted; their preceding words (Burrows-Wheeler transform) are kept as a wavelet matrix,
with the least doc_id of any range of suffixes. Each segment is then streamed from its last word to its first: a
backward-search step narrows the range of suffixes, and goes on while there is one of a smaller doc_id. That gives the matching
statistics (for an end, the longest match in earlier documents); those of 13 words or more are reported. The words
themselves are compared, not hashes.

*Hot runs of words.* A run that more than ``HOT`` documents have (say, of a licence) would make its shard large, as at the
borders of the passage each document gives other segments. Its windows are dealt out each by its own 128-bit digest, with the
least doc_id found with partial results before the shuffle; an adaptive join brings it back to the windows. Whether a run is
hot is known from the counts above, for all of its windows alike.

Words are runs of characters other than ASCII white space, unchanged.

Defined results: null and empty texts have no words. Texts of fewer than 13 words lose none. A row with a null doc_id neither
loses words nor makes others lose any. Rows that repeat a doc_id are judged each by its own text, and not against each other.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bitmaps import Bits
from tidemark.llm.common import CHUNK_CHARS, _chunks, bounded_batches, cut, stored, text_mark
from tidemark.llm.suffix_dedup import _sliding, numbered_words, run_hashes

WINDOW, GRAM = 13, 5
RUNS = WINDOW - GRAM + 1
SAMPLED = np.uint64((1 << 64) // 4)
SEGMENTS, HOT = 60_000, 5_000


# ---- which windows may repeat ----


def words_of(text: str) -> tuple[list[bytes], np.ndarray]:
    words = text.encode().split()
    return words, np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)


def sampled_runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of GRAM words; the least one in each window; which runs are counted."""
    runs = run_hashes(hashes, GRAM)[0]
    least = _sliding(runs, RUNS, np.minimum)
    pad = np.zeros(RUNS - 1, np.uint64)
    most = _sliding(np.concatenate((pad, least, pad)), RUNS, np.maximum)
    return runs, least, (most == runs) | (runs < SAMPLED)


def _map(docs: DataFrame, make: Callable[[], Callable[[list, list, list[str]], dict | None]], schema: str) -> DataFrame:
    """Apply a function of (ids, marks, texts) to the rows of docs in bounded chunks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    bounded_batches(docs.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at, end in _chunks(batch.column(2), CHUNK_CHARS):
                got = f(*(batch.column(k).slice(at, end - at).to_pylist() for k in range(3)))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(got[k.name], type=k.type) for k in out], schema=out)

    return docs.select("doc_id", text_mark().alias("mark"), F.col("text").cast("string")).mapInArrow(run, schema)


def _count(ids: list, marks: list, texts: list[str]) -> dict | None:
    found = []
    for text in texts:
        words, hashes = words_of(text)
        if len(words) >= WINDOW:
            runs, _, counted = sampled_runs(hashes)
            found.append(np.unique(runs[counted]))
    if not found:
        return None
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    return {"key": keys.view(np.int64), "n": n}


def run_counts(docs: DataFrame) -> DataFrame:
    """key, n: the sampled runs of words that more than one document has, and how many have each."""
    return _map(docs, lambda: _count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")


# ---- segments ----


def may_repeat(hashes: np.ndarray, shared: Bits) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window may occur in two documents, and its least run."""
    runs, least, _ = sampled_runs(hashes)
    alone = np.concatenate(([0], np.cumsum((runs < SAMPLED) & ~shared.have(runs))))
    return (alone[RUNS:] == alone[:-RUNS]) & shared.have(least), least


def segments(maybe: np.ndarray, least: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each segment; a window of a hot run is one by itself."""
    at = np.arange(len(least))
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (maybe[1:] != maybe[:-1]) | hot[1:]
    since = at - np.maximum.accumulate(np.where(new, at, 0))
    new |= since % RUNS == 0
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(least)))
    keep = maybe[start]
    return start[keep], n[keep]


def _segments(docs: DataFrame, shared: Bits, hot: Bits) -> DataFrame:
    """key, hot, doc_id, mark, start, words: the segments of every document; of hot windows the digest instead of the words."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((shared, hot))

    def make():
        shared, hot = sent.value

        def run(ids: list, marks: list, texts: list[str]) -> dict | None:
            out = {k: [] for k in ("key", "hot", "doc_id", "mark", "start", "words")}
            for i, mark, text in zip(ids, marks, texts, strict=True):
                words, hashes = words_of(text)
                if len(words) < WINDOW:
                    continue
                maybe, least = may_repeat(hashes, shared)
                if not maybe.any():
                    continue
                single = maybe & hot.have(least)
                start, n = segments(maybe, least, single)
                line = b" ".join(words)
                at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
                some = map(line.__getitem__, map(slice, at[start].tolist(), (at[start + n + WINDOW - 1] - 1).tolist()))
                single = single[start]
                out["words"] += [xxhash.xxh3_128_digest(x) if h else x for x, h in zip(some, single.tolist(), strict=True)] if single.any() else list(some)
                out["key"].append(least[start].view(np.int64))
                out["hot"].append(single)
                out["start"].append(start)
                out["doc_id"].append(np.full(len(start), i, np.int64))
                out["mark"].append(np.full(len(start), mark, np.int64))
            return {k: v if k == "words" else np.concatenate(v) for k, v in out.items()} if out["key"] else None

        return run

    return _map(docs, make, "key bigint, hot boolean, doc_id bigint, mark bigint, start int, words binary")


# ---- the index of a shard ----


class WaveletMatrix:
    """A sequence of numbers as one bit vector for each binary digit, with counts of ones at every 64 bits."""

    def __init__(self, sequence: np.ndarray, size: int):
        self.digits = max(1, int(size - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        for d in range(self.digits - 1, -1, -1):
            bit = (sequence >> d & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))
        numbers = np.arange(size)
        self.first = self._down(numbers, np.zeros(size, np.int64))

    def _down(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, ones, zeros) in enumerate(zip(self.bits, self.ones, self.zeros, strict=True)):
            block = at >> 6
            before = ones[block] + np.bitwise_count(bits[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(number >> (self.digits - 1 - k) & 1, zeros + before, at - before)
        return at

    def rank(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each number occurs before each place."""
        return self._down(number, at) - self.first[number]


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` numbers or more, by doubling; ties in any order."""
    rank, have = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        following = np.zeros(len(rank), np.int64)
        following[:-have] = rank[have:]
        key = rank * (len(rank) + 1) + following
        order = np.argsort(key, kind="stable")
        have *= 2
        if have >= depth:
            return order
        new = np.empty(len(key), np.int64)
        new[order] = np.cumsum(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        rank = new


class FMIndex:
    """Index of short texts of numbers (1 and up), each of a document: backward search with the least document of a range."""

    def __init__(self, texts: np.ndarray, lengths: np.ndarray, documents: np.ndarray):
        """texts: all numbers one after another; lengths and documents: of each text. Documents are numbers of 32 bits."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        joined = np.zeros(len(texts) + len(lengths), np.int64)
        joined[np.arange(len(texts)) + owner] = texts
        of = documents[np.repeat(np.arange(len(lengths)), lengths + 1)].astype(np.int32)
        order = sorted_suffixes(joined, int(lengths.max()) + 1)
        size = int(joined.max()) + 1
        self.n = len(joined)
        self.before = WaveletMatrix(joined[order - 1], size)
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(joined, minlength=size))[:-1]))
        self.least = [of[order]]
        while len(self.least[-1]) > 1 << len(self.least) - 1:
            half = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def extend(self, number: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes of one more number before them."""
        both = self.smaller[np.concatenate((number, number))] + self.before.rank(np.concatenate((number, number)), np.concatenate((at, end)))
        return both[: len(at)], both[len(at) :]

    def least_document(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least document in each range that isn't empty."""
        level = np.frexp((end - at).astype(float))[1] - 1
        out = np.empty(len(at), np.int32)
        for k in np.unique(level):
            some = level == k
            out[some] = np.minimum(self.least[k][at[some]], self.least[k][end[some] - (1 << k)])
        return out


def matches(texts: np.ndarray, lengths: np.ndarray, documents: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, start, end: matching statistics of each text against the texts of smaller documents, where they are ``window`` long
    or more and not part of the one that was reported before.

    All texts go through the index together, a step at a time.
    """
    index = FMIndex(texts, lengths, documents)
    first = np.cumsum(lengths) - lengths
    documents = documents.astype(np.int32)
    text = np.flatnonzero(lengths >= window)
    end = lengths[text].copy()
    at, lo, hi = end.copy(), np.zeros(len(text), np.int64), np.full(len(text), index.n)
    found = []
    while len(text):
        new_lo, new_hi = index.extend(texts[first[text] + at - 1], lo, hi)
        goes_on = new_lo < new_hi
        goes_on[goes_on] = index.least_document(new_lo[goes_on], new_hi[goes_on]) < documents[text[goes_on]]
        at = at - goes_on
        lo, hi = np.where(goes_on, new_lo, lo), np.where(goes_on, new_hi, hi)
        stops = ~goes_on | (at == 0)
        report = stops & (end - at >= window)
        found.append((text[report], at[report], end[report]))
        again = stops & (at > 0) & (end > window)
        end = end - again
        at, lo, hi = np.where(again, end, at), np.where(again, 0, lo), np.where(again, index.n, hi)
        keep = ~stops | again
        text, end, at, lo, hi = text[keep], end[keep], at[keep], lo[keep], hi[keep]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def shard_spans(rows: pa.Table) -> pa.Table:
    """doc_id, mark, start, end: repeated words of the segments of one shard (doc_id, mark, start, words)."""
    doc_id, mark, start = (rows.column(k).to_numpy() for k in ("doc_id", "mark", "start"))
    coded = rows.column("words").combine_chunks().dictionary_encode()
    which = coded.indices.to_numpy()
    _, lengths, texts = numbered_words(coded.dictionary)
    lengths, texts = lengths.astype(np.int64), texts.astype(np.int64)
    own = np.full(len(lengths), np.iinfo(np.int64).max)
    np.minimum.at(own, which, doc_id)
    text, a, b = matches(texts, lengths, np.unique(own, return_inverse=True)[1])
    # Of a segment's documents the first has what was found; the others have all of it from the first.
    later = np.flatnonzero(doc_id > own[which])
    firsts = np.flatnonzero(doc_id == own[which])
    order = np.argsort(text, kind="stable")
    text, a, b = text[order], a[order], b[order]
    lo, hi = np.searchsorted(text, which[firsts]), np.searchsorted(text, which[firsts], "right")
    row = np.repeat(firsts, hi - lo)
    at = np.arange(len(row)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
    rows_out = np.concatenate((later, row))
    return pa.table({
        "doc_id": doc_id[rows_out], "mark": mark[rows_out],
        "start": (start[rows_out] + np.concatenate((np.zeros(len(later), np.int64), a[at]))).astype(np.int32),
        "end": (start[rows_out] + np.concatenate((lengths[which[later]], b[at]))).astype(np.int32),
    })


# ---- the operator ----


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, mark, start, end: stretches of words that also stand in a document with a smaller doc_id, and cover all such
    words; they may overlap. A row of docs is known by doc_id and ``common.text_mark``.
    """
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    counts = cut(run_counts(docs))
    hot = counts.filter(F.col("n") > HOT)
    n, occurrences, n_hot = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > HOT)).first()
    found = stored(_segments(docs, Bits(counts, n), Bits(hot, n_hot)))
    shards = max(1, -(-occurrences // SEGMENTS))
    dealt = found.filter("NOT hot").select(F.pmod("key", F.lit(shards)).alias("shard"), "doc_id", "mark", "start", "words")
    spans = dealt.groupBy("shard").applyInArrow(shard_spans, "doc_id bigint, mark bigint, start int, end int")
    single = found.filter("hot").select("doc_id", "mark", "start", "words")
    first = single.groupBy(F.col("words").alias("digest")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    # Joined by another key than the aggregation's, so that both sides are dealt out by the join, which may split a hot one.
    later = single.withColumn("k", F.xxhash64("words")).join(first.withColumn("k", F.xxhash64("digest")), "k").filter("words = digest AND doc_id > least")
    return spans.unionByName(later.select("doc_id", "mark", "start", (F.col("start") + WINDOW).alias("end")))


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words of every document that aren't repeated from an earlier one, joined by a space.

    Only texts with something to remove are shuffled to their spans; a bitmap of bounded size lets the others pass straight on.
    """
    bounded_batches(docs.sparkSession)
    key = F.xxhash64("_id", "_mark").alias("key")
    spans = repeats(docs).groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = cut(spans)
    shared = docs.sparkSession.sparkContext.broadcast(Bits(spans.select(key), spans.count()))

    @F.pandas_udf("boolean")
    def may_have_spans(keys: pd.Series) -> pd.Series:
        return pd.Series(shared.value.have(keys.to_numpy().view(np.uint64)))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_mark().alias("mark"))
    rows = rows.withColumn("may", may_have_spans(F.xxhash64("doc_id", "mark")))
    joined = rows.filter("may").join(spans, (rows["doc_id"] == spans["_id"]) & (rows["mark"] == spans["_mark"]), "left")
    out = joined.select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    none = F.lit(None).cast("array<int>")
    out = out.unionByName(rows.filter("NOT may").select("doc_id", "text", none.alias("starts"), none.alias("ends")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for k in range(batch.num_rows):
                words = (batch.column(1)[k].as_py() or "").encode().split()
                gone = 0
                n_words.append(len(words))
                if batch.column(2)[k].is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, batch.column(2)[k].values.to_numpy(), 1)
                    np.add.at(edge, batch.column(3)[k].values.to_numpy(), -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    gone = len(words) - int(stay.sum())
                    words = itertools.compress(words, stay.tolist())
                n_removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return out.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, unnest(range(len(ws) - 12)) AS s, ws FROM d WHERE len(ws) >= 13),
x AS (SELECT r, doc_id, s, array_to_string(ws[s + 1 : s + 13], ' ') AS words FROM w),
f AS (SELECT words, min(doc_id) AS first_doc FROM x GROUP BY words),
gone AS (SELECT DISTINCT r, s + k AS i FROM x JOIN f USING (words), (SELECT unnest(range(13)) AS k) WHERE doc_id > first_doc),
each AS (SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM each ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
