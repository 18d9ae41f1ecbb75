"""Repeated passages by a sparse suffix array over the words of all documents.

Of all suffixes only those at minimisers are kept: in every window of ``LENGTH`` words the run of ``GRAM`` words with the
least hash (the first of equal ones). The choice depends on the window's words alone, so that copies of a window keep the same
suffix. A kept suffix stands for the windows whose minimiser it is; those reach from it to the left and to the right.

First pass: the keys of the kept suffixes (hash of their first GRAM words) are counted by document, with partial results before
the shuffle. A key of one document can't be part of a repeat; the others go to the workers as a bitmap of bounded size.
Second pass: each suffix whose key may be shared is a row with the words of its windows, dealt out by its key. In a shard of
about ``SUFFIXES`` of them,

* suffixes are sorted by what follows, and by what comes before, read backwards;
* neighbours in either order are compared, word by word: their common extensions to the right and to the left;
* for a window that begins o words before its suffix, the suffixes that agree in o words to the left and in the rest to the right
  have that window. Both are stretches of an order between neighbours that agree in less, so that each of its classes is a pair of
  stretches, and the smallest doc_id of a class is the window's first document.

So no window is lost because the neighbour that agrees most to the right agrees less to the left, and words are compared, not
hashes.

A key that more than ``HOT`` documents have would make its shard large. Its windows are brought together each by its own
128-bit digest instead, with the least and largest doc_id found with partial results before the shuffle, and joined back.

A word is repeated from document f if it's in a window of LENGTH words whose first document (smallest doc_id) is f and that
occurs in another document too. Words are runs of characters other than ASCII white space, upper-case A-Z taken as lower-case.

Defined results: null and empty texts and texts of fewer than LENGTH words have no passage; rows with a null doc_id are
left out; rows that repeat a doc_id are one document. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bitmaps import Bits
from tidemark.llm.common import CHUNK_CHARS, cut, map_texts, stored

LENGTH, GRAM = 50, 8
BEFORE = LENGTH - GRAM
SUFFIXES, HOT = 10_000, 2_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, text.encode().lower().split())), np.uint64)


def run_hashes(words: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size, hashes of all runs of so many words (polynomials modulo 2**64, from running sums)."""
    power, inverse = _power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[:-1], out=sums[1:])
    out = []
    for n in sizes:
        h = (sums[n:] - sums[:-n]) * inverse[: len(words) - n + 1]
        h ^= h >> np.uint64(31)
        h *= _MIX
        out.append(h ^ h >> np.uint64(29))
    return out


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (run hashes) of the kept suffixes; the minimiser of each window; hash of each window."""
    grams, windows = run_hashes(words, GRAM, LENGTH)
    width = LENGTH - GRAM + 1
    least = _sliding(grams, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate((pad, least, pad)), width, np.maximum)
    return grams[most == grams], least, windows


def _keys(ids: list, texts: list[str]) -> dict | None:
    found = [np.unique(minimisers(words)[0]) for words in map(word_hashes, texts) if len(words) >= LENGTH]
    if not found:
        return None
    keys, n = np.unique(np.concatenate(found), return_counts=True)
    return {"key": keys.view(np.int64), "n": n}


def shared_keys(docs: DataFrame) -> DataFrame:
    """key, n: suffix keys that more than one document has, and how many have each."""
    return map_texts(docs, lambda: _keys, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")


def kept_suffixes(words: np.ndarray, shared: Bits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window, number of windows and place of each kept suffix whose key may be shared."""
    grams = run_hashes(words, GRAM)[0]
    least = _sliding(grams, BEFORE + 1, np.minimum)
    maybe = shared.have(least)
    at = np.flatnonzero(maybe)
    if not len(at):
        return (np.zeros(0, np.uint64), *[at] * 3)
    place = at + np.lib.stride_tricks.sliding_window_view(grams, BEFORE + 1)[at].argmin(1)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(place) > 0))))
    return least[at[new]], at[new], np.diff(np.append(new, len(at))), place[new]


def _suffixes(docs: DataFrame, shared: Bits, hot: Bits) -> DataFrame:
    """key, hot, doc_id, start, n, before, words: of every kept suffix the first window that it stands for and their number, how
    many of its words come before it, and the words; of a hot key each window by itself, with a digest instead of the words."""
    sent = docs.sparkSession.sparkContext.broadcast((shared, hot))

    def make():
        shared, hot = sent.value

        def run(ids: list, texts: list[str]) -> dict | None:
            parts = {k: [] for k in ("key", "hot", "doc_id", "start", "n", "before", "words")}
            for i, text in zip(ids, texts, strict=True):
                words = text.encode().lower().split()
                if len(words) < LENGTH:
                    continue
                key, start, n, place = kept_suffixes(np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64), shared)
                if not len(key):
                    continue
                single = hot.have(key)
                times = np.where(single, n, 1)
                row = np.repeat(np.arange(len(key)), times)
                step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                single, first, count = single[row], start[row] + step, np.where(single, 1, n)[row]
                line = b" ".join(words)
                at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
                some = map(line.__getitem__, map(slice, at[first].tolist(), (at[first + count + LENGTH - 1] - 1).tolist()))
                parts["words"] += [xxhash.xxh3_128_digest(x) if h else x for x, h in zip(some, single.tolist(), strict=True)]
                for name, values in (("key", key[row].view(np.int64)), ("hot", single), ("doc_id", np.full(len(row), i, np.int64)), ("start", first), ("n", count), ("before", (place[row] - first))):
                    parts[name].append(values)
            return {k: v if k == "words" else np.concatenate(v) for k, v in parts.items()} if parts["key"] else None

        return run

    return map_texts(docs, make, "key bigint, hot boolean, doc_id bigint, start bigint, n int, before int, words binary", chunk=CHUNK_CHARS // 4)


def numbered_words(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place and number of words of each line (words joined by a space), and all words as numbers from 1."""
    split = pc.split_pattern(lines, " ")
    offsets = split.offsets.to_numpy()
    flat = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int32)
    flat += 1
    return offsets[:-1] - offsets[0], np.diff(offsets), flat


def ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows (numbers from 1, 0 after the end) in sorted order, and how much each has in common with the one before it."""
    order = np.argsort(rows.astype(">u4").view(f"S{4 * rows.shape[1]}").ravel(), kind="stable")
    same = (rows[order][1:] == rows[order][:-1]) & (rows[order][1:] > 0)
    return order, np.concatenate(([0], np.logical_and.accumulate(same, 1).sum(1)))


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """A number for each row: rows that share the first ``depth`` values have the same one."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth) if depth else 0
    return out


def shard_passages(rows: pa.Table) -> pa.Table:
    """doc_id, first_doc, start, last: windows (from start to last) of the suffixes of one shard that two documents or more have."""
    doc_id, start, n, before = (rows.column(k).to_numpy() for k in ("doc_id", "start", "n", "before"))
    first, sizes, flat = numbered_words(rows.column("words").combine_chunks())
    middle = (first + before).astype(np.int32)[:, None]
    after, back = np.arange(LENGTH, dtype=np.int32), np.arange(1, BEFORE + 1, dtype=np.int32)
    to_right = ordered(np.where(after < (sizes - before)[:, None], flat[np.minimum(middle + after, len(flat) - 1)], np.int32(0)))
    to_left = ordered(np.where(back <= before[:, None], flat[np.maximum(middle - back, 0)], np.int32(0)))
    found = []
    for o in range(BEFORE + 1):  # windows that begin o words before their suffix
        has = np.flatnonzero((before >= o) & (before - o < n))
        if not len(has):
            continue
        group = _classes(*to_left, o)[has] * (len(doc_id) + 1) + _classes(*to_right, LENGTH - o)[has]
        order = np.argsort(group, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(group[order]) > 0)))
        docs = doc_id[has[order]]
        least, most = np.minimum.reduceat(docs, edge), np.maximum.reduceat(docs, edge)
        which = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(order))))
        some = least[which] < most[which]
        row = has[order][some]
        found.append(np.stack((row, least[which][some], start[row] + before[row] - o)))
    row, least, at = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort((at, row))
    row, least, at = row[order], least[order], at[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(least) != 0) | (np.diff(at) != 1)))) if len(row) else row
    end = np.append(new[1:], len(row)) - 1 if len(row) else row
    return pa.table({"doc_id": doc_id[row[new]], "first_doc": least[new], "start": at[new], "last": at[end]})


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word (exclusive), first_doc: a row for each maximal stretch of words that are repeated from
    the same first document; documents without any have none.

    Where first_doc is doc_id itself, this is the copy to keep: of all equal windows exactly the first document's are in
    such rows, also where passages of several documents stand side by side.
    """
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    counts = cut(shared_keys(docs))
    n, occurrences, n_hot = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > HOT)).first()
    rows = stored(_suffixes(docs, Bits(counts, n), Bits(counts.filter(F.col("n") > HOT), n_hot)))
    shards = max(1, -(-occurrences // SUFFIXES))
    dealt = rows.filter("NOT hot").select(F.pmod("key", F.lit(shards)).alias("shard"), "doc_id", "start", "n", "before", "words")
    of_shards = dealt.groupBy("shard").applyInArrow(shard_passages, "doc_id bigint, first_doc bigint, start bigint, last bigint")
    windows = rows.filter("hot").select("doc_id", "start", "words")
    shared = windows.groupBy(F.col("words").alias("digest")).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("most")).filter("first_doc < most")
    # Joined by another key than the aggregation's, so that both sides are dealt out by the join, which may split a hot one.
    single = windows.withColumn("k", F.xxhash64("words")).join(shared.withColumn("k", F.xxhash64("digest")), "k").filter("words = digest")
    found = of_shards.unionByName(single.select("doc_id", "first_doc", "start", F.col("start").alias("last")))
    order = Window.partitionBy("doc_id", "first_doc").orderBy("start", "last")
    so_far = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("opens", F.when(so_far + LENGTH >= F.col("start"), 0).otherwise(1))
    numbered = opened.withColumn("passage", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = (F.max("last") + LENGTH).alias("end_word")
    return numbered.groupBy("doc_id", "first_doc", "passage").agg(F.min("start").alias("start_word"), ends).select("doc_id", "start_word", "end_word", "first_doc")
