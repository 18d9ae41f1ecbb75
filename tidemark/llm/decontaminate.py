"""Benchmark decontamination with a generalised suffix automaton of the benchmark's items.

The automaton holds all runs of words of all items. The words of a document are streamed through it, which keeps the
longest run that ends at each word and occurs in an item. Where that run is at least as long as a window, the window
that ends there occurs; its state tells the items. Words that no item has send the automaton back to its start, so
only stretches of known words, at least as long as the shortest window, are streamed.

The items are a stated query set. Their size is checked: they are dealt to blocks of at most about BLOCK_WORDS words, by
the same words as in the texts. At most BLOCKS automata exist at a time, built on the driver and broadcast (some 240 MB then), and
a task has one Python worker, however large the benchmark is. Up to BLOCKS blocks, documents pass through once, without a shuffle.
With more, a group of blocks is a job of its own: it writes the documents that it hits, and its automata are deleted before the
next ones are built; what the groups found is joined to the documents in the end. A group first looks up the hashes of the
documents' windows, so that few documents go through an automaton more than once.

Defined results: null texts have no words; items without words are ignored; a null item_id is left out; repeated items
count once for each item_id, and items that share an item_id are one item with the windows of all. Each row is judged by its
own text, repeated rows and a repeated doc_id too. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MOST_BROADCAST, bounded_batches, cut, stored, text_mark
from tidemark.llm.suffix_dedup import run_hashes

WINDOW = 13
#: Words of items in a block (an automaton takes some 300 bytes for each), and blocks that a worker holds at a time.
BLOCK_WORDS, BLOCKS = 200_000, 4
#: Upper-case letters become lower-case; of the other ASCII characters, those that aren't letters or digits become spaces.
TABLE = bytes(ord(chr(b).lower()) if b >= 0x80 or chr(b).isalnum() and b < 0x80 else 0x20 for b in range(128)) + bytes(range(128, 256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, tokens)), np.uint64)


class Automaton:
    """Windows of items: runs of ``window`` words, or the whole item where it has fewer words."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        split = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in words(t)]) for i, t in items if i is not None]
        for _, ids in split:
            self._add(ids)
        #: (state, length) -> items that have this window.
        self.windows: dict[tuple[int, int], set[int]] = {}
        for item, ids in split:
            if not ids:
                continue
            n = min(window, len(ids))
            for state, length, i in self._stream(ids):
                if i >= n - 1:
                    self.windows.setdefault((self._of_length(state, n), n), set()).add(item)
        self.sizes = sorted({n for _, n in self.windows})
        self._items = [t for i, t in items if i is not None]

    def keys(self) -> dict[int, set[int]]:
        """Hashes of all windows, by their number of words."""
        out: dict[int, set[int]] = {}
        for text in self._items:
            tokens = words(text)
            if tokens:
                size = min(self.window, len(tokens))
                out.setdefault(size, set()).update(run_hashes(word_hashes(tokens), size)[0].tolist())
        return out

    def _add(self, ids: list[int]) -> None:
        last = 0
        for c in ids:
            if c in self.next[last]:
                q = self.next[last][c]
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
                continue
            cur = self._state({}, self.length[last] + 1, 0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
            last = cur

    def _state(self, follows: dict[int, int], length: int, link: int) -> int:
        self.next.append(follows)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        """A state for the part of q's runs that is one longer than p's."""
        new = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _of_length(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _stream(self, ids) -> Iterator[tuple[int, int, int]]:
        """State, length of the longest match, index, for each word."""
        follows, link, length = self.next, self.link, self.length
        state = n = 0
        for i, c in enumerate(ids):
            while state and c not in follows[state]:
                state = link[state]
                n = length[state]
            if c in follows[state]:
                state = follows[state][c]
                n += 1
            else:
                n = 0
            yield state, n, i

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit ranges of words (end exclusive, merged), items with occurring windows, longest match."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        most = 0
        if not self.sizes or not tokens:
            return spans, found, most
        ids = np.fromiter(map(self.vocab.get, tokens, repeat(-1)), np.int64, len(tokens))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.sizes[0]
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            for state, n, i in self._stream(ids[start:end].tolist()):
                most = max(most, n)
                for size in self.sizes:
                    if size > n:
                        break
                    items = self.windows.get((self._of_length(state, size), size))
                    if items:
                        found |= items
                        a, b = start + i - size + 1, start + i + 1
                        while spans and spans[-1][1] >= a:
                            a = min(a, spans.pop()[0])
                        spans.append((a, b))
        return spans, found, most


def _blocks(items: DataFrame) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks there are, and their items, read as they are asked for."""
    rows = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    n_words = rows.agg(F.sum(F.size(F.expr(r"regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+', 0)")))).first()[0] or 0
    n = -(-n_words // BLOCK_WORDS) or 1
    return n, ([tuple(x) for x in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()] for k in range(n))


def _merged(a: list[int], b: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *b]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += (s, e)
    return out


_FOUND = "spans array<int>, items array<bigint>, longest int, n_words bigint, n_hit bigint"
_HITS = "doc_id bigint, mark bigint, spans array<int>, items array<bigint>, longest int"


def _judged(tokens: list[bytes], automata: list[Automaton]) -> tuple[list[int], list[int], int]:
    """Merged spans, sorted items, longest match over some automata."""
    spans, items, longest = [], set(), 0
    for automaton in automata:
        ranges, found, most = automaton.match(tokens)
        if found:
            spans = _merged(spans, ranges)
            items |= found
        longest = max(longest, most)
    return spans, sorted(items), longest


def _rows(docs: DataFrame):
    """The schema of what ``mark`` gives, for Spark and for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = rows.schema
    for field in _parse_datatype_string(_FOUND):
        schema = schema.add(field)
    return schema, to_arrow_schema(schema)


def _found(row: pa.Array, judged: list[tuple], n_words: list[int], arrow: pa.Schema) -> pa.RecordBatch:
    columns = ([j[0] for j in judged], [j[1] for j in judged], [j[2] for j in judged], n_words, [sum(j[0][1::2]) - sum(j[0][::2]) for j in judged])
    return pa.RecordBatch.from_arrays([row, *(pa.array(x, type=arrow.field(k).type) for k, x in enumerate(columns, 1))], schema=arrow)


def _in_one_pass(docs: DataFrame, automata: list) -> DataFrame:
    """``automata``: broadcast variables, which a worker reads once for all its tasks."""
    schema, arrow = _rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [a.value for a in automata]
        for batch in batches:
            tokens = [words(t) for t in batch.column(0).field("text").cast(pa.string()).to_pylist()]
            yield _found(batch.column(0), [_judged(t, own) for t in tokens], list(map(len, tokens)), arrow)

    return docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(run, schema)


def _group_hits(docs: DataFrame, automata: list) -> DataFrame:
    """doc_id, mark, spans, items, longest of the documents that a group of automata hits."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_HITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [a.value for a in automata]
        keys: dict[int, set[int]] = {}
        for a in own:
            for size, some in a.keys().items():
                keys.setdefault(size, set()).update(some)
        for batch in batches:
            out = []
            for i, mark, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                tokens = words(text)
                hashes = word_hashes(tokens)
                if any(not known.isdisjoint(run_hashes(hashes, size)[0].tolist()) for size, known in keys.items() if len(tokens) >= size):
                    spans, items, longest = _judged(tokens, own)
                    if items:
                        out.append((i, mark, spans, items, longest))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=arrow.field(k).type) for k in range(5)], schema=arrow)

    return docs.select("doc_id", text_mark().alias("mark"), F.col("text").cast("string")).mapInArrow(run, _HITS)


def _in_groups(docs: DataFrame, blocks: Iterator[list[tuple[int, str]]], window: int) -> DataFrame:
    """One job for each group of blocks; what they found is joined by doc_id and text."""
    sc, hits = docs.sparkSession.sparkContext, None
    while group := list(islice(blocks, BLOCKS)):
        automata = [sc.broadcast(Automaton(block, window)) for block in group]
        some = stored(_group_hits(docs, automata))
        for a in automata:
            a.destroy()
        hits = some if hits is None else hits.unionByName(some)
    # Groups and rows that repeat give more than one row of a document: at most BLOCKS-th of the blocks and equal ones.
    hits = hits.distinct().groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_list("spans").alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"), F.max("longest").alias("_longest"))
    hits = cut(hits)
    hits = F.broadcast(hits) if hits.count() <= MOST_BROADCAST // 10 else hits
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("_doc"), text_mark().alias("_own"))
    both = keyed.join(hits, F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_own").eqNullSafe(F.col("_mark")), "left")
    schema, arrow = _rows(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = [len(words(t)) for t in batch.column(0).field("text").cast(pa.string()).to_pylist()]
            judged = []
            for spans, items, longest in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                merged: list[int] = []
                for s in spans or []:
                    merged = _merged(merged, list(zip(s[::2], s[1::2], strict=True)))
                judged.append((merged, items or [], longest or 0))
            yield _found(batch.column(0), judged, n_words, arrow)

    return both.select("row", "_spans", "_items", "_longest").mapInArrow(run, schema)


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """row (all columns of docs), spans (word ranges, flat: start, end, ...), items (sorted ids), longest, n_words, n_hit.

    longest: words of the longest match; with more than BLOCKS blocks of items, of documents that are hit only.
    """
    bounded_batches(docs.sparkSession)
    n, blocks = _blocks(items)
    if n <= BLOCKS:
        return _in_one_pass(docs, [docs.sparkSession.sparkContext.broadcast(Automaton(block, window)) for block in blocks])
    return _in_groups(docs, blocks, window)


def _contaminated():
    """A twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest; contaminated: a twentieth of the words is hit."""
    marked = mark(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), items, window)
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return marked.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), _contaminated().alias("contaminated"), "longest")


def without_spans(text: str, spans: list[int]) -> str:
    """The text without the words of ``spans`` (as ``mark`` gives them) and what stands between them."""
    if not spans:
        return text
    data = text.encode()
    plain = np.frombuffer(data.translate(TABLE), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], plain, [0]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(data[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, data[at:]]).decode()


def remove_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with all columns, the text without the words that windows cover and what stands between them; null texts stay."""
    from pyspark.sql.types import _parse_datatype_string

    marked = mark(docs, items, window)
    text = F.pandas_udf(lambda t, s: pd.Series([None if x is None else without_spans(x, list(y)) for x, y in zip(t, s, strict=True)], dtype=object), _parse_datatype_string("string"))
    return marked.select(*(F.when(F.size("spans") > 0, text("row.text", "spans")).otherwise(F.col("row.text")).alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns: in the pass that marks them, without a join."""
    return mark(docs, items).filter(~_contaminated()).select("row.*")


SQL = r"""
WITH lower_docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lower_items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (
  SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM lower_items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS key FROM starts),
doc_starts AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lower_docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS key FROM doc_starts),
hits AS (
  SELECT doc_id, i, n, item_id FROM doc_windows JOIN windows USING (n, key)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lower_docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
