"""Byte-level BPE encoding and decoding.

Pre-tokens of many texts are merged together: the distinct ones are put into padded integer matrices by their
length; in each round every row merges its leftmost pair of least rank, all rows at once. Ranks of pairs come from
an open-addressing hash table in numpy arrays. A row loses exactly one symbol a round, so that dropping the merged
symbols (compaction) gives a matrix that is one column narrower; finished rows leave it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts

NONE = np.int32(2**31 - 1)
#: Longer pre-tokens (in bytes) are merged with a heap one by one: a matrix row would take quadratic time.
LONGEST_ROW = 256
#: Rows of a matrix at a time, and pre-tokens remembered by a worker.
ROWS, REMEMBERED = 16_384, 150_000


class PairTable:
    """(left id, right id) -> rank, for whole arrays of pairs; NONE if there is no such merge."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (len(pairs) * 5).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        ranks = np.array(list(pairs.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            first = np.unique(slot, return_index=True)[1]
            free = first[self.keys[slot[first]] == -1]
            self.keys[slot[free]], self.ranks[slot[free]] = keys[free], ranks[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, ranks, slot = keys[rest], ranks[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Negative ids stand for padding and never merge."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


class ByteBPE:
    """Encoder and decoder for a vocabulary given as {token bytes: rank}; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.start = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = pairs
        self.table = PairTable(pairs)
        self.known: dict[str, bytes] = {}

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    # -- encoding ------------------------------------------------------------------------------------------------

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each of ``tokens`` (not empty), packed as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(tokens)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            size = int(sizes[order[at]])
            if size > LONGEST_ROW:
                for i in order[at:].tolist():
                    out[i] = self._merge_long(tokens[i])
                break
            width = size if size <= 16 else -(-size // 8) * 8
            end = min(int(np.searchsorted(sizes[order], width, "right")), at + ROWS)
            rows = order[at:end]
            self._merge_matrix(rows, sizes[rows], b"".join(tokens[i].ljust(width, b"\0") for i in rows.tolist()), width, out)
            at = end
        return out

    def _merge_matrix(self, rows: np.ndarray, sizes: np.ndarray, data: bytes, width: int, out: list[bytes]) -> None:
        ids = self.start[np.frombuffer(data, np.uint8).reshape(len(rows), width)]
        ids[np.arange(width)[None, :] >= sizes[:, None]] = -1
        ranks = self.table.look_up(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
        while True:
            if ids.shape[1] > 1:
                best = ranks.argmin(axis=1)
                rank = ranks[np.arange(len(rows)), best]
                done = rank == NONE
            else:
                done = np.ones(len(rows), bool)
            if done.any():
                self._pack(rows[done], sizes[done], ids[done], out)
                go = ~done
                if not go.any():
                    return
                rows, sizes, ids, ranks, best, rank = rows[go], sizes[go], ids[go], ranks[go], best[go], rank[go]
            n, w = ids.shape
            row = np.arange(n)
            ids[row, best] = rank
            keep = np.ones((n, w), bool)
            keep[row, best + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            if w > 2:
                keep = np.ones((n, w - 1), bool)
                keep[row, best] = False
                ranks = ranks[keep].reshape(n, w - 2)
                left = np.flatnonzero(best > 0)
                ranks[left, best[left] - 1] = self.table.look_up(ids[left, best[left] - 1], ids[left, best[left]])
                right = np.flatnonzero(best < w - 2)
                ranks[right, best[right]] = self.table.look_up(ids[right, best[right]], ids[right, best[right] + 1])
            sizes = sizes - 1

    @staticmethod
    def _pack(rows: np.ndarray, sizes: np.ndarray, ids: np.ndarray, out: list[bytes]) -> None:
        for k in np.unique(sizes).tolist():
            mine = sizes == k
            packed = np.ascontiguousarray(ids[mine][:, :k]).astype("<u4").tobytes()
            for j, i in enumerate(rows[mine].tolist()):
                out[i] = packed[4 * k * j : 4 * k * (j + 1)]

    def _merge_long(self, token: bytes) -> bytes:
        ids = self.start[np.frombuffer(token, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := get((rank, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[j]]))
            if (h := before[i]) >= 0 and (r := get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        split = [self.pattern.findall(x) for x in texts]
        distinct = set().union(*split)
        if len(self.known) > REMEMBERED:  # what comes up here again is likely common
            self.known = {x: ids for x in distinct if (ids := self.known.get(x)) is not None}
        known = self.known
        if new := list(distinct - known.keys()):
            known.update(zip(new, self.merge([x.encode() for x in new]), strict=True))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], "<u4").tolist()

    # -- decoding ------------------------------------------------------------------------------------------------

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), decoded_sha256: ids of every text, and the digest of what they decode to.

    Null and empty texts have no tokens. Extra columns are ignored; every row gives one row, repeated rows too.
    """

    def make():
        bpe = ByteBPE.load(path, pattern)

        def run(ids: list, texts: list[str]) -> dict:
            packed = bpe.encode_packed(texts)
            tokens = [np.frombuffer(x, "<u4").astype(np.int32) for x in packed]
            return {"doc_id": ids, "n_tokens": list(map(len, tokens)), "ids": tokens, "decoded_sha256": [hashlib.sha256(bpe.decode_packed(x)).hexdigest() for x in packed]}

        return run

    return map_texts(docs, make, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text is encoded and its ids are decoded again.

    Null and empty texts have no tokens and the digests of nothing. Every row gives one row, repeated rows and null ids too;
    extra columns are ignored.
    """

    def make():
        bpe = ByteBPE.load(path, pattern)

        def run(ids: list, texts: list[str]) -> dict:
            packed = bpe.encode_packed(texts)
            return {
                "doc_id": ids,
                "n_tokens": [len(x) // 4 for x in packed],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in packed],
                "decoded_sha256": [hashlib.sha256(bpe.decode_packed(x)).hexdigest() for x in packed],
            }

        return run

    return map_texts(docs, make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
