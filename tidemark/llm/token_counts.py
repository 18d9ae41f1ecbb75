"""Token counts at every prefix of a text, for a piece vocabulary merged by score (BPE with byte fallback).

A dynamic programme over prefixes: the tokens of a prefix are those of a shorter prefix and one last token. The last
token is the one that can follow the last token of the shorter prefix, that is, the two side by side merge into
themselves. So count[i] = count[i - len(last)] + 1 for each i in turn, without encoding any prefix. Merges never cross
from a non-space to a space mark, nor a line break, as no piece does; so a text is a row of segments, its counts are
the running sum over its segments, and equal segments share their counts. Segments are taken in sorted order, and the
programme goes on from the prefix that a segment shares with the one before. An automaton over the vocabulary gives the
tokens that end at each character.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.bpe import NONE, PairTable
from tidemark.llm.common import map_texts

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Segments that a worker remembers, and pairs of tokens.
REMEMBERED, PAIRS = 600_000, 500_000
#: Characters of text at a time: the more, the more segments share their prefixes.
CHUNK = 8_000_000
#: Segments worked out at once, and the longest of them; longer ones are taken by themselves.
ROWS, WIDEST = 65_536, 48
#: Below all scores.
NEVER = -1e30


class PrefixCounter:
    def __init__(self, pieces: dict[str, float]):
        """``pieces``: score of each piece that merges can make; all other characters count as their UTF-8 bytes."""
        self.score = {p: s for p, s in pieces.items() if len(p) > 1}
        self.single = {p for p in pieces if len(p) == 1}
        for p in self.score:
            if (SPACE in p.lstrip(SPACE)) or "\n" in p:
                raise ValueError(f"a piece crosses a segment's border: {p!r}")
        #: The two parts that a piece is merged from at last.
        self.parts: dict[str, tuple[str, str]] = {}
        self.whole = {p for p in self.score if self._is_whole(p)}
        self.names = sorted(self.whole)
        self.lengths = [len(p) for p in self.names]
        self._build()
        self.follows: dict[int, bool] = {}
        self.known: dict[str, int] = {}

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> PrefixCounter:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = (i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in usual})

    def _is_whole(self, piece: str) -> bool:
        """Whether the merges of its characters, best score first, leftmost first, make this piece."""
        parts = list(piece)
        while len(parts) > 1:
            score, i = max((self.score.get(a + b, NEVER), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if score == NEVER:
                return False
            if len(parts) == 2:
                self.parts[piece] = parts[0], parts[1]
            parts[-i : -i + 2] = [parts[-i] + parts[-i + 1]]
        return True

    def weight(self, char: str) -> int:
        return 1 if char in self.single else len(char.encode("utf-8", "surrogatepass"))

    def _build(self) -> None:
        """An automaton that knows, after each character, all tokens that end there, longest first."""
        self.go: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        for number, name in enumerate(self.names):
            at = 0
            for c in name:
                if c not in self.go[at]:
                    self.go[at][c] = len(self.go)
                    self.go.append({})
                    self.ends.append(())
                at = self.go[at][c]
            self.ends[at] = (number,)
        self.shorter = [0] * len(self.go)
        todo = list(self.go[0].values())
        for at in todo:  # grows as it goes
            for c, to in list(self.go[at].items()):
                self.shorter[to] = self._step(self.shorter[at], c)
                self.ends[to] += self.ends[self.shorter[to]]
                todo.append(to)
        self.table = PairTable({(at, ord(c)): to for at, follows in enumerate(self.go) for c, to in follows.items()})
        self.shorter_array, self.lengths_array = np.array(self.shorter), np.array(self.lengths)
        self.ends_at = np.concatenate(([0], np.cumsum([len(x) for x in self.ends])))
        self.ends_flat = np.array([t for x in self.ends for t in x], np.int64)
        self.weights = np.searchsorted(np.array([0, 0x80, 0x800, 0x10000]), np.arange(0x110000), "right")
        self.weights[[ord(c) for c in self.single]] = 1

    def _step(self, at: int, c: str) -> int:
        while at and c not in self.go[at]:
            at = self.shorter[at]
        return self.go[at].get(c, 0)

    def _name(self, number: int) -> str:
        """Numbers from len(names) on are single characters."""
        return self.names[number] if number < len(self.names) else chr(number - len(self.names))

    def _can_follow(self, key: int) -> bool:
        got = self.follows.get(key)
        if got is None:
            if len(self.follows) > PAIRS:
                self.follows.clear()
            got = self.follows[key] = self._stay_apart(self._name(key >> 21), self._name(key & (1 << 21) - 1))
        return got

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether a and b side by side are merged into just these two.

        Their merges are undone, the latest first. What then stands at the border must not merge before the merge just
        undone: of equal scores the one further left comes first, so on a's side a tie is no harm.
        """
        score, parts = self.score.get, self.parts.get
        made_a = made_b = NEVER  # score of the merge that consumed the left or right neighbour of the border
        while True:
            across = score(a + b)
            if across is not None and across > made_a and across >= made_b:
                return False
            pa, pb = parts(a), parts(b)
            if pa is None and pb is None:
                return True
            if pb is None or pa is not None and score(a) < score(b):
                made_a, a = score(a), pa[1]
            else:
                made_b, b = score(b), pb[0]

    def extend(self, s: str, start: int, last: list[int], count: list[int], state: list[int]) -> None:
        """Fill last token, count and automaton state for the prefixes of s longer than ``start``."""
        go, ends, lengths = self.go, self.ends, self.lengths
        del last[start + 1 :], count[start + 1 :], state[start + 1 :]
        at, i = state[start], start
        for c in s[start:]:
            i += 1
            to = go[at].get(c)
            at = self._step(at, c) if to is None else to
            state.append(at)
            for token in ends[at]:
                j = i - lengths[token]
                if not j:
                    last.append(token)
                    count.append(1)
                    break
                if self._can_follow(last[j] << 21 | token):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
            else:
                last.append(len(self.names) + ord(c))
                count.append(count[i - 1] + self.weight(c))

    def inside(self, segment: str) -> list[int]:
        """Counts of a segment's prefixes, the empty one first."""
        count = [0]
        self.extend(segment, 0, [-1], count, [0])
        return count

    def learn(self, segments) -> None:
        """Counts of whole segments into ``known``."""
        short = []
        for s in sorted(segments):
            if len(s) <= WIDEST:
                short.append(s)
            else:
                self.known[s] = self.inside(s)[-1]
        for at in range(0, len(short), ROWS):
            self._learn_sorted(short[at : at + ROWS])

    def _learn_sorted(self, segments: list[str]) -> None:
        """The programme for many sorted segments at once, a prefix length at a time.

        A prefix is worked out in the first row that has it; the rows below that share it take over the result.
        """
        if not segments:
            return
        n, size = len(segments), np.fromiter(map(len, segments), np.int64, len(segments))
        width = int(size.max())
        codes = np.frombuffer("".join([s.ljust(width, "\0") for s in segments]).encode("utf-32-le"), np.uint32).reshape(n, width).T.astype(np.int64)
        differ = codes[:, 1:] != codes[:, :-1]
        differ |= np.arange(width)[:, None] >= np.minimum(size[1:], size[:-1])
        shared = np.concatenate(([0], np.where(differ.any(axis=0), differ.argmax(axis=0), width)))
        last, count = np.full((width + 1, n), -1, np.int64), np.zeros((width + 1, n), np.int64)
        state, row = np.zeros(n, np.int64), np.arange(n)
        for i in range(1, width + 1):
            fresh = (shared < i) & (size >= i)
            at = np.flatnonzero(fresh)
            char = codes[i - 1, at]
            now = self._steps(state[at], char)
            best = len(self.names) + char
            total = count[i - 1, at] + self.weights[char]
            begin, end = self.ends_at[now], self.ends_at[now + 1]
            left = np.flatnonzero(begin < end)
            while len(left):
                token = self.ends_flat[begin[left]]
                j = i - self.lengths_array[token]
                ok = j == 0
                ask = np.flatnonzero(~ok)
                keys, back = np.unique(last[j[ask], at[left[ask]]] << 21 | token[ask], return_inverse=True)
                ok[ask] = np.fromiter(map(self._can_follow, keys.tolist()), bool, len(keys))[back]
                took = left[ok]
                best[took] = token[ok]
                total[took] = count[j[ok], at[took]] + 1
                left = left[~ok]
                begin[left] += 1
                left = left[begin[left] < end[left]]
            last[i, at], count[i, at], state[at] = best, total, now
            owner = np.maximum.accumulate(np.where(fresh, row, 0))
            last[i], count[i], state = last[i, owner], count[i, owner], state[owner]
        self.known.update(zip(segments, count[size, row].tolist(), strict=True))

    def _steps(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        out = self.table.look_up(state, char).astype(np.int64)
        left = np.flatnonzero(out == NONE)
        while len(left):
            out[left] = 0
            left = left[state[left] != 0]
            state[left] = self.shorter_array[state[left]]
            found = self.table.look_up(state[left], char[left])
            out[left] = found
            left = left[found == NONE]
        return out

    def split(self, text: str) -> list[str]:
        return SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def counts(self, split: list[list[str]]) -> list[list[int]]:
        """For each text, given as its segments, the counts of its segments."""
        distinct = set().union(*split)
        if len(self.known) > REMEMBERED:  # what comes up here again is likely common
            self.known = {x: n for x in distinct if (n := self.known.get(x)) is not None}
        self.learn(distinct - self.known.keys())
        return [list(map(self.known.__getitem__, x)) for x in split]

    def prefixes(self, text: str) -> Prefixes:
        segments = self.split(text)
        return Prefixes(self, len(text), segments, self.counts([segments])[0])


class Prefixes:
    """Exact token counts of all prefixes of one text, without encoding it again.

    The counts at segment borders are kept, those within a segment are made again when asked for.
    """

    def __init__(self, counter: PrefixCounter, n_chars: int, segments: list[str], counts: list[int]):
        self.counter, self.n, self.segments = counter, n_chars, segments
        self.counts = [0, *accumulate(counts)]
        self.starts = [0, *accumulate(map(len, self.segments))]  # in the text with its leading mark

    def at(self, n_chars: int) -> int:
        """Tokens of the first n_chars characters."""
        if n_chars <= 0 or not self.segments:
            return 0
        at = min(n_chars, self.n) + 1
        k = bisect_right(self.starts, at) - 1
        if self.starts[k] == at:
            return self.counts[k]
        return self.counts[k] + self.counter.inside(self.segments[k])[at - self.starts[k]]

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        if self.counts[-1] <= budget:
            return self.n
        # A prefix that ends within a segment has more tokens than at its start, and segments only add tokens.
        k = bisect_right(self.counts, budget) - 1
        inside = self.counter.inside(self.segments[k])
        best = max(j for j in range(len(inside)) if self.counts[k] + inside[j] <= budget)
        return max(0, self.starts[k] + best - 1)


def count(docs: DataFrame, path: str, budget: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (characters of the longest prefix within the budget).

    Null and empty texts have no tokens. Every row gives one row; extra columns are ignored.
    """

    def make():
        counter = PrefixCounter.load(path)

        def run(ids: list, texts: list[str]) -> dict:
            split = [counter.split(x) for x in texts]
            counts = counter.counts(split)
            totals = list(map(sum, counts))
            rows = zip(texts, split, counts, totals, strict=True)
            return {
                "doc_id": ids,
                "n_bytes": [len(x.encode()) for x in texts],
                "n_tokens": totals,
                "over_limit": [n > budget for n in totals],
                "fit_chars": [Prefixes(counter, len(x), segments, own).fit(budget) if n > budget else len(x) for x, segments, own, n in rows],
            }

        return run

    return map_texts(docs, make, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint", chunk=CHUNK)
