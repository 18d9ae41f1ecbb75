"""Language identification of mixed texts: script ranges, scores of words, Viterbi with a switching penalty.

Learning counts character n-grams (1 to 3, with word borders) of a bounded sample of labelled texts into a hashed table
for each language, and the scripts of its words. For a text, the script of each word narrows the candidate languages; a
word's score for a candidate is the sum of its n-grams' log probabilities. The best sequence of languages, with a cost
for each change between neighbouring words, labels spans. The language with the most letters is the prediction.

The sequences of all texts of a batch are found together: words are cut into blocks, each block's best scores from
any entry to any exit language are found for all blocks at once, blocks are joined text by text, and the paths follow.

Defined results: texts that are null or have no letter, and all texts if nothing was learnt, are ``und`` with score 0.
Repeated rows give repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import CHUNK_CHARS, held_out, map_texts, sampled

#: Labelled rows to learn from, about; cells of the n-gram table; cost of a change of language, in nats.
MOST_ROWS, CELLS, PENALTY = 20_000, 1 << 16, 12.0
SMOOTH, LEAST_SHARE, EXCLUDED = 0.5, 0.001, -60.0
BLOCK = 64
WORD = re.compile(r"[^\W\d_]+")
#: First characters of ranges of scripts; a range goes up to the next one.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
)
_STARTS = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({b for _, b in SCRIPTS})
_OF = np.array([_NAMES.index(b) for _, b in SCRIPTS])
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def words_of(text: str) -> list[str]:
    """Lower-case words: runs of letters. Characters that count as word characters but aren't letters are left out."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(c.isalpha() for c in w)]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cell of every n-gram of ``words`` and the number of its word."""
    codes = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.cumsum(codes == 0) - 1
    cells, of = [], []
    for n in (1, 2, 3):
        m = len(codes) - n + 1
        h = np.full(m, n * int(_ODD[3]) % 2**64, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + m]) * _ODD[k]
            h ^= h >> np.uint64(32)
        # A border may be the first or the last of an n-gram's characters, not all of it nor within it.
        ok = codes[:m] != 0 if n == 1 else np.ones(m, bool) if n == 2 else codes[1 : 1 + m] != 0
        if n == 2:
            ok = (codes[:m] != 0) | (codes[1:] != 0)
        cells.append((h[ok] >> np.uint64(8)) % np.uint64(CELLS))
        of.append(word[:m][ok])
    return np.concatenate(cells).astype(np.int64), np.concatenate(of)


def scripts(words: list[str]) -> np.ndarray:
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _OF[np.searchsorted(_STARTS, first, "right") - 1]


class Model:
    def __init__(self, langs: list[str], cells: np.ndarray, of_script: np.ndarray):
        """cells: counts (CELLS, languages); of_script: counts (scripts, languages)."""
        self.langs = langs
        self.log = np.log((cells + SMOOTH) / (cells.sum(axis=0) + SMOOTH * CELLS))
        share = of_script / np.maximum(1, of_script.sum(axis=0))
        self.candidates = share >= LEAST_SHARE
        self.candidates[~self.candidates.any(axis=1)] = True

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): log probabilities less the best one's; EXCLUDED for languages of other scripts."""
        cell, word = grams(words)
        out = np.stack([np.bincount(word, self.log[cell, k], len(words)) for k in range(len(self.langs))], axis=1)
        possible = self.candidates[scripts(words)]
        out = np.where(possible, out, -np.inf)
        out -= out.max(axis=1, keepdims=True)
        return np.maximum(out, EXCLUDED)

    def label(self, texts: list[str]) -> list[tuple[str, float, str]]:
        """Language, share of the letters that it has, spans (language:first word:end word) of each text."""
        split = [words_of(x) for x in texts]
        distinct = list(set().union(*split))
        if not distinct or not self.langs:
            return [("und", 0.0, "")] * len(texts)
        index = dict(zip(distinct, range(len(distinct)), strict=True))
        table = self.scores(distinct)
        length = np.fromiter(map(len, distinct), np.int64, len(distinct))
        sizes = np.array([len(x) for x in split])
        at = np.fromiter((index[w] for x in split for w in x), np.int64, int(sizes.sum()))
        state = viterbi(table[at], sizes, PENALTY)
        out, start = [], 0
        for n in sizes.tolist():
            mine, letters = state[start : start + n], length[at[start : start + n]]
            start += n
            if not n:
                out.append(("und", 0.0, ""))
                continue
            of = np.bincount(mine, letters, len(self.langs))
            best = int(of.argmax())
            edges = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), n]
            spans = ",".join(f"{self.langs[mine[a]]}:{a}:{b}" for a, b in zip(edges, edges[1:], strict=False))
            out.append((self.langs[best], float(of[best] / of.sum()), spans))
        return out


def viterbi(score: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best states of many sequences, which follow one another in ``score`` (steps, states); a change costs ``penalty``."""
    n_states = score.shape[1]
    sizes = np.asarray(sizes)
    seqs = np.flatnonzero(sizes)
    blocks = -(-sizes[seqs] // BLOCK)
    total = int(blocks.sum())
    first_block = np.cumsum(blocks) - blocks
    first_step = (np.cumsum(sizes) - sizes)[seqs]
    seq_of = np.repeat(np.arange(len(seqs)), blocks)
    begin = first_step[seq_of] + (np.arange(total) - first_block[seq_of]) * BLOCK
    length = np.minimum(BLOCK, (first_step + sizes[seqs])[seq_of] - begin)
    step = np.arange(BLOCK)
    real = step[None, :] < length[:, None]
    padded = np.zeros((total, BLOCK, n_states))
    where = (begin[:, None] + step[None, :])[real]
    padded[real] = score[where]
    enter = np.where(np.eye(n_states, dtype=bool), 0.0, -penalty)
    through = enter[None] + padded[:, 0][:, None, :]  # (block, entry state, state)
    for t in range(1, BLOCK):
        through = np.maximum(through, through.max(axis=2, keepdims=True) - penalty) + padded[:, t][:, None, :]
    # Sequences with more blocks first, so that those that go on are a prefix.
    order = np.argsort(-blocks, kind="stable")
    going = [int((blocks > k).sum()) for k in range(int(blocks.max(initial=0)))]
    value = np.zeros((len(seqs), n_states))
    entry_value = np.empty((total, n_states))
    for k, m in enumerate(going):
        at = first_block[order[:m]] + k
        entry_value[at] = value[:m]
        value[:m] = (value[:m, :, None] + through[at]).max(axis=1)
        value[:m] -= value[:m].max(axis=1, keepdims=True)
    exit_state, entry_state = np.empty(total, np.int64), np.empty(total, np.int64)
    state = value.argmax(axis=1)
    for k in range(len(going) - 1, -1, -1):
        m = going[k]
        at = first_block[order[:m]] + k
        exit_state[at] = state[:m]
        state[:m] = (entry_value[at] + through[at, :, state[:m]]).argmax(axis=1)
        entry_state[at] = state[:m]
    values = np.empty((BLOCK, total, n_states))
    values[0] = enter[entry_state] + padded[:, 0]
    for t in range(1, BLOCK):
        values[t] = np.maximum(values[t - 1], values[t - 1].max(axis=1, keepdims=True) - penalty) + padded[:, t]
    path = np.empty((total, BLOCK), np.int64)
    path[:, -1] = now = exit_state
    row = np.arange(total)
    for t in range(BLOCK - 2, -1, -1):
        best = values[t].argmax(axis=1)
        now = np.where(values[t][row, now] >= values[t][row, best] - penalty, now, best)
        path[:, t] = now
    out = np.empty(len(score), np.int64)
    out[where] = path[real]
    return out


def train(docs: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Learn from text and lang of rows that aren't held out. What reaches the driver: CELLS numbers a language at most."""
    usable = docs.filter("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(2, 4))
    usable = usable.filter(sampled(most_rows, usable.count()))

    def count(langs: list, texts: list[str]) -> dict | None:
        of: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(langs, texts, strict=True):
            of[lang].update(words_of(text))
        out: dict[str, list] = {"lang": [], "cell": [], "n": []}
        for lang, words in of.items():
            if not words:
                continue
            distinct, times = list(words), np.array(list(words.values()), np.float64)
            cell, word = grams(distinct)
            n = np.concatenate((np.bincount(cell, times[word], CELLS), np.bincount(scripts(distinct), times, len(_NAMES))))
            at = np.flatnonzero(n)
            out["lang"] += [lang] * len(at)
            out["cell"] += at.tolist()
            out["n"] += n[at].astype(np.int64).tolist()
        return out if out["n"] else None

    counts = map_texts(usable, lambda: count, "lang string, cell bigint, n bigint", id_col="lang").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counts.column("lang").to_pylist(), object)
    langs = sorted(set(names.tolist()))
    table = np.zeros((CELLS + len(_NAMES), len(langs)))
    if len(langs):
        table[counts.column("cell").to_numpy(), np.searchsorted(np.array(langs, object), names)] = counts.column("n").to_numpy()
    return Model(langs, table[:CELLS], table[CELLS:])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters in that language), spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def run(ids: list, texts: list[str]) -> dict:
            found = shared.value.label(texts)
            return {"doc_id": ids} | {k: [x[i] for x in found] for i, k in enumerate(("lang_pred", "score", "spans"))}

        return run

    # The arrays of a chunk grow with the square of the number of languages: smaller chunks for many.
    chunk = max(CHUNK_CHARS // 50, min(CHUNK_CHARS, CHUNK_CHARS * 400 // max(1, len(model.langs)) ** 2))
    return map_texts(docs, make, "doc_id bigint, lang_pred string, score double, spans string", chunk=chunk)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans."""
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score", "spans")
