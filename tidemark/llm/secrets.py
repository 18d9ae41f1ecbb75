"""Secret scans by assignment-aware lexing.

What assigns in a text is lexed into names and values, over the syntaxes of source code and configuration
(``name = "value"``, ``name: value``, ``"name": "value"``, ``name["part"] = "value"``, ``name := value``,
``name => value``, ``export NAME=value``). A value is a row of literals and names joined by ``+`` or put side by side, perhaps
in round or square brackets. It may start on the line after and go over line ends: in brackets, after ``+`` or a backslash, in
triple or backward quotes (each line is a literal; assignments in such a text are lexed as well) and in YAML blocks. Literals
may have a prefix (``b"value"``). Names that hold literals are constants: where such a name is used in a later value, its
literals go along. Every literal that reaches a name is scored by how sensitive the name is and by how much the literal,
or the row it's in, looks like a secret; the best score of a literal counts, and those of ``LEAST_SCORE`` or more give a span
of kind ``literal``.

A value that uses a name refers to the assignment before instead of copying its literals. What a row of literals looks like is
summed up from its parts (``Look``), and the names' scores go from the last assignment back to the first; so time and memory
are linear in the text, however often names go into names.

Fixed patterns come first and always stay: assignments to tell-tale names, access keys, long hexadecimal runs.

Defined results: null and empty texts have no spans. Repeated rows give repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts
from tidemark.llm.spans import Span, by_start, digest, joined

KINDS = ("assign", "access", "hex", "literal")
LEAST_SCORE = 0.5

# The contract's patterns (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
_TOLD = ("passw", "secret", "token", "api")

#: A name, perhaps in quotes or with subscripts, and what assigns to it.
TARGET = re.compile(r"""(?<![A-Za-z0-9_.$-])(["']?)([A-Za-z_$][A-Za-z0-9_.$-]*+)\1((?:\[[^\[\]\n]{0,200}\])*+)[ \t]*+(?P<by>:=|=>|=(?![=~])|:(?![:=]))[ \t]*+""")
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*+")
STRING = re.compile(r"""(?:[bBrRuUfFtT]{1,2}|L|u8|[@$]{1,2})?(?:(?P<triple>\"{3}|'{3})(?P<lines>(?:\\.|(?!(?P=triple))[^\\])*+)(?P=triple)|`(?P<ticked>(?:\\.|[^`\\])*+)`|(?P<quote>["'])(?P<text>(?:\\.|(?!(?P=quote))[^\\\n])*+)(?P=quote))""", re.DOTALL)
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>|&+]++""")
#: Gaps within a line or over a backslash at its end; and where line ends and comments don't matter.
GAP = re.compile(r"(?:[ \t]|\\\r?\n)*+")
WIDE = re.compile(r"(?:\s|\\\r?\n|#[^\n]*|//[^\n]*)*+")
ASSIGNS = re.compile(r"[ \t]*+(?::=|=>|=(?![=~])|:(?![:=]))")
#: A comment with something in it that may assign.
COMMENT = re.compile(r"(?<=[\s(\[,])(?:#|//)(?=[^\n]*[=:])")
SPACE = re.compile(r"\s*+")
BLOCK = re.compile(r"[|>][0-9+-]{0,2}[ \t]*+(?:#[^\n]*)?\r?\n")
LINES = re.compile(r"\S(?:[^\n]*[^\s])?")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How sensitive a name's parts make it, and what parts say that it isn't the secret itself.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "auth": 0.6, "key": 0.55, "private": 0.6, "bearer": 0.8, "signature": 0.5, "salt": 0.5}
HARMLESS = {"public", "path", "file", "url", "uri", "name", "id", "count", "length", "size", "limit", "max", "min", "ttl", "expiry", "expires", "type", "field", "label", "hint", "policy"}
PLACEHOLDERS = ("changeme", "example", "placeholder", "your", "xxxx", "todo", "dummy", "none", "null", "true", "false", "undefined", "redacted", "****", "${", "{{", "<")
LONGEST_PLACEHOLDER = max(map(len, PLACEHOLDERS))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(x in low for x in _TOLD):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    """0 to 1 by the name's parts; neighbouring parts count as one word too (api_key, apiKey)."""
    parts = [p.lower() for p in PARTS.findall(name)]
    words = parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]
    best = max((SENSITIVE.get(w, 0.0) for w in words), default=0.0)
    if {"api", "access", "private", "encryption", "signing"} & set(parts) and "key" in parts:
        best = max(best, 0.9)
    return best * (0.4 if parts and HARMLESS & set(parts) else 1.0)


class Look:
    """What counts of a row of literals: how many there are, how often each character occurs, and how the row begins."""

    __slots__ = ("parts", "n", "of", "start")

    def __init__(self, value: str | None = None):
        self.parts, self.n = (0, 0) if value is None else (1, len(value))
        self.of: Counter = Counter(value or "")
        self.start = (value or "")[:LONGEST_PLACEHOLDER]

    def add(self, other: Look) -> None:
        if len(self.start) < LONGEST_PLACEHOLDER:
            self.start = (self.start + other.start)[:LONGEST_PLACEHOLDER]
        self.parts += other.parts
        self.n += other.n
        for c, k in list(other.of.items()):
            self.of[c] += k

    def score(self) -> float:
        """0 to 1: length, spread of characters and kinds of characters; 0 for short values, placeholders and prose."""
        n, low = self.n, self.start.lower()
        if n < 8 or any(low.startswith(p) for p in PLACEHOLDERS) or any(c.isspace() for c in self.of):
            return 0.0
        spread = -sum(c / n * math.log2(c / n) for c in self.of.values())
        kinds = sum((any(map(str.islower, self.of)), any(map(str.isupper, self.of)), any(map(str.isdigit, self.of)), not all(map(str.isalnum, self.of))))
        return min(1.0, spread / 3.5) * (0.55 + 0.15 * min(kinds, 3))


def literal_score(value: str) -> float:
    return Look(value).score()


def _block(text: str, target: int, at: int) -> list[list[tuple[int, int]]]:
    """The lines of a YAML block from ``at`` on: those deeper than the line of its target."""
    line = text.rfind("\n", 0, target) + 1
    depth = len(text[line:target]) - len(text[line:target].lstrip(" "))
    out = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if held := LINES.search(text, at, end):
            if held.start() - at <= depth:
                break
            out.append([held.span()])
        at = end + 1
    return out


#: A literal's span, or the number of the assignment whose literals are meant.
Part = tuple[int, int] | int


def _value(text: str, at: int, constants: dict[str, int]) -> tuple[list[list[Part]], int]:
    """Rows of literals of the value at ``at``, and where to look for the next target."""
    rows: list[list[Part]] = []
    row: list[Part] = []
    at = GAP.match(text, at).end()
    depth, start, inner = 0, at + len(SPACE.match(text, at)[0]), None
    below = "\n" in text[at:start]
    first = at
    if below:
        if not (STRING.match(text, start) or text.startswith("(", start)):
            return [], at
        at = start
    while at < len(text):
        if text[at] in "([":
            depth, at = depth + 1, WIDE.match(text, at + 1).end()
            continue
        if literal := STRING.match(text, at):
            if (depth or below) and ASSIGNS.match(text, literal.end()):
                break
            kind = next(k for k in ("lines", "ticked", "text") if literal[k] is not None)
            if kind != "text" and "\n" in literal[kind]:
                rows += [[m.span()] for m in LINES.finditer(text, *literal.span(kind))]
                inner = literal.start(kind) if inner is None else inner
            else:
                row.append(literal.span(kind))
            at = literal.end()
        elif bare := BARE.match(text, at):
            then = (WIDE if depth else GAP).match(text, bare.end()).end()
            if depth and text[then : then + 1] not in (",", ")", "]", "+"):
                break
            if bare[0] in constants:
                row.append(constants[bare[0]])
            elif not text.startswith("+", then):
                row.append(bare.span())
            at = bare.end()
        else:
            break
        go_on = False
        while not go_on:
            then = (WIDE if depth else GAP).match(text, at).end()
            mark = text[then : then + 1]
            if mark == "+":
                at, go_on = WIDE.match(text, then + 1).end(), True
            elif depth and mark in (")", "]"):
                depth, at = depth - 1, then + 1
            elif depth and mark == ",":
                rows.append(row)
                row, at, go_on = [], WIDE.match(text, then + 1).end(), True
            elif literal and STRING.match(text, then):
                at, go_on = then, True
            else:
                break
        if not go_on:
            break
    if inner is None and ("#" in (seen := text[first:at]) or "//" in seen) and (comment := COMMENT.search(text, first, at)):
        inner = comment.start()
    return [r for r in (*rows, row) if r], at if inner is None else inner


def lex(text: str):
    """(names, rows) for each assignment: rows of spans of literals and of numbers of assignments before (from 0)."""
    constants: dict[str, int] = {}
    count = 0
    if "=" not in text and ":" not in text:
        return
    at = 0
    while target := TARGET.search(text, at):
        found = [target]
        while target := TARGET.match(text, at := target.end()):  # a = b = "c"
            found.append(target)
        names = [".".join((t[2], *NAME.findall(t[3]))) for t in found]
        block = BLOCK.match(text, at) if found[-1]["by"] == ":" else None
        if block:  # looked through for targets as well
            at = block.end()
            rows = _block(text, found[0].start(), at) if max(map(name_score, names)) >= LEAST_SCORE else []
        else:
            rows, at = _value(text, at, constants)
        if rows:
            constants.update(dict.fromkeys(names, count))
            count += 1
            yield names, rows


def literal_spans(text: str) -> list[Span]:
    assigned = list(lex(text))
    if max((name_score(x) for names, _ in assigned for x in names), default=0.0) < LEAST_SCORE:
        return []
    own: dict[tuple[int, int], float] = {}
    looks: list[Look] = []  # of each assignment
    rows_scores: list[list[float]] = []  # of each of its rows of two literals or more
    for _, rows in assigned:
        whole, scores = Look(), []
        for row in rows:
            look = Look()
            for part in row:
                if isinstance(part, int):
                    look.add(looks[part])
                else:
                    mine = Look(text[slice(*part)].replace("\\\r\n", "").replace("\\\n", ""))
                    own[part] = mine.score()
                    look.add(mine)
            scores.append(look.score() if look.parts > 1 else 0.0)
            whole.add(look)
        looks.append(whole)
        rows_scores.append(scores)
    # The best name's score, and the best product of a name's and a row's, that reach an assignment from later ones.
    reach = [(0.0, 0.0)] * len(assigned)
    best: dict[tuple[int, int], float] = {}
    for k in range(len(assigned) - 1, -1, -1):
        names, rows = assigned[k]
        weight = max(map(name_score, names))
        weight = weight if weight >= LEAST_SCORE else 0.0
        for row, score in zip(rows, rows_scores[k], strict=True):
            to = max(weight, reach[k][0]), max(weight * score, reach[k][1])
            for part in row:
                if isinstance(part, int):
                    reach[part] = max(reach[part][0], to[0]), max(reach[part][1], to[1])
                elif part[0] < part[1]:
                    best[part] = max(best.get(part, 0.0), to[0] * own[part], to[1])
    return [("literal", a, b) for (a, b), score in best.items() if score >= LEAST_SCORE]


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (base spans and literals, by start, then kind)."""

    def run(ids: list, texts: list[str]) -> dict:
        base = [by_start(base_spans(x), KINDS) for x in texts]
        out = {"doc_id": ids} | {f"n_{k}": [sum(s[0] == k for s in x) for x in base] for k in KINDS[:3]}
        out["base_sha256"] = [digest(x) for x in base]
        out["spans"] = [joined(by_start(x + literal_spans(t), KINDS)) for x, t in zip(base, texts, strict=True)]
        return out

    return map_texts(docs, lambda: run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first."""
    out, at = [], 0
    for kind, a, b in by_start(base_spans(text) + literal_spans(text), KINDS):
        if a >= at:
            out += (text[at:a], f"[{kind}]")
        elif b <= at:
            continue
        at = max(at, b)
    return "".join([*out, text[at:]])
