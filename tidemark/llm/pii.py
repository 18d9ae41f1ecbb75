"""Personal data, and terms that give it away: information-theoretic sanitisation.

Fixed patterns find e-mail addresses, IP addresses, card and telephone numbers; these are the protected entities. A term
discloses an entity of its document as far as seeing the term tells which entity it is. What stays unknown, in bits, is

    residual = -log2 P(entity | term),

with the probability at the lower end of its 95 % interval (Wilson's) given that n(term, entity) of the n(term) documents with the
term hold the entity too. From 1 bit down the term is generalised, from half a bit down it is removed, wherever it stands in a
document that holds the entity. The interval is what keeps rare words apart from names: it takes 4 documents that all agree
to get to 1 bit, and 10 to get to half a bit. So an entity of fewer than 4 documents discloses nothing by its terms (that a word
stands beside an address once tells nothing of other texts); the address itself is found by its pattern anyway. The estimate
depends on documents with the term and the entity alone, not on the size of the corpus; that only tells whether the entity is
so common that the term adds nothing: the probability must be LIFT times that of the entity at least.

A term is a run of letters of any length; of scripts written without spaces, every two neighbouring characters.

All counts cover the whole corpus, with partial sums. Entities with the same documents disclose alike and are counted as
one class. As P(entity | term) must be a half at least, a term of more than twice the entity's documents can't disclose; the
most frequent terms (a table of at most MOST_TERMS, broadcast) are passed over by that bound before rows are made, without any
loss. Classes and terms of a document are rows of their own, (document, class) and (document, term), which joins bring together and
partial sums count: a worker holds one text and its words, whatever the number of entities in it.

Defined results: null and empty texts have no spans; an entity in half of all documents or more discloses nothing. Repeated rows
count as documents and give repeated rows. A very long text takes memory in proportion to its length. Extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, dealt_round, map_texts
from tidemark.llm.spans import Span, by_kind, digest, joined

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
#: Bits that stay unknown at most; normal quantile of the interval; least ratio to the entity's own probability.
GENERALISE, REMOVE, Z, LIFT = 1.0, 0.5, 1.959964, 2.0
#: Documents that an entity, and a term with it, must have at least: fewer can't get to GENERALISE, even if all agree.
LEAST = 4
MOST_TERMS = 500_000

# The contract's patterns (fixed values), put so that long runs take linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]+")
_PACKED = "\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
PACKED = re.compile(f"[{_PACKED}]")
RUNS = re.compile(f"[{_PACKED}]+|[^{_PACKED}]+")


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the run before an @, back to the end of the match before; the first @ with a domain counts."""
    out, done, at = [], 0, text.find("@")
    while at != -1:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return by_kind(out, KINDS)


def _hashed(s: str) -> int:
    h = xxhash.xxh64_intdigest(s.encode())
    return h - (1 << 64) if h >> 63 else h


def entity(text: str, span: Span) -> int:
    kind, a, b = span
    value = text[a:b].lower()
    return _hashed(f"{kind}:{_digits(value) if kind in ('card', 'phone') else value}")


def words(text: str) -> list[tuple[int, int]]:
    """All terms of a text: runs of letters, and pairs of neighbouring characters of scripts without spaces."""
    if text.isascii() or not PACKED.search(text):
        return [m.span() for m in TERM.finditer(text)]
    out = []
    for m in TERM.finditer(text):
        for run in RUNS.finditer(text, *m.span()):
            a, b = run.span()
            out += [(k, k + 2) for k in range(a, b - 1)] if b - a > 2 and PACKED.match(text, a) else [(a, b)]
    return out


def outside(places: list[tuple[int, int]], spans: list[Span]) -> list[bool]:
    """For each place whether it's outside all spans."""
    merged: list[list[int]] = []
    for _, x, y in sorted(spans, key=lambda s: s[1:]):
        if merged and x <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], y)
        else:
            merged.append([x, y])
    starts = [x for x, _ in merged]
    out = []
    for a, b in places:
        k = bisect_right(starts, b - 1)
        out.append(not k or merged[k - 1][1] <= a)
    return out


def near(text: str, span: Span, spans: list[Span]) -> list[tuple[int, int]]:
    """The terms that go with a span: all of the document outside its spans."""
    found = words(text)
    return [w for w, free in zip(found, outside(found, spans), strict=True) if free]


def _scan(ids: list, texts: list[str]) -> dict:
    spans = [base_spans(x) for x in texts]
    entities = [sorted({entity(t, s) for s in mine}) for t, mine in zip(texts, spans, strict=True)]
    out = {"id": ids} | {f"n_{k}": [sum(s[0] == k for s in x) for x in spans] for k in KINDS[:4]}
    out |= {"base_sha256": list(map(digest, spans)), "base": list(map(joined, spans)), "entities": entities}
    return out | {"text": [t if e else None for t, e in zip(texts, entities, strict=True)]}


_ROWS = (
    "id struct<doc_id:bigint,uid:bigint>, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, "
    "entities array<bigint>, text string"
)
def _document_counts(docs: DataFrame) -> DataFrame:
    """term, n_term: documents with the term, for all terms."""

    def run(ids: list, texts: list[str]) -> dict | None:
        counts: Counter = Counter()
        for text in texts:
            found = TERM.findall(text) if text.isascii() or not PACKED.search(text) else [text[a:b] for a, b in words(text)]
            counts.update({w.lower() for w in set(found)})
        return {"term": list(map(_hashed, counts)), "n": list(counts.values())} if counts else None

    return map_texts(docs, lambda: run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent terms, by term, and the documents of each."""
    least, total = None, 0
    for power, n in sorted(counts.groupBy(F.floor(F.log2("n_term")).alias("power")).count().collect(), reverse=True):
        total += n
        if total > MOST_TERMS:
            break
        least = power
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    got = counts.filter(F.col("n_term") >= 1 << least).toArrow()
    term, n = (got[c].to_numpy() for c in ("term", "n_term"))
    order = np.argsort(term)
    return term[order], n[order]


def lower_bound(both, of_term):
    """Lower end of Wilson's interval for a probability of which ``both`` of ``of_term`` trials succeeded; columns or numbers."""
    p, z2 = both / of_term, Z * Z
    root = F.sqrt if isinstance(both, Column) else np.sqrt
    return (p + z2 / (2 * of_term) - Z * root(p * (1 - p) / of_term + z2 / (4 * of_term * of_term))) / (1 + z2 / of_term)


def _classes(holding: DataFrame, n: int) -> DataFrame:
    """uid, class, n_entity: the classes of entities of each document, but for those that can't be disclosed."""
    each = holding.select("id.uid", F.explode("entities").alias("entity"))
    docs_of = F.bit_xor(F.xxhash64("uid"))
    of_entity = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), docs_of.alias("docs")).filter((F.col("n_entity") >= LEAST) & (F.col("n_entity") * LIFT <= n))
    of_entity = of_entity.select("entity", "n_entity", F.xxhash64("n_entity", "docs").alias("class"))
    return each.join(dealt_round(of_entity), "entity").select("uid", "class", "n_entity").distinct()


def _terms(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """uid, term: the different terms of documents (text, and the largest n_entity of their classes) that may disclose a class."""
    shared = rows.sparkSession.sparkContext.broadcast(_frequent(counts))

    def make():
        terms, n_terms = shared.value

        def run(ids: list, texts: list[str]) -> dict | None:
            uid, term = [], []
            for who, text in zip(ids, texts, strict=True):
                own = np.fromiter(map(_hashed, {text[a:b].lower() for a, b in words(text)}), np.int64)
                if len(terms) and len(own):
                    at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
                    own = own[(terms[at] != own) | (n_terms[at] <= 2 * who["most"])]
                uid.append(np.full(len(own), who["uid"], np.int64))
                term.append(own)
            return {"uid": np.concatenate(uid), "term": np.concatenate(term)} if uid else None

        return run

    return map_texts(rows, make, "uid bigint, term bigint", id_col=F.struct("uid", "most").alias("id"))


def _spans(rows: DataFrame) -> DataFrame:
    """uid, spans: base spans and those of the terms that disclose (hits: term, remove) of each document (base, text)."""

    def run(ids: list, texts: list[str]) -> dict:
        out = []
        for who, text in zip(ids, texts, strict=True):
            remove = {h["term"]: h["remove"] for h in who["hits"]}
            base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in who["base"].split(",") if x)]
            places = [(a, b, remove[h]) for a, b in words(text) if (h := _hashed(text[a:b].lower())) in remove]
            free = outside([p[:2] for p in places], base)
            out.append(joined(base + by_kind([("remove" if r else "generalise", a, b) for (a, b, r), f in zip(places, free, strict=True) if f], KINDS)))
        return {"uid": [x["uid"] for x in ids], "spans": out}

    return map_texts(rows, lambda: run, "uid bigint, spans string", id_col=F.struct("uid", "base", "hits").alias("id"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base spans, then terms, by kind and start)."""
    rows = cut(map_texts(docs, lambda: _scan, _ROWS, id_col=F.struct("doc_id", F.monotonically_increasing_id().alias("uid")).alias("id")))
    columns = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    n, holding = rows.count(), rows.filter(F.size("entities") > 0)
    classes = cut(_classes(holding, n))
    if classes.isEmpty():
        return rows.select("id.doc_id", *columns, F.col("base").alias("spans"))
    counts = cut(_document_counts(docs).filter(F.col("n_term") >= LEAST))
    texts = holding.select("id.uid", "base", "text").join(classes.groupBy("uid").agg(F.max("n_entity").alias("most")), "uid")
    terms = cut(_terms(texts, counts).join(counts, "term"))
    pairs = terms.join(classes, "uid").filter(F.col("n_term") <= 2 * F.col("n_entity"))
    both = pairs.groupBy("class", "n_entity", "term", "n_term").agg(F.count(F.lit(1)).alias("n_both"))
    sure = lower_bound(F.col("n_both").cast("double"), F.col("n_term").cast("double"))
    disclosing = both.select("class", "term", "n_entity", sure.alias("sure")).filter((-F.log2("sure") <= GENERALISE) & (F.col("sure") * n >= LIFT * F.col("n_entity")))
    hits = pairs.select("uid", "class", "term").join(dealt_round(disclosing), ["class", "term"]).groupBy("uid", "term").agg((-F.log2(F.max("sure")) <= REMOVE).alias("remove"))
    of_text = hits.groupBy("uid").agg(F.collect_list(F.struct("term", "remove")).alias("hits"))
    found = _spans(texts.drop("most").join(of_text, "uid")).withColumnRenamed("uid", "_uid")
    return rows.join(found, F.col("id.uid") == F.col("_uid"), "left").select("id.doc_id", *columns, F.coalesce("spans", "base").alias("spans"))


def sanitised(text: str, spans: str) -> str:
    """A text without what its spans (as ``find`` gives them) cover: entities and generalised terms give way to a label."""
    out, at = [], 0
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)), key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += (text[at : max(a, at)], "" if kind == "remove" else "[term]" if kind == "generalise" else f"[{kind}]")
        at = b
    return "".join([*out, text[at:]])
