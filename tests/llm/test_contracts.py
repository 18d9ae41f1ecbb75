"""Each operator against a plain version of its contract, over the smallest tables and over awkward rows."""

import base64
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from oracle import TINY, connect, same

from tidemark.llm import bpe, decontaminate, exact_dedup, langid, pii, quality, queries, secrets, simhash, suffix_dedup, token_counts
from tidemark.llm.spans import joined

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, odd):
    tiny = spark.read.parquet(f"{TINY}/documents.parquet")
    return {"tiny": tiny, "odd": odd}


def texts_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, TINY), queries.SQL[name], connect(TINY))


@pytest.mark.parametrize("which", ["tiny", "odd"])
def test_bpe_equals_the_library(tables, which):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for (i, t), n in texts_of(tables[which]).items():
        ids = lib.encode_ordinary(t or "")
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or "")] += n
    got = Counter(map(tuple, bpe.digest(tables[which], str(RANKS), public_tokenizers.PATTERN).collect()))
    assert got == want


def test_bpe_of_long_and_random_pieces():
    own = bpe.ByteBPE.load(str(RANKS), public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = np.random.default_rng(3)
    alphabet = list("abcdefgh ABé漢\n\t'ts12٣½_<|>😀\x1c\x85　\x00")
    for size in [*range(40), 300, 5000]:
        s = "".join(rng.choice(alphabet, size))
        ids = own.encode(s)
        assert ids == lib.encode_ordinary(s) and own.decode(ids) == s.encode()
    for s in ("a" * 2000, "ab" * 1500, "é" * 700):
        assert own.encode(s) == lib.encode_ordinary(s)


@pytest.mark.parametrize("which", ["tiny", "odd"])
def test_token_counts_equal_the_library(tables, which):
    lib = sentencepiece.SentencePieceProcessor(model_file=str(PIECES))
    want = Counter()
    for (i, t), n in texts_of(tables[which]).items():
        k = len(lib.encode(t or ""))
        want[i, len((t or "").encode()), k, k > 4096] += n
    got = token_counts.count(tables[which], str(PIECES)).drop("fit_chars").collect()
    assert Counter(map(tuple, got)) == want


def test_every_prefix_has_its_exact_count():
    lib = sentencepiece.SentencePieceProcessor(model_file=str(PIECES))
    own = token_counts.PrefixCounter.load(str(PIECES))
    rng = np.random.default_rng(4)
    parts = [*"ab  ABethé漢\x1c　\n\t12_▁<😀", "<s>", "</s>", "<0x0A>", "the", "ing", "   ", " understanding"]
    for _ in range(300):
        s = "".join(rng.choice(parts, rng.integers(0, 20)))
        p = own.prefixes(s)
        counts = [len(lib.encode(s[:k])) for k in range(len(s) + 1)]
        assert [p.at(k) for k in range(len(s) + 1)] == counts
        assert p.fit(5) == max(k for k in range(len(s) + 1) if counts[k] <= 5)


def plain_secrets(t: str) -> list:
    out = [("assign", *m.span()) for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


@pytest.mark.parametrize("which", ["tiny", "odd"])
def test_secrets_keep_the_base(tables, which):
    got = secrets.find(tables[which]).collect()
    want = Counter()
    for (i, t), n in texts_of(tables[which]).items():
        s = plain_secrets(t or "")
        want[i, *(sum(x[0] == k for x in s) for k in ("assign", "access", "hex")), sha(joined(s))] += n
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        assert sha(",".join(x for x in r["spans"].split(",") if x and not x.startswith("literal"))) == r["base_sha256"]


def test_secrets_follow_assignments():
    def found(t):
        return [t[a:b] for _, a, b in secrets.literal_spans(t)]

    assert found('x = "hunter2Hunter2!"\npassword = x') == ["hunter2Hunter2!"]
    assert found('db_pass: "a1B2c3D4e5"') == ["a1B2c3D4e5"]
    assert found("a = b = 'S3cretValue99'\nauth_token = a") == ["S3cretValue99"]
    assert found('{"private_key": "Zx81kQp0Lm", "name": "john"}') == ["Zx81kQp0Lm"]
    assert found("export SECRET_TOKEN=abcdEFGH1234") == ["abcdEFGH1234"]
    assert found('password = "changeme-please"\npassword_file = "/etc/secret/name1"\ncolour = "a1B2c3D4e5"') == []
    assert secrets.redact('pass_word: x\nsecret_key = "a1B2c3D4e5F6"').count("a1B2") == 0


@pytest.mark.parametrize("text, want", [
    ('os.environ["DB_PASSWORD"] = "a1B2c3D4e5F6"', ["a1B2c3D4e5F6"]),
    ('API_KEY = b"a1B2c3D4e5F6"\npassword = f"x1Y2z3W4v5U6"', ["a1B2c3D4e5F6", "x1Y2z3W4v5U6"]),
    ('password = ("a1B2c3D4e5F6")', ["a1B2c3D4e5F6"]),
    ('password = (\n    "a1B2c3"  # first\n    "D4e5F6"\n)\ncolour = "x1Y2z3W4v5U6"', ["a1B2c3", "D4e5F6"]),
    ('tokens_and_secret = ["a1B2c3D4e5F6", "x1Y2z3W4v5U6"]', ["a1B2c3D4e5F6", "x1Y2z3W4v5U6"]),
    ('password =\n"a1B2c3D4e5F6"', ["a1B2c3D4e5F6"]),
    ('{"private_key":\n  "a1B2c3D4e5F6",\n"name": "x1Y2z3W4v5U6"}', ["a1B2c3D4e5F6"]),
    ('secret:\n  "colour": "x1Y2z3W4v5U6"', []),
    ("secret:\n  - colour\nother: x1Y2z3W4v5U6", []),
    ("a:\n  secret_key: |\n    a1B2c3D4e5F6\n\n    g7H8i9J0k1L2\n  colour: x1Y2z3W4v5U6", ["a1B2c3D4e5F6", "g7H8i9J0k1L2"]),
    ("data: |\n  db_pass = 'a1B2c3D4e5F6'", ["a1B2c3D4e5F6"]),
    ('password = """a1B2c3D4e5F6"""', ["a1B2c3D4e5F6"]),
    ('password = """\na1B2c3D4e5F6\n"""', ["a1B2c3D4e5F6"]),
    ('config = """\npassword = \'a1B2c3D4e5F6\'\n"""', ["a1B2c3D4e5F6"]),
    ('password = \\\n    "a1B2c3D4e5F6"', ["a1B2c3D4e5F6"]),
    ('password: str = "a1B2c3D4e5F6"', ["a1B2c3D4e5F6"]),
])
def test_secrets_over_lines_brackets_and_prefixes(text, want):
    assert [text[a:b] for _, a, b in sorted(secrets.literal_spans(text))] == want


def plain_literals(t: str) -> list:
    """The same rule with every literal copied into every row that it reaches."""
    flat, best = [], {}
    for names, rows in secrets.lex(t):
        copied = [[x for part in row for x in (flat[part] if isinstance(part, int) else [part])] for row in rows]
        flat.append([x for row in copied for x in row])
        weight = max(map(secrets.name_score, names))
        for row in copied if weight >= secrets.LEAST_SCORE else []:
            values = [t[a:b].replace("\\\r\n", "").replace("\\\n", "") for a, b in row]
            whole = secrets.literal_score("".join(values)) if len(row) > 1 else 0.0
            for (a, b), value in zip(row, values, strict=True):
                if a < b:
                    best[a, b] = max(best.get((a, b), 0), weight * max(whole, secrets.literal_score(value)))
    return sorted(k for k, v in best.items() if v >= secrets.LEAST_SCORE)


def test_literals_by_brute_force():
    rng = np.random.default_rng(12)
    names = ["a", "b", "colour", "db_pass", "auth_token", "key_file", "x.secret", "private_key"]
    seen = 0
    for _ in range(400):
        lines = []
        for _ in range(rng.integers(1, 12)):
            value = [str(rng.choice(['"a1B2"', "'D4e5F6g7H8'", '"changeme"', '"two words here"', '"zzzzzzzzzzzz"', "b'Q9w8'", *names])) for _ in range(rng.integers(1, 5))]
            joined_by = str(rng.choice([" + ", ", ", "\n  + "]))
            right = joined_by.join(value) if joined_by != ", " else f"[{', '.join(value)}]"
            lines.append(f"{rng.choice(names)} {rng.choice(['=', ':', '=>', ':='])} {right}")
        t = "\n".join(lines)
        got = sorted((a, b) for _, a, b in secrets.literal_spans(t))
        assert got == plain_literals(t)
        seen += len(got)
    assert seen > 300


def test_names_that_go_into_names_take_linear_time():
    import time

    start = time.time()
    doubled = 'a0 = "S3cr"\n' + "".join(f"a{k + 1} = a{k} + a{k}\n" for k in range(400)) + "password = a400"
    assert [doubled[a:b] for _, a, b in secrets.literal_spans(doubled)] == ["S3cr"]
    grown = "".join(f'secret = secret + "aB{k}"\n' for k in range(10_000))
    assert len(secrets.literal_spans(grown)) == 10_000
    assert time.time() - start < 10


def test_many_entities_in_one_text_take_linear_time(spark):
    import time

    text = " ".join(f"user{k}@mail{k % 7}.com wrote word{k % 900}" for k in range(50_000))
    start = time.time()
    spans = pii.base_spans(text)
    free = pii.near(text, spans[0], spans)
    assert len(spans) == 50_000 and len(free) == 100_000 and time.time() - start < 10
    docs = spark.createDataFrame([(1, text), (2, "mail user5@mail5.com"), (3, "none")], "doc_id bigint, text string")
    assert [tuple(r) for r in pii.find(docs).select("doc_id", "n_email").orderBy("doc_id").collect()] == [(1, 50_000), (2, 1), (3, 0)]


def plain_pii(t: str) -> list:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and (sum(d[::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


@pytest.mark.parametrize("which", ["tiny", "odd"])
def test_pii_keeps_the_base(tables, which):
    got = pii.find(tables[which]).collect()
    want = Counter()
    for (i, t), n in texts_of(tables[which]).items():
        s = plain_pii(t or "")
        want[i, *(sum(x[0] == k for x in s) for k in ("email", "ip", "card", "phone")), sha(joined(s))] += n
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert sha(",".join(x for x in r["spans"].split(",") if x and x.split(":")[0] in ("email", "ip", "card", "phone"))) == r["base_sha256"]


def test_pii_terms_by_brute_force(spark):
    import random

    r = random.Random(5)
    names = ["alpha", "bravo", "carol", "delta", "echoes", "foxtrot", "golfer", "hotel", "India", "juliet"]
    docs = []
    for i in range(300):
        w = r.choices(names, k=r.randint(0, 30))
        k = r.randint(0, 14)
        if k < 10:
            if k < 3:
                w.insert(r.randint(0, len(w)), "Quimby" if k == 0 else "Zorro")
            w.insert(r.randint(0, len(w)), f"user{k}@mail.com")
        docs.append((i, " ".join(w)))
    docs += [(400, None), (401, ""), (None, "Zorro user1@mail.com"), docs[5]] + [(500 + k, "Mildred rare@mail.com" if k < 8 else "Mildred") for k in range(9)]
    info = []
    for i, t in docs:
        t = t or ""
        spans = pii.base_spans(t)
        near = [(pii.entity(t, s), t[a:b].lower(), a, b) for s in spans for a, b in pii.near(t, s, spans)]
        info.append((i, spans, near, {pii.entity(t, s) for s in spans}, {w.lower() for w in pii.TERM.findall(t)}))
    want = []
    for i, spans, near, _, _ in info:
        best: dict = {}
        for e, w, a, b in near:
            both = sum(any((e, w) == x[:2] for x in other[2]) for other in info)
            of_e, of_w = sum(e in x[3] for x in info), sum(w in x[4] for x in info)
            sure = wilson(both, of_w)
            if sure >= 0.5 and sure >= 2 * of_e / len(docs):
                best[a, b] = max(best.get((a, b), 0), sure)
        terms = [("remove" if d >= 2**-0.5 else "generalise", a, b) for (a, b), d in best.items()]
        want.append((i, joined(pii.by_kind(spans + terms, pii.KINDS))))
    got = [tuple(x) for x in pii.find(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).select("doc_id", "spans").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any("remove" in s for _, s in want) and any("generalise" in s for _, s in want)


def wilson(k, n, z=1.959964):
    """The p under k / n for which k successes are z standard deviations above their mean (by bisection)."""
    low, high = 0.0, k / n
    for _ in range(200):
        p = (low + high) / 2
        if (k / n - p) ** 2 > z * z * p * (1 - p) / n:
            low = p
        else:
            high = p
    return high


def _marked(docs, got, i):
    text = dict(docs)[i]
    spans = [x.split(":") for x in got[i].split(",") if x]
    return {kind: [text[int(a) : int(b)] for k, a, b in spans if k == kind] for kind in ("generalise", "remove")}


def test_pii_far_rare_and_short_terms(spark):
    """Names in headings and addresses at the end: of 10 documents, of 5, of 3 and of one; a short name; a script without spaces."""
    fill = "the report went out on time and all was well " * 20
    docs = [(i, fill + f"Quimby wrote {fill}" if i == 90 else fill) for i in range(100)]
    docs += [(200 + k, f"Zebulon Li report {fill} zl@mail.com and Zebulon went") for k in range(10)]
    docs += [(300 + k, f"report by 王小明的 {fill} wang@mail.com") for k in range(5)]
    docs += [(400 + k, f"Xanthippe {fill} xa@mail.com") for k in range(3)] + [(500, f"Once Only {fill} once@mail.com")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).select("doc_id", "spans").collect()}
    assert _marked(docs, got, 204) == {"generalise": [], "remove": ["Zebulon", "Li", "Zebulon"]}
    assert {"王小", "小明"} <= set(_marked(docs, got, 302)["generalise"]) and "report" not in _marked(docs, got, 302)["generalise"]
    assert all(_marked(docs, got, i) == {"generalise": [], "remove": []} for i in (90, 1, 400, 500))


def test_pii_outcome_does_not_move_with_the_size_of_the_corpus(spark):
    """The same documents among 10^2, 10^3 and 10^4 others get the same spans; so do their counts among 10^6 and 10^9."""
    some = [(k, f"Zebulon zl@mail.com rare{'abcdefghijkl'[k]}") for k in range(12)] + [(50 + k, f"Quimby q@mail.com {'other' if k else ''}") for k in range(5)]
    outcomes = []
    for size in (100, 1_000, 10_000):
        others = spark.range(1000, 1000 + size).selectExpr("id AS doc_id", "concat('plain words number', id, ' and nothing else') AS text")
        df = spark.createDataFrame(some, "doc_id bigint, text string").unionByName(others)
        outcomes.append(sorted((r["doc_id"], r["spans"]) for r in pii.find(df).filter("doc_id < 1000").collect()))
    assert outcomes[0] == outcomes[1] == outcomes[2] and "remove" in outcomes[0][0][1] and "generalise" in outcomes[0][14][1]
    assert not any("rare" in dict(some)[i][int(x.split(":")[1]) : int(x.split(":")[2])] for i, s in outcomes[0] for x in s.split(",") if "mail" not in x)
    for both, of_term in ((1, 1), (3, 3), (4, 4), (10, 10), (40, 70), (40, 1000)):
        assert pii.lower_bound(float(both), float(of_term)) == pytest.approx(wilson(both, of_term))


def test_pii_memory_of_one_long_text():
    """2,000 entities and 20,000 words in one text: what a worker makes of it is one row a word."""
    import tracemalloc

    text = " ".join(f"user{k}@mail{k}.com" for k in range(2_000)) + " " + " ".join(f"word{chr(97 + k % 26)}{'abcdefghij'[k // 26 % 10]}{'abcdefghij'[k // 260 % 10]}{'abcdefghij'[k // 2600]}" for k in range(20_000))
    tracemalloc.start()
    out = pii._scan([1], [text])
    spans = pii.words(text)
    names = {text[a:b].lower() for a, b in spans}
    assert out["n_email"] == [2_000] and len(names) >= 20_000 and tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_pii_of_many_entities_and_words_that_meet(spark):
    """Every word goes with every entity in the same four documents: all pairs count, and nothing is held for a text at a time."""
    words = ["w" + "".join("abcdefghij"[int(d)] for d in str(k)) for k in range(2_000)]
    text = " ".join(f"user{k}@mail.com" for k in range(200)) + " " + " ".join(words)
    docs = spark.createDataFrame([(k, text) for k in range(4)] + [(10 + k, "nothing") for k in range(20)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert all(got[k].count("generalise:") == 2_000 for k in range(4)) and got[10] == ""


def test_pii_sanitised():
    t = "mail joe@mail.com to Quimby now"
    assert pii.sanitised(t, "email:5:17,remove:21:27") == "mail [email] to  now"


def plain_fingerprint(t) -> int:
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(ids, fps) -> dict:
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least: dict = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


@pytest.mark.parametrize("which", ["tiny", "odd"])
def test_simhash_by_brute_force(tables, which):
    docs = texts_of(tables[which])
    rows = [(i, plain_fingerprint(t)) for (i, t) in docs if i is not None]
    of = components([i for i, _ in rows], [f for _, f in rows])
    want = Counter()
    for (i, t), n in docs.items():
        want[i, f"{plain_fingerprint(t):016x}", of.get(i)] += n
    assert Counter(map(tuple, simhash.report(tables[which]).collect())) == want


def test_simhash_links_in_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST", 6)
    rng = np.random.default_rng(8)
    bases = rng.integers(0, 2**63, 6)
    fps = {int(b) for b in bases}
    for b in bases.tolist():
        x = b
        for _ in range(25):
            y = x
            for k in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                y ^= 1 << k
            fps.add(y)
            x = y if rng.random() < 0.5 else b
    rows = [(simhash._signed(f), i) for i, f in enumerate(sorted(fps))]
    got = simhash.roots(simhash.link(spark.createDataFrame(rows, "fp bigint, node bigint")))
    found = {r["node"]: r["root"] for r in got.collect()}
    want = components(list(range(len(rows))), sorted(fps))
    assert {i: found.get(i, i) for i in want} == want


def test_simhash_forest_connects():
    rng = np.random.default_rng(9)
    fp = rng.integers(0, 2**64, 1, dtype=np.uint64) ^ np.array([1 << int(k) for k in rng.integers(0, 20, 60)], np.uint64)
    fp = np.unique(fp)
    links = simhash.forest(fp)
    assert len(links) == len(fp) - len(set(components(list(range(len(fp))), fp.tolist()).values()))


@pytest.mark.parametrize("which", ["tiny", "odd"])
def test_exact_dedup_by_brute_force(tables, which):
    docs = texts_of(tables[which])
    groups = defaultdict(list)
    for (i, t), n in docs.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")] += [(-len(t or ""), i is None, i or 0, i)] * n
    want = Counter()
    for text, rows in groups.items():
        rows.sort()
        for k, row in enumerate(rows):
            want[row[3], rows[0][3], len(rows), k == 0, sha(text)] += 1
    assert Counter(map(tuple, exact_dedup.find(tables[which]).collect())) == want


def test_exact_dedup_keeps_one_row_of_each_text(odd):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    texts = [re.sub(r"\s", "", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) and kept.filter("doc_id IS NULL").count() == 1
    assert sum(plain_exact(texts_of(odd).elements()).values()) == len(texts)


def test_decontamination_of_awkward_rows(odd, items):
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.report(odd, items).collect()}
    r = got[1, 72]
    assert r["contaminated"] and r["n_items"] == 3 and r["items_sha256"] == sha("1,2,5")
    # All words but the very first one and, in the last sentence, "the" and "dog"; "lazy" is an item of its own.
    assert r["n_hit"] == 69
    assert got[3, 0]["n_hit"] == 0 and got[3, 0]["items_sha256"] == sha("")


def test_decontamination_in_blocks(odd, items, monkeypatch):
    one = sorted(decontaminate.report(odd, items).drop("longest").collect(), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 5)
    assert sorted(decontaminate.report(odd, items).drop("longest").collect(), key=str) == one


def test_decontamination_in_fifty_blocks(spark, tables, monkeypatch):
    """At most BLOCKS automata are alive at a time, a task has one worker, and the rows are those of one automaton."""
    items = spark.read.parquet(f"{TINY}/benchmark.parquet")
    docs = tables["tiny"].unionByName(tables["tiny"].filter("doc_id % 5 = 0")).withColumn("_id", F.lit(1)).withColumn("spans", F.lit("x"))
    one = sorted(map(tuple, decontaminate.report(docs, items).drop("longest").collect()))
    whole = sorted(map(tuple, decontaminate.mark(docs, items).select("row.doc_id", "row.spans", "spans", "items").collect()))
    n_words = sum(len(decontaminate.words(r["text"])) for r in items.collect())
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", n_words // 49)
    assert decontaminate._blocks(items)[0] >= 49
    alive, most = [], []
    build, hits = decontaminate.Automaton.__init__, decontaminate._group_hits

    def counted(self, *args):
        build(self, *args)
        alive.append(1)
        most.append(len(alive))

    def ended(docs, automata):
        out = decontaminate.cut(hits(docs, automata))
        alive.clear()
        return out

    monkeypatch.setattr(decontaminate.Automaton, "__init__", counted)
    monkeypatch.setattr(decontaminate, "_group_hits", ended)
    marked = decontaminate.mark(docs, items)
    assert max(most) <= decontaminate.BLOCKS and len(most) >= 49
    assert marked._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, marked.select("row.doc_id", "row.spans", "spans", "items").collect())) == whole
    assert sorted(map(tuple, decontaminate.report(docs, items).drop("longest").collect())) == one


def test_spans_are_removed_from_documents(odd, items, monkeypatch):
    got = Counter(map(tuple, decontaminate.remove_spans(odd, items).select("doc_id", "text").collect()))
    a = decontaminate.Automaton([tuple(r) for r in items.collect()])
    want = Counter()
    for r in odd.collect():
        spans = [x for s in sorted(a.match(decontaminate.words(r["text"]))[0]) for x in s]
        want[r["doc_id"], r["text"] and decontaminate.without_spans(r["text"], spans)] += 1
    assert got == want and decontaminate.remove_spans(odd, items).columns == odd.columns
    assert not any(decontaminate.report(decontaminate.remove_spans(odd, items).filter("doc_id = 7"), items).select("n_hit").first())


def test_spans_are_cut_out():
    a = decontaminate.Automaton([(1, "one two three")])
    text = "Start, one TWO; three! End"
    spans, found, longest = a.match(decontaminate.words(text))
    assert spans == [(1, 4)] and found == {1} and longest == 3
    assert decontaminate.without_spans(text, [1, 4]) == "Start, ! End"


def plain_passages(docs, length=50) -> list:
    """Stretches of words in windows with the same first document, of the windows that two documents or more have."""
    words = defaultdict(list)
    for (i, t), _ in docs.items():
        if i is not None and t is not None:
            words[i].append(t.encode().lower().split())
    seen = defaultdict(set)
    for i, all_words in words.items():
        for w in all_words:
            for s in range(len(w) - length + 1):
                seen[tuple(w[s : s + length])].add(i)
    covered = defaultdict(set)
    for i, all_words in words.items():
        for w in all_words:
            for s in range(len(w) - length + 1):
                who = seen[tuple(w[s : s + length])]
                if len(who) > 1:
                    covered[i, min(who)].add(s)
    out = []
    for (i, f), starts in covered.items():
        at = None
        for s in sorted(starts):
            if at and at[1] >= s:
                at[1] = s + length
            else:
                out += [(i, *at, f)] if at else []
                at = [s, s + length]
        out.append((i, *at, f))
    return sorted(out)


@pytest.mark.parametrize("which", ["tiny", "odd"])
def test_passages_by_brute_force(tables, which):
    assert sorted(map(tuple, suffix_dedup.passages(tables[which]).collect())) == plain_passages(texts_of(tables[which]))


@pytest.mark.parametrize("hot, suffixes", [(2000, 20_000), (100, 500)])
def test_passages_of_a_hot_key_over_many_partitions(spark, tmp_path, monkeypatch, hot, suffixes):
    """A passage in a third of all documents, passages side by side, eight files and 32 shuffle partitions; with hot keys too."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SUFFIXES", suffixes)
    rng = np.random.default_rng(11)
    vocab = [f"w{k}" for k in range(400)]
    hot, a, b = (" ".join(rng.choice(vocab, n)) for n in (60, 55, 70))
    docs = []
    for i in range(3000):
        parts = [" ".join(rng.choice(vocab, rng.integers(5, 90)))]
        parts += [hot] if i % 3 == 0 else [a] if i % 7 == 1 else [a, b] if i % 50 == 2 else [b] if i % 50 == 5 else []
        docs.append((i, " ".join([*parts, *rng.choice(vocab, rng.integers(0, 40))])))
    docs += [(9, docs[9][1]), (4000, docs[2999][1]), (None, docs[0][1]), (4001, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8).write.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = sorted(map(tuple, suffix_dedup.passages(spark.read.parquet(str(tmp_path / "docs"))).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = plain_passages(Counter(docs))
    assert got == want and len(want) > 1000


def test_one_copy_of_every_passage_is_to_keep(spark):
    """Documents 2 and 5 have A; 5 and 9 have B, which follows A in 5: A is kept in 2, B in 5."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    docs = spark.createDataFrame([(2, a), (5, f"{a} {b}"), (9, b)], "doc_id bigint, text string")
    assert sorted(map(tuple, suffix_dedup.passages(docs).collect())) == [(2, 0, 60, 2), (5, 0, 60, 2), (5, 60, 120, 5), (9, 0, 60, 5)]


def test_passages_of_periodic_and_overlapping_texts(spark):
    """Equal runs within a window, copies that share parts only, two texts of one doc_id."""
    rng = np.random.default_rng(13)
    base = [f"w{k}" for k in rng.integers(0, 5, 400)]
    docs = [(k, " ".join(base[a : a + n])) for k, (a, n) in enumerate(zip(rng.integers(0, 300, 30).tolist(), rng.integers(45, 140, 30).tolist(), strict=True))]
    docs += [(50, "a b " * 60), (51, "b a " * 70), (52, "a " * 55), (53, "a " * 49), (54, "a " * 50), (3, " ".join(base[100:190])), (60, " ".join(base[:70] + ["x"] + base[:70]))]
    got = sorted(map(tuple, suffix_dedup.passages(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()))
    assert got == plain_passages(Counter(docs))


def test_neighbours_have_what_is_common():
    rng = np.random.default_rng(14)
    rows = np.where(np.arange(9) < rng.integers(0, 10, 80)[:, None], rng.integers(1, 3, (80, 9)), 0)
    order, common = suffix_dedup.ordered(rows)
    for depth in range(10):
        classes = suffix_dedup._classes(order, common, depth)
        for a in range(80):
            for b in range(a):
                if (rows[a, :depth] > 0).all() and (rows[b, :depth] > 0).all():
                    assert (classes[a] == classes[b]) == (rows[a, :depth] == rows[b, :depth]).all()


def test_minimisers_are_chosen_by_content():
    words = suffix_dedup.word_hashes(" ".join(f"w{i}" for i in range(200)))
    keys, least, windows = suffix_dedup.minimisers(words)
    _, least2, windows2 = suffix_dedup.minimisers(words[37:])
    assert (least[37:] == least2).all() and (windows[37:] == windows2).all() and set(least) <= set(keys)


def test_viterbi_is_optimal():
    def value(score, path, penalty):
        return sum(score[k, s] for k, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:], strict=False))

    rng = np.random.default_rng(0)
    sizes = np.array([0, 1, 5, 64, 65, 200, 0, 63])
    score = -5 * rng.random((sizes.sum(), 3))
    path, at = langid.viterbi(score, sizes, 3.0), 0
    for n in sizes.tolist():
        mine = score[at : at + n]
        best = np.zeros(3)
        for row in mine:
            best = np.maximum(best, best.max() - 3.0) + row
        if n:
            assert value(mine, path[at : at + n].tolist(), 3.0) == pytest.approx(best.max())
        at += n


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def plain_language(model, text) -> tuple[str, float]:
    """The best sequence by a dynamic programme, a word and a language at a time."""
    words = langid.words_of(text or "")
    if not words:
        return "und", 0.0
    score = model.scores(words)
    value, back = score[0].copy(), []
    for row in score[1:]:
        top = int(value.argmax())
        stay = value >= value[top] - langid.PENALTY
        back.append(np.where(stay, np.arange(len(row)), top))
        value = np.where(stay, value, value[top] - langid.PENALTY) + row
    path = [int(value.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    letters = Counter()
    for w, k in zip(words, reversed(path), strict=True):
        letters[k] += len(w)
    return model.langs[max(letters, key=lambda k: (letters[k], -k))], max(letters.values()) / sum(letters.values())


def test_language_by_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    model = langid.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in langid.report(docs).collect():
        lang, share = plain_language(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(share, abs=1e-6)


def test_quality_by_brute_force(spark):
    """Each document down each tree, one comparison at a time."""
    docs, labels = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def leaf(tree, node, x):
        if node >= len(model.feature[tree]):
            return model.leaf[tree][node - len(model.feature[tree])]
        return leaf(tree, 2 * node + (2 if x[model.feature[tree][node]] > model.threshold[tree][node] else 1), x)

    for r in quality.report(docs, labels).collect():
        x = quality.statistics(texts[r["doc_id"]] or "")
        p = 1 / (1 + np.exp(-(model.base + sum(leaf(t, 0, x) for t in range(len(model.leaf))))))
        assert r["score"] == pytest.approx(p, rel=1e-9) and r["predicted"] == int(r["score"] >= 0.3)


def test_mixed_text_gets_spans():
    cells = np.zeros((langid.CELLS, 2))
    for k, text in enumerate(("the cat sat on that mat then", "le chat est sur une table ronde")):
        cell, _ = langid.grams(langid.words_of(text) * 50)
        np.add.at(cells[:, k], cell, 1)
    scripts = np.zeros((len(langid._NAMES), 2))
    scripts[langid._NAMES.index("latin")] = 1
    [(lang, score, spans)] = langid.Model(["en", "fr"], cells, scripts).label(["the cat sat on that mat le chat est sur une table ronde"])
    assert spans == "en:0:6,fr:6:13" and lang == "fr" and 0.5 < score < 0.6


def test_language_of_awkward_rows(odd, empty):
    got = {r["doc_id"]: r for r in langid.report(odd).collect()}
    assert {got[k]["lang_pred"] for k in (3, 4, 5)} == {"und"} and got[1]["lang_pred"] == "en"
    assert langid.report(empty).count() == 0


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.report(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    bad, good = ([r["score"] for r in rows if r["quality"] == k] for k in (0, 1))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.95


def test_trees_are_what_the_arrays_say():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.Trees.fit(x, y, trees=30)
    p = model.score(x)
    assert ((p > 0.5) == y).mean() > 0.97
    raw = model.base
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
        k = 0
        while k < len(feature):
            k = 2 * k + 1 + int(x[7, feature[k]] > threshold[k])
        raw += leaf[k - len(feature)]
    assert p[7] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_samples_at_any_size(spark):
    """About as many as asked for, all of few, and the right share of 10**13 rows as well."""
    from tidemark.llm.common import sample_limit, sampled

    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert ids.filter(sampled(200_000, 200_000)).count() == 200_000
    assert 1_800 < ids.filter(sampled(2_000, 200_000)).count() < 2_200
    assert sample_limit(20_000, 10**13) / 2**63 == pytest.approx(2e-9)


def test_quality_learns_one_row_of_a_doc_id(spark, monkeypatch):
    """A doc_id that holds most rows, in documents and labels, doesn't swell the sample."""
    docs = spark.createDataFrame([(k, f"some words {k}") for k in range(1, 40)] + [(1, f"copy {k}") for k in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)] + [(1, 0)] * 200, "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality.Trees, "fit", staticmethod(lambda x, y: seen.append((len(x), sorted(y)))))
    quality.train(docs, labels)
    used = labels.filter("crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id").distinct().count()
    assert [n for n, _ in seen] == [used]


def test_quality_of_awkward_rows(odd, empty, labels):
    rows = quality.report(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.report(empty, labels).count() == 0
    assert {r["score"] for r in quality.report(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_empty_tables(spark, empty, items):
    for found in (
        bpe.digest(empty, str(RANKS), public_tokenizers.PATTERN), secrets.find(empty), pii.find(empty), simhash.report(empty), exact_dedup.find(empty),
        decontaminate.report(empty, items), suffix_dedup.passages(empty), token_counts.count(empty, str(PIECES)), exact_dedup.keep_first(empty), simhash.keep_first(empty),
    ):
        assert found.count() == 0
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert decontaminate.report(docs, items.limit(0)).first()["n_hit"] == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, TINY)
        assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, TINY).collect()
    assert {r["doc_id"] for r in out} == ids and 0 < len(ids) < docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["decoded_sha256"] == sha(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for r in out)


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i, t))
    return Counter((min(g)[3], min(g)[4]) for g in groups.values())


def plain_near(rows):
    """Rows with an id and a text each, all different; the row of the smallest id of each component."""
    known = [(i, t, plain_fingerprint(t)) for i, t in rows if i is not None]
    of = components(list(range(len(known))), [f for _, _, f in known])
    first = {}
    for k, (i, t, _) in enumerate(known):
        first[of[k]] = min(first.get(of[k], (i, t)), (i, t))
    return Counter(first.values()) + Counter((i, t) for i, t in rows if i is None)


def plain_clean(rows, items, window=13):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    runs = set()
    for _, t in items:
        w = split(t)
        n = min(window, len(w))
        runs |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(r) for r in runs}
    out = Counter()
    for i, t in rows:
        w = split(t)
        hit = {p for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in runs for p in range(k, k + n)}
        out[i, t] += not (hit and 20 * len(hit) >= len(w))
    return +out


REPEATED = [(3, "x y"), (7, "xy"), (7, "a text of its own"), (7, "a text of its own"), (8, "a text of  its own!"), (None, "x y"), (None, "only here"), (2, None), (2, ""), (2, "other words altogether")]


def test_a_repeated_id_loses_no_text(spark):
    docs = spark.createDataFrame(REPEATED, "doc_id bigint, text string").selectExpr("*", "1 AS mark", "2 AS kept", "3 AS _id", "4 AS row").repartition(3)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    of = texts_of(kept)
    assert of.pop((2, None), 0) + of.pop((2, ""), 0) == 1
    assert of == Counter([(3, "x y"), (7, "a text of its own"), (8, "a text of  its own!"), (None, "only here"), (2, "other words altogether")])
    near = texts_of(simhash.keep_first(docs))
    # Texts of fewer than three words are their own shingle; the null ids stay, one of the equal rows of 7 stays.
    assert near[(7, "a text of its own")] == 1 and near[(None, "x y")] == 1 and near[(None, "only here")] == 1 and near[(7, "xy")] == 1
    assert near[(2, None)] + near[(2, "")] == 1 and near[(2, "other words altogether")] == 1 and near[(3, "x y")] == 1


def test_near_copies_of_a_repeated_id(spark):
    base = [f"word{k}" for k in range(400)]
    one, other = " ".join(base), " ".join([*base[:200], "changed", *base[201:]])
    assert (plain_fingerprint(one) ^ plain_fingerprint(other)).bit_count() <= 3
    docs = [(5, one), (5, other), (5, other), (9, one), (9, "quite another text that nobody else has"), (4, "and one more of them here")]
    want = plain_near(list(dict.fromkeys(docs)))
    got = texts_of(simhash.keep_first(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)))
    assert sum(got.values()) == 3 == sum(want.values())
    assert got[(9, docs[4][1])] == got[(4, docs[5][1])] == 1 and got[(5, one)] + got[(5, other)] == 1


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage's rows, counted by hand, over the smallest table with rows of repeated ids, null ids and null texts added."""
    import shutil

    import corpus_pipeline

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    first = [tuple(r) for r in docs.limit(3).collect()]
    more = [(first[0][0], first[1][1], *first[0][2:]), first[2], (None, first[2][1], *first[0][2:]), (None, None, *first[0][2:]), (first[1][0], "w " + first[0][1], *first[0][2:])]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    for name in ("labels", "benchmark"):
        shutil.copy(f"{TINY}/{name}.parquet", tmp_path)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    model = quality.train(docs, labels)
    rows = list(texts_of(docs).elements())
    rows = [r for r, s in zip(rows, model.score(quality._table([t or "" for _, t in rows])), strict=True) if s >= quality.LEAST_SCORE]
    rows = list(plain_exact(rows).elements())
    rows = list(plain_near(rows).elements())
    items = [tuple(r) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").select("item_id", "text").collect()]
    rows = plain_clean(rows, items)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ByteBPE.load(str(RANKS), public_tokenizers.PATTERN).ranks, special_tokens={})
    want = Counter()
    for (i, t), n in rows.items():
        want[i, tuple(lib.encode_ordinary(t or "")), sha(t or "")] += n
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_pipeline_of_awkward_rows(spark, odd, tmp_path):
    import shutil

    import corpus_pipeline

    for name in ("labels", "benchmark"):
        shutil.copy(f"{TINY}/{name}.parquet", tmp_path)
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
