"""Ranked search, spelling variants and personal data against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import HARD, frame

from contrail.llm import pii, ranked_search, spelling

# --- 11 ----------------------------------------------------------------------


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute_search(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(c.values()) for _, c in counted]
    n_docs, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        own, scores = set(terms(text)), []
        for (doc, c), n in zip(counted, lengths, strict=True):
            if n:
                m = 100 - 90 + (90 * n * n_docs) // total
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own & c.keys())
                if score:
                    scores.append((-score, math.inf if doc is None else doc, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2])[:top])]
    return Counter(out)


@pytest.fixture
def many():
    """Documents of one term to thousands, with equal and repeated ones."""
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choices(vocab, [1 / (j + 1) for j in range(400)], k=r.choice([1, 3, 20, 200, 3000])))) for i in range(300)]
    return rows + [(i, rows[7][1]) for i in range(300, 330)] + [rows[7]] * 3


def searched(spark, docs, items):
    d, i = (spark.createDataFrame(x, f"{n} long, text string, term string, score int") for x, n in (([(*r, "x", 1) for r in docs], "doc_id"), ([(*r, "x", 1) for r in items], "item_id")))
    return Counter(tuple(r) for r in ranked_search.search(d.repartition(3), i).select("item_id", "rank", "doc_id", "score").collect())


def test_search_equals_brute_force(spark, many):
    hard = [(r[0], r[1]) for r in HARD]
    items = [(0, "W1 w2, w399!"), (1, many[7][1]), (2, "nothing here"), (3, None), (4, ""), (None, "w5 w5 w6"), (5, "ein satz A B"), (5, "w300"), (6, "日本語 ünïcödé x" + "x" * 4999)]
    assert searched(spark, many + hard, items) == brute_search(many + hard, items)


def test_search_in_several_blocks_of_items(spark, many, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEMS", 3)
    monkeypatch.setattr(ranked_search, "TERMS_AT_ONCE", 2)
    monkeypatch.setattr(ranked_search, "TRIED", 10)
    items = [(i, f"w{i} w{i * 7 % 400} w{i * i % 400}") for i in range(20)]
    assert searched(spark, many, items) == brute_search(many, items)


def test_search_without_rows(spark, empty, many):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(empty, items).count() == 0
    assert ranked_search.search(frame(spark, HARD[:1]), items.limit(0)).count() == 0
    assert searched(spark, many, [(1, "no such term"), (2, None)]) == Counter()


def test_bounds_are_never_below_scores(many):
    """With signatures so small that nearly every bit is set, too."""
    texts = [t.encode() for _, t in many]
    block = ranked_search.ItemBlock([{"q": 0, "terms": [{"term": b"w%d" % i, "w": 1000 + i} for i in range(0, 400, 7)]}], 300, 100_000)
    owner, code, times, counts, words = ranked_search.term_counts(texts)
    marks = ranked_search.hashes(words)
    for bits in (50, 4096):
        sheet = np.zeros((bits, -(-len(texts) // 8)), np.uint8)
        for o, c, n in zip(owner, code, times, strict=True):
            for level in range(int((ranked_search.LEVELS <= n).sum())):
                places = ranked_search.bit_places(ranked_search.key_hashes(marks[c : c + 1], level), bits)[0]
                sheet[places, o // 8] |= np.uint8(128 >> o % 8)
        bounds = block.bounds(counts, bits, sheet)[0]
        scores = np.array([s[0] for s in block.scores(texts, [[0]] * len(texts))])
        assert (bounds >= scores).all()
        assert bits == 50 or (bounds < 2 * scores + 2_000_000).mean() > 0.5


# --- 12 ----------------------------------------------------------------------


def brute_spelling(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            at = h % len(low)
            counts[low[:at] + low[at + 1 :] if h % 97 == 0 else low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
        out[w] = (n, len(others))
    rows = set()
    for w, (n, n_near) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, n_near, words[form[w]] if form[w] else None))
    return rows


def spelled(spark, docs):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, word string, n int")
    return [tuple(r) for r in spelling.spelling_variants(d.repartition(3)).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_spelling_equals_brute_force(spark):
    r = random.Random(3)
    base = ["".join(r.choices("aeinrstÉéßÿ", k=r.randint(4, 9))) for _ in range(60)]

    def typo(w):
        i, c = r.randrange(len(w)), r.choice("aeinrsté")
        return r.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])

    docs = [(i, " ".join(typo(w) for w in r.choices(base, [1 / (j + 1) for j in range(60)], k=150)) + "×÷ 日本aaaaaa_bbbbbb") for i in range(60)]
    docs += [(i[0], i[1]) for i in HARD] + [docs[0]] * 3 + [(None, "annas annas annas anna's x" + "y" * 3000)] * 3
    docs += [(1000, "kettle " * 3 + "kettles " * 8 + "kettless " * 20)]  # a chain of forms
    found = spelled(spark, docs)
    assert len(found) == len(set(found)) and set(found) == brute_spelling(docs)
    assert any(f for _, f, *_ in found) and any(f and rt != f for _, f, rt, *_ in found)


def test_spelling_broadcasts_no_signatures(spark, tmp_path):
    """A small file of words has many signatures, which are not to be built in the driver."""
    spark.createDataFrame([("abcde", 9), ("abcdf", 2), ("vwxyz", 4)], "word string, n long").write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    near = spelling.near_words(words)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert sorted(tuple(r) for r in near.collect()) == [("abcde", 1, "abcdf", 2), ("abcdf", 1, "abcde", 9)]


def test_spelling_without_rows(spark, empty):
    assert spelling.spelling_variants(empty).count() == 0
    assert spelled(spark, [(1, None), (2, ""), (3, "abc abc abc 12345")]) == []


@pytest.mark.parametrize(("equal", "longer"), [((1, 3), (1, 2)), ((1, 4), (1, 3)), ((2, 2), (2, 1)), ((3, 1), (1, 2))])
def test_partenum_signatures_are_exact(equal, longer):
    """Words one edit apart always share a key, whatever the partition."""
    r = random.Random(1)
    for _ in range(300):
        w = "".join(r.choices("abcdeé", k=r.randint(5, 12)))
        i, c = r.randrange(len(w)), r.choice("abcdeéz")
        for other in (w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]):
            if other != w:
                (_, same), (_, short), (_, long) = spelling.keys_of([w, other], equal, longer)
                meet = same if len(other) == len(w) else np.stack([short[0], long[1]] if len(w) < len(other) else [long[0], short[1]])
                assert set(meet[0].tolist()) & set(meet[1].tolist())


def test_joined_crcs():
    prefixes, words = [b"1:", b":", b"123456789:"], [b"a", b"word", b"x" * 5000, "é".encode()]
    p, w = np.divmod(np.arange(12), 4)
    assert spelling.pair_crcs(prefixes, words, p, w).tolist() == [zlib.crc32(prefixes[a] + words[b]) for a, b in zip(p, w, strict=True)]


# --- 13 ----------------------------------------------------------------------

PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and luhn(re.sub(r"\D", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def brute_base(text):
    return [(k, m.start(), m.end()) for k, (p, fine) in PATTERNS.items() for m in re.finditer(p, text or "") if fine(m.group())]


PEOPLE = [
    "mail a.b@c.de, x@y, @z.de a@@b.c a@b.c@d.e --@-.- user%+@mail.example.com.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 9.9.9.9.9 1..2.3.4 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 79927398713 5500000000000004 12345678901234567890 4 1 1 1",
    "+1 (234) 555-7713, +49.30.1234567 +1 +12 +123456789012345678 call +44 20 7946 0958.", "１２３ ٣٤٥ é@é.de 日本@例.jp +１２３",
    "write to jane (at) example (dot) org or bob at mail dot example dot com", "tel 030/1234567-89 or (017) 555-7713 20 or 0049 30 1234567",
    "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 at 12:34:56 and 00:1b:63:84:45:e6 fe80::1", "card 4222-2222-2222-2225",
]


def test_base_spans_equal_the_patterns():
    r = random.Random(2)
    texts = PEOPLE + ["".join(r.choices("0123456789.@+- ()ab%:", k=r.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(r.choices("0123.", k=40)) for _ in range(1000)] + ["".join(r.choices("ab.@", k=40)) for _ in range(1000)]
    for text in texts:
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute_base(text), text
        for k, a, b, own in pii.candidates(text, pii.base_spans(text)):
            assert own or all(b <= x or y <= a for _, x, y in pii.base_spans(text))
            assert len(pii.votes_of(text, k, a, b)) == len(pii.LABELERS) and pii.features_of(text, a, b).shape == (pii.FEATURES,)


def test_scanning_is_linear():
    began = time.time()
    for text in ("1" * 400_000, "1." * 200_000, "a" * 400_000, "a@" * 100_000, "+1 " * 100_000, "+1" + "(" * 400_000, "1 " * 200_000, "a at b dot " * 30_000, ":" * 400_000, "1:" * 200_000, "(at)" * 70_000, "1@1.1 " * 30_000):
        pii.inspect(text)
    assert time.time() - began < 60


def test_personal_data_of_documents(spark, empty):
    rows = [(i, t) for i, t in enumerate(PEOPLE)] + [(r[0], r[1]) for r in HARD] + [(100 + i, f"text {i} mail u{i}@mail.example.com card 4222-2222-2222-2225 and +1 (234) 555-{1000 + i}") for i in range(60)]
    rows += [(300 + i, f"write to jane{i} (at) mail (dot) org today") for i in range(20)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, found int").repartition(3)
    out = [r.asDict() for r in pii.personal_data(d).collect()]
    key = lambda x: (-1 if x[0] is None else x[0], *map(str, x[1:]))
    expected = []
    for i, text in rows:
        base = brute_base(text)
        n = Counter(k for k, _, _ in base)
        expected.append((i, *(n[k] for k in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    assert sorted(((r["doc_id"], *(r[f"n_{k}"] for k in pii.KINDS), r["base_sha256"]) for r in out), key=key) == sorted(expected, key=key)
    texts = dict(rows)
    for r in out:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= set(brute_base(texts[r["doc_id"]]))
        assert [(pii.KINDS.index(k), int(a)) for k, a, _ in spans] == sorted((pii.KINDS.index(k), int(a)) for k, a, _ in spans)
    # addresses that the fixed rules miss are found
    added = {r["doc_id"]: r["spans"] for r in out if (r["doc_id"] or 0) >= 300}
    assert all(s.startswith("email:9:") for s in added.values())
    assert pii.personal_data(empty).count() == 0


def test_estimated_reliabilities():
    """Labelers of known reliability: the estimates and the truths come back."""
    r = np.random.default_rng(4)
    truth = r.random(30_000) < 0.3
    right = np.array([0.9, 0.8, 0.95, 0.7, 0.6, 0.85, 0.75])
    says = np.where(r.random((30_000, 7)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    says[r.random(says.shape) < 0.2] = 0
    patterns, which, counts = np.unique(says, axis=0, return_inverse=True, return_counts=True)
    table, share = pii.reliabilities(patterns, counts.astype(float))
    assert abs(share - 0.3) < 0.02
    assert np.abs(table[1, :, 2] - 0.8 * right).max() < 0.03 and np.abs(table[0, :, 0] - 0.8 * right).max() < 0.03
    right_of = lambda t, s: ((pii.posterior(patterns, t, s)[which.ravel()] > 0.5) == truth).mean()
    yes = 0.8 * right
    known = np.array([np.stack([yes, np.full(7, 0.2), 0.8 - yes], 1), np.stack([0.8 - yes, np.full(7, 0.2), yes], 1)])
    assert right_of(table, share) > right_of(known, 0.3) - 0.002  # as good as with the true figures
    # the same from every row for itself
    again, _ = pii.reliabilities(says[:3000], np.ones(3000))
    few, n = np.unique(says[:3000], axis=0, return_counts=True)
    assert np.allclose(again, pii.reliabilities(few, n.astype(float))[0], atol=1e-6)


def test_overlapping_additions():
    model = {k: {"weights": np.eye(pii.FEATURES)[-1] * 5} for k in range(4)}
    one = np.eye(pii.FEATURES)[-1].astype(np.float16).tobytes()
    row = lambda k, a, b, base=False: {"kind": k, "start": a, "stop": b, "base": base, "features": one}
    assert pii.kept_spans([row(3, 0, 9), row(2, 5, 20), row(3, 20, 25), row(0, 30, 40, True)], model) == [(0, 30, 40), (3, 0, 9), (3, 20, 25)]
    assert pii.kept_spans([row(3, 0, 9)], {}) == []
