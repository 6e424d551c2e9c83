import collections
import hashlib
import random
import re

import numpy as np
import pytest

from contrail.llm import decontamination, line_dedup, lsh_forest, repetition

from .conftest import HARD, frame

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(rng, n, vocabulary=30):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# repetition


def figures(text, k=8):
    w, text = WORDS.findall(text or ""), text or ""
    count = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    hit = {j for i in range(len(w) - k + 1) if count[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_repetition_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 120), rng.choice([2, 5, 200]))
        if rng.random() < 0.5 and w:
            w += w[: rng.randrange(len(w))]
        rows.append((i, "".join(x + rng.choice([" ", "\n", " # "]) for x in w), "en", "s", 1))
    for r in repetition.measure(frame(spark, rows)).collect():
        text = rows[r.doc_id][1]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures(text)
        w = text.split()
        longest = max((n for a in range(len(w)) for b in range(a) for n in [next((x for x in range(len(w) - a) if w[a + x] != w[b + x]), len(w) - a)] if n >= 8), default=0)
        assert r.longest_repeat == longest


def test_repetition_hard_rows(hard, empty):
    rows = repetition.judge(repetition.measure(hard)).collect()
    assert len(rows) == len(HARD) and repetition.measure(empty).count() == 0
    for r in rows:
        text = next(t for i, t, *_ in HARD if i == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures(text)
        assert not (r.base_failed and r.kept)


def test_longest_repeat_decides():
    assert repetition.union_spans(np.array([0, 3, 0, 0, 0, 2, 0])) [0].tolist() == [1, 5]


def test_repetition_query(spark, smoke_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{smoke_dir}/documents.parquet").collect()}
    for r in repetition.op8_suffix_array_repetition(spark, smoke_dir).collect():
        n = figures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])


# decontamination


def contaminated(text, items, window=10):
    w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
    for item, t in items:
        x = ALNUM.findall((t or "").translate(LOWER))
        k = min(window, len(x))
        if k:
            parts = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
            at = [i for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in parts]
            hit |= {j for i in at for j in range(i, i + k)}
            found |= {str(item)} if at else set()
    return len(w), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.choice([1, 2, 3, 4, 5, 9, 10, 11, 25]), 40))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "w1 " * 30), (93, items[3][1]), (93, items[4][1])]
    rows = []
    for i in range(50):
        w = words(rng, rng.randrange(0, 80), 40)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = (rng.choice(items)[1] or "").split()
        rows.append((i, "".join(x.upper() + rng.choice([" ", ", ", "\n"]) for x in w), "en", "s", 1))
    found = decontamination.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    for r in found.collect():
        assert (r.n_words, r.n_hit, r.item_ids) == contaminated(rows[r.doc_id][1], items)


def test_decontamination_hard_rows(spark, hard, empty):
    items = spark.createDataFrame([(1, "c d e f g h i j k l m"), (None, "some words that nobody else has"), (2, None)], "item_id long, text string")
    rows = decontamination.contamination(hard, items).collect()
    assert sorted((r.doc_id or 0, r.n_hit, r.item_ids) for r in rows if r.contaminated) == [(0, 6, []), (1, 11, ["1"]), (5, 11, ["1"]), (5, 11, ["1"])]
    assert len(rows) == len(HARD)
    assert decontamination.contamination(empty, items).count() == 0
    none = decontamination.contamination(hard, items.limit(0)).collect()
    assert len(none) == len(HARD) and not any(r.contaminated for r in none)


def test_decontamination_query(spark, smoke_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{smoke_dir}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{smoke_dir}/documents.parquet").collect()}
    for r in decontamination.op5_prefix_filtered_decontamination(spark, smoke_dir).collect():
        n, hit, ids = contaminated(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(ids))
        assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()


# near duplicates


def shingles(text, k):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows, k=4, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            p, q = sets[a][1], sets[b][1]
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                root[find(a)] = find(b)
    low: dict = {}
    for a, (i, _) in enumerate(sets):
        low[find(a)] = min(low.get(find(a), i), i)
    return [(i, len(s), low[find(a)]) for a, (i, s) in enumerate(sets)]


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(25):
        base = words(rng, rng.choice([1, 3, 5, 40, 120]), 500)
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    # one large group: copies are near the original, less so one another
    base = words(rng, 150, 5000)
    for _ in range(60):
        w = list(base)
        for at in rng.sample(range(150), 3):
            w[at] = f"n{rng.random()}"
        rows.append((len(rows), " ".join(w)))
    rows.append((len(rows), " ".join(base)))
    found = lsh_forest.near_duplicates(frame(spark, [(*r, "en", "s", 1) for r in rows]))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == groups(rows)


def test_exact_pairs_against_brute_force(spark):
    rng = random.Random(11)
    base = words(rng, 200, 5000)
    rows = []
    for _ in range(60):  # a shared passage, pairs on both sides of the ratio
        w = list(base)
        for at in rng.sample(range(200), rng.randrange(1, 7)):
            w[at] = f"n{rng.random()}"
        rows.append((len(rows), " ".join(w[: rng.randrange(185, 201)])))
    sets = [shingles(t, 4) for _, t in rows]
    near = {(a, b) for a in range(60) for b in range(a + 1, 60) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert 10 < len(near) < 1500
    texts = spark.createDataFrame(rows, "node long, text string")
    for root in (lambda i: i, lambda i: 0 if i < 45 else i, lambda i: i % 3):
        nodes = spark.createDataFrame([(i, len(s), root(i)) for i, s in enumerate(sets)], "node long, n long, root long")
        found = {(min(r.a, r.b), max(r.a, r.b)) for r in lsh_forest.exact_pairs(texts, nodes).collect()}
        assert found >= {(a, b) for a, b in near if root(a) != root(b)}
        assert not any(root(a) == root(b) for a, b in found)


def test_large_regions_lose_no_link(spark, monkeypatch):
    rng = random.Random(12)
    base = words(rng, 200, 5000)
    rows = []
    for _ in range(150):  # alike at about 0.7
        w = list(base)
        for at in rng.sample(range(200), 9):
            w[at] = f"n{rng.random()}"
        rows.append((len(rows), " ".join(w)))
    for i in range(0, 150, 5):  # a partner at 0.8 to 0.9
        w = rows[i][1].split()
        for at in rng.sample(range(200), 4):
            w[at] = f"n{rng.random()}"
        rows.append((len(rows), " ".join(w)))
    # what the forest offers from large regions is left out altogether
    monkeypatch.setattr(lsh_forest, "_hubs", lambda regions, hubs: regions.selectExpr("node AS a", "node AS b").limit(0))
    monkeypatch.setattr(lsh_forest, "_neighbours", lambda regions, neighbours: regions.selectExpr("node AS a", "node AS b").limit(0))
    monkeypatch.setattr(lsh_forest, "DEPTHS", (1, 24))
    found = lsh_forest.near_duplicates(frame(spark, [(*r, "en", "s", 1) for r in rows]))
    expected = groups(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == expected
    assert len({c for *_, c in expected}) < len(rows)


def test_near_duplicates_hard_rows(hard, empty):
    rows = {(r.doc_id, r.n_shingles): r for r in lsh_forest.near_duplicates(hard).collect()}
    assert rows[(5, 20)].component_id == 1 and rows[(1, 20)].kept and not rows[(5, 20)].kept
    assert rows[(2, 0)].component_id == 2 and rows[(3, 0)].kept and rows[(4, 0)].kept
    assert [r.component_id for k, r in rows.items() if k[0] is None] == [None]
    assert lsh_forest.near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 500)], "a long, b long")
    roots = {r.node: r.root for r in lsh_forest.components(links).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, 500: 400}


def test_near_duplicates_query(spark, smoke_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{smoke_dir}/documents.parquet").collect()]
    found = lsh_forest.op6_lsh_forest(spark, smoke_dir).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(groups(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


# lines


@pytest.mark.parametrize("frequent", [1, 24, 16384])
def test_lines_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    rng = random.Random(4)
    common = [f"line {i}" for i in range(6)]
    rows = []
    for i in range(80):
        lines = [rng.choice([*common, f"own {i} {j}", "", "  "]) for j in range(rng.randrange(6))]
        rows.append((i, "\n".join(lines), "en", f"s{rng.randrange(14)}", 1))
    docs = frame(spark, rows)
    sites = collections.defaultdict(set)
    for _, t, _, s, _ in rows:
        for x in t.split("\n"):
            sites[x.strip()].add(s)
    seen, expected = set(), {}
    for i, t, *_ in rows:
        left, gone = [], 0
        for x in t.split("\n"):
            key = x.strip()
            if key and len(sites[key]) >= 10 and key in seen:
                gone += 1
            else:
                left.append(x)
            seen.add(key)
        expected[i] = ("\n".join(left), gone)
    found = line_dedup.drop_boilerplate(docs).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in found} == expected
    assert {r.doc_id: r.n_lines for r in found} == {i: sum(bool(x.strip()) for x in t.split("\n")) for i, t, *_ in rows}


def test_lines_hard_rows(hard, empty):
    out = line_dedup.drop_boilerplate(hard)
    assert [c for c in out.columns if c not in ("n_lines", "n_removed")] == [c for c in hard.columns if c != "n_removed"]
    assert sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text is not None) == sorted((i or 0, t) for i, t, *_ in HARD if t is not None)
    assert line_dedup.drop_boilerplate(empty).count() == 0
