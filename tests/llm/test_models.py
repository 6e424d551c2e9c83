import random

import numpy as np

from contrail.llm import html_crf, langid, quality, revisits
from contrail.llm.html_crf import MAIN, leaf_blocks

from .conftest import HARD, frame


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def corpus(spark, n=1200):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(prose(rng, "aeioustnrl", 12) for _ in range(5))
        docs.append((i, text if good else " ".join(w + rng.choice("#$%") * 3 for w in text.split()), "en", "s", 1))
        if rng.random() < 0.5:
            labels.append((i, int(good), 0))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark, hard, empty):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels)
    rows = docs.select("doc_id", quality.score_column(model, docs["text"]).alias("s"), "text").collect()
    right = [(r.s >= quality.THRESHOLD) == ("###" not in r.text and "$$$" not in r.text) for r in rows]
    assert np.mean(right) > 0.95, np.mean(right)
    scores = [r.s for r in hard.select(quality.score_column(model, hard["text"]).alias("s")).collect()]
    assert len(scores) == len(HARD) and all(0 <= s <= 1 for s in scores)
    assert quality.keep_good(hard, model).columns == hard.columns
    blank = quality.fit(empty, labels.limit(0))
    assert blank.prior == 0.5 and quality.keep_good(empty, blank).count() == 0
    assert all(abs(r.s - 0.5) < 1e-9 for r in hard.select(quality.score_column(blank, hard["text"]).alias("s")).collect())


def test_risk_of_negatives_stays_above_zero():
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 1, (200, 3)), np.vstack([rng.normal(1, 1, (140, 3)), rng.normal(-1, 1, (60, 3))])
    w = quality.nonnegative_pu(p, u, 0.7)
    test = np.vstack([rng.normal(1, 1, (700, 3)), rng.normal(-1, 1, (300, 3))]) @ w[:-1] + w[-1]
    assert ((test > 0) == (np.arange(1000) < 700)).mean() > 0.9


def test_risk_and_gradient_recomputed():
    rng = np.random.default_rng(4)
    p, u, prior = rng.normal(0.5, 1, (40, 3)), rng.normal(0, 1, (50, 3)), 0.9
    seen = []
    keep, quality.adam = quality.adam, lambda gradient, start, steps, rate: seen.append(gradient) or start
    try:
        quality.nonnegative_pu(p, u, prior)
    finally:
        quality.adam = keep

    def parts(w):
        loss = lambda f: sum(np.log1p(np.exp(-v)) for v in f) / len(f)
        fp, fu = [x @ w[:-1] + w[-1] for x in p], [x @ w[:-1] + w[-1] for x in u]
        return prior * loss(fp), loss([-v for v in fu]) - prior * loss([-v for v in fp]), quality.DECAY / 2 * (w[:-1] @ w[:-1])

    signs = set()
    for w in rng.normal(0, 2, (40, 4)):
        positive = parts(w)[1] >= 0
        signs.add(positive)
        value = (lambda v: sum(parts(v))) if positive else (lambda v: parts(v)[2] - parts(v)[1])
        for i in range(4):
            step = np.eye(4)[i] * 1e-5
            assert abs(seen[0](w)[i] - (value(w + step) - value(w - step)) / 2e-5) < 1e-6
    assert signs == {True, False}


def test_prior_is_estimated_without_negatives():
    rng = np.random.default_rng(5)
    for share in (0.25, 0.5, 0.8):
        n = int(share * 2000)
        p, u = rng.normal(1.5, 1, (1500, 4)), np.vstack([rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (2000 - n, 4))])
        assert abs(quality.class_prior(p, rng.permutation(u)) - share) < 0.06
    assert quality.class_prior(p, p) > 0.85


def test_models_do_not_depend_on_the_partitions(spark):
    rng = random.Random(9)
    rows = [(i % 60, prose(rng, "aeioustnrl", 30) + (" ### $$$" * 9 if i % 60 < 25 else ""), "ende"[i % 2 * 2 :][:2], "s", 1) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i >= 25), 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    one, other = frame(spark, rows).coalesce(1), frame(spark, rows[::-1]).repartition(7, "text")
    a, b = quality.fit(one, labels), quality.fit(other, labels)
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior and a.slope == b.slope
    a, b = langid.fit(one), langid.fit(other)
    assert np.array_equal(a.weights, b.weights)


def test_quality_query_does_not_read_the_held_out_labels(spark, smoke_dir):
    from contrail.llm.textkit import documents, fold

    docs, labels = documents(spark, smoke_dir), documents(spark, smoke_dir, "labels")
    other = labels.withColumn("quality", ((fold(labels["doc_id"]) == 2).cast("int") + labels["quality"]) % 2)
    a, b = quality.fit(docs, labels), quality.fit(docs, other)
    assert np.array_equal(a.weights, b.weights) and a.slope == b.slope
    rows = quality.op9_pu_quality(spark, smoke_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_language_held_out(spark, hard, empty):
    rng = random.Random(2)
    kinds = {"en": "ethaoins", "de": "enrschiß", "fr": "éèaueoils", "es": "aeonsñóí", "xx": "zqkvwxyj"}
    docs = frame(spark, [(i, prose(rng, kinds[v], 30), v, "s", 1) for i, v in enumerate(list(kinds) * 60)])
    model = langid.fit(docs)
    assert [len(f) for f in model.families] == [2, 2, 1] and len(model.pairs) == 2
    rows = docs.select("lang", langid.language_column(model, docs["text"]).alias("f")).collect()
    assert np.mean([r.lang == r.f.lang for r in rows]) > 0.97 and all(0 <= r.f.score <= 1 for r in rows)
    found = {r.doc_id: r.f for r in hard.select("doc_id", langid.language_column(model, hard["text"]).alias("f")).collect()}
    for i in (2, 3, 4, 6):
        assert (found[i].lang, found[i].score) == ("und", 0.0)
    assert found[9].lang in kinds
    nothing = langid.fit(empty)
    assert {r.f.lang for r in hard.select(langid.language_column(nothing, hard["text"]).alias("f")).collect()} == {"und"}


def test_language_query(spark, smoke_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{smoke_dir}/documents.parquet").collect()}
    rows = langid.op3_hierarchical_language(spark, smoke_dir).collect()
    assert len(rows) == len(truth)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.9


# pages


def test_blocks():
    page = '<html><head><title>T</title></head><body><p>a&amp;b<p><b>c<br>d</b><ul><li>e<li>f &lt;</ul><script>x<p></script><!-- <p>no --><div>g<h2> h </h2>i'
    assert [b.text for b in leaf_blocks(page)] == ["a&b", "c d", "e", "f <", "g", "h", "i"]
    assert leaf_blocks("") == [] and leaf_blocks("<p><") != [] and leaf_blocks("<<>>a</p></p>") != []


def test_head_without_end_tag():
    for start in ("<body><p>", "<p>", "<main><p>"):
        page = f"<html><head><title>t</title><meta charset=utf-8>{start}One.</p><div>Two.</div></html>"
        assert [b.text for b in html_crf.leaf_blocks(page)] == ["One.", "Two."]
    assert [b.text for b in html_crf.leaf_blocks("<head><noscript><p>no</p></noscript><svg><p>no</p></svg></head><p>One.")] == ["One."]


def test_paths_of_blocks():
    page = '<main id=mainPart><p class="a b">One <b>two</b></p><div class=a><span>three<span class="c">four</main><p>five'
    found = [(b.text, html_crf.path_features(b.path)) for b in leaf_blocks(page)]
    assert found == [
        ("One two", ["in=main", "in=p", "name=a", "name=b", "name=main", "name=part", "leaf=p", "above=main"]),
        ("threefour", ["in=div", "in=main", "in=span", "name=a", "name=c", "name=main", "name=part", "leaf=div", "above=main"]),
        ("five", ["in=p", "leaf=p", "above="]),
    ]


def test_markup_that_does_not_end_is_text():
    cases = {"a<b c": ["a<b c"], "if a<b then <p>x": ["if ax"], '<p title="x>y': ['<p title="x>y'], "<p title='a>b'>c": ["c"], "x<!-- y <p>z": ["x"], "<!x y": ["<!x y"],
             "a<": ["a<"], "<": ["<"], "</": ["</"], '<a "<b \'>x': ['<a "<b \'>x'], '<a "<b>"<i>x': ["x"]}
    for page, texts in cases.items():
        assert [b.text for b in leaf_blocks(page)] == texts, page


def test_long_broken_pages_take_linear_time():
    import time

    model = html_crf.train(html_crf.labelled_pages(["Some words of a block, and more."], 20), steps=5)
    pages = {"if a<b then ": 1, '<a "': 1, '<a "<b \'': 1, "<div>x": None, "<b><h1>x</i>": None, "<a": 1, "<!": 1, "<b class=q>x": 1, "<svg></p>": 0}
    for bit, blocks in pages.items():
        page = bit * (250_000 // len(bit))
        for p in (page, page + ">", page + '">'):
            begin = time.process_time()
            found = leaf_blocks(p)
            html_crf.decode(model, found)
            # squares of this length take minutes
            assert time.process_time() - begin < 15, bit
        if blocks is not None:
            assert len(leaf_blocks(page)) == blocks, bit
    assert [b.text for b in leaf_blocks("<p>&#" + "1" * 6000 + ";x&#" + "0" * 6000 + "65;")] == ["\ufffdxA"]


def test_digits_of_the_whole_block_count():
    block = html_crf.Block("x" * 300 + "7" * 700, ())
    assert "digits=3" in html_crf.text_features(block, 0, 1)


def test_viterbi_against_all_labellings():
    from itertools import product

    texts = [f"Some words of block {i}, and more." for i in range(20)]
    pages = html_crf.labelled_pages(texts, 80)
    model = html_crf.train(pages, steps=30)
    for blocks, _ in [p for p in pages if 0 < len(p[0]) <= 9][:15]:
        def total(y):
            s = model.start[y[0]] + sum(model.step[a][b] for a, b in zip(y, y[1:], strict=False))
            return s + sum(model.weights.get(f, (0, 0))[v] for i, (b, v) in enumerate(zip(blocks, y, strict=True)) for f in html_crf.path_features(b.path) + html_crf.text_features(b, i, len(blocks)))
        assert abs(total(html_crf.decode(model, blocks)) - max(map(total, product((0, 1), repeat=len(blocks))))) < 1e-9


def test_main_text_held_out_layouts(spark):
    rng = random.Random(3)
    texts = [prose(rng, "aeioustnrl", rng.randrange(5, 40)) for _ in range(300)]
    model = html_crf.train(html_crf.labelled_pages(texts, 300))
    right = [x == y for b, labels in html_crf.labelled_pages(texts, 100, seed=77) for x, y in zip(html_crf.decode(model, b), labels, strict=True)]
    assert np.mean(right) > 0.98
    page = ("<body><nav><a href=x>Home</a></nav><div class='cookie-banner'><p>We use cookies, as all do.</p></div><article><h1>News of the day</h1>"
            "<p>A first &amp; long  sentence,\n of many words.</p><p>Then the second one.</p></article><section class='comments'><p>What a fine article, I read it all.</p></section><footer>&copy; x</footer>")  # fmt: skip
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (None, "u", "<p>")], "page_id long, url string, html string")
    found = {r.page_id: r.t for r in pages.select("page_id", html_crf.main_text(model, pages["html"]).alias("t")).collect()}
    assert found == {1: "News of the day\nA first & long sentence, of many words.\nThen the second one.", 2: "", 3: "", None: ""}


def test_main_text_of_odd_tables(spark):
    model = html_crf.train(html_crf.labelled_pages(["A sentence of some words, as there are.", "Another, also of words."], 60), steps=40)
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = "<article>" + "<p>A sentence of words, and more of them.</p>" * 40_000 + "</article>"
    rows = [(1, "u", page, "other", "x"), (1, "u", page, "other", "x"), (None, None, "<article>" + "<p>A sentence of words, and more of them.</p>" * 3 + "</article>", None, None)]
    extract = lambda df: df.withColumn("main", html_crf.main_text(model, df["html"]))
    assert extract(spark.createDataFrame([], schema)).collect() == []
    found = extract(spark.createDataFrame(rows, schema)).collect()
    assert [len(r.main) for r in found if r.page_id == 1] == [39 * 40_000 - 1] * 2  # 38 characters and a line feed each
    assert [(r.main, r.text) for r in found if r.page_id is None] == [("\n".join(["A sentence of words, and more of them."] * 3), None)]


def test_page_query(spark, smoke_dir):
    import html
    import re

    truth = {r.page_id: r.html for r in spark.read.parquet(f"{smoke_dir}/pages.parquet").collect()}
    for r in html_crf.op7_crf_main_text(spark, smoke_dir).collect():
        body = re.search(r"<article>(.*)</article>", truth[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", x)).replace("<b>", "").split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


# revisits


def test_canonical_urls(spark):
    urls = ["http://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#f", "https://example.com/a?a=1&b=2&ref=q", "//m.example.com/a?a=1&b=2"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0] for r in df.select(revisits.canonical(df["url"])).collect()} == {"example.com/a?a=1&b=2"}


def test_revisits_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):  # one URL holds most records
        url = "http://hot.org/" if rng.random() < 0.7 else f"http://h.org/{rng.randrange(9)}"
        full = rng.random() < 0.3
        tag = rng.choice([None, '"a"', 'W/"a"', '"b"'])
        rows.append((i, url, rng.randrange(60), "response" if full else "revisit", tag, rng.choice([None, "m1", "m2"]), {"date": str(i), "etag": tag or "-", "content-length": str(i)} if rng.random() < 0.9 else None))
    rows += [(None, "u", 1, "revisit", None, None, None), (900, None, 1, "revisit", None, None, None), (901, "u", None, "revisit", None, None, None), (902, "u", 5, "revisit", None, None, None), (902, "u", 5, "revisit", None, None, None)]
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>"
    found = sorted((r.record_id, r.response_id, r.status, tuple(sorted(r.headers.items())) if r.headers is not None else None) for r in revisits.resolve(spark.createDataFrame(rows, schema)).collect())
    expected = []
    for i, url, ts, kind, tag, mod, headers in rows:
        if kind != "revisit" or None in (i, url, ts):
            continue
        earlier = [r for r in rows if r[3] == "response" and r[1] == url and r[2] < ts]
        r = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        if r is None:
            status = "no_response"
        elif tag and r[4]:
            status = "resolved" if tag.removeprefix("W/") == r[4].removeprefix("W/") else "mismatch"
        elif mod and r[5]:
            status = "resolved" if mod == r[5] else "mismatch"
        else:
            status = "unverified"
        merged = (r[6] or {}) | {k: v for k, v in (headers or {}).items() if k in revisits.PERMITTED} if status == "resolved" else None
        expected.append((i, r and r[0], status, tuple(sorted(merged.items())) if merged is not None else None))
    assert found == sorted(expected)
    assert revisits.resolve(spark.createDataFrame([], schema)).count() == 0
