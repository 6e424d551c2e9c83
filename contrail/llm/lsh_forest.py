"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Every text becomes its set of distinct word shingles (64-bit hashes), a digest
   of that set and a MinHash signature.  Texts of one digest are one *node* (a
   partial aggregate, so a group of any number of copies is one row per task).
2. Every node stands in TREES trees over its signature, each beginning at
   another value; their regions are hash buckets of fixed prefixes.  Nodes with a common prefix of the first of DEPTHS are a *region*;
   one of more than REGION nodes is looked at by the next depth, and so on, so
   the depth adapts to how dense a region is.  Candidates are the nodes of a
   small region among themselves; in one that is still large at the last depth
   the next NEIGHBOURS in the order of a hash of the node, which is arbitrary.
   In every large region each node also meets its HUBS, the nodes that most
   orders put into large regions: the original that many copies derive from is
   nearer to all of them than they are to each other.  These pairs grow in
   proportion to the nodes and link most of a large group, but not all of it.
3. A pair whose signatures agree in less than MIN_AGREE (four standard errors
   below 0.8) is dropped, the others are confirmed on the full sets, in rounds:
   first each node's best candidate, then whatever the links found so far do not
   connect already.  A pair inside a component cannot change it.
4. Components by alternating large-star and small-star steps over links.
5. Nodes of large regions (*dense* ones) then meet exactly: two sets that reach
   the ratio share one of their rarest shingles, at places that leave room for
   the rest.  Postings of these shingles are joined, dealt out in runs, where the
   components differ; what passes the bounds is confirmed without the signatures.

Nothing is collected; every step is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import SPACED_LOWER, arrow_batch, batch_fields, documents, hashes, run_hashes, slices, stored, text_bytes, words_of

SHINGLE = 4
MIN_PERCENT = 80
TREES, VALUES = 20, 120
#: How many values the nodes of a region share, from the first look to the deepest.
DEPTHS = (3, 6, 9, 12, 18, 24)
REGION = 16
NEIGHBOURS = 4
HUBS = 2
MIN_AGREE = 0.65
#: A region that stays large is dealt out in runs of about this many nodes.
RUN = 4096

SKETCH = batch_fields(("doc_id", T.LongType()), ("text_hash", T.LongType()), ("n_shingles", T.LongType()), ("digest", T.BinaryType()), ("signature", T.BinaryType()))

SHINGLES = batch_fields(("node", T.LongType()), ("shingle", T.LongType()))


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than k are one shingle."""
    codes, counts, words = words_of(texts, SPACED_LOWER)
    value = hashes(words)
    at = 0
    for n in counts.tolist():
        own = value[codes[at : at + n]]
        at += n
        yield np.unique(run_hashes(own, min(k, n))) if n else np.empty(0, np.uint64)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(1, 1 << 63, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(shingles: np.ndarray, n: int, rows: int = 4096) -> np.ndarray:
    """n minima of seeded multiply-shift hashes, 32 bits each; works on blocks of shingles."""
    a, b = _seeds(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), rows):
        np.minimum(low, (shingles[i : i + rows, None] * a + b).min(0), out=low)
    return (low >> np.uint64(32)).astype(">u4")


def sketch(docs: DataFrame, k: int = SHINGLE, n: int = VALUES) -> DataFrame:
    """Set size, digest of the set and signature of every text (nulls for an empty set)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                sizes, digests, signatures = [], [], []
                for s in shingle_sets(texts, k):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signatures.append(signature(s, n).tobytes() if len(s) else None)
                yield arrow_batch(schema, batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), sizes, digests, signatures)

    return _texts(docs).mapInArrow(run, SKETCH)


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def forest_pairs(nodes: DataFrame, trees: int = TREES, region: int = REGION, neighbours: int = NEIGHBOURS,
                 hubs: int = HUBS) -> tuple[DataFrame, DataFrame | None]:
    """Candidate pairs (a < b) of ``nodes`` (node, signature), and the dense nodes (None
    if no region is large), whose pairs in large regions are not all among them."""
    begin = VALUES // trees
    # the order goes on at the front of the signature where it ends
    signed = nodes.select("node", F.expr(f"concat(signature, substring(signature, 1, {4 * DEPTHS[-1]}))").alias("s"))
    keyed = signed.select("node", F.explode(F.array(*[
        F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.expr(f"substring(s, {4 * begin * t + 1}, {4 * DEPTHS[0]})")).alias("region"))
        for t in range(trees)
    ])).alias("x")).select("node", "x.tree", "x.region")
    found, dense = [], None
    for i, depth in enumerate(DEPTHS):
        # a region has one row per task before the exchange; regions of one node end here
        size = keyed.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
        sized = stored(keyed.join(size, "region"), f"forest-{depth}")
        pairs = _small(sized.where(F.col("size") <= region))
        large = sized.where(F.col("size") > region)
        ended = large.isEmpty()
        if not ended:
            if i == 0:  # nodes of large regions take along their signature and in how many of these they stand
                weight = large.groupBy("node").agg(F.count("*").alias("weight"))
                large = stored(large.join(weight.join(signed, "node"), "node"), "dense")
                dense = large.select("node").distinct()
            pairs = pairs.unionByName(_hubs(large, hubs))
            if depth == DEPTHS[-1]:
                pairs = pairs.unionByName(_neighbours(large, neighbours))
        found.append(stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"pairs-{depth}"))
        if ended or depth == DEPTHS[-1]:
            break
        prefix = F.expr(f"substring(s, {4 * begin} * tree + 1, {4 * DEPTHS[i + 1]})")
        keyed = large.select("node", "tree", "weight", "s", F.xxhash64("tree", prefix).alias("region"))
    out = found[0]
    for pairs in found[1:]:
        out = out.unionByName(pairs)
    return out.distinct(), dense


def _small(regions: DataFrame) -> DataFrame:
    """All pairs of each region; a region has at most REGION nodes here."""
    members = regions.groupBy("region").agg(F.sort_array(F.collect_list("node")).alias("m"))
    pairs = "flatten(transform(sequence(1, size(m) - 1), i -> transform(slice(m, i + 1, size(m) - i), y -> struct(m[i - 1] AS a, y AS b))))"
    return members.where("size(m) > 1").select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b")


def _hubs(regions: DataFrame, hubs: int) -> DataFrame:
    """Each node of a region with the few of the largest weight."""
    order = Window.partitionBy("region").orderBy(F.desc("weight"), "node")  # a top-n per region, taken before the exchange too
    front = regions.select("region", "node", "weight").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= hubs)
    front = front.groupBy("region").agg(F.sort_array(F.collect_list("node")).alias("hubs"))
    # many regions have the same hubs: a node meets them once
    met = regions.select("region", "node").join(front, "region").select("node", "hubs").distinct()
    return met.select(F.col("node").alias("a"), F.explode("hubs").alias("b")).where("a <> b")


def _neighbours(regions: DataFrame, neighbours: int) -> DataFrame:
    """Each node with the next few of its region in the order of a hash of the nodes.

    A region is dealt out in runs of about RUN nodes by ranges of a hash; a run
    also sees the first nodes of the next one, so no neighbour is lost between.
    """
    runs, spot = F.ceil(F.col("size") / RUN), F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    dealt = regions.select("region", "node", spot.alias("spot"), F.floor(spot * runs / (1 << 30)).alias("run"))
    order = Window.partitionBy("region", "run").orderBy("spot", "node")
    ahead = dealt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).drop("rank")
    both = dealt.withColumn("own", F.lit(True)).unionByName(ahead.withColumn("run", F.col("run") - 1).withColumn("own", F.lit(False)))
    near = both.withColumn("next", F.array(*[F.lead("node", i).over(order) for i in range(1, neighbours + 1)])).where("own")
    return near.select(F.col("node").alias("a"), F.explode("next").alias("b")).where("b IS NOT NULL")


def with_agreement(pairs: DataFrame, nodes: DataFrame, least: float = MIN_AGREE, percent: int = MIN_PERCENT) -> DataFrame:
    """``pairs`` with the share of equal signature values, without those below ``least``."""

    @F.arrow_udf(T.FloatType())
    def agree(one: pa.Array, two: pa.Array) -> pa.Array:
        out = [np.mean(np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4")) for x, y in zip(one.to_pylist(), two.to_pylist(), strict=True)]
        return pa.array(out, pa.float32())

    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    # sets of very different size cannot reach the ratio
    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    found = pairs.join(left, "a").join(right, "b").where(close)
    return found.select("a", "b", agree("sa", "sb").alias("share")).where(F.col("share") >= least)


def confirm(pairs: DataFrame, texts: DataFrame, k: int = SHINGLE, percent: int = MIN_PERCENT) -> DataFrame:
    """Those of ``pairs`` whose full sets reach ``percent``; ``texts`` has node and text.

    Texts travel instead of their sets, which are larger and do not compress.
    """

    @F.arrow_udf(T.BooleanType())
    def linked(one: pa.Array, two: pa.Array) -> pa.Array:
        out = []
        for a, b, texts in slices(one):
            for p, q in zip(shingle_sets(texts, k), shingle_sets(text_bytes(two.slice(a, b - a)), k), strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(linked("ta", "tb")).select("a", "b")


def shingle_rows(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(node, shingle) of every distinct shingle of ``texts`` (node, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SHINGLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                sets = list(shingle_sets(texts, k))
                node = np.repeat(batch.column(0).slice(a, b - a).to_numpy(), [len(s) for s in sets])
                yield arrow_batch(schema, node, np.concatenate(sets).view(np.int64))

    return texts.select("node", "text").mapInArrow(run, SHINGLES)


def exact_pairs(texts: DataFrame, nodes: DataFrame, k: int = SHINGLE, percent: int = MIN_PERCENT) -> DataFrame:
    """Pairs (a, b, ra, rb) of ``nodes`` (node, n, root) of different roots, without losing
    any whose sets reach ``percent``; ``texts`` has node and text.

    In one order of all shingles, the rarest first, the first common shingle of
    such a pair leaves both sets as many places as they have to share.  So a set
    of n has postings of its first n - ceil(n * percent / 100) + 1 shingles only.
    A shingle's postings outside its most frequent root are dealt out in runs of
    about RUN, and each run meets all its postings.
    """
    rows = stored(shingle_rows(texts, k), "dense-shingles")
    spread = rows.groupBy("shingle").agg(F.count("*").alias("spread")).where("spread > 1")
    shared = rows.join(spread, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("spread", "shingle"))).alias("m"))
    # a set's shingles that nobody else has come first and meet nothing
    own, last = F.col("n") - F.size("m"), F.col("n") - F.ceil(F.col("n") * percent / 100)
    front = shared.join(nodes, "node").withColumn("own", own).withColumn("left", (last + 1 - own).cast("int")).where("left > 0")
    postings = front.select("node", "n", "root", "own", F.posexplode(F.slice("m", 1, F.col("left"))).alias("at", "x"))
    postings = stored(postings.select(F.col("x.shingle").alias("shingle"), "node", "n", "root", (F.col("own") + F.col("at")).alias("place")), "postings")

    roots = postings.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    lists = roots.groupBy("shingle").agg(F.sum("c").alias("size"), F.max(F.struct("c", "root")).alias("main"), F.count("*").alias("roots"))
    lists = lists.where("roots > 1").select("shingle", F.col("main.root").alias("main"), F.ceil((F.col("size") - F.col("main.c")) / RUN).alias("runs"))
    postings = stored(postings.join(lists, "shingle"), "mixed-postings")
    left = postings.where("root <> main").select(
        "shingle", F.pmod(F.xxhash64("node"), "runs").alias("run"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("place").alias("ia"))
    right = postings.select(
        "shingle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.col("node").alias("b"), F.col("root").alias("rb"),
        F.col("n").alias("nb"), F.col("place").alias("ib"), (F.col("root") == F.col("main")).alias("most"))
    room = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    met = left.join(right, ["shingle", "run"]).where((F.col("ra") != F.col("rb")) & (F.col("most") | (F.col("a") < F.col("b"))) & room)
    return met.select("a", "b", "ra", "rb").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); the root is the component's smallest node.

    Large-star and small-star steps in turn, each an aggregate for the minimum and
    a join back, until count and hash sum of the links no longer change.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))  # a: centre, b: neighbour
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("low"))
        step = both.join(low, "a")
        if large:  # neighbours above the centre go to the minimum
            out = step.where("b > a").select(F.col("low").alias("a"), "b")
        else:  # neighbours below it, and the centre itself
            step = step.where("b < a").select("low", F.explode(F.array("a", "b")).alias("b"))
            out = step.select(F.col("low").alias("a"), "b")
        return out.where("a <> b").distinct()

    def mark(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = mark(edges)
    for _ in range(most):
        edges = stored(star(star(edges, True), False), "links")
        now = mark(edges)
        if now == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now
    raise RuntimeError("the components did not settle")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = MIN_PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept, root) of every row of ``docs`` (doc_id, text).

    A null or empty text, or one without words, has no set and is its own
    component.  Repeated rows share node and component; a row with a null doc_id
    gets its component's smallest id (null if there is none) and is kept only
    then.  Other columns are not read.  The smallest doc_id stands for a component;
    root tells apart components of one doc_id (null without a set).
    """
    sketches = stored(sketch(docs, k), "sketches")
    nodes = sketches.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("row"),
        F.min("signature").alias("signature"), F.min("n_shingles").alias("n_shingles"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers hold once they are written
    pairs, dense = forest_pairs(nodes)
    candidates = stored(with_agreement(pairs, nodes, percent=percent), "candidates")

    # the text of one row per node that a candidate names, and of every dense one
    involved = candidates.select(F.explode(F.array("a", "b")).alias("node"))
    involved = (involved.unionByName(dense) if dense else involved).distinct()
    rows = nodes.join(involved, "node").select("node", F.col("row.doc_id").alias("id"), "row.text_hash")
    texts = _texts(docs).join(rows, F.col("doc_id").eqNullSafe(F.col("id")) & (rows["text_hash"] == F.xxhash64("text")))
    texts = stored(texts.select("node", "text").dropDuplicates(["node"]), "texts")

    # first each node's best candidate, then what its links do not connect already
    best = Window.partitionBy("node").orderBy(F.desc("share"), "a", "b")
    ends = candidates.select("*", F.explode(F.array("a", "b")).alias("node")).withColumn("rank", F.row_number().over(best))
    first = stored(ends.where("rank = 1").select("a", "b").distinct(), "first")
    links = stored(confirm(first, texts, k, percent), "first-links")
    roots = components(links)
    ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    unseen = candidates.select("a", "b").join(first, ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
    unseen = unseen.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    roots = components(links.unionByName(confirm(unseen, texts, k, percent)))
    if dense:
        roots = _exact(dense, nodes, texts, roots, k, percent)

    component = nodes.join(roots, "node", "left").select("digest", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = component.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = component.join(smallest, "root").select("digest", "component_id", "root")
    out = sketches.drop("signature").join(component, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "root")


def _exact(dense: DataFrame, nodes: DataFrame, texts: DataFrame, roots: DataFrame, k: int, percent: int) -> DataFrame:
    """``roots`` after all dense nodes have met: one pair of each two components first,
    then all that are still apart."""
    sized = nodes.select("node", F.col("n_shingles").alias("n")).join(dense, "node").join(roots, "node", "left")
    pairs = exact_pairs(texts.join(dense, "node", "left_semi"), sized.withColumn("root", F.coalesce("root", "node")), k, percent)
    pairs = stored(pairs, "exact-pairs")
    merged = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    one = pairs.groupBy(F.least("ra", "rb").alias("x"), F.greatest("ra", "rb").alias("y")).agg(F.min(F.struct("a", "b")).alias("p"))
    if one.isEmpty():
        return roots
    links = stored(confirm(one.select("p.a", "p.b"), texts, k, percent), "exact-links")
    now = roots if links.isEmpty() else components(merged.unionByName(links))
    ra, rb = (now.select(F.col("node").alias(x), F.col("root").alias(f"n{x}")) for x in "ab")
    apart = pairs.join(one.select("p.a", "p.b"), ["a", "b"], "left_anti").join(ra, "a", "left").join(rb, "b", "left")
    apart = apart.where(F.coalesce("na", "a") != F.coalesce("nb", "b"))
    rest = stored(confirm(apart, texts, k, percent), "exact-links")
    return now if rest.isEmpty() else components(merged.unionByName(links).unionByName(rest))


def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_hash", "root")
