"""Ranked lexical search over bit-sliced Bloom signatures.

*Index.*  A document's keys are (term, level) for each level of LEVELS that the
term's number of occurrences reaches.  Documents of about as many keys share a
block of up to BLOCK_DOCS documents with one number of bits, so that signatures of
short and of very long documents are equally full.  A block is stored by slices:
one bitmap over its documents for each bit.

*Bounds.*  The documents of a block that may hold a key are the conjunction of its
HASHES slices: a Bloom filter errs to one side only, so the highest level found is
never below the true one.  A term adds at most its weight times the gain at the
most occurrences of that level; summed over the terms of an item this bounds the
document's score from above.

*Search.*  The documents of the TRIED highest bounds are scored exactly; the last of
their TOP best scores is a threshold that the result cannot fall below.  All documents
whose bound reaches it are scored exactly, so only what is provably not among the
TOP best is left out.

Blocks, bounds and scores are made where the documents lie.  Items go to the tasks
in blocks of bounded size, each block against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontamination import bitmap
from .textkit import ALNUM_LOWER, arrow_batch, batch_fields, documents, hashes, mix, slices, spans, stored, text_bytes, words_of

TOP = 10
#: Documents per item, by bound, whose exact scores give the threshold.
TRIED = 100
#: A term's occurrences are known up to the next of these.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 1024, 4096, 16384, 65536], np.int64)
BITS_PER_KEY, HASHES = 10, 5
#: A block ends with as many documents, or as many keys (some MB of signatures).
BLOCK_DOCS, BLOCK_KEYS = 512, 1 << 18
#: Terms and items of a block of items, about; and terms that bounds are summed for at once.
ITEM_TERMS, ITEMS, TERMS_AT_ONCE = 50_000, 2_000, 4_096

TERMS = batch_fields(("q", T.LongType()), ("term", T.BinaryType()), ("hash", T.LongType()))
INDEX = batch_fields(
    ("doc_ids", T.ArrayType(T.LongType())), ("text_hashes", T.ArrayType(T.LongType())), ("lengths", T.ArrayType(T.LongType())), ("bits", T.LongType()),
    ("slices", T.BinaryType()), ("terms", T.ArrayType(T.BinaryType())), ("docs_with", T.ArrayType(T.LongType())),
)
BOUNDS = batch_fields(("q", T.LongType()), ("doc_id", T.LongType()), ("text_hash", T.LongType()), ("bound", T.LongType()))
SCORES = batch_fields(("q", T.LongType()), ("doc_id", T.LongType()), ("score", T.LongType()))


def key_hashes(terms: np.ndarray, level: int) -> np.ndarray:
    """Hashes of the keys (term, level)."""
    return mix(terms + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64)))


def bit_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES bits of each key (double hashing)."""
    step = mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    return ((keys[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def size_class(n_keys: int) -> int:
    """Keys that a signature is made for: powers of two and the middles between them."""
    power = 1 << max(4, (n_keys - 1).bit_length())
    return power * 3 // 4 if n_keys <= power * 3 // 4 else power


class BlockMaker:
    """Gathers documents by size class; full classes become index rows."""

    def __init__(self, wanted: np.ndarray):
        self.wanted, self.open = wanted, {}

    def add(self, doc_id, text_hash: int, length: int, keys: np.ndarray, terms: list[bytes]) -> Iterator[tuple]:
        cap = size_class(len(keys))
        docs = self.open.setdefault(cap, [])
        docs.append((doc_id, text_hash, length, keys, terms))
        if len(docs) >= min(BLOCK_DOCS, max(1, BLOCK_KEYS // cap)):
            yield self._row(cap, self.open.pop(cap))

    def rest(self) -> Iterator[tuple]:
        for cap in sorted(self.open):
            yield self._row(cap, self.open[cap])
        self.open = {}

    @staticmethod
    def _row(cap: int, docs: list) -> tuple:
        bits = cap * BITS_PER_KEY
        # bits of a byte are documents in descending place, as np.packbits has them
        sheet = np.zeros((bits, -(-len(docs) // 8)), np.uint8)
        with_term: dict[bytes, int] = {}
        for i, (_, _, _, keys, terms) in enumerate(docs):
            sheet[np.unique(bit_places(keys, bits)), i // 8] |= np.uint8(128 >> i % 8)
            for t in terms:
                with_term[t] = with_term.get(t, 0) + 1
        ids, text_hashes, lengths = ([d[c] for d in docs] for c in range(3))
        return ids, text_hashes, lengths, bits, sheet.tobytes(), list(with_term), list(with_term.values())


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(document, term code, occurrences) of each different term of each text, terms per text, and the terms."""
    codes, counts, words = words_of(texts, ALNUM_LOWER)
    owner = np.repeat(np.arange(len(texts)), counts)
    pair, times = np.unique(owner * max(1, len(words)) + codes, return_counts=True)
    return pair // max(1, len(words)), pair % max(1, len(words)), times, counts, words


def build_index(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Blocks of all documents with a term; of the terms in ``wanted`` (a bitmap of hashes)
    each block also tells how many of its documents hold them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, shared = to_arrow_schema(INDEX), docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        maker = BlockMaker(known)
        for batch in batches:
            ids, text_hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, _, texts in slices(batch.column(1)):
                owner, code, times, counts, words = term_counts(texts)
                marks = hashes(words)
                asked = known[marks & np.uint64(len(known) - 1)]
                at = np.searchsorted(owner, np.arange(len(texts) + 1))
                for i in np.flatnonzero(counts).tolist():
                    own, n = code[at[i] : at[i + 1]], times[at[i] : at[i + 1]]
                    keys = [key_hashes(marks[own[n >= least]], level) for level, least in enumerate(LEVELS[LEVELS <= n.max()])]
                    terms = [words[c] for c in own[asked[own]]]
                    for row in maker.add(ids[a + i], text_hashes[a + i], int(counts[i]), np.concatenate(keys), terms):
                        yield arrow_batch(schema, *([x] for x in row))
        for row in maker.rest():
            yield arrow_batch(schema, *([x] for x in row))

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(run, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """(q, term, hash) of the different terms of every item."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(TERMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in spans(texts):
                owner, code, _, _, words = term_counts(texts[a:b])
                marks = hashes(words).view(np.int64)
                yield arrow_batch(schema, batch.column(0).take(pa.array(a + owner)), [words[c] for c in code], marks[code] if len(code) else [])

    return items.select("q", F.col("text").cast("string")).mapInArrow(run, TERMS)


def gains(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(1000000000*tf) div (1000*tf+8*m)."""
    return (1_000_000_000 * times) // (1000 * times + 8 * m)


class ItemBlock:
    """Some items with their weighted terms, and the corpus figures scores need."""

    def __init__(self, rows: list, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.q = np.array([r["q"] for r in rows], np.int64)
        place: dict[bytes, int] = {}
        self.terms = [np.array([place.setdefault(bytes(t["term"]), len(place)) for t in r["terms"]], np.int64) for r in rows]
        self.weights = [np.array([t["w"] for t in r["terms"]], np.int64) for r in rows]
        self.place = place
        self.hashes = hashes(list(place))

    def lengths_to_m(self, lengths: np.ndarray) -> np.ndarray:
        return 10 + (90 * lengths * self.n_docs) // self.n_terms

    def bounds(self, lengths: np.ndarray, bits: int, sheet: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores, items by documents."""
        m, docs = self.lengths_to_m(lengths), len(lengths)
        steps, before = [], np.zeros(docs, np.int64)
        for next_level in [*(LEVELS[1:] - 1), 0]:
            # occurrences are below the next level, and no more than the document has terms
            now = gains(np.minimum(next_level, lengths) if next_level else lengths, m)
            steps.append((now - before).astype(float))
            before = now
        out = np.zeros((len(self.q), docs))
        sizes = np.cumsum([len(t) for t in self.terms])
        first = 0
        while first < len(self.q):
            base = sizes[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(sizes, base + TERMS_AT_ONCE, "right")))
            used, inverse = np.unique(np.concatenate(self.terms[first:last]), return_inverse=True)
            gain = self._gain(self.hashes[used], bits, sheet, steps, docs)
            at = 0
            for i in range(first, last):
                n = len(self.terms[i])
                # whole numbers below 2**53
                out[i] = self.weights[i].astype(float) @ gain[inverse[at : at + n]]
                at += n
            first = last
        return out.astype(np.int64)

    @staticmethod
    def _gain(terms: np.ndarray, bits: int, sheet: np.ndarray, steps: list, docs: int) -> np.ndarray:
        out = np.zeros((len(terms), docs))
        alive = np.arange(len(terms))
        found = np.full((len(terms), sheet.shape[1]), 255, np.uint8)
        for level, step in enumerate(steps):
            for place in bit_places(key_hashes(terms[alive], level), bits).T:
                found &= sheet[place]
            some = found.any(axis=1)
            alive, found = alive[some], found[some]
            if not len(alive):
                break
            out[alive] += np.unpackbits(found, axis=1)[:, :docs] * step
        return out

    def scores(self, texts: list[bytes], asked: list[list[int]]) -> list[list[int]]:
        """Exact scores of each text for the items (their places) asked of it."""
        owner, code, times, counts, words = term_counts(texts)
        to_place = np.array([self.place.get(w, -1) for w in words], np.int64)
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        value, out = np.zeros(len(self.place), np.int64), []
        for i, wanted in enumerate(asked):
            place = to_place[code[at[i] : at[i + 1]]] if at[i] < at[i + 1] else np.empty(0, np.int64)
            own = place >= 0
            place = place[own]
            value[place] = gains(times[at[i] : at[i + 1]][own], self.lengths_to_m(counts[i : i + 1])[0])
            out.append([int((self.weights[x] * value[self.terms[x]]).sum()) for x in wanted])
            value[place] = 0
        return out


def _sheet(row: dict) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array(row["lengths"], np.int64)
    return lengths, np.frombuffer(row["slices"], np.uint8).reshape(row["bits"], -1)


def bounded(index: DataFrame, shared, least: dict[int, int] | None, top: int) -> DataFrame:
    """(q, doc_id, text_hash, bound): of each task the ``top`` highest bounds of each item; or,
    where ``least`` is given, every document whose bound is as high as that of the item."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(BOUNDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        if least is not None:
            low = np.array([max(1, least.get(int(q), 1)) for q in block.q], np.int64)[:, None]
        best = np.zeros((len(block.q), 0), np.int64)
        place = np.zeros((len(block.q), 0), np.int64)
        docs: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                lengths, sheet = _sheet(row)
                bound = block.bounds(lengths, row["bits"], sheet)
                if least is not None:
                    item, doc = np.nonzero(bound >= low)
                    yield arrow_batch(schema, block.q[item], [row["doc_ids"][d] for d in doc], [row["text_hashes"][d] for d in doc], bound[item, doc])
                    continue
                best = np.concatenate([best, bound], 1)
                place = np.concatenate([place, np.broadcast_to(len(docs) + np.arange(len(lengths)), bound.shape)], 1)
                docs += zip(row["doc_ids"], row["text_hashes"], strict=True)
                if best.shape[1] > top:
                    kept = np.argpartition(-best, top - 1, axis=1)[:, :top]
                    best, place = np.take_along_axis(best, kept, 1), np.take_along_axis(place, kept, 1)
                used, inverse = np.unique(place, return_inverse=True)
                docs, place = [docs[u] for u in used], inverse.reshape(place.shape)
        item, column = np.nonzero(best > 0)
        own = [docs[p] for p in place[item, column]]
        if own:
            yield arrow_batch(schema, block.q[item], [d[0] for d in own], [d[1] for d in own], best[item, column])

    return index.select("doc_ids", "text_hashes", "lengths", "bits", "slices").mapInArrow(run, BOUNDS)


def scored(docs: DataFrame, pairs: DataFrame, shared) -> DataFrame:
    """(q, doc_id, score) of all documents' rows that ``pairs`` (q, doc_id, text_hash) names."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        place = {int(q): i for i, q in enumerate(block.q)}
        for batch in batches:
            ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b, texts in slices(batch.column(1)):
                found = block.scores(texts, [[place[q] for q in w] for w in wanted[a:b]])
                q = [x for w in wanted[a:b] for x in w]
                yield arrow_batch(schema, q, [i for i, w in zip(ids[a:b], wanted[a:b], strict=True) for _ in w], [x for f in found for x in f])

    # as many items at most as a block of items has
    per_doc = pairs.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("q").alias("qs"))
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    return keyed.join(per_doc, same).select("doc_id", "text", "qs").mapInArrow(run, SCORES)


def _ranked(scores: DataFrame, top: int, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("q").orderBy(*order))
    return scores.withColumn("rank", place).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score
    above 0, equal scores by ascending doc_id (null last).

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not
    read.  Null and empty texts have no terms: such documents are not counted and
    never found, such items find nothing.  Repeated rows are documents (items) of
    their own; a null doc_id or item_id is returned as null.  Texts are read whole.
    Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    items = stored(items.select("item_id", "text").withColumn("q", F.monotonically_increasing_id()), "items")
    terms = stored(item_terms(items), "item-terms")
    index = stored(build_index(docs, bitmap(terms.select("hash"))), "signatures", "uncompressed")
    n_docs, n_terms = index.agg(F.sum(F.size("lengths")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    if not n_docs:
        none = F.lit(None)
        return items.limit(0).select("item_id", none.cast("int").alias("rank"), none.cast("long").alias("doc_id"), none.cast("long").alias("score"))
    with_term = index.select(F.explode(F.arrays_zip("terms", "docs_with")).alias("t")).select("t.*").groupBy(F.col("terms").alias("term")).agg(F.sum("docs_with").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = terms.join(with_term, "term").select("q", F.struct("term", weight.alias("w")).alias("t"))
    size = terms.agg(F.count("*"), F.countDistinct("q")).first()
    blocks = max(1, -(-size[0] // ITEM_TERMS), -(-size[1] // ITEMS))
    queries = weighted.groupBy("q").agg(F.sort_array(F.collect_list("t")).alias("terms"))
    queries = stored(queries.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))), "queries")
    found = None
    for b in range(blocks):
        # ITEM_TERMS terms, about
        rows = queries.where(F.col("block") == b).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(ItemBlock(rows, n_docs, n_terms))
        first = stored(_ranked(bounded(index, shared, None, max(top, TRIED)), max(top, TRIED), F.desc("bound"), F.col("doc_id")), "first-bounds")
        tried = _ranked(scored(docs, first, shared).where("score > 0"), top, F.desc("score"))
        # one number for each item of the block
        least = {r["q"]: r["s"] for r in tried.groupBy("q").agg(F.min("score").alias("s"), F.count("*").alias("n")).where(F.col("n") >= top).collect()}
        open_ = stored(bounded(index, shared, least, 0), "open")
        part = stored(scored(docs, open_, shared).where("score > 0"), "scores")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], SCORES)
    ranked = _ranked(found, top, F.desc("score"), F.asc_nulls_last("doc_id"))
    return ranked.join(items.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def op11_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term, row FROM (SELECT *, row_number() OVER () AS row FROM documents)),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len),
m AS (SELECT row, 100 - 90 + ((90 * n * docs) // terms) AS m FROM len, total),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
s AS (SELECT item_id, row, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item_id, row),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
