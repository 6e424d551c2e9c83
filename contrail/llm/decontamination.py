"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of WINDOW consecutive words (an item of
fewer words is one window).  A window is a set of word shingles that must *all*
occur in a document, so one token of it - its prefix - is enough to find every
candidate, and the rarest one gives the fewest:

1. One pass over the documents counts how often each shingle of a window occurs
   (partial counts per task; a bitmap of fixed size keeps other shingles out).
2. Each window's shingles are ordered by that count; the rarest is its prefix.
3. A second pass emits the places of prefix shingles with the words around them.
4. They meet their windows in a join on the shingle; the place of the shingle in
   the window and the length of the document bound where the window may lie, and
   the words there are compared one by one.

Counts, windows and candidates are joined by Spark; only the bitmap is broadcast,
whose size is fixed.  It is made by executors and joined on the driver with `or`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import ALNUM_LOWER, arrow_batch, batch_fields, documents, hashes, run_hashes, slices, spans, stored, text_bytes, words_of

WINDOW = 10
SHINGLE = 4
#: Bits of the bitmap, a power of two: 2 MB, whatever the tables hold.
BITS = 1 << 24
#: A bitmap is sent to the driver in this many pieces at most, so its size is bounded as well.
PIECES = 16

WINDOWS = batch_fields(("item_id", T.StringType()), ("words", T.ArrayType(T.BinaryType())), ("shingles", T.ArrayType(T.LongType())))
COUNTS = batch_fields(("shingle", T.LongType()), ("n", T.LongType()))
PLACES = batch_fields(
    ("doc_id", T.LongType()), ("text_hash", T.LongType()), ("n_words", T.LongType()),
    ("places", T.ArrayType(T.StructType([
        T.StructField("shingle", T.LongType()), T.StructField("at", T.LongType()),
        T.StructField("first", T.LongType()), T.StructField("words", T.ArrayType(T.BinaryType())),
    ]))),
)


def _split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    codes, counts, words = words_of(texts, ALNUM_LOWER)
    return codes, counts, words, hashes(words)[codes] if len(codes) else np.empty(0, np.uint64)


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, words, shingles) of every window of every item; shingles of windows
    shorter than ``shingle`` words are the window itself."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(WINDOWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            for a, b in spans(texts, 1 << 18):
                codes, counts, words, value = _split(texts[a:b])
                rows, at = [], 0
                for item, n in zip(ids[a:b], counts.tolist(), strict=True):
                    size = min(window, n)
                    k = min(shingle, size)
                    if n:
                        marks = run_hashes(value[at : at + n], k).view(np.int64).tolist()
                        own = [words[c] for c in codes[at : at + n]]
                        rows += [(item, own[i : i + size], marks[i : i + size - k + 1]) for i in range(n - size + 1)]
                    at += n
                if rows:
                    yield arrow_batch(schema, *(list(c) for c in zip(*rows, strict=True)))

    return items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, WINDOWS)


def bitmap(shingles: DataFrame, bits: int = BITS, pieces: int = PIECES) -> np.ndarray:
    """Bits at the low parts of the values of ``shingles`` (one long column), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)] = True
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in shingles.coalesce(pieces).mapInArrow(run, "bits binary").toLocalIterator():  # `pieces` rows of bits / 8 bytes
        out |= np.frombuffer(row[0], np.uint8)
    return np.unpackbits(out).astype(bool)


def _marks(value: np.ndarray, counts: np.ndarray, set_: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shingle size: the places whose shingle is in the bitmap, and the shingles there."""
    end = np.repeat(np.cumsum(counts), counts)
    for k in sizes:
        mark = run_hashes(value, k)
        at = np.flatnonzero(set_[mark & np.uint64(len(set_) - 1)] & (np.arange(len(mark)) + k <= end[: len(mark)]))
        yield k, at, mark[at].view(np.int64)


def shingle_counts(docs: DataFrame, set_: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """(shingle, n) over all documents, for shingles in the bitmap (and the few that share its bits)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, shared = to_arrow_schema(COUNTS), docs.sparkSession.sparkContext.broadcast(np.packbits(set_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                _, counts, _, value = _split(texts)
                found = [m for _, _, m in _marks(value, counts, known, tuple(range(1, shingle + 1)))]
                yield arrow_batch(schema, *np.unique(np.concatenate(found), return_counts=True))

    return docs.select(F.col("text").cast("string")).mapInArrow(run, COUNTS).groupBy("shingle").agg(F.sum("n").alias("n"))


def shingle_places(docs: DataFrame, set_: np.ndarray, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Every document with its number of words and the places of shingles in the
    bitmap, each with the words that a window around it may reach."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, shared = to_arrow_schema(PLACES), docs.sparkSession.sparkContext.broadcast(np.packbits(set_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for a, b, texts in slices(batch.column(1)):
                codes, counts, words, value = _split(texts)
                begins = np.cumsum(counts) - counts
                places: list[list] = [[] for _ in range(a, b)]
                for k, at, marks in _marks(value, counts, known, tuple(range(1, shingle + 1))):
                    reach = window - k if k == shingle else 0  # a shorter shingle is a whole window
                    owner = np.searchsorted(begins, at, "right") - 1
                    low = np.maximum(at - reach, begins[owner])
                    high = np.minimum(at + k + reach, begins[owner] + counts[owner])
                    for o, p, m, x, y in zip(owner.tolist(), at.tolist(), marks.tolist(), low.tolist(), high.tolist(), strict=True):
                        first = int(begins[o])
                        places[o].append({"shingle": m, "at": p - first, "first": x - first, "words": [words[c] for c in codes[x:y]]})
                yield arrow_batch(schema, batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), counts, places)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(run, PLACES)


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, text_hash, n_words) of every document, and (row, start, stop, item_id) of
    every occurrence of a window, in word places.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are
    not read.  Null and empty texts have no words.  Repeated rows are documents
    of their own; repeated items count once per item_id; a null item_id hits but
    is no item to count.  Without items nothing is hit.
    """
    windows = item_windows(items, window, shingle)
    # equal windows of all items are one
    windows = stored(windows.groupBy("words").agg(F.first("shingles").alias("shingles"), F.collect_set("item_id").alias("items")), "windows")
    each = windows.select(F.explode("shingles").alias("shingle"))
    counts = stored(shingle_counts(docs, bitmap(each), shingle), "shingle-counts")
    numbered = windows.withColumn("window", F.xxhash64("words")).select(
        "window", "words", "items", F.posexplode("shingles").alias("offset", "shingle"), F.size("shingles").alias("all"))
    # a window with a shingle that no document has cannot occur
    rare = Window.partitionBy("words").orderBy("n", "offset")
    ranked = numbered.join(counts, "shingle").withColumn("rank", F.row_number().over(rare)).withColumn("met", F.count("*").over(Window.partitionBy("words")))
    prefix = ranked.where("rank = 1 AND met = all").select("words", "items", "offset", "shingle")
    prefix = stored(prefix, "prefixes")

    found = stored(shingle_places(docs, bitmap(prefix.select("shingle")), window, shingle).withColumn("row", F.monotonically_increasing_id()), "places")
    places = found.where("size(places) > 0").select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.*")
    near = places.withColumnRenamed("words", "around").join(prefix, "shingle")
    near = near.withColumn("start", F.col("at") - F.col("offset")).withColumn("size", F.size("words"))
    near = near.where("start >= first AND start + size <= n_words AND start - first + size <= size(around)")  # bounds of place and length
    hits = near.where("slice(around, int(start - first + 1), int(size)) = words")
    hits = stored(hits.select("row", "start", (F.col("start") + F.col("size")).alias("stop"), "items").distinct(), "hits")
    return found.select("row", "doc_id", "text_hash", "n_words"), hits


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, text_hash, n_words, n_hit, item_ids, contaminated) of every document."""
    found, hits = find_hits(docs, items, window, shingle)
    earlier = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(earlier), F.lit(0))))
    words = hits.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("row", F.explode("items").alias("item_id")).groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    per_row = words.join(named, "row", "left")
    out = found.join(per_row, "row", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    out = out.withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op5_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
