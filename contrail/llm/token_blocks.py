"""Token ids in patched frame-of-reference blocks.

Format (version 1).  A store is a folder with two Parquet datasets:

``frames``  one row per frame: ``part``, ``frame`` (its number in the part),
            ``doc_ids`` and ``doc_counts`` (the whole documents it holds),
            ``block_starts`` (byte offset of each block) and ``payload``.
``index``   one row per frame: ``part``, ``frame``, ``start`` (ids in all frames before) and ``n_ids``.

A block holds up to BLOCK ids, little-endian:
``u4 minimum, u4 n, u1 width, u4 n_outliers``, then ``n`` offsets from the
minimum as ``width`` bits each (least significant bit first, outliers as their
low bits), then the outliers' places (u4 each) and whole offsets (u4 each).
``width`` holds PERCENTILE of a block's offsets; the rest are outliers.  Any
block decodes on its own, so a reader can start at any entry of the index.

Documents lie in ascending doc_id order: a range exchange on (doc_id, hash of the
text) deals equal ids out too, and each part is sorted.  Frames end at document
ends, so reading needs no exchange at all.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BATCH_BYTES, encoder
from .packing import vocabulary
from .textkit import arrow_batch, batch_fields, binary_slices, documents, scratch, slices

BLOCK = 4096
FRAME_IDS = 256 * 1024
PERCENTILE = 0.95
END_ID = 2
#: Pieces that the encoder remembers here (about 50 MB).
REMEMBERED = 1_200_000
HEAD = struct.Struct("<IIBI")

FRAMES = batch_fields(
    ("part", T.LongType()), ("frame", T.LongType()), ("n_ids", T.LongType()), ("doc_ids", T.ArrayType(T.LongType())),
    ("doc_counts", T.ArrayType(T.LongType())), ("block_starts", T.ArrayType(T.LongType())), ("payload", T.BinaryType()),
)
DOCS = batch_fields(("doc_id", T.LongType()), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.BinaryType()))
INDEX = "part long, frame long, start long, n_ids long"


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    offsets = (ids - np.uint32(low)).astype(np.uint32)
    k = min(len(ids) - 1, int(np.ceil(percentile * len(ids))) - 1)
    width = int(np.partition(offsets, k)[k]).bit_length()
    out = np.flatnonzero(offsets >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    bits = ((offsets[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return HEAD.pack(low, len(ids), width, len(out)) + np.packbits(bits, bitorder="little").tobytes() + out.astype("<u4").tobytes() + offsets[out].astype("<u4").tobytes()


def decode_block(payload: memoryview | bytes, at: int = 0) -> np.ndarray:
    low, n, width, outliers = HEAD.unpack_from(payload, at)
    at += HEAD.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    offsets = (bits.astype(np.float64) @ (2.0 ** np.arange(width))).astype(np.uint32)  # exact below 2**53
    if outliers:
        place = np.frombuffer(payload, "<u4", outliers, at + size)
        offsets[place] = np.frombuffer(payload, "<u4", outliers, at + size + 4 * outliers)
    return offsets + np.uint32(low)


def encode_frame(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[list[int], bytes]:
    blocks = [encode_block(ids[i : i + block], percentile) for i in range(0, len(ids), block)]
    return [0, *np.cumsum([len(b) for b in blocks[:-1]]).tolist()], b"".join(blocks)


def decode_frame(starts, payload: bytes) -> np.ndarray:
    return np.concatenate([decode_block(payload, s) for s in starts]) if len(starts) else np.empty(0, np.uint32)


def write_blocks(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block: int = BLOCK,
                 percentile: float = PERCENTILE, frame_ids: int = FRAME_IDS) -> None:
    """Encodes the texts of ``docs`` (doc_id, text; others are not read) into a store at ``path``.

    A null or empty text is the end id alone; null ids come first; repeated ids
    are stored as often as they come, in order of the text's hash.  No rows
    give an empty store.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(FRAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, frame = encoder(vocabulary, REMEMBERED), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, texts in slices(batch.column(1), 2 * BATCH_BYTES):
                ids, counts = bpe.encode(texts, end_id)
                cut = np.flatnonzero(np.diff(np.cumsum(counts) // frame_ids, append=-1)) + 1  # frames end with documents
                rows, first, at = [], 0, 0
                for last in cut.tolist():
                    n = int(counts[first:last].sum())
                    starts, payload = encode_frame(ids[at : at + n], block, percentile)
                    rows.append((part, frame, n, doc_ids[a + first : a + last], counts[first:last].tolist(), starts, payload))
                    first, at, frame = last, at + n, frame + 1
                yield arrow_batch(schema, *(list(c) for c in zip(*rows, strict=True)))

    key = [F.col("doc_id"), F.xxhash64("text")]
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(*key).sortWithinPartitions(*key)
    dealt.mapInArrow(run, FRAMES).write.option("compression", "zstd").parquet(f"{path}/frames")
    frames = docs.sparkSession.read.schema(FRAMES).parquet(f"{path}/frames")
    # sizes only: parts are as many as the exchange has, and each adds up its own frames
    totals = frames.groupBy("part").agg(F.sum("n_ids").alias("all"))
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("all").over(parts), F.lit(0)).alias("before"))
    earlier = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    places = frames.select("part", "frame", "n_ids", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("own")).join(totals, "part")
    places.select("part", "frame", (F.col("before") + F.col("own")).alias("start"), "n_ids").write.parquet(f"{path}/index")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in a store; ids are little-endian uint32."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_frame(row["block_starts"], row["payload"])
                counts = np.array(row["doc_counts"], np.int64)
                yield arrow_batch(schema, row["doc_ids"], row["start"] + np.cumsum(counts) - counts, counts, binary_slices(ids.astype("<u4"), counts))

    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    # a frame learns its start while it is packed: small rows meet, not ids
    placed = frames.join(index.select("part", "frame", "start"), ["part", "frame"])
    return placed.select("start", "doc_ids", "doc_counts", "block_starts", "payload").mapInArrow(run, DOCS)


def op10_patched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-blocks")
    write_blocks(documents(spark, sf_dir), path, vocabulary())
    return read_blocks(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
