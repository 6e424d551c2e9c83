"""Cost-balanced packing of documents into training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (projections plus
attention, which stays inside a document).  Documents go, longest first, to the
sequence of the lowest cost so far that has room for them.  A document longer
than a sequence first fills whole ones; one that no sequence has room for is cut
at the room of the cheapest sequence, so that almost nothing is
padded: a group of T tokens gets T // length full sequences and one of the next
power of two for the rest.

Every task packs groups of ``group_tokens`` tokens of its own input partition:
no shuffle, and memory bounded by a group and the longest single document.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BATCH_BYTES, encoder
from .textkit import arrow_batch, batch_fields, binary_slices, documents, slices

LENGTH = 2048
END_ID = 1
#: Tokens that one group of sequences holds (about 1000 sequences).
GROUP_TOKENS = 2 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

SCHEMA = batch_fields(
    ("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()),
    ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()),
    ("sequence_tokens", T.LongType()), ("padded_to", T.LongType()), ("sequence_cost", T.DoubleType()),
)


def piece_cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


def assign(lengths: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, tokens, sequence, offset) of every piece, for documents of these lengths."""
    full, rest = divmod(sum(lengths), length)
    room = [length] * full + ([1 << (rest - 1).bit_length()] if rest else [])
    size = list(room)
    pieces, queue, unused = [], [], len(room) - (1 if rest else 0)
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= length:  # fills a sequence of its own
            unused -= 1
            pieces.append((doc, start, length, unused, 0))
            room[unused] = 0
            start += length
        if n > start:
            queue.append((start - n, doc, start))
    heapq.heapify(queue)
    # a heap of (cost, sequence) for each room; ``rooms`` has those in use in order
    heaps: dict[int, list[tuple[float, int]]] = {}
    for s, free in enumerate(room):
        if free:
            heaps.setdefault(free, []).append((0.0, s))
    rooms = sorted(heaps)
    while queue:
        n, doc, start = heapq.heappop(queue)
        n = -n
        fits = rooms[bisect.bisect_left(rooms, n) :] or rooms
        free = min(fits, key=lambda x: heaps[x][0])
        spent, s = heapq.heappop(heaps[free])
        if not heaps[free]:
            del heaps[free], rooms[bisect.bisect_left(rooms, free)]
        took = min(n, room[s])
        pieces.append((doc, start, took, s, size[s] - room[s]))
        room[s] -= took
        if left := room[s]:
            if left not in heaps:
                heaps[left] = []
                bisect.insort(rooms, left)
            heapq.heappush(heaps[left], (spent + piece_cost(took, linear, quadratic), s))
        if took < n:
            heapq.heappush(queue, (took - n, doc, start + took))
    return pieces


def _group(doc_ids: list, ids: np.ndarray, counts: np.ndarray, first_sequence: int, length: int, linear: float, quadratic: float, schema: pa.Schema):
    """The pieces of one group in order of sequence and offset, and the number of its sequences."""
    found = np.array(assign(counts.tolist(), length, linear, quadratic), np.int64).reshape(-1, 5)
    found = found[np.lexsort((found[:, 4], found[:, 3]))]
    doc, start, n, sequence, offset = found.T
    begins = np.cumsum(counts) - counts
    first = begins[doc] + start
    joined = np.concatenate([ids[a:b] for a, b in zip(first.tolist(), (first + n).tolist(), strict=True)])
    sequences = int(sequence.max()) + 1
    tokens = np.bincount(sequence, n, sequences).astype(np.int64)
    cost = np.bincount(sequence, piece_cost(n.astype(float), linear, quadratic), sequences)
    power = (tokens & (tokens - 1)) == 0
    padded = np.where(power, tokens, length)
    batch = arrow_batch(
        schema, pa.array(doc_ids, pa.int64()).take(pa.array(doc)), start, n, binary_slices(joined.astype("<u4", copy=False), n),
        counts[doc], first_sequence + sequence, offset, tokens[sequence], padded[sequence], cost[sequence],
    )
    return batch, sequences


def pack(docs: DataFrame, vocabulary: str, end_id: int = END_ID, length: int = LENGTH, linear: float = LINEAR,
         quadratic: float = QUADRATIC, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of all documents with their token ids (little-endian uint32).

    ``docs`` has doc_id and text; other columns are not read.  A null or empty
    text is the end id alone.  A null doc_id stays null; repeated rows are packed
    as often as they come; documents of equal length go in input order.  No rows
    give no sequences.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        sequence = TaskContext.get().partitionId() << 40
        held, held_ids, held_counts, tokens = [], [], [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, b, texts in slices(batch.column(1), BATCH_BYTES):
                ids, counts = bpe.encode(texts, end_id)
                held += doc_ids[a:b]
                held_ids.append(ids)
                held_counts.append(counts)
                tokens += len(ids)
                if tokens >= group_tokens:
                    out, n = _group(held, np.concatenate(held_ids), np.concatenate(held_counts), sequence, length, linear, quadratic, schema)
                    yield out
                    sequence += n
                    held, held_ids, held_counts, tokens = [], [], [], 0
        if held:
            yield _group(held, np.concatenate(held_ids), np.concatenate(held_counts), sequence, length, linear, quadratic, schema)[0]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(packed: DataFrame) -> DataFrame:
    """``packed`` with a checksum in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "sequence_tokens", "padded_to", "sequence_cost")


def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(documents(spark, sf_dir), vocabulary()))
