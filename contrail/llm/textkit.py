"""Helpers that several corpus operators share.

Words are split per Arrow batch with ``bytes.translate`` and ``bytes.split``
and dictionary-encoded by Arrow, so the Python work follows the number of
*different* words of a chunk and everything per word is a NumPy array.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root

#: Texts are worked on in chunks of about this many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: How words are split: bytes.split() parts at \x20 and \x09-\x0D.
SPACED, SPACED_LOWER, ALNUM_LOWER = bytes(range(256)), _LOWER, _ALNUM


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def spans(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 16
    if start < len(texts):
        yield start, len(texts)


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Row ranges of about ``limit`` bytes with their texts; only one range's texts are held."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size + 16)
    start = 0
    while start < len(size):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop, text_bytes(column.slice(start, stop - start))
        start = stop


def words_of(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of all words in order, words per text, and the word of each code."""
    split = [t.translate(table).split() if table is not SPACED else t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    if not counts.sum():
        return np.empty(0, np.int64), counts, []
    coded = pa.array([w for s in split for w in s], pa.binary()).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), counts, coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (short by k - 1 at the end)."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : i + n])
    return h


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """True where the fold is 2; a null id is not held out (and never learnt from)."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one that the session names."""
    return f"{checkpoint_root(spark).rstrip('/')}/contrail-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a lineage cut that
    outlives executors, with pruned and pushed-down scans afterwards."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in any case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def batch_fields(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def arrow_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def binary_slices(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` as a binary column; ``counts`` are items per piece."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]
    ).cast(pa.binary())
