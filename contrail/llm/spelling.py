"""Spelling variants by PartEnum signatures of letter multisets.

A word's letters are a binary vector: its element (letter, i) is 1 where the
letter stands at least i times.  One replaced letter changes two elements, one
inserted or deleted letter changes one, so near words are at Hamming distance 2
(of equal length) or 1 (of lengths s and s + 1).  PartEnum finds all of them by
equality:

1. *Partition.*  Elements are dealt to ``n1`` parts; of two vectors at distance k
   at most, some part differs in k // n1 elements at most.
2. *Enumerate.*  Each part is dealt to ``n2`` sub-parts; leaving out each choice
   of k // n1 of them gives a signature that the two share exactly.
3. *Join.*  Words meet on equal signatures.  One edit also leaves the first or the
   last half of a word as it was, and fixes the lengths, so those belong to the key.
4. *Verify.*  Pairs of the join are kept where the edit distance is one.

Words are counted in one pass over the texts (counts are added up in the task, then
by Spark); all else works on the vocabulary, which Spark keeps partitioned.  The
words of one key differ in the half that the key does not hold, and one word has
few near words, so no group grows with the corpus as its word counts do.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import SPACED, arrow_batch, batch_fields, documents, mix, slices, stored, words_of

#: A run is edited where the crc32 of "<doc_id>:<run>" is divisible by this.
EDIT_EVERY = 97
#: Code points and occurrences that a word has at least.
MIN_POINTS, MIN_COUNT = 5, 3
#: (n1, n2) of words of equal length (distance 2) and of lengths s and s + 1 (distance 1).
EQUAL, LONGER = (1, 3), (1, 2)
#: Bytes of text taken at once.
TAKE = 4 << 20

COUNTS = batch_fields(("word", T.StringType()), ("n", T.LongType()))
SIGNED = batch_fields(("key", T.LongType()), ("side", T.ByteType()), ("word", T.StringType()), ("n", T.LongType()))
SAME, SHORT, LONG = 0, 1, 2

#: Lower-cases A-Z; other ASCII bytes that are no letter become blanks.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def runs_of(texts: list[bytes]) -> list[bytes]:
    """The texts with blanks for all but ASCII letters (lower-cased) and U+00C0 to U+00FF."""
    out = []
    for t in texts:
        t = t.translate(_RUNS)
        if not t.isascii():
            a = np.frombuffer(t, np.uint8).copy()
            lead = a == 0xC3  # U+00C0 to U+00FF are C3 80 to C3 BF
            kept = lead.copy()
            kept[1:] |= lead[:-1]
            a[(a >= 0x80) & ~kept] = 32
            t = a.tobytes()
        out.append(t)
    return out


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The GF(2) matrix of 32 ``columns`` times each of ``values``."""
    out = np.zeros(len(values), np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0)).astype(np.uint32)
    return out


@lru_cache(4096)
def _after(n: int) -> np.ndarray:
    """What ``n`` further bytes make of a crc32: crc(a + b) = crc(a) moved by len(b), xor crc(b)."""
    if n == 1:
        basis = [1 << bit for bit in range(32)]
        for _ in range(8):
            basis = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in basis]
        return np.array(basis, np.uint32)
    half = _after(n // 2)
    both = _apply(half, half)
    return _apply(_after(1), both) if n % 2 else both


def pair_crcs(prefixes: list[bytes], words: list[bytes], prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """crc32 of prefixes[p] + words[w] for each pair of ``prefix`` and ``word``."""
    start = np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes))
    own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    sizes, which = np.unique(np.fromiter(map(len, words), np.int64, len(words)), return_inverse=True)
    moved = np.stack([_apply(_after(int(s)), start) for s in sizes])
    return moved[which[word], prefix] ^ own[word]


def edited_counts(doc_ids: list, texts: list[bytes], every: int = EDIT_EVERY) -> Counter:
    """How often each word stands in the texts, after the edits."""
    codes, counts, words = words_of(runs_of(texts), SPACED)
    if not len(codes):
        return Counter()
    prefixes = [b":" if i is None else b"%d:" % i for i in doc_ids]
    h = pair_crcs(prefixes, words, np.repeat(np.arange(len(texts)), counts), codes)
    hit = h % np.uint32(every) == 0
    left = np.bincount(codes[~hit], minlength=len(words)).tolist()
    out = Counter({w: n for w, n in zip(words, left, strict=True) if n})
    for code, x in zip(codes[hit].tolist(), h[hit].tolist(), strict=True):
        word = words[code].decode()
        at = x % len(word)
        out[(word[:at] + word[at + 1 :]).encode()] += 1
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words long and frequent enough."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in slices(batch.column(1), TAKE):
                found = edited_counts(ids[a:b], texts)
                kept = [w for w in found if len(w) - w.count(0xC3) >= MIN_POINTS]
                yield arrow_batch(schema, pa.array(kept, pa.binary()).cast(pa.string()), [found[w] for w in kept])

    each = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COUNTS)
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def element_sums(words: list[str], parts: int) -> np.ndarray:
    """For each word and part of the vector: the sum of the hashes of its elements there."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((letter, word))
    letter, word = letter[order], word[order]
    fresh = np.flatnonzero(np.concatenate([[True], (letter[1:] != letter[:-1]) | (word[1:] != word[:-1])]))
    time = np.arange(len(letter)) - np.repeat(fresh, np.diff(np.append(fresh, len(letter))))
    element = mix((letter * 1024 + time).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(words), parts), np.uint64)
    np.add.at(out, (word, (element % np.uint64(parts)).astype(np.int64)), mix(element))
    return out


def signatures(words: list[str], distance: int, n1: int, n2: int) -> np.ndarray:
    """PartEnum: a column for each part and each choice of its sub-parts; vectors at
    ``distance`` at most are equal in one column at least."""
    out_of = distance // n1
    if n2 <= out_of:
        raise ValueError("each part needs more sub-parts than may differ")
    sums = element_sums(words, n1 * n2)
    columns = []
    for part in range(n1):
        for kept in combinations(range(n2), n2 - out_of):
            x = np.full(len(words), len(columns) + 1, np.uint64)
            for sub in kept:
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sums[:, part * n2 + sub])
            columns.append(x)
    return np.stack(columns, 1)


def _halves(words: list[str], role: int, longer: int) -> np.ndarray:
    """Hashes of (role, length, first half) and of (role, length, last half); of the longer
    word of a pair (``longer`` = 1) those that its shorter partner has."""
    out = np.empty((len(words), 2), np.uint64)
    for i, w in enumerate(words):
        s = len(w) - longer
        h = s // 2
        out[i, 0] = xxhash.xxh64_intdigest(w[:h].encode(), 4 * s + 2 * role)
        out[i, 1] = xxhash.xxh64_intdigest(w[len(w) - (s - h) :].encode(), 4 * s + 2 * role + 1)
    return out


def keys_of(words: list[str], equal=EQUAL, longer=LONGER) -> list[tuple[int, np.ndarray]]:
    """(side, keys) of all words: pairs meet on equal keys of SAME, or of SHORT and LONG."""
    two, one = signatures(words, 2, *equal), signatures(words, 1, *longer)
    out = []
    for side, found, role, more in ((SAME, two, 0, 0), (SHORT, one, 1, 0), (LONG, one, 1, 1)):
        half = _halves(words, role, more)
        keys = mix(found[:, :, None] ^ mix(half)[:, None, :])
        out.append((side, keys.reshape(len(words), -1)))
    return out


def signed(words: DataFrame, equal=EQUAL, longer=LONGER) -> DataFrame:
    """(key, side, word, n): a row for each signature of each word."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            for side, keys in keys_of(batch.column(0).to_pylist(), equal, longer):
                m = keys.shape[1]
                row = pa.array(np.repeat(np.arange(len(batch)), m))
                yield arrow_batch(schema, keys.ravel().view(np.int64), np.full(len(row), side, np.int8), batch.column(0).take(row), batch.column(1).take(row))

    return words.select("word", "n").mapInArrow(run, SIGNED)


def near_words(words: DataFrame, equal=EQUAL, longer=LONGER) -> DataFrame:
    """(word, n_near, form, form_n): how many words are one edit away, and the most
    frequent of those (the first in code-point order, where several are)."""
    one = signed(words, equal, longer)
    other = one.select("key", F.col("side").alias("side2"), F.col("word").alias("word2"), F.col("n").alias("n2"))
    meet = ((F.col("side") == SAME) & (F.col("side2") == SAME) & (F.col("word") < F.col("word2"))) | ((F.col("side") == SHORT) & (F.col("side2") == LONG))
    # never broadcast: the signatures of a word are taken for one row of its size
    met = one.join(other.hint("merge"), "key").where(meet & (F.levenshtein("word", "word2", 1) == 1))
    both = F.array(F.struct(F.col("word").alias("w"), F.col("word2").alias("o"), F.col("n2").alias("m")),
                   F.struct(F.col("word2").alias("w"), F.col("word").alias("o"), F.col("n").alias("m")))
    # a pair may share several signatures
    pairs = met.select(F.explode(both).alias("p")).select("p.*").distinct()
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("o").alias("o"))).alias("best")
    return pairs.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n_near"), best).select(
        "word", "n_near", F.col("best.o").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of its forms, by pointer doubling.  Counts
    at least double from a word to its form, so no chain is longer than their bits.
    No side is broadcast: a file of words is far smaller than its rows."""
    links = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(links.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``docs`` (doc_id, text; other
    columns are not read, whatever their names).

    A null or empty text has no words, a null doc_id reads as empty in the hash, repeated
    rows count each.  A word's form is its near word of largest n if that is at least
    twice its own (ties: the first in code-point order), else null.  Texts of any length
    are read whole; a run longer than any other is a word as others are.  No rows give
    no words.
    """
    words = stored(word_counts(docs), "words")
    near = words.join(near_words(words).hint("merge"), "word", "left")
    is_form = F.col("form_n") >= 2 * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    near = stored(near, "near-words")
    out = near.join(roots(near.where("form IS NOT NULL")).hint("merge"), "word", "left")
    return out.withColumn("root", F.coalesce("root", "word"))


def op12_partenum_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


# Near words in SQL by shared one-letter deletions; crc32 by its table; form chains by recursion.
SQL = r"""
WITH RECURSIVE tbl AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
       lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
docs AS (SELECT row_number() OVER () AS row, coalesce(doc_id::VARCHAR, '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
pairs AS (SELECT id, run, count(*) AS n FROM docs GROUP BY ALL),
bytes AS (SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''),
          lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM pairs),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM bytes, tbl),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
         UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, min_by(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS place, 0 AS step FROM formed UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON c.place = f.word WHERE f.form IS NOT NULL),
root AS (SELECT word, max_by(place, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN root USING (word)
"""
