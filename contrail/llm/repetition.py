"""Repetition rules from a suffix array over the words of each text.

The suffix array of a chunk of texts is built by prefix doubling in NumPy: the
first rank of a word includes its text, so suffixes of different texts never
meet, and only suffixes that still share their rank are sorted again.  The
longest common prefix of neighbours comes from the stored ranks (2**j words are
equal where the ranks of step j are).  Neighbours that share at least
``min_words`` words bound the intervals of repeated substrings; at a place p the
longest one that begins there is the larger of its two neighbours' prefixes, and
the union of those spans is what repeats.

A text fails if repeats cover too large a fraction of it or if one repeat is too
long, besides the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import SPACED, arrow_batch, batch_fields, documents, spans, text_bytes, words_of

MIN_WORDS = 8
LEAST_WORDS = 20
#: Percent of the words that repeats may cover.
MAX_COVERED = 30
#: One repeat may hold this many words, or this percent of the text if that is more.
MAX_REPEAT_WORDS, MAX_REPEAT_PERCENT = 100, 10

_BLANK = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"

RESULT = batch_fields(
    ("doc_id", T.LongType()), ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
    ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("longest_repeat", T.LongType()),
    ("repeat_spans", T.ArrayType(T.ArrayType(T.LongType()))),
)


def suffix_repeats(codes: np.ndarray, counts: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """For every word place of all texts, the words of the longest substring that
    begins there and occurs again in the same text (0 below ``min_words``)."""
    n = len(codes)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    first = text * (int(codes.max()) + 1) + codes

    order = np.argsort(first, kind="stable")
    changed = np.concatenate([[True], np.diff(first[order]) != 0])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(changed, np.arange(n), 0))
    rank[n] = -1
    levels, suffixes, width = [rank.copy()], order, 1
    alone = changed & np.append(changed[1:], True)
    active = order[~alone]
    place = np.flatnonzero(~alone)  # of the active ones in the suffix array
    while len(active):
        follow = active + width
        second = np.where(follow < end[active], rank[np.minimum(follow, n)] + 1, 0)
        again = np.lexsort((second, rank[active]))
        active, second = active[again], second[again]
        group = rank[active]
        new = np.concatenate([[True], (np.diff(group) != 0) | (np.diff(second) != 0)])
        suffixes[place] = active
        rank[active] = place[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        levels.append(rank.copy())
        width *= 2
        tied = ~(new & np.append(new[1:], True))
        active, place = active[tied], place[tied]

    # neighbours that share min_words at least share the rank of the largest step within
    step = min(len(levels) - 1, min_words.bit_length() - 1)
    near = np.flatnonzero(levels[step][suffixes[:-1]] == levels[step][suffixes[1:]])
    a, b = suffixes[near], suffixes[near + 1]
    x, y, shared = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        same = levels[j][x] == levels[j][y]
        shared[same] += 1 << j
        x, y = np.where(same, np.minimum(x + (1 << j), n), x), np.where(same, np.minimum(y + (1 << j), n), y)
    shared[shared < min_words] = 0
    np.maximum.at(longest, a, shared)
    np.maximum.at(longest, b, shared)
    return longest


def union_spans(longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the united spans [p, p + longest[p]); spans never leave their text."""
    at = np.flatnonzero(longest)
    if not len(at):
        return at, at
    reach = np.maximum.accumulate(at + longest[at])
    opens = np.concatenate([[True], at[1:] > reach[:-1]])
    return at[opens], np.append(reach[:-1][opens[1:]], reach[-1])


def measure(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Word, symbol, line and repetition figures of every text, with the united
    spans (first word, words) of what repeats.

    ``docs`` has doc_id and text; other columns are not read.  A null or empty
    text has zeros; repeated rows come as often as they are; equal lines without
    a word are not counted as duplicates.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), text_bytes(batch.column(1))
            for a, b in spans(texts):
                part = texts[a:b]
                codes, counts, _ = words_of(part, SPACED)
                longest = suffix_repeats(codes, counts, min_words)
                begins = np.cumsum(counts) - counts
                start, stop = union_spans(longest)
                # united spans of neighbouring texts may touch: cut them at the text's end
                owner = np.searchsorted(begins + counts, start, "right")
                lists: list[list[list[int]]] = [[] for _ in part]
                for o, s, e in zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True):
                    while True:
                        limit = int(begins[o] + counts[o])
                        if min(e, limit) > s:
                            lists[o].append([s - int(begins[o]), min(e, limit) - s])
                        if e <= limit:
                            break
                        s, o = limit, o + 1
                lines = [[x for x in t.split(b"\n") if x.strip(_BLANK)] for t in part]
                most = np.zeros(len(part), np.int64)
                full = counts > 0
                if full.any():
                    most[full] = np.maximum.reduceat(longest, begins[full])
                yield arrow_batch(
                    schema, ids.slice(a, b - a), counts, [len(t.translate(None, _BLANK + _CONTINUATION)) for t in part],
                    [len(t) - len(t.translate(None, _SYMBOLS)) for t in part], [len(x) - len(set(x)) for x in lines],
                    [sum(n for _, n in x) for x in lists], most, lists,
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)


def judge(measured: DataFrame, least_words: int = LEAST_WORDS, max_covered: int = MAX_COVERED,
          max_repeat: int = MAX_REPEAT_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Adds base_failed and kept: the base rules, then the limit on the longest repeat."""
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > max_covered * F.col("n_words"))
    long = (F.col("longest_repeat") > max_repeat) & (100 * F.col("longest_repeat") > max_repeat_percent * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & ~long)


def op8_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(measure(documents(spark, sf_dir))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat")
