"""Quality scores by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a linear model that
minimises the non-negative unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

with the logistic loss: where the bracket falls below zero the step goes against
it, so the model cannot drive the risk of the negatives below zero by fitting
the positives.  The class prior is estimated from the positives and the unlabelled
text (``class_prior``); labelled negatives take no part in it or in the risk.  Only the
last step reads them: a Platt step on the labelled rows turns margins into scores.

A model is fitted on at most ``max_rows`` rows of each kind (the first by a
seeded hash of the id); every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import adam, hashed_head, rows_of, sigmoid
from .textkit import SPACED, documents, fold, hashes, held_out, slices, words_of

MAX_ROWS = 3000
THRESHOLD = 0.7
HASHED = 1024
STEPS, RATE, DECAY, FOLDS = 150, 0.05, 2e-2, 3
#: Shares of the positives that the sets hold which bound the class prior.
PRIOR_SHARES = tuple(i / 20 for i in range(10, 20))

_CLASSES = np.zeros(256, np.int64)
for _i, _set in enumerate((b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b".!?", b",;:", b"#*$%&", b"|<>{}[]\\^~=_@", b"\n", b" \t\r", bytes(range(128, 256)))):
    _CLASSES[np.frombuffer(_set, np.uint8)] = _i + 1
_KINDS = 11
DENSE = _KINDS + 14


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the bias
    slope: float
    shift: float
    prior: float


def features(texts: list[bytes]) -> np.ndarray:
    """Shares of character kinds, word and line figures, and hashed words of each text."""
    n = len(texts)
    out = np.zeros((n, DENSE + HASHED), np.float32)
    codes, counts, words = words_of(texts, SPACED)
    begins = np.cumsum(counts) - counts
    for i, t in enumerate(texts):
        if t:
            out[i, :_KINDS] = np.bincount(_CLASSES[np.frombuffer(t, np.uint8)], minlength=_KINDS) / len(t)
        lines = [x for x in t.split(b"\n") if x]
        out[i, _KINDS : _KINDS + 3] = (
            np.log1p(len(t)) / 10, 1 - len(set(lines)) / len(lines) if lines else 0, np.log1p(len(t) / (len(lines) + 1)) / 10)
    if not len(codes):
        return out
    size = np.fromiter(map(len, words), np.float64, len(words))
    upper = np.fromiter((w.isupper() and len(w) > 1 for w in words), np.float64, len(words))
    digit = np.fromiter((any(48 <= c < 58 for c in w) for w in words), np.float64, len(words))
    mark = np.fromiter((w[-1:] in b"!#*$%&|" for w in words), np.float64, len(words))
    bare = np.fromiter((not any(c > 127 or 65 <= c <= 90 or 97 <= c <= 122 for c in w) for w in words), np.float64, len(words))
    text = np.repeat(np.arange(n), counts)
    each = np.maximum(counts, 1)
    at = _KINDS + 3
    for values in (size / 10, upper, digit, mark, bare, (size > 15).astype(float)):
        out[:, at] = np.bincount(text, values[codes], n) / each
        at += 1
    width = len(words)
    # different words and word pairs: what repeats inside a text
    key = text * width + codes
    distinct = np.unique(key)
    out[:, at] = np.bincount(distinct // width, minlength=n) / each
    pair = (text * width + codes)[:-1] * 1_000_003 + codes[1:]
    same = text[:-1] == text[1:]
    pairs, first = np.unique(pair[same], return_index=True)
    out[:, at + 1] = np.bincount(text[:-1][same][first], minlength=n) / np.maximum(counts - 1, 1)
    out[:, at + 2] = np.log1p(counts) / 10
    out[:, at + 3] = np.minimum(counts, 20) / 20
    out[:, at + 4] = counts < 20
    slot = (hashes([w.lower() for w in words]) % np.uint64(HASHED)).astype(np.int64)
    cell, times = np.unique(text * HASHED + slot[codes], return_counts=True)
    out[cell // HASHED, DENSE + cell % HASHED] = np.sqrt(times / each[cell // HASHED])
    return out


def _blocks(column: pa.Array, rows: int = 1000) -> Iterator[list[bytes]]:
    for _, _, texts in slices(column):
        for i in range(0, len(texts), rows):
            yield texts[i : i + rows]


@F.arrow_udf(T.BinaryType())
def _vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([x.tobytes() for part in _blocks(texts) for x in features(part).astype(np.float16)], pa.binary())


def nonnegative_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Weights (the bias last) that minimise the non-negative unbiased risk."""
    p = np.hstack([positive, np.ones((len(positive), 1), positive.dtype)])
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1), unlabelled.dtype)])

    def gradient(w):
        fp, fu = p @ w, u @ w
        on = -prior * (p.T @ sigmoid(-fp)) / len(p)
        off = (u.T @ sigmoid(fu)) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)
        risk = np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp))
        g = on + off if risk >= 0 else -off
        g[:-1] += decay * w[:-1]
        return g

    return adam(gradient, np.zeros(p.shape[1], np.float32), steps, rate)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled rows, 0.02 to 0.98.

    The unlabelled rows are a mixture of positives and others, so no set of rows holds a
    smaller share of them than the prior times its share of the positives.  The sets tried
    hold the PRIOR_SHARES of the positives of highest margin, by a logistic model that tells
    positives from unlabelled rows; margins are those of rows that a model has not seen.
    """
    both = np.vstack([positive, unlabelled])
    both = np.hstack([both, np.ones((len(both), 1), both.dtype)])
    y = np.arange(len(both)) < len(positive)
    part = np.concatenate([np.arange(len(positive)), np.arange(len(unlabelled))]) % FOLDS
    margin = np.zeros(len(both))
    for k in range(FOLDS):
        z, t = both[part != k], y[part != k]
        weight = np.where(t, 0.5 / max(1, t.sum()), 0.5 / max(1, (~t).sum()))

        def gradient(w, z=z, t=t, weight=weight):
            g = z.T @ (weight * (sigmoid(z @ w) - t)).astype(z.dtype)
            g[:-1] += DECAY * w[:-1]
            return g

        margin[part == k] = both[part == k] @ adam(gradient, np.zeros(both.shape[1], both.dtype), STEPS, RATE)
    limits = np.quantile(margin[y], [1 - share for share in PRIOR_SHARES])
    ratios = [(margin[~y] >= limit).mean() / (margin[y] >= limit).mean() for limit in limits]
    return float(np.clip(min(ratios), 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learns from rows outside the held-out fold, at most ``max_rows`` of each kind.

    ``docs``: doc_id, text.  ``labels``: doc_id, quality; null labels and null
    ids are not learnt from, and of several labels of one id the largest counts;
    of several texts of one id that of the smallest hash counts.  Null texts are empty
    ones, further columns are not read.  Where no document lacks a label, all labelled
    rows stand in for unlabelled text, their labels unread.  Without positives or texts
    the model scores everything by the share of positives among the labels (0.5 without
    labels).
    """
    learn = (fold(F.col("doc_id")) != 2) & F.col("doc_id").isNotNull()
    known = labels.where(learn & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    share = known.agg(F.avg((F.col("y") == 1).cast("double")), F.count("*")).first()
    good = hashed_head(known.where("y = 1").select("doc_id"), max_rows, 1)
    bad = hashed_head(known.where("y <> 1").select("doc_id"), max_rows, 2)
    # unlabelled text: ids of documents without a label in the learning folds
    loose = docs.where(learn).select("doc_id").join(known, "doc_id", "left_anti")
    loose = hashed_head(loose.distinct(), max_rows, 3)
    chosen = good.withColumn("kind", F.lit(1)).union(bad.withColumn("kind", F.lit(0))).union(loose.withColumn("kind", F.lit(2)))
    # at most 3 * max_rows ids: a proven bound
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # one text for each id, whatever the partitions
    rows = rows.groupBy("doc_id", "kind").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("kind", F.xxhash64("doc_id").alias("h"), _vectors("text").alias("x"))
    found = rows.orderBy("h").toArrow()
    kind, x = np.array(found["kind"].to_pylist(), np.int64), rows_of(found["x"])
    width = DENSE + HASHED
    if not (kind == 1).any():
        prior = float(np.clip((share[0] * share[1] + 1) / (share[1] + 2), 0.02, 0.98)) if share[1] else 0.5
        return Model(np.zeros(width, np.float32), np.ones(width, np.float32), np.zeros(width + 1, np.float32), 1.0, float(np.log(prior / (1 - prior))), prior)
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / scale
    unlabelled = x[kind == 2] if (kind == 2).any() else x
    prior = class_prior(x[kind == 1], unlabelled)
    w = nonnegative_pu(x[kind == 1], unlabelled, prior)
    # margins of rows that a model has not seen, so that scores are not too sure of themselves
    part, margin = np.arange(len(x)) % FOLDS, np.zeros(len(x))
    for k in range(FOLDS):
        rest = part != k
        if (rest & (kind == 1)).any():
            loose_x = x[rest & (kind == 2)] if (rest & (kind == 2)).any() else x[rest]
            v = nonnegative_pu(x[rest & (kind == 1)], loose_x, prior)
            margin[~rest] = x[~rest] @ v[:-1] + v[-1]
    labelled = kind != 2
    slope, shift = _platt(margin[labelled], kind[labelled], prior)
    return Model(mean, scale, w, slope, shift, prior)


def _platt(margin: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the score; the classes are weighed as the prior has them."""
    if (y == 0).sum() < 5:
        return 1.0, 0.0
    weight = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))

    def gradient(v):
        d = weight * (sigmoid(v[0] * margin + v[1]) - y)
        return np.array([d @ margin, d.sum()])

    a, b = adam(gradient, np.array([1.0, 0.0]), 500, 0.05)
    return float(max(a, 1e-3)), float(b)


def score_column(model: Model, text: Column) -> Column:
    """Score of each text, 0 to 1 (a null text is an empty one)."""

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = model.weights[:-1] / model.scale
        bias = model.weights[-1] - model.mean @ w
        for texts in batches:
            found = [features(part) @ w + bias for part in _blocks(texts)]
            yield pa.array(sigmoid(model.slope * np.concatenate(found) + model.shift) if found else [], pa.float64())

    return score(F.coalesce(text.cast("string"), F.lit("")))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score ``threshold`` at least, with all their columns."""
    return docs.where(score_column(model, F.col("text")) >= threshold)


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, documents(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
