"""Language of a text by hierarchical discrimination.

First a linear support vector machine per language family (one against the rest)
picks the family, then linear machines, one per pair of languages of that family,
vote on the language.  Features are relative frequencies of hashed character
1- to 3-grams of the lower-cased letters; a machine's margin on a text is the mean
of its weights over the text's grams, so scoring keeps no vector per text.

Families come from a fixed table of language codes; a code that is not in it is a
family of its own.  Machines are fitted on at most ``max_rows`` texts in all, the
same number of each language (the first by a seeded hash of the id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import adam, rows_of, share_below, sigmoid, spot
from .textkit import documents, fold, held_out, mix, spans, text_bytes

DIMENSIONS = 2048
MAX_ROWS = 4000
STEPS, RATE, DECAY = 200, 0.03, 1e-3
UNKNOWN = "und"

FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "finnic": ("et", "fi"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "sinitic": ("yue", "zh"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    families: tuple[tuple[int, ...], ...]  # places in languages
    pairs: tuple[tuple[int, int], ...]  # the first is on the positive side
    weights: np.ndarray  # one row per family, then per pair
    bias: np.ndarray


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed grams of all texts, and how many each text has (0 without a letter)."""
    strings = ["".join(c if c.isalpha() else " " for c in t.decode("utf-8", "replace").lower()) if not t.isascii()
               else t.lower().translate(_ASCII).decode() for t in texts]
    strings = [" " + " ".join(s.split()) + " " if s.strip() else "" for s in strings]
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    text = np.repeat(np.arange(len(strings)), size)
    parts, owners = [], []
    h = np.zeros(n, np.uint64)
    for k in range(1, 4):
        m = max(n - k + 1, 0)
        h = mix(h[:m] * np.uint64(0x100000001B3) + codes[k - 1 :][:m] + np.uint64(k))
        inside = text[:m] == text[k - 1 :][:m]
        parts.append((h[inside] % np.uint64(DIMENSIONS)).astype(np.int32))
        owners.append(text[:m][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.bincount(owner, minlength=len(strings))


_ASCII = bytes(c if 97 <= c <= 122 else 32 for c in range(256))


def _blocks(texts: list[bytes], rows: int = 1000) -> Iterator[list[bytes]]:
    for a, b in spans(texts, 1 << 20):
        for i in range(a, b, rows):
            yield texts[i : min(b, i + rows)]


@F.arrow_udf(T.BinaryType())
def _vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        out = []
        for part in _blocks(text_bytes(texts)):
            found, counts = grams(part)
            for x in np.split(found, np.cumsum(counts)[:-1]):
                out.append((100 * np.bincount(x, minlength=DIMENSIONS) / max(1, len(x))).astype(np.float16).tobytes())
        yield pa.array(out, pa.binary())


def linear_svm(x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Weights (the bias last) of a linear machine with the squared hinge loss; y is -1 or 1, both sides weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)

    def gradient(w):
        short = np.maximum(0, 1 - y * (x @ w))
        g = -2 * (x.T @ (weight * y * short))
        g[:-1] += decay * w[:-1]
        return g

    return adam(gradient, np.zeros(x.shape[1], x.dtype), steps, rate)


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learns from texts with a language outside the held-out fold.

    Null or empty texts, null languages and null ids are not learnt from.
    Without any language the model answers ``und`` for every text.
    """
    learn = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    learn = learn.where((fold(F.col("doc_id")) != 2) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    count = dict(learn.groupBy("lang").count().collect())  # one row per language code
    languages = sorted(count)
    if not languages:
        return Model((), (), (), np.empty((0, DIMENSIONS), np.float32), np.empty(0, np.float32))
    each = max(1, max_rows // len(languages))
    place = spot("doc_id", 5)
    limits = F.create_map(*[F.lit(x) for v in languages for x in (v, share_below(each, count[v]))])
    few = learn.select("doc_id", "lang").where(place < limits[F.col("lang")])  # about 4 rows for one that is wanted
    rank = Window.partitionBy("lang").orderBy(place, "doc_id")
    # at most max_rows ids: a proven bound
    chosen = few.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= each).drop("rank")
    rows = learn.join(F.broadcast(chosen), ["doc_id", "lang"])
    # one text for each id and language, that of the smallest hash, whatever the partitions
    rows = rows.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = rows.select("lang", F.xxhash64("doc_id").alias("h"), _vectors(F.coalesce("text", F.lit(""))).alias("x")).orderBy("lang", "h").toArrow()
    x, lang = rows_of(found["x"]), np.array([languages.index(v) for v in found["lang"].to_pylist()])
    live = x.any(1)
    x, lang = x[live], lang[live]
    if not len(x):
        return Model((), (), (), np.empty((0, DIMENSIONS), np.float32), np.empty(0, np.float32))
    mean, scale = x.mean(0), x.std(0) + 0.01
    x = (x - mean) / scale
    names = [family_of(v) for v in languages]
    families = tuple(tuple(i for i, v in enumerate(names) if v == f) for f in sorted(set(names)))
    pairs = tuple(p for f in families for p in combinations(f, 2))
    rows_w = []
    for f in families:
        y = np.where(np.isin(lang, f), 1.0, -1.0).astype(np.float32)
        rows_w.append(linear_svm(x, y))
    for a, b in pairs:
        use = (lang == a) | (lang == b)
        rows_w.append(linear_svm(x[use], np.where(lang[use] == a, 1.0, -1.0).astype(np.float32)))
    w = np.stack(rows_w)
    weights = w[:, :-1] / scale
    return Model(tuple(languages), families, pairs, (100 * weights).astype(np.float32), (w[:, -1] - weights @ mean).astype(np.float32))


def predict(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
    found, counts = grams(texts)
    n = len(texts)
    margin = np.zeros((len(model.bias), n))
    live = np.flatnonzero(counts)
    if len(live) and len(model.bias):
        begins = (np.cumsum(counts) - counts)[live]
        for j, w in enumerate(model.weights):
            margin[j, live] = np.add.reduceat(w[found], begins, dtype=np.float64) / counts[live] + model.bias[j]
    names, score = [UNKNOWN] * n, np.zeros(n)
    chance = sigmoid(2 * margin)
    kinds = len(model.families)
    for i in live.tolist() if kinds else ():
        k = int(np.argmax(margin[:kinds, i])) if kinds > 1 else 0
        sure = chance[k, i] if kinds > 1 else 1.0
        votes = {v: [0, 0.0, 1.0] for v in model.families[k]}
        for j, (a, b) in enumerate(model.pairs):
            if a in votes:
                m, p = margin[kinds + j, i], chance[kinds + j, i]
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
                votes[a][2], votes[b][2] = min(votes[a][2], p), min(votes[b][2], 1 - p)
        best = max(votes, key=lambda v: (votes[v][0], votes[v][1], -v))
        names[i], score[i] = model.languages[best], sure * votes[best][2]
    return names, score


def language_column(model: Model, text: Column) -> Column:
    """Struct (lang, score) of each text; ``und`` and 0 for a null text or one without a letter."""

    @F.arrow_udf("lang string, score double")
    def language(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], [np.empty(0)]
            for part in _blocks(text_bytes(texts)):
                n, s = predict(model, part)
                names += n
                scores.append(s)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["lang", "score"])

    return language(F.coalesce(text.cast("string"), F.lit("")))


def op3_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_column(fit(docs), F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
