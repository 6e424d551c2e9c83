"""Personal data by weak supervision.

Fixed rules give the base spans, which always stay.  The method adds others:

1. *Candidates.*  Loose patterns propose spans of each kind: the base ones, and what
   the rules miss (written-out addresses, numbers without a plus or with a wrong
   check digit, long addresses of the network).
2. *Votes.*  Labelers of three sorts say yes (1), no (-1) or nothing (0) on a
   candidate: patterns and check sums, gazetteers (domain endings, issuer numbers,
   calling codes, reserved networks) and the words and marks around it.
3. *Aggregation.*  Expectation-maximisation estimates, for each kind, how often each
   labeler votes so on true and on false candidates, and from that how likely each
   is true.  It reads the count of each combination of votes over *all* candidates:
   3 ** len(LABELERS) numbers a kind at most, whatever the corpus.
4. *Classifier.*  A logistic regression on the span's make-up and its surroundings,
   not on the votes, is fitted to those probabilities on TRAIN_ROWS hashed
   candidates a kind at most, and judges every candidate.

Texts are read once, by whole rows; found spans are stored and judged where they lie.
Every pattern is scanned in time linear in the text.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import adam, rows_of, share_below, sigmoid, spot
from .textkit import arrow_batch, batch_fields, documents, stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Candidates of a kind that the classifier is fitted on, at most.
TRAIN_ROWS = 20_000
#: A candidate is kept from this probability on.
KEEP = 0.5
#: Code points before and after a candidate that labelers look at.
REACH = 40
#: Code points of an added span, at most.
LONGEST = 320

# Gazetteers and cue words.
ENDINGS = frozenset("com org net edu gov mil int info biz name io dev app co eu de at ch fr be es it pt nl uk us ca au nz ie se no dk fi pl cz sk hu ro bg gr tr ru ua cn jp kr in br mx ar cl za test local example".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 385 386 387 389 420 421 423 852 853 855 856 880 886 960 961 962 963 964 965 966 971 972 973 974 975 976 977 992 993 994 995 996 998".split())
ISSUERS = tuple("34 36 37 38 39 4 51 52 53 54 55 2221 2720 6011 62 64 65 35 50 56 57 58 6304 6759".split())
CUES = (
    frozenset("mail email e-mail contact contacto kontakt write schreiben correo courriel adresse address mailto from to cc reply an von de para".split()),
    frozenset("ip ipv4 ipv6 host server node client address adresse dirección login logged peer gateway router remote von from".split()),
    frozenset("card cards visa mastercard amex credit debit karte kreditkarte carte tarjeta crédito pan account konto compte cuenta payment paid".split()),
    frozenset("phone tel telephone telefon teléfono téléphone mobile mobil móvil portable cell fax call anruf appel llame rufen contact whatsapp sms".split()),
)
AGAINST = frozenset("version v isbn issn order bestellung invoice rechnung facture factura price preis prix precio page seite página lines rows total sum id nr no part serial date datum time uhr commit build sha doi".split())

LABELERS = ("shape", "check", "gazetteer", "before", "after", "alone", "crowd")
FOUND = batch_fields(
    ("doc_id", T.LongType()), *[(f"n_{k}", T.LongType()) for k in KINDS], ("base_sha256", T.StringType()),
    ("found", T.ArrayType(T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
        T.StructField("base", T.BooleanType()), T.StructField("votes", T.StringType()), T.StructField("features", T.BinaryType()),
    ]))),
)
JUDGED = batch_fields(("doc_id", T.LongType()), *[(f"n_{k}", T.LongType()) for k in KINDS], ("base_sha256", T.StringType()), ("spans", T.StringType()))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[{]at[)\]}]| at |:", re.IGNORECASE)
_AT = re.compile(r" ?(?:@|[(\[{]at[)\]}]) ?| at (?=[A-Za-z0-9-]{1,63} dot )", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| dot | ?[(\[{]dot[)\]}] ?)[A-Za-z0-9-]{1,63}){1,8}", re.IGNORECASE)
_COLONS = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4})?(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,14}(?![0-9A-Za-z])")
_LONG_NUMBER = re.compile(r"(?<![0-9A-Za-z+.])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9A-Za-z])")
_WORD = re.compile(r"[^\W\d_][^\W_]*(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _left(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) by the fixed rules, by kind, then start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start, host = _left(text, at, done), _DOMAIN.match(text, at + 1)
        if start < at and host:
            done = host.end()
            out.append((EMAIL, start, done))
        at = text.find("@", max(done, at + 1))
    for chain in _CHAIN.finditer(text):
        if chain.group().count(".") >= 3:
            parts, place = chain.group().split("."), chain.start()
            begins = [place]
            for p in parts:
                begins.append(begins[-1] + len(p) + 1)
            for i in range(0, len(parts) - 3, 4):
                if all(len(v) < 3 or (len(v) == 3 and v <= "255") for v in (p.lstrip("0") for p in parts[i : i + 4])):
                    out.append((IP, begins[i], begins[i + 4] - 1))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((CARD, m.start(), m.end()))
    if "+" in text:
        out += [(PHONE, m.start(), m.end()) for m in _PLUS.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """The base spans and, apart from them, what loose patterns propose, by kind and start."""
    taken = sorted((a, b) for _, a, b in base)
    begins = [a for a, _ in taken]
    # base spans of two kinds may overlap: how far those up to each one reach
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []

    def free(a: int, b: int) -> bool:
        i = bisect_left(begins, b)
        return b - a <= LONGEST and not (i and ends[i - 1] > a)

    out = [(k, a, b, True) for k, a, b in base]
    done = 0
    for m in _AT.finditer(text):
        start, host = _left(text, m.start(), max(done, m.start() - 64)), _HOST.match(text, m.end())
        if start < m.start() and host and free(start, host.end()):
            done = host.end()
            out.append((EMAIL, start, done, False))
    if ":" in text:
        out += [(IP, m.start(), m.end(), False) for m in _COLONS.finditer(text) if m.end() - m.start() > 4 and free(m.start(), m.end())]
    for kind, pattern in ((CARD, _LONG_NUMBER), (PHONE, _NUMBER)):
        out += [(kind, m.start(), m.end(), False) for m in pattern.finditer(text) if free(m.start(), m.end())]
    return sorted(out)


def _network(span: str):
    try:
        return ipaddress.ip_address(span)
    except ValueError:
        return None


def _own_votes(kind: int, span: str, digits: str) -> tuple[int, int, int]:
    """Votes of the shape, the check and the gazetteer."""
    if kind == EMAIL:
        plain = re.sub(r" ?[(\[{]dot[)\]}] ?| dot ", ".", span, flags=re.IGNORECASE)
        local, _, host = re.sub(r" ?[(\[{]at[)\]}] ?| at | ?@ ?", "@", plain, flags=re.IGNORECASE).partition("@")
        ending = host.rpartition(".")[2].lower()
        fine = local[:1].isalnum() and local[-1:].isalnum() and ".." not in local and not host.startswith("-")
        return (1 if "@" in span and " " not in span else 0), (1 if fine and ending.isalpha() and len(ending) > 1 else -1), (1 if ending in ENDINGS else -1)
    if kind == IP:
        if ":" in span:
            groups = span.split(":")
            real = _network(span)
            timely = len(groups) in (3, 6) and all(len(g) == 2 for g in groups)
            return (1 if len(groups) == 8 or "::" in span else -1), (1 if real else -1), (-1 if timely or real is None else 1 if real.is_global else 0)
        real = _network(".".join(str(int(p)) for p in span.split(".")))
        return 1, (1 if real else -1), (-1 if real is None or real.is_unspecified or real.is_multicast else 1 if real.is_global else 0)
    if kind == CARD:
        groups = [len(g) for g in re.split(r"[\x20.-]", span)]
        usual = groups in ([16], [15], [4, 4, 4, 4], [4, 6, 5])
        return (1 if usual else -1 if len(groups) > 5 else 0), (1 if luhn(digits) else -1), (1 if digits.startswith(ISSUERS) and len(set(digits)) > 3 else -1)
    grouped = bool(re.search(r"[\x20()./-]", span))
    date = bool(re.fullmatch(r"(?:19|20)\d\d[-/. ]?[01]\d[-/. ]?[0-3]\d|[0-3]?\d[-/. ][01]?\d[-/. ](?:19|20)\d\d", span))
    if span.startswith("+"):
        return 1, (1 if 10 <= len(digits) <= 13 else 0), (1 if any(digits[:n] in CALLING for n in (1, 2, 3)) else -1)
    known = (digits.startswith("00") and any(digits[2 : 2 + n] in CALLING for n in (1, 2, 3))) or (digits[0] == "0" and grouped) or span.startswith("(")
    return (-1 if date else 1 if grouped else 0), (1 if 10 <= len(digits) <= 13 and not date else -1), (1 if known else -1)


def votes_of(text: str, kind: int, start: int, stop: int) -> tuple[int, ...]:
    """What each of LABELERS says of a candidate."""
    span = text[start:stop]
    digits = digits_of(span)
    before, after = text[max(0, start - REACH) : start], text[stop : stop + REACH]
    near = [w.lower() for w in _WORD.findall(before)[-4:]]
    said = 1 if any(w in CUES[kind] for w in near) else -1 if any(w in AGAINST for w in near) else 0
    next_ = [w.lower() for w in _WORD.findall(after)[:3]]
    told = 1 if any(w in CUES[kind] for w in next_) else -1 if any(w in AGAINST for w in next_) else 0
    left, right = before[-1:], after[:1]
    alone = 1 if (not left or left.isspace() or left in "(<[:;,|\"'") and (not right or right.isspace() or right in ")>].,;:|!?\"'") else -1
    others = sum(c.isdigit() for c in before + after)
    return (*_own_votes(kind, span, digits), said, told, alone, -1 if others > REACH // 2 else 1 if others == 0 else 0)


#: Length of the features: eight of the span, two classes of neighbours (six each), eight hashed words on each side, check digit, one.
FEATURES = 8 + 12 + 16 + 2


def _mark_class(c: str) -> int:
    return 0 if not c else 1 if c == "\n" else 2 if c.isspace() else 3 if c.isalpha() else 4 if c.isdigit() else 5


def features_of(text: str, start: int, stop: int) -> np.ndarray:
    """The span's make-up and its surroundings."""
    span, out = text[start:stop], np.zeros(FEATURES, np.float32)
    digits = [c for c in span if c.isdigit()]
    groups = [g for g in re.split(r"[^0-9A-Za-z]+", span) if g]
    out[:8] = (
        len(span) / 20, len(digits) / len(span), sum(c.isalpha() for c in span) / len(span), span.count(" ") / 4, len(groups) / 4,
        max(map(len, groups), default=0) / 16, len(set(digits)) / 10, sum(a != b for a, b in pairwise(digits)) / max(1, len(digits)),
    )
    out[8 + _mark_class(text[start - 1 : start] if start else "")] = 1
    out[14 + _mark_class(text[stop : stop + 1])] = 1
    for base, words in ((20, _WORD.findall(text[max(0, start - REACH) : start])[-2:]), (28, _WORD.findall(text[stop : stop + REACH])[:2])):
        for w in words:
            out[base + xxhash.xxh32_intdigest(w.lower()) % 8] = 1
    out[-2] = bool(digits) and luhn(digits_of(span))
    out[-1] = 1
    return out


def inspect(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans, and all candidates with their votes and features."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    return base, [
        {"kind": k, "start": a, "stop": b, "base": own, "votes": "".join("-0+"[v + 1] for v in votes_of(text, k, a, b)),
         "features": features_of(text, a, b).astype(np.float16).tobytes()}
        for k, a, b, own in candidates(text, base)
    ]


def find(docs: DataFrame) -> DataFrame:
    """Every document with its base counts and digest and its candidates."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, rows = batch.slice(at, 256), []
                for text in part.column(1).to_pylist():
                    base, found = inspect(text or "")
                    counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), found))
                yield arrow_batch(schema, part.column(0), *(list(c) for c in zip(*rows, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Expectation-maximisation over combinations of votes (rows of -1, 0, 1) and how often
    each comes: (table, share), where ``table[y, j, v + 1]`` is how often labeler j says v of a
    candidate whose truth is y, and ``share`` is the share of true ones.

    It starts from each labeler being right more often than not, and pseudo-counts
    in that sense keep the two truths from being exchanged."""
    n, m = patterns.shape
    prior = np.tile(np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])[:, None, :], (1, m, 1))
    table, share = prior / prior.sum(2, keepdims=True), 0.5
    for _ in range(steps):
        p = posterior(patterns, table, share)
        new = prior.copy()
        for y, w in ((0, (1 - p) * counts), (1, p * counts)):
            for v in range(3):
                new[y, :, v] += ((patterns == v - 1) * w[:, None]).sum(0)
        new /= new.sum(2, keepdims=True)
        share = float(np.clip(((p * counts).sum() + 1) / (counts.sum() + 2), 1e-3, 1 - 1e-3))
        moved = np.abs(new - table).max()
        table = new
        if moved < 1e-9:
            break
    return table, share


def posterior(patterns: np.ndarray, table: np.ndarray, share: float) -> np.ndarray:
    """Probability of each combination of votes to be of a true candidate."""
    column = np.arange(patterns.shape[1])
    log = [np.log(table[y][column, patterns + 1]).sum(1) for y in (0, 1)]
    return sigmoid(log[1] - log[0] + np.log(share / (1 - share)))


def parse_votes(column: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in v] for v in column], np.int64).reshape(len(column), len(LABELERS))


def fit_spans(x: np.ndarray, target: np.ndarray, steps: int = 400, decay: float = 1e-3) -> np.ndarray:
    """Weights of the logistic regression of probabilities ``target`` on ``x``."""

    def gradient(w: np.ndarray) -> np.ndarray:
        return x.T @ (sigmoid(x @ w) - target) / len(x) + decay * w

    return adam(gradient, np.zeros(x.shape[1]), steps, 0.1)


def fit(found: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[int, dict]:
    """For each kind with candidates: the labelers' reliabilities, the share of true
    candidates and the span classifier's weights."""
    each = found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    # at most 3 ** len(LABELERS) rows a kind
    seen = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    out: dict[int, dict] = {}
    for kind in sorted({r["kind"] for r in seen}):
        rows = [r for r in seen if r["kind"] == kind]
        counts = np.array([r["n"] for r in rows], float)
        table, share = reliabilities(parse_votes([r["votes"] for r in rows]), counts)
        out[kind] = {"table": table, "share": share}
        key = each.where(F.col("kind") == kind).withColumn("key", F.xxhash64("doc_id", "start", "stop", "votes", "features"))
        key = key.withColumn("spot", spot("key", 7)).where(F.col("spot") < share_below(train_rows, int(counts.sum())))
        picked = key.orderBy("spot", "doc_id", "start").limit(train_rows).select("votes", "features").toArrow()
        if not picked.num_rows:
            del out[kind]
            continue
        target = posterior(parse_votes(picked["votes"].to_pylist()), table, share)
        out[kind]["weights"] = fit_spans(rows_of(picked["features"]).astype(float), target)
    return out


def kept_spans(found: list[dict], models: dict[int, dict], keep: float = KEEP) -> list[tuple[int, int, int]]:
    """The base spans and the candidates that the classifier accepts; of accepted ones
    that overlap the likelier (then the first) stays."""
    spans = [(f["kind"], f["start"], f["stop"]) for f in found if f["base"]]
    judged = []
    for f in found:
        if not f["base"] and f["kind"] in models:
            p = float(sigmoid(np.frombuffer(f["features"], np.float16).astype(float) @ models[f["kind"]]["weights"]))
            if p >= keep:
                judged.append((-p, f["start"], f["kind"], f["stop"]))
    added: list[tuple[int, int]] = []
    for _, a, kind, b in sorted(judged):
        i = bisect_left(added, (a, b))
        if (i and added[i - 1][1] > a) or (i < len(added) and added[i][0] < b):
            continue
        added.insert(i, (a, b))
        spans.append((kind, a, b))
    return sorted(spans)


def judge(found: DataFrame, models: dict[int, dict]) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(JUDGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [joined(kept_spans(f, models)) if f else "" for f in batch.column(len(KINDS) + 2).to_pylist()]
            yield arrow_batch(schema, *(batch.column(i) for i in range(len(KINDS) + 2)), spans)

    return found.mapInArrow(run, JUDGED)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of ``docs``
    (doc_id, text; other columns are not read, whatever their names).

    Counts and digest are of the base spans; ``spans`` holds these and the added ones
    (kind:start:stop in code points, by kind and start).  Null and empty texts have
    none; repeated rows come as often as they are given; a null doc_id stays null.
    Texts of any length are read whole (an added span has LONGEST code points at
    most).  Without rows or without candidates nothing is fitted and nothing added.
    """
    found = stored(find(docs), "personal-data")
    return judge(found, fit(found))


def op13_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
