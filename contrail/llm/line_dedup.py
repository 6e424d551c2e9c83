"""Cross-site boilerplate lines by their distinct-site spread.

Every non-blank line (trimmed of ASCII white space) has a HyperLogLog sketch of
the sites it stands on; partial sketches of a line merge in one aggregate.  A line
whose estimate is clearly below or above MIN_SITES is decided by the estimate;
lines within BAND of it get an exact distinct count.  A line on MIN_SITES sites at
least is boilerplate and goes from every document but stays where it stands first
(smallest doc_id, then place), so that no text leaves the corpus altogether and
one of many copied documents stays whole.

Only hashes and places are exchanged; a text is read again once its lines to drop
are known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import documents, stored, without

MIN_SITES = 10
#: Share of MIN_SITES around it in which lines are counted exactly: six standard errors of the sketch.
BAND = 0.2
LOG_K = 10
#: At most this many lines are frequent: each has more than the FREQUENT-th part of all places.
FREQUENT = 16384
_TRIM = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_places(docs: DataFrame, site: str = "source") -> DataFrame:
    """(doc_id, text_hash, site, place, one, two) of every non-blank line; one and two are its hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
                       F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(_TRIM))).where("line <> ''")
    return rows.select("doc_id", "text_hash", "site", "place", F.xxhash64("line").alias("one"), F.xxhash64(F.lit(1), F.col("line")).alias("two"))


def boilerplate(places: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(one, two, n, first) of the lines on ``min_sites`` sites at least: how often and where first they stand."""
    spot = F.struct("doc_id", "text_hash", "place")
    sketches = places.groupBy("one", "two").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"), F.count("*").alias("n"), F.min(spot).alias("first"))
    estimate = sketches.select("one", "two", "n", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    likely = stored(estimate.where(F.col("sites") >= min_sites * (1 - band)), "line-spread")
    near = likely.where(F.col("sites") < min_sites * (1 + band)).drop("sites")
    pairs = _meet(places, near).select("one", "two", "site").distinct()
    exact = pairs.groupBy("one", "two").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    return likely.where(F.col("sites") >= min_sites * (1 + band)).drop("sites").unionByName(near.join(exact.drop("exact"), ["one", "two"]))


def _meet(places: DataFrame, lines: DataFrame) -> DataFrame:
    """``places`` with their row of ``lines`` (one, two, n, first).

    A line of more than 1 / FREQUENT of all places is one of fewer than FREQUENT:
    those are sent to the places, so that no task gets all places of one line;
    the places of the others go to their lines.
    """
    key = ["one", "two"]
    often = F.col("n") * FREQUENT > places.select(F.count("*")).scalar()
    frequent = F.broadcast(lines.where(often))
    rest = places.join(F.broadcast(lines.where(often).select(key)), key, "left_anti").join(lines.where(~often), key)
    return places.join(frequent, key).unionByName(rest)


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of text, and n_lines and n_removed.

    A null text stays null and has no lines; blank lines stay; a null site is
    one site of its own; a null doc_id comes before all others.  Rows with equal
    id and text share their outcome.  A column of docs named like a new one is
    replaced.  No rows give no rows.  A long text is split in one task, and the
    places of its lines to drop are one list.
    """
    docs = without(docs, "n_lines", "n_removed")
    places = stored(line_places(docs, site), "line-places")
    found = _meet(places, stored(boilerplate(places, min_sites), "boilerplate"))
    gone = found.where(F.struct("doc_id", "text_hash", "place") != F.col("first"))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("place").alias("_gone"))
    keyed = docs.withColumn("_key", F.xxhash64(F.col("text").cast("string")))
    out = keyed.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash")), "left")
    lines = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    text = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    full = F.size(F.filter(lines, lambda x: F.trim(x, F.lit(_TRIM)) != ""))
    columns = [F.when(F.col("_gone").isNull(), F.col("text").cast("string")).otherwise(text).alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, full.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op4_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"), "text")


SQL = r"""
WITH split AS (SELECT doc_id, coalesce(source, '') AS site, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
placed AS (SELECT doc_id, site, unnest(range(len(parts))) AS place, unnest(parts) AS part FROM split),
lines AS (SELECT doc_id, site, place, part, trim(part, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM placed),
boiler AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
marked AS (SELECT l.*, b.line IS NOT NULL AND row_number() OVER (PARTITION BY l.line ORDER BY doc_id, place) > 1 AS gone
           FROM lines l LEFT JOIN boiler b ON b.line = l.line)
SELECT m.doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       length(coalesce(string_agg(part, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS n_chars_left,
       CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(part, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') END AS text
FROM marked m JOIN documents d ON d.doc_id = m.doc_id GROUP BY m.doc_id
"""
