"""Importance resampling of documents towards a target text's distribution.

A document's features are its runs of words, hashed to buckets. A bucket's gain is the
log ratio of its share in the target to its share in the documents; a document's weight
is the mean gain of its features; Gumbel noise of a seeded digest makes the highest
scores a sample without replacement, drawn in proportion to the weights' exponentials.

Scoring explodes nothing: higher-order functions turn a text into its array of buckets
and add up the elements of one literal array of gains. Only bucket totals (at most
``buckets`` rows a task), histograms of scores and the drawn rows are shuffled. Ranks
come from a distributed sort of the drawn rows: places within a part, and the parts'
counts before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from .common import alphanumeric_words, crc32_sql, long_array, materialize

BUCKETS, MAX_RUN, MIN_WORDS, SEED, PERCENT = 10_000, 1, 20, 2024, 10
#: Scores are counted in steps of 2 ** COARSE first. They lie within 17 bits (gains are
#: logarithms of 64-bit ratios, noise of 32-bit ones), so both counts are bounded.
COARSE = 8
#: Bits of a row's place within its part, as ``monotonically_increasing_id`` has them.
PLACE_BITS = 33


def runs(words: Column, max_run: int = MAX_RUN) -> Column:
    """All runs of 1 to ``max_run`` consecutive words, joined by a space."""

    def of_length(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.concat(words, *map(of_length, range(2, max_run + 1))) if max_run > 1 else words


def bucket_array(features: Column, buckets: int = BUCKETS) -> Column:
    """Each feature's bucket, from 0."""
    return F.transform(features, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(buckets)).cast("int"))


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> list[int]:
    """How many features of the column ``text`` fall into each bucket."""
    each = bucket_array(let(alphanumeric_words(F.col("text")), lambda w: runs(w, max_run)), buckets)
    totals = [0] * buckets
    for bucket, n in texts.select(F.explode(each).alias("bucket")).groupBy("bucket").count().collect():
        totals[bucket] = n
    return totals


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    ratio = lambda s, t: ((t + 1.0) * (s_all + n)) / ((s + 1.0) * (t_all + n))
    return [math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source, target, strict=True)]


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from a digest of the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def score_documents(docs: DataFrame, gains: list[int], max_run: int = MAX_RUN, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text -> doc_id, n_words, n_features, weight, score (all long but the
    id), in one pass without an exploded row. ``carry`` names columns of ``docs`` to
    return as one struct ``carried``."""
    table = long_array(gains)

    def weighed(words: Column) -> Column:
        return let(
            bucket_array(runs(words, max_run), len(gains)),
            lambda b: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.size(b).cast("long").alias("n_features"),
                F.aggregate(b, F.lit(0).cast("long"), lambda total, x: total + F.element_at(table, x + 1)).alias("gain"),
            ),
        )

    box = [F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []
    found = docs.select("doc_id", *box, let(alphanumeric_words(F.col("text")), weighed).alias("found"))
    weight = F.when(F.col("found.n_features") == 0, F.lit(0).cast("long")).otherwise(
        F.expr("(found.gain - pmod(found.gain, found.n_features)) div found.n_features")
    )
    return found.select("doc_id", *(("carried",) if carry else ()), "found.n_words", "found.n_features", weight.alias("weight")).withColumn(
        "score", F.col("weight") + noise(F.col("doc_id"), seed)
    )


def _edge(scores: DataFrame, most: int) -> int:
    """The score of the last of the ``most`` highest. Counts by coarse step, then by
    score within the step where they reach ``most``."""
    step, above = None, 0
    for part, key in ((scores, F.shiftright("score", COARSE)), (None, F.col("score"))):
        part = scores.filter(F.shiftright("score", COARSE) == step) if part is None else part
        for value, n in sorted(part.groupBy(key.alias("k")).count().collect(), reverse=True):
            if above + n >= most:
                step = value
                break
            above += n
    return step


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their number from 1 in a total order, as ``rank``. The sort's
    parts are written with each row's place; the parts' counts, one row for each, give
    the numbers before it."""
    placed = materialize(rows.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "resample-order")
    part = F.shiftright("_place", PLACE_BITS)
    before, starts = 0, []
    for number, n in sorted(placed.groupBy(part.alias("part")).count().collect()):
        starts.append((number, before))
        before += n
    known = rows.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    place = F.col("_place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(known), "_part")  # one row for each part of the sort
        .withColumn("rank", F.col("_before") + place + 1)
        .drop("_place", "_part", "_before")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    max_run: int = MAX_RUN,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Weigh all documents and draw ``percent`` of those with ``min_words`` words.

    ``docs`` needs doc_id and text, ``target`` text. Returns one row per input row:
    doc_id, n_features, weight, score, rank (1, 2, 3... by score, then id, for the drawn
    rows, else null). Null and empty texts: no features, weight 0, never drawn. Null
    doc_id: the noise of an empty id, last among equals. Repeated rows: each has the
    same score and a rank of its own; rows of one id and score are ordered by their
    features, then arbitrarily, and differ in nothing returned. Very long texts: one
    array of buckets. An empty target has all shares smoothed; an empty table gives no
    rows. Further columns are ignored, but those of ``carry``, whatever their names,
    come back as one struct ``carried``.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    gains = bucket_gains(bucket_totals(texts, buckets, max_run), bucket_totals(target.select(F.col("text").cast("string").alias("text")), buckets, max_run))
    scored = materialize(score_documents(docs, gains, max_run, seed, carry), "resample-scores")
    fit = F.col("n_words") >= min_words
    out = ["doc_id", *(("carried",) if carry else ()), "n_features", "weight", "score"]
    most = scored.filter(fit).count() * percent // 100
    if not most:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    high = fit & (F.col("score") >= _edge(scored.filter(fit).select("score"), most))
    rows = scored.filter(high).withColumn("_row", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_row")]
    drawn = _numbered(rows, order).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return scored.filter(~high).withColumn("rank", F.lit(None).cast("long")).select(*out, "rank").unionByName(drawn.select(*out, "rank"))


def op11(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op11_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
w AS (SELECT r, unnest(words) AS word FROM d),
tw AS (SELECT unnest({words}) AS word FROM benchmark),
vocabulary AS MATERIALIZED (
  SELECT word, CAST({crc32_sql("word")} % 10000 AS BIGINT) AS b
  FROM (SELECT word FROM w UNION SELECT word FROM tw)),
s AS (SELECT b, count(*) AS n FROM w JOIN vocabulary USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM tw JOIN vocabulary USING (word) GROUP BY b),
gains AS (
  SELECT s.b, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE)
    / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (b)),
sums AS (
  SELECT r, sum(gain)::DOUBLE AS total, count(*) AS n
  FROM w JOIN vocabulary USING (word) JOIN gains USING (b) GROUP BY r),
scored AS (
  SELECT d.doc_id, len(d.words) AS n_words, coalesce(n, 0) AS n_features,
         CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN sums USING (r)),
noisy AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (
    PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) END AS place FROM noisy)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN place <= (SELECT count(*) FROM noisy WHERE n_words >= 20) * 10 // 100 THEN place END AS rank
FROM ranked
"""
