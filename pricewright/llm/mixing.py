"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Per source, tokens are summed by the top 15
bits of the hash; running sums over this histogram (32,768 rows a source at most)
find the bucket in which the source's budget ends. Only that bucket is refined,
15 bits at a time, down to one hash value. The mix is then a filter
``hash < threshold``; documents are never sorted. The threshold of a larger
budget is never smaller, so mixes of one corpus nest.

Only DataFrame expressions run; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, word_count

#: Default weights, dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Bits of the hash, and bits by which a boundary bucket is refined.
HASH_BITS, STEP_BITS = 60, 15


def _hash60(df: DataFrame):
    """60 bits of md5 of id and text: rows that agree in both are indivisible."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.md5(F.concat(name, F.lit("|"), text_or_empty()).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """(source, source_size) -> + weight, target.

    Targets share ``share`` times all sizes by weight, none above ``cap`` times its
    source. Resharing the excess until none is above is water filling: with the
    sources ordered by cap/weight, a source is capped if the level that the sources
    before it leave is not below its own. The windows have no partition; they run
    over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight_list = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.withColumn("_n", F.row_number().over(order))
        .withColumn(
            "weight", F.element_at(weight_list, (F.col("_n") - 1) % len(weights) + 1)
        )
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
    )
    before = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn(
            "_budget", F.sum("source_size").over(everything) * F.lit(float(share))
        )
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_caps_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn(
            "_weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0))
        )
        .withColumn(
            "_capped",
            (F.col("_budget") - F.col("_caps_before"))
            >= F.col("_ratio") * (F.col("_weights") - F.col("_weights_before")),
        )
    )
    level = (
        F.col("_budget")
        - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(everything)
    ) / F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    return rows.withColumn(
        "target",
        F.when(F.col("_capped"), F.col("_cap")).otherwise(level * F.col("weight")),
    ).select("source", "source_size", "weight", "target", F.col("_n").alias("sid"))


def _boundary(rows: DataFrame, shift: int) -> DataFrame:
    """The bucket ``h >> shift`` of each source in which its budget ``rest`` ends,
    and the words before that bucket. ``rows``: sid, h, size, rest, before."""
    histogram = (
        rows.withColumn("bucket", F.shiftright("h", shift))
        .groupBy("sid", "bucket", "rest", "before")
        .agg(F.sum("size").alias("in_bucket"))
    )
    running = Window.partitionBy("sid").orderBy("bucket")
    summed = histogram.withColumn(
        "upto", F.col("before") + F.sum("in_bucket").over(running)
    ).withColumn("start", F.col("upto") - F.col("in_bucket"))
    return summed.filter(
        (F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("upto"))
    ).select("sid", "bucket", "start", "in_bucket")


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Decide how many words of each document the mix takes.

    ``docs`` needs doc_id, text and source. Returns doc_id, source, size,
    source_size, target, taken, one row per input row. A source whose target
    exceeds its size is taken whole as often as the target allows, and the rest of
    the target once more up to the hash threshold. The document at the threshold is
    taken if that brings the source nearer to its target.

    Null text: size 0, taken 0. Null source: a source of its own, last in order.
    Null doc_id: hashed as an empty id. Repeated rows (same id and text) share one
    hash and one decision. A source without words: target 0. Empty table: no rows.
    Further columns of ``docs`` are ignored, but those of ``carry``, whatever their
    names, are returned as one struct ``carried``.
    """
    carried = ("carried",) if carry else ()
    box = [F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []
    base = materialize(
        docs.select(
            "doc_id",
            *box,
            F.col("source").cast("string").alias("source"),
            word_count(text_or_empty()).alias("size"),
            _hash60(docs).alias("h"),
        ),
        "mix-base",
    )
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = (
        source_targets(sizes, weights, share, cap)
        .withColumn(
            "full",
            F.when(
                F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
            ).otherwise(F.lit(0)),
        )
        .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    )
    targets = materialize(targets, "mix-targets")
    #: A source without a rest has no boundary.
    wanted = targets.filter("rest > 0").select(
        F.col("source").alias("_source"), "sid", "rest", F.lit(0).cast("long").alias("before")
    )
    rows = base.join(wanted, base["source"].eqNullSafe(wanted["_source"])).select(
        "sid", "h", "size", "rest", "before"
    )
    shift = HASH_BITS
    while shift > 0:
        shift -= STEP_BITS
        edge = materialize(_boundary(rows, shift), "mix-edge")
        if shift == 0:
            break
        narrowed = (
            rows.drop("before")
            .withColumn("bucket", F.shiftright("h", shift))
            .join(edge.select("sid", "bucket", F.col("start").alias("before")), ["sid", "bucket"])
            .drop("bucket")
        )
        rows = materialize(narrowed, "mix-rows")
    nearer = F.abs(F.col("start") + F.col("in_bucket") - F.col("rest")) < F.abs(
        F.col("start") - F.col("rest")
    )
    thresholds = (
        targets.filter("rest > 0")
        .join(edge, "sid")
        .select("sid", F.when(nearer, F.col("bucket") + 1).otherwise(F.col("bucket")).alias("below"))
    )
    ready = materialize(
        targets.join(thresholds, "sid", "left").select(
            F.col("source").alias("_source"),
            "source_size",
            "target",
            "full",
            F.coalesce("below", F.lit(0).cast("long")).alias("below"),
        ),
        "mix-thresholds",
    )
    once_more = F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return base.join(ready, base["source"].eqNullSafe(ready["_source"])).select(
        "doc_id",
        *carried,
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("full") + once_more)).cast("long").alias("taken"),
    )


def op6(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_sql(documents: str = "documents") -> str:
    """The same mix, with sorted running sums in place of histograms."""
    return rf"""
WITH base AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM {documents}),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighted AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM sizes),
ratios AS (
  SELECT *, CAST([5, 2, 1][(n - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS most FROM weighted),
levels AS (
  SELECT *, most / weight AS ratio,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS weights,
         coalesce(sum(most) OVER (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
         coalesce(sum(weight) OVER (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_before
  FROM ratios),
capped AS (SELECT *, budget - caps_before >= ratio * (weights - weights_before) AS is_capped FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_capped THEN most ELSE
           (budget - sum(CASE WHEN is_capped THEN most ELSE 0 END) OVER ())
           / sum(CASE WHEN is_capped THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM capped),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
hashes AS (
  SELECT b.source, b.h, any_value(p.target - p.whole * p.source_size) AS rest, sum(b.size) AS here
  FROM base b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source GROUP BY b.source, b.h),
running AS (
  SELECT *, sum(here) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes),
chosen AS (
  SELECT source, h,
         upto < rest OR (rest > 0 AND upto - here < rest AND abs(upto - rest) < abs(upto - here - rest)) AS again
  FROM running)
SELECT b.doc_id, b.size, p.source_size, p.target,
       CAST(b.size * (p.whole + CASE WHEN c.again THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM base b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source
JOIN chosen c ON b.source IS NOT DISTINCT FROM c.source AND b.h = c.h
"""
