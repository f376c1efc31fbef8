"""Grouped statistics in which the first of equals wins and medians are upper ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import spread_join

OUTLIER = 6.0
#: Steps of the histogram in which a median is looked for, per unit of asinh.
FINE = 256
#: Prices this near are one price.
SAME_PRICE = 0.005


def first_wins(rows: DataFrame, per: list[str], order: list) -> DataFrame:
    """The first row of each group under an order that ends in an ordinal."""
    window = Window.partitionBy(*per).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def first_of_group(rows: DataFrame, per: list[str], order: list[str]) -> DataFrame:
    """As ``first_wins`` for ascending orders without nulls, by a partial minimum of
    (order, other columns): groups shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in per and c not in order]
    least = F.min(F.struct(*order, *rest)).alias("_least")
    return rows.groupBy(*per).agg(least).select(*per, "_least.*").select(*rows.columns)


def _middle(counts: DataFrame, per: list[str], value: str) -> DataFrame:
    """The value of each group at which ``rank`` of its rows (counted in ``n``) is
    reached, with the rank left within that value."""
    order = Window.partitionBy(*per).orderBy(value)
    before = F.sum("n").over(order) - F.col("n")
    return counts.withColumn("_before", before).filter((F.col("_before") < F.col("rank")) & (F.col("rank") <= F.col("_before") + F.col("n"))).select(
        *per, value, (F.col("rank") - F.col("_before")).alias("rank")
    )


def upper_medians(rows: DataFrame, per: list[str], value: str, name: str) -> DataFrame:
    """Per group its upper median, sorted[floor(n / 2)], and the rows that have a
    value (``name``_of). Counts in a histogram find the bucket of the median, and
    counts of the distinct values in that bucket alone the median itself, so no group
    is sorted or held whole. Null values count nothing."""
    rows = rows.filter(F.col(value).isNotNull()).select(*per, F.col(value).alias("_v"))
    rows = rows.withColumn("_bucket", F.floor(F.asinh("_v") * FINE))
    total = F.sum("n").over(Window.partitionBy(*per))
    buckets = rows.groupBy(*per, "_bucket").agg(F.count("*").alias("n"))
    sized = buckets.withColumn("_of", total).withColumn("rank", F.floor(F.col("_of") / 2) + 1)
    sizes = sized.groupBy(*per).agg(F.max("_of").alias(f"{name}_of"))
    edge = _middle(sized, per, "_bucket")
    inside = spread_join(rows, edge, [*per, "_bucket"])
    values = inside.groupBy(*per, "_v", "rank").agg(F.count("*").alias("n"))
    return _middle(values, per, "_v").select(*per, F.col("_v").alias(name)).join(sizes, per)


def with_upper_median(rows: DataFrame, per: list[str], value: str, name: str) -> DataFrame:
    """+ the group's upper median and size; null for groups without a value."""
    return spread_join(rows, upper_medians(rows, per, value, name), per, "left")


def plausible(value: Column, median: Column, factor: float = OUTLIER) -> Column:
    return (value <= median * factor) & (value >= median / factor)


def best_value(rows: DataFrame, per: list[str], value: str, order: list[str]) -> DataFrame:
    """Per group of two rows or more its row of least value within the outlier
    guard: + pool (rows compared) and dropped. With under two plausible rows the
    guard is not applied. ``order`` has no nulls; null values are not compared."""
    columns = rows.columns
    rows = with_upper_median(rows.filter(F.col(value).isNotNull()), per, value, "_median").filter("_median_of >= 2")
    ok = plausible(F.col(value), F.col("_median"))
    rest = [c for c in columns if c not in per and c not in order and c != value]
    row = F.struct(value, *order, *rest)
    found = rows.groupBy(*per).agg(
        F.min(F.when(ok, row)).alias("_guarded"), F.min(row).alias("_least"), F.count_if(ok).alias("_kept"), F.count("*").alias("_n")
    )
    guarded = F.col("_kept") >= 2
    found = found.withColumn("_row", F.when(guarded, F.col("_guarded")).otherwise(F.col("_least")))
    found = found.withColumn("pool", F.when(guarded, F.col("_kept")).otherwise(F.col("_n")).cast("long"))
    return found.withColumn("dropped", (F.col("_n") - F.col("pool")).cast("long")).select(*per, "_row.*", "pool", "dropped").select(*columns, "pool", "dropped")


def dominant_group(rows: DataFrame, per: list[str], group: str, order: str) -> DataFrame:
    """The rows of each group's commonest ``group`` value; of equals the one whose
    first row by ``order`` comes first. Rows without a value are in none."""
    most = dominant(rows.filter(F.col(group).isNotNull()), per, group, order).drop("n")
    return spread_join(rows, most.withColumnRenamed(group, "_most"), per).filter(F.col(group) == F.col("_most")).drop("_most")


def unit_outliers(rows: DataFrame, per: list[str], value: str) -> DataFrame:
    """Rows of groups of three or more that lie outside the guard."""
    rows = with_upper_median(rows, per, value, "_median")
    return rows.filter("_median_of >= 3").filter(~plausible(F.col(value), F.col("_median"))).drop("_median", "_median_of")


def dominant(rows: DataFrame, per: list[str], value: str, order: str) -> DataFrame:
    """Per group its commonest value; of equals the one seen first by ``order``."""
    counts = rows.groupBy(*per, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return first_wins(counts, per, [F.col("n").desc(), "_first"]).drop("_first")


def price_penalty(price: Column, median: Column) -> Column:
    """0 within half to double of the median, then growing with log distance to 2.5."""
    away = F.abs(F.log2(price / median))
    return F.when(median.isNull() | (price <= 0) | (away <= 1), 0.0).otherwise(F.least(F.lit(2.5), (away - 1) * 1.6))


def discount_percent(old: Column, price: Column) -> Column:
    return F.when((old > price) & (old > 0), (old - price) / old * 100)


def discount_state(percent: Column) -> Column:
    return F.when(percent.isNull(), "none").when(percent < 15, "low").when(percent <= 45, "mid").otherwise("high")


def headline(cheapest: Column, cheapest_unit: Column, best: Column, best_unit: Column) -> Column:
    """best-buy if the best value is also the cheapest, or hardly better; best-value
    if it is over 10% better or cannot be compared; cheapest without one."""
    return (
        F.when(best.isNull(), "cheapest")
        .when(best == cheapest, "best-buy")
        .when(cheapest_unit.isNull() | (best_unit <= cheapest_unit * 0.9), "best-value")
        .otherwise("best-buy")
    )


def confidence(grouped: Column, valued: Column) -> Column:
    return F.when(grouped, "high").when(valued, "medium").otherwise("low")
