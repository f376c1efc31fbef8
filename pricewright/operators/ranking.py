"""The three orderings of a result grid, as sort keys that end in an ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import stage_band


def price_keys() -> list[Column]:
    """Cheaper first, rows without a price last, then the more relevant."""
    return [F.col("price").asc_nulls_last(), F.col("rel").desc(), F.col("ord").asc()]


def family_band(target: Column, own: Column, rel: Column) -> Column:
    """Under a query that names a family 3 same, 2 unknown, 0 other; else by
    relevance 2, 1, 0."""
    named = F.when(own == target, 3).when(own.isNull(), 2).otherwise(0)
    return F.when(target.isNotNull(), named).otherwise(F.when(rel >= 75, 2).when(rel >= 45, 1).otherwise(0))


def sort_keys(order: str) -> list[Column]:
    """Keys over stage, band, several (words in the query), target_family, price,
    rel, unit_value, unit, dominant_unit, featured, ord."""
    top = stage_band(F.col("stage"), F.col("several"), "primary")
    if order == "price":
        best = F.when(F.col("several"), 2).otherwise(4)
        genuine = (top >= best) & (F.col("target_family").isNull() | (F.col("band") >= 2))
        tail = lambda c: F.when(~genuine, c)
        return [genuine.desc(), tail(top).desc(), tail(F.col("band")).desc(), *price_keys()]
    keys = [F.col("stage").desc(), F.col("band").desc()]
    if order == "value":
        inside = F.coalesce(F.col("unit") == F.col("dominant_unit"), F.lit(False))
        keys += [inside.desc(), F.when(inside, F.col("unit_value")).asc()]
    elif order == "featured":
        keys.append(F.col("featured").desc())
    else:
        raise ValueError(f"no such ordering: {order}")
    return [*keys, *price_keys()]


def ranked(rows: DataFrame, order: str, per: str = "query_id", top: int | None = None) -> DataFrame:
    """+ rank within each query; only the first ``top`` if given."""
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*sort_keys(order))))
    return rows.filter(F.col("rank") <= top) if top else rows


def featured_score(curated: Column, discount: Column, learned: Column, penalty: Column) -> Column:
    """Curated at most 2, a deal at most 0.6, learned at most 1.5, less a penalty."""
    return (
        F.least(F.lit(2.0), curated) + F.least(discount, F.lit(0.5)) * 1.2 + F.least(F.lit(1.5), learned) - penalty
    )


def learned_boost(count: Column) -> Column:
    return F.least(count, F.lit(20)) / 20 * 0.75


def by_relevance(rows: DataFrame, per: str = "query_id", top: int | None = None) -> DataFrame:
    """+ rank by relevance, equals in source order."""
    order = Window.partitionBy(per).orderBy(F.col("rel").desc(), "ord")
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows.filter(F.col("rank") <= top) if top else rows
