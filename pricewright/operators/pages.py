"""Pages of an ordered list without sorting the list.

A page after a known row (``next_page``) needs the first rows behind that row's keys only,
which every task finds for itself. A page by its number (``numbered_pages``) first counts
rows in slices of the order's leading number, then sorts only the slices that it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import spread_join

#: Slices of a number's range that are counted.
SLICES = 4096


def sort_columns(keys: list[tuple[str, str]]) -> list[Column]:
    """``keys``: (column, 'asc' or 'desc'), nulls last."""
    return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in keys]


def behind(keys: list[tuple[str, str]], last: dict) -> Column:
    """Whether a row comes behind one with the key values ``last``."""
    found, same = F.lit(False), F.lit(True)
    for c, way in keys:
        value = last[c]
        if value is None:  # nulls are last, so nothing is behind them by this key
            later = F.lit(False)
        else:
            later = (F.col(c) < F.lit(value) if way == "desc" else F.col(c) > F.lit(value)) | F.col(c).isNull()
        found = found | (same & F.coalesce(later, F.lit(False)))
        same = same & F.col(c).eqNullSafe(F.lit(value))
    return found


def next_page(rows: DataFrame, keys: list[tuple[str, str]], size: int, last: dict | None = None) -> DataFrame:
    """The first ``size`` rows in order, or those behind the row whose values of the keys
    are ``last``. The keys together tell rows apart."""
    if size < 1:
        raise ValueError("no such page")
    rows = rows if last is None else rows.filter(behind(keys, last))
    return rows.orderBy(*sort_columns(keys)).limit(size)


def _narrowed(rows: DataFrame, per: list[str], column: str, way: str, settled: Column, first: int, last: int) -> DataFrame:
    """The rows of the slices of ``column`` that hold positions ``first`` to ``last`` of
    each group, with the rows before them added to _before. A group of which an earlier
    key still varies (not ``settled``) stays as it is."""
    number = F.unix_date(column) if dict(rows.dtypes)[column] == "date" else F.col(column)
    value = number.cast("double") * (-1 if way == "desc" else 1)
    rows = rows.withColumn("_value", value)
    ends = rows.groupBy(*per).agg(F.min("_value").alias("_least"), F.max("_value").alias("_most"), settled.alias("_settled"))
    wide = F.col("_most") - F.col("_least")
    slice_ = F.when(F.col("_value").isNull(), SLICES).otherwise(F.coalesce(F.floor((F.col("_value") - F.col("_least")) / F.nullif(wide, F.lit(0.0)) * (SLICES - 1)), F.lit(0)))
    rows = spread_join(rows, ends, per).withColumn("_slice", F.when(F.col("_settled"), slice_).otherwise(0).cast("int"))
    counts = rows.groupBy(*per, "_slice", "_before").agg(F.count("*").alias("n"))  # SLICES + 1 a group at most
    upto = F.sum("n").over(Window.partitionBy(*per).orderBy("_slice"))
    counts = counts.withColumn("_start", F.col("_before") + upto - F.col("n"))
    held = counts.filter((F.col("_start") < last) & (F.col("_start") + F.col("n") >= first))
    held = held.withColumn("_new", F.min("_start").over(Window.partitionBy(*per))).select(*per, "_slice", "_new")
    return spread_join(rows, held, [*per, "_slice"]).withColumn("_before", F.col("_new")).drop("_value", "_least", "_most", "_settled", "_slice", "_new")


def numbered_pages(rows: DataFrame, per: list[str], keys: list[tuple[str, str]], first: int, last: int, numbers: int = 2) -> DataFrame:
    """Rows ``first`` to ``last`` (from 1) of each group in order, + position. The first
    ``numbers`` keys are numbers, days or times; of each only the slices around the page go on, the
    second where the first no longer varies. Groups have no null in ``per``."""
    rows, before = rows.withColumn("_before", F.lit(0).cast("long")), []
    for column, way in keys[:numbers]:
        settled = F.lit(True)
        for c in before:
            settled = settled & F.coalesce(F.min(c) == F.max(c), F.lit(False)) & (F.count(c) == F.count("*"))
        rows = _narrowed(rows, per, column, way, F.first(F.lit(True)) if not before else settled, first, last)
        before.append(column)
    place = F.row_number().over(Window.partitionBy(*per).orderBy(*sort_columns(keys))) + F.col("_before")
    return rows.withColumn("position", place).filter(F.col("position").between(first, last)).drop("_before")
