"""Keyed upserts and small state tables, as DataFrame rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .resolve import large_join


def latest_by_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the last under ``order``."""
    newest = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """``table`` with rows of ``changes`` in place of, or beside, its own. Of several
    changes of one key the first under ``order`` counts, without an order any one; null
    is a key like others."""
    once = latest_by_key(changes, keys, order) if order else changes.dropDuplicates(keys)
    named = once.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return once.unionByName(table.join(named, same, "left_anti"))


def ingest(offers: DataFrame, brochures: DataFrame) -> DataFrame:
    """Offers with a sane price (above 0, and not above an earlier one) and the brochure
    of their edition, null if none is held. ``brochures``: edition, brochure."""
    sane = (F.col("price") > 0) & (F.col("old_price").isNull() | (F.col("old_price") >= F.col("price")))
    return large_join(offers.filter(sane), brochures.dropDuplicates(["edition"]), ["edition"], "left")


def apply_cart_events(events: DataFrame) -> DataFrame:
    """Cart state from ordered events (cart, item, ord, action, qty): add raises the
    quantity, set replaces it (0 to 99), remove and set 0 delete, toggle flips
    purchased. One fold per item over its own events."""
    step = F.struct("ord", "action", "qty")
    held = events.groupBy("cart", "item").agg(F.array_sort(F.collect_list(step)).alias("_log"))
    start = F.struct(F.lit(0).alias("qty"), F.lit(False).alias("purchased"))

    def fold(acc, e):
        qty = (
            F.when(e["action"] == "add", F.least(acc["qty"] + F.coalesce(e["qty"], F.lit(1)), F.lit(99)))
            .when(e["action"] == "set", F.greatest(F.lit(0), F.least(F.coalesce(e["qty"], F.lit(0)), F.lit(99))))
            .when(e["action"] == "remove", 0)
            .otherwise(acc["qty"])
        )
        flipped = (e["action"] == "toggle") & (acc["qty"] > 0)
        bought = F.when(flipped, ~acc["purchased"]).when(qty == 0, False).otherwise(acc["purchased"])
        return F.struct(qty.cast("int").alias("qty"), bought.alias("purchased"))

    state = held.withColumn("_s", F.aggregate("_log", start, fold))
    return state.filter("_s.qty > 0").select("cart", "item", "_s.qty", "_s.purchased")


def newest_distinct(rows: DataFrame, per: list[str], value: str, when: list, keep: int) -> DataFrame:
    """Per group the newest ``keep`` values, case-insensitively distinct: + rank."""
    folded = rows.withColumn("_key", F.lower(value))
    once = latest_by_key(folded, [*per, "_key"], when)
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*when)))
    return ranked.filter(F.col("rank") <= keep).drop("_key")
