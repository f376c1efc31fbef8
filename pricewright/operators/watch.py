"""Price watches: states, refresh reasons and crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9
STALE_HOURS = 26
ANCHORED = ("anchored_registry", "anchored_source", "anchored_spec")


def anchor_state(state: Column, product: Column, spec: Column) -> Column:
    return F.coalesce(
        state, F.when(product.isNotNull(), "anchored_registry").when(spec.isNotNull(), "anchored_spec").otherwise("resolving")
    )


def watch_state(last: Column, target: Column, close_percent: Column, anchored: Column | None = None) -> Column:
    """deal at or under the target, close within the threshold above it, else
    watching; unanchored before all."""
    deal = last <= target + EPSILON
    close = last <= target * (1 + close_percent / 100) + EPSILON
    out = F.when(F.coalesce(deal, F.lit(False)), "deal").when(F.coalesce(close, F.lit(False)), "close").otherwise("watching")
    return out if anchored is None else F.when(~anchored, "unanchored").otherwise(out)


def refresh_reason(active: Column, anchored: Column, health: Column, checked: Column, now: Column) -> Column:
    stale = F.unix_timestamp(now) - F.unix_timestamp(checked) >= STALE_HOURS * 3600
    return (
        F.when(~(F.coalesce(active, F.lit(True)) & anchored), None)
        .when(health == "provider_error", "provider_failure")
        .when((health == "unchecked") | checked.isNull(), "not_yet_checked")
        .when(stale, "stale")
    )


def crossings(rows: DataFrame, per: list[str], order: list[str], value: str, target: Column) -> DataFrame:
    """Rows at which a watch fires: the value falls to the target or under it after
    one above it, or at the first value. A null value neither fires nor arms."""
    known = rows.filter(F.col(value).isNotNull()).withColumn("_below", F.col(value) <= target)
    before = F.lag("_below").over(Window.partitionBy(*per).orderBy(*order))
    return known.withColumn("_was", F.coalesce(before, F.lit(False))).filter("_below AND NOT _was").drop("_below", "_was")
