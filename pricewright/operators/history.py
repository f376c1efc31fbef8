"""Price history: change points, running lows, verdicts and deal scores.

What a row needs from the rows before it comes in two passes. An identity's rows are cut
into segments of whole weeks; a summary of each segment (last price, least price, weeks)
is carried over the segments before, one row each; windows then run inside a segment and
start from what was carried. So an identity with any share of all rows is as many tasks
as it has segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import size, text
from . import statistics

EPSILON, NEAR = 1e-9, 0.1
#: Weeks of a segment.
SEGMENT_WEEKS = 4


def week_of(day: str) -> Column:
    return F.date_trunc("week", F.col(day).cast("timestamp"))


def segmented(rows: DataFrame, per: list[str], order: list[str], weeks: int = SEGMENT_WEEKS) -> DataFrame:
    """+ _segment: the identity (``per``; nulls are equal) and the number of the weeks in
    which a row lies. ``order`` begins with the day."""
    number = F.floor(F.datediff(week_of(order[0]).cast("date"), F.lit("1970-01-05").cast("date")) / (7 * weeks))
    return rows.withColumn("_segment", F.struct(*per, number.alias("_number")))


def carried(rows: DataFrame, per: list[str], **summaries: tuple[Column, str]) -> DataFrame:
    """Segmented ``rows`` + a column for each summary: an aggregate of a segment, brought
    together over all segments of the identity before the row's by 'last', 'min', 'max'
    or 'sum'."""
    found = rows.groupBy("_segment").agg(*[a.alias(n) for n, (a, _) in summaries.items()])
    before = Window.partitionBy(*[F.col("_segment")[c] for c in per]).orderBy("_segment._number").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each segment
    found = found.select("_segment", *[getattr(F, how)(n).over(before).alias(n) for n, (_, how) in summaries.items()])
    return rows.join(found, "_segment")


def inside(order: list[str]):
    """The rows of a segment in order."""
    return Window.partitionBy("_segment").orderBy(*order)


def row_before(value: Column, carry: str, order: list[str]) -> Column:
    """The value of the row before: in the segment, or what was carried to its first."""
    return F.when(F.row_number().over(inside(order)) == 1, F.col(carry)).otherwise(F.lag(value).over(inside(order)))


def _last(value: str, order: list[str]) -> Column:
    return F.max_by(value, F.struct(*order))


def with_previous(rows: DataFrame, per: list[str], order: list[str], price: str, point: str) -> DataFrame:
    """+ previous: the price before, and whether a row is a ``point``: differs from it."""
    rows = carried(segmented(rows, per, order), per, _price=(_last(price, order), "last"))
    rows = rows.withColumn("previous", row_before(F.col(price), "_price", order)).drop("_price", "_segment")
    return rows.withColumn(point, F.col("previous").isNull() | F.coalesce(F.col("previous") != F.col(price), F.lit(False)))


def change_points(rows: DataFrame, per: list[str], order: list[str], price: str) -> DataFrame:
    """Only the observations at which the price differs from the one before."""
    return with_previous(rows, per, order, price, "_point").filter("_point").drop("_point")


def _with_lows(rows: DataFrame, order: list[str], price: str) -> DataFrame:
    """Rows with _low and _count carried -> + low_before, depth, is_lowest."""
    earlier = inside(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "low_before": F.least("_low", F.min(price).over(earlier)),
            "depth": F.coalesce("_count", F.lit(0)) + F.count(price).over(earlier),
        }
    )
    return rows.withColumn("is_lowest", F.coalesce(F.col(price) <= F.col("low_before"), F.lit(False))).drop("_low", "_count")


def lowest_so_far(rows: DataFrame, per: list[str], order: list[str], price: str) -> DataFrame:
    """+ low_before: the least price of earlier rows; is_lowest: at or under it."""
    rows = carried(segmented(rows, per, order), per, _low=(F.min(price), "min"), _count=(F.count(price), "sum"))
    return _with_lows(rows, order, price).drop("_segment")


def verdict(today: Column, low: Column, weeks: Column) -> Column:
    return (
        F.when(weeks < 2, "building")
        .when(today <= low + EPSILON, "at-low")
        .when((today - low) / low <= NEAR, "near-low")
        .otherwise("above-low")
    )


def derive(rows: DataFrame, per: list[str], price: str, day: str, store: str, order: list[str]) -> DataFrame:
    """Per variant: lowest price with its place and day (first wins), highest, weeks
    seen, first and last day, observations."""
    least = F.min(F.struct(F.col(price).alias("price"), *[F.col(o) for o in order], F.col(store).alias("store"), F.col(day).alias("day")))
    return rows.groupBy(*per).agg(
        least["price"].alias("lowest"),
        least["store"].alias("lowest_store"),
        least["day"].alias("lowest_day"),
        F.max(price).alias("highest"),
        F.count_distinct(F.date_trunc("week", F.col(day).cast("timestamp"))).alias("weeks"),
        F.min(day).alias("first_seen"),
        F.max(day).alias("last_seen"),
        F.count("*").alias("observations"),
    )


def back_on_offer(rows: DataFrame, per: list[str], order: list[str], day: str, gap_days: int = 28) -> DataFrame:
    """+ gap_days since the row before; returned after a long gap."""
    rows = carried(segmented(rows, per, order), per, _day=(_last(day, order), "last"))
    gap = F.datediff(F.col(day), row_before(F.col(day), "_day", order))
    return rows.withColumn("gap_days", gap).drop("_day", "_segment").withColumn("back", F.coalesce(F.col("gap_days") >= gap_days, F.lit(False)))


#: Points of an exceptional deal, and the score that qualifies.
LOWEST_POINTS, DEEP_POINTS, BIG_POINTS, RARE_POINTS, MULTI_POINTS, RETURN_POINTS = 50, 30, 15, 20, 10, 15
QUALIFIES = 50
#: Weeks seen for a lowest ever, advertised drops in percent, weeks known
#: and share of them on offer for a rarity, days away for a return.
LEAST_WEEKS, DEEP_DROP, BIG_DROP, KNOWN_WEEKS, RARE_SHARE, AWAY_DAYS = 4, 40, 25, 8, 0.25, 28
#: A gift in normalized words, and what a product is only free of.
GIFT = "(^| )(free|مجانا)( |$)"
FREE_OF = "(^| )(sugar|gluten|fat|lactose|dairy|salt|caffeine|alcohol|cholesterol) free( |$)"


def multi_buy(name: Column) -> Column:
    """Whether a name carries a multi-buy: a plausible "a+b", or free ones."""
    gift = F.regexp_replace(text.normalize(name), FREE_OF, " ").rlike(GIFT)
    return size.bonus_count(size.size_text(name)).isNotNull() | gift


def deal_signals(rows: DataFrame, per: list[str], order: list[str], price: str, paid: Column, listed: Column, day: str) -> DataFrame:
    """+ the inputs of ``deal_score`` but the multi-buy, from the rows up to each one.
    ``order`` begins with ``day``; every row is an offer. weeks_seen: weeks with an
    offer; weeks_known: weeks since the first; drop: percent of ``listed`` that
    ``paid`` is less; away_days: since the low was last met, if this row meets it."""
    week = week_of(day)
    rows = segmented(rows, per, order).withColumn("_week", week)
    rows = carried(rows, per, _low=(F.min(price), "min"), _count=(F.count(price), "sum"), _weeks=(F.count_distinct("_week"), "sum"), _first=(F.min("_week"), "min"))
    upto = inside(order)
    all_upto = upto.rowsBetween(Window.unboundedPreceding, 0)
    rows = _with_lows(rows, order, price)
    # segments are whole weeks, so a week begins in one only
    rows = rows.withColumn("_new", F.coalesce(F.col("_week") != F.lag("_week").over(upto), F.row_number().over(upto) == 1))
    met = F.col(price) <= F.coalesce("low_before", price) + EPSILON
    rows = rows.withColumn("_met", F.when(met, F.col(day)))
    rows = carried(rows, per, _met_before=(F.max("_met"), "max"))
    away = F.datediff(F.col(day), F.greatest("_met_before", F.max("_met").over(upto.rowsBetween(Window.unboundedPreceding, -1))))
    first = F.least("_first", F.min("_week").over(all_upto))
    return rows.withColumns(
        {
            "weeks_seen": F.coalesce("_weeks", F.lit(0)) + F.count_if("_new").over(all_upto),
            "weeks_known": F.floor(F.datediff(F.col("_week"), first) / 7) + 1,
            "drop": statistics.discount_percent(listed, paid),
            "away_days": F.when(F.abs(F.col(price) - F.col("low_before")) <= EPSILON, away),
        }
    ).drop("_week", "_new", "_met", "_met_before", "_weeks", "_first", "_segment")


def deal_score(lowest: Column, weeks_seen: Column, drop: Column, weeks_known: Column, multi: Column, away_days: Column) -> Column:
    """Points for a lowest-ever price over enough weeks, a deep or a big advertised
    cut, a product rarely on offer, a multi-buy, and a return to the low."""
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    cut = lambda percent: F.coalesce(drop >= percent - EPSILON, F.lit(False))
    return (
        points(lowest & (weeks_seen >= LEAST_WEEKS), LOWEST_POINTS)
        + F.when(cut(DEEP_DROP), DEEP_POINTS).when(cut(BIG_DROP), BIG_POINTS).otherwise(0)
        + points((weeks_known >= KNOWN_WEEKS) & (weeks_seen <= RARE_SHARE * weeks_known), RARE_POINTS)
        + points(multi, MULTI_POINTS)
        + points(away_days >= AWAY_DAYS, RETURN_POINTS)
    )
