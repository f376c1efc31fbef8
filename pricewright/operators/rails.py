"""Rails over recorded prices: history by size, identities, new, back and in season,
biggest drops, collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.columns import let
from ..functions.lexicon import Lexicon
from . import gates, history
from .resolve import spread_join


def price_identity(store: Column, region: Column, name: Column, name_ar: Column, size: Column) -> Column:
    """An id for a product of a store across weeks, from names in both languages and
    the size; null for names of fewer than two words, of which no history is kept."""

    def of(names):
        key = F.concat_ws("|", F.coalesce(store, F.lit("")), F.coalesce(region, F.lit("")), names, size_key(size))
        return F.when(F.size(F.split(names, " ")) >= 2, F.concat(F.lit("ph_"), F.substring(F.sha2(key, 256), 1, 16)))

    return let(text.normalize(F.concat_ws(" ", name, name_ar)), of)


def size_key(size: Column) -> Column:
    """"ml:500.0"; '' without a size."""
    return let(size, lambda s: F.coalesce(F.concat_ws(":", s["unit"], F.when(s["unit"].isNotNull(), s["total"].cast("string"))), F.lit("")))


def variants(rows: DataFrame, per: list[str], price: str, day: str, store: str, order: list[str]) -> DataFrame:
    """Per product and size (``per``): lowest with place and day, highest, weeks, first
    and last day (``history.derive``), + latest: the last price of each store, cheapest
    first; trend: that of the last price against the one before it (down, up, flat; null
    for a single one)."""
    base = history.derive(rows, per, price, day, store, order)
    when = F.struct(day, *order)
    last = rows.groupBy(*per, store).agg(F.max_by(F.col(price), when).alias("_p"))
    latest = last.groupBy(*per).agg(F.array_sort(F.collect_list(F.struct(F.col("_p").alias("price"), F.col(store).alias("store")))).alias("latest"))
    two = F.slice(F.sort_array(F.collect_list(F.struct(day, *order, F.col(price).alias("price"))), asc=False), 1, 2)
    # the two newest rows of each store are enough for the two newest of all
    newest = Window.partitionBy(*per, store).orderBy(F.col(day).desc(), *[F.col(o).desc() for o in order])
    few = rows.withColumn("_rn", F.row_number().over(newest)).filter("_rn <= 2")
    trend = few.groupBy(*per).agg(two.alias("_two")).withColumn("_step", F.get("_two", F.lit(0))["price"] - F.get("_two", F.lit(1))["price"])
    trend = trend.select(*per, F.when(F.col("_step") < 0, "down").when(F.col("_step") > 0, "up").when(F.col("_step") == 0, "flat").alias("trend"))
    return base.join(latest, per).join(trend, per)


def history_read(candidates: DataFrame, observations: DataFrame, lexicon: Lexicon, price: str, day: str, store: str, order: list[str]) -> DataFrame:
    """The price history that answers each query: of its candidate products (``ord``, with
    ``q`` and ``it``) those that pass the gates of histories, their ``observations`` (by
    ``ord``) together by size: query_id, size and the columns of ``variants``. Under two
    weeks the verdict of such a record is that it is still building (``history.verdict``)."""
    kept = gates.gate_ladder(gates.interpret(candidates, lexicon), lexicon, "history").filter("dropped_by IS NULL")
    rows = observations.join(kept.select("query_id", "ord", size_key(F.col("it.size")).alias("size")), "ord")
    return variants(rows, ["query_id", "size"], price, day, store, order)


def new_this_week(rows: DataFrame, per: list[str], day: str, today: Column) -> DataFrame:
    """Products first seen in the ISO week of ``today``."""
    week = lambda c: F.date_trunc("week", c.cast("timestamp"))
    return rows.groupBy(*per).agg(F.min(day).alias("first_seen")).filter(week(F.col("first_seen")) == week(today))


#: Weeks of an aisle's own average, and how far above it a season is.
SEASON_WEEKS, SEASON_FACTOR = 8, 2.0


def in_season(rows: DataFrame, aisle: str, day: str) -> DataFrame:
    """Weeks in which an aisle's share of all offers is at least twice its average over
    the eight weeks before: aisle, week, share, usual. Weeks without an offer of the
    aisle count as 0 as long as there are offers at all."""
    weekly = rows.withColumn("week", F.date_trunc("week", F.col(day).cast("timestamp"))).groupBy("week", aisle).agg(F.count("*").alias("n"))
    totals = weekly.groupBy("week").agg(F.sum("n").alias("all"))
    numbered = totals.withColumn("no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("week")))  # a row per week
    shares = spread_join(weekly, numbered, ["week"]).withColumn("share", F.col("n") / F.col("all"))
    before = Window.partitionBy(aisle).orderBy("no").rangeBetween(-SEASON_WEEKS, -1)
    usual = F.sum("share").over(before) / SEASON_WEEKS
    return shares.withColumn("usual", usual).filter((F.col("no") > SEASON_WEEKS) & (F.col("share") >= SEASON_FACTOR * F.coalesce("usual", F.lit(0.0)))).select(
        aisle, F.col("week").cast("date").alias("week"), "share", F.coalesce("usual", F.lit(0.0)).alias("usual")
    )


def biggest_drops(rows: DataFrame, per: str, old: str, price: str, order: list[str], n: int) -> DataFrame:
    """Per group the n offers that are the largest share under an earlier price."""
    share = (F.col(old) - F.col(price)) / F.col(old)
    window = Window.partitionBy(per).orderBy(F.col("share").desc(), *order)
    cut = rows.filter((F.col(old) > F.col(price)) & (F.col(old) > 0)).withColumn("share", share)
    return cut.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def with_history_badges(offers: DataFrame, identities: DataFrame, identity: str = "identity", least_weeks: int = 4) -> DataFrame:
    """Offers with the depth of their identity's history, and lowest_weeks where they
    are at or under its lowest price and the history is deep enough. Offers without an
    identity or a history stay."""
    known = identities.select(identity, "lowest", "weeks")
    rows = spread_join(offers, known, [identity], "left")
    low = (F.col("price") <= F.col("lowest")) & (F.col("weeks") >= least_weeks)
    return rows.withColumn("lowest_weeks", F.when(low, F.col("weeks")))


def in_collections(offers: DataFrame, collections: DataFrame, calendar: DataFrame, today: Column) -> DataFrame:
    """Offers of the collections that show today. A collection (collection, aisles,
    families, window) has those of its aisles and families (null: any); with a window
    it shows on that window's days (calendar: window, first, last) only."""
    open_ = calendar.filter((today >= F.col("first")) & (today <= F.col("last"))).select("window").distinct()
    shown = collections.filter("window IS NULL").unionByName(collections.join(open_, "window", "left_semi"))
    by_aisle = shown.filter("aisles IS NOT NULL").withColumn("_aisle", F.explode(F.array_distinct("aisles")))
    fits = F.col("families").isNull() | F.array_contains("families", F.col("family"))
    aisled = offers.join(by_aisle, offers["aisle"] == by_aisle["_aisle"]).drop("_aisle")
    by_family = shown.filter("aisles IS NULL AND families IS NOT NULL").withColumn("_family", F.explode(F.array_distinct("families")))
    named = offers.join(by_family, offers["family"] == by_family["_family"]).drop("_family")
    # those of any aisle and family are one array, a row of each offer for each of them
    every = shown.filter("aisles IS NULL AND families IS NULL").agg(F.collect_set("collection")).scalar()
    whole = offers.withColumn("collection", every).withColumn("collection", F.explode("collection"))
    columns = [*offers.columns, "collection"]
    return aisled.filter(fits).select(*columns).unionByName(named.select(*columns)).unionByName(whole.select(*columns))
