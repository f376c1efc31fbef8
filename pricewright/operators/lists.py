"""Short ranked lists: elsewhere, similar, carts, brands, browse sorts and badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching
from ..functions.lexicon import Lexicon
from . import pages
from .resolve import spread_join

#: Rows of the lists, and how far sizes may be apart.
ELSEWHERE, SIMILAR, SIZE_SHARE, PAGE = 4, 10, 0.25, 24


def _first(rows: DataFrame, per: str, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    window = Window.partitionBy(per).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def near_size(own: Column, other: Column, share: float = SIZE_SHARE) -> Column:
    """The same unit and totals within a share of the own one; true if either size is
    unknown."""
    known = own["unit"].isNotNull() & other["unit"].isNotNull() & (own["total"] > 0)
    near = (own["unit"] == other["unit"]) & (F.abs(other["total"] - own["total"]) / own["total"] <= share)
    return ~F.coalesce(known, F.lit(False)) | F.coalesce(near, F.lit(False))


def elsewhere(pairs: DataFrame, lexicon: Lexicon, n: int = ELSEWHERE) -> DataFrame:
    """The cheapest offers of other stores that are the product: relevant by name and
    near in size. ``pairs``: query_id, q, it, ord, price, store, size, own_ord,
    own_store, own_size."""
    q, it = F.col("q"), F.col("it")
    other = (F.col("ord") != F.col("own_ord")) & (F.col("store") != F.col("own_store"))
    fit = matching.is_relevant(q, it) & (matching.relevance(q, it, lexicon) > 0) & near_size(F.col("own_size"), F.col("size"))
    return _first(pairs.filter(other & fit), "query_id", [F.col("price").asc(), F.col("ord").asc()], n)


def similar(anchors: DataFrame, items: DataFrame, n: int = SIMILAR) -> DataFrame:
    """Per anchor (id, family, form) other items of its family, forms not in conflict,
    in source order. Anchors and items of no known family have none. Items are first
    cut to the few that any anchor of a family and form can show, and these are one short
    list for the family and form, so no anchor is paired with more than it shows, and
    none is sorted. Items of no ``ord`` are never shown."""
    few = n + 1
    known = items.filter("family IS NOT NULL AND ord IS NOT NULL")
    order = Window.partitionBy("family", "form").orderBy("ord")
    known = known.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= few).select("family", F.col("form").alias("_form"), "ord")
    anchors = anchors.filter("family IS NOT NULL").select("id", "family", "form", F.coalesce("form", F.lit("")).alias("_kind"), F.col("form").isNull().alias("_any"))
    kinds = anchors.select("family", "form", "_kind", "_any").distinct()
    fit = F.col("form").isNull() | F.col("_form").isNull() | (F.col("form") == F.col("_form"))
    keys = ["family", "_kind", "_any"]
    lists = kinds.join(known, "family").filter(fit).groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("ord")), 1, few).alias("_some"))
    rows = spread_join(anchors, lists, keys)
    shown = F.slice(F.filter("_some", lambda o: o != F.col("id")), 1, n)
    return rows.select("id", F.posexplode(shown).alias("_place", "ord")).select("id", (F.col("_place") + 1).alias("rank"), "ord")


def cart_order(items: DataFrame) -> DataFrame:
    """+ place within each cart and store: what is still to buy before what is bought,
    the newest first."""
    order = Window.partitionBy("cart", "store").orderBy("purchased", F.col("added_at").desc_nulls_last(), "item")
    return items.withColumn("place", F.row_number().over(order))


def cart_counts(items: DataFrame) -> DataFrame:
    """Pieces in each cart; a missing quantity, or 0, is one."""
    return items.groupBy("cart").agg(F.sum(F.coalesce(F.nullif(F.col("qty"), F.lit(0)), F.lit(1))).alias("pieces"))


def brands_in_order(brands: DataFrame, name: str) -> DataFrame:
    """+ place in A to Z order, case and marks aside; equals by their characters."""
    order = Window.partitionBy(F.upper(F.substring(name, 1, 1))).orderBy(F.collate(name, "UNICODE_CI_AI"), name)
    return brands.withColumn("letter", F.upper(F.substring(name, 1, 1))).withColumn("place", F.row_number().over(order))


def browse_keys(sort: str) -> list[tuple[str, str]]:
    """Sorts of a browse list: discount, price, newest or ending; then the key."""
    keys = {
        "discount": [("discount", "desc"), ("price", "asc")],
        "price": [("price", "asc")],
        "newest": [("first_seen", "desc")],
        "ending": [("valid_to", "asc")],
    }
    if sort not in keys:
        raise ValueError(f"no such sort: {sort}")
    return [*keys[sort], ("ord", "asc")]


def browse_page(rows: DataFrame, filters: dict[str, str], sort: str = "discount", page: int = 0, size: int = PAGE, last: dict | None = None) -> DataFrame:
    """A page of the browse list: rows that have all of the filters' values, in order.
    Only the filters department, aisle, brand, store and family are known. Without
    ``last`` the page of that number, else the one behind the row with these keys."""
    allowed = {"department", "aisle", "brand", "store", "family"}
    if unknown := set(filters) - allowed:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    for name, value in filters.items():
        rows = rows.filter(F.col(name) == value)
    keys = browse_keys(sort)
    if page < 0 or size < 1:
        raise ValueError("no such page")
    if last is not None or page == 0:
        return pages.next_page(rows, keys, size, last)
    found = pages.numbered_pages(rows.withColumn("_list", F.lit(0)), ["_list"], keys, page * size + 1, (page + 1) * size, len(keys) - 1)
    return found.drop("_list", "position")
