"""A product registry: sightings are matched into products by tolerance.

Products: product_id, tokens (distinctive words), brand, unit, total, state, last_seen.
Sightings: sighting_id, tokens, brand, unit, total, store, week. How much of the smaller
token set the two share decides, a different size vetoes, a different brand counts
against; an exact prefix filter finds all pairs that share enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.size import TOLERANCE, within
from ..sources.store import materialize
from . import overlap
from .resolve import large_join, spread_join

#: A size bucket in logarithms, a little wider than sizes that are the same can be apart.
SIZE_BUCKET = -1.000001 * math.log(1 - TOLERANCE)
#: The bands of the score, what another brand costs, the weeks until a
#: product sleeps, and the bar for merging two.
ATTACH, REVIEW, BRAND_PENALTY, DORMANT_WEEKS, MERGE = 0.6, 0.45, 0.25, 6, 0.85


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller token set that the other has."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def size_differs(unit_a: Column, total_a: Column, unit_b: Column, total_b: Column) -> Column:
    """Both sizes known, and not the same; unknown sizes never differ."""
    known = unit_a.isNotNull() & unit_b.isNotNull() & total_a.isNotNull() & total_b.isNotNull()
    return F.coalesce(known & ((unit_a != unit_b) | ~within(total_a, total_b)), F.lit(False))


def brand_conflicts(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))


def scored_pairs(sightings: DataFrame, products: DataFrame, share: float = REVIEW) -> DataFrame:
    """sighting_id, product_id, score for all pairs of which one shares ``share`` of the
    smaller token set with the other, and whose sizes do not differ. Dormant products
    take part. No pair is lost: they come from ``overlap.contained_pairs``."""
    counts = overlap.word_counts(products, "tokens")
    pairs = overlap.contained_pairs(overlap.rare_first(sightings, "sighting_id", "tokens", counts), overlap.rare_first(products, "product_id", "tokens", counts), share)
    a, b = F.col("a"), F.col("b")
    pairs = pairs.filter(~size_differs(a["unit"], a["total"], b["unit"], b["total"]))
    penalty = F.when(brand_conflicts(F.coalesce(a["brand"], F.lit("")), F.coalesce(b["brand"], F.lit(""))), BRAND_PENALTY).otherwise(0.0)
    return pairs.select(a["sighting_id"].alias("sighting_id"), b["product_id"].alias("product_id"), (containment(a["ordered"], b["ordered"]) - penalty).alias("score"))


def resolve_sightings(sightings: DataFrame, products: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per sighting: product_id, score, band. ``attach`` and ``review`` bind to the best
    product (of equals the one that the sighting had before, ``known``, then the least
    id); ``create`` has none. Sightings without tokens are ``create``. Sightings that
    are alike in tokens, brand and size are scored once."""
    kind = F.struct(F.array_sort(F.array_distinct("tokens")).alias("tokens"), F.coalesce("brand", F.lit("")).alias("brand"), "unit", "total")
    seen = sightings.select("sighting_id", kind.alias("_kind"))
    kinds = seen.select("_kind").distinct().select(F.col("_kind").alias("sighting_id"), "_kind.*")
    pairs = scored_pairs(kinds, products).withColumnRenamed("sighting_id", "_kind")
    pairs = pairs if known is None else materialize(pairs, "registry-pairs")
    order = F.struct((-F.col("score")).alias("s"), "product_id")
    best = pairs.groupBy("_kind").agg(F.min_by(F.struct("product_id", "score"), order).alias("b"))
    rows = spread_join(seen, best, ["_kind"], "left").select("sighting_id", "_kind", "b.*")
    if known is not None:
        held = known.select("sighting_id", F.col("product_id").alias("_held")).filter("_held IS NOT NULL").dropDuplicates(["sighting_id"])
        rows = rows.join(held, "sighting_id", "left")
        again = pairs.select("_kind", F.col("product_id").alias("_held"), F.col("score").alias("_score"))
        rows = spread_join(rows, again, ["_kind", "_held"], "left")
        rows = rows.withColumn("product_id", F.when(F.col("_score") == F.col("score"), F.col("_held")).otherwise(F.col("product_id")))
    band = F.when(F.col("score") >= ATTACH, "attach").when(F.col("score") >= REVIEW, "review").otherwise("create")
    rows = rows.withColumn("band", band)
    bound = F.col("band") != "create"
    return rows.select("sighting_id", F.when(bound, F.col("product_id")).alias("product_id"), F.when(bound, F.col("score")).alias("score"), "band")


def taught(products: DataFrame, sightings: DataFrame, resolved: DataFrame) -> DataFrame:
    """Products with the tokens of the sightings attached to them; those in review
    teach nothing. A dormant product that is seen again is active."""
    own = resolved.filter("band = 'attach'").join(sightings.select("sighting_id", "tokens", "week"), "sighting_id")
    each = own.select("product_id", "week", F.explode_outer("tokens").alias("token")).groupBy("product_id", "token").agg(F.max("week").alias("week"))
    words = each.groupBy("product_id").agg(F.collect_list("token").alias("_new"), F.max("week").alias("_week"))
    rows = products.join(words, "product_id", "left")
    seen = F.col("_week").isNotNull()
    return rows.withColumns(
        {
            "tokens": F.when(seen, F.array_sort(F.array_union("tokens", "_new"))).otherwise(F.col("tokens")),
            "state": F.when(seen, "active").otherwise(F.col("state")),
            "last_seen": F.greatest("last_seen", "_week"),
        }
    ).drop("_new", "_week")


def put_to_sleep(products: DataFrame, today: Column) -> DataFrame:
    """Active products unseen for six weeks become dormant."""
    old = (F.col("state") == "active") & (F.datediff(today, F.col("last_seen")) > 7 * DORMANT_WEEKS)
    return products.withColumn("state", F.when(old, "dormant").otherwise(F.col("state")))


def _double_blocks(first: bool) -> Column:
    """The blocks of a product (brand, unit, total, stores), of which any two that may be
    doubles have one in common, as ``first`` and as second: the brand is the same or one
    has none, and besides the size is the same (neighbouring buckets, a tolerance wide),
    or a store is and one size is unknown. A total without end is near every other."""
    known = F.col("unit").isNotNull() & F.col("total").isNotNull()
    wild = known & (F.isnan("total") | (F.abs("total") == float("inf")))
    none = F.array().cast("array<string>")
    some = lambda held, *keys: F.when(held, F.array(*keys)).otherwise(none)
    key = lambda *parts: F.concat_ws("\x00", *parts)
    bucket = F.when(F.col("total") > 0, F.floor(F.log("total") / F.lit(SIZE_BUCKET)))
    step = lambda n: key(F.lit("size"), F.col("unit"), F.coalesce((bucket + n).cast("string"), F.lit("0 or less")))
    sized = some(known & ~wild, *([step(-1), step(0), step(1)] if first else [step(0)]))
    sized = F.concat(sized, some(wild if first else known, key(F.lit("wild"), F.col("unit"))), some(known if first else wild, key(F.lit("to wild"), F.col("unit"))))
    stores = lambda tag: F.transform(F.coalesce("stores", F.array()), lambda s: key(F.lit(tag), s.cast("string")))
    if first:
        placed = F.when(known, stores("to unsized")).otherwise(stores("unsized"))
    else:
        placed = F.concat(stores("unsized"), F.when(known, none).otherwise(stores("to unsized")))
    own, bare = key(F.lit("brand"), F.col("brand")), F.lit("to a brand" if first else "to none")
    brands = F.when(F.col("brand") == "", F.array(bare, F.lit("none"))).otherwise(F.array(own, F.lit("to none" if first else "to a brand")))
    return F.flatten(F.transform(F.array_distinct(F.concat(sized, placed)), lambda k: F.transform(brands, lambda b: key(b, k))))


def merge_targets(products: DataFrame, stores: DataFrame) -> DataFrame:
    """product_id, merged_into: products that are another's double. The bar is above
    that for a sighting, brands must not conflict, and the two have a store in common
    (stores: product_id, store) or the same known size. Products are taken by id: one
    merges into the first survivor before it that is its double, or else survives. So
    every step leads to a survivor, and a second run has nothing to merge. Products that
    are alike in all of this are one node of the rounds that find the survivors."""
    held = stores.filter("store IS NOT NULL").groupBy("product_id").agg(F.array_sort(F.collect_set("store")).alias("stores"))
    kind = F.struct(F.array_sort(F.array_distinct("tokens")).alias("tokens"), F.coalesce("brand", F.lit("")).alias("brand"), "unit", "total", "stores")
    sized = F.col("unit").isNotNull() & F.coalesce(F.col("total") >= 0, F.lit(False))
    rows = products.select("product_id", "tokens", "brand", "unit", "total")
    rows = large_join(rows, held, ["product_id"], "left")
    rows = materialize(rows.filter((F.size("tokens") > 0) & (F.col("stores").isNotNull() | sized)).select("product_id", kind.alias("kind")), "merge-rows")
    nodes = materialize(rows.groupBy("kind").agg(F.min("product_id").alias("node")), "merge-nodes")
    ordered = overlap.rare_first(nodes.select("node", "kind.*"), "node", "tokens")
    pairs = overlap.contained_pairs(ordered, ordered, MERGE, (_double_blocks(True), _double_blocks(False)))
    a, b = F.col("a"), F.col("b")
    same_size = F.coalesce((a["unit"] == b["unit"]) & within(a["total"], b["total"]), F.lit(False))
    pairs = pairs.filter((a["node"] < b["node"]) & ~brand_conflicts(a["brand"], b["brand"]) & ~size_differs(a["unit"], a["total"], b["unit"], b["total"]))
    pairs = pairs.filter(F.coalesce(F.arrays_overlap(a["stores"], b["stores"]), F.lit(False)) | same_size)
    led = overlap.leaders(nodes.select("node", F.lit(None).cast("string").alias("cls")), pairs.select(a["node"].alias("a"), b["node"].alias("b")))
    survivors = nodes.join(led.hint("merge"), "node").select("kind", F.col("leader").alias("merged_into"))
    return spread_join(rows, survivors.hint("merge"), ["kind"]).filter("product_id <> merged_into").select("product_id", "merged_into")


def current_ids(ids: DataFrame, merged: DataFrame, column: str = "product_id") -> DataFrame:
    """Ids with the survivor in place of a merged one."""
    step = merged.select(F.col("product_id").alias(column), "merged_into")
    return spread_join(ids, step, [column], "left").withColumn(column, F.coalesce("merged_into", column)).drop("merged_into")


#: What stands between the two products of an offer of either.
EITHER = r"(?i)(?:^|\s)(?:or|او|أو)(?:\s|$)"


def is_either_offer(name: Column) -> Column:
    """Two products to choose from: two sides of two words or more beside an "or"."""
    sides = F.filter(F.split(F.trim(name), EITHER), lambda s: F.size(F.filter(F.split(F.trim(s), r"\s+"), lambda w: F.length(w) > 1)) >= 2)
    return F.coalesce(name.rlike(EITHER) & (F.size(sides) >= 2), F.lit(False))


def acceptance(conditions: dict[str, Column]) -> Column:
    """struct<verdict, missing>: accepted if every condition holds (null is no), else
    rejected with the names of those that do not."""
    missing = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))
    return F.struct(F.when(F.size(missing) == 0, "accepted").otherwise("rejected").alias("verdict"), missing.alias("missing"))


def with_enrichment(offers: DataFrame, enriched: DataFrame, columns: list[str]) -> DataFrame:
    """Offers with the enriched values of ``columns`` where their enrichment is servable
    and has one; otherwise their own. + enriched."""
    own = enriched.filter("servable").select("offer_id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_have"))
    rows = offers.join(own, "offer_id", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns})
    return rows.withColumn("enriched", F.coalesce("_have", F.lit(False))).drop("_have", *[f"_{c}" for c in columns])


def arabic_name(category: Column, descriptors: Column, flavour: Column, brand: Column, size: Column, words: dict[str, str]) -> Column:
    """An Arabic name from the parts of a Latin one: category, descriptors, flavour,
    brand, size. Parts without a translation are left out, the brand stays; null if the
    category has none."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv]) if words else F.create_map().cast("map<string,string>")
    known = lambda c: F.try_element_at(table, F.lower(c))
    taste = F.when(known(flavour).isNotNull(), F.concat(F.lit("بنكهة "), known(flavour)))
    described = F.nullif(F.array_join(F.array_compact(F.transform(descriptors, known)), " "), F.lit(""))
    return F.when(known(category).isNotNull(), F.concat_ws(" ", known(category), described, taste, F.nullif(brand, F.lit("")), size))


def counted_in_arabic(n: Column, one: str, two: str, few: str, many: str) -> Column:
    """A counted noun: one, two, 3 to 10 with the plural, more with the singular."""
    counted = lambda noun: F.concat_ws(" ", n.cast("string"), F.lit(noun))
    return F.when(n == 1, one).when(n == 2, two).when(n.between(3, 10), counted(few)).otherwise(counted(many))


def produce_shelf(text: Column, shelf: Column, moved: dict[str, tuple[list[str], list[str]]]) -> Column:
    """The shelf of a product, moved where its text has one of the markers and none of
    the guards: shelf -> (new shelf as the key's value). Null text moves nothing."""
    hay = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    has = lambda ws: F.exists(F.array(*[F.lit(f" {w} ") for w in ws]), lambda w: F.contains(hay, w)) if ws else F.lit(False)
    out = shelf
    for target, (markers, guards) in moved.items():
        out = F.when(has(markers) & ~has(guards), F.lit(target)).otherwise(out)
    return out


def without_marker(name: Column, name_ar: Column, marker: str) -> Column:
    """Whether neither name has a marker; null names have none."""
    return ~F.contains(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(name_ar, F.lit(""))), F.lit(marker))
