"""The comparison model: one row per query from raw listings.

Listings are projected (price, relevance, coverage), pass the gate ladder and the
identity lock, are joined by offers of the same registry product, and give the range,
the cheapest, the best value, the headline, groups of the same product, the stores that
share the headline's price, a confidence and a verdict against the recorded history.
Every step works on all queries at once; a step's result has one row per query (or per
query and product) and meets the listings by a spread join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matching, size, text
from ..functions.lexicon import Lexicon
from ..sources.store import materialize
from . import gates, grouping, history, statistics
from .resolve import spread_join

#: The least relevance of a listing, and the relevance and stage of one
#: that is admitted by its identity.
REL_FLOOR, IDENTITY_STAGE = 30, 0

LISTING = ["query_id", "ord", "source", "store", "name", "brand", "price", "size", "up", "rel", "stage", "family", "form", "product_id", "brand_slug", "seq"]


def display_name(query: Column, name: Column, name_ar: Column) -> Column:
    """The name in the query's script first; null if both are empty."""
    known = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    arabic = query.rlike("[\\u0600-\\u06FF]")
    return F.when(arabic, F.coalesce(known(name_ar), known(name))).otherwise(F.coalesce(known(name), known(name_ar)))


def project(candidates: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Candidates (q, it and the listing's own columns) -> listings that compete: with
    a price (0 is one), relevant by name, at the relevance floor or over it, and
    covering the query's words. + rel, stage, family, form."""
    q, it = F.col("q"), F.col("it")
    rows = candidates.filter("price IS NOT NULL").filter(matching.is_relevant(q, it) & matching.covers_enough(q, it))
    rows = rows.withColumn("rel", matching.relevance(q, it, lexicon)).filter(F.col("rel") >= REL_FLOOR)
    return gates.interpret(rows, lexicon)


def admitted(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Projected listings through the gate ladder and the identity lock: + dropped_by,
    target_family. A lone listing is locked to itself."""
    return gates.identity_lock(gates.gate_ladder(rows, lexicon, "summary"))


def by_identity(kept: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers (ord, product_id, brand_slug, ...) that are the product and brand of an
    admitted listing but not admitted themselves, a row for each query. No gate looks
    at their names."""
    known = kept.filter("product_id IS NOT NULL AND brand_slug IS NOT NULL").select("query_id", "product_id", "brand_slug").distinct()
    pulled = offers.filter("price IS NOT NULL").join(known, ["product_id", "brand_slug"])
    pulled = pulled.join(kept.filter("source = 'flyer'").select("query_id", "ord"), ["query_id", "ord"], "left_anti")
    return pulled.withColumns({"rel": F.lit(float(REL_FLOOR)), "stage": F.lit(IDENTITY_STAGE)})


def pools(kept: DataFrame, offers: DataFrame) -> DataFrame:
    """Admitted listings and those pulled in by identity. ``seq`` is the order of
    listings in a query's pool: online ones, flyer ones, pulled ones, each by ``ord``."""
    place = lambda n: F.struct(n.alias("part"), F.col("ord").alias("ord"))
    own = kept.withColumn("seq", place(F.when(F.col("source") == "online", 0).otherwise(1)))
    return own.select(*LISTING).unionByName(by_identity(kept, offers).withColumn("seq", place(F.lit(2))).select(*LISTING))


def best_values(pool: DataFrame) -> DataFrame:
    """Per query with two listings or more of its commonest unit: that unit, the row
    of least unit price within the outlier guard (``best``), pool and dropped."""
    rows = pool.filter("up IS NOT NULL").select("query_id", "seq", "price", "store", F.col("up.value").alias("value"), F.col("up.unit").alias("unit"))
    rows = statistics.dominant_group(rows, ["query_id"], "unit", "seq")
    best = statistics.best_value(rows, ["query_id"], "value", ["seq"])
    return best.select("query_id", F.struct("seq", "price", "store", "value").alias("best"), F.col("unit").alias("value_unit"), "pool", "dropped")


def headlines(pool: DataFrame) -> DataFrame:
    """Per query: offers, stores, flyers, lowest, highest, the cheapest listing (the
    first of equals), the best value, and the headline with its kind."""
    row = F.struct("price", "seq", "store", "name", "size", "up")
    stats = pool.groupBy("query_id").agg(
        F.count("*").alias("offers"),
        F.count_distinct("source", "store").alias("stores"),
        F.count_if(F.col("source") == "flyer").alias("flyers"),
        F.min("price").alias("lowest"),
        F.max("price").alias("highest"),
        F.min_by(row, F.struct("price", "seq")).alias("cheapest"),
    )
    rows = stats.join(best_values(pool), "query_id", "left")
    cheap, best = F.col("cheapest"), F.col("best")
    unit_value = F.when(cheap["up"]["unit"] == F.col("value_unit"), cheap["up"]["value"])
    kind = statistics.headline(F.to_json(cheap["seq"]), unit_value, F.to_json(best["seq"]), best["value"])
    rows = rows.withColumn("kind", kind)
    return rows.withColumn("head_seq", F.when(F.col("kind") == "best-value", best["seq"]).otherwise(cheap["seq"]))


def _with_head(pool: DataFrame, heads: DataFrame) -> DataFrame:
    """The pool with its query's headline listing as ``head``."""
    head = pool.join(heads.select("query_id", F.col("head_seq").alias("seq")), ["query_id", "seq"])
    head = head.select("query_id", F.struct("seq", "store", "price", "name", "size").alias("head"))
    return spread_join(pool, head, ["query_id"])


def canonical_equivalents(pool: DataFrame) -> DataFrame:
    """Per query the registry product (and brand) that two stores or more sell: the one
    with the headline before others, then that of most stores, then the first listed.
    ``pool`` has ``head``."""
    rows = pool.filter("product_id IS NOT NULL").withColumn("_brand", F.coalesce("brand_slug", F.lit("")))
    groups = rows.groupBy("query_id", "product_id", "_brand").agg(
        F.count_distinct("store").alias("stores"), F.max(F.col("seq") == F.col("head.seq")).alias("has_head"), F.min("seq").alias("first")
    )
    order = F.struct((~F.col("has_head")).alias("h"), (-F.col("stores")).alias("s"), "first")
    value = F.struct("product_id", "stores", "has_head")
    return groups.filter("stores >= 2").groupBy("query_id").agg(F.min_by(value, order).alias("canonical"))


def lexical_equivalents(pool: DataFrame) -> DataFrame:
    """The same for online listings, which have no registry product: groups of one size
    and brand, or overlapping names. A group with the headline comes before others; of
    others only sized ones count, that of most stores first."""
    rows = pool.filter("source = 'online' AND size.unit IS NOT NULL").select(
        "query_id", F.col("size.unit").alias("unit"), F.col("size.total").alias("total"), "ord", "form",
        F.coalesce("brand", F.lit("")).alias("brand"), text.words(F.col("name")).alias("words"), "store", "seq", "head",
    )
    numbered = grouping.group_equivalents(rows, ["query_id", "unit"], "ord")
    groups = rows.join(numbered, ["query_id", "unit", "ord"]).groupBy("query_id", "unit", "leader").agg(
        F.count_distinct("store").alias("stores"), F.max(F.col("seq") == F.col("head.seq")).alias("has_head"), F.min("seq").alias("first")
    )
    order = F.struct((~F.col("has_head")).alias("h"), (-F.col("stores")).alias("s"), "first")
    return groups.filter("stores >= 2").groupBy("query_id").agg(F.min_by(F.struct("stores", "has_head"), order).alias("lexical"))


def shared_stores(pool: DataFrame) -> DataFrame:
    """Per query the other stores that sell the headline's product at its price: equal
    prices, and the same size or the same normalized name. ``pool`` has ``head``."""
    head = F.col("head")
    same = size.same_size(F.col("size"), head["size"]) | (text.normalize(F.col("name")) == text.normalize(head["name"]))
    rows = pool.filter((F.col("store") != head["store"]) & (F.abs(F.col("price") - head["price"]) <= statistics.SAME_PRICE) & same)
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_set("store")).alias("shared_with"))


def size_history(pool: DataFrame, variants: DataFrame) -> DataFrame:
    """Per query the record of the headline's own size against today's best price for
    that size: low, todays_best, delta, weeks, verdict. ``variants``: query_id, unit,
    total, low, weeks, observations; the most observed that fits is taken. Queries
    without one have no row. ``pool`` has ``head``."""
    head = F.col("head.size")
    fits = lambda s: F.coalesce((s["unit"] == F.col("v_unit")) & size.within(s["total"], F.col("v_total")), F.lit(False))
    records = variants.withColumnRenamed("unit", "v_unit").withColumnRenamed("total", "v_total")
    heads = pool.filter(F.col("seq") == F.col("head.seq")).select("query_id", "head").join(records, "query_id").filter(fits(head))
    order = F.struct((-F.col("observations")).alias("o"), "v_unit", "v_total")
    chosen = heads.groupBy("query_id").agg(F.min_by(F.struct("v_unit", "v_total", "low", "weeks"), order).alias("c")).select("query_id", "c.*")
    today = spread_join(pool, chosen, ["query_id"]).filter(fits(F.col("size")))
    found = today.groupBy("query_id", "low", "weeks").agg(F.min("price").alias("todays_best"))
    return found.withColumn("delta", F.col("todays_best") - F.col("low")).withColumn(
        "verdict", history.verdict(F.col("todays_best"), F.col("low"), F.col("weeks"))
    )


def compare(candidates: DataFrame, offers: DataFrame, lexicon: Lexicon, variants: DataFrame | None = None) -> DataFrame:
    """The comparison, a row for each query with an admitted listing.

    ``candidates``: query_id, q, it, ord, source (online or flyer), store, name, brand,
    price, size, up, product_id, brand_slug. ``offers``: all flyer offers in the same
    columns but the query's, + family and form. Gated listings and the pool are written
    to scratch, for they are read several times.
    """
    own = ["query_id", "ord", "source", "store", "name", "brand", "price", "size", "up", "rel", "stage", "family", "form", "product_id", "brand_slug"]
    gated = admitted(project(candidates, lexicon), lexicon).select(*own, "target_family", "dropped_by")
    gated = materialize(gated, "compare-gated")
    counts = gates.excluded_counts(gated).join(
        gated.groupBy("query_id").agg(F.count_if(F.col("dropped_by") == "identity").alias("identity_excluded")), "query_id"
    )
    pool = materialize(pools(gated.filter("dropped_by IS NULL"), offers), "compare-pool")
    heads = materialize(headlines(pool), "compare-heads")
    led = materialize(_with_head(pool, heads), "compare-led")
    rows = counts.drop("kept").join(heads, "query_id")
    for part in (canonical_equivalents(led), lexical_equivalents(led), shared_stores(led)):
        rows = rows.join(part, "query_id", "left")
    known = F.when(F.col("canonical").isNotNull(), F.struct("canonical.stores", "canonical.has_head")).otherwise(F.col("lexical"))
    rows = rows.withColumn("_same", known)
    high = F.coalesce(F.col("_same.has_head"), F.lit(False))
    rows = rows.withColumns(
        {
            "equivalent_stores": F.col("_same.stores"),
            "shared_with": F.coalesce("shared_with", F.array().cast("array<string>")),
            "confidence": statistics.confidence(high, F.col("best").isNotNull()),
        }
    ).drop("_same", "canonical", "lexical")
    if variants is not None:
        seen = size_history(led, variants).select("query_id", "low", "todays_best", "delta", "weeks", "verdict")
        rows = rows.join(seen, "query_id", "left")
    return rows


def result_split(candidates: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Candidates of a result list -> + rel, part: 'primary' (enough of the query),
    'related', or 'hidden' (not relevant)."""
    q, it = F.col("q"), F.col("it")
    rows = candidates.withColumn("rel", matching.relevance(q, it, lexicon))
    relevant = matching.is_relevant(q, it) & (F.col("rel") > 0)
    return rows.withColumn("part", F.when(~relevant, "hidden").when(matching.is_primary(q, it), "primary").otherwise("related"))


FLYERS = "__flyers__"


def in_view(rows: DataFrame, view: str | None) -> DataFrame:
    """The rows of one store, or all flyer offers, of a list that is ranked already;
    ranks stay as they are."""
    if view is None:
        return rows
    return rows.filter(F.col("source") == "flyer") if view == FLYERS else rows.filter(F.col("store") == view)
