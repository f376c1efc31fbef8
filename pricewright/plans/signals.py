"""Queries of featured signals and learning, and of raw listings, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, display, featured, matching
from ..functions.lexicon import Lexicon
from ..operators import ranking, resolve, statistics, watch
from ..sources import listings as sources
from .oracles import NOUN, L
from .tables import PARTS, items_of, listings, products, table

SIGNALS = {"warm": ["hot"], "young": ["new", "fresh"], "flat": ["red plate", "blue plate"], "big": ["large"]}
WEIGHTS = {("warm", "hardware"): 0.8, ("young", "hardware"): 0.5, ("young", "toys"): 1.25, ("flat", "general"): 1.0, ("big", "toys"): 0.25}
CATEGORIES = {"fastener": "hardware", "tool": "hardware", "gadget": "toys"}


def _signals(spark, d):
    rows = matching.with_item(items_of(spark, d), PARTS).withColumn("family", F.col("it.family"))
    ids = F.concat(featured.detect_signals(F.col("name"), SIGNALS), F.array(featured.brand_id(F.col("maker"))))
    return rows.select("ord", "price", "family", "name", "maker", featured.detect_signals(F.col("name"), SIGNALS).alias("signals"), ids.alias("ids"))


def product_signals(spark, d):
    category = display.family_category(F.col("family"), ["plate"], CATEGORIES)
    return _signals(spark, d).select(F.col("ord").alias("p_partkey"), F.array_join("ids", "|").alias("ids"), category.alias("category"))


PRODUCT_SIGNALS = f"""WITH n AS (SELECT *, split_part(p_name, ' ', 1) AS a, {NOUN} AS fam FROM part)
SELECT p_partkey, concat_ws('|', CASE WHEN a = 'hot' THEN 'warm' END, CASE WHEN a = 'new' THEN 'young' END, CASE WHEN p_name IN ('red plate', 'blue plate') THEN 'flat' END,
  CASE WHEN a = 'large' THEN 'big' END, 'b:brand ' || substr(p_brand, 7)) AS ids, CASE fam WHEN 'plate' THEN 'produce' WHEN 'gadget' THEN 'toys' ELSE 'hardware' END AS category FROM n"""


def _learned(spark, d):
    """Clicks as choices of the part that their props name, filed under its family."""
    clicks = table(spark, d, "events").filter("event_type = 'click'").select(F.col("user_id"), F.get_json_object("props", "$.k").try_cast("bigint").alias("ord"), F.col("event_id").alias("at"))
    chosen = clicks.join(_signals(spark, d), "ord")
    return featured.learned(chosen.select("user_id", F.concat(F.lit("f:"), "family").alias("key"), "ids", "at"), "user_id")


def learned_signals(spark, d):
    return _learned(spark, d).select("user_id", "key", "id", F.col("n").cast("long").alias("n"))


_CHOICES = f"""WITH q AS ({PRODUCT_SIGNALS}), f AS (SELECT p_partkey, {NOUN} AS fam FROM part),
c AS (SELECT user_id, 'f:' || fam AS key, ids, event_id AS pos FROM events JOIN f ON p_partkey = TRY_CAST(props->>'$.k' AS BIGINT) JOIN q USING (p_partkey) WHERE event_type = 'click'),
x AS (SELECT user_id, key, unnest(string_split(ids, '|')) AS id, pos FROM c),
n AS (SELECT user_id, key, id, least(count(*), 40) AS n, max(pos) AS pos FROM x GROUP BY ALL),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY n DESC, pos DESC, id) <= 24)"""
LEARNED = f"""{_CHOICES} SELECT user_id, key, id, n FROM k"""


def featured_rank(spark, d):
    """For user 3 the ten featured parts of each family: curated signals of the family's
    category, a discount, what the user's choices teach, less the penalty of a price far
    from the family's median."""
    rows = _signals(spark, d).filter("family IS NOT NULL")
    own = _learned(spark, d).filter("user_id = 3").groupBy(F.expr("substring(key, 3)").alias("family")).agg(F.map_from_entries(F.collect_list(F.struct("id", "n"))).alias("counts"))  # at most 24 ids a key
    rows = resolve.spread_join(rows, own, ["family"], "left")
    rows = statistics.with_upper_median(rows, ["family"], "price", "median")
    category = display.family_category(F.col("family"), ["plate"], CATEGORIES)
    cut = display.discount_share(F.when(F.col("ord") % 3 == 0, F.col("price") * 1.25), F.col("price"))
    score = ranking.featured_score(
        featured.curated_weight(F.col("signals"), category, WEIGHTS), cut, F.coalesce(featured.learned_boost(F.col("ids"), F.col("counts")), F.lit(0.0)),
        statistics.price_penalty(F.col("price"), F.col("median")),
    )
    rows = rows.withColumns({"query_id": F.col("family"), "stage": F.lit(5), "band": F.lit(3), "several": F.lit(False), "target_family": F.col("family"), "rel": F.lit(100.0), "featured": F.round(score, 9)})
    return ranking.ranked(rows, "featured", top=10).select("family", "rank", F.col("ord").alias("p_partkey"), "featured")


FEATURED = f"""{_CHOICES}, u AS (SELECT key[3:] AS fam, id, n FROM k WHERE user_id = 3),
s AS (SELECT p.*, f.fam, q.ids, q.category FROM part p JOIN f USING (p_partkey) JOIN q USING (p_partkey) WHERE f.fam IS NOT NULL),
b AS (SELECT p_partkey, sum(least(n, 20) / 20.0::DOUBLE * 0.75::DOUBLE) AS boost FROM s JOIN u ON u.fam = s.fam AND list_contains(string_split(ids, '|'), id) GROUP BY 1),
w AS (SELECT s.*, coalesce(boost, 0) AS boost, CASE category WHEN 'hardware' THEN CASE WHEN contains(ids, 'warm|') THEN 0.8::DOUBLE WHEN contains(ids, 'young|') THEN 0.5 ELSE 0 END
  WHEN 'toys' THEN CASE WHEN contains(ids, 'young|') THEN 1.25::DOUBLE WHEN contains(ids, 'big|') THEN 0.25 ELSE 0 END ELSE 0 END AS curated FROM s LEFT JOIN b USING (p_partkey)),
g AS (SELECT *, round(least(2.0::DOUBLE, curated) + CASE WHEN p_partkey % 3 = 0 THEN 0.2::DOUBLE ELSE 0 END * 1.2::DOUBLE + least(1.5::DOUBLE, boost), 9) AS featured FROM w)
SELECT fam AS family, CAST(row_number() OVER (PARTITION BY fam ORDER BY featured DESC, p_retailprice, p_partkey) AS INT) AS rank, p_partkey, featured FROM g QUALIFY rank <= 10"""


def listing_union(spark, d):
    """Online results and flyer offers as one list of listings: rows without a price go,
    price 0 stays, flyer names in the query's script."""
    k = F.col("p_partkey")
    part = products(spark, d)
    price = F.when(k % 10 == 0, None).when(k % 10 == 1, 0.0).otherwise(F.col("p_retailprice"))
    online = part.filter("p_type <> 'PROMO'").select(F.col("p_name").alias("name"), F.when(k % 2 == 0, F.col("p_brand")).alias("brand"), price.alias("price"), F.lit(None).cast("double").alias("oldPrice"), F.lit("1 kg").alias("size"))
    flyer = part.filter("p_type = 'PROMO'").select(
        F.concat(F.lit("s"), k % 3).alias("store"), F.when(k % 3 != 0, F.col("p_name")).alias("name"), F.when(k % 2 == 0, "اسم").alias("nameAr"), price.alias("price"),
        F.lit(None).cast("double").alias("oldPrice"), F.lit("1 kg").alias("size"), F.concat(F.lit("pr_"), k).alias("productId"),
    )
    rows = sources.all_listings(sources.online_listings(online, "panda"), sources.flyer_listings(flyer, arabic_query=True))
    return rows.groupBy("source", "store", "name").agg(F.count("*").alias("listings"), F.count_if(F.col("price") == 0).alias("free"), F.count("product_id").alias("known"))


UNION = """WITH p AS (SELECT * FROM part WHERE p_partkey % 10 <> 0)
SELECT 'online' AS source, 'panda' AS store, p_name AS name, count(*) AS listings, count(*) FILTER (WHERE p_partkey % 10 = 1) AS free, CAST(0 AS BIGINT) AS known FROM p WHERE p_type <> 'PROMO' GROUP BY p_name
UNION ALL SELECT 'flyer', 's' || (p_partkey % 3), CASE WHEN p_partkey % 2 = 0 THEN 'اسم' WHEN p_partkey % 3 <> 0 THEN p_name ELSE '' END AS n, count(*), count(*) FILTER (WHERE p_partkey % 10 = 1), count(*)
FROM p WHERE p_type = 'PROMO' GROUP BY p_partkey % 3, n"""


def source_kinds(spark, d):
    """Suppliers as sources, split into online and flyer ones, with the state that their
    watches are anchored in."""
    rows = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 3 == 0, "online").otherwise("index").alias("kind"))
    online, flyer = sources.split_sources(rows)
    both = online.withColumn("part", F.lit("a")).unionByName(flyer.withColumn("part", F.lit("b")))
    k = F.col("s_suppkey")
    state = watch.anchor_state(F.when(k % 4 == 0, "anchored_source"), F.when(k % 4 == 1, k), F.when(k % 4 == 2, "{}"))
    return both.groupBy("part", state.alias("state")).agg(F.count("*").alias("sources"))


KINDS = """SELECT CASE WHEN s_nationkey % 3 = 0 THEN 'a' ELSE 'b' END AS part, CASE s_suppkey % 4 WHEN 0 THEN 'anchored_source' WHEN 1 THEN 'anchored_registry' WHEN 2 THEN 'anchored_spec' ELSE 'resolving' END AS state,
  count(*) AS sources FROM supplier GROUP BY ALL"""


def kept_offers(spark, d):
    """Offers kept for 180 days before the end of the table, by category and family."""
    shelf = Lexicon(base=PARTS.base, derived=PARTS.derived, types=PARTS.types, synonyms=PARTS.synonyms, category_family={"promo": "flyer"})
    fam = classify.offer_family(F.when(F.col("p_partkey") % 3 == 0, F.lit("thing")).otherwise(F.col("p_name")), F.lit(None).cast("string"), F.col("p_type"), shelf)
    parts = products(spark, d).select(F.col("p_partkey").alias("l_partkey"), fam.alias("family"))
    rows = sources.retained(listings(spark, d), F.lit("2001-06-30").cast("date"), "day", 180).join(parts, "l_partkey")
    return rows.groupBy("family").agg(F.count("*").alias("offers"))


KEPT = f"""WITH {L} SELECT CASE WHEN p_partkey % 3 <> 0 THEN {NOUN} WHEN p_type = 'PROMO' THEN 'flyer' END AS family, count(*) AS offers
FROM l JOIN part ON l_partkey = p_partkey WHERE day >= DATE '2001-06-30' - 180 GROUP BY ALL"""


def ingested_offers(spark, d):
    """Offers of two ingests, the later ones in place of the earlier: those with a sane
    price only, keyed by store and offer, with the brochure of their edition."""
    from ..operators import merge

    k = F.col("l_orderkey")
    rows = listings(spark, d).select(
        F.col("l_suppkey").alias("store"), (k * 10 + F.col("l_linenumber")).alias("offer_id"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("old_price"),
        F.when(k % 9 == 0, F.col("l_extendedprice") * 2).when(k % 9 == 1, -1.0).otherwise(F.col("price")).alias("price"), F.concat(F.lit("e"), k.cast("string")).alias("edition"),
    )
    held = table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("edition"), F.col("o_orderkey").alias("brochure"))
    order = ["part", "price"]
    early, late = merge.ingest(rows.filter("part % 2 = 0"), held), merge.ingest(rows.filter("part % 3 = 0"), held)
    once = merge.upsert(early.limit(0), early, ["store", "offer_id"], order)
    kept = merge.upsert(once, late, ["store", "offer_id"], order)
    return kept.groupBy("store").agg(F.count("*").alias("offers"), F.count("brochure").alias("linked"), F.sum("part").alias("parts"))


INGESTED = f"""WITH {L}, r AS (SELECT l_suppkey AS store, l_orderkey * 10 + l_linenumber AS offer_id, l_partkey AS part, l_orderkey AS k, price FROM l WHERE l_orderkey % 9 > 1 AND l_extendedprice >= price AND price > 0),
e AS (SELECT * FROM r WHERE part % 2 = 0 QUALIFY row_number() OVER (PARTITION BY store, offer_id ORDER BY part, price) = 1),
t AS (SELECT * FROM r WHERE part % 3 = 0 QUALIFY row_number() OVER (PARTITION BY store, offer_id ORDER BY part, price) = 1),
m AS (SELECT * FROM t UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.store = e.store AND t.offer_id = e.offer_id))
SELECT store, count(*) AS offers, count(o_orderkey) AS linked, CAST(sum(part) AS BIGINT) AS parts FROM m LEFT JOIN orders ON o_orderkey = k AND o_orderstatus <> 'F' GROUP BY store"""

QUERIES = {
    "product_signals": product_signals, "learned_signals": learned_signals, "featured_rank": featured_rank, "listing_union": listing_union, "source_kinds": source_kinds,
    "kept_offers": kept_offers, "ingested_offers": ingested_offers,
}
SQL = {
    "product_signals": PRODUCT_SIGNALS, "learned_signals": LEARNED, "featured_rank": FEATURED, "listing_union": UNION, "source_kinds": KINDS, "kept_offers": KEPT, "ingested_offers": INGESTED,
}
