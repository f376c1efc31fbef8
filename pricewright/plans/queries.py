"""The registered queries: operators applied to whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify, matching, size, text
from ..operators import gates, grouping, history, merge, pages, ranking, resolve, statistics, watch
from .tables import ORDER, PARTS, candidates, listings, products, queries, table

TARGET = 100.0


def best_value(spark, d):
    best = statistics.best_value(listings(spark, d), ["l_partkey"], "unit", ORDER)
    return best.select("l_partkey", *ORDER, F.col("unit").alias("best_unit"), "pool", "dropped")


def cheapest_per_store(spark, d):
    rows = listings(spark, d).select("l_partkey", "l_suppkey", "price", "l_orderkey", "l_linenumber")
    return statistics.first_of_group(rows, ["l_partkey", "l_suppkey"], ["price", "l_orderkey", "l_linenumber"])


def price_range_summary(spark, d):
    return listings(spark, d).groupBy("l_partkey").agg(
        F.min("price").alias("lowest"),
        F.max("price").alias("highest"),
        F.count_distinct("l_suppkey").alias("stores"),
        F.count("*").alias("listings"),
    )


def unit_outliers(spark, d):
    return statistics.unit_outliers(listings(spark, d), ["l_suppkey"], "unit").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "unit")


def median_price_penalty(spark, d):
    rows = statistics.with_upper_median(listings(spark, d).select("l_partkey", "price"), ["l_partkey"], "price", "median")
    rows = rows.withColumn("median", F.when(F.col("median_of") >= 4, F.col("median")))
    rows = rows.withColumn("penalty", statistics.price_penalty(F.col("price"), F.col("median")))
    return rows.groupBy("l_partkey").agg(
        F.max("median").alias("median"), F.count_if(F.col("penalty") > 0).alias("penalized"), F.count_if(F.col("penalty") >= 2.5).alias("capped")
    )


def discount_bands(spark, d):
    percent = statistics.discount_percent(F.col("l_extendedprice"), F.col("price"))
    rows = listings(spark, d).withColumn("state", statistics.discount_state(percent))
    return rows.groupBy("l_suppkey", "state").agg(F.count("*").alias("listings"))


def dominant_kind(spark, d):
    return statistics.dominant(products(spark, d), ["p_brand"], "p_type", "p_partkey").select("p_brand", "p_type", "n")


def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize(F.col("text")).cast("binary")).alias("digest"))


def token_inventory(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def synonym_expand(spark, d):
    rows = products(spark, d).select("p_partkey", text.tokens(F.col("p_name")).alias("t"))
    return rows.select("p_partkey", F.explode(F.flatten(matching.variants(F.col("t"), PARTS))).alias("word"))


def family_tiers(spark, d):
    return products(spark, d).select("p_partkey", classify.family(F.col("p_name"), PARTS).alias("family"))


def form_keyword(spark, d):
    return products(spark, d).select("p_partkey", classify.form(F.col("p_name"), PARTS).alias("form"))


def _sized(spark, d):
    label = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" x 250 ml"))
    return products(spark, d).withColumn("s", size.parse_size(label))


def parse_sizes(spark, d):
    return _sized(spark, d).select("p_partkey", "s.unit", "s.each", "s.pack", "s.total", "s.src", size.size_label(F.col("s")).alias("label"))


def unit_price(spark, d):
    none = F.lit(None).cast("string")
    basis = size.price_basis(none, F.col("p_name"), none, F.col("s.unit").isNotNull())
    up = size.unit_price(F.col("p_retailprice"), size.reference_quantity(F.col("s"), basis))
    return _sized(spark, d).withColumn("up", up).select("p_partkey", F.col("up.value").alias("unit_value"), F.col("up.unit").alias("per"))


def relevance_score(spark, d):
    q, it = F.col("q"), F.col("it")
    rel = matching.relevance(q, it, PARTS)
    return candidates(spark, d).select("query_id", F.col("ord").alias("p_partkey"), rel.alias("rel"), matching.is_relevant(q, it).alias("relevant"), matching.is_primary(q, it).alias("is_primary"))


def match_stage(spark, d):
    return candidates(spark, d).select("query_id", F.col("ord").alias("p_partkey"), matching.match_stage(F.col("q"), F.col("it"), PARTS).alias("stage"))


def _gated(spark, d, tier):
    return gates.gate_ladder(gates.interpret(candidates(spark, d), PARTS), PARTS, tier)


def gate_ladder(tier):
    return lambda spark, d: gates.excluded_counts(_gated(spark, d, tier))


def identity_lock(spark, d):
    rows = _gated(spark, d, "summary").withColumns(
        {
            "rel": matching.relevance(F.col("q"), F.col("it"), PARTS),
            "source": F.when(F.col("kind") == "PROMO", "flyer").otherwise("online"),
            "product_id": F.col("maker"),
        }
    )
    locked = gates.identity_lock(rows)
    return locked.groupBy("query_id").agg(
        F.count_if(F.col("dropped_by").isNull()).alias("kept"), F.count_if(F.col("dropped_by") == "identity").alias("identity_excluded")
    )


def canonical_pull_in(spark, d):
    rows = listings(spark, d).join(products(spark, d).select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    admitted = rows.filter("l_quantity >= 49")
    return grouping.pull_in(admitted.select(*keys, "p_brand"), rows, keys, ["l_partkey", "p_brand"]).select(*keys)


def shared_best_price(spark, d):
    rows = listings(spark, d)
    head = statistics.first_of_group(rows.select("l_partkey", "price", *ORDER), ["l_partkey"], ["price", *ORDER])
    head = head.select("l_partkey", F.col("price").alias("best"), F.col("l_suppkey").alias("head"))
    other = rows.join(head, "l_partkey").filter((F.col("l_suppkey") != F.col("head")) & (F.abs(F.col("price") - F.col("best")) <= statistics.SAME_PRICE))
    return other.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("shared_with"))


def headline_decision(spark, d):
    rows = listings(spark, d)
    best = statistics.best_value(rows, ["l_partkey"], "unit", ORDER)
    cheap = statistics.first_of_group(rows.select("l_partkey", "price", "unit", *ORDER), ["l_partkey"], ["price", *ORDER])
    key = lambda p: F.concat_ws("-", *[F.col(f"{p}{c}") for c in ORDER])
    cheap = cheap.select("l_partkey", F.col("price").alias("lowest"), F.col("unit").alias("cheap_unit"), *[F.col(c).alias(f"c_{c}") for c in ORDER])
    best = best.select("l_partkey", F.col("unit").alias("best_unit"), "pool", *[F.col(c).alias(f"b_{c}") for c in ORDER])
    both = cheap.join(best, "l_partkey", "left")
    b = F.when(F.col("pool").isNotNull(), key("b_"))
    kind = statistics.headline(key("c_"), F.col("cheap_unit"), b, F.col("best_unit"))
    sold = rows.groupBy("l_partkey").agg((F.count_distinct("l_suppkey") >= 2).alias("grouped"))  # a part is one registry product
    both = both.join(sold, "l_partkey")
    return both.select("l_partkey", "lowest", kind.alias("headline"), statistics.confidence(F.col("grouped"), b.isNotNull()).alias("confidence"))


def _ranked(order):
    def run(spark, d):
        rows = _gated(spark, d, "summary").withColumns(
            {
                "rel": matching.relevance(F.col("q"), F.col("it"), PARTS),
                "several": F.size("q.tokens") > 1,
                "target_family": F.col("q.family"),
                "unit": F.when(F.col("pieces") > 0, F.when(F.col("pieces") % 3 == 0, "kg").otherwise("pc")),
                "unit_value": F.col("price") / F.col("pieces"),
            }
        )
        counts = rows.groupBy("query_id", "unit").agg((-F.count("unit")).alias("n"), F.min("ord").alias("first"))
        most = counts.groupBy("query_id").agg(F.min(F.struct("n", "first", "unit"))["unit"].alias("dominant_unit"))
        rows = resolve.spread_join(rows, most, ["query_id"])
        rows = rows.withColumn("band", ranking.family_band(F.col("target_family"), F.col("family"), F.col("rel")))
        discount = (F.col("ord") % 10) / 20
        curated = F.when(F.col("maker") == "Brand#1", 1.0).otherwise(0.0)
        learned = ranking.learned_boost(F.col("ord") % 7)
        rows = rows.withColumn("featured", ranking.featured_score(curated, discount, learned, F.lit(0.0)))
        return ranking.ranked(rows, order, top=20).select("query_id", "rank", F.col("ord").alias("p_partkey"))

    return run


def dedupe_jaccard(spark, d):
    rows = products(spark, d).select("p_brand", F.floor(F.col("p_retailprice") / 10).alias("bucket"), "p_partkey", text.words(F.col("p_name")).alias("words"))
    return grouping.dedupe_listings(rows, ["p_brand", "bucket"], "p_partkey", "words").select("p_partkey")


def group_equivalents(spark, d):
    rows = products(spark, d).select(
        F.col("p_brand").alias("block"),
        "p_partkey",
        F.col("p_size").cast("double").alias("total"),
        classify.form(F.col("p_name"), PARTS).alias("form"),
        F.lit("").alias("brand"),
        text.words(F.col("p_name")).alias("words"),
    )
    groups = grouping.group_equivalents(rows, ["block"], "p_partkey")
    return groups.select("block", "p_partkey", F.col("leader").alias("representative"))


def group_branded(spark, d):
    """Groups within a type, where every other part is known by its brand."""
    k = F.col("p_partkey")
    rows = products(spark, d).select(
        F.col("p_type").alias("block"), "p_partkey", (F.col("p_size") * F.when(k % 3 == 0, 1.02).otherwise(1.0)).alias("total"),
        classify.form(F.col("p_name"), PARTS).alias("form"), F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("brand"), text.words(F.col("p_name")).alias("words"),
    )
    return grouping.group_equivalents(rows, ["block"], "p_partkey").select("block", "p_partkey", F.col("leader").alias("representative"))


def canonical_groups(spark, d):
    rows = listings(spark, d).join(products(spark, d).select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    head = F.min(F.struct("price", *ORDER)).alias("h")
    rows = resolve.spread_join(rows.withColumn("aisle", F.col("l_partkey") % 50), rows.groupBy((F.col("l_partkey") % 50).alias("aisle")).agg(head), ["aisle"])
    rows = rows.withColumn("is_head", F.struct("price", *ORDER) == F.col("h"))
    ranked = grouping.canonical_groups(rows, "l_partkey", "p_brand", "l_suppkey", "aisle", "is_head")
    return ranked.select("l_partkey", "p_brand", "stores", "listings", "rank")


HISTORY_ORDER = ["day", "l_orderkey", "l_linenumber", "l_suppkey"]


def history_points(spark, d):
    rows = listings(spark, d).withColumn("price", F.floor("unit"))
    points = history.change_points(rows, ["l_partkey"], HISTORY_ORDER, "price")
    previous = F.coalesce("previous", F.lit(-1)).cast("long").alias("previous")
    return points.select("l_partkey", F.col("day").cast("string").alias("day"), "l_orderkey", "l_linenumber", "l_suppkey", F.col("price").cast("long").alias("price"), previous)


def lowest_ever(spark, d):
    rows = history.lowest_so_far(listings(spark, d), ["l_partkey"], HISTORY_ORDER, "unit")
    return rows.filter("is_lowest AND depth >= 4").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "unit", "low_before")


def history_summary(spark, d):
    out = history.derive(listings(spark, d), ["l_partkey"], "unit", "day", "l_suppkey", ["l_orderkey", "l_linenumber"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("lowest_day", "first_seen", "last_seen")})


def history_verdict(spark, d):
    rows = listings(spark, d)
    last = F.max(F.struct("day", "l_orderkey", "l_linenumber", "l_suppkey", "unit"))["unit"]
    stats = rows.groupBy("l_partkey").agg(last.alias("today"), F.min("unit").alias("low"), F.count_distinct(F.date_trunc("week", F.col("l_shipdate").cast("timestamp"))).alias("weeks"))
    return stats.select("l_partkey", "today", "low", "weeks", history.verdict(F.col("today"), F.col("low"), F.col("weeks")).alias("verdict"))


def back_on_offer(spark, d):
    rows = history.back_on_offer(listings(spark, d), ["l_partkey"], HISTORY_ORDER, "day")
    return rows.groupBy("l_partkey").agg(F.count_if("back").alias("returns"), F.max("gap_days").alias("longest_gap"))


def deal_score(spark, d):
    named = products(spark, d).select(F.col("p_partkey").alias("l_partkey"), history.multi_buy(F.col("p_name")).alias("multi"))
    rows = listings(spark, d).join(named, "l_partkey")
    rows = history.deal_signals(rows, ["l_partkey"], HISTORY_ORDER, "unit", F.col("price"), F.col("l_extendedprice"), "day")
    score = history.deal_score(F.col("is_lowest"), F.col("weeks_seen"), F.col("drop"), F.col("weeks_known"), F.col("multi"), F.col("away_days"))
    rows = rows.withColumn("score", score).filter(F.col("score") >= history.QUALIFIES)
    return rows.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "score")


def _aisles(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    store = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return store.select(F.col("s_suppkey").alias("l_suppkey"), F.coalesce("r_name", F.lit("other")).alias("department"), F.coalesce("n_name", F.lit("other")).alias("aisle"))


def browse_tiles(spark, d):
    rows = listings(spark, d).select("l_suppkey").join(_aisles(spark, d), "l_suppkey", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit("other")) for c in ("department", "aisle")})
    tiles = rows.groupingSets([["department", "aisle"], ["department"], []], "department", "aisle")
    return tiles.agg(F.count("*").alias("offers"), F.count_distinct("l_suppkey").alias("stores"))


def browse_facets(spark, d):
    rows = listings(spark, d).join(products(spark, d).select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name"), "l_partkey")
    rows = rows.withColumn("family", classify.family(F.col("p_name"), PARTS))
    return rows.groupBy("p_brand").agg(F.count("*").alias("offers"), F.count_distinct("l_suppkey").alias("stores"), F.count_distinct("family").alias("families"))


def browse_listing_page(spark, d):
    """The third page of 24 per department, by discount, then key."""
    rows = listings(spark, d).join(_aisles(spark, d), "l_suppkey")
    keys = [("l_discount", "desc"), ("price", "asc"), ("l_orderkey", "asc"), ("l_linenumber", "asc"), ("l_partkey", "asc"), ("l_suppkey", "asc")]
    return pages.numbered_pages(rows, ["department"], keys, 49, 72).select("department", "position", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def brand_mining(spark, d):
    """Leading words on four products or more in two stores or more over the last eight
    weeks of the table."""
    rows = listings(spark, d)
    last = rows.agg(F.max("day").alias("last"))  # one row
    rows = rows.join(F.broadcast(last), F.col("day") > F.date_sub("last", 56))
    rows = rows.join(products(spark, d).select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    rows = rows.withColumn("lead", F.get(text.tokens(F.col("p_name")), F.lit(0)))
    return rows.groupBy("lead").agg(F.count_distinct("l_partkey").alias("products"), F.count_distinct("l_suppkey").alias("stores")).filter("products >= 4 AND stores >= 2")


def cart_rollup(spark, d):
    rows = listings(spark, d).join(table(spark, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    cents = F.round(F.col("price") * 100).cast("decimal(38,0)")
    rows = rows.withColumn("cents", cents)
    sums = rows.rollup("o_custkey", "l_suppkey").agg(F.sum("cents").cast("long").alias("cents"), F.sum(F.col("l_quantity").cast("long")).alias("items"))
    return sums.withColumns({c: F.coalesce(c, F.lit(-1)).cast("long") for c in ("o_custkey", "l_suppkey")})


def watch_crossings(spark, d):
    rows = table(spark, d, "events")
    fired = watch.crossings(rows, ["user_id"], ["ts", "event_id"], "value", F.lit(20.0))
    return fired.select("event_id", "user_id", "value")


def watch_states(spark, d):
    last = F.max(F.struct("ts", "event_id", "value"))["value"]
    rows = table(spark, d, "events").groupBy("user_id").agg(last.alias("last"), F.max("ts").alias("checked"))
    anchored = F.col("user_id") % 5 != 0
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    return rows.select(
        "user_id",
        watch.watch_state(F.col("last"), F.lit(20.0), F.lit(50.0), anchored).alias("state"),
        watch.refresh_reason(F.lit(True), anchored, F.lit("ok"), F.col("checked").cast("timestamp"), now).alias("reason"),
    )


def alert_counts(spark, d):
    rows = table(spark, d, "events")
    alerts = rows.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("alerts"))
    return rows.select("user_id").distinct().join(alerts, "user_id", "left").select("user_id", F.coalesce("alerts", F.lit(0)).cast("long").alias("alerts"))


def json_props(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("known"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def url_provenance(spark, d):
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#]+)", 1))
    safe = host.endswith(".example.com") | (host == "example.com")
    ref = F.regexp_extract(url, r"/([0-9]+)(?:[/.?#]|$)", 1)
    return table(spark, d, "pages").select("page_id", F.when(safe, "link").otherwise("search").alias("target"), F.nullif(ref, F.lit("")).alias("flyer_ref"))


def spatial_hit(spark, d):
    """Events as points on a page, all products as boxes."""
    points = table(spark, d, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 4).alias("page"), ((F.col("event_id") * 37 % 1000) / 1000).alias("px"), ((F.col("event_id") * 91 % 997) / 997).alias("py")
    )
    k = F.col("p_partkey")
    boxes = products(spark, d).select(
        (k % 4).alias("page"), k.alias("box_id"), ((k * 53 % 90) / 100).alias("x"), ((k * 29 % 90) / 100).alias("y"), (((k % 7) + 1) / 100).alias("w"), (((k % 5) + 1) / 100).alias("h")
    )
    return resolve.boxes_hit(points, boxes, "page", 0.04)


def history_size_join(spark, d):
    """Per product the products of its brand, itself too, whose size differs by 3% at
    most; counted per size, so that no pairs of products are made."""
    rows = products(spark, d).select("p_brand", F.col("p_partkey").alias("b"), F.col("p_size").cast("double").alias("size"))
    sizes = rows.groupBy("p_brand", "size").agg(F.count("*").alias("n"))
    mine, other = sizes.select("p_brand", F.col("size").alias("sb")), sizes.withColumnRenamed("size", "sa")
    alike = resolve.band_join(other, mine, ["p_brand"], "sa", "sb", 0.03).groupBy("p_brand", F.col("sb").alias("size")).agg(F.sum("n").alias("alike"))
    return rows.join(alike, ["p_brand", "size"]).select("b", "alike")


def recent_searches(spark, d):
    rows = table(spark, d, "events").select("user_id", F.concat("event_type", (F.col("event_id") % 5).cast("string")).alias("query"), "ts", "event_id")
    newest = [F.col("ts").desc(), F.col("event_id").desc()]
    return merge.newest_distinct(rows, ["user_id"], "query", newest, 8).select("user_id", "rank", "query")


def learned_counts(spark, d):
    rows = table(spark, d, "events").filter("event_type = 'click'").withColumn("signal", F.get_json_object("props", "$.k").try_cast("int"))
    counts = rows.groupBy("user_id", "signal").agg(F.least(F.count("*"), F.lit(40)).alias("n"), F.max("event_id").alias("_last"))
    order = Window.partitionBy("user_id").orderBy(F.col("n").desc(), F.col("_last").desc())
    kept = counts.withColumn("_rn", F.row_number().over(order)).filter("_rn <= 24")
    return kept.groupBy("user_id").agg(F.count("*").alias("signals"), F.sum(F.least("n", F.lit(20))).alias("saturated"))


def offer_to_brochure(spark, d):
    """Line items to orders by key, else by the customer with that number."""
    offers = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") > 3, F.col("l_orderkey")).alias("exact"), F.col("l_suppkey").alias("loose"))
    flyers = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey")).alias("by_id"), F.col("o_custkey").alias("by_customer"))
    found = resolve.first_match(offers, flyers, [("exact", "by_id"), ("loose", "by_customer")], "o_orderkey", "o_orderkey")
    return found.groupBy("matched_by").agg(F.count("*").alias("offers"), F.count_distinct("o_orderkey").alias("flyers"))


def latest_upsert(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "value", "ts", "event_id")
    return merge.latest_by_key(rows, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "value", "event_id")


def cart_state(spark, d):
    action = F.when(F.col("event_type") == "purchase", "add").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "toggle").otherwise("none")
    rows = table(spark, d, "events").select(F.col("user_id").alias("cart"), (F.col("event_id") % 3).alias("item"), F.col("event_id").alias("ord"), action.alias("action"), F.lit(1).alias("qty"))
    return merge.apply_cart_events(rows)


def usable_prices(spark, d):
    from ..sources.listings import usable_price

    rows = table(spark, d, "events").withColumn("raw", F.when(F.col("event_id") % 7 == 0, "12abc").when(F.col("event_id") % 7 == 1, " 3.5 ").otherwise(F.col("value").cast("string")))
    return rows.groupBy("event_type").agg(F.count(usable_price(F.col("raw"))).alias("usable"), F.count("*").alias("listings"))


def event_windows(spark, d):
    """The batch twin of the streaming windowed lows."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("ts", "1 day"), "user_id").agg(F.min("value").alias("low"), F.count("*").alias("n")).select(F.col("window.start").cast("date").cast("string").alias("day"), "user_id", "low", "n")


QUERIES = {
    "best_value": best_value,
    "cheapest_per_store": cheapest_per_store,
    "price_range_summary": price_range_summary,
    "unit_outliers": unit_outliers,
    "median_price_penalty": median_price_penalty,
    "discount_bands": discount_bands,
    "dominant_kind": dominant_kind,
    "normalize_text": normalize_text,
    "token_inventory": token_inventory,
    "synonym_expand": synonym_expand,
    "family_tiers": family_tiers,
    "form_keyword": form_keyword,
    "parse_sizes": parse_sizes,
    "unit_price": unit_price,
    "relevance_score": relevance_score,
    "match_stage": match_stage,
    "gate_ladder_summary": gate_ladder("summary"),
    "gate_ladder_alert": gate_ladder("alert"),
    "gate_ladder_history": gate_ladder("history"),
    "identity_lock": identity_lock,
    "canonical_pull_in": canonical_pull_in,
    "shared_best_price": shared_best_price,
    "headline_decision": headline_decision,
    "rank_lowest_price": _ranked("price"),
    "rank_best_value": _ranked("value"),
    "rank_featured": _ranked("featured"),
    "dedupe_jaccard": dedupe_jaccard,
    "group_equivalents": group_equivalents,
    "group_branded": group_branded,
    "canonical_groups": canonical_groups,
    "history_points": history_points,
    "history_summary": history_summary,
    "history_size_join": history_size_join,
    "lowest_ever": lowest_ever,
    "history_verdict": history_verdict,
    "back_on_offer": back_on_offer,
    "deal_score": deal_score,
    "browse_tiles": browse_tiles,
    "browse_facets": browse_facets,
    "browse_listing_page": browse_listing_page,
    "brand_mining": brand_mining,
    "cart_rollup": cart_rollup,
    "cart_state": cart_state,
    "watch_crossings": watch_crossings,
    "watch_states": watch_states,
    "alert_counts": alert_counts,
    "json_props": json_props,
    "url_provenance": url_provenance,
    "spatial_hit": spatial_hit,
    "recent_searches": recent_searches,
    "learned_counts": learned_counts,
    "offer_to_brochure": offer_to_brochure,
    "latest_upsert": latest_upsert,
    "usable_prices": usable_prices,
    "event_windows": event_windows,
}
