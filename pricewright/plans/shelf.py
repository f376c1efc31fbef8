"""Queries of lists, rails, watches, profiles and the registry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching, size
from ..operators import history, lists, phrases, profiles, rails, registry, search
from ..sources.store import materialize
from .oracles import _STAGED, L, NOUN, greedy, ladder
from .queries import HISTORY_ORDER
from .tables import PARTS, dealt_products, items_of, listings, products, queries, table

TODAY = "1998-06-15"


def _today():
    return F.lit(TODAY).cast("date")


# lists


def elsewhere(spark, d):
    """For each query as a product of store s0 of 10 pieces: its cheapest offers in
    other stores."""
    rows = items_of(spark, d).withColumns({"store": F.concat(F.lit("s"), F.col("ord") % 5), "size": size.parse_size(F.concat(F.col("pieces").cast("string"), F.lit(" kg")))})
    asked = queries(spark).withColumns({"own_ord": F.lit(-1).cast("long"), "own_store": F.lit("s0"), "own_size": size.parse_size(F.lit("10 kg"))})  # read once a query, not a pair
    found = search.candidates(matching.with_query(asked, PARTS), matching.with_item(rows, PARTS))
    return lists.elsewhere(found, PARTS).select("query_id", "rank", F.col("ord").alias("p_partkey"))


ELSEWHERE = f"""WITH {_STAGED} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p_retailprice, p_partkey) AS INT) AS rank, p_partkey
FROM staged WHERE p_partkey % 5 <> 0 AND abs(p_size - 10) <= 2.5 QUALIFY rank <= 4"""


def similar(spark, d):
    items = matching.with_item(items_of(spark, d), PARTS).select("ord", F.col("it.family").alias("family"), F.col("it.form").alias("form"))
    items = materialize(items, "similar-items")  # read twice, and its filter would be asked before the rows are dealt
    return lists.similar(items.withColumnRenamed("ord", "id"), items).select(F.col("id").alias("p_partkey"), "rank", F.col("ord").alias("other"))


def _cart(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        F.col("user_id").alias("cart"), (e % 4).alias("store"), e.alias("item"), F.when(e % 3 != 0, (e % 5).cast("int")).alias("qty"), (e % 7 == 0).alias("purchased"),
        F.when(e % 11 != 0, F.col("ts").cast("timestamp")).alias("added_at"),
    )


def cart_order(spark, d):
    return lists.cart_order(_cart(spark, d)).select("cart", "store", "place", "item")


def cart_counts(spark, d):
    return lists.cart_counts(_cart(spark, d)).select("cart", F.col("pieces").cast("long").alias("pieces"))


def brand_index(spark, d):
    """Part names in their index: letter and place, case and marks aside."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.initcap("p_name")).when(k % 3 == 1, F.col("p_name")).otherwise(F.translate(F.upper("p_name"), "OE", "ÖÉ"))
    return lists.brands_in_order(products(spark, d).select(name.alias("name")).distinct(), "name").select("name", "letter", "place")


BRAND_INDEX = """WITH n AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:]
  WHEN 1 THEN p_name ELSE translate(upper(p_name), 'OE', 'ÖÉ') END AS name FROM part)
SELECT name, upper(name[1]) AS letter, CAST(row_number() OVER (PARTITION BY upper(name[1]) ORDER BY lower(translate(name, 'ÖÉ', 'oe')), name) AS INT) AS place FROM n"""


def browse_newest(spark, d):
    """The second page of the newest offers of one store."""
    rows = listings(spark, d).select(
        F.concat("l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey", F.lit("-"), "l_suppkey").alias("ord"), F.col("l_suppkey").cast("string").alias("store"),
        F.col("day").alias("first_seen"), "price", F.col("l_discount").alias("discount"),
    )
    return lists.browse_page(rows, {"store": "3"}, "newest", page=1).select("ord", "price")


BROWSE_NEWEST = f"""WITH {L} SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS ord, price FROM l WHERE l_suppkey = 3
ORDER BY day DESC, ord LIMIT 24 OFFSET 24"""


# rails


def price_variants(spark, d):
    out = rails.variants(listings(spark, d), ["l_partkey"], "unit", "day", "l_suppkey", ["l_orderkey", "l_linenumber"])
    cheapest = F.get("latest", F.lit(0))
    return out.select("l_partkey", "lowest", "weeks", F.size("latest").alias("stores"), cheapest["price"].alias("latest_low"), cheapest["store"].alias("latest_store"), "trend")


PRICE_VARIANTS = f"""WITH {L},
s AS (SELECT l_partkey, l_suppkey, unit FROM l QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC) = 1),
c AS (SELECT l_partkey, count(*) AS stores, min(unit) AS latest_low, min_by(l_suppkey, (unit, l_suppkey)) AS latest_store FROM s GROUP BY 1),
t AS (SELECT l_partkey, unit - lead(unit) OVER w AS step, row_number() OVER w AS rn FROM l WINDOW w AS (PARTITION BY l_partkey ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, unit DESC)),
g AS (SELECT l_partkey, min(unit) AS lowest, count(DISTINCT date_trunc('week', day)) AS weeks FROM l GROUP BY 1)
SELECT l_partkey, lowest, weeks, CAST(stores AS INT) AS stores, latest_low, latest_store, CASE WHEN step < 0 THEN 'down' WHEN step > 0 THEN 'up' WHEN step = 0 THEN 'flat' END AS trend
FROM g JOIN c USING (l_partkey) JOIN t USING (l_partkey) WHERE rn = 1"""


def history_read(spark, d):
    """What each query reads from the price history: by size, the lowest with its store
    and day, how deep it is, and the verdict on the cheapest of today's stores."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    items = items_of(spark, d).withColumn("pack", F.concat((F.col("pieces") % 4 + 1).cast("string"), F.lit(" kg")))
    found = search.candidates(matching.with_query(queries(spark), PARTS), matching.with_item(items, PARTS, size="pack"))
    seen = listings(spark, d).withColumn("ord", F.col("l_partkey"))
    out = rails.history_read(found, seen, PARTS, "unit", "day", "l_suppkey", order)
    low = F.get("latest", F.lit(0))["price"]
    return out.select(
        "query_id", "size", "lowest", "lowest_store", F.col("lowest_day").cast("string").alias("lowest_day"), "highest", "weeks", "observations", F.size("latest").alias("stores"),
        low.alias("latest_low"), history.verdict(low, F.col("lowest"), F.col("weeks")).alias("verdict"), "trend",
    )


HISTORY_READ = f"""{ladder("primary", False, True)},
{L},
o AS (SELECT query_id, 'g:' || CAST((p_size % 4 + 1) * 1000.0::DOUBLE AS VARCHAR) AS size, l.* FROM g6 JOIN l ON l_partkey = p_partkey WHERE in3),
s AS (SELECT query_id, size, l_suppkey, unit FROM o QUALIFY row_number() OVER (PARTITION BY query_id, size, l_suppkey ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1),
c AS (SELECT query_id, size, count(*) AS stores, min(unit) AS latest_low FROM s GROUP BY ALL),
t AS (SELECT query_id, size, unit - lead(unit) OVER w AS step, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY query_id, size ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, unit DESC)),
m AS (SELECT query_id, size, l_suppkey AS lowest_store, CAST(day AS VARCHAR) AS lowest_day FROM o QUALIFY row_number() OVER (PARTITION BY query_id, size ORDER BY unit, l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1),
g AS (SELECT query_id, size, min(unit) AS lowest, max(unit) AS highest, count(DISTINCT date_trunc('week', day)) AS weeks, count(*) AS observations FROM o GROUP BY ALL)
SELECT CAST(query_id AS INT) AS query_id, size, lowest, lowest_store, lowest_day, highest, weeks, observations, CAST(stores AS INT) AS stores, latest_low,
  CASE WHEN weeks < 2 THEN 'building' WHEN latest_low <= lowest + 1e-9 THEN 'at-low' WHEN (latest_low - lowest) / lowest <= 0.1 THEN 'near-low' ELSE 'above-low' END AS verdict,
  CASE WHEN step < 0 THEN 'down' WHEN step > 0 THEN 'up' WHEN step = 0 THEN 'flat' END AS trend
FROM g JOIN c USING (query_id, size) JOIN t USING (query_id, size) JOIN m USING (query_id, size) WHERE rn = 1"""


def new_products(spark, d):
    return rails.new_this_week(listings(spark, d), ["l_suppkey", "l_partkey"], "day", _today()).select("l_suppkey", "l_partkey", F.col("first_seen").cast("string").alias("first_seen"))


def seasons(spark, d):
    """Parts of ten as aisles."""
    rows = listings(spark, d).select((F.col("l_partkey") % 10).alias("aisle"), "day")
    out = rails.in_season(rows, "aisle", "day")
    return out.select("aisle", F.col("week").cast("string").alias("week"), F.round("share", 9).alias("share"), F.round("usual", 9).alias("usual"))


SEASONS = f"""WITH {L}, n AS (SELECT date_trunc('week', day)::DATE AS week, l_partkey % 10 AS aisle, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT week, sum(n) AS total, row_number() OVER (ORDER BY week) AS no FROM n GROUP BY week),
s AS (SELECT aisle, week, no, n / total AS share FROM n JOIN t USING (week)),
u AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY aisle ORDER BY no RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING), 0) / 8 AS usual FROM s)
SELECT aisle, week::VARCHAR AS week, round(share, 9) AS share, round(usual, 9) AS usual FROM u WHERE no > 8 AND share >= 2 * usual"""


def biggest_drops(spark, d):
    rows = listings(spark, d).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "price")
    out = rails.biggest_drops(rows, "l_suppkey", "l_extendedprice", "price", ["price", "l_orderkey", "l_linenumber", "l_partkey"], 5)
    return out.select("l_suppkey", "rank", "l_orderkey", "l_linenumber", "l_partkey")


def identity_badges(spark, d):
    """Offers with their identity's history: single-word names have none."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.split("p_name", " ")[1]).otherwise(F.col("p_name"))
    parts = dealt_products(spark, d).select(k.alias("l_partkey"), rails.price_identity(F.lit("s"), F.lit("r"), name, F.lit(None).cast("string"), size.parse_size(F.concat("p_size", F.lit(" kg")))).alias("identity"))
    parts = materialize(parts, "badge-identities")  # read once; its filter would be asked before the rows are dealt
    rows = listings(spark, d).join(parts, "l_partkey")
    seen = rows.filter("identity IS NOT NULL").groupBy("identity").agg(F.min("unit").alias("lowest"), F.count_distinct(F.date_trunc("week", F.col("day").cast("timestamp"))).alias("weeks"))
    out = rails.with_history_badges(rows.select("l_suppkey", "identity", F.col("unit").alias("price")), seen)
    return out.groupBy("l_suppkey").agg(F.count("*").alias("offers"), F.count("identity").alias("known"), F.count("lowest_weeks").alias("lowest"), F.max("lowest_weeks").alias("most_weeks"))


IDENTITY_BADGES = f"""WITH {L}, p AS (SELECT l.*, CASE WHEN p_partkey % 4 <> 0 THEN p_name || p_size END AS id FROM l JOIN part ON l_partkey = p_partkey),
s AS (SELECT id, min(unit) AS lowest, count(DISTINCT date_trunc('week', day)) AS weeks FROM p WHERE id IS NOT NULL GROUP BY id)
SELECT l_suppkey, count(*) AS offers, count(id) AS known, count(*) FILTER (WHERE unit <= lowest AND weeks >= 4) AS lowest, max(weeks) FILTER (WHERE unit <= lowest AND weeks >= 4) AS most_weeks
FROM p LEFT JOIN s USING (id) GROUP BY l_suppkey"""


def collections(spark, d):
    shelves = spark.createDataFrame(
        [("cold-things", ["1", "2"], ["fastener"], None), ("tools", None, ["tool"], None), ("summer", ["3"], None, "june"), ("winter", ["4"], None, "december"), ("all", None, None, None)],
        "collection string, aisles array<string>, families array<string>, window string",
    )
    days = spark.createDataFrame([("june", "1998-06-01", "1998-06-30"), ("june", "1998-06-10", "1998-06-20"), ("december", "1998-12-01", "1998-12-31")], "window string, first string, last string")
    offers = matching.with_item(items_of(spark, d), PARTS).select("ord", (F.col("ord") % 6).cast("string").alias("aisle"), F.col("it.family").alias("family"))
    days = days.select("window", F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last"))
    return rails.in_collections(offers, shelves, days, _today()).select("collection", F.col("ord").alias("p_partkey"))


COLLECTIONS = f"""WITH p AS (SELECT p_partkey, p_partkey % 6 AS aisle, {NOUN} AS fam FROM part)
SELECT 'cold-things' AS collection, p_partkey FROM p WHERE aisle IN (1, 2) AND fam = 'fastener' UNION ALL SELECT 'tools', p_partkey FROM p WHERE fam = 'tool'
UNION ALL SELECT 'summer', p_partkey FROM p WHERE aisle = 3 UNION ALL SELECT 'all', p_partkey FROM p"""


# watches and profiles


def watch_checks(spark, d):
    """A check of a watch for each query, of 8 pieces and with a target; no product has
    the size of watch 5, and none has a price for watch 8."""
    rows = items_of(spark, d).withColumns({"source": F.when(F.col("kind") == "PROMO", "flyer").otherwise("online"), "size": size.parse_size(F.concat(F.col("pieces").cast("string"), F.lit(" kg"))), "price": F.when(F.col("ord") % 9 != 0, F.col("price"))})
    own = F.when(F.col("query_id") == 5, "900 kg").otherwise("8 kg")
    asked = queries(spark).withColumn("own_size", size.parse_size(own))  # read once a query, not a pair
    found = search.candidates(matching.with_query(asked, PARTS), matching.with_item(rows, PARTS))
    pairs = found.withColumn("watch_id", F.col("query_id")).withColumn("price", F.when(F.col("query_id") != 8, F.col("price")))
    judged = profiles.watch_candidates(pairs, PARTS).select("watch_id", "ord", "price", "reason")
    watches = queries(spark).select(F.col("query_id").alias("watch_id"), F.when(F.col("query_id") < 4, 10000.0).otherwise(1.0).alias("target"), (F.col("query_id") == 2).alias("below"))
    return profiles.evaluated_watches(judged, watches).select("watch_id", "price", F.col("best").alias("p_partkey"), "fires", "below", "resolution")


WATCH_CHECKS = f"""WITH {_STAGED},
r AS (SELECT *, CASE WHEN n = 1 THEN 100.0 ELSE (CASE WHEN a1 OR b1 THEN 100 ELSE 0 END + CASE WHEN a2 OR b2 THEN 100 ELSE 0 END) / 2.0
  * (0.5 + 0.5 * (CAST(a1 OR b1 AS INT) + CAST(a2 OR b2 AS INT)) / 2.0) END AS rel FROM staged),
j AS (SELECT *, CASE WHEN p_partkey % 9 = 0 OR query_id = 8 THEN 'no-price' WHEN rel < 50 THEN 'relevance' WHEN query_id = 5 OR abs(p_size - 8) > 2 THEN 'size'
  WHEN p_type = 'PROMO' AND n > 1 AND NOT ((a1 OR b1) AND (a2 OR b2)) THEN 'name' END AS reason FROM r),
b AS (SELECT query_id, min(p_retailprice) AS price, min_by(p_partkey, (p_retailprice, p_partkey)) AS p_partkey FROM j WHERE reason IS NULL GROUP BY 1),
y AS (SELECT query_id, max_by(reason, list_position(['no-price', 'relevance', 'size', 'name'], reason)) AS why FROM j WHERE reason IS NOT NULL GROUP BY 1),
w AS (SELECT i AS watch_id, CASE WHEN i < 4 THEN 10000.0 ELSE 1.0 END AS target, i = 2 AS was FROM range(1, 9) t(i))
SELECT CAST(watch_id AS INT) AS watch_id, price, p_partkey, coalesce(price <= target + 1e-9 AND NOT was, false) AS fires, coalesce(price <= target + 1e-9, was) AS below,
  CASE WHEN p_partkey IS NOT NULL THEN 'resolved' ELSE coalesce(why, 'no-candidate') END AS resolution
FROM w LEFT JOIN b ON watch_id = b.query_id LEFT JOIN y ON watch_id = y.query_id"""


def identity_gates(spark, d):
    """How each part meets a watch that pins family and size, strict and flexible."""
    k = F.col("p_partkey")
    noun = F.split("p_name", " ")[1]
    pinned = F.create_map(F.lit("family"), F.lit("bolt"), F.lit("size"), F.lit("7"))
    evidence = F.create_map(F.lit("family"), noun, F.lit("size"), F.when(k % 3 != 0, (F.col("p_size") % 10).cast("string")))
    rows = products(spark, d).withColumns({"strict": profiles.identity_gate(pinned, evidence, True), "flexible": profiles.identity_gate(pinned, evidence, False)})
    return rows.groupBy("strict", "flexible").agg(F.count("*").alias("parts"))


IDENTITY_GATES = """WITH p AS (SELECT split_part(p_name, ' ', 2) <> 'bolt' AS off, p_partkey % 3 = 0 AS dim, p_size % 10 <> 7 AS odd FROM part)
SELECT CASE WHEN off THEN 'conflict:family' WHEN NOT dim AND odd THEN 'conflict:size' WHEN dim THEN 'abstain:size' ELSE 'match' END AS strict,
  CASE WHEN off THEN 'conflict:family' WHEN NOT dim AND odd THEN 'conflict:size' WHEN dim THEN 'unpinned:size' ELSE 'match' END AS flexible, count(*) AS parts FROM p GROUP BY ALL"""


def _watches(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(
        c.alias("watch_id"), F.when(c % 10 != 0, F.concat(F.lit("p"), (c % 3).cast("string"))).alias("profile_id"), (c % 4 != 0).alias("active"), (c % 50).alias("created"), F.col("c_acctbal").alias("target")
    )


def checked_watches(spark, d):
    """The watches that are checked, orphans adopted by the profile that asked first."""
    calls = spark.createDataFrame([("p2", 5), ("p1", 3), ("p1", 9)], "profile_id string, at int")
    return profiles.active_watches(profiles.adopt_orphans(_watches(spark, d), calls)).select("watch_id", "profile_id")


CHECKED = """WITH w AS (SELECT c_custkey AS watch_id, CASE WHEN c_custkey % 10 = 0 THEN 'p1' ELSE 'p' || (c_custkey % 3) END AS profile_id, c_custkey % 50 AS created FROM customer WHERE c_custkey % 4 <> 0),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY created, watch_id) <= 24)
SELECT watch_id, profile_id FROM f ORDER BY created, watch_id LIMIT 90"""


def changed_watches(spark, d):
    """Watches after changes by orders: some under another profile, some repeated."""
    o = F.col("o_custkey")
    rows = table(spark, d, "orders").filter("o_orderkey % 2 = 0")
    changes = rows.select(
        F.when(F.col("o_orderkey") % 8 == 0, o + 100000).otherwise(o).alias("watch_id"),
        F.concat(F.lit("p"), (F.when(F.col("o_orderkey") % 6 == 0, o + 1).otherwise(o) % 3).cast("string")).alias("profile_id"),
        F.lit(True).alias("active"), F.lit(7).cast("long").alias("created"), F.col("o_totalprice").alias("target"),
        F.when(F.col("o_orderkey") % 8 == 0, "create").when(F.col("o_orderkey") % 10 == 0, "delete").otherwise("update").alias("action"),
        F.col("o_orderkey").alias("at"),
    )
    out = profiles.changed_watches(_watches(spark, d), changes)
    return out.select("watch_id", "profile_id", "active", "target")


CHANGED = """WITH w AS (SELECT c_custkey AS watch_id, CASE WHEN c_custkey % 10 <> 0 THEN 'p' || (c_custkey % 3) END AS profile_id, c_custkey % 4 <> 0 AS active, c_acctbal AS target FROM customer),
c AS (SELECT CASE WHEN o_orderkey % 8 = 0 THEN o_custkey + 100000 ELSE o_custkey END AS watch_id, 'p' || (CASE WHEN o_orderkey % 6 = 0 THEN o_custkey + 1 ELSE o_custkey END % 3) AS profile_id,
  o_totalprice AS target, CASE WHEN o_orderkey % 8 = 0 THEN 'create' WHEN o_orderkey % 10 = 0 THEN 'delete' ELSE 'update' END AS action, o_orderkey AS "at" FROM orders WHERE o_orderkey % 2 = 0),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY watch_id, profile_id ORDER BY "at" DESC) = 1),
a AS (SELECT l.* FROM l LEFT JOIN w USING (watch_id) WHERE (w.watch_id IS NULL AND action = 'create') OR w.profile_id = l.profile_id),
n AS (SELECT watch_id, profile_id, true AS active, target FROM a WHERE action <> 'delete' QUALIFY row_number() OVER (PARTITION BY watch_id ORDER BY profile_id) = 1)
SELECT * FROM n UNION ALL SELECT * FROM w WHERE watch_id NOT IN (SELECT watch_id FROM a)"""


def seen_profiles(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("browser"), F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("p"), "c_custkey")).alias("profile_id"), F.lit(1).cast("long").alias("created"), F.lit(2).cast("long").alias("seen"))
    visits = table(spark, d, "events").select(F.col("user_id").alias("browser"), F.concat(F.lit("n"), "event_id").alias("profile_id"), F.col("event_id").alias("at"))
    return profiles.seen_profiles(old, visits)


SEEN = """WITH o AS (SELECT c_custkey AS browser, 'p' || c_custkey AS profile_id FROM customer WHERE c_custkey % 7 <> 0),
v AS (SELECT user_id AS browser, 'n' || min(event_id) AS new_id, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1)
SELECT coalesce(o.browser, v.browser) AS browser, coalesce(o.profile_id, new_id) AS profile_id, CAST(CASE WHEN o.browser IS NULL THEN first ELSE 1 END AS BIGINT) AS created,
  CAST(CASE WHEN o.browser IS NULL THEN last ELSE greatest(2, coalesce(last, 2)) END AS BIGINT) AS seen FROM o FULL JOIN v ON o.browser = v.browser"""


def reading_positions(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("reader"), (F.col("event_id") % 40).alias("brochure_id"), (F.col("event_id") % 9).alias("page"), F.col("event_id").alias("at"))
    return profiles.remembered_positions(rows.filter("at % 2 = 0"), rows.filter("at % 2 = 1")).select("reader", "brochure_id", "page", "at")


POSITIONS = """WITH l AS (SELECT user_id AS reader, event_id % 40 AS brochure_id, max(event_id) AS "at" FROM events GROUP BY ALL)
SELECT reader, brochure_id, "at" % 9 AS page, "at" FROM l QUALIFY row_number() OVER (PARTITION BY reader ORDER BY "at" DESC, brochure_id) <= 24"""


def source_scopes(spark, d):
    k = F.col("c_custkey")
    sources = F.array(*[F.lit(s) for s in ("a", "b", "c", "d")])
    saved = F.when(k % 3 == 0, F.array(F.lit("b"), F.lit("x"))).when(k % 3 == 1, F.array().cast("array<string>"))
    scope = profiles.source_scope(saved, F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))), sources)
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(scope), ",").alias("sources"))


SCOPES = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 OR c_custkey % 2 = 1 THEN 'a,b,c,d' WHEN c_custkey % 3 = 0 THEN 'b,d' ELSE 'd' END AS sources FROM customer"""


# registry


def _sightings(spark, d):
    """Parts as sightings of registry products that bear their names, brands and sizes,
    with a word more, and for every sixth with one of another product."""
    k = F.col("p_partkey")
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    words = F.when(k % 6 == 0, F.array(a, F.lit("odd"), F.lit("thing"))).otherwise(F.array(a, b, F.concat(F.lit("x"), (k % 50).cast("string"))))
    return products(spark, d).select(
        k.alias("sighting_id"), words.alias("tokens"), F.when(k % 4 == 0, "other").when(k % 4 == 1, "").otherwise(b).alias("brand"),
        F.when(k % 5 != 0, "kg").alias("unit"), F.when(k % 5 != 0, (k % 3 + 1).cast("double")).alias("total"), (k % 7).alias("store"), F.lit("1998-06-10").cast("date").alias("week"),
    )


def _registered(spark, d):
    rows = products(spark, d).select("p_name").distinct()
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    heavy = F.when(F.length(a) > 3, 2.0).otherwise(1.0)
    return rows.select(F.concat(F.lit("pr_"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("product_id"), F.array(a, b).alias("tokens"), b.alias("brand"), F.lit("kg").alias("unit"), heavy.alias("total"), F.lit("active").alias("state"), F.lit("1998-05-20").cast("date").alias("last_seen"))


def registry_resolve(spark, d):
    found = registry.resolve_sightings(_sightings(spark, d), _registered(spark, d))
    return found.select(F.col("sighting_id").alias("p_partkey"), F.when(F.col("band") == "attach", F.col("product_id")).alias("product_id"), F.round("score", 6).alias("score"), "band")


REGISTRY = """WITH s AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 6 = 0 AS odd,
  CASE p_partkey % 4 WHEN 0 THEN 'other' WHEN 1 THEN '' ELSE split_part(p_name, ' ', 2) END AS brand, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 3 + 1 END AS total FROM part),
r AS (SELECT DISTINCT 'pr_' || replace(p_name, ' ', '_') AS product_id, split_part(p_name, ' ', 1) AS ra, split_part(p_name, ' ', 2) AS rb, CASE WHEN length(split_part(p_name, ' ', 1)) > 3 THEN 2 ELSE 1 END AS rt FROM part),
m AS (SELECT p_partkey, product_id, (CASE WHEN a = ra THEN 1 ELSE 0 END + CASE WHEN NOT odd AND b = rb THEN 1 ELSE 0 END) / 2.0 - CASE WHEN brand <> '' AND brand <> rb THEN 0.25 ELSE 0 END AS score
  FROM s JOIN r ON (a = ra OR (NOT odd AND b = rb)) WHERE total IS NULL OR total = rt),
t AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, product_id) = 1)
SELECT p_partkey, CASE WHEN t.score >= 0.6 THEN t.product_id END AS product_id, CASE WHEN t.score >= 0.45 THEN round(t.score::DOUBLE, 6) END AS score,
  CASE WHEN t.score >= 0.6 THEN 'attach' WHEN t.score >= 0.45 THEN 'review' ELSE 'create' END AS band FROM s LEFT JOIN t USING (p_partkey)"""


def registry_lifecycle(spark, d):
    """Products after the sightings of a week: what they learned, and which sleep."""
    sightings = _sightings(spark, d)
    found = registry.resolve_sightings(sightings, _registered(spark, d))
    after = registry.put_to_sleep(registry.taught(_registered(spark, d), sightings, found), F.lit("1998-07-15").cast("date"))
    return after.select("product_id", "state", F.col("last_seen").cast("string").alias("last_seen"), F.size("tokens").alias("tokens"))


LIFECYCLE = f"""WITH q AS ({REGISTRY}), x AS (SELECT product_id, count(DISTINCT p_partkey % 50) AS learned FROM q WHERE band = 'attach' GROUP BY 1),
r AS (SELECT DISTINCT 'pr_' || replace(p_name, ' ', '_') AS product_id FROM part)
SELECT product_id, CASE WHEN learned IS NULL THEN 'dormant' ELSE 'active' END AS state, CASE WHEN learned IS NULL THEN '1998-05-20' ELSE '1998-06-10' END AS last_seen, CAST(2 + coalesce(learned, 0) AS INT) AS tokens
FROM r LEFT JOIN x USING (product_id)"""


def registry_merges(spark, d):
    """Doubles among products that bear the same words: each part is one, minted by its
    brand; they merge where a store or the size is the same."""
    k = F.col("p_partkey")
    rows = products(spark, d).select(
        k.alias("product_id"), F.split("p_name", " ").alias("tokens"), F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("brand"), F.when(k % 3 != 0, "kg").alias("unit"),
        F.when(k % 3 != 0, F.col("p_size").cast("double")).alias("total"), (k % 4).alias("store"),
    )
    return registry.merge_targets(rows, rows.select("product_id", "store")).select(F.col("product_id").alias("p_partkey"), "merged_into")


MERGES = greedy(
    "SELECT p_name AS block, p_partkey AS ord, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS brand, CASE WHEN p_partkey % 3 <> 0 THEN p_size::DOUBLE END AS total, p_partkey % 4 AS store FROM part",
    "brand VARCHAR, total DOUBLE, store BIGINT",
    """(k.total IS NULL OR n.total IS NULL OR abs(k.total - n.total) <= 0.03 * greatest(k.total, n.total)) AND (k.brand = '' OR n.brand = '' OR k.brand = n.brand)
    AND (k.store = n.store OR coalesce(abs(k.total - n.total) <= 0.03 * greatest(k.total, n.total), false))""",
) + " SELECT ord AS p_partkey, leader AS merged_into FROM r WHERE i > 0 AND leader <> ord"


def acceptance(spark, d):
    """Which parts may be shown, and what the others lack."""
    k = F.col("p_partkey")
    verdict = registry.acceptance({"name": F.col("p_name").contains("o"), "size": F.col("p_size") < 20, "price": F.when(k % 3 != 0, F.col("p_retailprice") > 950)})
    rows = products(spark, d).withColumn("v", verdict)
    return rows.groupBy("v.verdict", F.array_join("v.missing", "+").alias("missing")).agg(F.count("*").alias("parts"))


ACCEPTANCE = """WITH v AS (SELECT array_to_string(list_filter([CASE WHEN NOT contains(p_name, 'o') THEN 'name' END, CASE WHEN p_size >= 20 THEN 'size' END,
  CASE WHEN p_partkey % 3 = 0 OR p_retailprice <= 950 THEN 'price' END], lambda x: x IS NOT NULL), '+') AS missing FROM part)
SELECT CASE WHEN missing = '' THEN 'accepted' ELSE 'rejected' END AS verdict, missing, count(*) AS parts FROM v GROUP BY ALL"""


def enriched_offers(spark, d):
    offers = products(spark, d).select(F.col("p_partkey").alias("offer_id"), "p_name", "p_brand")
    k = F.col("offer_id")
    other = offers.filter("offer_id % 2 = 0").select("offer_id", F.concat(F.lit("Fine "), "p_name").alias("p_name"), F.when(k % 3 == 0, "Seen").alias("p_brand"), (k % 5 != 0).alias("servable"))
    return registry.with_enrichment(offers, other, ["p_name", "p_brand"])


ENRICHED = """SELECT p_partkey AS offer_id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 <> 0 THEN 'Fine ' || p_name ELSE p_name END AS p_name,
  CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 3 = 0 THEN 'Seen' ELSE p_brand END AS p_brand, p_partkey % 2 = 0 AND p_partkey % 5 <> 0 AS enriched FROM part"""


def _long_names(spark, d):
    """Parts with names of three words and up to two more."""
    k = F.col("p_partkey")
    more = F.when(k % 4 == 0, " quite odd").when(k % 4 == 1, " 12 pcs").when(k % 4 == 2, " odd").otherwise("")
    return products(spark, d).select("*", F.split(F.concat(F.lower("p_type"), F.lit(" "), "p_name", more), " ").alias("words"), F.concat(F.lit("d"), k % 2).alias("department"))


def shelf_phrases(spark, d):
    """The head of each name in a dictionary drawn from the parts: nouns, names of every
    other, names with their type of those of one size; adjectives, of which some are
    claimed twice. Heads before two unknown words are refused."""
    parts = products(spark, d)
    noun, adjective = F.substring_index("p_name", " ", -1), F.substring_index("p_name", " ", 1)
    found = parts.select(noun.alias("phrase"), F.concat(F.lit("k_"), noun).alias("meaning"))
    found = found.union(parts.filter("p_partkey % 20 = 0").select("p_name", F.concat(F.lit("n_"), "p_name")))
    found = found.union(parts.filter("p_size = 7").select(F.concat(F.lower("p_type"), F.lit(" "), "p_name"), F.concat(F.lit("t_"), "p_name")))
    found = found.union(parts.select(adjective, F.when(F.length(adjective) > 3, F.concat(F.lit("a"), F.col("p_partkey") % 2)).otherwise("a")))
    heads = phrases.head_phrases(_long_names(spark, d), "p_partkey", "words", found.distinct())
    return heads.select("p_partkey", "phrase", "meaning", F.col("n").cast("int").alias("n"), "refused")


LONG_NAMES = """names AS (SELECT p_partkey, 'd' || p_partkey % 2 AS department,
  string_split(lower(p_type) || ' ' || p_name || CASE p_partkey % 4 WHEN 0 THEN ' quite odd' WHEN 1 THEN ' 12 pcs' WHEN 2 THEN ' odd' ELSE '' END, ' ') AS w FROM part),
places AS (SELECT p_partkey, department, w, unnest(range(1, len(w) + 1)) AS i FROM names),
grams AS (SELECT p_partkey, department, w, i, n, array_to_string(w[i : i + n - 1], ' ') AS phrase FROM places, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w))"""

PHRASES = f"""WITH claimed AS (SELECT split_part(p_name, ' ', 2) AS phrase, 'k_' || split_part(p_name, ' ', 2) AS meaning FROM part
  UNION SELECT p_name, 'n_' || p_name FROM part WHERE p_partkey % 20 = 0 UNION SELECT lower(p_type) || ' ' || p_name, 't_' || p_name FROM part WHERE p_size = 7
  UNION SELECT split_part(p_name, ' ', 1), CASE WHEN length(split_part(p_name, ' ', 1)) > 3 THEN 'a' || p_partkey % 2 ELSE 'a' END FROM part),
known AS (SELECT phrase, min(meaning) AS meaning FROM claimed GROUP BY 1 HAVING count(*) = 1),
{LONG_NAMES},
hits AS (SELECT * FROM grams JOIN known USING (phrase)),
heads AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, i DESC) = 1),
behind AS (SELECT h.p_partkey, count(*) AS unknown FROM heads h JOIN places p ON p.p_partkey = h.p_partkey AND p.i >= h.i + h.n
  WHERE NOT regexp_matches(p.w[p.i], '^[0-9]') AND NOT EXISTS (FROM hits x WHERE x.p_partkey = p.p_partkey AND p.i >= x.i AND p.i < x.i + x.n) GROUP BY 1)
SELECT p_partkey, phrase, meaning, CAST(n AS INT) AS n, coalesce(unknown, 0) >= 2 AS refused FROM heads LEFT JOIN behind USING (p_partkey)"""


def arabic_names(spark, d):
    words = {"bolt": "برغي", "ring": "خاتم", "red": "احمر", "hot": "حار", "mint": "نعناع"}
    k = F.col("p_partkey")
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    name = registry.arabic_name(b, F.array(a, F.lit("fine")), F.when(k % 2 == 0, "mint"), F.when(k % 3 == 0, F.col("p_brand")).otherwise(""), registry.counted_in_arabic((k % 12 + 1).cast("int"), "قطعة", "قطعتان", "قطع", "قطعة"), words)
    either = registry.is_either_offer(F.when(k % 2 == 0, F.concat("p_name", F.lit(" or "), F.reverse("p_name"))).otherwise(F.concat(b, F.lit(" or "), "p_name")))
    return products(spark, d).select("p_partkey", name.alias("name"), either.alias("either"))


ARABIC = """WITH n AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 12 + 1 AS c FROM part)
SELECT p_partkey, CASE WHEN b IN ('bolt', 'ring') THEN concat_ws(' ', CASE b WHEN 'bolt' THEN 'برغي' ELSE 'خاتم' END, CASE a WHEN 'red' THEN 'احمر' WHEN 'hot' THEN 'حار' END,
  CASE WHEN p_partkey % 2 = 0 THEN 'بنكهة نعناع' END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END,
  CASE WHEN c = 1 THEN 'قطعة' WHEN c = 2 THEN 'قطعتان' WHEN c <= 10 THEN c || ' قطع' ELSE c || ' قطعة' END) END AS name, p_partkey % 2 = 0 AS either FROM n"""


def _brands(spark, d):
    """A dictionary drawn from the parts: nouns, some of one department, names of those
    of one size, which some types bar, and a noun that two brands claim."""
    parts = products(spark, d)
    noun = F.substring_index("p_name", " ", -1)
    none = F.lit(None).cast("array<string>")
    one = F.when(F.length(noun) % 2 == 0, F.array(F.lit("d1")))
    found = parts.select(noun.alias("phrase"), F.concat(F.lit("Noun "), noun).alias("brand"), one.alias("departments"), none.alias("barred"))
    found = found.union(parts.filter("p_size = 3").select("p_name", F.concat(F.lit("Line "), "p_name"), none, F.array(F.lit("promo"), F.lit("small"))))
    return found.union(parts.filter("p_name LIKE '% bolt'").select(noun, F.lit("Other"), none, none)).distinct()


def brand_tags(spark, d):
    """Brands of one word or two, of one department, barred by a neighbour; names are
    there twice."""
    rows = _long_names(spark, d).select("p_partkey", "words", "department")
    return phrases.branded(rows.union(rows), "words", _brands(spark, d), "department").select("p_partkey", "brand")


BRAND_TAGS = f"""WITH {LONG_NAMES},
nouns AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS phrase FROM part),
lines AS (SELECT DISTINCT p_name AS phrase FROM part WHERE p_size = 3),
hits AS (SELECT p_partkey, i, n, 'Noun ' || phrase AS brand FROM grams JOIN nouns USING (phrase) WHERE phrase <> 'bolt' AND (length(phrase) % 2 = 1 OR department = 'd1')
  UNION ALL SELECT p_partkey, i, n, 'Line ' || phrase FROM grams JOIN lines USING (phrase)
  WHERE coalesce(CASE WHEN i > 1 THEN w[i - 1] END, '') NOT IN ('promo', 'small') AND coalesce(w[i + 2], '') NOT IN ('promo', 'small')),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY i, n DESC) = 1)
SELECT p_partkey, brand FROM (SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part) LEFT JOIN best USING (p_partkey)"""


def brand_collisions(spark, d):
    """Phrases that two brands claim."""
    return phrases.collisions(_brands(spark, d), "brand").select("phrase", F.array_join("claims", ", ").alias("claims"))


BRAND_COLLISIONS = "SELECT DISTINCT 'bolt' AS phrase, 'Noun bolt, Other' AS claims FROM part WHERE p_name LIKE '% bolt'"


def moved_shelves(spark, d):
    """Shelves moved by markers unless a guard stands beside; names without a marker."""
    k = F.col("p_partkey")
    name = F.when(k % 5 != 0, F.col("p_name"))
    shelf = registry.produce_shelf(name, F.lit("fresh"), {"frozen": (["cold"], ["ring", "rod"]), "warm": (["hot"], [])})
    rows = products(spark, d).select(shelf.alias("shelf"), registry.without_marker(name, F.lit(None).cast("string"), "bolt").alias("plain"))
    return rows.groupBy("shelf", "plain").agg(F.count("*").alias("parts"))


MOVED = """WITH n AS (SELECT split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 5 = 0 AS none FROM part)
SELECT CASE WHEN none THEN 'fresh' WHEN a = 'hot' THEN 'warm' WHEN a = 'cold' AND b NOT IN ('ring', 'rod') THEN 'frozen' ELSE 'fresh' END AS shelf, none OR b <> 'bolt' AS plain, count(*) AS parts FROM n GROUP BY ALL"""


def comparable_quantities(spark, d):
    """The denominator of each part's price, how it is sold and from what evidence."""
    k = F.col("p_partkey")
    label = F.concat("p_name", F.when(k % 4 == 0, " 500 g").when(k % 4 == 1, " per kg").when(k % 4 == 2, " 2 kg per 500 gm").otherwise(""))
    q = size.comparable_quantity(label, F.lit(None).cast("string"))
    rows = dealt_products(spark, d).withColumn("q", q)
    price = F.try_divide(F.col("p_retailprice"), F.col("q.quantity"))
    return rows.select("p_partkey", "q.unit", "q.quantity", "q.selling", "q.evidence", price.alias("unit_value"))


QUANTITIES = """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'kg' END AS unit, CASE p_partkey % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE END AS quantity,
  CASE p_partkey % 4 WHEN 0 THEN 'discrete' WHEN 1 THEN 'continuous' END AS selling, CASE p_partkey % 4 WHEN 0 THEN 'package' WHEN 1 THEN 'stated' WHEN 2 THEN 'contradiction' ELSE 'none' END AS evidence,
  CASE p_partkey % 4 WHEN 0 THEN p_retailprice / 0.5::DOUBLE WHEN 1 THEN p_retailprice END AS unit_value FROM part"""

QUERIES = {
    "elsewhere": elsewhere, "similar": similar, "cart_order": cart_order, "cart_counts": cart_counts, "brand_index": brand_index, "browse_newest": browse_newest,
    "price_variants": price_variants, "history_read": history_read, "new_products": new_products, "seasons": seasons, "biggest_drops": biggest_drops, "identity_badges": identity_badges, "collections": collections,
    "watch_checks": watch_checks, "identity_gates": identity_gates, "checked_watches": checked_watches, "changed_watches": changed_watches, "seen_profiles": seen_profiles,
    "reading_positions": reading_positions, "source_scopes": source_scopes, "registry_resolve": registry_resolve, "registry_lifecycle": registry_lifecycle, "registry_merges": registry_merges,
    "acceptance": acceptance, "enriched_offers": enriched_offers, "shelf_phrases": shelf_phrases, "arabic_names": arabic_names, "brand_tags": brand_tags, "brand_collisions": brand_collisions, "moved_shelves": moved_shelves,
    "comparable_quantities": comparable_quantities,
}
SQL = {
    "elsewhere": ELSEWHERE,
    "similar": f"""WITH p AS (SELECT p_partkey, {NOUN} AS fam, CASE WHEN split_part(p_name, ' ', 1) IN ('hot', 'cold') THEN split_part(p_name, ' ', 1) END AS form FROM part)
SELECT x.p_partkey, CAST(row_number() OVER (PARTITION BY x.p_partkey ORDER BY y.p_partkey) AS INT) AS rank, y.p_partkey AS other FROM p x JOIN p y ON x.fam = y.fam AND x.p_partkey <> y.p_partkey
WHERE coalesce(x.form = y.form, true) QUALIFY rank <= 10""",
    "cart_order": """WITH c AS (SELECT user_id AS cart, event_id % 4 AS store, event_id AS item, event_id % 7 = 0 AS bought, CASE WHEN event_id % 11 <> 0 THEN ts END AS added FROM events)
SELECT cart, store, CAST(row_number() OVER (PARTITION BY cart, store ORDER BY bought, added DESC NULLS LAST, item) AS INT) AS place, item FROM c""",
    "cart_counts": "SELECT user_id AS cart, CAST(sum(CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 1 ELSE event_id % 5 END) AS BIGINT) AS pieces FROM events GROUP BY 1",
    "brand_index": BRAND_INDEX,
    "browse_newest": BROWSE_NEWEST,
    "price_variants": PRICE_VARIANTS,
    "history_read": HISTORY_READ,
    "new_products": f"""WITH {L} SELECT l_suppkey, l_partkey, min(day)::VARCHAR AS first_seen FROM l GROUP BY ALL HAVING date_trunc('week', min(day)) = date_trunc('week', DATE '{TODAY}')""",
    "seasons": SEASONS,
    "biggest_drops": f"""WITH {L} SELECT l_suppkey, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_extendedprice - price) / l_extendedprice DESC, price, l_orderkey, l_linenumber, l_partkey) AS INT) AS rank,
  l_orderkey, l_linenumber, l_partkey FROM l WHERE l_extendedprice > price AND l_extendedprice > 0 QUALIFY rank <= 5""",
    "identity_badges": IDENTITY_BADGES,
    "collections": COLLECTIONS,
    "watch_checks": WATCH_CHECKS,
    "identity_gates": IDENTITY_GATES,
    "checked_watches": CHECKED,
    "changed_watches": CHANGED,
    "seen_profiles": SEEN,
    "reading_positions": POSITIONS,
    "source_scopes": SCOPES,
    "registry_resolve": REGISTRY,
    "registry_lifecycle": LIFECYCLE,
    "registry_merges": MERGES,
    "acceptance": ACCEPTANCE,
    "enriched_offers": ENRICHED,
    "shelf_phrases": PHRASES,
    "arabic_names": ARABIC,
    "brand_tags": BRAND_TAGS,
    "brand_collisions": BRAND_COLLISIONS,
    "moved_shelves": MOVED,
    "comparable_quantities": QUANTITIES,
}
