"""Queries of brochures and offers on their pages, with their SQL.

Orders are brochures, their line items pages with one offer each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import brochures
from .tables import table

TODAY = "1998-06-15"


def _brochures(spark, d):
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        k.alias("id"),
        (F.col("o_custkey") % 20).alias("store"),
        F.lit("r").alias("region"),
        F.concat(F.lit("e"), F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("-"), k.cast("string")))).alias("edition"),
        F.when(F.col("o_orderstatus") == "P", "link").when(k % 5 == 0, "pdf").otherwise("images").alias("source_type"),
        F.when(k % 3 == 0, F.concat(F.lit("https://x.example/offers/a/"), k.cast("string"), F.lit("/p"))).otherwise("https://x.example/").alias("source_url"),
        F.when(k % 7 != 0, day).alias("valid_from"),
        F.when(k % 11 != 0, F.date_add(day, (k % 60).cast("int"))).alias("valid_to"),
        (k % 2 == 0).alias("is_current"),
        F.md5((k % 400).cast("string")).alias("checksum"),
        (k % 30).cast("int").alias("pages"),
    )


def _lines(spark, d):
    """Line items dealt by order: one shuffle for all that is asked of an order's lines."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").repartition("l_orderkey").distinct()


def _pages(spark, d):
    rows = _lines(spark, d).select(
        F.col("l_orderkey").alias("brochure_id"), F.col("l_linenumber").alias("index"), F.concat(F.lit("p"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")).alias("page_id")
    )
    return rows.withColumn("page_id", F.when(F.col("index") != 6, F.col("page_id")))


def _spots(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("brochure_id"), F.col("l_linenumber").alias("index")).agg(
        F.min("l_partkey").alias("place")
    ).withColumn("offer_id", F.col("brochure_id") * 10 + F.col("index"))


def _offers(spark, d):
    """Offers that know their brochure by id, edition, flyer, page or not at all."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = _lines(spark, d).join(orders.hint("merge"), "l_orderkey")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    edition = F.concat(F.lit("e"), F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit("-"), k.cast("string"))))
    return rows.select(
        (k * 10 + n).alias("offer_id"),
        ((F.col("o_custkey") + F.when(k % 13 == 0, 1).otherwise(0)) % 20).alias("store"),
        F.lit("r").alias("region"),
        F.when(n == 1, k).alias("brochure_id"),
        F.when(n == 2, edition).alias("edition"),
        F.when(n == 3, k.cast("string")).alias("flyer_ref"),
        F.when(n.isin(4, 6), F.concat(F.lit("p"), (k * 10 + n).cast("string"))).alias("page_ref"),
        F.when((n < 4) & (k % 4 == 0), n).alias("page_index"),
    )


def brochure_order(spark, d):
    rows = brochures.ordered(_brochures(spark, d), F.lit(TODAY).cast("date"))
    return rows.filter("place <= 10").select("store", "place", "id")


BROCHURES = f"""b AS (SELECT o_orderkey AS id, o_custkey % 20 AS store,
  'e' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE o_custkey || '-' || o_orderkey END AS edition,
  CASE WHEN o_orderstatus = 'P' THEN 'link' WHEN o_orderkey % 5 = 0 THEN 'pdf' ELSE 'images' END AS kind,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR END AS ref,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS valid_from,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE + (o_orderkey % 60)::INT END AS valid_to,
  o_orderkey % 30 AS pages, o_orderkey % 400 AS sum FROM orders),
v AS (SELECT *, CASE WHEN valid_to IS NULL THEN id % 2 = 0 ELSE valid_to >= DATE '{TODAY}' AND (valid_from IS NULL OR valid_from <= DATE '{TODAY}') END AS active FROM b)"""
ORDER = "active DESC, kind = 'link', CASE WHEN kind = 'link' THEN 0 ELSE pages END DESC, valid_to DESC NULLS LAST, id"


def best_brochure(spark, d):
    rows = brochures.best_of_store(_brochures(spark, d), F.lit(TODAY).cast("date"))
    return rows.select("store", "id", "expired")


def brochure_days(spark, d):
    """Per day count: brochures by days left and by weeks since they began."""
    today = F.lit(TODAY).cast("date")
    rows = _brochures(spark, d).select(brochures.days_left(F.col("valid_to"), today).alias("days"), brochures.weeks_ago(F.col("valid_from"), today).alias("weeks"))
    return rows.groupBy("days", "weeks").agg(F.count("*").alias("brochures"))


def brochure_groups(spark, d):
    rows = brochures.by_store(_brochures(spark, d).select("store", "region", "id", "edition"))
    return rows.select("store", F.size("brochures").alias("n"), F.md5(F.array_join(F.transform("brochures", lambda b: b["edition"]), ",")).alias("editions"))


def edition_names(spark, d):
    rows = brochures.edition_names(_brochures(spark, d))
    return rows.select("id", "edition_name")


def brochure_dedupe(spark, d):
    kept = brochures.deduplicated(_brochures(spark, d), _pages(spark, d).withColumn("page_id", F.concat(F.lit("q"), (F.col("brochure_id") % 700).cast("string"), F.lit("-"), F.col("index").cast("string"))), F.lit(TODAY).cast("date"))
    return kept.select("store", "id")


def page_lists(spark, d):
    rows = brochures.page_lists(_pages(spark, d))
    return rows.select("brochure_id", F.array_join("indices", ",").alias("indices"), F.md5(F.array_join("page_ids", ",", "-")).alias("page_ids"))


def offer_landing(spark, d):
    spots = _pages(spark, d).select("brochure_id", "index", (F.col("brochure_id") * 10 + F.col("index")).alias("offer_id"))  # those of _spots, without places
    rows = brochures.landings(_offers(spark, d), _brochures(spark, d), _pages(spark, d), spots, dealt=True)
    return rows.select("offer_id", "held", "matched_by", "page", "landed_by")


LANDING = f"""WITH {BROCHURES},
l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem),
o AS (SELECT k * 10 + n AS offer_id, k, n, (o_custkey + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) % 20 AS store FROM l JOIN orders ON k = o_orderkey),
f AS (SELECT o.*, b.id IS NOT NULL AS same, b.ref, b.kind, b.edition FROM o LEFT JOIN b ON b.id = k AND b.store = o.store),
m AS (SELECT *, CASE WHEN NOT same THEN NULL WHEN n = 1 THEN 1 WHEN n = 2 THEN 2 WHEN n = 3 AND ref IS NOT NULL THEN 3
  WHEN n = 3 AND contains(edition, '-') THEN 4 WHEN n = 4 THEN 5 END AS step FROM f),
p AS (SELECT *, CASE WHEN step IS NOT NULL THEN k END AS held, CASE WHEN step IS NULL OR kind <> 'images' THEN NULL
  WHEN n < 4 AND k % 4 = 0 THEN 1 WHEN n = 4 THEN 2 ELSE 3 END AS land FROM m)
SELECT offer_id, held, CAST(step AS INT) AS matched_by, CASE WHEN land IS NOT NULL THEN n END AS page, CAST(land AS INT) AS landed_by FROM p"""


def reading_sequence(spark, d):
    offers = table(spark, d, "lineitem").filter("l_quantity > 25").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer_id"))
    return brochures.reading_sequence(_pages(spark, d), _spots(spark, d), offers).withColumns({"at": F.col("at").cast("int"), "page": F.col("page").cast("int")})


SEQUENCE = """WITH p AS (SELECT DISTINCT l_orderkey AS brochure_id, l_linenumber AS index FROM lineitem),
g AS (SELECT *, row_number() OVER (PARTITION BY brochure_id ORDER BY index) - 1 AS page FROM p),
o AS (SELECT DISTINCT l_orderkey AS brochure_id, l_linenumber AS index FROM lineitem WHERE l_quantity > 25)
SELECT brochure_id, CAST(row_number() OVER (PARTITION BY brochure_id ORDER BY page) - 1 AS INT) AS at, CAST(page AS INT) AS page, index, brochure_id * 10 + index AS offer_id
FROM g JOIN o USING (brochure_id, index)"""


def reading_start(spark, d):
    """Where reading starts on each brochure's third page: at its offer, or the top."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("brochure_id"), F.lit(2).alias("page"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") * 10 + 3).alias("offer_id"))
    return brochures.start_of_reading(reading_sequence(spark, d), asked).select("brochure_id", F.col("start").cast("int").alias("start"))


def opening_pages(spark, d):
    rows = brochures.page_lists(_pages(spark, d))
    k = F.col("brochure_id")
    page = brochures.opening_page(
        F.col("indices"), F.col("page_ids"), F.when(k % 3 == 0, F.lit(4)), F.when(k % 2 == 0, F.concat(F.lit("p"), (k * 10 + 2).cast("string"))), (k % 9).cast("int")
    )
    return rows.select("brochure_id", page.alias("page"))


OPENING = """WITH p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem),
a AS (SELECT k, list(i ORDER BY i) AS ix FROM p GROUP BY k)
SELECT k AS brochure_id, CAST(CASE WHEN k % 3 = 0 AND list_contains(ix, 4) THEN list_position(ix, 4) - 1
  WHEN k % 2 = 0 AND list_contains(ix, 2) THEN list_position(ix, 2) - 1 WHEN k % 9 < len(ix) THEN k % 9 ELSE 0 END AS INT) AS page FROM a"""


def spot_boxes(spark, d):
    """Events as corners of spots on pages of 1000 by 500 pixels."""
    e = F.col("event_id")
    points = table(spark, d, "events").select(F.col("user_id").alias("brochure_id"), (e % 3).alias("index"), (e % 7).alias("offer_id"), (e * 37 % 1100).alias("px"), (e * 91 % 520).alias("py"))
    sizes = points.select("brochure_id", "index").distinct().withColumns({"width": F.lit(1000), "height": F.lit(500)})
    boxes = brochures.spot_boxes(points, sizes)
    return boxes.select("brochure_id", "index", "offer_id", *[F.round(c, 6).alias(c) for c in "xywh"])


BOXES = """WITH p AS (SELECT user_id AS brochure_id, event_id % 3 AS index, event_id % 7 AS offer_id, event_id * 37 % 1100 / 1000::DOUBLE AS fx, event_id * 91 % 520 / 500::DOUBLE AS fy FROM events),
b AS (SELECT brochure_id, index, offer_id, least(min(fx), 1) AS x, least(min(fy), 1) AS y, least(max(fx), 1) AS x1, least(max(fy), 1) AS y1 FROM p GROUP BY ALL)
SELECT brochure_id, index, offer_id, round(x, 6) AS x, round(y, 6) AS y, round(x1 - x, 6) AS w, round(y1 - y, 6) AS h FROM b"""


def spot_snapshot(spark, d):
    """Spots after a new parse that found nothing for every fourth brochure, whose bytes
    are the same for every eighth."""
    held = _spots(spark, d).select("brochure_id", "index", "offer_id")
    parsed = held.filter("brochure_id % 4 <> 0 AND brochure_id % 2 = 0").withColumn("offer_id", F.col("offer_id") + 5)
    read = held.filter("brochure_id % 2 = 0").select("brochure_id").distinct().select("brochure_id", F.lit("a").alias("checksum"), F.when(F.col("brochure_id") % 8 == 0, "a").otherwise("b").alias("held_checksum"))
    return brochures.snapshot(held, parsed, read).groupBy((F.col("brochure_id") % 8).alias("kind")).agg(F.count("*").alias("spots"), F.sum(F.col("offer_id") % 10).alias("digits"))


SNAPSHOT = """WITH s AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem)
SELECT k % 8 AS kind, count(*) AS spots, CAST(sum((k * 10 + i + CASE WHEN k % 4 <> 0 AND k % 2 = 0 THEN 5 ELSE 0 END) % 10) AS BIGINT) AS digits
FROM s WHERE k % 2 = 1 OR k % 4 <> 0 OR k % 8 = 0 GROUP BY 1"""

QUERIES = {
    "brochure_order": brochure_order,
    "best_brochure": best_brochure,
    "brochure_days": brochure_days,
    "brochure_groups": brochure_groups,
    "edition_names": edition_names,
    "brochure_dedupe": brochure_dedupe,
    "page_lists": page_lists,
    "offer_landing": offer_landing,
    "reading_sequence": reading_sequence,
    "reading_start": reading_start,
    "opening_pages": opening_pages,
    "spot_boxes": spot_boxes,
    "spot_snapshot": spot_snapshot,
}
SQL = {
    "brochure_order": f"""WITH {BROCHURES} SELECT store, CAST(row_number() OVER (PARTITION BY store ORDER BY {ORDER}) AS INT) AS place, id FROM v QUALIFY place <= 10""",
    "best_brochure": f"""WITH {BROCHURES} SELECT store, id, NOT active AS expired FROM v WHERE active OR kind <> 'link'
QUALIFY row_number() OVER (PARTITION BY store ORDER BY active DESC, CASE WHEN NOT active THEN valid_to END DESC NULLS LAST, {ORDER}) = 1""",
    "brochure_days": f"""WITH {BROCHURES} SELECT greatest(datediff('day', DATE '{TODAY}', valid_to), CASE WHEN valid_to IS NOT NULL THEN 0 END)::INT AS days,
  CASE WHEN valid_from <= DATE '{TODAY}' THEN round(datediff('day', valid_from, DATE '{TODAY}') / 7.0)::INT END AS weeks, count(*) AS brochures FROM b GROUP BY ALL""",
    "brochure_groups": f"""WITH {BROCHURES} SELECT store, CAST(count(*) AS INT) AS n, md5(string_agg(edition, ',' ORDER BY id)) AS editions FROM b GROUP BY store""",
    "edition_names": f"""WITH {BROCHURES}, w AS (SELECT id, store, pages, strftime(coalesce(valid_from, valid_to), '%G-W%V') AS week FROM b)
SELECT id, CASE WHEN row_number() OVER (PARTITION BY store, week ORDER BY pages DESC, id) = 1 THEN week ELSE concat_ws('-', week, id) END AS edition_name FROM w""",
    "brochure_dedupe": f"""WITH {BROCHURES}, c AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY store, sum ORDER BY active DESC, pages DESC, valid_to DESC NULLS LAST, id DESC) = 1),
s AS (SELECT l_orderkey AS id, string_agg(DISTINCT 'q' || (l_orderkey % 700) || '-' || l_linenumber, '|' ORDER BY 'q' || (l_orderkey % 700) || '-' || l_linenumber) AS ps FROM lineitem GROUP BY 1),
j AS (SELECT c.*, ps FROM c LEFT JOIN s USING (id))
SELECT store, id FROM j QUALIFY ps IS NULL OR row_number() OVER (PARTITION BY store, ps ORDER BY active DESC, pages DESC, valid_to DESC NULLS LAST, id DESC) = 1""",
    "page_lists": """WITH p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS i FROM lineitem)
SELECT k AS brochure_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS indices, md5(string_agg(CASE WHEN i <> 6 THEN 'p' || (k * 10 + i) ELSE '-' END, ',' ORDER BY i)) AS page_ids FROM p GROUP BY k""",
    "offer_landing": LANDING,
    "reading_sequence": SEQUENCE,
    "reading_start": f"""WITH q AS ({SEQUENCE}), a AS (SELECT brochure_id, min("at") AS top, min("at") FILTER (WHERE index = 3 AND brochure_id % 2 = 0) AS own FROM q WHERE page = 2 GROUP BY 1)
SELECT o_orderkey AS brochure_id, CAST(coalesce(own, top, -1) AS INT) AS start FROM orders LEFT JOIN a ON o_orderkey = brochure_id""",
    "opening_pages": OPENING,
    "spot_boxes": BOXES,
    "spot_snapshot": SNAPSHOT,
}
