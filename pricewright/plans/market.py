"""Queries of the comparison model, offer search and result lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import matching, size
from ..operators import comparison, ranking, search
from .oracles import _STAGED, ladder
from .tables import PARTS, items_of, queries

#: A flyer offer's registry product, brand, store and size, as columns of the parts.
SOURCE = "CASE WHEN p_type = 'PROMO' THEN 'flyer' ELSE 'online' END"
STORE = "concat('s', p_partkey % 9)"
PRICE = "floor(p_retailprice / 20) * 20.0"


def _shelf(spark, d):
    """Parts as listings: online ones have a unit price, flyer offers a size and a
    registry product (their noun) as well."""
    rows = items_of(spark, d)
    flyer = F.col("kind") == "PROMO"
    whole = size.parse_size(F.concat(F.col("pieces").cast("string"), F.lit(" x 100 g")))
    unit = F.when(F.col("pieces") % 3 == 0, "kg").otherwise("pc")
    return matching.with_item(
        rows.withColumns(
            {
                "source": F.when(flyer, "flyer").otherwise("online"),
                "store": F.concat(F.lit("s"), F.col("ord") % 9),
                "price": F.floor(F.col("price") / 20) * 20.0,
                "size": F.when(flyer, whole),
                "up": F.struct((F.col("price") / F.col("pieces")).alias("value"), unit.alias("unit")),
                "product_id": F.when(flyer, F.element_at(F.split("name", " "), 2)),
                "brand_slug": F.when(flyer, F.col("maker")),
            }
        ),
        PARTS,
    )


def compare_products(spark, d):
    shelf = _shelf(spark, d)
    asked = matching.with_query(queries(spark), PARTS)
    offers = shelf.filter("source = 'flyer'").withColumns({"family": F.col("it.family"), "form": F.col("it.form")})
    found = comparison.compare(search.candidates(asked, shelf), offers, PARTS)
    return found.select(
        "query_id", "offers", "stores", "flyers", "lowest", "highest", "target_family", "stage_excluded", "family_excluded",
        "identity_excluded", F.col("cheapest.seq.ord").alias("cheapest"), F.col("best.seq.ord").alias("best_value"),
        "value_unit", "pool", "dropped", "kind", F.col("head_seq.ord").alias("head"), "equivalent_stores",
        F.array_join("shared_with", ",").alias("shared_with"), "confidence",
    )


MEDIAN = "list_sort(list({v}))[CAST(floor(count(*) / 2) AS INT) + 1]"
COMPARE = f"""{ladder('exact', True, True, 'competing')},
covered AS (SELECT *, list_concat(CASE WHEN a1 OR b1 THEN [0] ELSE [] END, CASE WHEN a2 OR b2 THEN [1] ELSE [] END) AS cover,
  {SOURCE} AS source, 's' || (p_partkey % 9) AS store, floor(p_retailprice / 20) * 20.0::DOUBLE AS price, CASE WHEN p_type = 'PROMO' THEN b END AS product_id,
  CASE WHEN p_size % 3 = 0 THEN 'kg' ELSE 'pc' END AS unit FROM g6),
valued AS (SELECT *, p_retailprice / p_size AS uv FROM covered),
anchor AS (SELECT query_id, cover AS acover, product_id AS aproduct FROM valued WHERE in3
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, source = 'online' DESC, price, p_partkey) = 1),
locked AS (SELECT v.*, in3 AND len(acover) > 0 AND coalesce(product_id <> aproduct, true) AND NOT list_has_all(cover, acover) AS out4
  FROM valued v JOIN anchor USING (query_id)),
counts AS (SELECT query_id, count(*) FILTER (WHERE NOT in1) AS stage_excluded, count(*) FILTER (WHERE in1 AND NOT in2) AS family_excluded,
  count(*) FILTER (WHERE out4) AS identity_excluded, max(target) AS target_family FROM locked GROUP BY query_id),
kept AS (SELECT query_id, p_partkey, CASE WHEN source = 'online' THEN 0 ELSE 1 END AS part, source, store, price, uv, unit, product_id, p_brand, p_name, p_size
  FROM locked WHERE in3 AND NOT out4),
extra AS (SELECT k.query_id, p.p_partkey, 2 AS part, 'flyer' AS source, 's' || (p.p_partkey % 9) AS store, floor(p.p_retailprice / 20) * 20.0::DOUBLE AS price,
  p.p_retailprice / p.p_size AS uv, CASE WHEN p.p_size % 3 = 0 THEN 'kg' ELSE 'pc' END AS unit, k.product_id, p.p_brand, p.p_name, p.p_size
  FROM (SELECT DISTINCT query_id, product_id, p_brand FROM kept WHERE product_id IS NOT NULL) k
  JOIN part p ON p.p_type = 'PROMO' AND split_part(p.p_name, ' ', 2) = k.product_id AND p.p_brand = k.p_brand
  WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.query_id = k.query_id AND x.p_partkey = p.p_partkey)),
pooled AS (SELECT * FROM kept UNION ALL SELECT * FROM extra),
stats AS (SELECT query_id, count(*) AS offers, count(DISTINCT source || ':' || store) AS stores, count(*) FILTER (WHERE source = 'flyer') AS flyers,
  min(price) AS lowest, max(price) AS highest FROM pooled GROUP BY query_id),
cheap AS (SELECT * FROM pooled QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY price, part, p_partkey) = 1),
units AS (SELECT query_id, unit, count(*) AS c, min((part, p_partkey)) AS first FROM pooled GROUP BY ALL),
chosen AS (SELECT query_id, unit FROM units QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, first) = 1),
fam AS (SELECT p.* FROM pooled p JOIN chosen USING (query_id, unit)),
med AS (SELECT query_id, count(*) AS n, {MEDIAN.format(v='uv')} AS m FROM fam GROUP BY query_id HAVING count(*) >= 2),
guarded AS (SELECT fam.*, n, uv <= m * 6 AND uv >= m / 6 AS ok, sum(CAST(uv <= m * 6 AND uv >= m / 6 AS INT)) OVER (PARTITION BY query_id) AS ks
  FROM fam JOIN med USING (query_id)),
best AS (SELECT query_id, p_partkey AS bk, part AS bpart, uv AS bu, unit AS value_unit, CASE WHEN ks >= 2 THEN ks ELSE n END AS pool,
  n - CASE WHEN ks >= 2 THEN ks ELSE n END AS dropped FROM guarded WHERE ok OR ks < 2
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY uv, part, p_partkey) = 1),
heads AS (SELECT c.query_id, c.p_partkey AS cheapest, c.part AS cpart, bk, bpart, value_unit, pool, dropped,
  CASE WHEN bk IS NULL THEN 'cheapest' WHEN bk = c.p_partkey THEN 'best-buy'
    WHEN c.unit <> value_unit OR bu <= c.uv * 0.9::DOUBLE THEN 'best-value' ELSE 'best-buy' END AS kind FROM cheap c LEFT JOIN best USING (query_id)),
named AS (SELECT *, CASE WHEN kind = 'best-value' THEN bk ELSE cheapest END AS head FROM heads),
led AS (SELECT p.*, n.head, h.store AS hstore, h.price AS hprice, h.p_name AS hname, h.source AS hsource, h.p_size AS hsize
  FROM pooled p JOIN named n USING (query_id) JOIN pooled h ON h.query_id = n.query_id AND h.p_partkey = n.head),
groups AS (SELECT query_id, product_id, p_brand, count(DISTINCT store) AS equivalent_stores, bool_or(p_partkey = head) AS has_head, min((part, p_partkey)) AS first
  FROM led WHERE product_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT store) >= 2),
same AS (SELECT * FROM groups QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY has_head DESC, equivalent_stores DESC, first) = 1),
shared AS (SELECT query_id, string_agg(DISTINCT store, ',' ORDER BY store) AS shared_with FROM led
  WHERE store <> hstore AND abs(price - hprice) <= 0.005::DOUBLE AND (p_name = hname OR (source = 'flyer' AND hsource = 'flyer'
    AND greatest(p_size, hsize)::DOUBLE - least(p_size, hsize) <= 0.03::DOUBLE * greatest(p_size, hsize))) GROUP BY query_id)
SELECT query_id, offers, stores, flyers, lowest, highest, target_family, stage_excluded, family_excluded, identity_excluded, cheapest, bk AS best_value,
  value_unit, CAST(pool AS BIGINT) AS pool, CAST(dropped AS BIGINT) AS dropped, kind, head, equivalent_stores, coalesce(shared_with, '') AS shared_with,
  CASE WHEN coalesce(has_head, false) THEN 'high' WHEN bk IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence
FROM counts JOIN stats USING (query_id) JOIN named USING (query_id) LEFT JOIN same USING (query_id) LEFT JOIN shared USING (query_id)"""


def offer_search(spark, d):
    """The twenty best offers of each query, as the offer search orders them."""
    found = search.candidates(matching.with_query(queries(spark), PARTS), matching.with_item(items_of(spark, d), PARTS))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*search.offer_order(PARTS))))
    return ranked.filter("rank <= 20").select("query_id", "rank", F.col("ord").alias("p_partkey"))


OFFER_SEARCH = f"""WITH {_STAGED},
points AS (SELECT *, (CASE WHEN a1 OR b1 THEN 100 ELSE 0 END + CASE WHEN a2 OR b2 THEN 100 ELSE 0 END) / n AS score,
  CASE WHEN qfam IS NULL THEN 1 WHEN fam = qfam THEN 2 WHEN fam IS NULL THEN 1 ELSE 0 END AS tier FROM staged)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY stage DESC, tier DESC, score DESC, p_retailprice, p_partkey) AS INT) AS rank, p_partkey
FROM points QUALIFY rank <= 20"""


def result_parts(spark, d):
    found = search.candidates(matching.with_query(queries(spark), PARTS), matching.with_item(items_of(spark, d), PARTS))
    return comparison.result_split(found, PARTS).groupBy("query_id", "part").agg(F.count("*").alias("listings"))


RESULT_PARTS = f"""WITH {_STAGED}
SELECT query_id, CASE WHEN n = 1 OR ((a1 OR b1) AND (a2 OR b2)) THEN 'primary' ELSE 'related' END AS part, count(*) AS listings FROM staged GROUP BY ALL"""


def relevance_rank(spark, d):
    """The result list by relevance, then source order; its view of one store keeps
    the ranks of the whole list."""
    found = search.candidates(matching.with_query(queries(spark), PARTS), matching.with_item(items_of(spark, d), PARTS))
    rows = found.withColumns({"rel": matching.relevance(F.col("q"), F.col("it"), PARTS), "store": F.concat(F.lit("s"), F.col("ord") % 9), "source": F.lit("online")})
    rows = ranking.by_relevance(rows, top=60)
    return comparison.in_view(rows, "s4").select("query_id", "rank", F.col("ord").alias("p_partkey"))


RELEVANCE_RANK = f"""WITH {_STAGED.rstrip()},
r AS (SELECT *, CASE WHEN n = 1 THEN 100.0 ELSE (CASE WHEN a1 OR b1 THEN 100 ELSE 0 END + CASE WHEN a2 OR b2 THEN 100 ELSE 0 END) / 2.0
  * (0.5 + 0.5 * (CAST(a1 OR b1 AS INT) + CAST(a2 OR b2 AS INT)) / 2.0) END AS rel FROM staged),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, p_partkey) AS INT) AS rank, p_partkey FROM r)
SELECT * FROM k WHERE rank <= 60 AND p_partkey % 9 = 4"""

QUERIES = {
    "compare_products": compare_products,
    "offer_search": offer_search,
    "result_parts": result_parts,
    "relevance_rank": relevance_rank,
}
SQL = {
    "compare_products": COMPARE,
    "offer_search": OFFER_SEARCH,
    "result_parts": RESULT_PARTS,
    "relevance_rank": RELEVANCE_RANK,
}
