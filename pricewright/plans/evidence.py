"""Queries of sizes, stated prices, fresh produce and shifted products, asked with the
words and sizes of the parts themselves, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching, size
from ..functions.lexicon import Lexicon
from ..operators import gates, search
from .tables import PARTS, dealt_products, items_of, products

#: Rings and gears as produce, cut cold, processed hot, and red for a flavour.
PRODUCE = Lexicon(
    base={"tool": ["anvil"]}, produce={"ring": ["ring"], "gear": ["gear"]}, types={"cut": ["cold"]}, processed=["hot"], flavor_before=["red"], head_skip=[], shifters=[]
)
#: Rings and widgets make another product of the word before them.
SHIFTED = Lexicon(synonyms=[["large", "big"]], shifters=["ring", "widget"])
_A, _B = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"


def _words(spark, d):
    """Parts with their adjective and noun."""
    return products(spark, d).withColumns({"a": F.substring_index("p_name", " ", 1), "b": F.substring_index("p_name", " ", -1)})


def size_vectors(spark, d):
    """Sizes of labels: bonus packs, plausible and not, eastern digits, packs, counts."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    shapes = [
        F.concat(n, F.lit("+"), (k % 12 + 1).cast("string"), F.lit(" x 250ml")),
        F.concat(F.translate(n, "0123456789", "".join(chr(0x660 + i) for i in range(10))), F.lit(" لتر")),
        F.concat(n, F.lit(" cans x 330ml")),
        F.concat(n, F.lit(" pcs")),
    ]
    label = F.col("p_name")
    for i, shape in enumerate(shapes):
        label = F.when(k % 5 == i, F.concat("p_name", F.lit(" "), shape)).otherwise(label)
    rows = products(spark, d).withColumn("s", size.parse_size(label))
    return rows.select("p_partkey", "s.unit", "s.total")


SIZE_VECTORS = """SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN 'ml' WHEN p_partkey % 5 = 3 THEN 'pcs' END AS unit,
  CASE p_partkey % 5 WHEN 0 THEN 250.0::DOUBLE * CASE WHEN p_partkey % 12 + 1 <= p_size AND p_size + p_partkey % 12 + 1 <= 99 THEN p_size + p_partkey % 12 + 1 ELSE p_partkey % 12 + 1 END
    WHEN 1 THEN 1000.0::DOUBLE * p_size WHEN 2 THEN 330.0::DOUBLE * p_size WHEN 3 THEN p_size::DOUBLE END AS total FROM part"""


def price_basis_vectors(spark, d):
    """Unit prices by a package, by what a field states, and none where both disagree."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    name = F.when(k % 5 == 0, F.concat("p_name", F.lit(" 6 x "), F.col("p_size").cast("string"), F.lit(" ml"))).when(k % 5 == 4, F.concat("p_name", F.lit(" 2 kg"))).otherwise(F.col("p_name"))
    field = F.when(k % 5 == 1, "Per Kg").when(k % 5 == 2, F.concat(F.lit("per "), (F.col("p_size") * 10).cast("string"), F.lit(" gm"))).when(k % 5 == 4, "per 500 gm")
    rows = products(spark, d).withColumns({"_name": name, "_field": field})
    rows = rows.withColumn("s", size.parse_size(F.col("_name"), F.col("_field")))
    basis = size.price_basis(F.col("_field"), F.col("_name"), none, F.col("s.unit").isNotNull())
    up = size.unit_price(F.col("p_retailprice"), size.reference_quantity(F.col("s"), basis))
    return rows.withColumn("up", up).select("p_partkey", F.col("up.value").alias("unit_value"), F.col("up.unit").alias("per"))


PRICE_BASIS_VECTORS = """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_retailprice / (6.0::DOUBLE * p_size / 1000) WHEN 1 THEN p_retailprice / 1.0::DOUBLE WHEN 2 THEN p_retailprice / (p_size * 10 * 0.001::DOUBLE) END AS unit_value,
  CASE p_partkey % 5 WHEN 0 THEN 'L' WHEN 1 THEN 'kg' WHEN 2 THEN 'kg' END AS per FROM part"""


def adopted_unit_prices(spark, d):
    """Unit prices that came with a row, where they are usable, else those of its size."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    rows = dealt_products(spark, d).withColumn("s", size.parse_size(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" kg"))))
    value = F.when(k % 4 == 0, price / 2).when(k % 4 == 1, -price).when(k % 4 == 2, price)
    adopted = F.struct(value.alias("value"), F.when(k % 4 == 2, "box").otherwise("pc").alias("unit"))
    up = size.unit_price(price, size.reference_quantity(F.col("s"), F.lit(None).cast("struct<unit:string,quantity:double>")), adopted)
    return rows.withColumn("up", up).select("p_partkey", F.col("up.value").alias("unit_value"), F.col("up.unit").alias("per"))


ADOPTED = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice / 2 ELSE p_retailprice / (p_size * 1000.0::DOUBLE / 1000) END AS unit_value,
  CASE WHEN p_partkey % 4 = 0 THEN 'pc' ELSE 'kg' END AS per FROM part"""


def size_query_tokens(spark, d):
    """Queries of a noun and a size: the size is structure, not a word."""
    asked = _words(spark, d).select(F.concat("b", F.lit(" "), F.col("p_size").cast("string"), F.lit(" kg")).alias("query")).distinct()
    rows = matching.with_query(asked, PARTS)
    return rows.select("query", F.array_join("q.tokens", " ").alias("tokens"), F.col("q.size.total").alias("total"), F.col("q.family").alias("family"))


def sized_stages(spark, d):
    """Queries of a noun with the least and the largest size of its parts, which parts
    of another size contradict."""
    ends = _words(spark, d).groupBy("b").agg(F.array(F.min("p_size"), F.max("p_size")).alias("ends"))
    asked = ends.select("b", F.explode(F.array_distinct("ends")).alias("n")).select(F.concat("b", F.lit(" "), F.col("n").cast("string"), F.lit(" kg")).alias("query_id"))
    items = items_of(spark, d)
    items = items.withColumn("name", F.when(F.col("ord") % 3 == 0, F.col("name")).otherwise(F.concat("name", F.lit(" "), F.col("pieces").cast("string"), F.lit(" kg"))))
    found = search.candidates(matching.with_query(asked, PARTS, "query_id"), matching.with_item(items, PARTS))
    return found.select("query_id", F.col("ord").alias("p_partkey"), matching.match_stage(F.col("q"), F.col("it"), PARTS).alias("stage"))


SIZED_STAGES = f"""WITH q AS (SELECT {_B} AS noun, unnest(list_distinct([min(p_size), max(p_size)])) AS n FROM part GROUP BY 1)
SELECT noun || ' ' || n || ' kg' AS query_id, p_partkey,
  CASE WHEN p_partkey % 3 <> 0 AND abs(p_size - n) > 0.03 * greatest(p_size, n) THEN 1 WHEN {_A} = 'new' THEN 5 ELSE 4 END AS stage
FROM q JOIN part ON noun = {_B}"""


def gate_fresh(spark, d):
    """The gate ladder for each noun, where some are asked for as fresh produce."""
    asked = _words(spark, d).select(F.col("b").alias("query_id")).distinct()
    found = search.candidates(matching.with_query(asked, PRODUCE, "query_id"), matching.with_item(items_of(spark, d), PRODUCE))
    return gates.excluded_counts(gates.gate_ladder(gates.interpret(found, PRODUCE), PRODUCE))


GATE_FRESH = f"""WITH p AS (SELECT {_A} AS a, {_B} AS noun FROM part)
SELECT noun AS query_id, count(*) FILTER (a <> 'red' AND NOT (noun IN ('ring', 'gear') AND a IN ('hot', 'cold'))) AS kept, count(*) FILTER (a = 'red') AS stage_excluded,
  CAST(0 AS BIGINT) AS family_excluded, CAST(0 AS BIGINT) AS form_excluded, count(*) FILTER (noun IN ('ring', 'gear') AND a IN ('hot', 'cold')) AS fresh_excluded,
  CASE WHEN noun IN ('ring', 'gear') THEN noun WHEN noun = 'anvil' THEN 'tool' END AS target_family
FROM p GROUP BY noun"""


def shifted_relevance(spark, d):
    """Queries of an adjective; before some nouns it is part of another product."""
    asked = _words(spark, d).select(F.col("a").alias("query_id")).distinct()
    found = search.candidates(matching.with_query(asked, SHIFTED, "query_id"), matching.with_item(items_of(spark, d), SHIFTED))
    return found.select("query_id", F.col("ord").alias("p_partkey"), matching.relevance(F.col("q"), F.col("it"), SHIFTED).alias("rel"))


SHIFTED_RELEVANCE = f"""WITH q AS (SELECT DISTINCT {_A} AS query_id FROM part)
SELECT query_id, p_partkey, CASE WHEN {_B} IN ('ring', 'widget') THEN 100.0::DOUBLE * 0.45::DOUBLE ELSE 100.0::DOUBLE END AS rel
FROM q JOIN part ON query_id = {_A} OR (query_id IN ('large', 'big') AND {_A} IN ('large', 'big'))"""

QUERIES = {
    "size_vectors": size_vectors, "price_basis_vectors": price_basis_vectors, "adopted_unit_prices": adopted_unit_prices, "size_query_tokens": size_query_tokens,
    "sized_stages": sized_stages, "gate_fresh": gate_fresh, "shifted_relevance": shifted_relevance,
}
SQL = {
    "size_vectors": SIZE_VECTORS,
    "price_basis_vectors": PRICE_BASIS_VECTORS,
    "adopted_unit_prices": ADOPTED,
    "size_query_tokens": f"""SELECT DISTINCT {_B} || ' ' || p_size || ' kg' AS query, {_B} AS tokens, p_size * 1000.0::DOUBLE AS total, CASE WHEN {_B} IN ('widget', 'gizmo') THEN 'gadget'
  WHEN {_B} IN ('bolt', 'rod', 'ring') THEN 'fastener' WHEN {_B} = 'plate' THEN 'plate' WHEN {_B} IN ('anvil', 'gear') THEN 'tool' END AS family FROM part""",
    "sized_stages": SIZED_STAGES,
    "gate_fresh": GATE_FRESH,
    "shifted_relevance": SHIFTED_RELEVANCE,
}
