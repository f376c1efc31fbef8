"""The driver's tables in the roles that the queries give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching
from ..functions.lexicon import Lexicon
from ..operators import search
from ..sources.store import dealt

#: A lexicon for the part names, which are an adjective and a noun.
PARTS = Lexicon(
    base={"fastener": ["bolt", "rod", "ring"], "plate": ["plate"], "tool": ["anvil", "gear"]},
    derived={"gadget": ["widget", "gizmo"]},
    types={"hot": ["hot"], "cold": ["cold"]},
    synonyms=[["rod", "bar"], ["large", "big"]],
)
QUERIES = (
    (1, "bolt"),
    (2, "red bolt"),
    (3, "new ring"),
    (4, "gear blue"),
    (5, "big rod"),
    (6, "hot gizmo"),
    (7, "fish"),
    (8, "cold"),
)
#: A listing's key: the columns that tell its rows apart, in source order.
ORDER = ["l_orderkey", "l_linenumber", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as listings: price (after discount), unit (price per piece), day."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"
    )
    return rows.withColumns(
        {
            "price": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            "unit": F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity"),
            "day": F.col("l_shipdate").cast("date"),
        }
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def dealt_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products for readings that cost much a row."""
    return dealt(products(spark, sf_dir), "p_partkey")


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the role of listings: ord, name, brand, maker, kind, price, pieces."""
    return dealt_products(spark, sf_dir).select(
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("name"),
        F.lit("").alias("brand"),
        F.col("p_brand").alias("maker"),
        F.col("p_type").alias("kind"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("pieces"),
    )


def candidates(spark: SparkSession, sf_dir: str, lexicon: Lexicon = PARTS) -> DataFrame:
    """Every query with the products that have a word of it."""
    return search.candidates(matching.with_query(queries(spark), lexicon), matching.with_item(items_of(spark, sf_dir), lexicon))
