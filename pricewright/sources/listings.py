"""Sources of listings: typed scans, ordered fallbacks, unions and small sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ONLINE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("oldPrice", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("discountLabel", T.StringType()),
    ]
)
FLYER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("store", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("nameAr", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("oldPrice", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("brandSlug", T.StringType()),
        T.StructField("productId", T.StringType()),
        T.StructField("validTo", T.DateType()),
    ]
)
LISTING_COLUMNS = ["source", "store", "name", "brand", "price", "old_price", "size_text", "product_id"]


def read_listings(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = ONLINE) -> DataFrame:
    """A typed, permissive scan: a record that does not fit is kept with nulls and
    its text in ``_corrupt_record``."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        reader = reader.schema(kept).option("mode", "PERMISSIVE")
        return reader.option("header", "true").load(path) if fmt == "csv" else reader.load(path)
    return reader.schema(schema).load(path)


def first_non_empty(strategies: dict[str, Callable[[], DataFrame]], preferred: str | None = None) -> tuple[str, DataFrame]:
    """The first strategy that gives rows, the preferred one tried before the
    others. Raises with every reason if all fail or are empty."""
    names = sorted(strategies, key=lambda n: n != preferred)
    reasons = []
    for name in names:
        try:
            rows = strategies[name]()
            if not rows.isEmpty():
                return name, rows
            reasons.append(f"{name}: no rows")
        except Exception as e:  # a source may fail in any way of its own
            reasons.append(f"{name}: {e}")
    raise LookupError("; ".join(reasons))


def split_sources(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected sources as online and flyer ones."""
    return sources.filter("kind = 'online'"), sources.filter("kind <> 'online'")


def online_listings(rows: DataFrame, store: str) -> DataFrame:
    """Online results as listings; a row without a price is none, price 0 is one."""
    return rows.filter(F.col("price").isNotNull()).select(
        F.lit("online").alias("source"),
        F.lit(store).alias("store"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("brand", F.lit("")).alias("brand"),
        "price",
        F.col("oldPrice").alias("old_price"),
        F.col("size").alias("size_text"),
        F.lit(None).cast("string").alias("product_id"),
    )


def flyer_listings(rows: DataFrame, arabic_query: bool = False) -> DataFrame:
    """Flyer offers as listings, named in the query's script where they can be."""
    names = ("nameAr", "name") if arabic_query else ("name", "nameAr")
    return rows.filter(F.col("price").isNotNull()).select(
        F.lit("flyer").alias("source"),
        "store",
        F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit("")).alias("name"),
        F.lit("").alias("brand"),
        "price",
        F.col("oldPrice").alias("old_price"),
        F.col("size").alias("size_text"),
        F.col("productId").alias("product_id"),
    )


def all_listings(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*LISTING_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*LISTING_COLUMNS))
    return out


def usable_price(text):
    """A text's price if it is a finite number above 0, else null."""
    value = F.trim(text).try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite & (value > 0), value)


def active_on(day, valid_from, valid_to, current):
    """Valid on a day; an undated one by its flag."""
    dated = (valid_to >= day) & (valid_from.isNull() | (valid_from <= day))
    return F.when(valid_to.isNull(), F.coalesce(current, F.lit(False))).otherwise(dated)


def retained(rows: DataFrame, day, column: str, days: int) -> DataFrame:
    """Rows whose date is not more than ``days`` before ``day``."""
    return rows.filter(F.col(column) >= F.date_sub(day, days))
