"""Brands read from words by a dictionary of any size: a table of keys, met by joins.

The rules are those of ``names.BrandBook``, which suits a dictionary that fits into a
plan; here the dictionary is a table, and a word asks it under the few keys that it may
be meant by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import strings
from ..functions.names import fold, undoubled
from ..functions.text import folded, strip_article
from .resolve import dictionary_join, large_join

#: Letters of a word or key from which on it may be repaired.
LONG = 4


def brand_keys(brands: DataFrame, ambiguous=(), generic=()) -> DataFrame:
    """ord, display, names -> kind ('known', 'doubled' or 'long'), key, display: the
    identifying words of each name, without article, and its joined form; the first
    brand (by ``ord``) of a key keeps it. ``ambiguous`` words are never a key, ``generic``
    ones never alone."""
    each = brands.select("ord", "display", F.posexplode("names").alias("_no", "name")).withColumn("words", F.filter(F.split(fold(F.col("name")), " "), lambda w: w != ""))
    own = F.filter("words", lambda w: ~F.array_contains(strings(folded(generic)), w))
    keys = F.flatten(F.transform(own, lambda w: F.array(w, strip_article(w))))
    joined = F.when(F.size("words") > 1, F.array(F.array_join("words", ""))).otherwise(strings([]))
    rows = each.select("ord", "_no", "display", F.posexplode(F.concat(keys, joined)).alias("_i", "key"))
    rows = rows.filter((F.length("key") >= 2) & ~F.array_contains(strings(folded(ambiguous)), F.col("key")))
    first = F.min_by("display", F.struct("ord", "_no", "_i")).alias("display")
    known = rows.groupBy("key").agg(first).select(F.lit("known").alias("kind"), "key", "display")
    doubled = rows.groupBy(undoubled(F.col("key")).alias("key")).agg(first).select(F.lit("doubled").alias("kind"), "key", "display")
    return known.union(doubled).union(known.filter(F.length("key") >= LONG).withColumn("kind", F.lit("long")))


def read_brands(rows: DataFrame, key: str, words: str, keys: DataFrame, ambiguous=()) -> DataFrame:
    """Rows + brand: the brand of the first of their words that is one: as it stands,
    without article, with doubled letters taken as one, or with one or two letters
    appended. ``key`` is unique. Rows without words or brands have none."""
    each = rows.select(F.col(key), F.posexplode(words).alias("_i", "_word")).withColumn("n", fold(F.col("_word")))
    barred = strings(folded(ambiguous))
    each = each.filter((F.col("n") != "") & ~F.array_contains(barred, F.col("n")) & ~F.array_contains(barred, strip_article(F.col("n"))))
    asked = lambda no, kind, k: F.struct(F.lit(no).alias("no"), F.lit(kind).alias("kind"), k.alias("key"))
    cut = lambda k: F.substr("n", F.lit(1), F.length("n") - k)
    plain = F.array(asked(1, "known", F.col("n")), asked(2, "known", strip_article(F.col("n"))))
    repaired = F.array(asked(3, "doubled", undoubled(F.col("n"))), asked(4, "long", cut(1)), asked(5, "long", cut(2)))
    ways = F.when(F.length("n") >= LONG, F.concat(plain, repaired)).otherwise(plain)
    met = each.select(F.col(key).alias("_row"), "_i", F.explode(ways).alias("w")).select("_row", "_i", "w.*")
    met = dictionary_join(met, keys, ["kind", "key"])
    best = met.groupBy("_row").agg(F.min_by("display", F.struct("_i", "no")).alias("brand"))
    return large_join(rows.withColumn("_row", F.col(key)), best, ["_row"], "left").drop("_row")
