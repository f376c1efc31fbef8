"""Signals in product names, and what choices teach, for the featured order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import lookup, mapping
from .text import normalize

#: The spelling of "sweetened" that folding would make "local", the most
#: that a count grows to, ids kept of a key and keys kept, and the boost of one id, its
#: saturation and the most of all.
SWEETENED = "محلى"
MOST_COUNTED, IDS_KEPT, KEYS_KEPT = 40, 24, 48
BOOST, SATURATION, MOST_BOOST, MOST_CURATED = 0.75, 20, 1.5, 2.0


def fold_articles(text: Column) -> Column:
    """Normalized text without the articles of words that have two letters more."""
    return F.regexp_replace(text, r"(^| )(?:وال|ال)(?=\S\S)", "$1")


def detect_signals(text: Column, signals: dict[str, list[str]]) -> Column:
    """Names of the signals of which a word or phrase occurs whole, in order."""
    raw = F.replace(F.coalesce(text, F.lit("")), F.lit(SWEETENED), F.lit(" "))
    hay = F.concat(F.lit(" "), fold_articles(normalize(raw)), F.lit(" "))
    found = []
    for name, words in signals.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(hay, F.concat(F.lit(" "), fold_articles(normalize(F.lit(w))), F.lit(" ")))
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def brand_id(brand: Column) -> Column:
    """"b:" and the first three words of a brand; null without one."""
    words = F.slice(F.split(normalize(brand), " "), 1, 3)
    return F.when(normalize(brand) != "", F.concat(F.lit("b:"), F.array_join(words, " ")))


def learn_key(q: Column) -> Column:
    """What a query's choices are filed under: its family, else its first word."""
    return F.when(q["family"].isNotNull(), F.concat(F.lit("f:"), q["family"])).when(F.size(q["tokens"]) > 0, F.concat(F.lit("t:"), F.get(q["tokens"], F.lit(0))))


def learned(choices: DataFrame, owner: str) -> DataFrame:
    """Choices (owner, key, ids, at) -> owner, key, id, n: how often an id was chosen
    under a key, at most so often, the strongest ids of a key (of equals the one chosen
    last) and the newest keys of an owner."""
    rows = choices.filter("key IS NOT NULL AND size(ids) > 0").select(owner, "key", F.explode(F.array_distinct("ids")).alias("id"), "at")
    counts = rows.groupBy(owner, "key", "id").agg(F.least(F.count("*"), F.lit(MOST_COUNTED)).alias("n"), F.max("at").alias("at"))
    best = Window.partitionBy(owner, "key").orderBy(F.col("n").desc(), F.col("at").desc(), "id")
    counts = counts.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= IDS_KEPT).drop("_rn")
    newest = rows.groupBy(owner, "key").agg(F.max("at").alias("last"))
    order = Window.partitionBy(owner).orderBy(F.col("last").desc(), "key")
    keys = newest.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= KEYS_KEPT).select(owner, "key")
    return counts.join(keys, [owner, "key"]).select(owner, "key", "id", "n")


def learned_boost(ids: Column, counts: Column) -> Column:
    """The boost of a product's ids by a map id -> n."""
    each = F.transform(ids, lambda i: F.least(F.coalesce(F.try_element_at(counts, i), F.lit(0)), F.lit(SATURATION)) / SATURATION * BOOST)
    return F.least(F.lit(MOST_BOOST), F.aggregate(each, F.lit(0.0), lambda a, b: a + b))


def curated_weight(signals: Column, category: Column, weights: dict[tuple[str, str], float]) -> Column:
    """The weights of the signals found that mean something in a category."""
    table = mapping({f"{s}|{c}": str(w) for (s, c), w in weights.items()})
    each = F.transform(signals, lambda s: F.coalesce(lookup(table, F.concat_ws("|", s, category)).cast("double"), F.lit(0.0)))
    return F.least(F.lit(MOST_CURATED), F.aggregate(each, F.lit(0.0), lambda a, b: a + b))
