"""Offer search: which products have a word of a query, found by keys.

A query word matches a product word whole, a word's beginning (from four letters) or
any place in the text (from five). So a product that matches a word of five letters or
more has each five letters in a row of it, one of four has a word that begins with it,
and a shorter one stands there whole. These are the index's keys. A query asks for each
word by one key only, that of the fewest products among all that a match must have;
products without it are never paired, and what the key brings is then confirmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matching
from ..functions.columns import let
from ..functions.lexicon import Lexicon
from ..sources.store import dealt, materialize
from .resolve import dictionary_join, spread_join


def _tagged(tag: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(tag), v))


def _grams(text: Column, size: int) -> Column:
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.coalesce(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))), F.array().cast("array<string>"))


def item_keys(it: Column) -> Column:
    """The keys of a product's name and brand."""
    start, inside = matching.LEAST_START, matching.LEAST_INSIDE

    def keys(it):
        words = F.concat(it["words"], it["brand_words"])
        beginnings = F.transform(F.filter(words, lambda w: F.length(w) >= start), lambda w: F.substr(w, F.lit(1), F.lit(start)))
        short = F.filter(words, lambda w: F.length(w) < start)
        return F.concat(_tagged("w", short), _tagged("p", beginnings), _tagged("g", _grams(it["text"], inside)), _tagged("g", _grams(it["brand_text"], inside)))

    return F.array_distinct(let(it, keys))


def query_keys(q: Column) -> Column:
    """For each word that a token may be, the keys that a matching product must all
    have: array of (word, keys)."""
    start, inside = matching.LEAST_START, matching.LEAST_INSIDE

    def choice(v):
        keys = F.when(F.length(v) < start, _tagged("w", F.array(v))).when(F.length(v) < inside, _tagged("p", F.array(v))).otherwise(_tagged("g", _grams(v, inside)))
        return F.struct(v.alias("word"), F.array_distinct(keys).alias("keys"))

    words = F.array_distinct(F.flatten(q["variants"]))
    return F.transform(F.filter(words, lambda v: v != ""), choice)


def key_pairs(queries: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, ord: the products that have the rarest key of a word of a query. The
    index holds only keys that some query may ask for; it is written once, counted, and
    then asked."""
    asked = queries.select("query_id", F.explode(query_keys(F.col("q"))).alias("w")).select("query_id", "w.word", F.explode("w.keys").alias("_key"))
    keyed = items.select("ord", F.explode(item_keys(F.col("it"))).alias("_key"))
    keyed = materialize(keyed.join(asked.select("_key").distinct(), "_key", "left_semi"), "search-keys")
    counted = asked.join(keyed.groupBy("_key").agg(F.count("*").alias("n")), "_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("query_id", "word").agg(F.min(F.struct("n", "_key")).alias("k")).filter("k.n > 0")
    return dictionary_join(keyed, rarest.select("query_id", "k._key").distinct(), ["_key"]).select("query_id", "ord").distinct()


def candidates(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Queries (query_id, q) with the products (ord, it) of which name or brand has a
    word of theirs: the columns of both, a row per pair. A query without words has
    none. The analyses are written to scratch, for they are read twice. Pairs are few
    bytes and cost much each, so they are dealt to tasks by their number, and items come
    to them by merging."""
    items, queries = materialize(items, "search-items"), materialize(queries, "search-queries")
    pairs = dealt(materialize(key_pairs(queries, items), "search-pairs"), "ord")
    both = spread_join(pairs.join(items.hint("merge"), "ord"), queries, ["query_id"])
    return both.filter(F.exists(matching.token_tiers(F.col("q"), F.col("it")), lambda t: t > 0))


#: Points of a word for the ranking of offers, and the demotion.
EXACT, BEGINNING, SUBSTRING, DEMOTED = 100, 70, 40, 0.45


def token_score(q: Column, it: Column, lexicon: Lexicon) -> Column:
    """The offer search's own score: per query token the best of whole word, word
    beginning and substring, averaged; demoted as ``matching.relevance`` is."""
    points = F.transform(
        matching.token_tiers(q, it), lambda t: F.when(t == 3, EXACT).when(t == 2, BEGINNING).when(t == 1, SUBSTRING).otherwise(0)
    )
    total = F.aggregate(points, F.lit(0), lambda a, p: a + p) / F.greatest(F.size("q.tokens"), F.lit(1))
    return total * F.when(matching.is_shifted(q, it, lexicon), DEMOTED).otherwise(1.0)


def offer_order(lexicon: Lexicon) -> list[Column]:
    """Stage, family tier, match strength, then the cheapest, then the first."""
    q, it = F.col("q"), F.col("it")
    family = F.when(q["family"].isNull(), 1).when(it["family"] == q["family"], 2).when(it["family"].isNull(), 1).otherwise(0)
    return [
        matching.match_stage(q, it, lexicon).desc(),
        family.desc(),
        token_score(q, it, lexicon).desc(),
        F.col("price").asc_nulls_last(),
        F.col("ord").asc(),
    ]
