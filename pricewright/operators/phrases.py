"""Occurrences of a dictionary's phrases in the words of rows, for a dictionary of any
size and phrases of any length.

A place in a row first meets the dictionary's first words, each of which is one row with
the lengths of its phrases; then the row's own words of just those lengths meet the
phrases. Both joins have one row for each key on the dictionary's side, which
is broadcast while it is small; ``spread_join`` spreads frequent words beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import dictionary_join, large_join


def collisions(phrases: DataFrame, meaning: str) -> DataFrame:
    """phrase, claims: the phrases that two meanings or more claim."""
    return phrases.filter(f"phrase IS NOT NULL AND {meaning} IS NOT NULL").groupBy("phrase").agg(F.sort_array(F.collect_set(meaning)).alias("claims")).filter("size(claims) > 1")


def unclaimed(phrases: DataFrame, meaning: str) -> DataFrame:
    """The dictionary with one row a phrase, without phrases that two meanings claim:
    no answer rather than a wrong one."""
    rows = phrases.filter(f"phrase <> '' AND {meaning} IS NOT NULL")
    return rows.join(collisions(phrases, meaning), "phrase", "left_anti").dropDuplicates(["phrase"])


def phrase_hits(rows: DataFrame, key: str, words: str, phrases: DataFrame) -> DataFrame:
    """key, start (from 0), n, before, after (the words beside it, null at the ends) and
    the columns of ``phrases`` for each occurrence of one. ``key`` is unique in ``rows``
    (a struct may be); ``phrases`` has a distinct ``phrase`` of words joined by a blank.
    Rows without words and null words have no hit."""
    known = phrases.withColumn("n", F.size(F.split("phrase", " ")))
    firsts = known.groupBy(F.substring_index("phrase", " ", 1).alias("word")).agg(F.sort_array(F.collect_set("n")).alias("lengths"))
    own = rows.select(F.col(key).alias("key"), F.col(words).alias("words"), known.agg(F.max("n")).scalar().alias("most"))
    near = F.transform("words", lambda w, i: F.struct(F.slice("words", i + 1, F.col("most") + 1).alias("ahead"), F.when(i > 0, F.get("words", i - 1)).alias("before")))
    places = own.filter("most IS NOT NULL").select("key", "most", F.posexplode(near).alias("start", "p"))
    places = places.select("key", "start", "p.*", F.get("p.ahead", F.lit(0)).alias("word"))
    met = dictionary_join(places.filter("word IS NOT NULL"), firsts, ["word"])
    fits = F.filter("lengths", lambda n: n <= F.size("ahead"))
    met = met.select("key", "start", "before", "ahead", F.explode(fits).alias("n"))
    met = met.select("key", "start", "before", F.get("ahead", F.col("n")).alias("after"), F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ").alias("phrase"))
    return dictionary_join(met, known, ["phrase"]).withColumnRenamed("key", key)


def head_phrases(rows: DataFrame, key: str, words: str, phrases: DataFrame, trailing: int = 2) -> DataFrame:
    """Per row with a phrase of a dictionary (phrase, meaning): the longest, of equals
    the one furthest right, as phrase, meaning, n, i; unknown: how many words behind it
    are in no phrase and do not begin with a digit; refused: whether these are
    ``trailing`` or more, for then the true head is not in the dictionary and what was
    found only describes it. Phrases of two meanings name nothing."""
    hits = phrase_hits(rows, key, words, unclaimed(phrases, "meaning").select("phrase", "meaning"))
    covered = F.collect_set(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b")))
    heads = hits.groupBy(key).agg(F.max_by(F.struct("phrase", "meaning", "n", F.col("start").alias("i")), F.struct("n", "start")).alias("head"), covered.alias("covered"))
    found = large_join(rows.select(key, F.col(words).alias("_words")), heads, [key])
    end = F.col("head.n") + F.col("head.i")
    behind = F.filter(
        F.transform("_words", lambda w, i: F.when((i >= end) & ~w.rlike(r"^\p{Nd}") & ~F.exists("covered", lambda c: (c["a"] <= i) & (i < c["b"])), i)), lambda i: i.isNotNull()
    )
    found = found.select(key, "head.*", F.size(behind).alias("unknown"))
    return found.withColumn("refused", F.col("unknown") >= trailing)


def branded(rows: DataFrame, words: str, brands: DataFrame, department: str) -> DataFrame:
    """+ brand: the first phrase of a row, of equals the longest, that is a brand allowed
    in its department and not beside a word that bars it. ``brands``: phrase, brand,
    departments (null: all), barred (neighbours, null: none); phrases match as whole
    words, those that two brands claim match nothing (``collisions`` has them). Rows
    are looked up once for all that have the same words and department; repeated rows
    stay."""
    name = F.struct(F.col(words).alias("words"), F.col(department).alias("department"))
    named = rows.withColumn("_name", name)
    own = named.select("_name").distinct().withColumn("_words", F.col("_name.words"))
    hits = phrase_hits(own, "_name", "_words", unclaimed(brands, "brand").select("phrase", "brand", "departments", "barred"))
    allowed = F.col("departments").isNull() | F.array_contains("departments", F.col("_name.department"))
    beside = F.arrays_overlap(F.array_compact(F.array("before", "after")), F.col("barred"))
    fits = F.coalesce(allowed, F.lit(False)) & ~F.coalesce(beside, F.lit(False))
    best = hits.filter(fits).groupBy("_name").agg(F.min_by("brand", F.struct("start", -F.col("n"))).alias("brand"))
    return large_join(named, best, ["_name"], "left").drop("_name")
