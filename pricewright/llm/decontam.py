"""Benchmark decontamination: documents' words inside n-grams of a test set.

The test set's normalised n-grams are a hash set in two forms: an array of bits, one
literal in the plan, which every window of a document is looked up in without leaving
its row, and the n-grams themselves, broadcast where their counted size allows. Only
windows whose bits are set leave the row, with their text, and the join on that text
verifies them. Verified windows are gathered by document; rows without a candidate
never enter a shuffle. Spans or whole documents can then be removed.

Only DataFrame expressions run; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from .common import alphanumeric_words, long_array, materialize, spread_join

#: Words of a window; a shorter item is one window of all its words.
WORDS = 10
#: Bits of the filter for each n-gram, and most bits in all (a literal of 2 MB). Beyond
#: a million n-grams the share of windows that pass by chance grows (to 15 % at four
#: million): they cost a join row each, and results stay the same.
BITS_EACH, MOST_BITS = 64, 1 << 24
#: The n-grams are broadcast up to so many bytes (counted), else they meet the
#: candidates in a shuffle that spreads frequent ones.
BROADCAST_BYTES = 128 << 20


def _starts(n_words: Column, length: int) -> Column:
    """1, 2, ... for the windows of ``length`` words."""
    none = F.array().cast("array<int>")
    return F.when(n_words >= length, F.sequence(F.lit(1), n_words - (length - 1))).otherwise(none)


def _window_hash(hashes: Column, start: Column, length) -> Column:
    return F.xxhash64(F.slice(hashes, start, length))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_windows(benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """item_id, text -> one row per distinct window: gram (its words, joined by a
    space), length, h, items (ids as strings, sorted; null ids are none). An items list
    is no longer than the ids of the test set, as a document's own list may be."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), alphanumeric_words(F.col("text")).alias("w"))
    length = F.least(F.lit(n), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - length + 1)
    each = F.transform(starts, lambda i: F.slice("w", i, length))
    grams = words.filter(F.size("w") > 0).select("item", F.explode(each).alias("g"))
    return (
        grams.groupBy(F.array_join("g", " ").alias("gram"))
        .agg(F.array_sort(F.collect_set("item")).alias("items"), F.first("g").alias("g"))
        .select("gram", F.size("g").alias("length"), F.xxhash64(_hashes(F.col("g"))).alias("h"), "items")
    )


class GramFilter:
    """Two bits a gram in an array of 2 ** k bits, which any expression can ask."""

    def __init__(self, grams: DataFrame, count: int):
        self.bits = min(MOST_BITS, max(1024, 1 << (BITS_EACH * count - 1).bit_length()))
        places = F.array(*self._places(F.col("h")))
        words = (
            grams.select(F.explode(places).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("mask"))
        )
        found = dict(words.collect())  # at most MOST_BITS / 64 rows
        self.words = long_array(found.get(i, 0) for i in range(self.bits >> 6))

    def _places(self, h: Column) -> list[Column]:
        mask = F.lit(self.bits - 1).cast("long")
        return [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]

    def may_hold(self, h: Column) -> Column:
        first, second = (
            F.getbit(F.element_at(self.words, F.shiftright(p, 6).cast("int") + 1), p.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
            for p in self._places(h)
        )
        return first & second


def _candidates(words: Column, lengths: list[int], known: GramFilter) -> Column:
    """The number of words and the windows that the filter lets pass, with their text."""

    def of_length(hashes: Column, length: int) -> Column:
        each = F.transform(_starts(F.size(hashes), length), lambda i: _window_hash(hashes, i, length))
        passing = lambda own: F.filter(_starts(F.size(hashes), length), lambda i: known.may_hold(F.element_at(own, i)))
        told = lambda i: F.struct(i.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice(words, i, length), " ").alias("gram"))
        return F.transform(let(each, passing), told)

    found = lambda hashes: F.concat(*[of_length(hashes, n) for n in lengths])
    return F.struct(F.size(words).cast("long").alias("n_words"), let(_hashes(words), found).alias("windows"))


def covered(spans: Column) -> Column:
    """How many words sorted windows (start, length) cover together."""
    last = lambda s: (s["start"] + s["length"]).cast("long")
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(a, s):
        fresh = F.greatest(F.lit(0).cast("long"), last(s) - F.greatest(a["end"], s["start"].cast("long")))
        return F.struct((a["n"] + fresh).alias("n"), F.greatest(a["end"], last(s)).alias("end"))

    return F.aggregate(spans, begin, add, lambda a: a["n"])


def joined_spans(spans: Column) -> Column:
    """Sorted windows as runs that do not touch: array of (first, behind)."""
    empty = F.array().cast("array<struct<first:int,behind:int>>")

    def add(a, s):
        own = F.struct(s["start"].alias("first"), (s["start"] + s["length"]).alias("behind"))
        tail = F.get(a, F.size(a) - 1)
        longer = F.struct(tail["first"].alias("first"), F.greatest(tail["behind"], own["behind"]).alias("behind"))
        touches = (F.size(a) > 0) & (s["start"] <= tail["behind"])
        return F.when(touches, F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(a, F.array(own)))

    return F.aggregate(spans, empty, add)


def mark_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Find the test set's windows in documents.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text. Returns one row per
    input row: doc_id, n_words, n_hit (words inside any window of an item), spans (the
    windows found: start from 1, length), items (ids of items with a window found, as
    sorted strings). Null and empty texts have no words. An item without words has no
    window; one without an id marks words and is in no list; repeated items count once.
    Repeated documents and those without an id are marked each. Very long texts are
    looked up whole. An empty test set marks nothing; an empty table gives no rows.
    Further columns are ignored, but those of ``carry``, whatever their names, come
    back as one struct ``carried``.
    """
    grams = materialize(item_windows(benchmark, n), "decontam-grams")
    size = F.length("gram") + 16 + F.aggregate("items", F.lit(0), lambda a, x: a + F.length(x) + 8)
    count, total, lengths = grams.agg(F.count("*"), F.sum(size), F.array_sort(F.collect_set("length"))).first()
    box = [F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []
    carried = ("carried",) if carry else ()
    words = alphanumeric_words(F.col("text"))
    nothing = [
        F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<struct<start:int,length:int>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    ]
    if not count:
        return docs.select("doc_id", *box, F.size(words).cast("long").alias("n_words"), *nothing)
    known = GramFilter(grams, count)
    scanned = docs.select("doc_id", *box, let(words, lambda w: _candidates(w, lengths, known)).alias("found"))
    scanned = scanned.select("doc_id", *carried, "found.*", F.monotonically_increasing_id().alias("row_no"))
    scanned = materialize(scanned, "decontam-windows")
    touched = F.size("windows") > 0
    asked = scanned.filter(touched).select("row_no", F.explode("windows").alias("w")).select("row_no", "w.*")
    items = grams.select("gram", "items")
    hits = asked.join(F.broadcast(items), "gram") if total <= BROADCAST_BYTES else spread_join(asked, items, ["gram"])
    by_row = hits.groupBy("row_no").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    out = ["doc_id", *carried, "n_words", "n_hit", "spans", "items"]
    found = scanned.filter(touched).drop("windows").join(by_row, "row_no", "left")
    found = found.withColumns({"spans": F.coalesce("spans", nothing[1]), "items": F.coalesce("items", nothing[2])})
    found = found.withColumn("n_hit", covered(F.col("spans")))
    return scanned.filter(~touched).select("doc_id", *carried, "n_words", *nothing).unionByName(found.select(*out))


def without_spans(text: Column, spans: Column) -> Column:
    """A text without the words of the spans and what stands before each of them."""
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(text, F.lit(f"{gap}*{gap.replace('[', '[^', 1)}+|{gap}+$"), F.lit(0))

    def rest(p: Column) -> Column:
        def kept(runs: Column) -> Column:
            starts = F.concat(F.array(F.lit(1)), F.transform(runs, lambda r: r["behind"]))
            ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(p) + 1))
            return F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda k: F.slice(p, k["a"], k["b"] - k["a"])))

        return F.array_join(let(joined_spans(spans), kept), "")

    return F.when(F.size(spans) == 0, text).otherwise(let(pieces, rest))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = WORDS) -> DataFrame:
    """The documents, with all their columns, without what the test set shares with
    them: without the ``spans`` found, or without the ``documents`` that have any."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    marked = mark_contamination(docs, benchmark, n, carry=docs.columns)
    if remove == "documents":
        return marked.filter("n_hit = 0").select("carried.*")
    clean = without_spans(F.col("carried.text"), F.col("spans"))
    return marked.select(*[(clean if c == "text" else F.col("carried")[c]).alias(c) for c in docs.columns])


def op12(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = mark_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), '{}', '{}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
grams AS (
  SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
    lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS gram
  FROM items WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
starts AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM docs, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n),
windows AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM starts),
hits AS (SELECT r, i, windows.n, item FROM windows JOIN grams USING (gram)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""
