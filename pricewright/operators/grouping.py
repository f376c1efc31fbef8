"""Equivalence of listings.

Greedy grouping depends on order and compares with each group's first member only, so
its groups are those of the first independent set in order (``overlap.leaders``). Equal
listings are one node; pairs come from a prefix filter over their words, or, where
brands decide, from classes of size, form and brand.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.size import TOLERANCE, within
from ..functions.text import jaccard
from ..sources.store import materialize
from . import overlap
from .resolve import large_join

DUPLICATE = 0.7
NAME_OVERLAP = 0.6


def _profiles(rows: DataFrame, columns: list[str], ord_: str, label: str) -> DataFrame:
    """Distinct ``columns`` with the first ``ord_`` of each, as ``node``: a struct that
    the first column (a struct of the block) and ``ord_`` make unique and orderable."""
    first = rows.groupBy(*columns).agg(F.min(ord_).alias("ord"))
    return materialize(first.withColumn("node", F.struct(F.col(columns[0]).alias("block"), "ord")), label)


def dedupe_listings(rows: DataFrame, per: list[str], ord_: str, words: str, share: float = DUPLICATE) -> DataFrame:
    """Listings left after dropping those whose words overlap an earlier kept one's
    of the same ``per`` (store and price; nulls are equal) by ``share`` or more
    (Jaccard). ``ord_`` is unique within ``per``. Listings without words stay."""
    box = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(per)])
    rows = rows.select(box.alias("block"), F.array_sort(F.array_distinct(F.array_compact(words))).alias("words"), F.col(ord_).alias("ord"))
    bare = F.coalesce(F.size("words"), F.lit(0)) <= 0
    nodes = _profiles(rows.filter(~bare), ["block", "words"], "ord", "dedupe-nodes")
    pairs = overlap.alike_pairs(overlap.rare_first(nodes, "node", "words", per=["block"]), "node", share, ["block"])
    pairs = pairs.filter(jaccard(F.col("a.words"), F.col("b.words")) >= share).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    led = overlap.leaders(nodes.select("node", F.lit(None).cast("string").alias("cls")), pairs)
    kept = led.filter("node = leader").select("node.block", "node.ord").union(rows.filter(bare).select("block", "ord"))
    return kept.select(*[F.col("block")[f"k{i}"].alias(c) for i, c in enumerate(per)], F.col("ord").alias(ord_))


def group_equivalents(rows: DataFrame, block: list[str], ord_: str) -> DataFrame:
    """Groups of the same product within a block (a unit): sizes within 3%, forms
    not in conflict, brands equal, or without brands names that overlap by 0.6.
    ``rows``: total, form, brand, words; ``ord_`` is unique within a block. Returns
    block, ord, leader: the ``ord_`` of its group's first member. Rows that are like
    nothing, for want of a size or of words, are groups of their own."""
    box = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(block)])
    rows = materialize(
        rows.select(
            box.alias("block"), F.col(ord_).alias("ord"), F.col("total").cast("double").alias("total"), "form",
            F.coalesce("brand", F.lit("")).alias("brand"), F.array_sort(F.array_distinct(F.array_compact(F.coalesce("words", F.array().cast("array<string>"))))).alias("words"),
        ),
        "group-rows",
    )
    same = ["block", "total", "form", "brand", "words"]
    can = F.coalesce(F.col("total") > 0, F.lit(False)) & ((F.col("brand") != "") | (F.size("words") > 0))
    nodes = _profiles(rows.filter(can), same, "ord", "group-nodes")
    bucket = F.floor(F.log("total") / F.lit(-1.000001 * math.log(1 - TOLERANCE)))
    fits = lambda a, b: within(a["total"], b["total"]) & F.coalesce(a["form"] == b["form"], F.lit(True))
    pairs = overlap.alike_pairs(overlap.rare_first(nodes, "node", "words", per=["block"]), "node", NAME_OVERLAP, ["block"], bucket)
    a, b = F.col("a"), F.col("b")
    bare = (a["brand"] == "") | (b["brand"] == "")
    pairs = pairs.filter(bare & fits(a, b)).select(a["node"].alias("a"), b["node"].alias("b"))
    kind = F.struct("block", "total", "form", "brand")
    nodes_of = nodes.select("node", F.when(F.col("brand") != "", kind).alias("cls"))
    kinds = nodes.filter("brand <> ''").select("block", "brand", kind.alias("cls"), bucket.alias("_near")).distinct()
    wide = kinds.select("block", "brand", F.col("cls").alias("c"), F.explode(F.array(F.col("_near") - 1, F.col("_near"), F.col("_near") + 1)).alias("_near"))
    classes = wide.join(kinds.withColumnRenamed("cls", "d"), ["block", "brand", "_near"]).filter(fits(F.col("c"), F.col("d"))).select("c", "d")
    led = overlap.leaders(nodes_of, pairs, classes)
    known = nodes.join(led.hint("merge"), "node").select(*[F.col(c).alias(f"_{c}") for c in same], F.col("leader.ord").alias("leader"))
    every = rows.withColumn("_key", F.xxhash64(*same))
    known = known.withColumn("_key", F.xxhash64(*[f"_{c}" for c in same]))
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = large_join(every.filter(can), known, ["_key"]).filter(equal)
    out = found.select("block", "ord", "leader").union(rows.filter(~can).select("block", "ord", F.col("ord").alias("leader")))
    return out.select(*[F.col("block")[f"k{i}"].alias(c) for i, c in enumerate(block)], F.col("ord").alias(ord_), "leader")


def canonical_groups(rows: DataFrame, product: str, brand: str, store: str, per: str | None = None, head: str | None = None) -> DataFrame:
    """Products sold by two stores or more: stores and rows per product and brand. With
    a pool ``per`` also the rank of each group in its pool: the one with the headline
    (``head``: a boolean column) first, then more stores, then the lesser product."""
    keys = [product, brand] if per is None else [per, product, brand]
    more = [] if head is None else [F.max(head).alias("has_head")]
    groups = rows.groupBy(*keys).agg(F.count_distinct(store).alias("stores"), F.count("*").alias("listings"), *more).filter("stores >= 2")
    if per is None:
        return groups
    first = [F.col("has_head").desc()] if head else []
    return groups.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*first, F.col("stores").desc(), product, brand)))


def pull_in(admitted: DataFrame, pool: DataFrame, keys: list[str], product: list[str]) -> DataFrame:
    """Rows of ``pool`` that share product and brand with an admitted row, and are
    not admitted themselves."""
    known = admitted.select(*product).distinct()
    return pool.join(known, product, "left_semi").join(admitted.select(*keys), keys, "left_anti")
