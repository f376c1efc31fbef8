"""Pairs of word sets that share enough, and greedy leaders over such pairs.

Pairs come from a prefix filter: with words in one order, rarest first, two sets that
share ``k`` words share one of the first ``n - k + 1`` words of each. Only these meet,
and a pair is made at the first word that both have there, so it is made once.

Greedy grouping (an item joins the first earlier leader like it, or leads) is the first
independent set in order, which rounds of joins find: an item that no undecided earlier
item is like leads, and what is like it falls. No row and no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import discard, materialize
from .resolve import spread_join


def rare_first(rows: DataFrame, key: str, words: str, counts: DataFrame | None = None, per: list[str] = []) -> DataFrame:
    """``rows`` that have words, + ``ordered``: their distinct words, those of fewest rows
    first. ``key`` is unique. ``counts`` (per, word, n) may come from other rows."""
    each = rows.select(key, *per, F.explode(F.array_distinct(words)).alias("word")).filter("word IS NOT NULL")
    counts = word_counts(rows, words, per) if counts is None else counts
    rated = spread_join(each, counts, [*per, "word"], "left").select(key, F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word").alias("w"))
    ordered = rated.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["word"]).alias("ordered"))
    return rows.join(ordered.hint("merge"), key)


def word_counts(rows: DataFrame, words: str, per: list[str] = []) -> DataFrame:
    each = rows.select(*per, F.explode(F.array_distinct(words)).alias("word")).filter("word IS NOT NULL")
    return each.groupBy(*per, "word").agg(F.count("*").alias("n"))


def at_least(n: Column, share: float) -> Column:
    """The least whole number of words that is ``share`` of ``n`` or more."""
    return F.greatest(F.ceil(n * F.lit(share) - 1e-9), F.lit(1)).cast("int")


def prefix(ordered: Column, share: float) -> Column:
    """The words of which one is shared by any set that shares ``share`` of these."""
    return F.slice(ordered, F.lit(1), F.size(ordered) - at_least(F.size(ordered), share) + 1)


def alike_pairs(rows: DataFrame, key: str, share: float, per: list[str], near: Column | None = None) -> DataFrame:
    """Pairs (a, b: structs of all columns, a's key below b's) in which the words shared
    are ``share`` of the larger set or more; a superset of those of that Jaccard
    similarity. ``rows`` come from ``rare_first``. With ``near`` (a whole number) only
    rows meet whose numbers differ by one at most."""
    one = rows.withColumn("_first", prefix(F.col("ordered"), share))
    own, others = (F.lit(0), F.array(F.lit(0))) if near is None else (near, F.array(near - 1, near, near + 1))

    def side(name: str, numbers: Column) -> DataFrame:
        dealt = one.withColumn("_near", F.explode(numbers))
        return dealt.select(*per, "_near", F.struct(*rows.columns, "_first").alias(name), F.explode("_first").alias("word"))

    met = side("a", others).join(side("b", F.array(own)), [*per, "word", "_near"]).filter(F.col("a")[key] < F.col("b")[key])
    met = met.filter(F.get(F.array_intersect("a._first", "b._first"), F.lit(0)) == F.col("word"))
    most = F.greatest(F.size("a.ordered"), F.size("b.ordered"))
    return met.filter(F.size(F.array_intersect("a.ordered", "b.ordered")) >= at_least(most, share)).select("a", "b")


def contained_pairs(left: DataFrame, right: DataFrame, share: float, blocks: tuple[Column, Column] | None = None) -> DataFrame:
    """Pairs (a from ``left``, b from ``right``: structs of all columns) that share
    ``share`` of the smaller set's words or more, once each. Both come from
    ``rare_first`` with the same counts. The smaller set's prefix meets all words of the
    larger that stand early enough for so many shared ones to follow. With ``blocks``
    (arrays of a left row's and a right row's) only rows meet that have one in common,
    once for each."""
    keys = ["word"] if blocks is None else ["word", "_block"]

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        return rows if blocks is None else rows.withColumn("_block", F.explode(blocks[name == "b"]))

    def met(small, s, large, g, strictly):
        own = small.withColumn("_first", prefix(F.col("ordered"), share))
        own = dealt(own, s).select(*keys[1:], F.struct(*small.columns, "_first").alias(s), F.explode("_first").alias("word"))
        all_ = dealt(large, g).select(*keys[1:], F.struct(*large.columns).alias(g), F.posexplode("ordered").alias("_place", "word"))
        size_s, size_g = F.size(f"{s}.ordered"), F.size(f"{g}.ordered")
        bigger = size_g > size_s if strictly else size_g >= size_s
        found = own.join(all_, keys).filter(bigger & (F.col("_place") <= size_g - at_least(size_s, share)))
        found = found.filter(F.get(F.array_intersect(f"{s}._first", f"{g}.ordered"), F.lit(0)) == F.col("word"))
        found = found.filter(F.size(F.array_intersect(f"{s}.ordered", f"{g}.ordered")) >= at_least(size_s, share))
        return found.select(F.col(s).dropFields("_first").alias(s), g).select("a", "b")

    return met(left, "a", right, "b", False).unionByName(met(right, "b", left, "a", True))


def leaders(nodes: DataFrame, edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(node, leader): the first of its earlier neighbours that leads, or the node itself
    if none does. ``nodes``: node (orderable, unique), cls (null: none); ``edges``: a, b
    with a < b. Items of one class, and of classes paired in ``classes`` (c, d, both
    ways), are neighbours too, without an edge for each pair.

    Each round decides the nodes that have no undecided neighbour before them, and all
    neighbours of those; random orders need few rounds, a path in order half its length.
    """
    nodes, edges = materialize(nodes.select("node", "cls"), "lead-nodes"), materialize(edges.select("a", "b").distinct(), "lead-edges")
    if classes is not None:
        own = nodes.filter("cls IS NOT NULL").select(F.col("cls").alias("c"), F.col("cls").alias("d"))
        classes = materialize(classes.select("c", "d").union(own).distinct(), "lead-classes")

    def first_near(some: DataFrame) -> DataFrame:
        """cls, least: the least of ``some`` nodes in a class or one paired with it."""
        least = some.filter("cls IS NOT NULL").groupBy(F.col("cls").alias("c")).agg(F.min("node").alias("n"))
        return spread_join(classes, least, ["c"]).groupBy(F.col("d").alias("cls")).agg(F.min("n").alias("least"))

    def behind(some: DataFrame, of: DataFrame) -> DataFrame:
        """The nodes of ``some`` with one of ``of`` before them in a near class."""
        return spread_join(some.filter("cls IS NOT NULL"), first_near(of), ["cls"]).filter("least < node").select("node")

    fallen, rest, undecided = [], edges, nodes
    while not (rest if classes is None else undecided).isEmpty():
        waiting = rest.select(F.col("b").alias("node"))
        if classes is None:
            heads = rest.select(F.col("a").alias("node")).distinct().join(waiting.distinct(), "node", "left_anti")
        else:
            heads = undecided.join(waiting.union(behind(undecided, undecided)).distinct(), "node", "left_anti")
        heads = materialize(heads, "lead-heads")
        down = spread_join(rest, heads.select(F.col("node").alias("a")), ["a"]).select(F.col("b").alias("node"))
        if classes is not None:
            down = down.union(behind(undecided, heads))
        down = materialize(down.distinct(), "lead-down")
        left = spread_join(rest, heads.select(F.col("node").alias("a")), ["a"], "left_anti")
        for end in ("a", "b"):
            left = spread_join(left, down.select(F.col("node").alias(end)), [end], "left_anti")
        left = materialize(left, "lead-edges")
        if classes is not None:
            later = materialize(undecided.join(heads.select("node").union(down), "node", "left_anti"), "lead-nodes")
            if undecided is not nodes:
                discard(undecided)
            undecided = later
        if rest is not edges:
            discard(rest)
        discard(heads)
        fallen.append(down)
        rest = left
    if not fallen:
        return nodes.select("node", F.col("node").alias("leader"))
    down = fallen[0]
    for more in fallen[1:]:
        down = down.union(more)
    down = materialize(down, "lead-down")
    heads = materialize(nodes.join(down, "node", "left_anti"), "lead-heads")
    found = spread_join(edges, heads.select(F.col("node").alias("a")), ["a"]).select(F.col("b").alias("node"), F.col("a").alias("leader"))
    if classes is not None:
        near = spread_join(nodes.filter("cls IS NOT NULL"), first_near(heads), ["cls"]).filter("least < node")
        found = found.union(near.select("node", F.col("least").alias("leader")))
    found = found.groupBy("node").agg(F.min("leader").alias("leader")).join(down, "node", "left_semi")
    return heads.select("node", F.col("node").alias("leader")).union(found)
