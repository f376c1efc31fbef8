r"""N-gram Jaccard join with multiple-global-order filtering.

Texts are sets of hashed word shingles. Under any one global order of the shingles,
two sets of Jaccard similarity t or more share l shingles or more among their first
n - ceil(t n) + l ones (n the set's size). A pair must pass that test under several
orders before its sets are compared:

1. the hash order tests every set: of its prefix enough shingles must stand in
   another set's prefix too. What a prefix has alone it cannot share, which bounds
   what the whole set can share; most sets go here. The sets left are counted whole,
   and those of which less than t is shared with another set go as well;
2. the order "rarest first" makes the buckets: sets near in size that share a prefix
   shingle. A bucket's pivot is the set whose shingles are the commonest. Each set
   pairs with its buckets' pivots only, so a group of near copies costs about one
   pair a member;
3. two further orders (other bijections of the hash) must agree on l shared shingles;
4. pairs without a pivot: all sets of a pivot's family differ from it by some
   shingles, and their differences are sets again. The difference between two sets is
   that between their differences, so sets that link share at least
   k = (|D(a)| + |D(b)| - (|a| + |b|) / 9) / 2 of them. A prefix filter over the
   differences, rarest first in the family, with the exact k and positions, gives the
   candidates. It is asked only where links with pivots have left a family in two or
   more components, and only for pairs of which one set is outside its pivot's
   component (for those k is 1 or more, so the filter loses no link).

Equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, scratch_tables, shared, spread_join, sweep
from .components import connected_components
from .shingles import fingerprint, mix, parts, shingle_sets

#: Similarity as a fraction: 80 hundredths. Sets link if their difference has no more
#: than (|a| + |b|) / ``APART`` shingles, which is the same.
SHARE, OF = 80, 100
APART = (OF + SHARE) // (OF - SHARE)
#: Two prefixes must share 1 + n // ``PER_SHARED`` shingles, n the smaller set's size.
PER_SHARED = 20
#: Further orders that must agree on a pair, by their multiplier.
ORDERS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Size bands are a little wider than sets that link can be apart, 5 / 4.
BAND = 1.2501
#: Bits of the prefilter at most (16 MB); a full one lets more through, nothing less.
FILTER_BITS = 1 << 27
#: Rows that a batch of exploded sets may have, beyond one set.
BATCH_ROWS = 1 << 17

#: While the join runs: shuffle files go as soon as their query has ended, Arrow batches
#: of texts and sets stay small, and a side is broadcast only if its rows, with their
#: copies, were measured after a shuffle. A file's size says little of them: the labels of
#: near copies are a few bytes a row in Parquet, and they and their copies grow with the
#: input in the driver's memory.
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]):
    """Set session settings, and put back what they were."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def prefix_length(n: int, shared: int = 1) -> int:
    return n - -(-SHARE * n // OF) + shared


def _batch(arrays: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays.values()], names=list(arrays))


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    return (t.as_py() for t in batch["text"])


def _set(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def set_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, fp. ``fp`` is a 128-bit digest of the set,
    null if it is empty."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp = [], []
            for part in parts(_texts(batch)):
                for s in shingle_sets(part):
                    n.append(len(s))
                    fp.append(fingerprint(s))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(fp, pa.binary())], names=["doc_id", "n_shingles", "fp"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sets, f"doc_id {kind}, n_shingles bigint, fp binary")


def _hash_prefix(s: np.ndarray) -> np.ndarray:
    """The prefix under the hash order (sets are sorted by it)."""
    return s[: prefix_length(len(s), 1 + len(s) // PER_SHARED)]


def prefix_rows(docs: DataFrame) -> DataFrame:
    """(token, tag) for every shingle of a set's prefix under the hash order; sets
    that differ have different tags (64 bits of their digests)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(_texts(batch)):
                found = {fingerprint(s): _hash_prefix(s) for s in shingle_sets(part) if len(s)}
                token = np.concatenate(list(found.values())) if found else np.zeros(0, np.uint64)
                tag = np.frombuffer(b"".join(f[:8] for f in found), np.int64)
                yield _batch({"token": token.view(np.int64), "tag": np.repeat(tag, [len(s) for s in found.values()])})

    return docs.select("text").mapInArrow(rows, "token bigint, tag bigint")


class Sieve:
    """A Bloom filter of 64-bit values with a bounded number of bits."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits >> 6, np.uint64)

    def at(self, x: np.ndarray) -> tuple:
        h = mix(x ^ np.uint64(0x2545F4914F6CDD1D))
        return tuple((h >> np.uint64(s)) & np.uint64(self.bits - 1) for s in (0, 32))

    def holds(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for p in self.at(x):
            hit &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return hit


def sieve_of(values: DataFrame, column: str) -> Sieve:
    """Built by Spark: each batch gives its words, which are joined by OR."""
    n = max(1, values.count())
    bits = min(FILTER_BITS, max(1 << 12, 1 << (12 * n - 1).bit_length()))
    empty = Sieve(bits)

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch[column].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            p = np.unique(np.concatenate(empty.at(x)))
            word, first = np.unique((p >> np.uint64(6)).astype(np.int64), return_index=True)
            mask = np.uint64(1) << (p & np.uint64(63))
            mask = np.bitwise_or.reduceat(mask, first) if len(first) else mask
            yield _batch({"word": word.astype(np.int32), "mask": mask.view(np.int64)})

    # at most bits / 64 rows of 12 bytes, read as Arrow
    found = values.select(column).mapInArrow(words, "word int, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("m")).toArrow()
    out = Sieve(bits)
    out.words[found["word"].to_numpy()] = found["m"].to_numpy().view(np.uint64)
    return out


def candidate_sets(docs: DataFrame, tokens) -> DataFrame:
    """(cid, fp, shingles), a row for each class that can link by its hash-order
    prefix. ``tokens`` gives a sieve of the prefix shingles that two classes have; what
    a prefix lacks there no other class has in its own."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = tokens()
        for batch in batches:
            for part in parts(_texts(batch)):
                found = {}
                for s in shingle_sets(part):
                    n, prefix = len(s), _hash_prefix(s)
                    if not n:
                        continue
                    held = int(sieve.holds(prefix).sum())
                    if held > SHARE * n // OF // PER_SHARED and OF * (n - len(prefix) + held) >= SHARE * n:
                        found[fingerprint(s)] = s.tobytes()
                yield _batch({"fp": pa.array(list(found), pa.binary()), "shingles": pa.array(list(found.values()), pa.binary())})

    found = docs.select("text").mapInArrow(rows, "fp binary, shingles binary").dropDuplicates(["fp"])
    return found.select(F.monotonically_increasing_id().alias("cid"), "fp", "shingles")


def shingle_rows(sets: DataFrame) -> DataFrame:
    """(token, cid, n) for every shingle of every set."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, own = batch["cid"].to_numpy(), [_set(x) for x in batch["shingles"]]
            sizes = np.array([len(s) for s in own], np.int64)
            for a, b in _runs(sizes):
                yield _batch(
                    {
                        "token": np.concatenate(own[a:b]).view(np.int64),
                        "cid": np.repeat(cid[a:b], sizes[a:b]),
                        "n": np.repeat(sizes[a:b].astype(np.int32), sizes[a:b]),
                    }
                )

    return sets.select("cid", "shingles").mapInArrow(rows, "token bigint, cid bigint, n int")


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``BATCH_ROWS`` at most, or of one row."""
    a, total = 0, 0
    for b, size in enumerate(sizes.tolist()):
        if b > a and total + size > BATCH_ROWS:
            yield a, b
            a, total = b, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def shared_rows(rows: DataFrame) -> DataFrame:
    """token, cid, n, c, held, common: the shingles that ``c`` (two or more) classes
    have, of classes of which enough is shared. ``held`` is how many shingles of the
    class are, ``common`` how common they are on average."""
    counts = rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    found = materialize(rows.join(counts, "token").select("token", "cid", "n", "c"), "jaccard-shared")
    weight = F.sum((F.log("c") * 1024).cast("long")) / F.col("n")
    held = found.groupBy("cid", "n").agg(F.count("*").alias("held"), weight.alias("common"))
    return found.join(held.filter(OF * F.col("held") >= SHARE * F.col("n")).drop("n"), "cid")


def families(rows: DataFrame) -> DataFrame:
    """(a, p): every class with the pivots of its buckets under the order "rarest
    first". Shingles that one class alone has come first in it and need no row. Sets
    near enough in size share one of two size bands."""
    rarest = Window.partitionBy("cid").orderBy("c", "token")
    alone = F.col("n") - F.col("held")
    length = F.col("n") - F.ceil(F.col("n") * SHARE / OF) + 1
    prefix = rows.withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= length - alone)
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")
    placed = materialize(prefix.select("token", F.explode(F.array(band, band + 1)).alias("band"), "cid", "common"), "jaccard-prefixes")
    tops = placed.groupBy("token", "band").agg(F.max(F.struct("common", "cid"))["cid"].alias("p"))
    pairs = placed.join(tops, ["token", "band"]).filter("cid <> p").select(F.col("cid").alias("a"), "p").distinct()
    pairs = materialize(pairs, "jaccard-families")
    discard(placed)
    return pairs


def order_prefixes(sets: DataFrame) -> DataFrame:
    """cid, n and the prefixes under ``ORDERS`` as arrays."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_set(x) for x in batch["shingles"]]
            columns = [batch["cid"], pa.array([len(s) for s in own], pa.int32())]
            for order in ORDERS:
                turned = [np.sort(s * np.uint64(order))[: prefix_length(len(s), 1 + len(s) // PER_SHARED)] for s in own]
                flat = np.concatenate(turned) if turned else np.zeros(0, np.uint64)
                ends = np.cumsum([0, *map(len, turned)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names=["cid", "n", "o0", "o1"])

    return sets.select("cid", "shingles").mapInArrow(rows, "cid bigint, n int, o0 array<bigint>, o1 array<bigint>")


def agreed(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are near in size and share enough under all of
    the further orders."""
    named = lambda c: orders.select(F.col("cid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "o0", "o1")])
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    near = OF * F.least("n_a", "n_b") >= SHARE * F.greatest("n_a", "n_b")
    least = 1 + F.floor(F.least("n_a", "n_b") / PER_SHARED)
    for order in ("o0", "o1"):
        near &= F.size(F.array_intersect(f"{order}_a", f"{order}_b")) >= least
    return both.filter(near).select("a", "b")


def _shares(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets link."""
    both = _shares(a, b)
    return OF * both >= SHARE * (len(a) + len(b) - both)


def _with_sets(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs with the sets of ``a`` as x and of ``b`` as y."""
    one = pairs.join(sets.select(F.col("cid").alias(a), F.col("shingles").alias("x")), a)
    return one.join(sets.select(F.col("cid").alias(b), F.col("shingles").alias("y")), b)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes that link."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [similar(_set(x), _set(y)) for x, y in zip(batch["x"], batch["y"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return _with_sets(pairs, sets, "a", "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def mixed_families(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """a, p, root, outside: the members of the families that are not one component;
    ``outside`` if the member is not in its pivot's."""
    own = lambda c, r: roots.select(F.col("node").alias(c), F.col("root").alias(r))
    rooted = pairs.join(own("a", "ra"), "a", "left")
    rooted = spread_join(rooted, pairs.select("p").distinct().join(own("p", "rp"), "p", "left"), ["p"])
    rooted = rooted.select("a", "p", F.coalesce("ra", "a").alias("root"), (F.coalesce("ra", "a") != F.coalesce("rp", "p")).alias("outside"))
    rooted = materialize(rooted, "jaccard-rooted")
    return spread_join(rooted, rooted.filter("outside").select("p").distinct(), ["p"])


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, p, root, outside, na, np, nd, token: every shingle in which a member differs
    from its pivot; ``nd`` of them in all."""
    kept = ("a", "p", "root", "outside")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [_set(v) for v in batch["x"]], [_set(v) for v in batch["y"]]
            found = [np.setxor1d(a, b, assume_unique=True) for a, b in zip(x, y, strict=True)]
            sizes = np.array([len(d) for d in found], np.int64)
            fixed = {k: batch[k].to_numpy(zero_copy_only=False) for k in kept}
            fixed |= {"na": np.array([*map(len, x)], np.int32), "np": np.array([*map(len, y)], np.int32), "nd": sizes.astype(np.int32)}
            for a, b in _runs(sizes):
                part = {k: np.repeat(v[a:b], sizes[a:b]) for k, v in fixed.items()}
                yield _batch(part | {"token": np.concatenate(found[a:b]).view(np.int64)})

    schema = "a bigint, p bigint, root bigint, outside boolean, na int, np int, nd int, token bigint"
    return _with_sets(members, sets, "a", "p").select(*kept, "x", "y").mapInArrow(rows, schema)


def difference_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) that can link by a prefix filter over their differences
    from a pivot they have in common. One of each pair is outside its pivot's
    component, and the two are in different components.

    A set outside has more than (na + np) / 9 differences. Sets that link share
    k >= max(nd_a, nd_b) - (na + nb) / 9, and nb <= 5/4 na; with a partner outside
    also k > (nd_a + (np - na) / 9) / 2. The prefixes are as long as the bounds ask.
    """
    counts = found.groupBy("p", "token").agg(F.count("*").alias("c")).filter("c > 1")
    again = found.join(counts, ["p", "token"])
    member = Window.partitionBy("p", "a")
    # differences that one member alone has come first and need no row
    place = F.col("nd") - F.count("*").over(member) + F.row_number().over(member.orderBy("c", "token"))
    any_k = F.greatest(F.lit(1), F.ceil(F.col("nd") - F.col("na") / 4))
    outer_k = F.greatest(any_k, F.ceil((APART * F.col("nd") + F.col("np") - F.col("na")) / (2 * APART)))
    index = again.withColumn("place", place.cast("int"))  # 1 for the first
    index = index.withColumn("short", F.col("place") <= F.col("nd") - outer_k + 1)
    index = index.filter(F.col("short") | F.col("outside") & (F.col("place") <= F.col("nd") - any_k + 1))
    index = materialize(index.select("p", "token", "a", "root", "outside", "na", "nd", "place", "short"), "jaccard-index")
    one = index.filter("outside").alias("l")
    two = index.filter("short").alias("r")
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))  # noqa: E741
    near = OF * F.least(l("na"), r("na")) >= SHARE * F.greatest(l("na"), r("na"))
    # at the first shared difference, what is left must do
    left = F.least(l("nd") - l("place"), r("nd") - r("place"))
    enough = 2 * APART * (1 + left) >= APART * (l("nd") + r("nd")) - (l("na") + r("na"))
    once = ~r("outside") | (l("short") & (l("a") < r("a")))
    on = (l("p") == r("p")) & (l("token") == r("token")) & (l("root") != r("root")) & near & enough & once
    pairs = one.join(two, on).select(F.least(l("a"), r("a")).alias("a"), F.greatest(l("a"), r("a")).alias("b")).distinct()
    pairs = materialize(pairs, "jaccard-pairs")
    discard(index)
    return pairs


def class_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, fp) of classes that may link, and links (a, b) between cids that make the
    same components as all links."""
    spark = docs.sparkSession
    ends = prefix_rows(docs).groupBy("token").agg(F.min("tag").alias("low"), F.max("tag").alias("high"))
    tokens = materialize(ends.filter("low <> high").select("token"), "jaccard-tokens")
    sets = materialize(candidate_sets(docs, shared(spark, sieve_of(tokens, "token"))), "jaccard-sets")
    discard(tokens)
    first = materialize(shared_rows(shingle_rows(sets)).select("token", "cid", "n"), "jaccard-counted")
    pairs = families(shared_rows(first))
    discard(first)
    members = pairs.select(F.col("a").alias("cid")).union(pairs.select("p")).distinct()
    live = materialize(sets.join(members, "cid"), "jaccard-live")
    discard(sets)
    orders = materialize(order_prefixes(live), "jaccard-orders")
    stars = materialize(agreed(pairs.select("a", F.col("p").alias("b")), orders), "jaccard-stars")
    links = materialize(verified(stars, live), "jaccard-links")
    discard(stars)
    roots = connected_components(links)
    mixed = materialize(mixed_families(pairs, roots), "jaccard-mixed")
    others = difference_pairs(materialize(differences(mixed, live), "jaccard-differences"))
    more = materialize(verified(agreed(others, orders), live), "jaccard-more")
    return live.select("cid", "fp"), links.union(more)


def class_components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp, component): the least doc_id of each class's component."""
    least = classes.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = materialize(least, "jaccard-least")
    live, links = class_links(docs)
    linked = live.join(connected_components(links), F.col("cid") == F.col("node")).select("fp", "root").join(least, "fp")
    linked = materialize(linked, "jaccard-linked")
    ids = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = spread_join(linked, ids, ["root"]).select("fp", "component")
    return least.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id, one row per row.

    ``component_id`` is the least doc_id that can be reached over links of Jaccard
    similarity 0.8 or more between sets of distinct five-word shingles. Null or
    empty text, or one of blanks: an empty set, linked with nothing, its own
    doc_id. Null doc_id: takes part in links; the id of its component is the least
    that is not null. Repeated rows: equal sets, so one component. Very long texts:
    compared whole. Empty table: no rows. Further columns of ``docs`` are ignored.

    Sets are told apart by 128-bit digests of 64-bit shingle hashes.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    with session_settings(docs.sparkSession, SETTINGS):
        classes = materialize(set_classes(docs), "jaccard-classes")
        with scratch_tables() as inner:
            named = materialize(class_components(docs, classes), "jaccard-components")
        sweep([p for p in inner if "/jaccard-components-" not in p])
    return spread_join(classes, named, ["fp"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def op7(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
