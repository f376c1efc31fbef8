"""Profiles, watches of profiles, and small keyed states as tables.

Every change is a DataFrame from the table before to the table after it; ``sources.store``
writes such tables. Watches belong to one profile, and nothing here reads across profiles
but ``adopt_orphans`` and ``active_watches``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matching
from ..functions.columns import first_where, strings
from ..functions.lexicon import Lexicon
from .lists import near_size
from .merge import upsert

#: Active watches of a profile and of all, reading positions kept, alerts
#: and the least relevance of a candidate of a watch.
PER_PROFILE, OF_ALL, POSITIONS, CANDIDATE_FLOOR = 24, 90, 24, 50


def seen_profiles(profiles: DataFrame, visits: DataFrame) -> DataFrame:
    """Profiles (browser, profile_id, created, seen) after visits (browser, profile_id
    for a new one, at): one per browser, created at the first visit; a record without
    an id is replaced."""
    sound = profiles.filter("profile_id IS NOT NULL")
    first = visits.groupBy("browser").agg(F.min_by("profile_id", "at").alias("new_id"), F.min("at").alias("first"), F.max("at").alias("last"))
    rows = sound.join(first, "browser", "full")
    return rows.select(
        "browser",
        F.coalesce("profile_id", "new_id").alias("profile_id"),
        F.coalesce("created", "first").alias("created"),
        F.greatest("seen", "last").alias("seen"),
    )


def adopt_orphans(watches: DataFrame, calls: DataFrame) -> DataFrame:
    """Watches without a profile go to the profile that asked first; others stay."""
    first = calls.agg(F.min_by("profile_id", "at").alias("_first"))  # one row
    return watches.crossJoin(F.broadcast(first)).withColumn("profile_id", F.coalesce("profile_id", "_first")).drop("_first")


def active_watches(watches: DataFrame, per_profile: int = PER_PROFILE, of_all: int = OF_ALL) -> DataFrame:
    """The active watches that are checked: of each profile the first so many, of those
    the first so many of all."""
    own = Window.partitionBy("profile_id").orderBy("created", "watch_id")
    rows = watches.filter("active").withColumn("_rn", F.row_number().over(own)).filter(F.col("_rn") <= per_profile).drop("_rn")
    return rows.orderBy("created", "watch_id").limit(of_all)


def changed_watches(watches: DataFrame, changes: DataFrame) -> DataFrame:
    """Watches after creations, updates and deletions (action, and a watch's columns).
    A change of a watch takes effect only under its own profile; of several for one
    watch the last by ``at``."""
    newest = Window.partitionBy("watch_id", "profile_id").orderBy(F.col("at").desc())
    last = changes.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn", "at")
    owner = watches.select("watch_id", F.col("profile_id").alias("_owner"), F.lit(True).alias("_known"))
    allowed = last.join(owner, "watch_id", "left").filter(F.col("_known").isNull() & (F.col("action") == "create") | F.col("_owner").eqNullSafe(F.col("profile_id")))
    allowed = allowed.drop("_owner", "_known")
    gone = watches.join(allowed.filter("action = 'delete'").select("watch_id"), "watch_id", "left_anti")
    return upsert(gone, allowed.filter("action <> 'delete'").drop("action").select(*watches.columns), ["watch_id"], [F.col("profile_id")])


def alerts_of(alerts: DataFrame, watches: DataFrame, profile: str) -> DataFrame:
    """A profile's alerts: those of its watches, the newest first."""
    own = watches.filter(F.col("profile_id") == profile).select("watch_id")
    return alerts.join(own, "watch_id", "left_semi").orderBy(F.col("at").desc(), "alert_id")


def marked_seen(alerts: DataFrame, seen: DataFrame) -> DataFrame:
    """Alerts with ``seen`` true for those of the given ids."""
    ids = seen.select("alert_id").distinct().withColumn("_seen", F.lit(True))
    return alerts.join(ids, "alert_id", "left").withColumn("seen", F.coalesce("_seen", "seen", F.lit(False))).drop("_seen")


def remembered_positions(positions: DataFrame, read: DataFrame, keep: int = POSITIONS) -> DataFrame:
    """Reading positions (reader, brochure_id, page, at) after new ones: the last of
    each brochure, the newest ``keep`` of each reader."""
    rows = positions.unionByName(read)
    last = rows.groupBy("reader", "brochure_id").agg(F.max_by("page", "at").alias("page"), F.max("at").alias("at"))
    order = Window.partitionBy("reader").orderBy(F.col("at").desc(), "brochure_id")
    return last.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= keep).drop("_rn")


def source_scope(saved: Column, known: Column, sources: Column) -> Column:
    """The sources to search: the saved ones that still exist and those never seen
    before; all without a saved choice."""
    new = F.array_except(sources, F.coalesce(known, F.array().cast("array<string>")))
    return F.when(saved.isNull(), sources).otherwise(F.array_union(F.array_intersect(sources, saved), new))


#: A watch's gates, in order.
GATES = ("no-price", "relevance", "size", "name")


def watch_candidates(pairs: DataFrame, lexicon: Lexicon, floor: float = CANDIDATE_FLOOR) -> DataFrame:
    """Offers that can be a watch's product, with the reason for the others: ``pairs``
    has watch_id, q, it, ord, price, source, size, own_size. In order: no price, too
    little relevance, another size (±25%), a flyer offer that lacks a word by name."""
    q, it = F.col("q"), F.col("it")
    fails = (
        F.col("price").isNull(),
        matching.relevance(q, it, lexicon) < floor,
        ~near_size(F.col("own_size"), F.col("size")),
        (F.col("source") == "flyer") & ~matching.is_primary(q, it),
    )
    return pairs.withColumn("reason", first_where([(f, F.lit(g)) for f, g in zip(fails, GATES, strict=True)]))


def evaluated_watches(judged: DataFrame, watches: DataFrame) -> DataFrame:
    """Watches with the cheapest candidate and whether this check fires: the price is
    at or under the target and was not at the last check that had one. Without one, the
    resolution is the gate that its best candidate failed: the last that any came to. A check without
    a candidate leaves the state as it was. Needs target, below; gives price, best,
    fires, below, resolution."""
    best = judged.filter("reason IS NULL").groupBy("watch_id").agg(F.min(F.struct("price", "ord")).alias("_best"))
    far = F.array_position(strings(GATES), F.col("reason"))
    first = judged.filter("reason IS NOT NULL").groupBy("watch_id").agg(F.max_by("reason", far).alias("_why"))
    rows = watches.join(best, "watch_id", "left").join(first, "watch_id", "left")
    under = F.col("_best.price") <= F.col("target") + 1e-9
    was = F.coalesce(F.col("below"), F.lit(False))
    return rows.select(
        *[c for c in watches.columns if c != "below"],
        F.col("_best.price").alias("price"),
        F.col("_best.ord").alias("best"),
        F.coalesce(under & ~was, F.lit(False)).alias("fires"),
        F.coalesce(under, was).alias("below"),
        F.when(F.col("_best").isNotNull(), "resolved").otherwise(F.coalesce("_why", F.lit("no-candidate"))).alias("resolution"),
    )


def identity_gate(pinned: Column, evidence: Column, strict: bool) -> Column:
    """How evidence (a map) meets pinned dimensions (a map): 'match', 'conflict:<name>'
    or 'unknown:<name>'. Names in order. Unknown evidence abstains for a strict watch
    and fails a flexible one's pin; both keep the reason."""
    names = F.array_sort(F.map_keys(pinned))
    conflict = F.filter(names, lambda n: F.element_at(evidence, n).isNotNull() & (F.element_at(evidence, n) != F.element_at(pinned, n)))
    unknown = F.filter(names, lambda n: F.element_at(evidence, n).isNull())
    first = lambda a: F.get(a, F.lit(0))
    missing = F.concat(F.lit("abstain:" if strict else "unpinned:"), first(unknown))
    return F.when(F.size(conflict) > 0, F.concat(F.lit("conflict:"), first(conflict))).when(F.size(unknown) > 0, missing).otherwise("match")
