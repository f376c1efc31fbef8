"""Brochures: validity, order, editions, and the way from an offer to its page.

Tables: brochures (id, store, region, edition, source_type, source_url, valid_from,
valid_to, is_current, checksum, pages); pages (brochure_id, index, page_id); spots
(brochure_id, index, place, offer_id, x, y, w, h); offers (offer_id, store, region,
brochure_id, edition, flyer_ref, page_ref, page_index). ``today`` is a date column, so
results do not hang on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.listings import active_on


def is_external(source_type: Column, source_url: Column) -> Column:
    """A link to a store's own page, not a page set of ours."""
    return F.coalesce((source_type == "link") & (F.length(source_url) > 0), F.lit(False))


def is_pdf(source_type: Column) -> Column:
    return F.coalesce(source_type == "pdf", F.lit(False))


def days_left(valid_to: Column, today: Column) -> Column:
    """Whole days until the last one ends: 0 on it and after it, null if undated."""
    return F.when(valid_to.isNotNull(), F.greatest(F.datediff(valid_to, today), F.lit(0)))


def weeks_ago(week: Column, today: Column) -> Column:
    """Rounded weeks since a day; null for days to come."""
    days = F.datediff(today, week)
    return F.when(days >= 0, F.round(days / 7).cast("int"))


def flyer_ref(source_url: Column) -> Column:
    """The flyer number in a brochure's source URL, or null."""
    return F.nullif(F.regexp_extract(source_url, r"/offers/[^/]+/([0-9]+)(?:/|$)", 1), F.lit(""))


def by_store(brochures: DataFrame) -> DataFrame:
    """store, region -> their brochures as an array, by id."""
    columns = [c for c in brochures.columns if c not in ("store", "region", "id")]
    return brochures.groupBy("store", "region").agg(F.array_sort(F.collect_list(F.struct("id", *columns))).alias("brochures"))


def display_order(today: Column) -> list[Column]:
    """Active before others, page sets before links, more pages, later validity."""
    active = active_on(today, F.col("valid_from"), F.col("valid_to"), F.col("is_current"))
    external = is_external(F.col("source_type"), F.col("source_url"))
    return [
        F.coalesce(active, F.lit(False)).desc(),
        external.asc(),
        F.when(external, 0).otherwise(F.coalesce("pages", F.lit(0))).desc(),
        F.col("valid_to").desc_nulls_last(),
        F.col("id").asc(),
    ]


def ordered(brochures: DataFrame, today: Column) -> DataFrame:
    """+ place of each brochure within its store and region."""
    window = Window.partitionBy("store", "region").orderBy(*display_order(today))
    return brochures.withColumn("place", F.row_number().over(window))


def best_of_store(brochures: DataFrame, today: Column) -> DataFrame:
    """Per store and region the brochure to open: the first active one; without one the
    page set that expired last (``expired``). Stores with links only have none."""
    active = F.coalesce(active_on(today, F.col("valid_from"), F.col("valid_to"), F.col("is_current")), F.lit(False))
    rows = brochures.withColumn("expired", ~active)
    rows = rows.filter(~F.col("expired") | ~is_external(F.col("source_type"), F.col("source_url")))
    last = F.when(F.col("expired"), F.col("valid_to")).desc_nulls_last()
    window = Window.partitionBy("store", "region").orderBy("expired", last, *display_order(today))
    return rows.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def page_lists(pages: DataFrame) -> DataFrame:
    """brochure_id -> indices and page_ids, aligned and in page order."""
    listed = pages.groupBy("brochure_id").agg(F.array_sort(F.collect_list(F.struct("index", "page_id"))).alias("p"))
    return listed.select("brochure_id", F.col("p.index").alias("indices"), F.col("p.page_id").alias("page_ids"))


def _keyed(*parts: Column) -> Column:
    """A join key, null if a part is: the parts, each but the last with its length."""
    texts = [p.cast("string") for p in parts]
    return F.concat(*[c for t in texts[:-1] for c in (F.length(t).cast("string"), F.lit(":"), t)], texts[-1])


def _by_ways(offers: DataFrame, brochures: DataFrame, pages: DataFrame, other: Column) -> tuple[DataFrame, DataFrame]:
    """Offers that name no brochure in any way, and the others with ``_found``: step, id
    and ``other`` (of the brochure) of the first way that leads to a brochure, or null. All
    ways of all offers are one join, so an offer is shuffled once for each key it asks by,
    and those that ask by several once more."""
    key = lambda way, value: _keyed(F.lit(way), F.col("store"), F.col("region"), value)
    suffix = F.nullif(F.regexp_extract("edition", "-([0-9]+)$", 1), F.lit(""))
    ways = [(1, "i", F.col("id")), (2, "e", F.col("edition")), (3, "f", flyer_ref(F.col("source_url"))), (4, "f", suffix)]
    each = F.explode(F.array(*[F.struct(key(way, c).alias("key"), F.lit(step).alias("step")) for step, way, c in ways]))
    held = brochures.select("id", other.alias("other"), each.alias("w")).select("w.key", "w.step", "id", "other").filter("key IS NOT NULL")
    stores = brochures.select(F.col("id").alias("brochure_id"), "store", "region", other.alias("other"))
    paged = pages.filter("brochure_id IS NOT NULL").join(stores.hint("merge"), "brochure_id")
    held = held.union(paged.select(key("p", F.col("page_id")).alias("key"), F.lit(5), "brochure_id", "other"))
    held = held.groupBy(F.col("key").alias("_key")).agg(F.min(F.struct("step", "id", "other")).alias("_found")).hint("merge")
    columns = offers.columns
    wanted = [("i", "brochure_id"), ("e", "edition"), ("f", "flyer_ref"), ("p", "page_ref")]
    keys = [key(way, F.col(c)) for way, c in wanted]
    number = F.lit(0)
    for _, c in wanted:
        number = number + (F.col("store").isNotNull() & F.col("region").isNotNull() & F.col(c).isNotNull()).cast("int")
    one = offers.filter(number == 1).withColumn("_key", F.coalesce(*keys)).join(held, "_key", "left").select(*columns, "_found")
    several = offers.filter(number > 1).select(*columns, F.posexplode(F.array_compact(F.array(*keys))).alias("_place", "_key"))
    several = several.join(held, "_key", "left").groupBy(*columns).agg(F.min("_found").alias("_found"), F.count(F.when(F.col("_place") == 0, 1)).alias("_alike"))
    several = several.withColumn("_alike", F.explode(F.sequence(F.lit(1), F.col("_alike")))).select(*columns, "_found")
    return offers.filter(number == 0), one.unionByName(several)


def brochures_of_offers(offers: DataFrame, brochures: DataFrame, pages: DataFrame) -> DataFrame:
    """Offers with the held brochure of their store that they belong to (``held``) and
    the step that found it (``matched_by``): 1 brochure id, 2 edition, 3 flyer number
    of the source URL, 4 that at the end of the edition, 5 a page that the offer names.
    Another brochure of the same store is no match. Of equals the least id."""
    none, rows = _by_ways(offers, brochures, pages, F.lit(False))
    found = rows.select(*offers.columns, F.col("_found.id").alias("held"), F.col("_found.step").alias("matched_by"))
    return found.unionByName(none, allowMissingColumns=True)


def landings(offers: DataFrame, brochures: DataFrame, pages: DataFrame, spots: DataFrame, dealt: bool = False) -> DataFrame:
    """Offers with the page of their brochure to open on (``page``): the index they
    name if it is there, else that of the page they name, else the first page with a
    spot of theirs (spots on pages that the brochure lacks lead nowhere); null if none is
    certain, and for brochures that are no images. Offers are dealt to the tasks of their
    brochures and meet its pages and spots by windows, so that each is shuffled once, and
    not at all if ``dealt`` says that pages and spots lie by brochure already. Offers
    whose brochure is not opened are spread, those that name none stay where they are."""
    if not dealt:
        pages, spots = pages.repartition("brochure_id"), spots.repartition("brochure_id")
    none, rows = _by_ways(offers, brochures, pages, F.coalesce(F.col("source_type") != "images", F.lit(True)))
    at, page = brochures.schema["id"].dataType, pages.schema["index"].dataType
    text = lambda c: F.col(c).cast("string")
    opened = F.when(~F.col("_found.other"), F.col("_found.id"))
    any_at = F.pmod(F.xxhash64(F.spark_partition_id(), "offer_id"), F.lit((1 << 31) - 1)).cast(at)
    rows = rows.select(*offers.columns, F.col("_found.id").alias("held"), F.col("_found.step").alias("matched_by"), opened.isNotNull().alias("_opens"), F.coalesce(opened, any_at).alias("_at"))
    rows = rows.repartition("_at").withColumns({"_kind": F.lit(0), "_place": F.lit(None).cast(page), "_index": text("page_index"), "_page": text("page_ref"), "_offer": text("offer_id")})
    for kind, places, ids in ((1, pages, {"_page": text("page_id")}), (2, spots, {"_offer": text("offer_id")})):
        own = {"_at": F.col("brochure_id").cast(at), "_kind": F.lit(kind), "_place": F.col("index"), "_index": text("index"), **ids}
        places = places.filter("brochure_id IS NOT NULL")
        rows = rows.union(places.select(*[own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]))
    alike = lambda c: Window.partitionBy("_at", c)
    least = lambda kept, c: F.when(F.col(c).isNotNull(), F.min(F.when(kept, F.col("_place"))).over(alike(c)))
    rows = rows.withColumn("_there", F.max(F.col("_kind") == 1).over(alike("_index")) & F.col("_index").isNotNull())
    rows = rows.withColumn("_paged", least(F.col("_kind") == 1, "_page"))
    rows = rows.withColumn("_spot", least((F.col("_kind") == 2) & F.col("_there"), "_offer"))
    named = F.when(F.col("_there"), F.col("page_index").cast(page))
    step = F.when(F.col("_there"), 1).when(F.col("_paged").isNotNull(), 2).when(F.col("_spot").isNotNull(), 3)
    found = rows.filter("_kind = 0").select(
        *offers.columns, "held", "matched_by", F.when(F.col("_opens"), F.coalesce(named, "_paged", "_spot")).alias("page"), F.when(F.col("_opens"), step).alias("landed_by")
    )
    return found.unionByName(none, allowMissingColumns=True)


def reading_sequence(pages: DataFrame, spots: DataFrame, offers: DataFrame) -> DataFrame:
    """Every spot with an offer, in page order and within a page in the order of the
    source: brochure_id, at (from 0), page (its place among the pages), index, offer_id."""
    rank = Window.partitionBy("brochure_id").orderBy("index")
    placed = pages.select("brochure_id", "index", (F.row_number().over(rank) - 1).alias("page"))
    known = spots.join(offers.select("offer_id").distinct(), "offer_id")
    rows = known.join(placed, ["brochure_id", "index"])
    order = Window.partitionBy("brochure_id").orderBy("page", "place")
    return rows.select("brochure_id", (F.row_number().over(order) - 1).alias("at"), "page", "index", "offer_id")


def start_of_reading(sequence: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (brochure_id, page, offer_id or null) -> + start: the offer's place on that
    page, else the page's first; -1 for a page without any."""
    rows = asked.join(sequence.withColumnRenamed("offer_id", "_offer").drop("index"), ["brochure_id", "page"], "left")
    own = F.min(F.when(F.col("_offer") == F.col("offer_id"), F.col("at")))
    return rows.groupBy("brochure_id", "page", "offer_id").agg(F.coalesce(own, F.min("at"), F.lit(-1)).alias("start"))


def opening_page(indices: Column, page_ids: Column, index: Column, page_id: Column, remembered: Column) -> Column:
    """The page (from 0) to open on: the index asked for, else the page id, else the
    remembered one if it is still there, else the first."""
    at = lambda values, v: F.when(F.array_position(values, v) > 0, F.array_position(values, v) - 1)
    return F.coalesce(at(indices, index), at(page_ids, page_id), F.when(remembered < F.size(indices), remembered), F.lit(0)).cast("int")


def page_sets(pages: DataFrame) -> DataFrame:
    """brochure_id -> a digest of its page ids, and how many: alike for the same pages
    rendered again."""
    known = pages.filter("page_id IS NOT NULL").groupBy("brochure_id").agg(F.sort_array(F.collect_set(F.col("page_id").cast("string"))).alias("s"))
    return known.select("brochure_id", F.sha2(F.array_join("s", "|"), 256).alias("page_set"), F.size("s").alias("pages"))


def deduplicated(brochures: DataFrame, pages: DataFrame, today: Column) -> DataFrame:
    """One brochure for each checksum of a store and region, and for each page set:
    valid now, more pages, later validity, newer id. Brochures without a checksum or a
    page with an id are not compared by it."""
    active = F.coalesce(active_on(today, F.col("valid_from"), F.col("valid_to"), F.col("is_current")), F.lit(False))
    best = [active.desc(), F.coalesce("pages", F.lit(0)).desc(), F.col("valid_to").desc_nulls_last(), F.col("id").desc()]

    def once(rows: DataFrame, key: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("store", "region", key).orderBy(*best))
        known = rows.filter(F.col(key).isNotNull()).withColumn("_rn", rank).filter("_rn = 1").drop("_rn")
        return known.unionByName(rows.filter(F.col(key).isNull()))

    rows = once(brochures, "checksum")
    sets = page_sets(pages).select(F.col("brochure_id").alias("id"), "page_set")
    return once(rows.join(sets, "id", "left"), "page_set").drop("page_set")


def edition_names(brochures: DataFrame) -> DataFrame:
    """+ edition_name: the ISO week of the first day for a store's main brochure of
    that week (that of most pages), and the week with the id for its siblings."""
    start = F.coalesce("valid_from", "valid_to")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), start).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(start).cast("string"), 2, "0"))
    rows = brochures.withColumn("_week", week)
    rank = F.row_number().over(Window.partitionBy("store", "region", "_week").orderBy(F.coalesce("pages", F.lit(0)).desc(), "id"))
    name = F.when(rank == 1, F.col("_week")).otherwise(F.concat_ws("-", "_week", F.col("id").cast("string")))
    return rows.withColumn("edition_name", name).drop("_week")


def spot_boxes(points: DataFrame, sizes: DataFrame) -> DataFrame:
    """Corners of spots (brochure_id, index, offer_id, px, py in pixels) with page sizes
    (brochure_id, index, width, height) -> their bounding boxes as page fractions."""
    rows = points.join(sizes.filter("width > 0 AND height > 0"), ["brochure_id", "index"])
    rows = rows.withColumns({"fx": F.col("px") / F.col("width"), "fy": F.col("py") / F.col("height")})
    part = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return rows.groupBy("brochure_id", "index", "offer_id").agg(
        part(F.min("fx")).alias("x"), part(F.min("fy")).alias("y"),
        (part(F.max("fx")) - part(F.min("fx"))).alias("w"), (part(F.max("fy")) - part(F.min("fy"))).alias("h"),
    )


def snapshot(held: DataFrame, parsed: DataFrame, read: DataFrame) -> DataFrame:
    """Spots after a parse: those of ``parsed`` for the brochures read, but the held
    ones where the parse of the same bytes found none. ``read``: brochure_id, checksum,
    held_checksum of the brochures that were read."""
    found = parsed.select("brochure_id").distinct().withColumn("_some", F.lit(True))
    state = read.join(found, "brochure_id", "left")
    same = F.coalesce(F.col("checksum") == F.col("held_checksum"), F.lit(False))
    gone = state.filter(F.col("_some") | ~same).select("brochure_id")
    return held.join(gone, "brochure_id", "left_anti").unionByName(parsed)


def point_to_fraction(px: Column, py: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """A point of the screen as fractions of the page drawn there; null beside it."""
    x, y = (px - left) / width, (py - top) / height
    return F.when(x.between(0, 1) & y.between(0, 1), F.struct(x.alias("x"), y.alias("y")))
