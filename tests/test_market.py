"""The comparison model's parts that the registered query does not reach, names, and rules
on single rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pricewright.functions import display, featured, matching, names, navigation
from pricewright.functions.lexicon import GROCERY
from pricewright.operators import brands, brochures, comparison, lists, overlap, pages, phrases, profiles, rails, registry, search


def pool_of(spark, rows):
    """rows: ord, source, store, name, brand, price, unit, total."""
    kinds = "ord long, source string, store string, name string, brand string, price double, unit string, total double"
    df = spark.createDataFrame(rows, kinds).withColumn("query_id", F.lit(1))
    size = F.when(F.col("unit").isNotNull(), F.struct("unit", F.col("total").alias("each"), F.lit(1).alias("pack"), "total", F.lit("measure").alias("src")))
    up = F.when(F.col("unit").isNotNull(), F.struct((F.col("price") / F.col("total") * 1000).alias("value"), F.when(F.col("unit") == "ml", "L").otherwise("kg").alias("unit")))
    none = F.lit(None).cast("string")
    return df.withColumns({"size": size, "up": up, "rel": F.lit(100.0), "stage": F.lit(5), "family": none, "form": none, "product_id": none, "brand_slug": none,
                           "seq": F.struct(F.lit(0).alias("part"), F.col("ord"))}).select(*comparison.LISTING)


MILK = [
    (1, "online", "a", "Nadec Milk", "Nadec", 9.0, "ml", 2000.0),
    (2, "online", "b", "Nadec Milk Fresh", "Nadec", 8.5, "ml", 1980.0),
    (3, "online", "c", "Almarai Milk", "Almarai", 5.0, "ml", 1000.0),
    (4, "online", "d", "Milk thing", "", 4.0, None, None),
    (5, "online", "a", "Other Milk", "Almarai", 5.0, "ml", 1000.0),
]


def test_online_listings_are_grouped_by_size_and_brand(spark):
    pool = pool_of(spark, MILK)
    heads = comparison.headlines(pool)
    head = heads.first()
    assert (head.cheapest.seq.ord, head.best.seq.ord, head.kind, head.head_seq.ord) == (4, 2, "best-value", 2)
    led = comparison._with_head(pool, heads)
    lexical = comparison.lexical_equivalents(led).first().lexical
    assert (lexical.stores, lexical.has_head) == (2, True)
    assert comparison.canonical_equivalents(led).count() == 0


def test_history_of_the_same_size_only(spark):
    pool = pool_of(spark, MILK)
    led = comparison._with_head(pool, comparison.headlines(pool))
    kinds = "query_id int, unit string, total double, low double, weeks int, observations int"
    got = comparison.size_history(led, spark.createDataFrame([(1, "ml", 2000.0, 8.0, 5, 9), (1, "ml", 1990.0, 8.5, 5, 3), (1, "ml", 1000.0, 1.0, 5, 99)], kinds)).first()
    assert (got.low, got.todays_best, got.verdict) == (8.0, 8.5, "near-low")
    assert comparison.size_history(led, spark.createDataFrame([(1, "g", 2000.0, 8.0, 5, 9)], kinds)).count() == 0


def test_shared_price_needs_the_same_product(spark):
    rows = [(1, "online", "a", "Rice", "", 5.0, "g", 1000.0), (2, "online", "b", "Basmati", "", 5.004, "g", 1020.0), (3, "online", "c", "Rice", "", 5.0, None, None), (4, "online", "d", "Basmati", "", 5.0, "g", 500.0), (5, "online", "e", "Rice", "", 5.1, "g", 1000.0)]
    pool = pool_of(spark, rows)
    heads = comparison.headlines(pool).withColumn("head_seq", F.struct(F.lit(0).alias("part"), F.lit(1).cast("long").alias("ord")))
    assert comparison.shared_stores(comparison._with_head(pool, heads)).first().shared_with == ["b", "c"]


def column(spark, rows, kinds, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kinds}")
    return [r.x for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_structured_names(spark):
    book = names.BrandBook.of([("Sadia", ["Sadia", "ساديا"]), ("Al Kabeer", ["Al Kabeer", "الكبير"])], ambiguous=["kabeer", "الكبير"], generic=["al"])
    rows = [
        ("OFFER or chicken 900g SADIAA frozen chicken breast", "صدور دجاج ساديات مجمدة", None, False, None),
        ("qwe rty zxc", "", None, False, "fresh-chicken"),
        ("Puck Cream (2 x 500g)", None, None, True, None),
        (None, None, None, False, None),
    ]
    expression = names.structured_name(F.col("n"), F.col("a"), F.col("b"), F.col("e"), F.col("c"), book, GROCERY)
    got = column(spark, rows, "n string, a string, b string, e boolean, c string", expression)
    assert (got[0].en, got[0].brand) == ("Frozen Chicken Breast", "Sadia")
    assert got[1].en == "Qwe Rty Zxc" and got[1].brand is None
    assert (got[2].en, got[2].ar) == ("Puck Cream (2 x 500g)", "")
    assert (got[3].en, got[3].ar, got[3].fallback) == ("", "", "")


def test_a_table_of_brands_reads_as_the_book_does(spark):
    rng = random.Random(2)
    known = [("Sadia", ["Sadia", "ساديا"]), ("Al Kabeer", ["Al Kabeer", "الكبير"]), ("Aabb", ["aabb", "ab ba"]), ("Second", ["sadia", "abba foods"]), ("Nestlé", ["Nestlé"])]
    options = {"ambiguous": ["kabeer", "fresh"], "generic": ["al", "foods"]}
    book = names.BrandBook.of(known, **options)
    stems = ["sadia", "ساديا", "الساديا", "kabeer", "alkabeer", "كبير", "الكبير", "aabb", "ab", "ba", "abba", "abbafoods", "nestle", "Nestlé", "foods", "fresh", "al", "zz", "", "!"]
    words = [s + rng.choice(("", "", "x", "xy", "xyz", s[-1:])) for s in stems for _ in range(6)]
    rows = spark.createDataFrame([(i, [w]) for i, w in enumerate(words)] + [(900, ["zz", "sadiaa", "nestle"]), (901, []), (902, None)], "k int, words array<string>")
    table = brands.brand_keys(spark.createDataFrame([(i, d, ns) for i, (d, ns) in enumerate(known)], "ord int, display string, names array<string>"), **options)
    got = {r.k: r.brand for r in brands.read_brands(rows, "k", "words", table, options["ambiguous"]).collect()}
    want = column(spark, [(w,) for w in words], "w string", book.match(F.col("w")))
    assert [got[i] for i in range(len(words))] == want and len(set(want)) > 4
    assert (got[900], got[901], got[902]) == ("Sadia", None, None)


def test_confidence_gate(spark):
    got = column(spark, [(0, 0), (1, 0), (2, 0), (4, 2), (5, 3)], "n int, t int", names.low_confidence(F.col("n"), F.col("t")))
    assert got == [True, False, True, True, False]


def test_folding_of_marks(spark):
    assert column(spark, [("Ülker",), ("CRÈME Brûlée",), (None,)], "v string", names.fold(F.col("v"))) == ["ulker", "creme brulee", ""]


def test_search_query_of_broken_and_missing_sources(spark):
    rows = [("{oops", '{"product": "red/onion"}'), ('{"family": ["milk"], "brand": "new co"}', None), ('["x"]', '{"variety": "x"}'), (None, None)]
    got = column(spark, rows, "a string, b string", navigation.search_query(F.col("a"), F.col("b")))
    assert got == ["Red Onion", "Milk New Co", "", ""]


def test_links_of_the_exact_store_only(spark):
    urls = ["https://www.amazon.sa/dp/1", "https://amazon.sa.evil.com/x", "http://amazon.sa/x", "https://amzn.to/a", "https://x@amazon.com/p", None]
    got = column(spark, [(u,) for u in urls], "u string", navigation.exact_link(F.col("u")))
    assert got == [urls[0], None, None, urls[3], urls[4], None]


def test_signals_fold_articles_and_drop_sweetened(spark):
    rows = [("الفراولة المحلية",), ("موز محلى",), ("Local apples",), (None,)]
    got = column(spark, rows, "t string", featured.detect_signals(F.col("t"), {"local": ["محلي", "محليه", "local"]}))
    assert got == [["local"], [], ["local"], []]


def test_variants_for_a_size(spark):
    made = F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(t).alias("total")) for u, t in (("ml", 900.0), ("ml", 1000.0), ("g", 5.0))])
    got = column(spark, [("ml", 1000.0), ("ml", 1100.0), ("ml", 2000.0), (None, None)], "u string, t double", display.variant_for(F.col("u"), F.col("t"), made))
    assert [v and v.total for v in got] == [1000.0, 900.0, None, 900.0]


def test_either_offers(spark):
    rows = [("Fresh Milk or Laban Drink",), ("Milk or Laban",), ("حليب طازج او لبن طازج",), ("Oreo Cookies Box",), (None,)]
    assert column(spark, rows, "n string", registry.is_either_offer(F.col("n"))) == [True, False, True, False, False]


def test_a_merged_id_leads_to_its_survivor(spark):
    merged = spark.createDataFrame([("b", "a")], "product_id string, merged_into string")
    ids = spark.createDataFrame([("a",), ("b",), (None,)], "product_id string")
    assert sorted(str(r.product_id) for r in registry.current_ids(ids, merged).collect()) == ["None", "a", "a"]


def test_sightings_stay_with_the_product_they_had(spark):
    kinds = "tokens array<string>, brand string, unit string, total double"
    products = spark.createDataFrame([("p1", ["milk", "nadec"], "", None, None), ("p2", ["milk", "nadec"], "", None, None)], f"product_id string, {kinds}")
    seen = spark.createDataFrame([(1, ["milk", "nadec", "x"], "", None, None), (2, ["milk", "nadec"], "", None, None), (3, [], "", None, None)], f"sighting_id int, {kinds}")
    known = spark.createDataFrame([(1, "p1"), (2, "p2")], "sighting_id int, product_id string")
    got = {r.sighting_id: (r.product_id, r.band) for r in registry.resolve_sightings(seen, products, known).collect()}
    assert got == {1: ("p1", "attach"), 2: ("p2", "attach"), 3: (None, "create")}


def test_alerts_belong_to_a_profile(spark):
    watches = spark.createDataFrame([(1, "a"), (2, "b")], "watch_id int, profile_id string")
    alerts = spark.createDataFrame([(10, 1, 5, False), (11, 2, 6, False), (12, 1, 7, None)], "alert_id int, watch_id int, at int, seen boolean")
    own = profiles.alerts_of(alerts, watches, "a")
    assert [r.alert_id for r in own.collect()] == [12, 10]
    marked = profiles.marked_seen(alerts, spark.createDataFrame([(12,), (12,)], "alert_id int"))
    assert {r.alert_id: r.seen for r in marked.collect()} == {10: False, 11: False, 12: True}


def test_points_beside_the_page_are_null(spark):
    rows = [(15.0, 30.0), (5.0, 30.0), (110.0, 70.0)]
    got = column(spark, rows, "x double, y double", brochures.point_to_fraction(F.col("x"), F.col("y"), F.lit(10.0), F.lit(20.0), F.lit(100.0), F.lit(50.0)))
    assert [g and (g.x, g.y) for g in got] == [(0.05, 0.2), None, (1.0, 1.0)]


def test_search_by_beginnings_and_insides(spark):
    items = spark.createDataFrame([(1, "Cornflakes", ""), (2, "Milkshake", ""), (3, "Water", "Milkyway"), (4, "Tea", "")], "ord int, name string, brand string")
    asked = spark.createDataFrame([(1, "flakes"), (2, "milk"), (3, "mil"), (4, "")], "query_id int, query string")
    pairs = search.candidates(matching.with_query(asked, GROCERY), matching.with_item(items, GROCERY))
    assert sorted((r.query_id, r.ord) for r in pairs.select("query_id", "ord").collect()) == [(1, 1), (2, 2), (2, 3)]


def test_a_query_word_asks_by_its_rarest_key(spark):
    """The beginning is common and the word is not: only products with the word's rarest
    letters are paired, however many have its beginning."""
    rows = [(i, "Milk water" if i % 2 else "Fresh milks", "Shaker") for i in range(600)] + [(1000 + i, f"Big milkshake {i}", "") for i in range(3)]
    items = matching.with_item(spark.createDataFrame(rows, "ord int, name string, brand string"), GROCERY)
    asked = matching.with_query(spark.createDataFrame([(1, "milkshake"), (2, "milkshakes")], "query_id int, query string"), GROCERY)
    assert sorted(tuple(r) for r in search.key_pairs(asked, items).collect()) == [(1, 1000), (1, 1001), (1, 1002)]
    assert sorted((r.query_id, r.ord) for r in search.candidates(asked, items).collect()) == [(1, 1000), (1, 1001), (1, 1002)]


@pytest.mark.parametrize("seed", range(2))
def test_candidates_equal_every_pair(spark, seed):
    """By looking at all pairs: words of one to eight letters, brands, synonyms."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["milk", "حليب", "rice", "egg", "eggs", "".join(rng.choice("ab") for _ in range(rng.randint(1, 8)))])
    text = lambda n: " ".join(word() for _ in range(rng.randint(0, n)))
    items = spark.createDataFrame([(i, text(4), text(2)) for i in range(60)], "ord int, name string, brand string")
    asked = spark.createDataFrame([(i, text(3)) for i in range(30)], "query_id int, query string")
    q, it = matching.with_query(asked, GROCERY).select("query_id", "q"), matching.with_item(items, GROCERY).select("ord", "it")
    every = q.crossJoin(it).filter(F.exists(matching.token_tiers(F.col("q"), F.col("it")), lambda t: t > 0))
    want = {(r.query_id, r.ord) for r in every.collect()}
    got = [(r.query_id, r.ord) for r in search.candidates(q, it).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_collections_without_limits_have_every_offer(spark):
    offers = spark.createDataFrame([(1, "a", "f"), (2, None, None), (2, None, None)], "ord int, aisle string, family string")
    shelves = spark.createDataFrame([("all", None, None, None), ("then", None, None, "june"), ("a", ["a", "a"], None, None), ("f", None, ["f", "f"], None)], "collection string, aisles array<string>, families array<string>, window string")
    days = spark.createDataFrame([], "window string, first date, last date")
    got = rails.in_collections(offers, shelves, days, F.lit("2024-01-01").cast("date")).collect()
    assert sorted((r.collection, r.ord) for r in got) == [("a", 1), ("all", 1), ("all", 2), ("all", 2), ("f", 1)]


def test_spots_on_missing_pages_lead_nowhere(spark):
    held = spark.createDataFrame([(1, "s", "r", "e", "images", None)], "id long, store string, region string, edition string, source_type string, source_url string")
    pages = spark.createDataFrame([(1, 2, "p2")], "brochure_id long, index int, page_id string")
    spots = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "brochure_id long, index int, offer_id long")
    offers = spark.createDataFrame([(7, "s", "r", 1, None, None, None, None), (8, "s", "r", 1, None, None, None, None)], "offer_id long, store string, region string, brochure_id long, edition string, flyer_ref string, page_ref string, page_index int")
    assert {r.offer_id: r.page for r in brochures.landings(offers, held, pages, spots).collect()} == {7: None, 8: 2}


def test_landings_keep_both_steps(spark):
    """The step that found the brochure is not that which found the page."""
    held = spark.createDataFrame([(1, "s", "r", "e", "images", None), (2, "s", "r", "f", "pdf", None)], "id long, store string, region string, edition string, source_type string, source_url string")
    pages = spark.createDataFrame([(1, 2, "p2"), (1, 3, "p3")], "brochure_id long, index int, page_id string")
    spots = spark.createDataFrame([(1, 2, 7)], "brochure_id long, index int, offer_id long")
    rows = [(7, 1, None, None, None), (8, None, "e", None, 3), (9, None, None, "p3", None), (10, 2, None, None, None), (11, None, None, None, None)]
    offers = spark.createDataFrame([(i, "s", "r", b, e, None, p, n) for i, b, e, p, n in rows], "offer_id long, store string, region string, brochure_id long, edition string, flyer_ref string, page_ref string, page_index int")
    got = {r.offer_id: (r.held, r.matched_by, r.page, r.landed_by) for r in brochures.landings(offers, held, pages, spots).collect()}
    assert got == {7: (1, 1, 2, 3), 8: (1, 2, 3, 1), 9: (1, 5, 3, 2), 10: (2, 1, None, None), 11: (None, None, None, None)}


def landed(offers, held, pages, spots):
    """Landings by looking at all rows."""
    found = []
    for o in offers:
        offer, store, region, brochure, edition, flyer, page_ref, page_index = o
        asked = [None if v is None or store is None or region is None else (store, region, str(v)) for v in (brochure, edition, flyer, flyer, page_ref)]
        ways = {}
        for b, s, r, e, kind, url in held:
            number = url.split("/")[-2] if "/offers/" in url else None
            tail = e.split("-")[-1] if "-" in e else None
            own = [[b], [e], [number], [tail], [p for k, _, p in pages if k == b]]
            for step, values in enumerate(own):
                if asked[step] and any(v is not None and (s, r, str(v)) == asked[step] for v in values):
                    ways[step + 1] = min(ways.get(step + 1, (b, kind)), (b, kind))
        step = min(ways, default=None)
        b, kind = ways[step] if step else (None, None)
        mine = [(i, p) for k, i, p in pages if k == b and i is not None and kind == "images"]
        at = [
            {i for i, _ in mine if i == page_index},
            {i for i, p in mine if p is not None and p == page_ref},
            {i for k, i, n in spots if k == b and n == offer and n is not None and i in [j for j, _ in mine]},
        ]
        by = next((n for n, some in enumerate(at) if some), None)
        found.append((*o, b, step, None if by is None else min(at[by]), None if by is None else by + 1))
    return sorted(found, key=str)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("dealt", [False, True])
def test_landings_of_odd_rows(spark, seed, dealt):
    """Offers that ask in several ways, repeated rows, missing parts, keys of other stores."""
    rng = random.Random(seed)
    some = lambda *values: rng.choice([None, *values])
    held = [(b, rng.choice("st"), rng.choice(["r", "1:r"]), rng.choice(["e", "e-2", f"e-{b}"]), rng.choice(["images", "images", "pdf"]), rng.choice(["", f"https://x.example/offers/a/{b % 5}/p"])) for b in range(12)]
    pages = [(some(*range(13)), some(1, 2, 3), some("p1", "p2", "p3")) for _ in range(40)]
    spots = [(some(*range(13)), some(1, 2, 3, 4), some(*range(20))) for _ in range(80)]
    offers = [(some(*range(20)), some("s", "t"), some("r", "1:r", "1:r"), some(*range(14)), some("e", "e-2"), some("1", "2", "3"), some("p1", "p2"), some(1, 2, 9)) for _ in range(300)]
    offers = offers + offers[:60] + [(n, None, None, None, None, None, None, None) for n in (1, 1)]
    frames = [
        spark.createDataFrame(offers, "offer_id long, store string, region string, brochure_id long, edition string, flyer_ref string, page_ref string, page_index int"),
        spark.createDataFrame(held, "id long, store string, region string, edition string, source_type string, source_url string"),
        spark.createDataFrame(pages, "brochure_id long, index int, page_id string"),
        spark.createDataFrame(spots, "brochure_id long, index int, offer_id long"),
    ]
    got = brochures.landings(*frames, dealt=dealt)
    assert got.columns == [*frames[0].columns, "held", "matched_by", "page", "landed_by"]
    assert sorted(map(tuple, got.collect()), key=str) == landed(offers, held, pages, spots)


def test_processing_words_are_trusted(spark):
    rows = [("tinned",), ("مجمده",), ("xyzzy",)]
    trusted = names.is_trusted(F.col("w"), F.array().cast("array<string>"), GROCERY)
    assert column(spark, rows, "w string", trusted) == [True, True, False]


def test_a_watch_names_the_gate_that_its_best_candidate_failed(spark):
    judged = spark.createDataFrame([(1, 1, None, "no-price"), (1, 2, 5.0, "size"), (1, 3, 5.0, "relevance"), (2, 4, None, "no-price")], "watch_id int, ord int, price double, reason string")
    watches = spark.createDataFrame([(1, 9.0, None), (2, 9.0, None), (3, 9.0, None)], "watch_id int, target double, below boolean")
    assert {r.watch_id: r.resolution for r in profiles.evaluated_watches(judged, watches).collect()} == {1: "size", 2: "no-price", 3: "no-candidate"}


@pytest.mark.parametrize("sort", ["discount", "price", "newest"])
def test_pages_equal_the_offset_form(spark, sort):
    """Pages 0 to 5 by number and behind the last row, with nulls and many equal keys."""
    rng = random.Random(1)
    rows = [(i, "s" if i % 7 else "t", rng.choice((None, 0.0, 0.1, 0.1, 0.5)), rng.choice((None, 1.0, 2.0, rng.random())), rng.choice((None, dt.date(2024, 1, rng.randint(1, 9))))) for i in range(220)]
    df = spark.createDataFrame(rows, "ord int, store string, discount double, price double, first_seen date").repartition(3)
    keys = lists.browse_keys(sort)
    whole = [r.ord for r in df.filter("store = 's'").orderBy(*pages.sort_columns(keys)).collect()]
    last = None
    for n in range(6):
        by_number = sorted(r.ord for r in lists.browse_page(df, {"store": "s"}, sort, n, 30).collect())
        behind = lists.browse_page(df, {"store": "s"}, sort, n, 30, last).collect()
        assert [r.ord for r in behind] == whole[n * 30 : n * 30 + 30]
        assert by_number == sorted(whole[n * 30 : n * 30 + 30])
        last = behind[-1].asDict()
    assert lists.browse_page(df, {"store": "s"}, sort, 99, 30).count() == 0


def test_names_of_one_word_have_no_history(spark):
    none = F.lit(None)
    size = F.struct(none.cast("string").alias("unit"), none.cast("double").alias("total"))
    got = column(spark, [("Milk", None), ("Milk", "حليب"), ("Fresh Milk", None), (None, None)], "n string, a string", rails.price_identity(F.lit("s"), F.lit("r"), F.col("n"), F.col("a"), size))
    assert [bool(g) for g in got] == [False, True, True, False]


def test_pull_in_keeps_to_the_brand(spark):
    kept = spark.createDataFrame([(1, 1, "flyer", "p", "x"), (1, 9, "online", None, None)], "query_id int, ord int, source string, product_id string, brand_slug string")
    offers = spark.createDataFrame([(1, "p", "x", 3.0), (2, "p", "x", 4.0), (3, "p", "y", 1.0), (4, "p", None, 1.0), (5, "p", "x", None)], "ord int, product_id string, brand_slug string, price double")
    assert [r.ord for r in comparison.by_identity(kept, offers).collect()] == [2]


def test_names_in_the_script_of_the_query(spark):
    rows = [("milk", "Milk", "حليب"), ("حليب", "Milk", "حليب"), ("حليب", "Milk", " "), ("milk", None, "حليب"), ("milk", "", None)]
    got = column(spark, rows, "q string, n string, a string", comparison.display_name(F.col("q"), F.col("n"), F.col("a")))
    assert got == ["Milk", "حليب", "Milk", "حليب", None]


def test_choices_are_filed_by_family_or_first_word(spark):
    asked = spark.createDataFrame([(1, "fresh milk"), (2, "nadec"), (3, "")], "query_id int, query string")
    rows = matching.with_query(asked, GROCERY).select("query_id", featured.learn_key(F.col("q")).alias("k")).orderBy("query_id").collect()
    assert [r.k for r in rows] == ["f:milk", "t:nadec", None]


def test_kinds_of_brochures(spark):
    rows = [("link", "https://x"), ("link", ""), ("pdf", None), (None, None)]
    got = column(spark, rows, "t string, u string", F.struct(brochures.is_external(F.col("t"), F.col("u")).alias("e"), brochures.is_pdf(F.col("t")).alias("p")))
    assert [(g.e, g.p) for g in got] == [(True, False), (False, False), (False, True), (False, False)]


def plain_containment(a, b):
    a, b = set(a), set(b)
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


@pytest.mark.parametrize("seed", range(2))
def test_no_pair_of_the_registry_is_lost(spark, seed):
    """Every pair that the review band needs, by brute force, for small and large sets."""
    rng = random.Random(seed)
    make = lambda: [f"t{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(rng.choice((0, 1, 2, 4, 9, 15)))]
    size = lambda: (rng.choice(("kg", None)), rng.choice((1.0, 1.02, 2.0, None)))
    seen = [(i, make(), rng.choice(("", "a", "b", None)), *size()) for i in range(60)]
    held = [(f"p{i:02}", make(), rng.choice(("", "a", "b", None)), *size()) for i in range(50)]
    s = spark.createDataFrame(seen, "sighting_id int, tokens array<string>, brand string, unit string, total double").repartition(3)
    p = spark.createDataFrame(held, "product_id string, tokens array<string>, brand string, unit string, total double")
    want = {}
    for i, a, brand, u, t in seen:
        for j, b, other, v, w in held:
            differs = None not in (u, t, v, w) and (u != v or abs(t - w) > 0.03 * max(t, w))
            if plain_containment(a, b) >= 0.45 - 1e-12 and not differs:
                want[i, j] = plain_containment(a, b) - (0.25 if brand and other and brand != other else 0)
    got = {(r.sighting_id, r.product_id): r.score for r in registry.scored_pairs(s, p).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    bound = {r.sighting_id: r.product_id for r in registry.resolve_sightings(s, p).collect()}
    for i, *_ in seen:
        best = min(((-round(c, 9), j) for (k, j), c in want.items() if k == i), default=(0, None))
        assert bound[i] == (best[1] if -best[0] >= 0.45 else None)


def test_six_of_nine_tokens_attach(spark):
    seen = spark.createDataFrame([(1, [f"a{i}" for i in range(3)] + [f"c{i}" for i in range(6)], "", None, None)], "sighting_id int, tokens array<string>, brand string, unit string, total double")
    known = spark.createDataFrame([("p", [f"b{i}" for i in range(3)] + [f"c{i}" for i in range(6)], "", None, None)], "product_id string, tokens array<string>, brand string, unit string, total double")
    assert registry.resolve_sightings(seen, known).first().band == "attach"


def test_merges_lead_to_survivors(spark):
    """By brute force in order of id; a second run over the survivors merges nothing."""
    rng = random.Random(4)
    rows = [(i, rng.sample(["a", "b", "c", "d", "e", "f", "g"], rng.randint(1, 7)), rng.choice(("", "", "x", "y")), rng.choice(("kg", None)), rng.choice((1.0, 1.02, 1.04, None))) for i in range(80)]
    stores = [(i, rng.choice(("s", "t", None))) for i in range(80) for _ in range(rng.randint(0, 2))]
    by_id = {}
    for i, s in stores:
        by_id.setdefault(i, set()).update({s} - {None})

    def double(p, q):
        known = None not in (p[3], p[4], q[3], q[4])
        near = known and p[3] == q[3] and abs(p[4] - q[4]) <= 0.03 * max(p[4], q[4])
        if plain_containment(p[1], q[1]) < 0.85 or (known and not near) or (p[2] and q[2] and p[2] != q[2]):
            return False
        return near or bool(by_id.get(p[0], set()) & by_id.get(q[0], set()))

    survivors, want = [], {}
    for p in rows:
        first = next((q[0] for q in survivors if double(q, p)), None)
        if first is None:
            survivors.append(p)
        else:
            want[p[0]] = first
    schema = "product_id int, tokens array<string>, brand string, unit string, total double"
    held = spark.createDataFrame(stores, "product_id int, store string")
    got = {r.product_id: r.merged_into for r in registry.merge_targets(spark.createDataFrame(rows, schema), held).collect()}
    assert got == want
    assert registry.merge_targets(spark.createDataFrame(survivors, schema), held).count() == 0


def test_doubles_meet_by_blocks(spark):
    """Any two that may be doubles have a block in common, odd totals too; products of one
    name that differ in brand, size and store do not meet."""
    nan, inf = float("nan"), float("inf")
    totals = (None, 0.0, -1.0, 1e-3, 1.0, 1.03, 1.031, 1.1, 500.0, 515.0, inf, -inf, nan)
    rows = [(i, b, u, t, s) for i, (b, u, t, s) in enumerate((b, u, t, s) for b in ("", "x", "none") for u in ("kg", None) for t in totals for s in (["s"], ["t", "u"], None))]
    kinds = spark.createDataFrame(rows, "node int, brand string, unit string, total double, stores array<string>")
    side = lambda n, first: kinds.select(F.struct("*").alias(n), registry._double_blocks(first).alias(f"{n}_blocks"))
    a, b = F.col("a"), F.col("b")
    same = F.coalesce((a["unit"] == b["unit"]) & registry.within(a["total"], b["total"]), F.lit(False))
    double = ~registry.brand_conflicts(a["brand"], b["brand"]) & ~registry.size_differs(a["unit"], a["total"], b["unit"], b["total"]) & (F.coalesce(F.arrays_overlap(a["stores"], b["stores"]), F.lit(False)) | same)
    met = side("a", True).crossJoin(side("b", False)).select(double.alias("double"), F.arrays_overlap("a_blocks", "b_blocks").alias("met"))
    n = {(r.double, r.met): r["count"] for r in met.groupBy("double", "met").count().collect()}
    assert n[True, True] > 0 and (True, False) not in n and n[False, False] > n[False, True]


def test_registry_pairs_do_not_grow_by_name(spark):
    """4,000 products of one name, each of a size and brand of its own: the rows that meet
    are counted from the join itself."""
    rows = spark.range(4000).select("id", F.array(F.lit("red"), F.lit("bolt")).alias("ordered"), F.col("id").cast("string").alias("brand"), F.lit("kg").alias("unit"), (F.col("id") + 1.0).alias("total"), F.array(F.lit("s")).alias("stores"))
    blocks = (registry._double_blocks(True), registry._double_blocks(False))
    assert overlap.contained_pairs(rows, rows, registry.MERGE).count() == 4000 ** 2
    assert overlap.contained_pairs(rows, rows, registry.MERGE, blocks).count() == 4000


def test_phrases_of_any_length(spark):
    words = "the very long name of a rather tall red box".split()
    rows = spark.createDataFrame([(1, words, "d"), (1, words, "d"), (2, ["red"], "d"), (3, None, "d"), (4, [], None), (5, ["box", None, "red", "box", "odd", "2x", "things"], "e")], "k int, words array<string>, department string")
    known = [(" ".join(words[:8]), "Long", None, None), ("red box", "Box", ["e"], None), ("red", "Red", None, ["tall"]), ("box", "One", None, None), ("box", "Two", None, None), (None, "Null", None, None)]
    book = spark.createDataFrame(known, "phrase string, brand string, departments array<string>, barred array<string>")
    got = sorted(((r.k, r.brand) for r in phrases.branded(rows, "words", book, "department").collect()))
    assert got == [(1, "Long"), (1, "Long"), (2, "Red"), (3, None), (4, None), (5, "Box")]
    assert [tuple(r) for r in phrases.collisions(book, "brand").collect()] == [("box", ["One", "Two"])]
    heads = phrases.head_phrases(rows.dropDuplicates(["k"]), "k", "words", book.select("phrase", F.col("brand").alias("meaning")))
    assert {r.k: (r.phrase, r.unknown, r.refused) for r in heads.collect()} == {1: (" ".join(words[:8]), 0, False), 2: ("red", 0, False), 5: ("red box", 2, True)}
    assert phrases.branded(rows, "words", book.filter("false"), "department").filter("brand IS NULL").count() == 6
