"""Queries of names, labels, searches and messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display, names, navigation, text
from ..operators import brands
from .oracles import NOUN
from .tables import PARTS, dealt_products, products, table

BOOK = names.BrandBook.of([(f"Brand#{i}", [f"Brand {chr(97 + i)}{chr(97 + i)}zor"]) for i in range(26)], ambiguous=["new"], generic=["brand"])
SHOWN = names.Display(
    families={"fastener": ("Fastener", "برغي"), "gadget": ("Gadget", "جهاز"), "plate": ("Plate", "صحن"), "tool": ("Tool", "اداه")},
    forms={"cold": ("Cold", "بارد"), "hot": ("Hot", "حار")},
    processing={"frozen": ("Frozen", "مجمد", "مجمدة")},
    markers={"frozen": ("frozen", "مجمد")},
)


def _read(spark, d):
    """Part names as a machine reads them off a page: banner copy, sizes, a brand with
    an appended letter, a repeated word, and for every fifth only garbage."""
    k = F.col("p_partkey")
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    brand = F.concat(F.lit(""), F.element_at(F.array(*[F.lit(f"{chr(97 + i)}{chr(97 + i)}zorx") for i in range(26)]), (k % 26 + 1).cast("int")))
    good = F.concat_ws(" ", F.lit("OFFER 900g"), F.upper(b), F.lit("sale"), brand, a, F.upper(b), F.lit("24pcs"))
    bad = F.concat_ws(" ", F.lit("only 5% qwrt"), b, F.lit("zxcv bnmk %"))
    return dealt_products(spark, d).select("p_partkey", "p_name", F.when(k % 5 == 0, bad).otherwise(good).alias("raw"), (k % 7 == 0).alias("enriched"))


def offer_names(spark, d):
    none = F.lit(None).cast("string")
    s = names.structured_name(F.col("raw"), none, none, F.col("enriched"), none, BOOK, PARTS, SHOWN)
    return _read(spark, d).withColumn("s", s).select("p_partkey", "s.en", "s.ar", "s.brand", "s.fallback")


#: A word list's display names by family, as SQL.
SHOWN_ARABIC = "CASE " + " ".join(f"WHEN {NOUN} = '{k}' THEN '{v[1]}'" for k, v in SHOWN.families.items()) + " END"
SHOWN_FAMILY = "CASE " + " ".join(f"WHEN {NOUN} = '{k}' THEN '{v[0]}'" for k, v in SHOWN.families.items()) + " END"
OFFER_NAMES = f"""WITH p AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, chr(97 + (p_partkey % 26)::INT) || chr(97 + (p_partkey % 26)::INT) || 'zorx' AS br,
  {SHOWN_FAMILY} AS fam, {SHOWN_ARABIC} AS fam_ar FROM part),
r AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'only 5% qwrt ' || b || ' zxcv bnmk %' ELSE concat_ws(' ', 'OFFER 900g', upper(b), 'sale', br, a, upper(b), '24pcs') END AS raw,
  CASE WHEN p_partkey % 5 = 0 THEN 'qwrt ' || b || ' zxcv bnmk %' ELSE concat_ws(' ', upper(b), 'sale', br, a, upper(b), '24pcs') END AS cleaned FROM p)
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN raw WHEN p_partkey % 5 = 0 THEN fam
  ELSE upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:] END AS en,
  CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat_ws(' ', CASE WHEN p_partkey % 5 <> 0 THEN CASE a WHEN 'hot' THEN 'حار' WHEN 'cold' THEN 'بارد' END END, fam_ar) END AS ar,
  CASE WHEN p_partkey % 5 <> 0 THEN 'Brand#' || (p_partkey % 26) END AS brand, cleaned AS fallback FROM r"""


def brand_matches(spark, d):
    """The brand that a word is read as: whole, with the article, doubled, with letters
    appended, with marks, or cut short."""
    k = F.col("p_partkey")
    letter = F.element_at(F.array(*[F.lit(chr(97 + i)) for i in range(26)]), (k % 26 + 1).cast("int"))
    whole = F.concat(letter, letter, F.lit("zor"))
    word = (
        F.when(k % 6 == 0, F.concat(F.lit("Brand "), whole)).when(k % 6 == 1, F.upper(whole)).when(k % 6 == 2, F.concat(letter, letter, F.lit("zzoorr")))
        .when(k % 6 == 3, F.concat(whole, F.lit("ab"))).when(k % 6 == 4, F.replace(whole, F.lit("o"), F.lit("ö"))).otherwise(F.concat(letter, letter, F.lit("zo")))
    )
    rows = products(spark, d).select("p_partkey", word.alias("word"))
    return rows.select("p_partkey", BOOK.match(F.when(F.col("p_partkey") % 6 != 0, F.col("word"))).alias("read"), BOOK.exact(F.col("word")).alias("exact"))


BRAND_MATCHES = """SELECT p_partkey, CASE WHEN p_partkey % 6 BETWEEN 1 AND 4 THEN 'Brand#' || (p_partkey % 26) END AS read,
  CASE WHEN p_partkey % 6 IN (1, 4) THEN 'Brand#' || (p_partkey % 26) WHEN p_partkey % 6 = 0 THEN 'Brand#' || (p_partkey % 26) END AS exact FROM part"""


def present_names(spark, d):
    rows = products(spark, d).select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.initcap("p_name"), F.lit(" XL"))).alias("n"))
    return rows.select(
        "p_partkey", text.present_case(F.col("n")).alias("shown"), text.leading_words(F.col("n"), 2, 7).alias("lead"), text.history_query(F.col("n"), F.lit("misc")).alias("seed"),
        text.match_text(F.col("n")).alias("match"),
    )


PRESENT = """WITH n AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
c AS (SELECT p_partkey, a, b, upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:] AS t FROM n)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN t ELSE t || ' XL' END AS shown, left(CASE WHEN p_partkey % 2 = 0 THEN upper(a || ' ' || b) ELSE t END, 7) AS lead,
  CASE WHEN p_partkey % 2 = 0 THEN upper(a || ' ' || b) ELSE t END AS seed, a || ' ' || b || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' xl' END AS match FROM c"""


def search_queries(spark, d):
    """The search for each part from what is stored of it: a snapshot that names no
    product for every third, a specification, a broken text for every fourth."""
    k = F.col("p_partkey")
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    snapshot = F.when(k % 4 == 0, "{broken").when(k % 3 == 0, F.to_json(F.struct(a.alias("variety")))).otherwise(
        F.to_json(F.struct(F.concat(b, F.lit("_fresh-uht")).alias("product"), F.array(a).alias("processing"), F.col("p_brand").alias("brand")))
    )
    spec = F.to_json(F.struct(b.alias("family"), F.upper(b).alias("category"), F.lit("premium cut").alias("cut")))
    return dealt_products(spark, d).select("p_partkey", navigation.search_query(snapshot, spec).alias("query"))


SEARCH_QUERIES = """WITH n AS (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
c AS (SELECT *, CASE WHEN a <> 'new' THEN upper(a[1]) || a[2:] END AS ca, upper(b[1]) || b[2:] AS cb FROM n)
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN cb || ' Cut' WHEN p_partkey % 3 = 0 THEN concat_ws(' ', ca, cb, 'Cut')
  ELSE concat_ws(' ', ca, cb, 'UHT', cb, 'Cut', p_brand) END AS query FROM c"""


def notification_targets(spark, d):
    """Where each page's notification leads; the pages' own links stand for observed
    ones, and for every third for one of the store whose links are kept."""
    k = F.col("page_id")
    link = F.when(k % 3 == 0, F.concat(F.lit("https://www.amazon.sa/dp/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("http://amazon.sa/"), k.cast("string"))).otherwise(F.col("url"))
    none = F.lit(None).cast("string")
    target = navigation.notification_target(
        F.when(k % 2 == 0, "Amazon").otherwise("panda"), link, F.when(k % 5 == 0, F.concat(F.lit("pr_"), k.cast("string"))), none,
        F.concat(F.lit(" Name "), k.cast("string")), none, F.when(k % 7 != 0, F.concat(F.lit("q & "), k.cast("string"))),
    )
    return table(spark, d, "pages").select("page_id", target.alias("t")).select("page_id", "t.kind", "t.href", "t.query")


NOTIFICATIONS = """WITH q AS (SELECT page_id, page_id % 2 = 0 AND page_id % 3 = 0 AS kept, CASE WHEN page_id % 5 = 0 OR page_id % 7 = 0 THEN 'Name ' || page_id ELSE 'q & ' || page_id END AS query FROM pages)
SELECT page_id, CASE WHEN kept THEN 'external' ELSE 'search' END AS kind, CASE WHEN kept THEN 'https://www.amazon.sa/dp/' || page_id
  ELSE '#/search?q=' || replace(replace(query, '&', '%26'), ' ', '+') || CASE WHEN page_id % 5 = 0 THEN '&product=pr_' || page_id ELSE '' END END AS href, CASE WHEN NOT kept THEN query END AS query FROM q"""


def watch_kinds(spark, d):
    k = F.col("p_partkey")
    w = navigation.watch_of(F.when(k % 4 == 0, "amazon").otherwise("noon"), k, F.concat("p_name", F.lit(" one two three four five")), F.when(k % 3 == 0, F.lit("2 L")).otherwise(""))
    key = navigation.cart_key(F.when(k % 2 == 0, "online").otherwise("flyer"), F.lit("s1"), k)
    return products(spark, d).select(w.alias("w"), key.alias("cart_key"), "p_partkey").select("p_partkey", "w.kind", "w.product_id", "w.query", "w.size_text", "cart_key")


WATCH_KINDS = """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'product' ELSE 'grocery' END AS kind, p_partkey::VARCHAR AS product_id, p_name || ' one two three four' AS query,
  CASE WHEN p_partkey % 4 <> 0 THEN p_name || ' one two three four five' || CASE WHEN p_partkey % 3 = 0 THEN ' 2 L' ELSE '' END END AS size_text,
  CASE WHEN p_partkey % 2 = 0 THEN 's1:' || p_partkey ELSE p_partkey::VARCHAR END AS cart_key FROM part"""

MESSAGES = {
    "en": {"days.one": "{n} day", "days.other": "{n} days", "size.big": "big", "size.small": "small"},
    "ar": {"days.one": "يوم", "size.big": "كبير"},
}


def labels(spark, d):
    """Price labels, states, hues and messages of every part."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    language = F.when(k % 2 == 0, "ar").otherwise("en")
    value = F.when(k % 3 == 0, price).when(k % 3 == 1, price / 100).otherwise(price / 20000)
    return products(spark, d).select(
        "p_partkey",
        display.unit_price_label(F.floor(value * 64) / 64, F.lit("kg")).alias("unit_label"),
        display.each_price_label(F.when(k % 10 != 9, F.floor(value * 512) / 512)).alias("each_label"),
        F.round(display.discount_share(F.when(k % 4 != 0, price * 1.25), price), 9).alias("cut"),
        display.enrichment_state(k % 5 != 0, F.when(k % 2 == 0, "x-Medium-1").otherwise("large")).alias("state"),
        display.family_category(F.when(k % 3 == 0, "tomato").when(k % 3 == 1, "milk"), ["tomato"], {"milk": "dairy"}).alias("category"),
        display.match_badge(k % 2 == 0, (k % 4).cast("int") - 1, (k % 6).cast("int")).alias("badge"),
        display.message(MESSAGES, F.when(k % 3 == 0, "size.big").when(k % 3 == 1, "size.small").otherwise("none"), language).alias("message"),
        display.counted_message(MESSAGES, F.lit("days"), (k % 3).cast("int"), language).alias("days"),
        display.hue(F.col("p_name")).cast("int").alias("hue"),
    )


LABELS = """WITH v AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice WHEN p_partkey % 3 = 1 THEN p_retailprice / 100 ELSE p_retailprice / 20000 END AS v FROM part),
u AS (SELECT *, floor(v * 64) / 64 AS uv, floor(v * 512) / 512 AS ev FROM v),
h AS (SELECT p_partkey, list_reduce(list_transform(list_prepend(0, list_transform(string_split(p_name, ''), lambda c: ascii(c))), lambda c: c::BIGINT), lambda a, c: (a * 31 + c) % 360) AS hue FROM part)
SELECT p_partkey, CASE WHEN uv >= 100 THEN floor(uv + 0.5)::BIGINT::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.2f', uv + 1e-9::DOUBLE), '([.][0-9]*?)0+$', '\\1'), '[.]$', '') END || ' SAR/kg' AS unit_label,
  CASE WHEN p_partkey % 10 = 9 OR ev <= 0 THEN '' ELSE CASE WHEN ev >= 100 THEN floor(ev + 0.5)::BIGINT::VARCHAR
    ELSE regexp_replace(regexp_replace(CASE WHEN ev < 0.1 THEN printf('%.3f', ev + 1e-9::DOUBLE) ELSE printf('%.2f', ev + 1e-9::DOUBLE) END, '([.][0-9]*?)0+$', '\\1'), '[.]$', '') END || ' SAR each' END AS each_label,
  CASE WHEN p_partkey % 4 <> 0 THEN 0.2::DOUBLE ELSE 0 END AS cut,
  CASE WHEN p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 2 = 0 THEN 'medium' ELSE 'enriched' END AS state,
  CASE p_partkey % 3 WHEN 0 THEN 'produce' WHEN 1 THEN 'dairy' ELSE 'general' END AS category,
  CASE WHEN p_partkey % 2 = 0 AND p_partkey % 4 - 1 <= 0 THEN 'related' WHEN p_partkey % 6 >= 4 THEN 'best' WHEN p_partkey % 6 = 3 THEN 'close' ELSE 'related' END AS badge,
  CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'كبير' ELSE 'big' END WHEN 1 THEN 'small' ELSE 'none' END AS message,
  CASE WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'يوم' ELSE '1 day' END ELSE (p_partkey % 3) || ' days' END AS days, CAST(hue AS INT) AS hue
FROM u JOIN h USING (p_partkey)"""


def insight_lines(spark, d):
    """The lines of every part's sheet, against the history variant of its size."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    low = lambda share: (price * share).alias("low")
    made = F.array(
        F.struct(F.lit("g").alias("unit"), (F.col("p_size") * 1.5).alias("total"), low(0.5)),
        F.struct(F.lit("g").alias("unit"), (F.col("p_size") * 1.2).alias("total"), low(0.9)),
        F.struct(F.lit("ml").alias("unit"), F.col("p_size").cast("double").alias("total"), low(1.0)),
    )
    unit = F.when(k % 4 == 0, "g").when(k % 4 == 1, "ml").when(k % 4 == 2, "pcs")
    rows = products(spark, d).withColumn("v", display.variant_for(unit, F.when(unit.isNotNull(), F.col("p_size").cast("double")), made))
    lines = display.insights(price, F.when(k % 3 == 0, price * 1.5), F.col("v.low"), F.when(k % 2 == 0, "down"), (k % 5).cast("int"))
    marks = display.badges(F.when(k % 4 == 0, F.lit(9)), (k % 3 * 10).cast("int"), k % 2 == 0, k % 5 == 0, (k % 7).cast("int"))
    return rows.select("p_partkey", F.round("v.low", 6).alias("low"), F.array_join(lines, ",").alias("lines"), F.array_join(marks, ",").alias("badges"))


INSIGHTS = """WITH v AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE END AS share FROM part),
l AS (SELECT *, CASE WHEN share = 1 THEN 'lowest' WHEN share = 0.9 THEN 'above-low:11' WHEN share = 0.5 THEN 'above-low:100' END AS a,
  CASE WHEN share < 1 AND p_partkey % 2 = 0 THEN 'falling' END AS b, CASE p_partkey % 5 WHEN 0 THEN 'ends-today' WHEN 1 THEN 'ends-tomorrow' END AS c, CASE WHEN p_partkey % 3 = 0 THEN 'cut:33' END AS e,
  CASE WHEN p_partkey % 4 = 0 THEN 'lowest:9' END AS m, CASE WHEN p_partkey % 3 > 0 THEN 'drop:' || (p_partkey % 3 * 10) END AS n, CASE WHEN p_partkey % 2 = 0 THEN 'rare' END AS o,
  CASE WHEN p_partkey % 5 = 0 THEN 'multi-buy' END AS q, CASE p_partkey % 7 WHEN 0 THEN 'ends-today' WHEN 1 THEN 'ends-tomorrow' END AS r FROM v)
SELECT p_partkey, round(p_retailprice * share, 6) AS low, array_to_string(list_filter([a, b, c, e], lambda x: x IS NOT NULL)[1:3], ',') AS lines,
  array_to_string(list_filter([m, n, o, q, r], lambda x: x IS NOT NULL)[1:2], ',') AS badges FROM l"""

def read_brands(spark, d):
    """Brands read from words with a dictionary drawn from the parts: the words joined,
    with two letters appended, with the last doubled; the noun alone is none."""
    parts = products(spark, d)
    a, b, k = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), F.col("p_partkey")
    named = parts.groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    book = named.select("ord", F.concat(F.lit("R "), "p_name").alias("display"), F.array(F.concat(b, F.lit("or")), F.concat(F.lit("al "), a, b)).alias("names"))
    joined = F.concat(a, b)
    word = F.when(k % 4 == 0, joined).when(k % 4 == 1, F.concat(joined, F.lit("xy"))).when(k % 4 == 2, F.concat(F.upper(joined), F.substring(joined, -1, 1))).otherwise(b)
    rows = parts.select("p_partkey", F.array(F.lit("12"), word, F.lit("odd")).alias("words"))
    return brands.read_brands(rows, "p_partkey", "words", brands.brand_keys(book, generic=["al"])).select("p_partkey", "brand")


READ_BRANDS = "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN 'R ' || p_name END AS brand FROM part"

QUERIES = {
    "offer_names": offer_names,
    "read_brands": read_brands,
    "brand_matches": brand_matches,
    "present_names": present_names,
    "search_queries": search_queries,
    "notification_targets": notification_targets,
    "watch_kinds": watch_kinds,
    "labels": labels,
    "insight_lines": insight_lines,
}
SQL = {
    "offer_names": OFFER_NAMES,
    "read_brands": READ_BRANDS,
    "brand_matches": BRAND_MATCHES,
    "present_names": PRESENT,
    "search_queries": SEARCH_QUERIES,
    "notification_targets": NOTIFICATIONS,
    "watch_kinds": WATCH_KINDS,
    "labels": LABELS,
    "insight_lines": INSIGHTS,
}
