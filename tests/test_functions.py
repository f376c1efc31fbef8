from pyspark.sql import functions as F

from pricewright.functions import classify, matching, size, text
from pricewright.functions.lexicon import GROCERY, Lexicon
from pricewright.operators import gates, statistics


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


SIZES = {
    "Almarai Milk 2 L": ("ml", 1, 2000, "measure"),
    "Nadec Multi Pack 12x1l": ("ml", 12, 12000, "measure"),
    "حليب ٢ لتر": ("ml", 1, 2000, "measure"),
    "حليب كامل الدسم، 24 قطعة × 125مل": ("ml", 24, 3000, "measure"),
    "حليب × 125مل": ("ml", 1, 125, "measure"),
    "Cola 6+2 free 250 ml": ("ml", 8, 2000, "measure"),
    "عصير 9+3 × 200 مل": ("ml", 12, 2400, "measure"),
    "Promo 1+2 x 200ml": ("ml", 2, 400, "measure"),
    "Pepsi 6 cans x 330ml": ("ml", 6, 1980, "measure"),
    "200 ml x 6": ("ml", 6, 1200, "measure"),
    "Cheese 2,5 kg": ("g", 1, 2500, "measure"),
    "30 pcs eggs": ("pcs", 30, 30, "count"),
    "Indomie Noodles 6's": ("pcs", 6, 6, "count-weak"),
    "مناديل ورقية 500 منديل": (None, 1, None, None),
    "Omega 3+6+9 Fish Oil": (None, 1, None, None),
    "": (None, 1, None, None),
}


def test_sizes(spark):
    got = column(spark, list(SIZES), "string", size.parse_size)
    assert [(s.unit, s.pack, s.total, s.src) for s in got] == list(SIZES.values())


def test_sizes_fail_no_cast(spark, monkeypatch):
    """A group that is not there is not cast: each failed cast costs an exception."""
    monkeypatch.setattr(type(F.lit(1)), "try_cast", type(F.lit(1)).cast)
    got = column(spark, list(SIZES), "string", size.parse_size)
    assert [(s.unit, s.pack, s.total, s.src) for s in got] == list(SIZES.values())


def test_null_size(spark):
    assert column(spark, [None], "string", size.parse_size)[0].unit is None


def test_normalize(spark):
    given = ["  Crème FRAÎCHE, 2%! ", "أحمد ٱلدَّجَاج", "قهوة", None, "---"]
    assert column(spark, given, "string", text.normalize) == ["crème fraîche 2", "احمد الدجاج", "قهوه", "", ""]


def test_tokens_drop_articles_and_single_letters(spark):
    assert column(spark, ["والدجاج ال x 7 ab"], "string", text.tokens) == [["دجاج", "ال", "7", "ab"]]


FAMILIES = {
    "Milk Chocolate Bar 90g": "chocolate",
    "Strawberry Milk 180ml": "milk",
    "بنكهة الفراولة": None,
    "الحليب الطازج": "milk",
    "Fresh Tomatoes 1kg": "tomato",
    "tomato paste": "sauce",
    "Nadec": None,
}


def test_families(spark):
    got = column(spark, list(FAMILIES), "string", lambda c: classify.family(c, GROCERY))
    assert got == list(FAMILIES.values())


def test_forms_and_processing(spark):
    form = column(spark, ["Herfy Minced Chicken Roll", "milk", None], "string", lambda c: classify.form(c, GROCERY))
    assert form == ["mince", None, None]
    frozen = column(spark, ["والمجمدة", "Frozen peas", "peas"], "string", lambda c: classify.is_processed(c, GROCERY))
    assert frozen == [True, True, False]


def test_lexicon_from_rows():
    made = Lexicon.from_rows([("base", "milk", "milk"), ("derived", "jam", "jam"), ("processed", "", "frozen")])
    assert made.family_tiers() == {"jam": ("derived", "jam"), "milk": ("base", "milk")}
    assert made.processed == ["frozen"]


STAGES = [
    ("Fresh Milk Full Fat 1 L", "milk", 5),
    ("Almarai Fresh Milk 1 L", "milk", 4),
    ("Kellogg Cornflakes 500g", "flakes", 2),
    ("Milk Chocolate Bar 90g", "milk", 1),
    ("Almarai Fresh Milk 2L", "fresh milk", 5),
    ("Arwa Water 330ml", "Arwa Water 1.5L", 1),
    ("Arwa Water", "Arwa Water 1.5L", 5),
    ("Eggplant", "egg", 0),
    ("Milk", "", 0),
]


def matched(spark, rows):
    df = spark.createDataFrame([(i, n, "", q) for i, (n, q, *_) in enumerate(rows)], "ord int, name string, brand string, query string")
    return matching.with_query(matching.with_item(df, GROCERY), GROCERY)


def test_stages(spark):
    rows = matched(spark, STAGES).select("ord", matching.match_stage(F.col("q"), F.col("it"), GROCERY).alias("s"))
    assert [r.s for r in rows.orderBy("ord").collect()] == [s for *_, s in STAGES]


POOLS = {
    1: ("milk", ["Fresh Milk 1 L", "Almarai Milk 2 L", "Milk Chocolate", "Yogurt"]),
    2: ("nadec", ["Nadec Milk", "Nadec Milk 2L", "Nadec Yogurt", "Nadec Thing"]),
    3: ("lemon", ["Lemon 1kg", "Lemon Frozen", "Lemon drink"]),
    4: ("chicken nuggets", ["Chicken Nuggets 1kg", "Chicken Roll", "Nuggets"]),
    5: ("rice", ["Milk", "Bread"]),
}


def test_gate_ladder(spark):
    rows = [(q, p, n) for p, (q, names) in POOLS.items() for n in names]
    df = spark.createDataFrame([(p, q, n, "", i) for i, (q, p, n) in enumerate(rows)], "query_id int, query string, name string, brand string, ord int")
    judged = gates.interpret(matching.with_query(matching.with_item(df, GROCERY), GROCERY), GROCERY).cache()
    kept = {}
    for tier in gates.POLICIES:
        out = gates.gate_ladder(judged, GROCERY, tier).filter("dropped_by IS NULL")
        kept[tier] = {(r.query_id, r.name) for r in out.select("query_id", "name").collect()}
    assert kept["alert"] <= kept["summary"]
    assert {n for p, n in kept["summary"] if p == 1} == {"Fresh Milk 1 L"}
    assert {n for p, n in kept["history"] if p == 1} == {"Fresh Milk 1 L", "Almarai Milk 2 L"}
    assert {n for p, n in kept["summary"] if p == 2} == {"Nadec Milk", "Nadec Milk 2L", "Nadec Thing"}
    assert {n for p, n in kept["summary"] if p == 3} == {"Lemon 1kg"}
    assert not {n for p, n in kept["alert"] if p == 5}
    judged.unpersist()


def test_discount_and_headline(spark):
    percent = column(spark, [85.0, 55.0, 54.0, 100.0], "double", lambda c: statistics.discount_state(statistics.discount_percent(F.lit(100.0), c)))
    assert percent == ["mid", "mid", "high", "none"]
    penalty = column(spark, [6.0, 1000.0, 0.0], "double", lambda c: statistics.price_penalty(c, F.lit(3.0)))
    assert penalty == [0.0, 2.5, 0.0]


def test_best_value_drops_implausible(spark):
    rows = spark.createDataFrame([(1, 6.0, 0), (1, 5.5, 1), (1, 0.19, 2), (2, 1.0, 3)], "g int, u double, ord int")
    got = statistics.best_value(rows, ["g"], "u", ["ord"]).collect()
    assert [(r.g, r.u, r.pool, r.dropped) for r in got] == [(1, 5.5, 2, 1)]


#: Size readings that must hold, as label -> unit, total.
SIZE_CASES = (
    ("Almarai Milk 2 L", "ml", 2000.0),
    ("حليب ٢ لتر", "ml", 2000.0),
    ("حليب كامل الدسم، 24 قطعة × 125مل", "ml", 3000.0),
    ("Cola 6+2 free 250 ml", "ml", 2000.0),
    ("عصير 9+3 × 200 مل", "ml", 2400.0),
    ("Promo 1+2 x 200ml", "ml", 400.0),
    ("Pepsi 6 cans x 330ml", "ml", 1980.0),
    ("Omega 3+6+9 Fish Oil", None, None),
    ("Indomie Noodles 6's", "pcs", 6.0),
    ("", None, None),
)
#: Price basis readings: name, size field, price -> unit price, unit.
BASIS_CASES = (
    ("Milk 6 x 200 ml", None, 9.0, 7.5, "L"),
    ("Apple Royal Gala Brazil", "Per Kg", 7.99, 7.99, "kg"),
    ("Sea Bream 200-300 /Kg", None, 26.99, None, None),
    ("Kalamata Olives", "per 500 gm", 9.95, 19.9, "kg"),
    ("Indomie Noodles 6's", None, 5.0, None, None),
)


def test_size_and_price_readings(spark):
    rows = spark.createDataFrame([c[:1] for c in SIZE_CASES], "label string").withColumn("s", size.parse_size(F.col("label")))
    assert {r.label: (r.unit, r.total) for r in rows.select("label", "s.unit", "s.total").collect()} == {c[0]: c[1:] for c in SIZE_CASES}
    rows = spark.createDataFrame([c[:3] for c in BASIS_CASES], "name string, field string, price double").withColumn("s", size.parse_size(F.col("name"), F.col("field")))
    basis = size.price_basis(F.col("field"), F.col("name"), F.lit(None).cast("string"), F.col("s.unit").isNotNull())
    up = size.unit_price(F.col("price"), size.reference_quantity(F.col("s"), basis))
    got = {r.name: (r.value and round(r.value, 6), r.unit) for r in rows.withColumn("up", up).select("name", "up.value", "up.unit").collect()}
    assert got == {c[0]: c[3:] for c in BASIS_CASES}
