"""Joins that must not gather a table that grows with the input in the driver."""

import re

import pytest
from pyspark.sql import functions as F

from pricewright import plans
from pricewright.llm import jaccard
from pricewright.operators import brands, brochures, grouping, lists, merge, phrases, resolve
from pricewright.plans import tables
from pricewright.sources import store

#: Queries that read each part at some cost.
DEALT = ["offer_names", "search_queries", "adopted_unit_prices", "comparable_quantities"]


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def grown(spark, tmp_path, rows=300_000):
    """A table of whose rows the file says little: a megabyte for 300,000 rows."""
    path = str(tmp_path / "grown.parquet")
    spark.range(rows).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_copies_count_before_a_broadcast(spark, tmp_path):
    few = grown(spark, tmp_path)
    joined = resolve.spread_join(spark.range(10), few.withColumn("x", F.col("id") + 1), ["id"], "left")
    assert "BroadcastHashJoin" not in planned(joined)
    assert sorted((r.id, r.x) for r in joined.collect()) == [(i, i + 1) for i in range(10)]


def test_ingest_gathers_no_brochures(spark, tmp_path):
    held = grown(spark, tmp_path).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("edition"), F.col("id").alias("brochure"))
    offers = spark.createDataFrame([("e7", 2.0, None), ("e7", 2.0, 3.0), (None, 1.0, None), ("none", 1.0, 1.0), ("e8", 4.0, 3.0)], "edition string, price double, old_price double")
    found = merge.ingest(offers, held)
    assert "BroadcastHashJoin" not in planned(found)
    assert sorted((str(r.edition), r.brochure) for r in found.collect()) == [("None", None), ("e7", 7), ("e7", 7), ("none", None)]


def test_landings_gather_no_pages(spark, tmp_path):
    ids = grown(spark, tmp_path)
    held = ids.select("id", F.lit("s").alias("store"), F.lit("r").alias("region"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("edition"), F.lit("").alias("source_url"))
    pages = ids.select(F.col("id").alias("brochure_id"), F.lit(1).alias("index"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("page_id"))
    columns = "store string, region string, brochure_id long, edition string, flyer_ref string, page_ref string"
    offers = spark.createDataFrame([("s", "r", 5, None, None, None), ("s", "r", None, "e6", None, "p7"), ("s", "r", None, None, None, "p8"), ("t", "r", 5, None, None, None), ("s", "r", None, None, None, None)], columns)
    found = brochures.brochures_of_offers(offers, held, pages)
    assert "LeftOuter, BuildRight" not in planned(found)
    got = [(r.held, r.matched_by) for r in found.collect()]
    assert sorted(got, key=str) == sorted([(5, 1), (6, 2), (8, 5), (None, None), (None, None)], key=str)


def joins(df):
    """The kinds of join in a plan, the last one first."""
    return re.findall(r"(\w*Join)\b", planned(df))


def test_brands_gather_no_rows(spark, tmp_path):
    rows = grown(spark, tmp_path).select("id", F.array(F.lit("12"), F.when(F.col("id") % 2 == 0, "acmexy").otherwise("odd")).alias("words"))
    book = spark.createDataFrame([(1, "Acme", ["acme"])], "ord int, display string, names array<string>")
    found = brands.read_brands(rows, "id", "words", brands.brand_keys(book))
    assert joins(found) == ["SortMergeJoin", "BroadcastHashJoin"] and "BuildLeft" not in planned(found)
    assert {(r.brand, r.n) for r in found.groupBy("brand").agg(F.count("*").alias("n")).collect()} == {("Acme", 150_000), (None, 150_000)}


def test_heads_gather_no_rows(spark, tmp_path):
    rows = grown(spark, tmp_path).select("id", F.array(F.lit("red"), F.when(F.col("id") % 2 == 0, "bolt").otherwise("odd")).alias("words"))
    book = spark.createDataFrame([("red bolt", "b"), ("bolt", "c")], "phrase string, meaning string")
    found = phrases.head_phrases(rows, "id", "words", book)
    assert joins(found)[0] == "SortMergeJoin" and "BuildLeft" not in planned(found)
    assert [(r.meaning, r.n, r["count"]) for r in found.groupBy("meaning", "n").count().collect()] == [("b", 2, 150_000)]


def test_long_dictionaries_are_merged(spark, monkeypatch):
    monkeypatch.setattr(resolve, "MOST_WORDS", 2)
    many = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)] + [(99, None)], "id int, word string")
    few = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "word string, n int")
    found = resolve.dictionary_join(many, few, ["word"])
    assert joins(found) == ["SortMergeJoin"]
    assert sorted((r.id, r.n) for r in found.collect()) == [(i, i % 2 + 1) for i in range(20)]


def test_groups_gather_no_rows(spark, tmp_path):
    k = F.col("id").cast("string")
    rows = grown(spark, tmp_path, 60_000).select(F.lit("b").alias("block"), "id", F.lit(2.0).alias("total"), F.lit("f").alias("form"), k.alias("brand"), F.array(k).alias("words"))
    found = grouping.group_equivalents(rows, ["block"], "id")
    assert joins(found)[0] == "SortMergeJoin"
    assert found.filter("id = leader").count() == found.count() == 60_000


def test_jaccard_gathers_no_labels(spark, tmp_path):
    labels = grown(spark, tmp_path).select(F.col("id").alias("b"), (F.col("id") % 7).alias("root"))
    links = spark.range(10).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with jaccard.session_settings(spark, jaccard.SETTINGS):
        spread, plain = resolve.spread_join(links, labels, ["b"]), links.join(labels, "b")
        assert joins(spread) == joins(plain) == ["SortMergeJoin"]
        want = [(i, (i + 1) % 7) for i in range(10)]
        assert sorted((r.a, r.root) for r in spread.collect()) == sorted((r.a, r.root) for r in plain.collect()) == want


def test_thin_rows_are_dealt_to_all_tasks(spark, tmp_path):
    rows = grown(spark, tmp_path)  # one file of a megabyte, so one task of a scan
    found = store.dealt(rows, "id")
    sizes = [r.n for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 300_000 / 12 and sum(sizes) == 300_000
    assert store.dealt(rows.limit(10), "id").rdd.getNumPartitions() == 1


@pytest.mark.parametrize("name", DEALT)
def test_costly_readings_are_dealt(spark, data, name):
    assert "REPARTITION_BY_NUM" in planned(plans.registered()[0][name](spark, data))


def test_searches_read_dealt_items(spark, data):
    assert "REPARTITION_BY_NUM" in planned(tables.items_of(spark, data))


def test_pairs_are_dealt(spark, data):
    plan = planned(tables.candidates(spark, data))
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin [ord" in plan


@pytest.mark.parametrize("name", ["elsewhere", "watch_checks"])
def test_own_sizes_are_read_by_query(spark, data, name):
    plan = plans.registered()[0][name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and " kg" not in plan  # sizes are read before the pairs are made


def test_identities_read_once(spark, data):
    assert "badge-identities" in planned(plans.registered()[0]["identity_badges"](spark, data))


def test_similar_sorts_no_anchors(spark):
    items = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "a", "y"), (4, "a", "x"), (5, None, "x"), (6, "b", None)], "ord long, family string, form string")
    found = lists.similar(items.withColumnRenamed("ord", "id"), items, 2)
    assert not re.search(r"Window \[.*\], \[id#", planned(found))
    got = {(r.id, r.rank): r.ord for r in found.collect()}
    assert got == {(1, 1): 2, (1, 2): 4, (2, 1): 1, (2, 2): 3, (3, 1): 2, (4, 1): 1, (4, 2): 2}


def joins(plan):
    """The joins of an optimized plan."""
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    return [*([plan] if plan.nodeName() == "Join" else []), *[j for p in below for j in joins(p)]]


def steps(spark, tmp_path):
    """Rows of which most have no key in the first step, with a column nobody asks for."""
    rows = grown(spark, tmp_path, 3000).repartition(3)
    left = rows.select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("a"), (F.col("id") % 4).alias("b"), F.repeat(F.lit("x"), F.col("id").cast("int") % 5).alias("pad"))
    right = spark.createDataFrame([(10, 9, 30), (20, None, None), (20, None, 40), (30, None, None), (None, 2, 5), (None, 0, 6)], "x int, y int, r int")
    return resolve.first_match(left, right, [("a", "x"), ("b", "y")], "r", "r")


def test_null_keys_are_spread(spark, tmp_path):
    """The salt is a key of the join, not a condition beside it."""
    found = steps(spark, tmp_path)
    keys = re.findall(r"SortMergeJoin \[(.*?)\], \[", planned(found))
    assert len(keys) == 2 and all("_salt" in k for k in keys)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        none = grown(spark, tmp_path / "none", 1000).select("id", F.when(F.col("id") < 0, F.col("id")).alias("k")).repartition(3)
        joined = resolve.large_join(none, spark.range(5).select(F.col("id").alias("k"), F.lit(1).alias("one")), ["k"], "left")
        assert joined.select(F.spark_partition_id().alias("p")).distinct().count() == 4 and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_steps_shuffle_what_is_read(spark, tmp_path):
    found = steps(spark, tmp_path)
    plan = found.groupBy("matched_by").agg(F.count("*"))._jdf.queryExecution().optimizedPlan()
    assert len(joins(plan)) == 2 and not any("pad" in j.output().mkString() for j in joins(plan))
    one, two = {10: 30}, {2: 5, 0: 6}  # a null result is a match, but the search goes on
    for r in found.collect():
        first = r.a in (10, 20, 30)
        assert r.r == one.get(r.a, two.get(r.b)) and r.matched_by == (1 if first else 2 if r.b in two else None)


def shuffled(spark):
    """Rows that the session's stages have written to shuffles so far."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_landing_shuffles_an_offer_few_times(spark, data):
    """Twenty rows an offer were written when each way to a brochure or page was a join."""
    before = shuffled(spark)
    offers = len(plans.registered()[0]["offer_landing"](spark, data).collect())
    rows = sum(n for s, n in shuffled(spark).items() if s not in before)
    assert offers > 4000 and offers < rows < 6 * offers
