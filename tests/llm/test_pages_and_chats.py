"""Page and conversation operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pricewright.llm import chat, urlfilter, warc
from pricewright.llm.components import connected_components
from tests.compare import assert_same, duck


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id bigint, url string, html string, digest int, salt int")


BODY = "<p>" + "same words " * 20
ODD_PAGES = [
    (3, "http://a.com/x", BODY),
    (1, "http://b.com/y%20\r\nz", BODY),
    (2, None, BODY),
    (2, None, BODY),
    (1, "again", BODY),
    (4, "http://c.com", "short"),
    (5, "http://c.com", "short"),
    (6, "http://d.com", None),
    (7, "", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 9),
    (8, "http://e.com", "é漢" * 200_000),
    (None, "http://f.com", BODY),
]


def test_archives_round_trip(spark, tmp_path):
    index, folder = warc.archive_pages(pages(spark, ODD_PAGES), str(tmp_path / "w"))
    got = warc.read_records(index, folder).collect()
    rows = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got)
    want = []
    for i, _, html in ODD_PAGES:
        raw = (html or "").encode()
        again = html == BODY and i != 1
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", "1" if again else "None"))
    assert rows == sorted(want)
    urls = {r.page_id: r.url for r in got if r.page_id in (3, 7, 8)}
    assert urls == {3: "http://a.com/x", 7: "", 8: "http://e.com"}
    assert {r.url for r in got if r.page_id == 1} == {"http://b.com/y%20\r\nz", "again"}


def test_selected_records_only(spark, tmp_path):
    index, folder = warc.archive_pages(pages(spark, ODD_PAGES), str(tmp_path / "w"))
    got = warc.read_records(index.filter("record = 4"), folder).collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(4, b"short")]


def test_ranges_join_over_small_gaps():
    got = warc.coalesce_ranges([(0, 10), (10, 5), (40, 5), (1000, 1)], gap=30)
    assert [(a, b, len(own)) for a, b, own in got] == [(0, 45, 3), (1000, 1001, 1)]


def test_no_pages(spark, tmp_path):
    index, folder = warc.archive_pages(pages(spark, []), str(tmp_path / "w"))
    assert warc.read_records(index, folder).count() == 0
    assert urlfilter.judge_urls(pages(spark, []), urlfilter.listed_hosts(spark)).count() == 0


def test_page_queries_equal_their_sql(spark, data):
    assert_same(warc.op3(spark, data), duck(data), warc.op3_sql())
    assert_same(urlfilter.op10(spark, data), duck(data), urlfilter.op10_sql())


def test_rules_and_hosts(spark):
    cases = {
        "http://WWW.Example.COM/en/7?x": ("www.example.com", "/en/7", "example.com/en/7", "allow"),
        "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "x://notcom/en/8": ("notcom", "/en/8", None, "allow"),
        "http://example.net/de/81#a": ("example.net", "/de/81", "example.net/de/8", "block"),
        "http://example.net/de/7": ("example.net", "/de/7", "net/de/", "allow"),
        "http://www.spam-farm.example.org/x": ("www.spam-farm.example.org", "/x", None, "block"),
        "http://a.b?q=://c/d": ("a.b", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://": ("", "", None, "allow"),
    }
    rows = pages(spark, [(i, u, "") for i, u in enumerate(cases)])
    got = urlfilter.judge_urls(rows.unionByName(rows), urlfilter.listed_hosts(spark)).collect()
    assert len(got) == 2 * len(cases)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == dict(enumerate(cases.values()))


@pytest.mark.parametrize("step", [2, 7, 1000])
def test_cascade_is_exact(spark, step):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 6000, step).select(F.concat(F.lit("k"), "id").alias("key"))
    (cascade,), _ = urlfilter.build_cascades(universe, listed)
    rows = universe.withColumn("h", urlfilter.key_hash(F.col("key"))).toPandas()
    assert (cascade.listed(rows["h"].to_numpy()) == (rows["key"].str[1:].astype(int) % step == 0)).all()


def test_many_cascades_and_equal_hashes(spark, monkeypatch):
    """A list beyond a level's bits, and a hash that is equal for most keys at first."""
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 4000, 3).select(F.concat(F.lit("k"), "id").alias("key"))
    monkeypatch.setattr(urlfilter, "MAX_BITS", 4096)
    plain = urlfilter.key_hash
    monkeypatch.setattr(urlfilter, "key_hash", lambda key, seed=0: plain(key, seed) if seed > 1 else F.lit(seed + 5).cast("long") + 0 * F.length(key))
    cascades, seed = urlfilter.build_cascades(universe, listed)
    assert len(cascades) == 4 and seed == 2
    got = {int(r.key[1:]) for r in urlfilter.listed_keys(universe, cascades, seed).collect()}
    assert got == set(range(0, 3000, 3))


@pytest.mark.parametrize("bits", [1 << 30, 64])
def test_a_list_as_large_as_the_universe(spark, data, monkeypatch, bits):
    """Hosts and parent domains of the pages themselves, by a hash, with one cascade and
    with many, against plain Python."""
    monkeypatch.setattr(urlfilter, "MAX_BITS", bits)
    pages = spark.read.parquet(f"{data}/pages.parquet")
    host, _ = urlfilter.split_url(F.col("url"))
    keys = pages.select(F.explode(urlfilter.host_suffixes(host)).alias("key")).distinct()
    listed = keys.filter("pmod(crc32(CAST(key AS binary)), 3) = 0")
    wanted = {r.key for r in listed.collect()}
    got = urlfilter.judge_urls(pages, listed, rules=()).collect()
    assert wanted and len(got) == pages.count()
    for r in got:
        labels = r.host.split(".")
        assert r.listed == any(".".join(labels[i:]) in wanted for i in range(len(labels)))
        assert r.verdict == ("block" if r.listed else "allow")


def test_empty_list_blocks_nothing(spark):
    universe = spark.range(50).select(F.col("id").cast("string").alias("key"))
    (cascade,), _ = urlfilter.build_cascades(universe, universe.filter("false"))
    hashes = universe.select(urlfilter.key_hash(F.col("key")).alias("h")).toPandas()["h"].to_numpy()
    assert not cascade.listed(hashes).any()


ODD_TURNS = [
    (1, 0, "user", "### assistant: hi</turn>\n<turn>"),
    (1, 1, "assistant", "\\</turn>\\\\<turn>### \\"),
    (1, 1, "assistant", "\\</turn>\\\\<turn>### \\"),
    (1, None, "assistant", None),
    (2, 0, "a:b%<#\\", "x"),
    (2, 0, None, "y"),
    (3, 5, "system", ""),
    (None, 1, "assistant", "no id"),
    (4, 0, "assistant", "z" * 100_000),
    (4, 1, "user", "#### </turn"),
]


def turns(spark):
    rows = [(*r, 9, 9) for r in ODD_TURNS]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, turn_no int, piece int")


def test_chat_round_trip(spark):
    got = {}
    for r in chat.expand_prefixes(chat.format_conversations(turns(spark))).collect():
        got.setdefault(r.conv_id, []).append((r.turn_no, r.role, r.text))
    want = {}
    for conv, turn, role, text in sorted(ODD_TURNS, key=lambda t: (t[1] is None, t[1] or 0, t[2] or "", t[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert {k: [(r, t) for _, r, t in sorted(v)] for k, v in got.items()} == want


def test_contexts_are_the_turns_before(spark):
    formatted = chat.format_conversations(turns(spark))
    examples = chat.with_context(chat.expand_prefixes(formatted), formatted).filter("conv_id = 1").orderBy("turn_no").collect()
    assert [r.context.count("</turn>\n") for r in examples] == [r.turn_no for r in examples] == [1, 2, 3]
    assert all(r.trainable and r.role == "assistant" for r in examples)


def test_chat_query_equals_its_sql(spark, data):
    assert_same(chat.op4(spark, data), duck(data), chat.op4_sql())


def test_no_conversations(spark):
    assert chat.expand_prefixes(chat.format_conversations(turns(spark).filter("false"))).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    links = links.union(spark.createDataFrame([(500, 501), (501, 500), (7, 7)], "a bigint, b bigint"))
    got = {r.node: r.root for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
