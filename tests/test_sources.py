"""Connectors, state tables and what a session remembers."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from pyspark.sql import functions as F

from pricewright.sources import connectors
from pricewright.sources.store import StateTable


@pytest.fixture()
def shop():
    """A server of listings: /good answers, /flaky from the second time on, others never."""
    asked = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] = asked.get(self.path, 0) + 1
            good = self.path == "/good" or self.path == "/flaky" and asked[self.path] > 1
            self.send_response(200 if good else 500)
            self.end_headers()
            if good:
                self.wfile.write(json.dumps({"results": [{"id": 7, "name": "Milk", "price": "3.5"}, {"id": "8", "price": "n/a"}, "no row"]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def test_stores_are_read_with_one_retry(spark, shop):
    url, asked = shop
    rows = connectors.read_stores(spark, {"a": f"{url}/good", "b": f"{url}/flaky"}, retry_ms=1).collect()
    assert sorted((r.store, r.id, r.name, r.price) for r in rows if r.name) == [("a", "7", "Milk", 3.5), ("b", "7", "Milk", 3.5)]
    assert len(rows) == 4 and asked["/flaky"] == 2


def test_a_store_that_fails(spark, shop):
    url, asked = shop
    both = {"a": f"{url}/good", "c": f"{url}/never"}
    assert {r.store for r in connectors.read_stores(spark, both, best_effort=True, retry_ms=1).collect()} == {"a"}
    assert asked["/never"] == 2
    with pytest.raises(Exception, match="c: HTTP Error 500"):
        connectors.read_stores(spark, both, retry_ms=1).collect()


@pytest.fixture()
def market():
    """A server of searches by store, query and page; the store "down" says why not."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            asked.append((at["provider"], at["q"], int(at["page"])))
            down = at["provider"] == "down"
            self.send_response(503 if down else 200)
            self.end_headers()
            rows = [{"id": f"{at['page']}-{i}", "name": at["q"], "price": i} for i in range(int(at["limit"]))]
            self.wfile.write(json.dumps({"error": "asleep"} if down else {"results": rows}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/search?provider={{store}}&q={{query}}&page={{page}}&limit={{limit}}", asked
    server.shutdown()


def test_searches_are_asked_by_page(spark, market):
    template, asked = market
    rows = connectors.search_stores(spark, template, ["a", "c"], ["حليب 2 L"], pages=2, limit=3)
    got = rows.filter("price > 0").collect()
    assert sorted((r.store, r.query, r.page, r.id) for r in got) == sorted((s, "حليب 2 L", p, f"{p}-{i}") for s in "ac" for p in (0, 1) for i in (1, 2))
    assert sorted(set(asked)) == sorted((s, "حليب 2 L", p) for s in "ac" for p in (0, 1))
    assert rows.filter("store = 'a'").count() == 6 and rows.count() == 12
    named = connectors.search_stores(spark, template, ["a", "down"], ["x", "y"], limit=1, best_effort=True, retry_ms=1)
    assert sorted((r.store, r.query) for r in named.collect()) == [("a", "x"), ("a", "y")]
    with pytest.raises(Exception, match="down: asleep"):
        connectors.search_stores(spark, template, ["down"], ["x"], retry_ms=1).collect()


def test_state_table_keeps_versions(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), "k int, v string")
    assert table.read().count() == 0 and table.versions() == []
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    table.write(make([(1, "a")]))
    table.change(lambda rows: rows.unionByName(make([(2, "b")])))
    assert {tuple(r) for r in table.read().collect()} == {(1, "a"), (2, "b")}
    assert {tuple(r) for r in table.read(0).collect()} == {(1, "a")}
    table.change(lambda rows: rows.filter("k = 2"))
    assert table.versions() == [1, 2] and table.read().count() == 1


def test_two_writers_lose_no_change(spark, tmp_path):
    """A second writer commits while the first is at work: in another bucket, where both
    stand, and in the same, where the first makes its change again."""
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    table = StateTable(spark, str(tmp_path / "t"), "k int, v string", keys=("k",), buckets=4)
    table.write(make([(i, "a") for i in range(40)]))
    of = {r.k: r._bucket for r in table._bucket(table.read()).collect()}
    other = next(k for k in of if of[k] != of[0])
    same = next(k for k in of if k and of[k] == of[0])
    for k in (other, same):
        calls = []

        def step(rows, k=k, calls=calls):
            calls.append(k)
            if len(calls) == 1:
                second = StateTable(spark, table.path, table.schema, keys=("k",), buckets=4)
                second.change(lambda own: own.withColumn("v", F.when(F.col("k") == k, F.concat("v", F.lit("2"))).otherwise(F.col("v"))), make([(k, "")]))
            return rows.withColumn("v", F.when(F.col("k") == 0, F.concat("v", F.lit("1"))).otherwise(F.col("v")))

        table.change(step, make([(0, "")]))
        assert len(calls) == (1 if k == other else 2)
    found = dict(tuple(r) for r in table.read().collect())
    assert len(found) == 40 and (found[0], found[other], found[same]) == ("a11", "a2", "a2")


def test_writers_at_once(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k int, n int")
    table = StateTable(spark, str(tmp_path / "t"), "k int, n int", keys=("k",), buckets=2)
    table.write(make([(1, 0), (2, 0)]))
    add = lambda rows: rows.withColumn("n", F.col("n") + 1)
    writers = [threading.Thread(target=lambda: table.change(add, make([(1, 0), (2, 0)]), keep=100)) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert {tuple(r) for r in table.read().collect()} == {(1, 4), (2, 4)} and table.versions()[-1] == 4


def test_a_change_writes_its_buckets_only(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "k int, v string")
    table = StateTable(spark, str(tmp_path / "t"), "k int, v string", keys=("k",), buckets=8)
    table.write(make([(i, "a") for i in range(80)]))
    before = table._newest()[1]["buckets"]
    table.change(lambda rows: rows.filter("k <> 3"), make([(3, "")]))
    after = table._newest()[1]["buckets"]
    assert sum(before[b] != after.get(b) for b in before) == 1 and table.read().count() == 79
    assert table.change(lambda rows: rows, make([])) == 1  # nothing touched, nothing written


def test_the_winner_is_remembered_and_forgotten(spark, tmp_path):
    memory = connectors.StrategyMemory(StateTable(spark, str(tmp_path / "m"), connectors.StrategyMemory.SCHEMA))
    some, none = spark.range(2), spark.range(0)
    calls = []

    def strategy(name, rows):
        return lambda: calls.append(name) or rows

    assert connectors.scan_source("s", {"x": strategy("x", none), "y": strategy("y", some)}, memory)[0] == "y"
    calls.clear()
    assert connectors.scan_source("s", {"x": strategy("x", some), "y": strategy("y", some)}, memory)[0] == "y" and calls == ["y"]
    with pytest.raises(LookupError, match="x: no rows"):
        connectors.scan_source("s", {"x": strategy("x", none)}, memory)
    assert memory.winner("s") is None
    connectors.StrategyMemory(None).keep("s", "x")
    assert connectors.StrategyMemory(None).winner("s") is None


def test_session_cache_drops_all_when_full(spark):
    cache, made = connectors.SessionCache(2), []
    make = lambda n: lambda: made.append(n) or spark.range(n)
    for n in (1, 1, 2, 3):
        cache.get(n, make(n))
    assert made == [1, 2, 3] and list(cache.held) == [3]
    cache.clear()


def test_offers_and_history_of_a_query(spark):
    cache = connectors.SessionCache(5)
    assert connectors.offers_for("  ", lambda q: spark.range(3), cache) is None
    assert connectors.offers_for("a", lambda q: spark.range(0), cache) is None
    assert connectors.offers_for("b", lambda q: spark.range(300), cache).count() == 120
    rows = spark.createDataFrame([(0,), (4,)], "observations int")
    assert connectors.history_for("b", lambda q: rows, cache).count() == 1
    assert connectors.history_for("c", lambda q: rows.filter("observations = 0"), cache) is None
    cache.clear()
