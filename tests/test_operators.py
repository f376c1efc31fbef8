import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewright.operators import grouping, merge, overlap, resolve, statistics, watch
from pricewright.plans import queries as plans
from pricewright.plans import shelf, tables
from pricewright.sources import listings
from pricewright.sources.store import StateTable
from pricewright.streaming import watches


def test_greedy_dedupe_follows_source_order(spark, data):
    rows = spark.read.parquet(f"{data}/part.parquet").orderBy("p_partkey").collect()
    kept, want = {}, set()
    for r in rows:
        bucket, own = kept.setdefault((r.p_brand, int(r.p_retailprice // 10)), []), set(r.p_name.split())
        if not any(len(own & k) / len(own | k) >= 0.7 for k in bucket):
            bucket.append(own)
            want.add(r.p_partkey)
    assert {r.p_partkey for r in plans.dedupe_jaccard(spark, data).collect()} == want


def test_greedy_groups_compare_with_representatives(spark):
    items = [(0, 100.0), (1, 102.0), (2, 104.0), (3, 101.0), (4, 106.0)]
    for order in (items, items[::-1]):
        groups, want = [], []
        for _, total in order:
            hit = next((i for i, g in enumerate(groups) if abs(g - total) <= 0.03 * max(g, total)), None)
            want.append(len(groups) if hit is None else hit)
            if hit is None:
                groups.append(total)
        rows = [("b", i, t, None, "x", ["w"]) for i, (_, t) in enumerate(order)]
        df = spark.createDataFrame(rows, "block string, ord int, total double, form string, brand string, words array<string>")
        got = grouping.group_equivalents(df, ["block"], "ord").orderBy("ord").collect()
        first = [want.index(g) for g in want]
        assert [r.leader for r in got] == first


def test_first_wins_on_equal_prices(spark):
    rows = spark.createDataFrame([(1, 5.0, 2), (1, 5.0, 1), (1, 6.0, 0)], "g int, price double, ord int")
    assert statistics.first_wins(rows, ["g"], ["price", "ord"]).first().ord == 1
    assert statistics.first_of_group(rows, ["g"], ["price", "ord"]).first().ord == 1


def test_cart_folds_events_in_order(spark, data):
    rows = [("c", "a", i, *e) for i, e in enumerate([("add", 1), ("add", None), ("toggle", None), ("set", 150)])]
    rows += [("c", "b", 0, "add", 1), ("c", "b", 1, "remove", None)]
    df = spark.createDataFrame(rows, "cart string, item string, ord int, action string, qty int")
    assert [tuple(r) for r in merge.apply_cart_events(df).collect()] == [("c", "a", 99, True)]
    assert plans.cart_state(spark, data).count() > 0


def test_upsert_replaces_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in merge.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_band_join_equals_cross_filter(spark):
    left = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 97, 98, 100, 103, 104, 0])], "a int, x double")
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 100, 101, 0])], "b int, y double")
    keyed = lambda d: d.withColumn("k", F.lit(1))
    got = {(r.a, r.b) for r in resolve.band_join(keyed(left), keyed(right), ["k"], "x", "y", 0.03).collect()}
    want = {
        (p.a, q.b)
        for p in left.collect()
        for q in right.collect()
        if min(p.x, q.y) > 0 and abs(p.x - q.y) <= 0.03 * max(p.x, q.y)
    }
    assert got == want


def test_refresh_reasons(spark):
    now = dt.datetime(2024, 1, 3)
    rows = [(True, True, "ok", now - dt.timedelta(hours=26)), (True, True, "ok", now), (True, True, "ok", None), (True, False, "ok", None), (True, True, "provider_error", None)]
    df = spark.createDataFrame(rows, "active boolean, anchored boolean, health string, checked timestamp")
    reason = watch.refresh_reason(F.col("active"), F.col("anchored"), F.col("health"), F.col("checked"), F.lit(now))
    assert [r.x for r in df.select(reason.alias("x")).collect()] == ["stale", None, "not_yet_checked", None, "provider_failure"]


def test_usable_prices(spark):
    given = ["1.5", " 2 ", "12abc", "Infinity", "NaN", "0", "-1", "", None, "1e3"]
    df = spark.createDataFrame([(v,) for v in given], "v string")
    assert [r.x for r in df.select(listings.usable_price(F.col("v")).alias("x")).collect()] == [1.5, 2.0, *[None] * 7, 1000.0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "name": "Milk", "price": 0}\n{"id": "2", "name": "Tea"}\n{bad\n')
    rows = listings.online_listings(listings.read_listings(spark, str(tmp_path / "a.json")), "s")
    assert [(r.name, r.price) for r in rows.collect()] == [("Milk", 0.0)]
    empty = rows.filter("false")
    name, got = listings.first_non_empty({"x": lambda: empty, "y": lambda: rows}, preferred="x")
    assert name == "y" and got.count() == 1


def stream_rows(spark, df):
    query = df.writeStream.format("memory").queryName("out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table("out").collect()


def event_files(spark, frame, folder, parts):
    for i in range(parts):
        part = frame.iloc[i * len(frame) // parts : (i + 1) * len(frame) // parts]
        spark.createDataFrame(part[["event_id", "ts", "user_id", "value"]]).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).schema


def sentinels(frame):
    """An event of every user long after all others, which moves the watermark on."""
    last = frame.groupby("user_id", as_index=False).first()[["user_id"]]
    far = frame["ts"].max() + pd.Timedelta(days=30)
    return pd.concat([frame, last.assign(event_id=10**9, ts=far, value=10.0**9), last.assign(event_id=10**9 + 1, ts=far + pd.Timedelta(days=1), value=10.0**9)])


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_crossings_equal_batch(spark, data, tmp_path, seed):
    """Events of a day arrive in any order."""
    frame = spark.read.parquet(f"{data}/events.parquet").toPandas().sort_values("ts")
    rng = random.Random(seed)
    hours = (frame["ts"] - frame["ts"].min()).dt.total_seconds() / 3600
    frame = sentinels(frame.assign(key=hours + [rng.random() * 20 for _ in range(len(frame))]).sort_values("key"))
    schema = event_files(spark, frame, str(tmp_path / "in"), 6)
    stream = watches.crossing_alerts(watches.event_stream(spark, str(tmp_path / "in"), schema, 1), 20.0, "2 days")
    got = [r for r in stream_rows(spark, stream) if r.event_id < 10**9]
    assert sorted(r.event_id for r in got) == sorted(r.event_id for r in plans.watch_crossings(spark, data).collect())


def test_streamed_lows_equal_batch(spark, data, tmp_path):
    frame = sentinels(spark.read.parquet(f"{data}/events.parquet").toPandas().sort_values("ts"))
    schema = event_files(spark, frame, str(tmp_path / "in"), 4)
    stream = watches.windowed_lows(watches.event_stream(spark, str(tmp_path / "in"), schema, 1), "1 day", "1 day")
    got = {(str(r["from"].date()), r.user_id): (r.low, r.n) for r in stream_rows(spark, stream) if (r.low or 0) < 10**9}
    want = {(r.day, r.user_id): (r.low, r.n) for r in plans.event_windows(spark, data).collect()}
    assert got == want


def test_late_rows_give_points_of_their_own(spark, tmp_path):
    path = str(tmp_path / "h")
    write = watches.merge_history(path, ["k"], ["day"], "price")
    make = lambda rows: spark.createDataFrame(pd.DataFrame(rows, columns=["k", "day", "price"]))
    write(make([(1, 1.0, 5.0), (1, 2.0, 5.0), (1, 3.0, 5.0), (1, 4.0, 6.0)]), 0)
    write(make([(1, 2.5, 7.0)]), 1)
    got = watches.current_history(spark, path, ["k"], ["day"], "price").orderBy("day").collect()
    assert [(r.day, r.price) for r in got] == [(1, 5.0), (2.5, 7.0), (3, 5.0), (4, 6.0)]


def test_history_is_the_same_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, float(day), float(rng.randint(1, 3))) for k in range(5) for day in range(30)]
    want, last = [], {}
    for k, day, price in rows:
        if last.get(k) != price:
            want.append((k, day, price))
        last[k] = price
    rng.shuffle(rows)
    write = watches.merge_history(str(tmp_path / "h"), ["k"], ["day"], "price")
    make = lambda own: spark.createDataFrame(pd.DataFrame(own, columns=["k", "day", "price"]))
    for batch in (0, 1, 2, 1):  # one comes twice, and batches overlap
        write(make(rows[batch * 50 : batch * 50 + 60]), batch)
    got = watches.current_history(spark, str(tmp_path / "h"), ["k"], ["day"], "price").collect()
    assert sorted((r.k, r.day, r.price) for r in got) == want


def test_closed_observations_leave_points_only(spark, tmp_path):
    """Batches late by at most the bound give the batch twin's points from fewer rows."""
    rng = random.Random(9)
    rows = [(k, float(day), float(rng.randint(1, 2))) for k in range(4) for day in range(60)]
    want, last = [], {}
    for k, day, price in rows:
        if last.get(k) != price:
            want.append((k, day, price))
        last[k] = price
    rows.sort(key=lambda r: r[1] + rng.random() * 8)
    path = str(tmp_path / "h")
    write = watches.merge_history(path, ["k"], ["day"], "price", lateness=10.0)
    make = lambda own: spark.createDataFrame(pd.DataFrame(own, columns=["k", "day", "price"]))
    for i in range(4):
        write(make(rows[i * 60 : i * 60 + 60]), i)
    got = watches.current_history(spark, path, ["k"], ["day"], "price").collect()
    assert sorted((r.k, r.day, r.price) for r in got) == want
    held = StateTable(spark, path, keys=("k",), buckets=watches.BUCKETS).read()
    assert held.filter("NOT point AND day < 45").count() == 0 < held.filter("NOT point").count()
    write(make([(0, 3.0, 99.0)]), 9)  # far too late
    assert watches.current_history(spark, path, ["k"], ["day"], "price").filter("price = 99").isEmpty()


def test_standing_watches_on_a_stream(spark, data, tmp_path):
    """One file is one check: the first equals the batch twin; then prices fall, a watch
    is added between the batches, and a batch comes again."""
    table = watches.StateTable(spark, str(tmp_path / "w"), watches.WATCH, keys=("watch_id",), buckets=4)
    asked = [(q.query_id, q.query, "8 kg", 10000.0 if q.query_id < 4 else 1.0, q.query_id == 2, None, None) for q in tables.queries(spark).collect()]
    table.write(spark.createDataFrame(asked, watches.WATCH))
    offers = tables.items_of(spark, data).selectExpr(
        "ord", "name", "brand", "CASE WHEN ord % 9 <> 0 THEN price END AS price", "CASE WHEN kind = 'PROMO' THEN 'flyer' ELSE 'online' END AS source", "pieces || ' kg' AS size"
    )
    write = watches.standing_watches(table, str(tmp_path / "alerts"), tables.PARTS)
    parts = [offers, offers.withColumn("price", F.lit(0.5)), offers.withColumn("price", F.lit(0.4))]
    for i, rows in enumerate(parts):
        rows.coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    fired = lambda n: {r.watch_id: r.best for r in spark.read.parquet(str(tmp_path / "alerts" / f"check={n}")).collect()}

    def check(i):
        stream = spark.readStream.schema(offers.schema).parquet(str(tmp_path / f"in{i}"))
        run = stream.writeStream.foreachBatch(lambda rows, _: write(rows, i)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{i}")).start()
        run.awaitTermination(120)

    check(0)
    want = {r.watch_id: (r.p_partkey, r.below) for r in shelf.watch_checks(spark, data).collect() if r.fires}
    assert fired(0) == {w: best for w, (best, _) in want.items()} and fired(0)
    table.change(lambda rows: rows.union(spark.createDataFrame([(99, "bolt", "8 kg", 0.45, False, None, None)], watches.WATCH)), spark.createDataFrame([(99,)], "watch_id bigint"))
    check(1)
    second = fired(1)
    assert set(second) and not set(second) & set(fired(0)) and 2 not in second and 99 not in second
    check(2)
    assert set(fired(2)) == {99}
    before = table.read().count()
    write(parts[2], 2)
    assert set(fired(2)) == {99} and table.read().count() == before == 9


def test_upsert_takes_one_change_of_a_key_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "c"), (1, "b"), (None, "m"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in merge.upsert(old, new, ["k"], [F.col("v")]).collect()} == {(1, "b"), (None, "m"), (3, "d")}


def test_upper_median_is_that_of_sorted_values(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([rng.uniform(-5, 5), 3.0, rng.uniform(0, 10**6)])) for g in range(8) for _ in range(rng.randint(1, 60))] + [(9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: (r.m, r.m_of) for r in statistics.upper_medians(df, ["g"], "v", "m").collect()}
    values = {g: sorted(v for h, v in rows if h == g) for g in range(8)}
    assert got == {g: (v[len(v) // 2], len(v)) for g, v in values.items()}


def plain_groups(rows):
    """The leader of each (block, ord, total, form, brand, words), by comparing each row
    with the leaders before it."""
    led, out = {}, {}
    for block, i, total, form, brand, words in rows:
        words = set(words or ())
        for r, t, f, b, w in led.setdefault(block, []):
            size = t is not None and total is not None and max(t, total) > 0 and abs(t - total) <= 0.03 * max(t, total)
            forms = f is None or form is None or f == form
            most = max(len(w), len(words))
            same = b == brand if b and brand else most > 0 and len(w & words) >= 0.6 * most
            if size and forms and same:
                out[block, i] = r
                break
        else:
            led[block].append((i, total, form, brand, words))
            out[block, i] = i
    return out


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_the_fold(spark, seed):
    """Sizes in long chains, brands and none, forms and none, rows that are like nothing."""
    rng = random.Random(seed)
    rows = [
        (
            rng.choice(("b", "c", None)), i, rng.choice((None, 0.0, -1.0, 100.0, *[round(rng.uniform(95, 115), 1)] * 6)), rng.choice((None, None, "x", "y")),
            rng.choice(("", "", "m", "n", None)), rng.choice((None, [], *[[f"w{rng.randint(0, 4)}" for _ in range(rng.randint(1, 4))]] * 8)),
        )
        for i in range(150)
    ]
    df = spark.createDataFrame(rows, "block string, ord int, total double, form string, brand string, words array<string>").repartition(5)
    got = {(r.block, r.ord): r.leader for r in grouping.group_equivalents(df, ["block"], "ord").collect()}
    assert got == plain_groups(rows)


@pytest.mark.parametrize("seed", range(2))
def test_dedupe_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(("s", None)), i, rng.choice((None, [], *[[f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 9))]] * 9))) for i in range(160)]
    df = spark.createDataFrame(rows, "store string, ord int, words array<string>").repartition(3)
    kept, want = {}, set()
    for store, i, words in rows:
        own = set(words or ())
        if not any(own and len(own & k) / len(own | k) >= 0.7 for k in kept.setdefault(store, [])):
            kept[store].append(own)
            want.add((store, i))
    assert {(r.store, r.ord) for r in grouping.dedupe_listings(df, ["store"], "ord", "words").collect()} == want


def test_leaders_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(9)]
    hub = [(100, 101 + i) for i in range(500)] + [(101, 700), (102, 700)]
    nodes = sorted({x for e in path + hub for x in e} | {5000})
    df = spark.createDataFrame([(n, None) for n in nodes], "node int, cls string")
    got = {r.node: r.leader for r in overlap.leaders(df, spark.createDataFrame(path + hub, "a int, b int")).collect()}
    assert got == {n: n - n % 2 if n < 10 else 100 if 100 < n < 700 else n for n in nodes}


def test_first_match_keeps_columns_of_any_name(spark):
    names = ["_deal", "_found", "_step", "_k", "_r", "_s", "_salt_"]
    left = spark.createDataFrame([(1, *"abcdefg"), (2, *"hijklmn")], "a int, " + ", ".join(f"{c} string" for c in names))
    right = spark.createDataFrame([(1, 30)], "x int, r int")
    got = resolve.first_match(left, right, [("a", "x")], "r", "r").select("a", *names, "r", "matched_by").collect()
    assert sorted(map(tuple, got)) == [(1, *"abcdefg", 30, 1), (2, *"hijklmn", None, None)]


def test_first_match_goes_round_null_keys(spark):
    left = spark.createDataFrame([(i, None if i % 3 else i, i % 4) for i in range(20)], "i int, a int, b int")
    right = spark.createDataFrame([(3, 2, 30), (6, None, 60), (None, 2, 5), (6, 1, 7)], "x int, y int, r int")
    got = {r.i: (r.r, r.matched_by) for r in resolve.first_match(left, right, [("a", "x"), ("b", "y")], "r", "r").collect()}
    want = {}
    for i in range(20):
        one = {3: 30, 6: 7}.get(i) if i % 3 == 0 else None
        two = {2: 5, 1: 7}.get(i % 4)
        want[i] = (one, 1) if one else (two, 2) if two else (None, None)
    assert got == want
