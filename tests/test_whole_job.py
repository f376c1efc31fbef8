"""Queries against brute force."""

import datetime as dt
import random

from pricewright.operators import resolve
from pricewright.plans import queries as plans
from tests.compare import duck


def hits(points, boxes, least=0.04):
    found = {}
    for pid, page, px, py in points:
        best = None
        for on, box, x, y, w, h in boxes:
            ww, hh = max(w, least), max(h, least)
            x0, y0 = x + w / 2 - ww / 2, y + h / 2 - hh / 2
            if on == page and x0 <= px <= x0 + ww and y0 <= py <= y0 + hh:
                direct = x <= px <= x + w and y <= py <= y + h
                key = (not direct, w * h, box)
                best = key if best is None or key < best else best
        if best:
            found[pid] = (page, best[2], not best[0])
    return found


def test_spatial_hit_uses_all_products(spark, tmp_path):
    keys = [1, 2, 3, 399, 400, 401, *range(500, 900), 1260, 1261, 1999, 3000]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    events = [(i, i * 7 % 13) for i in range(700)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    points = [(e, u % 4, (e * 37 % 1000) / 1000, (e * 91 % 997) / 997) for e, u in events]
    boxes = [(k % 4, k, (k * 53 % 90) / 100, (k * 29 % 90) / 100, ((k % 7) + 1) / 100, ((k % 5) + 1) / 100) for k in keys]
    want = hits(points, boxes)
    got = {r.id: (r.page, r.box_id, r.direct) for r in plans.spatial_hit(spark, str(tmp_path)).collect()}
    assert got == want
    assert any(box >= 400 for _, box, _ in want.values())


def test_equal_boxes_give_the_first(spark):
    points = [(1, 0, 0.5, 0.5), (2, 1, 0.5, 0.5)]
    boxes = [(0, 9, 0.4, 0.4, 0.2, 0.2), (0, 3, 0.4, 0.4, 0.2, 0.2), (0, 5, 0.49, 0.49, 0.3, 0.3), (1, 4, 0.4, 0.4, 0.2, 0.2)]
    p = spark.createDataFrame(points, "id int, page int, px double, py double")
    b = spark.createDataFrame(boxes, "page int, box_id int, x double, y double, w double, h double")
    got = {r.id: (r.page, r.box_id, r.direct) for r in resolve.boxes_hit(p, b, "page", 0.04).collect()}
    assert got == hits(points, boxes) == {1: (0, 3, True), 2: (1, 4, True)}


def test_crowded_pages(spark):
    """Boxes of all sizes, many on one spot, against every pair."""
    rng = random.Random(8)
    points = [(i, rng.randint(0, 1), rng.random() ** 2, rng.random()) for i in range(300)]
    boxes = [(rng.randint(0, 1), i, rng.random() ** 2, rng.random(), rng.choice((0.0, 0.001, 0.01, 0.2, 1.5)) * rng.random(), 0.05 * rng.random()) for i in range(2500)]
    p = spark.createDataFrame(points, "id int, page int, px double, py double").repartition(3)
    b = spark.createDataFrame(boxes, "page int, box_id int, x double, y double, w double, h double")
    got = {r.id: (r.page, r.box_id, r.direct) for r in resolve.boxes_hit(p, b, "page", 0.004).collect()}
    assert got == hits(points, boxes, 0.004)


def write_listings(spark, path, rows):
    """rows: order, line, product, store, quantity, price before discount, discount, day."""
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp"
    spark.createDataFrame(rows, columns).write.parquet(f"{path}/lineitem.parquet")


def test_best_price_is_shared_at_equal_prices_only(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    prices = {
        1: [(1, 40000.0), (2, 40000.004), (3, 40000.006), (4, 40350.0), (2, 40000.0), (1, 40000.0)],
        2: [(7, 9.0), (8, 9.05), (9, 9.09)],
        3: [(5, 3.0), (6, 3.0), (7, 3.0)],
    }
    rows = [(i, 1, p, s, 1.0, v, 0.0, day) for p, offers in prices.items() for i, (s, v) in enumerate(offers)]
    write_listings(spark, tmp_path, rows)
    got = {r.l_partkey: r.shared_with for r in plans.shared_best_price(spark, str(tmp_path)).collect()}
    want = {}
    for product, offers in prices.items():
        store, best = min(offers, key=lambda o: o[1])
        others = {s for s, v in offers if s != store and abs(v - best) <= 0.005}
        if others:
            want[product] = len(others)
    assert got == want == {1: 1, 3: 2}


def test_shared_best_price_equals_brute_force_on_tables(spark, data):
    """As in the SQL of this query, but for the tolerance."""
    want = duck(data).sql("""
WITH l AS (SELECT *, l_extendedprice * (1 - l_discount) AS price FROM lineitem),
h AS (SELECT l_partkey, price AS best, l_suppkey AS head FROM l QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY price, l_orderkey, l_linenumber, l_suppkey) = 1)
SELECT l_partkey, count(DISTINCT l_suppkey) AS shared_with FROM l JOIN h USING (l_partkey)
WHERE l_suppkey <> head AND abs(price - best) <= 0.005::DOUBLE GROUP BY l_partkey""").fetchall()
    assert sorted(tuple(r) for r in plans.shared_best_price(spark, data).collect()) == sorted(want)


MULTI = {"cola 1+1", "cola 2 + 1 free", "buy two get one free", "عصير مجاناً"}


def deal_points(offers, multi):
    """order, line and store -> score of one product's offers (day, order, line, store, unit, drop)."""
    out, seen = {}, []
    for day, order, line, store, unit, drop in sorted(offers):
        week = day - dt.timedelta(days=day.weekday())
        weeks = {week, *(d - dt.timedelta(days=d.weekday()) for d, _ in seen)}
        known = (week - min(weeks)).days // 7 + 1
        low = min((u for _, u in seen), default=None)
        score = 50 if low is not None and unit <= low and len(weeks) >= 4 else 0
        score += 30 if drop >= 40 - 1e-9 else 15 if drop >= 25 - 1e-9 else 0
        score += 20 if known >= 8 and len(weeks) <= known / 4 else 0
        score += 10 if multi else 0
        if low is not None and abs(unit - low) <= 1e-9:
            last = max(d for d, u in seen if u <= low + 1e-9)
            score += 15 if (day - last).days >= 28 else 0
        out[order, line, store] = score
        seen.append((day, unit))
    return out


def all_points(lines, names):
    products = {}
    for order, line, part, store, quantity, listed, discount, ts in lines:
        paid = listed * (1 - discount)
        drop = (listed - paid) / listed * 100 if listed > paid else 0
        products.setdefault(part, []).append((ts.date(), order, line, store, paid / quantity, drop))
    return {(p, *k): v for p, offers in products.items() for k, v in deal_points(offers, names[p] in MULTI).items() if v >= 50}


def test_deal_score_has_six_signals(spark, tmp_path):
    names = {1: "cola", 2: "cola 1+1", 3: "cola 2 + 1 free", 4: "buy two get one free", 5: "عصير مجاناً", 6: "sugar free cola", 7: "omega 3+6+9"}
    week = lambda n, d=0: dt.datetime(2024, 1, 1) + dt.timedelta(weeks=n, days=d)
    histories = [
        [(0, 10, 0), (1, 9, 0)],  # a low at the second observation
        [(0, 10, 0), (1, 9, 0), (2, 9.5, 0), (3, 8.9, 0), (4, 8.9, 0), (9, 8.9, 0)],  # a lowest ever in week 4, a return
        [(0, 10, 0.4), (12, 20, 0.4), (30, 20, 0.3), (40, 20, 0.25), (41, 20, 0.39)],  # deep and big cuts, rarely on offer
        [(0, 10, 0), (4, 10, 0), (7, 50, 0.4), (8, 30, 0.45)],  # known 8 weeks, 3 of them on offer
        [(0, 6, 0), (30, 10, 0.4), (60, 10, 0.4), (70, 10, 0.4)],  # back at the low of 6
        [(n, 10 + n % 3, 0.08) for n in range(12)],  # no more than under the median
    ]
    rows, order = [], 0
    for part in range(1, 8 * len(histories)):
        for n, listed, discount in histories[part % len(histories)]:
            order += 1
            rows.append((order, 1, part, 1 + order % 3, 1.0, float(listed), float(discount), week(n, order % 3)))
    names = {p: names[1 + p % 7] for p in range(1, 8 * len(histories))}
    write_listings(spark, tmp_path, rows)
    spark.createDataFrame(list(names.items()), "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    want = all_points(rows, names)
    got = {(r.l_partkey, r.l_orderkey, r.l_linenumber, r.l_suppkey): r.score for r in plans.deal_score(spark, str(tmp_path)).collect()}
    assert got == want
    assert {50, 60, 65, 75} <= set(want.values())


def test_deal_score_equals_brute_force_on_tables(spark, data):
    lines = duck(data).sql("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate FROM lineitem").fetchall()
    names = dict(duck(data).sql("SELECT p_partkey, p_name FROM part").fetchall())
    got = {(r.l_partkey, r.l_orderkey, r.l_linenumber, r.l_suppkey): r.score for r in plans.deal_score(spark, data).collect()}
    assert got == all_points(lines, names)
    assert len(got) > 0


def test_size_join_has_all_products(spark, data):
    rows = duck(data).sql("SELECT p_partkey, p_brand, p_size FROM part").fetchall()
    want = {k: sum(b == brand and abs(s - own) <= 0.03 * max(s, own) for _, b, s in rows) for k, brand, own in rows}
    got = plans.history_size_join(spark, data).collect()
    assert len(got) == len(rows)
    assert {r.b: r.alike for r in got} == want
