"""Importance resampling, decontamination and conversation repair against SQL and
plain Python, on odd rows and beyond their switches."""

import heapq
import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from math import floor, log

import pytest
from pyspark.sql import functions as F

from pricewright.llm import decontam, repair, resample
from pricewright.llm.queries import QUERIES, SQL
from tests.compare import assert_same, duck
from tests.llm.odd import LONG, PROSE, no_documents, odd_documents

NEW = ["op11_importance_resample", "op12_decontaminate", "op13_repair_turns"]


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data), duck(data), SQL[name])


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


ITEMS = [
    (1, " ".join(PROSE.split()[2:16])),
    (2, "WIZARDS quietly"),
    (2, "wizards, QUIETLY!"),
    (3, None),
    (4, " ... "),
    (None, "old mill"),
    (5, " ".join(LONG.split()[100:130])),
    (6, "héàü"),
    (7, "c"),
]


def odd_benchmark(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id bigint, text string, gram int")


# --- resampling


def test_resampling_equals_plain_python(spark):
    docs, target = odd_documents(spark), odd_benchmark(spark)
    got = resample.resample(docs, target, percent=50, buckets=50, max_run=2, min_words=3)

    def feature_buckets(text):
        w = plain_words(text)
        return [zlib.crc32(x.encode()) % 50 for x in [*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))]]

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    s, t = (Counter(b for x in texts for b in feature_buckets(x)) for texts in ([x for _, x in rows], [x for _, x in ITEMS]))
    gain = [floor(1000 * log((t[b] + 1) * (s.total() + 50) / ((s[b] + 1) * (t.total() + 50)))) for b in range(50)]
    want = []
    for i, text in rows:
        own = feature_buckets(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(own), weight, weight + floor(-1000 * log(-log((h + 0.5) / 2**32))), len(plain_words(text)) >= 3))
    fit = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0] or 0, w[1]))
    ranks = Counter((*w[:4], n if n <= len(fit) // 2 else None) for n, w in enumerate(fit, 1))
    ranks += Counter((*w[:4], None) for w in want if not w[4])
    assert Counter(tuple(r) for r in got.collect()) == ranks


def test_resampling_odd_tables(spark):
    assert resample.resample(no_documents(spark), odd_benchmark(spark)).count() == 0
    empty_target = odd_benchmark(spark).filter("item_id > 99")
    assert resample.resample(odd_documents(spark), empty_target).count() == odd_documents(spark).count()
    carried = resample.resample(odd_documents(spark), odd_benchmark(spark), carry=odd_documents(spark).columns)
    assert carried.select("carried.*").columns == odd_documents(spark).columns


def test_ranks_of_one_group_of_equal_rows(spark):
    """Most rows share id and text, hence score: each still has a rank of its own."""
    same = spark.range(900).select(F.lit(None).cast("long").alias("doc_id"), F.lit(PROSE * 2).alias("text"))
    other = spark.range(100).select("id", F.concat(F.lit(PROSE + " more words "), F.col("id")).alias("text"))
    got = resample.resample(same.union(other).repartition(6), odd_benchmark(spark), percent=95).collect()
    ranked = sorted((r for r in got if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, 951))
    assert [r.score for r in ranked] == sorted((r.score for r in got), reverse=True)[:950]


# --- decontamination


def plain_marks(rows, n):
    windows = {}
    for i, text in ITEMS:
        w = plain_words(text)
        k = min(n, len(w))
        for at in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[at : at + k]), set()).add(i)
    out = []
    for i, text in rows:
        w, hit, items = plain_words(text), set(), set()
        for k in {len(g) for g in windows}:
            for at in range(len(w) - k + 1):
                if (found := windows.get(tuple(w[at : at + k]))) is not None:
                    hit |= set(range(at, at + k))
                    items |= found
        out.append((i, len(w), len(hit), tuple(sorted(str(x) for x in items if x is not None))))
    return Counter(out)


@pytest.mark.parametrize("n, limit, bits", [(10, 1 << 20, 1 << 20), (10, -1, 1 << 20), (3, 1 << 20, 1024)])
def test_marks_equal_plain_python(spark, monkeypatch, n, limit, bits):
    """Broadcast, shuffled, and with a filter so small that most windows pass it."""
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    docs = odd_documents(spark)
    got = decontam.mark_contamination(docs, odd_benchmark(spark), n)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got.collect()) == plain_marks([(r.doc_id, r.text) for r in docs.collect()], n)


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Keep this. The old, OLD mill -- here", 1), (2, "nothing", 2), (3, None, 3), (4, "old mill", 4)], "doc_id long, text string, row_no int")
    items = spark.createDataFrame([(9, "old mill")], "item_id long, text string")
    clean = decontam.decontaminate(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {1: "Keep this. The old -- here", 2: "nothing", 3: None, 4: ""}
    assert {r.doc_id for r in decontam.decontaminate(docs, items, "documents").collect()} == {2, 3}
    with pytest.raises(ValueError):
        decontam.decontaminate(docs, items, "words")


def test_runs_of_many_spans(spark):
    words = [f"w{i}" for i in range(3000)]
    items = [(k, " ".join(words[k : k + 3])) for k in range(0, 3000, 7)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    left = [w for i, w in enumerate(words) if i % 7 > 2]
    assert decontam.decontaminate(docs, benchmark).first().text.split() == left
    assert decontam.mark_contamination(docs, benchmark).first().n_hit == 3000 - len(left)


def test_decontamination_odd_tables(spark):
    assert decontam.mark_contamination(no_documents(spark), odd_benchmark(spark)).count() == 0
    none = decontam.mark_contamination(odd_documents(spark), odd_benchmark(spark).filter("item_id = 3"))
    assert none.agg(F.sum("n_hit")).first()[0] == 0
    assert none.count() == odd_documents(spark).count()


# --- repair

WORDS = ["Yes.", "No!", "cut off", "", " \n", "Yes."]


def odd_turns(spark):
    rng, rows = random.Random(5), []
    for conv in [*range(120), None]:
        for turn in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "", None, "tool"])
            rows.append((conv, None if rng.random() < 0.1 else turn * rng.choice((1, 1, 3)), role, rng.choice([*WORDS, None]), 1))
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}.", 1) for t in range(9000)]
    rows += [(501, 1, "user", LONG * 3, 1), (501, 1, "user", LONG * 3, 1)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault int")


def plain_repair(rows):
    """The cheapest letters by a search over all edits, and what they leave."""
    rows = [(t, r or "", x or "") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, r, x in rows:
        told = x.rstrip(" \t\n\x0b\x0c\r")
        faults.append(1 if not told else 2 if (r, x) in seen else 3 if told[-1] not in ".!?" else 0)
        seen.add((r, x))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, said = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        wanted, to = repair.WANTED[state]
        heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*said, f"{wanted}:")))
        if i < len(rows):
            _, r, x = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, said))
            if faults[i] in (0, 3):
                extra = 5 if faults[i] else 0
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, to, (*said, f"{wanted}:{x}")))
                if r[:1] in repair.NEXT[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, repair.NEXT[state][r[:1]], (*said, f"{r}:{x}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, sha256("\n".join(said).encode()).hexdigest())


def test_repair_equals_search(spark):
    rows = odd_turns(spark).repartition(5)
    by_conv = {}
    for r in rows.collect():
        by_conv.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_digests(rows).collect()}
    assert got == {c: plain_repair(own) for c, own in by_conv.items()}


def test_repaired_turns_make_the_digests(spark):
    rows = odd_turns(spark).filter("conv_id < 120 OR conv_id IS NULL")
    turns = {}
    for r in sorted(repair.repair_turns(rows).collect(), key=lambda r: r.seq):
        turns.setdefault(r.conv_id, []).append(r)
    for r in repair.repair_digests(rows).collect():
        own = turns[r.conv_id]
        assert [t.seq for t in own] == list(range(len(own)))
        assert "".join(t.edit for t in own) == r.audit
        said = [f"{t.role}:{t.text}" for t in own if t.edit != "D"]
        assert sha256("\n".join(said).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in own if t.edit != "D"))


def test_repair_of_nothing(spark):
    none = odd_turns(spark).filter("conv_id > 999")
    assert repair.repair_digests(none).count() == 0
    assert repair.repair_turns(none).count() == 0


def test_repair_query_on_odd_rows(spark, tmp_path):
    """Nulls anywhere, repeated turns, and a conversation whose rows are all dropped."""
    dropped = next(c for c in range(600, 700) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    extra = spark.createDataFrame([(dropped, 0, "user", "gone.", 1)], "conv_id long, turn long, role string, text string, fault int")
    odd_turns(spark).filter("conv_id < 500 OR conv_id IS NULL").union(extra).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op13_repair_turns"](spark, str(tmp_path))
    assert got.filter(F.col("conv_id") == dropped).select("cost", "audit", "repaired_sha256").first() == (0, "", sha256(b"").hexdigest())
    assert_same(got, duck(str(tmp_path)), SQL["op13_repair_turns"])
