"""Document operators on odd rows and against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewright.llm import jaccard, langid, media, mixing, packing, quality, rules
from pricewright.llm.common import word_count, words_of
from pricewright.llm.components import connected_components
from tests.compare import assert_same, duck
from tests.llm.odd import TEXTS, no_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (7, 0, 0), (7, 0, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "packing": lambda d: packing.packed_pieces(d),
    "media": lambda d: media.media_columns(d),
    "jaccard": lambda d: jaccard.jaccard_components(d),
    "mixing": lambda d: mixing.mix_sources(d),
    "rules": lambda d: rules.judge(d),
    "quality": lambda d: quality.classify(d, labels(d.sparkSession)),
    "langid": lambda d: langid.identify(d.select("doc_id", "text"), langid.train(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_documents(spark, name):
    assert OPERATORS[name](no_documents(spark)).count() == 0


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "packing"])
def test_one_row_per_row(spark, name):
    got = Counter(r.doc_id for r in OPERATORS[name](odd_documents(spark)).collect())
    assert got == Counter(i for i, *_ in TEXTS)


def test_words(spark):
    rows = odd_documents(spark).select("text", word_count(F.coalesce("text", F.lit(""))).alias("n"), F.size(words_of(F.coalesce("text", F.lit("")))).alias("m")).collect()
    assert all(r.n == r.m == len(WORD.findall(r.text or "")) for r in rows)


# packing


def pieces_cover(rows, expected):
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, total in expected.items():
        assert sum(n for _, n, _ in by_doc[doc]) == total
    for own in by_window.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end == 1024 or end & (end - 1) == 0


def test_packing_cuts_no_id_and_pads_none(spark):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(packing.default_tokenizer())
    full.encode_special_tokens = True
    ids = [(i, np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4")) for i, t, *_ in TEXTS]
    rows = packing.packed_pieces(odd_documents(spark)).collect()
    expected = Counter()
    for i, own in ids:
        expected[i] += len(own)
    pieces_cover(rows, expected)
    known = {}
    for i, own in ids:
        known.setdefault(i, own)
    assert all(zlib.crc32(known[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)


def test_packer_follows_sum_of_squares():
    out = []
    packer = packing.Packer(lambda s, pieces: out.append(pieces), window=16)
    rng, counts = random.Random(5), Counter()
    for doc in range(300):
        size = rng.randint(1, 15)
        before = counts.copy()

        def change(h, size=size, before=before):
            after = before.copy()
            if h:
                after[h] -= 1
            if h + size < 16:
                after[h + size] += 1
            return sum(v * v for v in after.values())

        best = min([0, *(h for h in range(1, 17 - size) if before[h] > 0)], key=lambda h: (change(h), -h))
        packer.add(doc, np.arange(size, dtype="<u4"))
        if best:
            counts[best] -= 1
        if best + size < 16:
            counts[best + size] += 1
        assert {h: n for h, n in counts.items() if n} == {h: int(n) for h, n in enumerate(packer.level) if 0 < h < 16 and n}
    packer.finish()
    fills = [sum(len(p[2]) for p, _ in pieces) for pieces in out]
    assert all(f == 16 or f & (f - 1) == 0 for f in fills)


def test_packer_closes_windows_beyond_its_bound():
    out = []
    packer = packing.Packer(lambda s, pieces: out.append(pieces), window=16, max_open=8)
    for doc in range(100):
        packer.add(doc, np.arange(9, dtype="<u4"))
        assert packer.n_open <= 9
    packer.finish()
    assert sum(len(p[2]) for pieces in out for p, _ in pieces) == 900


def test_assembled_windows(spark):
    docs = odd_documents(spark)
    whole = packing.assemble(packing.pack_documents(docs, packing.default_tokenizer()))
    assert {len(r.tokens) // 4 for r in whole.collect()} <= {1 << i for i in range(11)}


# media


def test_media_round_trip(spark):
    for r in media.media_columns(odd_documents(spark)).collect():
        raw = next((t or "") for i, t, *_ in TEXTS if i == r.doc_id).encode()
        assert r.n_bytes == len(raw)
        assert bytes(r.thumbnail) == raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert r.media[:2] == b"\xff\xd8" and r.width == 512


def test_media_query_digests(spark, data):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in media.op2(spark, data).collect():
        padded = docs[r.doc_id] + b"\0" * (-len(docs[r.doc_id]) % 64 if docs[r.doc_id] else 64)
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_unreadable_media_is_null(spark):
    rows = spark.createDataFrame([(1, bytearray(b"not a jpeg")), (2, None), (3, bytearray(b"\xff\xd8\xff"))], "id int, media binary")
    assert all(r.thumbnail is None and r.width is None for r in media.read_media(rows).collect())


# rules


def plain_statistics(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, data):
    extra = [(100, "a b c a b c d\na b\n\na b\n#1 $ a b c", None, None), (101, "x x x x x", "en", "s"), (102, "a b", "en", "s")]
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source").unionByName(
        spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string")
    )
    docs = docs.unionByName(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source").withColumn("doc_id", F.col("doc_id") + 1000))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    for r in rules.base_statistics(docs).collect():
        own = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own, r.doc_id
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])


def test_rules_keep_good_and_drop_bad(spark):
    data = "/root/testdata/sf0.01"
    got = rules.op8(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").filter("NOT base_failed")
    assert got.filter("quality = 1 AND NOT kept").count() == 0
    assert got.filter("quality = 0 AND kept").count() == 0


FLOORS = [f for *_, f in rules.VECTOR]


def plain_mcd(x):
    """The rules' estimate of one group in numpy: mean and covariance."""
    floor = np.diag(np.square(FLOORS))

    def near(mean, cov):
        z = x - mean
        return np.einsum("ij,ij->i", z @ np.linalg.inv(cov), z)

    def moments(rows, factor):
        return rows.mean(axis=0), np.cov(rows.T, bias=True) * factor + floor

    def nearest(estimate, share, factor):
        bucket = np.floor(np.log(near(*estimate) + 1e-6) * 32)
        edge = np.sort(bucket)[int(np.ceil(share * len(x))) - 1]
        return moments(x[bucket <= edge], factor)

    bucket = np.sort(np.floor(np.arcsinh(x) * 256), axis=0)
    q1, q2, q3 = (np.sinh((bucket[int(np.ceil(s * len(x))) - 1] + 0.5) / 256) for s in (0.25, 0.5, 0.75))
    middle = (q2, np.diag(np.square(np.maximum((q3 - q1) / 1.349, FLOORS))))
    starts = [middle, nearest(middle, 0.5, rules.HALF_CONSISTENCY), moments(x, 1.0)]
    for _ in range(rules.FIRST_STEPS):
        starts = [nearest(s, rules.SUBSET, rules.CONSISTENCY) for s in starts]
    determinant = lambda e: np.linalg.slogdet(e[1])[1]
    best = min(starts, key=determinant)
    for _ in range(rules.MORE_STEPS):
        after = nearest(best, rules.SUBSET, rules.CONSISTENCY)
        moved = abs(determinant(after) - determinant(best)) > rules.STILL
        best = after
        if not moved:
            break
    return moments(x[near(*best) <= rules.INSIDE], rules.INSIDE_CONSISTENCY)


def plain_vector(text):
    words, chars, symbols, dup_lines, repeat = plain_statistics(text)
    lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
    return [np.log1p(words), chars / words, np.log1p(1000 * symbols / chars), dup_lines / lines, repeat / words]


def test_outliers_equal_numpy(spark):
    """Distances of two groups, one with two clusters of rows, and of pooled sparse ones."""
    rng, rows = random.Random(8), []
    for i in range(700):
        words = [("w" if i % 3 else "longword") + str(rng.randint(0, 500)) for _ in range(rng.randint(60, 90 if i % 9 else 2000))]
        words += ["#"] * (rng.randint(0, 3) if i % 50 else 400)
        source = ("a", "b")[i % 2] if i % 10 else f"s{i}"
        rows.append((i, " ".join(words), "en", source))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    groups = {}
    for i, text, _, source in rows:
        n, *_, repeat = plain_statistics(text)
        if got[i].base_failed:
            assert 100 * repeat > 50 * n and not got[i].kept
        else:
            groups.setdefault(source if source in "ab" else "sparse", []).append((i, plain_vector(text)))
    for own in groups.values():
        x = np.array([v for _, v in own])
        mean, cov = plain_mcd(x)
        d2 = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)
        for (i, _), d in zip(own, d2, strict=True):
            assert abs(got[i].d2 - d) <= 1e-6 * max(1, d), (i, got[i].d2, d)
            assert got[i].kept == (d <= rules.CUTOFF)
    assert not all(r.kept for r in got.values() if not r.base_failed)


# mixing


def test_mixing_equals_sorted_sql(spark, data, tmp_path):
    assert_same(mixing.op6(spark, data), duck(data), mixing.op6_sql())
    odd_documents(spark).filter("doc_id IS NULL OR doc_id <> 12").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = mixing.op6(spark, str(tmp_path))
    assert_same(got, duck(str(tmp_path)), mixing.op6_sql())
    assert all(r.taken <= 2 * r["size"] for r in got.collect())


def test_mixing_reruns_agree(spark, data):
    rows = [sorted(map(tuple, mixing.op6(spark, data).collect())) for _ in range(2)]
    assert rows[0] == rows[1]


# language id


def test_language_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = langid.op9(spark, data).join(truth, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def plain_grams(text):
    """The buckets of a text's n-grams, in integers modulo 2**32."""
    m, low = 2**32 - 1, text.lower()
    points = [ord(c) for c in low + "  "]
    for at in range(len(low)):
        mixed = 0
        for order, factor in zip((1, 2, 3), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D), strict=True):
            mixed = ((mixed ^ (mixed >> 15)) * 0x2C1B3C6D + points[at + order - 1] * factor) & m
            h = (mixed + order) * 0x27D4EB2F & m
            yield ((h ^ (h >> 13)) * 0x165667B1 & m) >> 17


def test_language_equals_plain_bayes(spark, data):
    """Prediction and posterior of every row, by counting and adding one by one."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    teaches = lambda r: zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 != 2 and r.lang is not None
    letters = lambda t: bool(t) and any(map(str.isalpha, t))
    counts, rows = {}, Counter()
    for r in docs:
        if teaches(r) and letters(r.text):
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
            rows[r.lang] += 1
    smooth = {lang: own.total() + 0.5 * 2**15 for lang, own in counts.items()}
    got = {r.doc_id: r for r in langid.op9(spark, data).collect()}
    for r in docs:
        if not letters(r.text):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        own = Counter(plain_grams(r.text))
        odds = {lang: math.log(rows[lang] / rows.total()) + sum(k * math.log((c[b] + 0.5) / smooth[lang]) for b, k in own.items()) for lang, c in counts.items()}
        best = max(odds, key=odds.get)
        assert got[r.doc_id].lang_pred == best
        assert abs(got[r.doc_id].score - 1 / sum(math.exp(o - odds[best]) for o in odds.values())) < 1e-3


def test_language_of_odd_texts(spark):
    docs = odd_documents(spark)
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), langid.train(docs)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6, 9))
    assert got[7].lang_pred == "en"
    empty = langid.train(docs.filter("false"))
    assert {r.lang_pred for r in langid.identify(docs.select("doc_id", "text"), empty).collect()} == {"und"}


# classifier


def test_classifier_finds_planted_words(spark):
    rng, rows, marks = random.Random(3), [], []
    for i in range(900):
        ws = [f"w{rng.randint(0, 400)}" for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            ws[rng.randint(0, 39)] = f"vile{rng.randint(0, 99)}"
        rows.append((i, " ".join(ws), "en", f"s{i % 7}"))
        marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    known = spark.createDataFrame([m for m in marks if m[0] % 3], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.classify(docs, known).collect()}
    unseen = [i for i, *_ in marks if i % 3 == 0]
    assert sum(got[i] == bool(i % 5) for i in unseen) >= 0.98 * len(unseen)


def test_no_labels_reject_nothing(spark):
    docs = odd_documents(spark)
    none = labels(spark).filter("false")
    assert all(r.kept for r in quality.classify(docs, none).collect())


def test_sparse_sites_shrink_to_the_global_rate(spark):
    rows = [("h1", "p1", 0.9)] * 2 + [("h2", "p2", 0.1)] * 500 + [("h3", "p3", 0.6)] * 500
    scored = spark.createDataFrame(rows, "host_key string, path_key string, p double")
    site, _ = quality.site_rates(F.col("p"))
    got = {r.path_key: r.r for r in scored.join(quality.site_counts(scored), ["host_key", "path_key"]).withColumn("r", site).collect()}
    assert got["p2"] < got["p1"] < 0.7 and abs(got["p3"] - 0.6) < 0.05


def test_own_evidence_is_left_out_of_the_site(spark):
    """By counting the other documents one by one."""
    rng = random.Random(4)
    rows = [(i, f"h{i % 3}", f"p{i % 5}", rng.random()) for i in range(60)]
    scored = spark.createDataFrame(rows, "i int, host_key string, path_key string, p double")
    site, overall = quality.site_rates(F.col("p"))
    got = scored.join(quality.site_counts(scored), ["host_key", "path_key"]).withColumns({"site": site, "all": overall}).collect()
    for r in got:
        rest = [x for x in rows if x[0] != r.i]
        host = [x[3] for x in rest if x[1] == r.host_key]
        path = [x[3] for x in rest if x[1] == r.host_key and x[2] == r.path_key]
        rate = sum(x[3] for x in rest) / len(rest)
        host_rate = (sum(host) + r.k_host * rate) / (len(host) + r.k_host)
        assert abs(r.all - rate) < 1e-9
        assert abs(r.site - (sum(path) + r.k_path * host_rate) / (len(path) + r.k_path)) < 1e-9


@pytest.mark.parametrize("sf, recall, langs", [("sf0.01", 0.8, ("en",)), ("sf0.1", 0.9, ("en", "de", "fr", "es"))])
def test_classifier_held_out(spark, sf, recall, langs):
    """Of the labelled documents that it did not learn from, by label. At sf0.01
    languages but English have four to six toxic documents each, too few to learn from."""
    data = f"/root/testdata/{sf}"
    docs, known = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    unseen = known.filter("doc_id % 3 = 0")
    model = quality.train(docs.select("doc_id", "text"), known.filter("doc_id % 3 <> 0"))
    judged = quality.with_evidence(docs.join(unseen, "doc_id").selectExpr("doc_id", "text", "lang", "quality = 0 AS low", "toxic = 1 AS toxic"), model)
    got = judged.selectExpr("lang", "low", "toxic", f"1 / (1 + exp(-evidence)) <= {quality.REJECT} AS kept").collect()
    rejected = lambda rows: sum(not r.kept for r in rows) / len(rows)
    assert rejected([r for r in got if r.low]) >= 0.95
    assert rejected([r for r in got if r.toxic and r.lang in langs]) >= 0.95
    assert rejected([r for r in got if r.toxic or r.low]) >= recall
    assert rejected([r for r in got if not r.low and not r.toxic]) <= 0.03


def test_long_texts_teach(spark):
    """The word that tells stands behind any prefix that a shorter reading would have."""
    rows = [(i, "plain words " * 9000 + ("vile" if i % 2 else "kind")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = docs.selectExpr("doc_id", "1 AS quality", "CAST(doc_id % 2 AS int) AS toxic")
    texts = [t + f" x{i}" for i, t in rows]
    model = quality.train(docs.withColumn("text", F.concat("text", F.lit(" x"), "doc_id")), known)
    assert [e > 0 for e in model.evidence(texts)] == [bool(i % 2) for i, _ in rows]


def test_url_sites(spark):
    urls = ["https://A.com/news/2024/x?q", "http://b.org", "no url", None, "x://c/d"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i")
    got = [tuple(r) for r in rows.select(*quality.url_sites(F.col("u"))).collect()]
    assert got == [("a.com", "/news"), ("b.org", ""), ("", ""), ("", ""), ("c", "/d")]


# jaccard


def words_of_text(t):
    return (t or "").encode().lower().split()


def shingle_set(t):
    ws = words_of_text(t)
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)])


def plain_components(docs):
    sets = [(i, shingle_set(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    least = {}
    for x, (i, s) in enumerate(sets):
        if s and i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted((str(i), len(s), str(least.get(find(x)) if s else i)) for x, (i, s) in enumerate(sets))


def near_copies(seed):
    rng = random.Random(seed)
    docs, i = [], 0
    line = " ".join(f"common{k}" for k in range(40))
    for base in range(12):
        words = [f"b{base}w{rng.randint(0, 3000)}" for _ in range(rng.randint(8, 220))]
        if base % 3 == 0:
            words += line.split()
        for _ in range(rng.randint(1, 14)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = f"new{rng.randint(0, 10**6)}"
            docs.append((i, " ".join(own)))
            i += 1
    docs += [(i + k, line + f" tail{k} " * (k % 3)) for k in range(60)]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(df).collect())
    assert got == plain_components(docs)


def chain_sets(rng, n):
    """Sets that differ a little from the one before, so that ends are far apart."""
    out = [set(rng.sample(range(10**6), 120))]
    for _ in range(n - 1):
        own = set(rng.choice(out))
        for x in rng.sample(sorted(own), rng.randint(0, 14)):
            own.discard(x)
        own |= set(rng.sample(range(10**6), rng.randint(0, 14)))
        out.append(own)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_differences_lose_no_link(spark, seed):
    """Whatever the pivot: with its links they make the components of all links."""
    rng = random.Random(seed)
    sets = chain_sets(rng, 70)
    links = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    table = spark.createDataFrame([(i, bytearray(np.sort(np.array(sorted(s), np.uint64)).tobytes())) for i, s in enumerate(sets)], "cid long, shingles binary")
    pivots = rng.sample(range(len(sets)), 2)
    pairs = [(i, p) for p in pivots for i in range(len(sets)) if i != p]
    stars = [(i, p) for i, p in pairs if links(i, p)]
    empty = spark.createDataFrame([], "a long, b long")
    roots = connected_components(spark.createDataFrame(stars, "a long, b long") if stars else empty)
    mixed = jaccard.mixed_families(spark.createDataFrame(pairs, "a long, p long"), roots)
    got = {tuple(r) for r in jaccard.difference_pairs(jaccard.differences(mixed, table)).collect()}
    root = {r.node: r.root for r in roots.collect()}
    missed = [(i, j) for j in range(len(sets)) for i in range(j) if links(i, j) and root.get(i, i) != root.get(j, j) and (i, j) not in got]
    assert not missed
    assert len(got) < len(sets) * (len(sets) - 1) // 2


def test_components_with_a_hub(spark):
    links = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(500, 560)] + [(600, 600), (700, 701), (701, 700)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    want = {i: 0 for i in range(400)} | {i: 500 for i in range(500, 561)} | {700: 700, 701: 700}
    assert got == want


def test_components_of_odd_texts(spark):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(odd_documents(spark)).collect())
    assert got == plain_components([(i, t) for i, t, *_ in TEXTS])
