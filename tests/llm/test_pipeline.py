"""The pipeline's stages row by row against plain Python, and on odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pricewright.llm import quality, rules
from tests.llm.odd import PROSE, odd_documents
from tests.llm.test_documents import plain_mcd, plain_statistics, plain_vector, shingle_set, words_of_text

COLUMNS = "doc_id long, text string, lang string, source string, token string, row string, kept int"


def fixture_rows():
    """Prose with nulls in every column, shared and missing ids, near and exact copies,
    junk, toxic words, a hot source and names that the operators use themselves."""
    rng, rows = random.Random(11), []
    bases = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 160))] for _ in range(150)]
    for i in range(330):
        words = list(rng.choice(bases[:40]) if i % 4 == 0 else bases[i % 150])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
        if i % 9 == 0:
            words[rng.randrange(len(words))] = rng.choice(("vile", "rotten"))
        if i % 31 == 0:
            words = words[:20]
        if i % 37 == 0:
            words = [w + "###" for w in words]
        doc_id = None if i % 13 == 0 else i % 300
        source = None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 5}"
        rows.append((doc_id, " ".join(words), rng.choice(("en", "en", None)), source, f"t{i}", None if i % 2 else "r", i))
    rows += [rows[5], rows[5], (None, None, None, None, None, None, None), (7, "", "en", "hot", "a", "b", 1), (None, " \n ", "en", "hot", "a", "b", 2)]
    rows.append((400, "long " + " ".join(f"l{k}" for k in range(30_000)), "en", "hot", "a", "b", 3))
    return rows


def plain_rules(rows):
    vectors, groups = {}, {}
    for i, r in enumerate(rows):
        n, _, _, _, repeat = plain_statistics(r[1])
        if n >= 50 and 100 * repeat <= 50 * n:
            vectors[i] = plain_vector(r[1])
            groups.setdefault((r[2], r[3]), []).append(i)
    dense = {k: v for k, v in groups.items() if len(v) >= rules.MIN_GROUP}
    sparse = {}
    for (lang, _), own in ((k, v) for k, v in groups.items() if k not in dense):
        sparse.setdefault(lang, []).extend(own)
    rest = [i for own in sparse.values() if len(own) < rules.MIN_GROUP for i in own]
    kept = set()
    for own in [*dense.values(), *(v for v in sparse.values() if len(v) >= rules.MIN_GROUP), *([rest] if rest else [])]:
        x = np.array([vectors[i] for i in own])
        mean, cov = plain_mcd(x)
        d2 = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)
        kept |= {i for i, d in zip(own, d2, strict=True) if d <= rules.CUTOFF}
    return [r for i, r in enumerate(rows) if i in kept]


def plain_classifier(rows, model):
    evidence = np.concatenate([model.evidence([r[1]]) for r in rows])
    p = 1 / (1 + np.exp(-evidence))
    host, path = [r[3] for r in rows], [(r[3], r[2]) for r in rows]
    sure = lambda v: min(max(v, 1e-6), 1 - 1e-6)

    def sums(keys):
        n, bad = Counter(keys), Counter()
        for k, v in zip(keys, p, strict=True):
            bad[k] += v
        return n, bad

    def strength(n, bad, around):
        total = sum(n.values())
        spread = sum(n[k] * (bad[k] / n[k] - around(k)) ** 2 for k in n) / total
        noise = sum(around(k) * (1 - around(k)) for k in n) / total
        mean = sum(n[k] * around(k) for k in n) / total
        return min(max(mean * (1 - mean) / max(spread - noise, 1e-9), quality.WEAKEST), quality.STRONGEST)

    hn, hb = sums(host)
    pn, pb = sums(path)
    rate = sure(p.sum() / len(p))
    kh = strength(hn, hb, lambda _: rate)
    kp = strength(pn, pb, lambda k: sure((hb[k[0]] + kh * rate) / (hn[k[0]] + kh)))
    kept, logit = [], lambda v: np.log(v / (1 - v))
    for i, r in enumerate(rows):
        own = sure((p.sum() - p[i]) / (len(p) - 1))
        h = sure((hb[host[i]] - p[i] + kh * own) / (hn[host[i]] - 1 + kh))
        s = sure((pb[path[i]] - p[i] + kp * h) / (pn[path[i]] - 1 + kp))
        if 1 / (1 + np.exp(-(evidence[i] + logit(s) - logit(own)))) <= quality.REJECT:
            kept.append(r)
    return kept


def plain_groups(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    groups = {}
    for x in range(len(rows)):
        groups.setdefault(find(x), []).append(rows[x])
    return list(groups.values())


def plain_mix(rows):
    sizes = [len(words_of_text(r[1])) for r in rows]
    hashes = [int(hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest()[:15], 16) for r in rows]
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    total = {n: sum(s for s, r in zip(sizes, rows, strict=True) if r[3] == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, left = {}, 1.5 * sum(sizes)
    open_ = list(names)
    while open_:  # whoever is above twice its size stops there, and the others share the rest
        level = left / sum(weight[n] for n in open_)
        over = [n for n in open_ if weight[n] * level >= 2 * total[n]]
        for n in over:
            target[n] = 2.0 * total[n]
            left -= target[n]
        if not over:
            target |= {n: weight[n] * level for n in open_}
            break
        open_ = [n for n in open_ if n not in over]
    copies = []
    for n in names:
        own = [i for i, r in enumerate(rows) if r[3] == n and sizes[i]]
        full = int(target[n] // total[n]) if total[n] else 0
        rest = target[n] - full * total[n] if total[n] else 0
        again, upto = set(), 0
        for h in sorted({hashes[i] for i in own}):
            here = sum(sizes[i] for i in own if hashes[i] == h)
            if upto + here < rest or (upto < rest and abs(upto + here - rest) < abs(upto - rest)):
                again.add(h)
            upto += here
        copies += [rows[i] for i in own for _ in range(full + (hashes[i] in again))]
    return copies


def table(rows):
    return sorted(map(repr, map(tuple, rows)))


def labels_for(spark, rows, folder):
    marks = {r[0]: int(any(w in r[1].split() for w in ("vile", "rotten"))) for r in rows if r[0] is not None and r[1]}
    known = spark.createDataFrame([(i, 1, t) for i, t in marks.items() if i % 10], "doc_id long, quality int, toxic int")
    known.write.mode("overwrite").parquet(f"{folder}/labels.parquet")


def test_stages_equal_plain_python(spark, tmp_path):
    data = str(tmp_path)
    rows = fixture_rows()
    labels_for(spark, rows, data)
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{data}/documents.parquet")
    read = lambda name: spark.read.parquet(f"{data}/{name}")

    def after(stage, before, name):
        found = stage(spark, read(before), data)
        found.write.parquet(f"{data}/{name}")
        return [tuple(r) for r in read(name).collect()]

    ruled = after(corpus_pipeline.quality_rules, "documents.parquet", "ruled")
    assert table(ruled) == table(plain_rules(rows)) and 0 < len(ruled) < len(rows)

    model = quality.train(read("ruled").select("doc_id", "text"), read("labels.parquet"))
    good = after(corpus_pipeline.quality_classifier, "ruled", "good")
    assert table(good) == table(plain_classifier(ruled, model)) and len(good) < len(ruled)

    single = after(corpus_pipeline.near_duplicates, "good", "single")
    groups = plain_groups(good)
    assert len(single) == len(groups) < len(good)
    left = Counter(map(repr, single))
    for own in groups:
        least = min((r[0] is None, r[0] or 0) for r in own)
        fit = [repr(r) for r in own if (r[0] is None, r[0] or 0) == least and left[repr(r)]]
        assert fit, own
        left[fit[0]] -= 1

    mixed = after(corpus_pipeline.source_mix, "single", "mixed")
    assert table(mixed) == table(plain_mix(single))

    packed = read("mixed")
    pieces = corpus_pipeline.token_windows(spark, packed, data).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(r[0] for r in mixed)
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)

    whole = corpus_pipeline.run(spark, data)
    assert sum(r.length for r in whole.collect()) == sum(r.length for r in pieces)


def test_labelled_bad_documents_go(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = corpus_pipeline.materialize(corpus_pipeline.quality_classifier(spark, docs, data), "test-stage")
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert kept.join(labels.filter("toxic = 1 OR quality = 0"), "doc_id").count() == 0


def test_odd_documents_pass_through(spark, data):
    docs = odd_documents(spark)
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, data)
        if name != "token windows":
            assert found.columns == docs.columns, name
            assert 0 <= found.count() <= (2 * rows if name == "source mix" else rows), name
        else:
            assert found.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        assert stage(spark, docs.filter("false"), data).count() == 0, name


def test_rows_without_an_id_have_their_own_verdicts(spark, data):
    """One good row without an id takes no junk row along."""
    good_text = " ".join(f"word{n}" for n in range(120))
    docs = spark.createDataFrame([(i, t, "en", "a") for i in (None, 1) for t in (good_text, "too short", "junk junk junk", None)], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.quality_rules(spark, docs, data).collect()
    assert sorted((r.doc_id is None, r.text) for r in kept) == [(False, good_text), (True, good_text)]


def test_near_copies_of_shared_and_missing_ids(spark, data):
    other = " ".join(f"other{n}" for n in range(30))
    rows = [(None, PROSE), (None, PROSE + " now"), (1, other), (2, other + " x"), (2, "quite another text of seven words"), (5, None), (5, None)]
    near = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.near_duplicates(spark, near, data).collect()
    assert len(kept) == 5
    assert sorted(str(r.text) for r in kept if r.doc_id is not None) == sorted(["None", "None", other, "quite another text of seven words"])


def test_stages_leave_no_tables_behind(spark, data):
    from pricewright.llm import common

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = set(common._LEFT)
    for _, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, data).count()
    corpus_pipeline.sweep(corpus_pipeline._LEFT.paths)
    assert set(common._LEFT) <= before


def test_classifier_learns_from_all_labels_below_its_bound(spark, monkeypatch):
    n = 2_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    monkeypatch.setattr(quality, "fit", lambda bad, shape, held, features: len(bad))
    assert quality.train(docs, labels).heads == [n]
    assert abs(quality.train(docs, labels, rows=1000).heads[0] - 1000) < 200
