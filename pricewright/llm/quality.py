"""Quality classifier with hierarchical empirical Bayes site priors.

Two logistic regressions, of low quality and of toxicity, over hashed words, word
beginnings and frequent beginnings, and a few shape statistics, are fitted on a bounded
sample of labelled rows. Their probability that a document is either (bad) is evidence
of the document alone. Grouped
sums of these probabilities over all documents give every host, and every path
under a host, a posterior rate: a path is shrunk toward its host and a host toward
the global rate, with strengths estimated from the spread of the rates. A document's
verdict combines its own evidence with its path's posterior, from which its own
evidence is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared, spread_join
from .urlfilter import split_url
from .shingles import mix, parts

#: The training sample: rows at most (in expectation).
TRAIN_ROWS = 12_000
#: Features for each label: chosen at most, least documents and least gain (in nats) of
#: one, word beginnings used, and how often a beginning is frequent: twice, and one word
#: in so many.
FEATURES, LEAST_DOCS, LEAST_GAIN, BEGINNINGS, FREQUENT = 6000, 3, 4.0, (4, 5), 100
STATISTICS = 6
LABELS = ("low", "toxic")
RIDGE, ROUNDS, RATE = 0.002, 400, 0.05
#: The evidence of every text where nothing could be learned.
UNTRAINED = -4.0
#: A document is rejected above this probability of being bad: one that is kept and bad
#: costs as much as two that are dropped and good.
REJECT = 1 / 3
#: Bounds of the strength with which sites are shrunk.
WEAKEST, STRONGEST = 20.0, 10_000.0

_BLANK_POINTS = np.array([9, 10, 11, 12, 13, 32], np.uint32)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_KIND = np.arange(8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def featurize(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per text its distinct hashed features (0 is none), and its shape statistics: log words,
    word length, and the shares of distinct words, upper case letters, characters
    that are neither letters nor blanks, and symbols."""
    texts = [t or "" for t in texts]
    points = np.frombuffer(" ".join([t.replace("\0", " ") for t in texts] + [""]).encode("utf-32-le"), np.uint32)
    lowered = [t.lower() for t in texts]
    low = np.frombuffer(" ".join(lowered + [""]).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lowered])
    blank = np.isin(low, _BLANK_POINTS)
    edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
    first, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    shape = np.zeros((len(texts), STATISTICS))
    if not len(first):
        return [np.zeros(0, np.uint64) for _ in texts], shape
    lengths = stop - first
    inside = np.flatnonzero(~blank)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(begin, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    terms = mix(low[inside].astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) * powers[place]
    hashes = [mix(np.add.reduceat(terms, begin) + _KIND[0])]
    for k in BEGINNINGS:
        own = np.add.reduceat(np.where(place < k, terms, np.uint64(0)), begin)
        hashes.append(np.where(lengths >= k, mix(own + _KIND[k]), np.uint64(0)))
    upto = np.searchsorted(first, ends)
    found, a = [], 0
    raw_ends = np.cumsum([len(t) + 1 for t in texts])
    upper = (points >= 65) & (points <= 90)
    symbol = np.isin(points, np.array([ord(c) for c in "#*$%&|<>!"], np.uint32))
    plain = ((points | 32) >= 97) & ((points | 32) <= 122) | (points >= 0xC0) | np.isin(points, _BLANK_POINTS)
    raw_start = 0
    for i, (b, end) in enumerate(zip(upto.tolist(), raw_ends.tolist(), strict=True)):
        words = np.unique(hashes[0][a:b])
        n, chars = b - a, max(1, end - raw_start - 1)
        own = [words]
        for h in hashes[1:]:
            beginnings, times = np.unique(h[a:b], return_counts=True)
            often = beginnings[(times >= 2) & (times * FREQUENT >= n) & (beginnings != 0)]
            own += [beginnings, mix(often + _KIND[7])]
        found.append(np.concatenate(own))
        if n:
            shape[i] = (
                np.log1p(n),
                lengths[a:b].mean(),
                len(words) / n,
                upper[raw_start:end].sum() / chars,
                1 - (plain[raw_start:end].sum() - 1) / chars,
                symbol[raw_start:end].sum() / chars,
            )
        a, raw_start = b, end
    return found, shape


@dataclass
class Classifier:
    """One label's chosen features (sorted), their weights, scaling of the statistics."""

    features: np.ndarray
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    bias: float

    def columns(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of every chosen feature that a text has."""
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        if not len(self.features):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(self.features, flat), len(self.features) - 1)
        hit = self.features[at] == flat
        return row[hit], at[hit]

    def shapes(self, shape: np.ndarray) -> np.ndarray:
        return np.clip((shape - self.centre) / self.scale, -6, 6)

    def odds(self, found: list[np.ndarray], shape: np.ndarray) -> np.ndarray:
        """Log odds that each text has the label."""
        row, at = self.columns(found)
        k = len(self.features)
        wide = np.bincount(row, self.weights[at], minlength=len(found)) if len(row) else 0.0
        return self.bias + wide + self.shapes(shape) @ self.weights[k:]


@dataclass
class Heads:
    """A classifier for each label that could be learned."""

    heads: list[Classifier]

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Log odds that each text is bad: that it has one of the labels."""
        if not self.heads:
            return np.full(len(texts), UNTRAINED)
        found, shape = featurize(texts)
        none = sum(np.logaddexp(0, np.clip(h.odds(found, shape), -30, 300)) for h in self.heads)
        return none + np.log(-np.expm1(-none))


def _features_of(sample: DataFrame) -> DataFrame:
    """digest, low, toxic, features (binary), shape: a row for each distinct text."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, shapes = [], []
            for part in parts(t.as_py() for t in batch["text"]):
                found, shape = featurize(part)
                features += [f[f != 0].tobytes() for f in found]
                shapes += shape.tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("digest", *LABELS)), pa.array(features, pa.binary()), pa.array(shapes, pa.list_(pa.float64()))],
                names=["digest", *LABELS, "features", "shape"],
            )

    once = sample.groupBy(F.sha2("text", 256).alias("digest")).agg(*[F.max(c).alias(c) for c in LABELS], F.first("text").alias("text"))
    return once.mapInArrow(rows, "digest string, low int, toxic int, features binary, shape array<double>")


def _feature_counts(sample: DataFrame) -> DataFrame:
    """name, n, n1: every feature with its documents and its bad documents."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch["features"]]
            bad = np.repeat(batch["bad"].to_numpy(), [len(f) for f in own])
            name, at = np.unique(np.concatenate(own), return_inverse=True) if own else (np.zeros(0, np.uint64),) * 2
            n, n1 = np.bincount(at.astype(np.int64), minlength=len(name)), np.bincount(at.astype(np.int64), bad, len(name))
            columns = [pa.array(name.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(n1.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "n", "n1"])

    counts = sample.select("bad", "features").mapInArrow(rows, "name bigint, n bigint, n1 bigint")
    return counts.groupBy("name").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def _chosen(sample: DataFrame, rate: float) -> np.ndarray:
    """Sorted features whose documents differ most in their share of bad ones."""
    share = (F.col("n1") + rate) / (F.col("n") + 1)
    gain = F.col("n") * (share * F.log(share / rate) + (1 - share) * F.log((1 - share) / (1 - rate)))
    counts = _feature_counts(sample).filter(F.col("n") >= LEAST_DOCS).withColumn("gain", gain)
    best = counts.filter(F.col("gain") >= LEAST_GAIN).orderBy(F.col("gain").desc(), "name").limit(FEATURES)
    return np.sort(best.select("name").toArrow()["name"].to_numpy().view(np.uint64))


def _cells(sample: DataFrame, chosen: np.ndarray) -> pa.Table:
    """digest, bad, shape, columns (the chosen features a text has) of the sample, in
    one order however it was read."""
    sent = shared(sample.sparkSession, chosen)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for batch in batches:
            held = [np.flatnonzero(np.isin(own, np.frombuffer(x.as_buffer(), np.uint64))).astype(np.int32) for x in batch["features"]]
            columns = [*(batch[c] for c in ("digest", "bad", "shape")), pa.array(held, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "bad", "shape", "columns"])

    # at most TRAIN_ROWS rows with FEATURES numbers each
    found = sample.mapInArrow(rows, "digest string, bad int, shape array<double>, columns array<int>").toArrow()
    return found.sort_by("digest")


def fit(bad: np.ndarray, shape: np.ndarray, held: list[np.ndarray], features: np.ndarray) -> Classifier:
    """Logistic regression by full-batch gradient steps. ``held`` are the numbers of
    the features that each text has."""
    rate, k = bad.mean(), len(features)
    centre, scale = np.median(shape, axis=0), shape.std(axis=0) + 1e-3
    model = Classifier(features, np.zeros(k + STATISTICS), centre, scale, float(np.log(rate / (1 - rate))))
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    col = np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64)
    dense = model.shapes(shape)
    w, b = np.zeros(k + STATISTICS), model.bias
    m, v = np.zeros(k + STATISTICS + 1), np.zeros(k + STATISTICS + 1)
    for step in range(1, ROUNDS + 1):
        z = b + np.bincount(row, w[col], minlength=len(bad)) + dense @ w[k:]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - bad) / len(bad)
        g = np.concatenate([np.bincount(col, error[row], minlength=k), error @ dense, [error.sum()]])
        g[:-1] += RIDGE * w / len(bad) * 100
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    model.weights, model.bias = w, float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Heads:
    """Fit on about ``rows`` labelled documents, picked by a hash of their id, of any
    length. Features are counted and chosen in Spark, for each label apart; the driver
    gets the chosen ones only. Equal texts weigh as one. Labels are (doc_id, quality,
    toxic); a null quality counts as good, a null toxic as harmless. A label that no
    document or every one has is not learned; without one that is learned every text has
    the evidence ``UNTRAINED``."""
    marks = {"low": F.coalesce("quality", F.lit(1)) == 0, "toxic": F.coalesce("toxic", F.lit(0)) == 1}
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(marks[c].cast("int")).alias(c) for c in LABELS])
    share = min(1.0, rows / max(1, known.count()))
    picked = known.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= min(2**63 - 1, int(share * 2.0**63)))
    # about ``rows`` rows, whatever the input's size
    sample = docs.join(F.broadcast(picked), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), *LABELS)
    sample = materialize(_features_of(sample), "quality-features")
    n, *marked = sample.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in LABELS]).first()
    heads = []
    for label, n_bad in zip(LABELS, marked, strict=True):
        if 0 < n_bad < n:
            own = sample.select("digest", F.col(label).alias("bad"), "features", "shape")
            chosen = _chosen(own, n_bad / n)
            cells = _cells(own, chosen)
            held = [np.array(x.as_py(), np.int32) for x in cells["columns"]]
            heads.append(fit(cells["bad"].to_numpy().astype(float), np.array(cells["shape"].to_pylist()), held, chosen))
    return Heads(heads)


def with_evidence(docs: DataFrame, model: Heads) -> DataFrame:
    """Replace ``text`` by ``evidence``, the classifier's log odds."""
    sent = shared(docs.sparkSession, model)
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "evidence double"])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent()
        for batch in batches:
            values = [own.evidence(part) for part in parts(t.as_py() for t in batch["text"])]
            values = np.concatenate(values) if values else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch[f.name] for f in kept), pa.array(values)], names=[*(f.name for f in kept), "evidence"]
            )

    return docs.mapInArrow(score, schema)


def _logit(p):
    return F.log(p / (1 - p))


def _strength(rate: str, around: str):
    """Beta strength by moments: how little the rates of well-filled sites spread."""
    spread = F.sum(F.col("n") * (F.col(rate) - F.col(around)) ** 2) / F.sum("n")
    noise = F.sum(F.col(around) * (1 - F.col(around))) / F.sum("n")
    mean = F.sum(F.col("n") * F.col(around)) / F.sum("n")
    excess = F.greatest(spread - noise, F.lit(1e-9))
    return F.least(F.greatest(mean * (1 - mean) / excess, F.lit(WEAKEST)), F.lit(STRONGEST))


def _sure(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))


def site_counts(scored: DataFrame) -> DataFrame:
    """host_key, path_key, p (probability of being bad) -> a row per path with the
    documents and sums of p of path, host and all (n, bad; host_n, host_bad; all_n,
    all_bad) and the strengths k_host and k_path of their shrinkage."""
    paths = scored.groupBy("host_key", "path_key").agg(F.count("*").alias("n"), F.sum("p").alias("bad"))
    paths = materialize(paths, "quality-paths")
    # one row each
    overall = F.broadcast(paths.agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad")))
    hosts = paths.groupBy("host_key").agg(F.sum("n").alias("host_n"), F.sum("bad").alias("host_bad")).crossJoin(overall)
    hosts = materialize(hosts, "quality-hosts")
    own = lambda c: F.col(f"{c}bad") / F.col(f"{c}n")
    spread = hosts.select(F.col("host_n").alias("n"), own("host_").alias("own"), _sure(own("all_")).alias("rate"))
    hosts = hosts.crossJoin(F.broadcast(spread.agg(_strength("own", "rate").alias("k_host"))))
    host_rate = _posterior("host_bad", "host_n", "k_host", _sure(own("all_")))
    paths = spread_join(paths, materialize(hosts, "quality-strong"), ["host_key"])
    spread = paths.select("n", own("").alias("own"), host_rate.alias("rate"))
    return materialize(paths.crossJoin(F.broadcast(spread.agg(_strength("own", "rate").alias("k_path")))), "quality-sites")


def _posterior(bad, n, k, around: Column) -> Column:
    """The rate of a site of ``n`` documents, shrunk toward the rate around it."""
    value = lambda c: F.col(c) if isinstance(c, str) else c
    return _sure((value(bad) + value(k) * around) / (value(n) + value(k)))


def site_rates(p: Column) -> tuple[Column, Column]:
    """The rates of a document's path and of all documents, from the columns of
    ``site_counts`` and without the document's own ``p``."""
    less = lambda c: (F.greatest(F.col(f"{c}bad") - p, F.lit(0.0)), F.col(f"{c}n") - 1)
    bad, n = less("all_")
    overall = F.when(n > 0, _sure(bad / n)).otherwise(_sure(p))
    bad, n = less("host_")
    host = _posterior(bad, n, "k_host", overall)
    bad, n = less("")
    return _posterior(bad, n, "k_path", host), overall


def url_sites(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, for ``classify``'s ``host`` and ``path``."""
    host, path = split_url(url)
    return host, F.regexp_extract(path, "^/[^/]*", 0)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and two site columns -> doc_id, evidence, site_rate, p_bad, kept,
    one row per row.

    ``host`` names the site column and ``path`` the finer one within a host; documents
    that have no URL give two flat columns for that hierarchy, such as source and
    language, others those of ``url_sites``. Null text: an empty text. Null host or path:
    a site of its own. Null doc_id: judged, never trained on. Very long texts: learned
    and judged whole. Repeated rows: judged alike. Without a label that some
    documents have and some lack no document is rejected. Empty table: no rows. Further columns are ignored, but those
    of ``carry``, whatever their names, are returned as one struct ``carried``.
    """
    carried = ("carried",) if carry else ()
    box = [F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col(host).alias("host"), F.col(path).alias("path"), *box)
    model = train(docs.select("doc_id", "text"), labels.select("doc_id", "quality", "toxic"))
    key = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    rows = docs.select("doc_id", *carried, key("host").alias("host_key"), key("path").alias("path_key"), "text")
    scored = with_evidence(rows, model).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    scored = materialize(scored, "quality-scored")
    site, overall = site_rates(F.col("p"))
    odds = F.col("evidence") + _logit(F.col("site_rate")) - _logit(F.col("rate"))
    judged = spread_join(scored, site_counts(scored), ["host_key", "path_key"]).withColumns({"site_rate": site, "rate": overall})
    return judged.select("doc_id", *carried, "evidence", "site_rate", (1 / (1 + F.exp(-odds))).alias("p_bad")).withColumn(
        "kept", F.col("p_bad") <= REJECT
    )


def op5(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
