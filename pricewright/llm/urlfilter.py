"""URL filters: rules, and a Bloom filter cascade over listed hosts.

The cascade's first level encodes the listed keys. Its false positives over the
corpus's complete key universe are encoded by the second level, the listed keys
that pass the second by the third, and so on until a level has none. The first level
that a key misses then tells exactly whether it is listed: for every key of the
universe the answer is that of a join with the list, without the join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, shared, spread_join

BITS_PER_KEY, PROBES = 10, 5
#: Bits a level may have (128 MB); a longer list is dealt to several cascades.
MAX_BITS = 1 << 30

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The contract's rules: verdict, host, path prefix.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Hosts listed as unwanted, subdomains included, where no other list is given.
LISTED = (
    "adult-x.example.com",
    "ads-track.example.com",
    "casino-win.example.net",
    "cheap-pills.example.com",
    "cheap-pills.example.net",
    "free-bets.example.net",
    "spam-farm.example.org",
)


def _positions(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Probe positions [key, probe] by double hashing of 64-bit key hashes."""
    x = hashes.astype(np.int64).view(np.uint64) + np.uint64((level * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    b = (a ^ (a >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((a[:, None] + steps * b[:, None]) % np.uint64(bits)).astype(np.int64)


@dataclass
class Cascade:
    """Levels as 64-bit words; level 0 encodes listed keys."""

    levels: list[np.ndarray]

    def passes(self, hashes: np.ndarray, level: int) -> np.ndarray:
        words = self.levels[level]
        at = _positions(hashes, level, 64 * len(words))
        return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        """Of each hash of a key of the universe, whether the key is listed."""
        out = np.full(len(hashes), len(self.levels) % 2 == 1)
        left = np.arange(len(hashes))
        for level in range(len(self.levels)):
            passed = self.passes(hashes[left], level)
            out[left[~passed]] = level % 2 == 1
            left = left[passed]
        return out


def key_hash(key: Column, seed: int = 0) -> Column:
    return F.xxhash64(key, F.lit(seed)) if seed else F.xxhash64(key)


def _level(keys: DataFrame, level: int, bits: int) -> np.ndarray:
    """The level's words: partial ones per batch, joined by OR in Spark."""

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_positions(batch["h"].to_numpy(), level, bits))
            mask = np.uint64(1) << (at & 63).astype(np.uint64)
            word, first = np.unique(at >> 6, return_index=True)
            mask = np.bitwise_or.reduceat(mask, first) if len(first) else mask
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    # at most bits / 64 rows reach the driver
    found = keys.mapInArrow(words, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("m")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64).view(np.uint64)
    return out


def _passing(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    sent = shared(keys.sparkSession, Cascade(list(cascade.levels)))

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent()
        for h in batches:
            yield pd.Series(own.passes(h.to_numpy(np.int64), level))

    return keys.filter(passes("h"))


def _hashed(universe: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Keys of the universe that are not listed, and listed keys, each with ``h``, and
    the hash's seed: the first under which no two keys on different sides are equal."""
    keys = materialize(universe.select("key").filter("key IS NOT NULL").distinct(), "url-universe")
    wanted = materialize(listed.select("key").filter("key IS NOT NULL").distinct(), "url-listed")
    others = keys.join(wanted, "key", "left_anti")
    seed = 0
    while True:
        a, b = (rows.withColumn("h", key_hash(F.col("key"), seed)) for rows in (others, wanted))
        if a.select("h").join(b.select("h"), "h", "left_semi").isEmpty():
            return a, b, seed
        seed += 1


def _cascade(others: DataFrame, wanted: DataFrame) -> Cascade:
    cascade, encoded, opposite = Cascade([]), wanted.select("h"), others.select("h")
    while True:
        n, level = encoded.count(), len(cascade.levels)
        cascade.levels.append(_level(encoded, level, max(64, -(-n * BITS_PER_KEY // 64) * 64)))
        false_positives = materialize(_passing(opposite, cascade, level), "url-level")
        if false_positives.isEmpty():
            return cascade
        encoded, opposite = false_positives, encoded


def build_cascades(universe: DataFrame, listed: DataFrame) -> tuple[list[Cascade], int]:
    """Cascades that are exact for every ``key`` of ``universe``, and the hash's seed.

    Both have a column ``key``. Null keys are in neither set. Keys are dealt to as many
    cascades, by a remainder of their hash, as keep a level within ``MAX_BITS``."""
    others, wanted, seed = _hashed(universe, listed)
    n = -(-max(1, wanted.count()) * BITS_PER_KEY // MAX_BITS)
    own = lambda rows, i: rows.filter(F.pmod("h", F.lit(n)) == i)
    return [_cascade(own(others, i), own(wanted, i)) for i in range(n)], seed


def _is_listed(cascade: Cascade, spark):
    sent = shared(spark, cascade)

    @F.pandas_udf(T.BooleanType())
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent()
        for h in batches:
            yield pd.Series(own.listed(h.to_numpy(np.int64)))

    return listed("h")


def listed_keys(keys: DataFrame, cascades: list[Cascade], seed: int) -> DataFrame:
    """The rows of ``keys`` (a column ``key`` of the universe) that are listed: each
    cascade is sent out on its own and asked for its own keys."""
    hashed = keys.withColumn("h", key_hash(F.col("key"), seed))
    part = F.pmod("h", F.lit(len(cascades)))
    found = [hashed.filter(part == i).filter(_is_listed(c, keys.sparkSession)) for i, c in enumerate(cascades)]
    return reduce(DataFrame.unionByName, found).drop("h")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL as in the contract; empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    labels = F.split(host, "[.]")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def _rule_fits(host: Column, path: Column, rule) -> Column:
    _, rule_host, rule_path = rule
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def _any_listed(cascade: Cascade, seed: int, spark) -> Column:
    """Whether the host or a parent domain is listed, by one cascade for all keys."""
    sent = shared(spark, cascade)

    @F.pandas_udf(T.BooleanType())
    def any_listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent()
        for keys in batches:
            sizes = keys.str.len().to_numpy(np.int64)
            if not len(sizes):
                yield pd.Series([], dtype=bool)
                continue
            hits = own.listed(np.concatenate(keys.to_list()).astype(np.int64))
            yield pd.Series(np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes) - sizes) > 0)

    return any_listed(F.transform(host_suffixes(F.col("host")), lambda key: key_hash(key, seed)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url -> page_id, host, path, rule, listed, verdict, one row per row.

    The longest fitting rule decides; without one, a host that is listed, or under a
    listed domain, is blocked and any other allowed. ``listed`` has a column ``key``
    of domains in lower case. Each host is looked up once. Null url, or one without ``://``: empty host and path,
    allowed unless a rule fits. Null page_id, repeated rows: judged like others.
    Empty table: no rows. Further columns of ``pages`` are ignored.
    """
    host, path = split_url(F.col("url").cast("string"))
    rows = materialize(pages.select("page_id", host.alias("host"), path.alias("path")), "url-rows")
    # distinct hosts first: a hot host is one row from here on
    hosts = materialize(rows.select("host").distinct(), "url-hosts")
    keys = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("key"))
    cascades, seed = build_cascades(keys.select("key"), listed)
    if len(cascades) > 1:
        bad = listed_keys(keys, cascades, seed).select("host").distinct().withColumn("listed", F.lit(True))
        known = hosts.join(bad, "host", "left").select("host", F.coalesce("listed", F.lit(False)).alias("listed"))
    else:
        known = hosts.select("host", _any_listed(cascades[0], seed, hosts.sparkSession).alias("listed"))
    known = materialize(known, "url-known")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones take precedence
        fits = _rule_fits(F.col("host"), F.col("path"), r)
        rule = F.when(fits, r[1] + r[2]).otherwise(rule)
        verdict = F.when(fits, r[0]).otherwise(verdict)
    return (
        spread_join(rows, known, ["host"])
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
        .select("page_id", "host", "path", "rule", "listed", "verdict")
    )


def listed_hosts(spark, hosts=LISTED) -> DataFrame:
    return spark.createDataFrame([(h,) for h in hosts], "key string")


def op10(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, listed_hosts(spark)).select("page_id", "host", "path", "rule", "verdict")


def op10_sql(pages: str = "pages") -> str:
    longest_first = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    named = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}'"
        for _, h, p in longest_first
    )
    verdicts = "CASE rule " + " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in RULES) + " END"
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED)
    return rf"""
WITH split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM {pages}),
ruled AS (SELECT *, CASE {named} END AS rule FROM split)
SELECT page_id, host, path, rule,
  coalesce({verdicts}, CASE WHEN {listed} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""
