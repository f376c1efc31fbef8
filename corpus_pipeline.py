"""The corpus pipeline: documents to packed token windows in five stages.

Every stage works on all that its predecessor kept, is written as Parquet and read
again; a stage's result must be written before the next stage is called, which deletes
the tables that the ones before have left in the shared folder. All stages but the
last return the columns of documents.

Decisions are made for rows, not for ids: the operators carry the whole row with their
verdict, so rows of one id, or of none, have each their own. All stages take nulls in
any column, empty and very long texts, repeated rows, empty tables and further columns
of any names, as their docstrings say.
"""

from __future__ import annotations

import threading
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.llm.common import materialize, scratch_tables, sweep
from pricewright.llm.jaccard import jaccard_components
from pricewright.llm.mixing import mix_sources
from pricewright.llm.packing import packed_pieces
from pricewright.llm.quality import classify
from pricewright.llm.rules import judge


class _Left(threading.local):
    """Tables that the stages so far have left, of each thread's own run."""

    def __init__(self):
        self.paths: list[str] = []


_LEFT = _Left()


def _stage(function):
    @wraps(function)
    def run_stage(spark, docs, sf_dir):
        sweep(_LEFT.paths)
        with scratch_tables() as own:
            found = function(spark, docs, sf_dir)
        _LEFT.paths.extend(own)
        return found

    return run_stage


@_stage
def quality_rules(spark, docs, sf_dir) -> DataFrame:
    """Drop the rows that the quality rules reject. Null and empty texts fail the base
    rules; null lang or source is a group of its own; repeated rows share a verdict."""
    return judge(docs, carry=docs.columns).filter("kept").select("carried.*")


@_stage
def quality_classifier(spark, docs, sf_dir) -> DataFrame:
    """Drop the rows that the quality classifier rejects; it learns from the labels
    table by doc_id. Rows without an id are judged and teach nothing; null text is an
    empty one; without labels of both kinds no row goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, carry=docs.columns).filter("kept").select("carried.*")


@_stage
def near_duplicates(spark, docs, sf_dir) -> DataFrame:
    """Keep one row of each group of near duplicates: that of the least doc_id (null
    last), of equals that of the least hash over all columns, so that another order of
    the same rows keeps the same. Rows without words are near to nothing and stay."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.xxhash64(*[docs[c] for c in docs.columns]).alias("digest"), F.struct(*[docs[c] for c in docs.columns]).alias("carried"))
    rows = materialize(rows, "pipeline-rows")
    row_id = F.struct(F.col("carried.doc_id").isNull().alias("no_id"), F.col("carried.doc_id").alias("id"), "digest", "row_no")
    found = jaccard_components(rows.select(row_id.alias("doc_id"), F.col("carried.text").alias("text")))
    kept = found.filter(F.col("doc_id.row_no") == F.col("component_id.row_no")).select("doc_id.row_no")
    return rows.join(kept, "row_no", "left_semi").select("carried.*")


@_stage
def source_mix(spark, docs, sf_dir) -> DataFrame:
    """Every row as often as the mix takes it: not at all, once, or twice. Rows without
    words are not taken; null source is a source of its own."""
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    taken = mix_sources(docs, carry=docs.columns).withColumn("copies", copies).filter("copies > 0")
    repeated = taken.select("carried", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select("carried.*")


@_stage
def token_windows(spark, docs, sf_dir) -> DataFrame:
    """Pack the rows' tokens into windows: one row per piece. Null and empty texts have
    the separator alone; every row is packed, repeated or not."""
    return packed_pieces(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("token windows", token_windows),
]

#: Tokens cannot be made in SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
