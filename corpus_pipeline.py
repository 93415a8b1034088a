"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing; each stage reads what the last one wrote."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import decontaminate, langid, linededup, packing, simhash
from lexiforge.llm.common import free_name, table
from lexiforge.store import mark, materialize, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def tidy(stage: Stage) -> Stage:
    """The stage; of the tables that it writes on its way only those stay that its result reads."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = mark(spark)
        out = stage(spark, docs, sf_dir)
        release(spark, before, out)
        return out

    return run


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the lang column of docs."""
    return langid.keep_known(docs, docs)


@tidy
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere, n_chars (if there is one) set anew; one of which no line is left goes."""
    n = free_name(docs, "n_removed")
    out = linededup.dedup_lines(docs, removed=n).where((F.col(n) == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, judged by what line dedup has left of the texts and by the texts of the table
    documents: of a near copy, line dedup has left only the lines that differ."""
    return simhash.keep_one(docs, whole=table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and token-budget batches."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Language ID, MinHash and SimHash have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written on its way goes once its result stands, and so does what it read."""
    docs, before = table(spark, sf_dir, "documents"), mark(spark)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(spark, before, docs)
    return docs
