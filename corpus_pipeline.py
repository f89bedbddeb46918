"""Corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from affinade.llm.common import crc_mod, delete, handed_out, scratch, table
from affinade.llm.decontaminate import drop_contaminated
from affinade.llm.language import keep_identified
from affinade.llm.near_duplicates import deduplicate
from affinade.llm.packing import pack_documents
from affinade.llm.queries import vocabulary
from affinade.llm.secrets import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
LANGUAGES = ("en",)  # that the corpus is made for
_used: list[str] = []  # scratch tables of the stage before, which nothing reads once its output is written


def tidy(stage: Stage) -> Stage:
    """Delete the scratch tables of the stage before: a stage is called when its predecessor's output is written."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _used:
            delete(spark, path)
        before = set(handed_out())
        out = stage(spark, docs, sf_dir)
        _used[:] = [p for p in handed_out() if p not in before] if stage is not best_fit_packing.__wrapped__ else []
        return out

    return run_stage


@tidy
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep LANGUAGES and what is too short or mixed to tell; the network learns from this stage's own documents."""
    return keep_identified(docs, crc_mod("doc_id", 3) != 1, LANGUAGES)


@tidy
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return deduplicate(docs, threshold=0.8)


@tidy
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


@tidy
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets; every document stays."""
    return redact(docs)


@tidy
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # language ID is learned and packing a sequence of sweeps: SQL can't express them


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
