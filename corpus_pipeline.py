"""The corpus pipeline: quality classifier, quality rules, near-duplicates, repeated passages, packing.

Each stage takes all documents that its predecessor kept, and all but the last return the columns
of documents. A stage judges its own input only.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import ledger, minhash, packing, quality_lm, substring
from codeloom.llm.common import clear, dropped, made, mark, table, written


_left: list[str] = []


def _stage(f):
    """A stage that begins by clearing the tables of the stage before: a stage's result is written and read again before the next one begins."""

    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear([p for p in _left if p != getattr(docs, "_codeloom_path", None)])
        since = mark()
        out = f(spark, docs, sf_dir)
        _left[:] = made(since)
        return out

    return stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is over their language's limit go: each row by its own text, whatever its key."""
    return quality_lm.screened(docs, table(spark, sf_dir, "labels"))


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go: each row by its own text, whatever its key."""
    return ledger.screened(docs, 2)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their 5-word shingles, one row of the smallest doc_id stays."""
    return minhash.deduplicated(docs, shingle=5, percent=80)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier are cut out, row by row; n_chars follows where a text changes."""
    old = max(docs.columns, key=len) + "_"  # no column's name
    cut = substring.deduplicated(docs.withColumn(old, F.length("text")))
    return cut.withColumn("n_chars", F.when(F.length("text").eqNullSafe(F.col(old)), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))).select(*docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: SQL has no tokenizers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each written to the shared folder and read again: a row for each piece of a sequence.

    Every stage judges rows, not keys, so repeated and null doc_ids keep their own verdicts. Null texts
    pass the classifier and go by the rules (few words); empty tables give no rows.
    """
    docs = source = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), name)
        if docs is not source:
            dropped(docs)
        docs = kept
    last = STAGES[-1][1](spark, docs, sf_dir)
    _left.clear()  # the result needs them
    return last
