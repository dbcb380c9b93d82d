"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes each stage's result to the shared folder and reads it again, so a stage starts from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import jaccard_join, mixing, packing, quality_rules, substring_dedup
from vecspark.llm.shared import Scratch, load

#: Words of a passage that is removed where it repeats.
PASSAGE_WORDS = 40


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that the rules fail go, and then documents that they reject."""
    return quality_rules.apply_rules(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8 or more, that of the smallest id stays."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier go from the texts; a text of which nothing is left goes."""
    return substring_dedup.without_repeats(docs, window=PASSAGE_WORDS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time perhaps cut."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", passage_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the tokenizer of the last stage; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of the documents. A stage's table goes when the next one has read it."""
    docs, scratch, before = load(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
