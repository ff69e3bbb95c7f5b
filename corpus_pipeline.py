"""A training corpus from documents: five stages, each written and read again. Counted as part of subpackage llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gramlake.llm.common import table, written
from gramlake.llm.decontaminate import remove_benchmark
from gramlake.llm.language_id import fit_profiles, keep_identified, training_rows
from gramlake.llm.ngram_join import drop_near_copies
from gramlake.llm.packing import pack
from gramlake.llm.toxicity import fit_grammar, keep_clean, labelled_rows


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or without an n-gram of any known language."""
    return keep_identified(docs, fit_profiles(training_rows(docs)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the grammar, learned from the training fold of the labels, scores 0.3 or more."""
    return keep_clean(docs, fit_grammar(labelled_rows(docs, table(spark, sf_dir, "labels"))))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return drop_near_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold ten consecutive words of a benchmark item, or a whole shorter item."""
    return remove_benchmark(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens: one row per piece."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), forget=True)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("ngram_join", near_copy_stage),
    ("decontaminate", decontamination_stage),
    ("packing", packing_stage),
]

#: Language models, learned lexicons and tokenizers are beyond SQL; tests/llm/ holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
