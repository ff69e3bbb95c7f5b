"""Trigram queries as DataFrames over postings (trigram, doc_id)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.trigrams import packed
from .trigram_query import Query

MAX_FLAGS = 64


def candidates(q: Query, docs: DataFrame, postings: DataFrame) -> DataFrame:
    """Distinct doc_id of the documents that fulfil q: one pruned scan and one exchange for any tree."""
    if q.op == "all":
        return docs.select("doc_id").distinct()
    if q.op == "none":
        return docs.select("doc_id").where(F.lit(False))
    grams = sorted(q.trigrams())
    hits = postings.where(F.col("trigram").isin([packed(g) for g in grams]))
    if len(grams) > MAX_FLAGS:
        return hits.groupBy("doc_id").agg(F.collect_set("trigram").alias("held")).where(formula(q, lambda g: F.array_contains("held", packed(g)))).select("doc_id")
    flags = [F.bool_or(F.col("trigram") == packed(g)).alias(f"f{packed(g)}") for g in grams]
    return hits.groupBy("doc_id").agg(*flags).where(formula(q, lambda g: F.col(f"f{packed(g)}"))).select("doc_id")


def formula(q: Query, leaf) -> Column:
    parts = [leaf(g) for g in sorted(q.grams)] + [formula(s, leaf) for s in q.subs]
    return reduce((lambda a, b: a & b) if q.op == "and" else (lambda a, b: a | b), parts)


def bound(q: Query, counts: dict[int, int], n_docs: int) -> int:
    """How many documents can fulfil q at most, by the number of documents that hold each trigram."""
    if q.op in ("all", "none"):
        return n_docs if q.op == "all" else 0
    parts = [counts[packed(g)] for g in q.grams] + [bound(s, counts, n_docs) for s in q.subs]
    return min(parts) if q.op == "and" else min(n_docs, sum(parts))


def evaluated(q: Query, ids: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """The sorted ids that fulfil q, from each trigram's sorted ids."""
    parts = [ids(g) for g in q.grams] + [evaluated(s, ids) for s in q.subs]
    return reduce(np.intersect1d if q.op == "and" else np.union1d, sorted(parts, key=len))


def by_sets(q: Query, docs: DataFrame, postings: DataFrame) -> DataFrame:
    """The same by set operations, node by node: the lowering that tests compare with."""
    if q.op in ("all", "none"):
        return candidates(q, docs, postings)
    parts = [postings.where(F.col("trigram") == packed(g)).select("doc_id").distinct() for g in sorted(q.grams)] + [by_sets(s, docs, postings) for s in q.subs]
    return reduce(DataFrame.intersect, parts) if q.op == "and" else reduce(DataFrame.union, parts).distinct()
