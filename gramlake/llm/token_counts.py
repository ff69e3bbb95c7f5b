"""Token counts (operator 6): lengths only, computed in Arrow functions.

Each Arrow batch is regrouped by UTF-8 bytes, long texts are split at safe boundaries and nothing but the counts leaves Python.
Null text counts as empty: zero bytes, zero tokens. Rows are never dropped, also not repeated ones; other columns are left out,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PieceEncoder
from .common import table


def token_count(text: Column, path: str, spaces: str = "kept") -> Column:
    """Number of tokens of each whole text (null: 0)."""

    @F.arrow_udf("long")
    def counts(a: pa.Array) -> pa.Array:
        enc = PieceEncoder.get(path, spaces, 4, 1_500_000)
        return pa.array(enc.encode(a, counts_only=True)[1])

    return counts(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. An empty table gives an empty result."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = token_count(F.col("_text"), path)
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    return out.select("doc_id", F.octet_length("_text").cast("long").alias("n_bytes"), n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
