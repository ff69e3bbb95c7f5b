"""What an index holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def files(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "name")


def trigrams(postings: DataFrame) -> DataFrame:
    """Each trigram of the dictionary as three byte values."""
    t = F.col("trigram")
    byte = lambda k: F.shiftright(t, k).bitwiseAND(F.lit(255)).cast("long")
    return postings.select("trigram").distinct().select(byte(16).alias("b0"), byte(8).alias("b1"), byte(0).alias("b2"))
