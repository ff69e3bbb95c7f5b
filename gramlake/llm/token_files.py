"""Token-ID output (operator 7): ORC files of integer runs, in ascending id order.

Rows are ranged by id and sorted, so each file holds one id range: readers prune files and stripes by the footer's minimum
and maximum, and row groups by the row index and the Bloom filter on doc_id; stripes are read in parallel. `ids` is an
array<int> column, which ORC stores with integer run-length encoding. A document's `start` is its file's offset (the sum of
the files before it, one row a file) plus its offset in the file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PieceEncoder
from .common import shared_path, table

FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
#: Bytes of text that one file is made of, about.
PART_BYTES = 64 << 20


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, parts: int | None = None, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text", stride: int = 1000) -> None:
    """Writes the token files: `parts` of them, else one for about every `part_bytes` of text.

    Null text is an empty document (its end id alone); null ids come first; rows that share an id keep one row each, next to
    one another, and may be cut into several files; an empty table writes no rows; other columns are left out."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, at = PieceEncoder.get(tokenizer, "kept", 4), TaskContext.get().partitionId(), 0
        for b in batches:
            for k in range(0, b.num_rows, 500):
                c = b.slice(k, 500)
                flat, lens = enc.ended(c.column(1), end_id)
                ends = np.cumsum(lens)
                arr = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(np.full(len(lens), part, np.int32)), pa.array(at + ends - lens), pa.array(lens), arr], ["doc_id", "part", "local_start", "n_tokens", "ids"])
                at += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
        parts = -(-size // part_bytes) or 1
    (
        rows.withColumn("h", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", stride)
        .orc(out)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids; filters on doc_id reach the ORC reader."""
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # one row a file
    offsets = sizes.select("part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return files.join(F.broadcast(offsets), "part").select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """ids -> ids_crc32: crc32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            view = memoryview(np.ascontiguousarray(values, "<i4")).cast("B")
            sums = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "tokens") + ".orc"
    write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return checksums(read_token_files(spark, out))
