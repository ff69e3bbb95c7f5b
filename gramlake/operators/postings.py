"""Posting lists: lists, deltas, encoded bytes, sizes and offsets.

A frequent trigram's list is never one task's: lists are cut into chunks by ranges of the document id, and what runs along a
whole list (positions, deltas, sums) is carried over from one row for each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Ids of a chunk: 2^20.
CHUNK_BITS = 20
# The longest encoded number and the trigram that ends a dictionary.
MAX_VARINT_BYTES, END_TRIGRAM = 10, 0xFFFFFF


def posting_lists(postings: DataFrame, chunk_bits: int | None = None) -> DataFrame:
    """(trigram, doc_ids) of each list; with chunk_bits (trigram, chunk, doc_ids), no row longer than a chunk."""
    keys = ["trigram"]
    if chunk_bits is not None:
        postings, keys = postings.withColumn("chunk", F.shiftright("doc_id", chunk_bits)), ["trigram", "chunk"]
    return postings.groupBy(*keys).agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def doc_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("trigram").agg(F.count("*").alias("doc_count"))


def deltas(postings: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(trigram, pos, delta): each id less the one before, the first less -1; a closing 0."""
    p = postings.select("trigram", "doc_id", F.shiftright("doc_id", chunk_bits).alias("chunk"))
    chunks = p.groupBy("trigram", "chunk").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    along = Window.partitionBy("trigram").orderBy("chunk")
    sums = along.rowsBetween(Window.unboundedPreceding, -1)
    start = chunks.select("trigram", "chunk", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("base"), F.lag("top", 1, -1).over(along).alias("prev"))
    inner = Window.partitionBy("trigram", "chunk").orderBy("doc_id")
    at, one = (F.col("base") + F.row_number().over(inner) - 1).cast("long"), F.col("doc_id") - F.coalesce(F.lag("doc_id").over(inner), F.col("prev"))
    rows = p.join(start, ["trigram", "chunk"]).select("trigram", at.alias("pos"), one.alias("delta"))
    ends = chunks.groupBy("trigram").agg(F.sum("n").alias("pos"), F.lit(0).cast("long").alias("delta"))
    return rows.unionByName(ends)


def decoded(d: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    d = d.where("delta > 0").withColumn("chunk", F.shiftright("pos", chunk_bits))
    chunks = d.groupBy("trigram", "chunk").agg(F.sum("delta").alias("t"))
    sums = Window.partitionBy("trigram").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    start = chunks.select("trigram", "chunk", F.coalesce(F.sum("t").over(sums), F.lit(0)).alias("base"))
    inner = Window.partitionBy("trigram", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return d.join(start, ["trigram", "chunk"]).select("trigram", (F.col("base") + F.sum("delta").over(inner) - 1).alias("doc_id"))


def varint_bytes(n: Column) -> Column:
    """Bytes of n in groups of seven bits."""
    return F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5).cast("long")


def varint_hex(n: Column) -> Column:
    """n as hexadecimal bytes of seven bits each, the lowest first; all but the last have the upper bit set."""
    last = varint_bytes(n).cast("int") - 1

    def byte(k: Column) -> Column:
        bits = F.call_function("shiftrightunsigned", n, k * 7).bitwiseAND(F.lit(127).cast("long"))
        return F.lpad(F.hex(bits + F.when(k < last, 128).otherwise(0)), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), last), byte), "")


def varint_value(hexa: Column) -> Column:
    """The number that the first encoded number of hexadecimal bytes says; null without an end in MAX_VARINT_BYTES bytes, or
    where it passes 64 bits."""
    one = F.transform(F.sequence(F.lit(0), F.least(F.length(hexa) / 2, F.lit(MAX_VARINT_BYTES)).cast("int") - 1), lambda k: F.conv(F.substring(hexa, 2 * k + 1, F.lit(2)), 16, 10).cast("long"))
    state = F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("k"), F.lit(False).alias("done"), F.lit(False).alias("lost"))

    def step(s: Column, b: Column) -> Column:
        over = (s["k"] == 9) & (b > 1)
        v = s["v"].bitwiseOR(F.call_function("shiftleft", b.bitwiseAND(F.lit(127)), s["k"] * 7))
        moved = F.struct(v.alias("v"), (s["k"] + 1).alias("k"), (b < 128).alias("done"), (s["lost"] | over).alias("lost"))
        return F.when(s["done"], s).otherwise(moved)

    return F.when(F.length(hexa) >= 2, F.aggregate(one, state, step, lambda s: F.when(s["done"] & ~s["lost"], s["v"])))


def encoded(postings: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(trigram, chunk, bytes): each list as it is encoded, the trigram's three bytes, its deltas and the closing zero, cut into
    chunks of 2^chunk_bits numbers; the chunks of a list one after the other are its bytes."""
    d = deltas(postings).withColumn("chunk", F.shiftright("pos", chunk_bits))
    one = F.sort_array(F.collect_list(F.struct("pos", varint_hex(F.col("delta")).alias("b"))))
    rows = d.groupBy("trigram", "chunk").agg(F.array_join(F.transform(one, lambda x: x["b"]), "").alias("h"))
    head = F.when(F.col("chunk") == 0, F.lpad(F.hex("trigram"), 6, "0")).otherwise("")
    return rows.select("trigram", "chunk", F.unhex(F.concat(head, "h")).alias("bytes"))


def list_sizes(postings: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(trigram, doc_count, n_bytes) of each encoded list: the trigram, its deltas and the closing zero. Postings are shuffled and
    sorted once; what crosses chunks is worked out from one row for each."""
    p = postings.select("trigram", "doc_id", F.shiftright("doc_id", chunk_bits).alias("chunk"))
    delta = F.col("doc_id") - F.lag("doc_id").over(Window.partitionBy("trigram", "chunk").orderBy("doc_id"))
    inner = F.coalesce(F.sum(F.when(F.col("delta").isNotNull(), varint_bytes(F.col("delta")))), F.lit(0)).alias("n_bytes")
    ends = F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")
    return _sizes(p.withColumn("delta", delta).groupBy("trigram", "chunk").agg(*ends, inner))


def stored_sizes(postings: DataFrame) -> DataFrame:
    """The same of postings that are read from files, sorted within and apart from one another by (trigram, doc_id), as an index
    writes them: without a shuffle of postings. A run is what a list holds in one part of a file."""
    source = F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("source")
    names = ["trigram", "first", "last", "n", "n_bytes"]

    def size(delta: np.ndarray) -> np.ndarray:
        return 1 + sum((delta >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, None  # the last run, which may go on
        for b in batches:
            trigram, doc, src = (b.column(c).to_numpy() for c in ("trigram", "doc_id", "source"))
            if not len(doc):
                continue
            start = np.flatnonzero(np.concatenate([[True], (trigram[1:] != trigram[:-1]) | (src[1:] != src[:-1])]))
            inner = np.concatenate([[0], size(np.diff(doc))])
            inner[start] = 0
            runs = np.stack([trigram[start], doc[start], doc[np.append(start[1:], len(doc)) - 1], np.diff(np.append(start, len(doc))), np.add.reduceat(inner, start)]).astype(np.int64)
            if key == (trigram[0], src[0]):
                runs[3, 0], runs[4, 0] = runs[3, 0] + kept[3], runs[4, 0] + kept[4] + size(runs[1, 0] - kept[2])
                runs[1, 0] = kept[1]
            elif kept is not None:
                runs = np.concatenate([kept[:, None], runs], axis=1)
            key, kept = (trigram[-1], src[-1]), runs[:, -1].copy()
            yield pa.RecordBatch.from_arrays([pa.array(runs[0, :-1].astype(np.int32)), *(pa.array(r[:-1]) for r in runs[1:])], names)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(kept[0])], pa.int32()), *(pa.array([int(v)], pa.int64()) for v in kept[1:])], names)

    return _sizes(postings.select("trigram", "doc_id", source).mapInArrow(run, "trigram int, first long, last long, n long, n_bytes long"))


def _sizes(runs: DataFrame) -> DataFrame:
    """(trigram, doc_count, n_bytes) from runs (trigram, first, last, n, n_bytes) of lists: their ends, length and the bytes within."""
    before = F.lag("last", 1, -1).over(Window.partitionBy("trigram").orderBy("first", "last"))
    joined = runs.withColumn("n_bytes", F.col("n_bytes") + varint_bytes(F.col("first") - before))
    return joined.groupBy("trigram").agg(F.sum("n").alias("doc_count"), (F.sum("n_bytes") + 4).alias("n_bytes"))


def list_offsets(postings: DataFrame, end: bool = False, in_files: bool = False) -> DataFrame:
    """(trigram, doc_count, offset): the dictionary, and where each encoded list starts; with `end` its last entry, the end
    trigram without documents. in_files: postings are read from a stored index. The dictionary has at most 2^24 rows at any scale;
    it is written, as it is read twice, and the running sum goes by blocks of the trigram's first byte, so no task holds it all."""
    sizes = written(stored_sizes(postings) if in_files else list_sizes(postings), "sizes")
    if end:
        sizes = sizes.unionByName(postings.sparkSession.createDataFrame([(END_TRIGRAM, 0, 4)], sizes.schema))
    sizes = sizes.withColumn("block", F.shiftright("trigram", 16))
    return running(sizes, "trigram", "n_bytes").select("trigram", "doc_count", "offset")


def running(rows: DataFrame, order: str, size: str, block: str = "block") -> DataFrame:
    """rows with `offset`, the sum of `size` over all rows before in the order of (block, order)."""
    w = Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(block).agg(F.sum(size).alias("_t"))
    before = totals.select(block, F.coalesce(F.sum("_t").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, block).withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)) + F.col("_before"))


def with_dense_ids(rows: DataFrame, order: str, id_col: str = "doc_id") -> DataFrame:
    """rows numbered from 0 in the order of a column; equal values share a number.

    The values are ranged, sorted and written once with their task's number and place in it; ids and the tasks' sizes both come
    from that table, so neither can differ from the other, however often the result is computed."""
    values = written(rows.select(order).distinct().repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()), "order")
    part = F.shiftright("_m", 33)
    sizes = values.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))  # one row a task
    before = sizes.select("_p", (F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    ids = values.withColumn("_p", part).join(F.broadcast(before), "_p").select(order, (F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias(id_col))
    return rows.join(ids, order)
