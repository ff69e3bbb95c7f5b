"""Continuous indexing: each micro-batch of files becomes a small index of its own, a segment; segments are compacted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import storage
from ..functions.trigrams import Limits
from ..operators.index import TrigramIndex
from ..operators.merge import hashed
from ..operators.postings import with_dense_ids

#: Segments that are compacted into one.
SEGMENTS = 8
#: Ids of a segment in a view: below 2^40.
SEGMENT_BITS = 40


def stream_files(files: DataFrame, root: str, checkpoint: str, limits: Limits = Limits(), segments: int = SEGMENTS) -> StreamingQuery:
    """files: a streaming (name, content) DataFrame. A batch writes its own files only, as a segment below `root` that becomes
    visible as a whole; a batch that is run again after a failure replaces its segment. A name that comes again hides its older
    content. From `segments` segments on they are compacted into one, and older ones are deleted."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        before = [p for p in storage.versions(spark, root) if batch_of(p) < number]
        write_segment(TrigramIndex.build(spark, batch, limits=limits), root, number)
        if len(before) + 1 >= segments:
            compact(spark, root)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_of(path: str) -> int:
    return int(path.rsplit("/v", 1)[1].split("-")[0])


def write_segment(ix: TrigramIndex, root: str, number: int, kind: str = "batch") -> str:
    """Writes v<number>-<kind>, then publishes it. An unpublished or repeated one of that name is replaced."""
    spark, inner = ix.docs.sparkSession, f"{root}/.{kind}-{number:012d}"
    out = f"{root}/v{number:012d}-{kind}"
    storage.delete(spark, inner)
    storage.delete(spark, out)
    ix.write(inner, keep=1)
    fs, made = storage.folder(spark, storage.versions(spark, inner)[-1])
    fs.mkdirs(storage.folder(spark, root)[1])
    fs.rename(made, storage.folder(spark, out)[1])  # one step: the marker moves with the tables
    storage.delete(spark, inner)
    return out


def live_segments(spark: SparkSession, root: str) -> list[str]:
    """The segments that make up the index, oldest first: what a compaction covers is left out."""
    found = storage.versions(spark, root)
    done = max((batch_of(p) for p in found if p.endswith("-whole")), default=-1)
    return [p for p in found if batch_of(p) > done or p.endswith("-whole") and batch_of(p) == done]


def compact(spark: SparkSession, root: str) -> None:
    """All live segments as one, with dense ids; the former segments are deleted once it is visible."""
    old = live_segments(spark, root)
    if len(old) < 2:
        return
    view = latest(spark, root)
    ids = with_dense_ids(view.docs.select("name", F.col("doc_id").alias("old_id")), "name").select("old_id", "doc_id")
    again = lambda df: df.withColumnRenamed("doc_id", "old_id").join(hashed(ids), "old_id").drop("old_id")
    whole = TrigramIndex(view.paths, again(view.docs), again(view.postings), again(view.contents), view.skipped)
    write_segment(whole, root, batch_of(old[-1]), "whole")
    for p in old:
        storage.delete(spark, p)


def latest(spark: SparkSession, root: str) -> TrigramIndex | None:
    """The live segments as one index: ids carry their segment's number, and of a name only the newest segment's row is seen."""
    parts = [TrigramIndex.open_version(spark, p) for p in live_segments(spark, root)]
    if not parts:
        return None
    if len(parts) == 1:
        return parts[0]
    shown: dict[str, list[DataFrame]] = {name: [] for name in ("paths", "docs", "postings", "contents", "skipped")}
    newer: DataFrame | None = None
    for k in range(len(parts) - 1, -1, -1):
        ix = parts[k]
        names = ix.docs.select("name").unionByName(ix.skipped.select("name"))
        ident = (F.lit(k << SEGMENT_BITS) + F.col("doc_id")).alias("doc_id")
        docs, skipped = ix.docs, ix.skipped
        if newer is not None:
            docs, skipped = (df.join(newer, "name", "left_anti") for df in (docs, skipped))
        alive = docs.select("doc_id")
        for name, df in (("postings", ix.postings), ("contents", ix.contents)):
            df = df if newer is None else df.join(hashed(alive), "doc_id", "left_semi")
            shown[name].append(df.select(ident, *(c for c in df.columns if c not in ("doc_id", "bucket"))))
        shown["docs"].append(docs.select(ident, *(c for c in docs.columns if c != "doc_id")))
        shown["skipped"].append(skipped.select("name", "reason"))
        shown["paths"].append(ix.paths)
        newer = (names if newer is None else newer.unionByName(names)).distinct()
    union = {name: reduce(DataFrame.unionByName, dfs) for name, dfs in shown.items()}
    union["paths"] = union["paths"].distinct()
    return TrigramIndex(**union)
