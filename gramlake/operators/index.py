"""The trigram index: paths, docs, postings, contents and skipped, as tables.

On disk an index is a directory of versions; a version is written beside the others and becomes visible as a whole. Contents
are cut into buckets of consecutive ids (a partition column) and sorted within: a search reads only its candidates' buckets
and, of these, the row groups that can hold them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions.trigrams import Limits, numbered, packed
from ..plans.lower import bound, candidates, evaluated
from ..plans.regex import parse
from ..plans.trigram_query import ALL, Query, compiled
from . import merge as _merge
from . import search as _search
from .postings import doc_counts, encoded, list_offsets

SCHEMAS = {
    "paths": "path string",
    "docs": "doc_id long, name string, n_bytes long, n_trigrams int",
    "postings": "trigram int, doc_id long",
    "contents": "doc_id long, name string, content binary, bucket int",
    "skipped": "name string, reason string",
}
#: Bytes of contents in a bucket and in a row group, about, and buckets at most (each is a directory).
BUCKET_BYTES, GROUP_BYTES, BUCKETS = 128 << 20, 8 << 20, 4096
#: Candidates that become a list of ids in the scan's filter; more are joined.
FEW = 1000
#: Postings that a lookup brings to the driver at most; more are combined by Spark.
LOOKUP_ROWS = 200_000
#: Where at least one document in so many may match, all are scanned: a scan costs less than finding out.
SCAN_SHARE = 5


def default_location() -> str:
    """CSEARCHINDEX, else a fixed name in the home directory."""
    return os.environ.get("CSEARCHINDEX") or os.path.join(os.environ.get("HOME") or os.environ.get("USERPROFILE") or ".", ".csearchindex")


def _among(column: str, values: list[int]) -> Column:
    """Whether a column is one of these numbers: as text, which takes one call however many they are."""
    return F.expr(f"{column} IN ({', '.join(map(str, values))})") if values else F.lit(False)


def _columns(name: str) -> list[str]:
    return [x.split()[0] for x in SCHEMAS[name].split(", ")]


@dataclass
class TrigramIndex:
    paths: DataFrame
    docs: DataFrame
    postings: DataFrame
    contents: DataFrame
    skipped: DataFrame

    #: Ids are shifted by this many bits to give their bucket; None where contents have no buckets.
    shift: int | None = None
    #: Of a stored index: how many documents hold each trigram, and the number of documents.
    stats_table: DataFrame | None = None
    n_docs: int = 0
    known_counts: dict[int, int] = field(default_factory=dict)
    #: Whether contents lie in order of id already, so that no shuffle is needed to write them.
    in_order: bool = False

    @classmethod
    def build(cls, spark: SparkSession, files: DataFrame, roots: list[str] = (), limits: Limits = Limits(), id_col: str | None = None) -> TrigramIndex:
        """From (name, content) rows, content STRING or BINARY. Of repeated names the row with the least content hash is
        indexed. A row with an `error`, where there is such a column, is skipped for it. Ids are dense in order of name, or
        id_col's. Texts under three bytes are indexed without trigrams; skipped texts get no id.

        Contents are shuffled once, ranged by name; there, in order, repeated names go, texts are examined and numbered, and
        the result is written once: all tables derive from it, so ids agree however often they are computed."""
        content = F.col("content")
        content = F.encode(content, "UTF-8") if dict(files.dtypes)["content"] == "string" else content
        fault = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
        own = [F.col(id_col).cast("long").alias("own")] if id_col else []
        rows = files.select("name", *own, F.coalesce(content, F.lit(b"")).alias("content"), fault.alias("error"))
        ranged = rows.withColumn("h", F.xxhash64("content")).repartitionByRange("name").sortWithinPartitions("name", "h").drop("h")
        rows = storage.written(numbered(ranged, limits), "examined")
        good = rows.where("reason is null")
        if id_col:
            good = good.withColumnRenamed("own", "doc_id")
        else:
            sizes = good.groupBy("part").agg(F.count("*").alias("_c"))  # one row a task
            before = sizes.select("part", F.coalesce(F.sum("_c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
            good = good.join(F.broadcast(before), "part").withColumn("doc_id", F.col("_before") + F.col("local"))
        docs = good.select("doc_id", "name", F.octet_length("content").cast("long").alias("n_bytes"), F.size("grams").alias("n_trigrams"))
        return cls(
            spark.createDataFrame([(r,) for r in sorted(set(roots))], SCHEMAS["paths"]),
            docs,
            good.select(F.explode("grams").alias("trigram"), "doc_id"),
            good.select("doc_id", "name", "content"),
            rows.where("reason is not null").select("name", "reason"),
            in_order=not id_col,
        )

    def write(self, path: str, keep: int = 2) -> None:
        """Writes a new version and makes it visible in one step; `keep` versions stay, so an index may be written to the path
        that it was opened from, and readers of the former version are not disturbed.

        Postings are ranged and sorted by (trigram, doc_id): lookups prune files and row groups, and no frequent trigram is
        bound to one file. Contents go by bucket and id."""
        spark = self.docs.sparkSession
        out = storage.next_version(spark, path)
        for name in ("paths", "docs", "skipped"):
            getattr(self, name).select(*_columns(name)).write.parquet(f"{out}/{name}")
        self.postings.repartitionByRange("trigram", "doc_id").sortWithinPartitions("trigram", "doc_id").write.parquet(f"{out}/postings")
        posts = spark.read.schema(SCHEMAS["postings"]).parquet(f"{out}/postings")
        doc_counts(posts).repartitionByRange("trigram").sortWithinPartitions("trigram").write.parquet(f"{out}/counts")
        size = spark.read.schema(SCHEMAS["docs"]).parquet(f"{out}/docs").agg(F.max("doc_id").alias("top"), F.sum("n_bytes").alias("n"), F.count("*").alias("docs")).first()
        top, n = size["top"] or 0, size["n"] or 0
        buckets = min(BUCKETS, max(1, -(-n // BUCKET_BYTES)))
        shift = max(0, (top // buckets).bit_length())
        parts = max(buckets, min(spark.sparkContext.defaultParallelism, -(-n // GROUP_BYTES)), 1)
        rows = self.contents.select("doc_id", "name", "content", F.shiftright("doc_id", shift).cast("int").alias("bucket"))
        if self.in_order:
            pass
        elif size["docs"] == top + 1:  # ids are dense: their ranges are known without looking
            rows = rows.repartitionById(parts, F.expr(f"cast(doc_id * {parts} div {top + 1} as int)"))
        else:
            rows = rows.repartitionByRange(parts, "doc_id")
        rows = rows.sortWithinPartitions("bucket", "doc_id")
        rows.write.option("parquet.block.size", GROUP_BYTES).partitionBy("bucket").parquet(f"{out}/contents")
        spark.createDataFrame([(shift, size["docs"])], "shift int, n_docs long").coalesce(1).write.parquet(f"{out}/facts")
        storage.publish(spark, out)
        storage.prune(spark, path, keep)

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None) -> TrigramIndex:
        """The newest published version."""
        path = path or default_location()
        found = storage.versions(spark, path)
        if not found:
            raise FileNotFoundError(f"no index at {path}")
        return cls.open_version(spark, found[-1])

    @classmethod
    def open_version(cls, spark: SparkSession, path: str) -> TrigramIndex:
        tables = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}
        facts = spark.read.schema("shift int, n_docs long").parquet(f"{path}/facts").first()
        counts = spark.read.schema("trigram int, doc_count long").parquet(f"{path}/counts")
        return cls(**tables, shift=facts["shift"], stats_table=counts, n_docs=facts["n_docs"])

    @staticmethod
    def reset(spark: SparkSession, path: str | None = None) -> bool:
        """Deletes the index; whether there was one."""
        return storage.delete(spark, path or default_location())

    # Lookups

    def list_paths(self) -> DataFrame:
        return self.paths.orderBy("path")

    def posting_list(self, gram: bytes, restrict: DataFrame | None = None) -> DataFrame:
        found = self.postings.where(F.col("trigram") == packed(gram)).select("doc_id").distinct()
        return found if restrict is None else found.join(restrict.select("doc_id").distinct(), "doc_id", "left_semi")

    def and_(self, ids: DataFrame, gram: bytes, restrict: DataFrame | None = None) -> DataFrame:
        return ids.select("doc_id").distinct().join(self.posting_list(gram, restrict), "doc_id", "left_semi")

    def or_(self, ids: DataFrame, gram: bytes, restrict: DataFrame | None = None) -> DataFrame:
        """An unknown trigram leaves the ids as they are."""
        return ids.select("doc_id").unionByName(self.posting_list(gram, restrict)).distinct()

    def query(self, q: Query) -> DataFrame:
        return candidates(q, self.docs, self.postings)

    def stats(self) -> DataFrame:
        return self.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum(F.col("n_trigrams").cast("long")), F.lit(0)).alias("n_postings"))

    def trigram_stats(self) -> DataFrame:
        return doc_counts(self.postings)

    def dictionary(self, end: bool = False) -> DataFrame:
        """(trigram, doc_count, offset) of every list as encoded one after the other."""
        return list_offsets(self.postings, end, in_files=self.stats_table is not None)

    def encoded_lists(self) -> DataFrame:
        """(trigram, chunk, bytes): the encoded lists themselves."""
        return encoded(self.postings)

    def list_at(self, offset: int) -> DataFrame:
        """The dictionary entry whose encoded list starts there; none between two starts."""
        return self.dictionary().where(F.col("offset") == offset)

    # Search

    def candidates(self, pattern: str, ignore_case: bool = False, file_pattern: str | None = None, brute: bool = False, unicode: bool = False) -> DataFrame:
        """(doc_id, name) that may match; file_pattern filters names, unanchored and case-sensitive, before contents are read."""
        q = ALL if brute else compiled(parse(pattern, ignore_case, unicode), unicode)
        docs = self.docs.select("doc_id", "name")
        if file_pattern is not None:
            docs = docs.where(_search.matches(F.col("name"), file_pattern))
        return docs if q.op == "all" else docs.join(self.query(q), "doc_id", "left_semi")

    def _counts(self, grams: list[int]) -> dict[int, int]:
        """How many documents hold each trigram; a pattern's trigrams are few, and what was asked before is remembered."""
        if lost := [g for g in grams if g not in self.known_counts]:
            if len(self.known_counts) > 1 << 16:
                self.known_counts.clear()
                lost = grams
            found = dict(self.stats_table.where(_among("trigram", lost)).collect())
            self.known_counts.update({g: found.get(g, 0) for g in lost})
        return {g: self.known_counts[g] for g in grams}

    def _looked_up(self, q: Query) -> list[int] | DataFrame | None:
        """A stored index's candidates: a short list of ids, a DataFrame, or None where nearly all would have to be read."""
        counts = self._counts([packed(g) for g in sorted(q.trigrams())])
        if bound(q, counts, self.n_docs) * SCAN_SHARE >= self.n_docs > FEW:
            return None
        if sum(counts.values()) > LOOKUP_ROWS:
            return self.query(q)
        hits = self.postings.where(_among("trigram", sorted(counts))).toArrow()
        trigram, ids = hits["trigram"].to_numpy(), hits["doc_id"].to_numpy()
        return evaluated(q, lambda g: np.unique(ids[trigram == packed(g)])).tolist()

    def _rows(self, pattern: str, ignore_case: bool = False, file_pattern: str | None = None, brute: bool = False, unicode: bool = False) -> DataFrame:
        """The contents that must be searched: all, or those of the candidates. Up to FEW candidates reach the scan as filters on
        bucket and id; more are joined, by bucket and id, so that the scan can be pruned by what the other side holds."""
        q = ALL if brute else compiled(parse(pattern, ignore_case, unicode), unicode)
        rows = self.contents
        if q.op == "none":
            return rows.where(F.lit(False))
        if q.op == "all" and file_pattern is None:
            return rows
        if file_pattern is None and self.stats_table is not None:
            found = self._looked_up(q)
            if found is None:
                return rows
        else:
            found = self.candidates(pattern, ignore_case, file_pattern, brute, unicode).select("doc_id")
            few = [r[0] for r in found.limit(FEW + 1).collect()]
            found = few if len(few) <= FEW else found
        if isinstance(found, list) and len(found) > FEW:
            found = self.docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(found, pa.int64())}))
        if isinstance(found, list):
            if self.shift is not None:
                rows = rows.where(_among("bucket", sorted({i >> self.shift for i in found})))
            return rows.where(_among("doc_id", found))
        if self.shift is None:
            return rows.join(found, "doc_id", "left_semi")
        return rows.join(found.withColumn("bucket", F.shiftright("doc_id", self.shift).cast("int")), ["bucket", "doc_id"], "left_semi")

    def search(self, pattern: str, ignore_case: bool = False, file_pattern: str | None = None, brute: bool = False, max_count: int | None = None, unicode: bool = False) -> DataFrame:
        rows = self._rows(pattern, ignore_case, file_pattern, brute, unicode)
        return _search.matching_lines(rows, pattern, ignore_case, max_count, unicode)

    def search_files(self, pattern: str, **options) -> DataFrame:
        return _search.matching_files(self._rows(pattern, **options), pattern, options.get("ignore_case", False), options.get("unicode", False))

    def search_counts(self, pattern: str, **options) -> DataFrame:
        return self.search(pattern, **options).groupBy("doc_id", "name").agg(F.count("*").alias("n_lines"))

    def merge(self, newer: TrigramIndex, compat_prefix: bool = False) -> TrigramIndex:
        return _merge.merged(self, newer, compat_prefix)
