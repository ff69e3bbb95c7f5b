"""N-gram Jaccard join (operator 10): exact links and classes of texts whose shingle sets are alike.

1. One pass makes each text's set size and key (a 128-bit hash of the set) and sums a fixed table of counters over all
   shingles. Texts with equal sets are one node, the one with the smallest id.
2. Shingles are ordered by their counter, rare ones first. Two sets that reach the threshold share a shingle among the
   first n - ceil(t n) + 1 of each, so only those become postings, each with the set's size; a set's bitmap (its shingles'
   parity over 2048 bits) is kept beside.
3. A bucket is cut into size bands: in order of its different sizes, wherever two neighbours alone rule a link out. First each row
   meets only its band's smallest id. The bitmaps' differing bits
   bound the overlap from above; sorted arrays decide what is left. The links' components are labelled.
4. Then all pairs of a band whose labels still differ are compared, in tiles of bounded size, and the components finished.
   A pair within one component needs no look: its link would change nothing.
No step emits all pairs of a group, no cap drops one, and no table of nodes or links reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_broadcast, give_back, lean, table, written
from .linking import components, tiles, tiles_in_turn

SKETCH_BITS = 20
CHUNK = 1 << 14
BITS = 2048
#: Ids whose list is broadcast at most (16 MB); beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class WordHash(dict):
    """word -> 64-bit hash, forgotten beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHash()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased, words split at ASCII white space).

    Of a text with fewer words, but not none, the whole sequence is the one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = (x ^ h[i : len(h) - k + 1 + i]) * MIX[0]
        x ^= x >> np.uint64(29)
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    return np.unique((x ^ (x >> np.uint64(27))) * MIX[2])


def bitmap(s: np.ndarray) -> bytes:
    """The parity of the shingles that fall on each of BITS bits."""
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def slot(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def overlaps(a: int, b: int, num: int, den: int) -> int:
    """The least overlap of sets of a and b elements with Jaccard similarity num / den."""
    return -(-num * (a + b) // (num + den))


class NgramJoin:
    """Exact Jaccard links between texts: intersection / union >= num / den over `width`-word shingles."""

    def __init__(self, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"):
        self.width, self.num, self.den = width, num, den
        self.spark = docs.sparkSession
        bounded_batches(docs.sparkSession)
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    # Step 1

    def profile(self) -> tuple[DataFrame, np.ndarray]:
        """(id, n, k1, k2) of every row, and the shingles' order class by counter (one byte for each of 2^20 counters)."""
        width = self.width

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << SKETCH_BITS, np.int64)
            for b in batches:
                sizes, k1, k2 = [], [], []
                for t in b.column(1).to_pylist():
                    s = shingles(t, width)
                    key = xxhash.xxh3_128_intdigest(s.tobytes())
                    sizes.append(len(s))
                    k1.append((key & (2**64 - 1)) - 2**63)
                    k2.append((key >> 64) - 2**63)
                    np.add.at(total, slot(s), 1)
                none = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), *none], ["id", "n", "k1", "k2", "chunk", "counts"])
            if total.any():
                parts = total.reshape(-1, CHUNK)
                none = pa.nulls(len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(len(parts)), pa.int32()), pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary())], ["id", "n", "k1", "k2", "chunk", "counts"])

        def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(CHUNK, np.int64)
            for b in batches:
                for x in b.column("counts").to_pylist():
                    total += np.frombuffer(x, "<u4")
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(255, 6 * np.log2(1 + total)).astype(np.uint8).tobytes()], pa.binary())], ["chunk", "level"])

        made = written(self.docs.mapInArrow(lean(rows), "id long, n long, k1 long, k2 long, chunk int, counts binary"), "sets")
        level = np.zeros(1 << SKETCH_BITS, np.uint8)  # of a fixed size at any scale
        for r in made.where("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, level binary").collect():
            level[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["level"], np.uint8)
        return made.where("chunk is null").select("id", "n", "k1", "k2"), level

    # Step 2

    def prefixes(self, level: np.ndarray) -> DataFrame:
        """(id, n, bits, keys) of every row with enough shingles to be like a different set."""
        width, num, den = self.width, self.num, self.den
        least = next(n for n in range(1, 1000) if (n - 1) * den >= num * n)  # smaller sets are like equal ones only
        held = self.spark.sparkContext.broadcast(level)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    s = shingles(t, width)
                    n = len(s)
                    if i is None or n < least - 1:
                        continue
                    p = n - -(-num * n // den) + 1
                    order = np.lexsort((s, held.value[slot(s)]))[:p]
                    out.append((i, n, bitmap(s), s[order].view(np.int64)))
                keys = [x[3] for x in out]
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "n", "bits", "keys"])

        return self.docs.mapInArrow(lean(rows), "id long, n long, bits binary, keys array<long>")

    # Steps 3 and 4

    def like_sized(self, a: str, b: str):
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def bounded(self, pairs: DataFrame, bits: DataFrame) -> DataFrame:
        """pairs (a, na, b, nb) that the bitmaps leave possible."""
        num, den = self.num, self.den

        @F.arrow_udf("boolean")
        def possible(x: pa.Array, y: pa.Array, na: pa.Array, nb: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.bool_())
            u, v = (np.frombuffer(b"".join(z.to_pylist()), np.uint64).reshape(len(z), -1) for z in (x, y))
            apart = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
            total = na.to_numpy(zero_copy_only=False) + nb.to_numpy(zero_copy_only=False)
            return pa.array((total - apart) // 2 * (num + den) >= num * total)

        for side in ("a", "b"):
            pairs = pairs.join(bits.select(F.col("id").alias(side), F.col("bits").alias(f"bits_{side}")), side)
        return pairs.where(possible("bits_a", "bits_b", "na", "nb")).select("a", "b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The written pairs (a, b) whose sets reach the threshold, by intersecting their sorted arrays."""
        width, num, den = self.width, self.num, self.den
        ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "s"])

        arrays = self.docs.join(bounded_broadcast(ids, ids.count(), BROADCAST_IDS), "id", "left_semi").mapInArrow(lean(rows), "id long, s binary")

        @F.arrow_udf("boolean")
        def alike(x: pa.Array, y: pa.Array) -> pa.Array:
            out, last, at = [], None, None
            for p, q in zip(x, y, strict=True):
                p, q = p.as_py(), q.as_py()
                if p != last:
                    last, at = p, np.frombuffer(p, np.uint64)
                other = np.frombuffer(q, np.uint64)
                k = np.searchsorted(at, other)
                k[k == len(at)] = 0
                n = int((at[k] == other).sum()) if len(at) else 0
                out.append(den * n >= num * (len(at) + len(other) - n))
            give_back()
            return pa.array(out, pa.bool_())

        got = pairs.join(arrays.withColumnsRenamed({"id": "b", "s": "sb"}), "b").join(arrays.withColumnsRenamed({"id": "a", "s": "sa"}), "a")
        return written(got.where(alike("sa", "sb")).select("a", "b"), "links")

    @cached_property
    def parts(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Written once: all rows; the different sets; their bitmaps; their bands' rows (key, seg, id, n; a, na: the band's
        smallest id)."""
        num, den = self.num, self.den
        rows, level = self.profile()
        sets = written(rows.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.min("n").alias("n")), "nodes")
        made = written(self.prefixes(level).join(sets.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "prefixes")
        post = made.select("id", "n", F.explode("keys").alias("key"))
        # Bands are cut from the different sizes of a key, each counted once, not from its rows: no key is sorted in one task.
        sizes = post.groupBy("key", "n").agg(F.count("*").alias("c"), F.min("id").alias("lo"))
        by_size, band = Window.partitionBy("key").orderBy("n"), Window.partitionBy("key", "seg")
        apart = F.coalesce(F.lag("n").over(by_size) * den < F.col("n") * num, F.lit(False)).cast("int")
        sizes = sizes.withColumn("apart", apart).withColumn("seg", F.sum("apart").over(by_size.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        first = F.min(F.struct("lo", "n")).over(band)
        bands = sizes.select("key", "n", "seg", F.sum("c").over(band).alias("rows"), first.alias("f")).where("rows > 1")
        hits = post.join(bands.select("key", "n", "seg", F.col("f.lo").alias("a"), F.col("f.n").alias("na")), ["key", "n"])
        return rows, sets, made.select("id", "bits"), written(hits.select("key", "seg", "id", "n", "a", "na"), "hits")

    def met(self, seen: DataFrame, bits: DataFrame) -> DataFrame:
        """The written links among all pairs of a band (key, seg, id, n, component) whose components differ."""
        num, den = self.num, self.den
        mixed = seen.groupBy("key", "seg").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
        spread = seen.join(mixed.select("key", "seg", "rows"), ["key", "seg"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in tiles_in_turn(batches, ["key", "seg", "t1", "t2"]):
                n, c, i, side = (t.column(x).to_numpy() for x in ("n", "component", "id", "side"))
                u = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
                for k in range(len(n) - 1):
                    rest = slice(k + 1, None)
                    ok = c[rest] != c[k]
                    if t.column("t1")[0] != t.column("t2")[0]:
                        ok &= side[rest] != side[k]
                    ok &= np.minimum(n[rest], n[k]) * den >= np.maximum(n[rest], n[k]) * num
                    j = np.flatnonzero(ok) + k + 1
                    if not len(j):
                        continue
                    apart = np.bitwise_count(u[j] ^ u[k]).sum(axis=1, dtype=np.int64)
                    total = n[j] + n[k]
                    j = j[(total - apart) // 2 * (num + den) >= num * total]
                    if len(j):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i[j], i[k])), pa.array(np.maximum(i[j], i[k]))], ["a", "b"])

        tiled = tiles(spread, ["key", "seg"]).join(bits, "id").select("key", "seg", "t1", "t2", "side", "id", "n", "component", "bits")
        pairs = tiled.repartition("key", "seg", "t1", "t2").sortWithinPartitions("key", "seg", "t1", "t2").mapInArrow(lean(meet), "a long, b long")
        return self.verified(written(pairs.distinct(), "pairs"))

    def links(self) -> DataFrame:
        """(a, b), a < b: every link between different sets, each told by the smallest id that has it; see members().

        For joins that need the links themselves: a class of n sets that are all alike has n (n - 1) / 2 of them."""
        _, _, bits, hits = self.parts
        return self.met(hits.select("key", "seg", "id", "n", F.col("id").alias("component")), bits)

    def members(self) -> DataFrame:
        """(id, rep) of every row with shingles: the smallest id that has the same set, which links() tells it by."""
        rows, sets, _, _ = self.parts
        return rows.where("id is not null").join(sets.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep")

    def classes(self) -> DataFrame:
        """(id, n_shingles, component_id): one row per input row.

        component_id is the smallest id reachable by links; equal sets are linked, empty sets with nothing. Null ids get a
        null component. Rows that share an id are one node of the graph, with the sets of all of them. Links within a class are
        not looked for (links() lists all); an empty table gives no rows; other columns are left out, whatever their names."""
        rows, sets, bits, hits = self.parts
        star = hits.where("id <> a").where(self.like_sized("n", "na")).select("a", "na", F.col("id").alias("b"), F.col("n").alias("nb")).distinct()
        links = self.verified(written(self.bounded(star, bits), "pairs"))
        label = written(components(links), "labels")
        more = self.met(hits.select("key", "seg", "id", "n").join(label, "id", "left").withColumn("component", F.coalesce("component", "id")), bits)
        final = components(links.unionByName(more))
        nodes = sets.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
        alone = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
        return rows.join(nodes, ["k1", "k2"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, alone).otherwise(F.col("id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near copies of an earlier one: of each class the smallest doc_id stays; all columns as they are.

    Rows without an id stay; of rows that share an id all stay or go; columns of any name stay as they are."""
    gone = NgramJoin(docs, width, num, den).classes().where("id <> component_id").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = NgramJoin(table(spark, sf_dir, "documents"), width=3, num=90, den=100).classes()
    return found.withColumnRenamed("id", "doc_id")


# DuckDB: all pairs of distinct sets by a plain join of shingles, then the links' transitive closure.
OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(a[k : k + 2], ' ') AS g
    FROM (SELECT doc_id, a, unnest(range(1, GREATEST(1, len(a) - 2) + 1)) AS k FROM w WHERE len(a) > 0))
), n AS (
  SELECT doc_id, COUNT(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id
), r AS (
  SELECT h, MIN(doc_id) AS rep, MIN(n) AS n FROM n GROUP BY h
), i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
  WHERE x.doc_id IN (SELECT rep FROM r) AND y.doc_id IN (SELECT rep FROM r) GROUP BY 1, 2
), l AS (
  SELECT a, b FROM i JOIN r p ON p.rep = a JOIN r q ON q.rep = b WHERE 100 * c >= 90 * (p.n + q.n - c)
), e AS (
  SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l
), t AS (
  SELECT rep AS u, rep AS v FROM r UNION SELECT t.u, e.v FROM t JOIN e ON t.v = e.u
), c AS (
  SELECT u, MIN(v) AS m FROM t GROUP BY u
)
SELECT w.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(c.m, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (h) LEFT JOIN c ON c.u = r.rep
"""
