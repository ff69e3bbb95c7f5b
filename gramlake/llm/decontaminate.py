"""Benchmark decontamination (operator 8): one Aho-Corasick automaton over the normalised items' windows.

A text is normalised by one byte translation that keeps every offset: A-Z become a-z and all bytes that are no word bytes
become spaces (bytes above 0x7F belong to words). Its words joined by single spaces are scanned once; a hit's words map
back to byte offsets of the original. The items travel as one broadcast table. Where their windows pass AUTOMATON_BYTES the
items are dealt into parts, and the documents are scanned once for each part, one after the other: a task holds one automaton
at a time, and no benchmark is refused or cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, lean, table, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of the windows in one automaton, about (it takes some fifty times that in a worker).
AUTOMATON_BYTES = 4 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
BETWEEN = "doc_id long, text string, ranges array<struct<first:int,last:int>>, items array<string>"


def normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


def windows_of(words: list[bytes], width: int) -> list[bytes]:
    """Consecutive windows of an item; one of fewer words, but not none, is a single window."""
    if not words:
        return []
    return [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]


def automaton(items: list[tuple[str, str | None]], width: int):
    """The automaton of all windows; each carries its number of words and the ids of its items. None without windows."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows_of(normal(text).split(), width):
            owners.setdefault(w, set()).add(item)
    if not owners:
        return None
    auto = ahocorasick.Automaton()
    for w, ids in owners.items():
        auto.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(ids))))
    auto.make_automaton()
    return auto


def hits(text: str | None, auto) -> tuple[list[bytes], list[tuple[int, int]], set[str]]:
    """A text's words, the ranges of words (first, last) that windows occur in, and the items of these windows."""
    words = normal(text).split()
    if not words or auto is None:
        return words, [], set()
    line = f" {b' '.join(words).decode('latin-1')} "
    found = list(auto.iter(line))
    if not found:
        return words, [], set()
    breaks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)  # breaks[k] stands before word k
    last = np.searchsorted(breaks, [end for end, _ in found]) - 1
    return words, [(int(k) - n + 1, int(k)) for k, (_, (n, _)) in zip(last, found, strict=True)], {i for _, (_, ids) in found for i in ids}


def told(text: str | None, n_words: int, ranges: list[tuple[int, int]], spans: bool) -> tuple[int, list[tuple[int, int]]]:
    """Hit words and (if asked for) the hit spans as character offsets of the original text."""
    if not ranges:
        return 0, []
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, [a for a, _ in ranges], 1)
    np.add.at(change, [b + 1 for _, b in ranges], -1)
    hit = np.cumsum(change[:-1]) > 0
    places = []
    if spans:
        at = [m.span() for m in WORD.finditer(normal(text))]
        raw = (text or "").encode("utf-8", "surrogatepass")
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            first = len(raw[: at[a][0]].decode("utf-8", "surrogatepass"))
            places.append((first, first + len(raw[at[a][0] : at[b - 1][1]].decode("utf-8", "surrogatepass"))))
    return int(hit.sum()), places


def benchmark_parts(items: DataFrame, item_col: str, item_text: str, width: int, bound: int) -> Iterator[Broadcast]:
    """The items in parts whose windows have about `bound` bytes at most, each broadcast."""
    held = items.select(F.col(item_col).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    size = held.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-size * width // bound) or 1
    for k in range(parts):
        some = held if parts == 1 else held.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield items.sparkSession.sparkContext.broadcast([tuple(r) for r in some.collect()])


def find_benchmark(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", spans: bool = True, bound: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated and the hit spans in the original text.

    Null or wordless texts have no words and no hits; null or wordless items have no windows; repeated rows give repeated
    rows; without items nothing is contaminated; an empty table gives no rows; other columns are left out, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("array<struct<first:int,last:int>>").alias("ranges"), F.lit(None).cast("array<string>").alias("items"))
    parts = list(benchmark_parts(items, item_col, item_text, width, bound))

    def scanned(known: Broadcast, last: bool) -> Callable:
        made: list = []

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(automaton(known.value, width))
            for b in batches:
                out = []
                for text, old, ids in zip(*(b.column(x).to_pylist() for x in ("text", "ranges", "items")), strict=True):
                    words, ranges, found = hits(text, made[0])
                    ranges += [(r["first"], r["last"]) for r in old or ()]
                    out.append((text, len(words), ranges, sorted(found.union(ids or ()))))
                yield result(b.column("doc_id"), out) if last else between(b.column("doc_id"), out)

        return match

    def between(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        ranges = pa.array([[{"first": a, "last": b} for a, b in set(r)] for _, _, r, _ in out], kind)
        return pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in out], pa.string()), ranges, pa.array([x[3] for x in out], pa.list_(pa.string()))], ["doc_id", "text", "ranges", "items"])

    def result(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        seen = [told(text, n, ranges, spans) for text, n, ranges, _ in out]
        columns = [
            ids,
            pa.array([x[1] for x in out], pa.int64()),
            pa.array([n for n, _ in seen], pa.int64()),
            pa.array([len(x[3]) for x in out], pa.int64()),
            pa.array([hashlib.sha256(",".join(x[3]).encode()).hexdigest() for x in out], pa.string()),
            pa.array([n > 0 for n, _ in seen], pa.bool_()),
            pa.array([[{"start": s, "end": e} for s, e in places] for _, places in seen], kind),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])

    for known in parts[:-1]:
        rows = written(rows.mapInArrow(lean(scanned(known, False)), BETWEEN), "scanned")
    return rows.mapInArrow(lean(scanned(parts[-1], True)), RESULT)


def remove_benchmark(docs: DataFrame, items: DataFrame, width: int = 10, text_col: str = "text", bound: int = AUTOMATON_BYTES) -> DataFrame:
    """The documents of which no word is hit, all columns as they are."""

    def clean(known: Broadcast) -> Column:
        made: list = []

        @F.arrow_udf("boolean")
        def none_hit(a: pa.Array) -> pa.Array:
            if not made:
                made.append(automaton(known.value, width))
            give_back()
            return pa.array([not hits(t, made[0])[1] for t in a.to_pylist()], pa.bool_())

        return none_hit(F.col(text_col))

    parts = list(benchmark_parts(items, "item_id", "text", width, bound))
    for known in parts[:-1]:
        docs = written(docs.where(clean(known)), "scanned")
    return docs.where(clean(parts[-1]))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False)
    return out.drop("spans")


# DuckDB: the same windows by self-join of words, written without the automaton.
OP8_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, LEAST(len(a), 10) AS n, array_to_string(a[k : k + 9], ' ') AS g
  FROM (SELECT item, a, unnest(range(1, GREATEST(1, len(a) - 9) + 1)) AS k FROM b WHERE len(a) > 0)
), dw AS (
  SELECT doc_id, n, p, array_to_string(a[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, a, n, unnest(range(1, len(a) - n + 2)) AS p
        FROM w, (SELECT DISTINCT n FROM bw) WHERE len(a) >= n)
), hits AS (
  SELECT doc_id, p, dw.n, item FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), words AS (
  SELECT doc_id, COUNT(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, CAST(COALESCE(len(a), 0) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(s, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
