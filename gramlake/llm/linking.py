"""Parts shared by the joins on similarity: connected components of links, and all pairs of a bucket in bounded tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Rows of a bucket that stand in one tile's block.
BLOCK = 1024


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): component is the smallest id reachable.

    Alternates two contractions, each a minimum over neighbours, until no edge changes; every round is a written table, and
    nothing but a count and a checksum reaches the driver. A hub's edges are partially aggregated before the shuffle."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        # Every node tells its larger neighbours of the smallest node it knows.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every node and its smaller neighbours go to the smallest of them.
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        former, edges = edges, written(small, "edges")
        dropped(former)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("id"), "component").unionByName(roots.select(F.col("component").alias("id"), "component").distinct())


def tiles(hits: DataFrame, key: list[str], block: int = BLOCK) -> DataFrame:
    """hits, which hold their bucket's number of rows as `rows`, with columns t1, t2, side: every pair of rows of one key meets in
    exactly one tile (key, t1, t2) of about two blocks at most. A bucket of up to `block` rows is one tile; a larger one is
    dealt into blocks by a hash of the row, without bringing it together, and its rows are repeated once for each block."""
    last = F.ceil(F.col("rows") / block).cast("int") - 1
    own = F.when(last > 0, F.pmod(F.xxhash64(*hits.columns), last + 1)).otherwise(0).cast("int")
    spread = hits.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), last)))
    return spread.select("*", F.least("_b", "_o").alias("t1"), F.greatest("_b", "_o").alias("t2"), (F.col("_b") > F.col("_o")).cast("int").alias("side")).drop("rows", "_o", "_b")


def tiles_in_turn(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The runs of equal `key` in sorted batches, each as one table; only runs of several rows."""
    held: list[pa.RecordBatch] = []

    def runs(t: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        change = np.zeros(t.num_rows - 1, bool) if t.num_rows else np.zeros(0, bool)
        for k in key:
            x = t.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()] + [t.num_rows] * last
        return [t.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1], t.slice(cuts[-1])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        whole, rest = runs(pa.Table.from_batches(held).combine_chunks(), False)
        yield from whole
        held = rest.to_batches()
    if held:
        yield from runs(pa.Table.from_batches(held).combine_chunks(), True)[0]


def whole_runs(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 1 << 15) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches regrouped to tables of about `rows` rows that cut no run of equal `key`, with each row's run end."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        t = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(t.num_rows - 1, bool)
        for k in key:
            x = t.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        stops = np.append(np.flatnonzero(change) + 1, t.num_rows)
        if not last:
            stops = stops[:-1]
        n = int(stops[-1]) if len(stops) else 0
        return t.slice(0, n), np.repeat(stops, np.diff(stops, prepend=0)), t.slice(n)

    size, most = 0, rows
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size >= most:
            whole, ends, rest = cut(False)
            if whole.num_rows:
                yield whole, ends
            held, size = rest.to_batches(), rest.num_rows
            most = max(rows, 2 * size)  # a run longer than a table is not looked through again at each batch
    if held:
        whole, ends, _ = cut(True)
        yield whole, ends
