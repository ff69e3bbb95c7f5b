"""Incremental update: a newer index shadows what an older one holds below the newer one's paths."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .postings import with_dense_ids

if TYPE_CHECKING:
    from .index import TrigramIndex


def root_of(path: Column) -> Column:
    """A path without slashes at its end; the root directory is the empty text."""
    return F.regexp_replace(path, "/+$", "")


def above(name: Column) -> Column:
    """A name and all directories above it, as root_of() writes them."""
    parts = F.split(name, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: root_of(F.concat_ws("/", F.slice(parts, F.lit(1), k)))))


def covered(names: DataFrame, paths: DataFrame, compat_prefix: bool = False) -> DataFrame:
    """The distinct names of `names` (name) that are one of the paths (path) or stand below one: an equality join of the names'
    directories with the paths, so neither side is compared row by row with the other. compat_prefix compares strings only,
    so /b also covers /bb; names are then cut to the lengths that paths have (some hundreds at most)."""
    if compat_prefix:
        lengths = [r[0] for r in paths.select(F.length("path")).distinct().collect()]
        keys = F.filter(F.array(*(F.when(F.length("name") >= n, F.substring("name", 1, n)) for n in sorted(lengths))), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
        roots = paths.select(F.col("path").alias("_key"))
    else:
        keys, roots = above(F.col("name")), paths.select(root_of(F.col("path")).alias("_key"))
    return names.select("name", F.explode(keys).alias("_key")).join(roots.distinct(), "_key", "left_semi").select("name").distinct()


def unshadowed(docs: DataFrame, paths: DataFrame, compat_prefix: bool = False) -> DataFrame:
    """The older docs outside all newer paths."""
    return docs.join(covered(docs.select("name"), paths, compat_prefix), "name", "left_anti").select(*docs.columns)


def id_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, old_id, name, new_id): ids in order of name over both."""
    both = old.select(F.lit("old").alias("src"), F.col("doc_id").alias("old_id"), "name").unionByName(new.select(F.lit("new").alias("src"), F.col("doc_id").alias("old_id"), "name"))
    return with_dense_ids(both, "name", "new_id")


def merged_paths(a: DataFrame, b: DataFrame, compat_prefix: bool = False) -> DataFrame:
    """The union of roots, without those below another one; of paths that differ in slashes at the end one stays."""
    both = a.select("path").unionByName(b.select("path"))
    both = both.distinct() if compat_prefix else both.groupBy(root_of(F.col("path")).alias("_r")).agg(F.min("path").alias("path")).select("path")
    # A path's own key would cover it: what is looked for is a path above.
    names = both.select(F.col("path").alias("name"))
    if compat_prefix:
        lengths = [r[0] for r in both.select(F.length("path")).distinct().collect()]
        keys = F.filter(F.array(*(F.when(F.length("name") > n, F.substring("name", 1, n)) for n in sorted(lengths))), lambda x: x.isNotNull())
        roots = both.select(F.col("path").alias("_key"))
    else:
        keys, roots = F.array_except(above(F.col("name")), F.array(root_of(F.col("name")))), both.select(root_of(F.col("path")).alias("_key"))
    inner = names.select("name", F.explode(keys).alias("_key")).join(roots, "_key", "left_semi").select(F.col("name").alias("path")).distinct()
    return both.join(inner, "path", "left_anti")


def hashed(ids: DataFrame) -> DataFrame:
    """ids for a join with postings or contents: a task hashes its share of the ids, one row a document, and lets the other side
    pass; a sort-merge join sorts all of its postings, in as much memory as they take."""
    return ids.hint("shuffle_hash")


def merged_postings(old: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    both = old.select("trigram", F.col("doc_id").alias("old_id"), F.lit("old").alias("src")).unionByName(new.select("trigram", F.col("doc_id").alias("old_id"), F.lit("new").alias("src")))
    return both.join(hashed(ids), ["src", "old_id"]).select("trigram", F.col("new_id").alias("doc_id"))


def check_newer(newer: TrigramIndex, compat_prefix: bool = False) -> None:
    stray = unshadowed(newer.docs, newer.paths, compat_prefix).limit(1).count()
    if stray:
        raise ValueError("the newer index holds a name outside its paths")


def merged(old: TrigramIndex, new: TrigramIndex, compat_prefix: bool = False) -> TrigramIndex:
    check_newer(new, compat_prefix)
    kept = unshadowed(old.docs, new.paths, compat_prefix)
    ids = id_map(kept, new.docs)

    def renumbered(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.withColumn("src", F.lit("old")).unionByName(b.withColumn("src", F.lit("new"))).withColumnRenamed("doc_id", "old_id")
        return both.join(hashed(ids.select("src", "old_id", F.col("new_id").alias("doc_id"))), ["src", "old_id"]).drop("src", "old_id")

    skipped = unshadowed(old.skipped, new.paths, compat_prefix)
    return type(old)(
        merged_paths(old.paths, new.paths, compat_prefix),
        renumbered(kept, new.docs).select("doc_id", "name", "n_bytes", "n_trigrams"),
        merged_postings(old.postings, new.postings, ids),
        renumbered(*(ix.contents.select("doc_id", "name", "content") for ix in (old, new))).select("doc_id", "name", "content"),
        skipped.unionByName(new.skipped),
    )
