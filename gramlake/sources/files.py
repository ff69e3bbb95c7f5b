"""Sources: file trees, file lists and tables as (name, content) rows."""

from __future__ import annotations

import fnmatch
import logging
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.trigrams import FILE_NAME, IO

log = logging.getLogger(__name__)
FILES = "name string, content binary, error string"


def normalised(roots: list[str]) -> list[str]:
    """Absolute real paths of the roots that exist, sorted, once each; empty arguments are dropped, absent ones warned of."""
    out = set()
    for r in roots:
        if not r:
            continue
        if os.path.exists(r):
            out.add(os.path.realpath(r))
        else:
            log.warning("%s does not exist", r)
    return sorted(out)


def listed(path: str) -> list[str]:
    """Roots from a text file, one a line."""
    with open(path, encoding="utf-8") as f:
        return [line.strip() for line in f if line.strip()]


def glob_regex(glob: str) -> str:
    """A glob as a Java pattern for a whole path; * also crosses /."""
    return fnmatch.translate(glob).replace("(?s:", "(?s)(?:").replace("\\Z", "\\z").replace("\\z", "")


def excluded(name: Column, globs: list[str]) -> Column:
    """Whether a glob matches the path, any directory above it, or the base name of one of these."""
    if not globs:
        return F.lit(False)
    parts = F.split(name, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))
    whole = "|".join(f"(?:{glob_regex(g)})" for g in globs)
    test = f"\\A(?:{whole})\\z"
    return F.exists(above, lambda p: p.rlike(test)) | F.exists(parts, lambda p: p.rlike(test))


def file_tree(spark: SparkSession, roots: list[str], excludes: list[str] = (), follow_links: bool = True, files_too: bool = False) -> DataFrame:
    """(name, content BINARY, error) of all files below the roots. A path is read once; files are listed by Spark and read where
    its tasks run. A file that can't be read or whose name is no UTF-8 has no content but an error: the reason to skip it.

    Roots that are no directories are skipped with a warning, unless files_too."""
    roots = normalised(roots)
    if not follow_links:
        roots = [r for r in roots if not os.path.islink(r)]
    for r in roots if not files_too else ():
        if not os.path.isdir(r):
            log.warning("%s is no directory: skipped", r)
    roots = [r for r in roots if files_too or os.path.isdir(r)]
    if not roots:
        return spark.createDataFrame([], FILES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():  # one file at a time: contents may be large
                content, error = None, None
                try:
                    with open(name, "rb") as f:
                        content = f.read()
                except OSError:
                    error = FILE_NAME if "\ufffd" in name else IO
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["name", "content", "error"])

    listed_ = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots).select(F.regexp_replace("path", "^file:/*", "/").alias("name"))
    return listed_.where(~excluded(F.col("name"), [".csearchindex", *excludes])).distinct().mapInArrow(read, FILES)


def table_rows(df: DataFrame, name: Column, text: str = "text") -> DataFrame:
    return df.select(name.alias("name"), F.col(text).alias("content"))
