"""The engine as two commands, each a function of arguments and a main program:

    python -m gramlake.commands index  [--list | --reset | PATH ...] ...
    python -m gramlake.commands search [-c -G RE -i -l -n -m NUM --files --brute --format-vs --indexpath DIR] PATTERN
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.trigrams import Limits
from .operators import search as _search
from .operators.index import TrigramIndex, default_location
from .sources.files import file_tree, listed, normalised
from .storage import versions

log = logging.getLogger(__name__)


def logging_to_stdout(verbose: bool = False) -> None:
    """Time, level and message on standard output; everything if verbose."""
    own = logging.getLogger("gramlake")
    own.setLevel(logging.DEBUG if verbose else logging.INFO)
    if not own.handlers:
        own.addHandler(handler := logging.StreamHandler(sys.stdout))
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))


def index_arguments() -> argparse.ArgumentParser:
    d, p = Limits(), argparse.ArgumentParser("index", description="Indexes file trees. Without paths the indexed paths are indexed again.")
    p.add_argument("path", nargs="*")
    p.add_argument("--list", action="store_true", help="list the indexed paths and exit")
    p.add_argument("--reset", action="store_true", help="delete the index and exit")
    p.add_argument("--indexpath")
    p.add_argument("--no-follow-simlinks", action="store_true")
    p.add_argument("--maxFileLen", type=int, default=d.max_file_len)
    p.add_argument("--maxLineLen", type=int, default=d.max_line_len)
    p.add_argument("--maxtrigrams", type=int, default=d.max_trigrams)
    p.add_argument("--maxinvalidutf8ratio", type=float, default=d.max_invalid_utf8)
    p.add_argument("--exclude", help="a file of globs, one a line")
    p.add_argument("--filelist", help="a file of paths, one a line")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--logskip", action="store_true", help="tell which files are skipped and why")
    return p


def index(spark: SparkSession, argv: list[str], out: Callable[[str], None] = print) -> int:
    p = index_arguments()
    a = p.parse_args(argv)
    where = a.indexpath or default_location()
    if a.list and a.reset or a.reset and a.path:
        p.error("--reset goes with neither --list nor paths")
    logging_to_stdout(a.verbose)
    there = bool(versions(spark, where))
    if a.list:
        for r in TrigramIndex.open(spark, where).list_paths().toLocalIterator() if there else ():
            out(r.path)
        return 0
    if a.reset:
        TrigramIndex.reset(spark, where)
        return 0
    before = TrigramIndex.open(spark, where) if there else None
    roots = [*a.path, *(listed(a.filelist) if a.filelist else [])]
    if not roots and before:  # the paths of an index are those that a user gave: few
        roots = [r.path for r in before.list_paths().collect()]
    roots = normalised(roots)
    files = file_tree(spark, roots, listed(a.exclude) if a.exclude else [], not a.no_follow_simlinks)
    fresh = TrigramIndex.build(spark, files, roots, Limits(a.maxFileLen, a.maxLineLen, a.maxtrigrams, a.maxinvalidutf8ratio))
    if a.logskip:
        for r in fresh.skipped.orderBy("name").toLocalIterator():
            out(f"{r.name}: skipped: {r.reason}")
    (before.merge(fresh) if before else fresh).write(where)
    return 0


def search_arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("search", description="Prints the lines that match.")
    p.add_argument("pattern")
    p.add_argument("-c", "--count", action="store_true", help="only the number of matching lines of each file")
    p.add_argument("--color", action="store_true")
    p.add_argument("--nocolor", action="store_true")
    p.add_argument("-G", "--file-search-regex", metavar="FILE_PATTERN")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("--files", action="store_true", help="the files that would be searched")
    p.add_argument("-l", "--files-with-matches", action="store_true")
    p.add_argument("-n", "--line-number", action="store_true")
    p.add_argument("--format-vs", action="store_true")
    p.add_argument("-m", "--max-count", type=int, metavar="NUM", help="NUM matches of each file at most")
    p.add_argument("--brute", action="store_true")
    p.add_argument("--indexpath")
    return p


def found(spark: SparkSession, argv: list[str]) -> DataFrame:
    """The printed lines as a DataFrame: `output`, in order of (name, line_no)."""
    a = search_arguments().parse_args(argv)
    ix = TrigramIndex.open(spark, a.indexpath or default_location())
    how = {"ignore_case": a.ignore_case, "file_pattern": a.file_search_regex, "brute": a.brute}
    if a.files:
        return ix.candidates(a.pattern, **how).orderBy("name").select(F.col("name").alias("output"))
    if a.files_with_matches:
        return ix.search_files(a.pattern, **how).orderBy("name").select(F.col("name").alias("output"))
    lines = ix.search(a.pattern, max_count=a.max_count, **how)
    if a.count:
        return lines.groupBy("name").agg(F.count("*").alias("n")).orderBy("name").select(F.concat_ws(": ", "name", F.col("n").cast("string")).alias("output"))
    if a.color and not a.nocolor and not a.format_vs:
        lines = lines.withColumn("line", _search.highlighted(F.col("line"), a.pattern, a.ignore_case))
    lines = lines.orderBy("name", "line_no")
    return _search.formatted(lines, "vs" if a.format_vs else "normal", a.line_number, None if a.format_vs else os.getcwd()).select("output")


def search(spark: SparkSession, argv: list[str], out: Callable[[str], None] = print) -> int:
    for r in found(spark, argv).toLocalIterator():
        out(r.output)
    return 0


def main(argv: Iterable[str]) -> int:
    name, *rest = list(argv) or [""]
    if name not in ("index", "search"):
        print(__doc__)
        return 2
    if "-h" in rest or "--help" in rest:
        (index_arguments if name == "index" else search_arguments)().parse_args(rest)
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return (index if name == "index" else search)(spark, rest)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
