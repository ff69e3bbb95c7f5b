"""Verification of candidates line by line, and output formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.regex import RegexError, java, may_match_newline, parse

# Terminal codes for names, numbers, matches and their end.
BOLD_GREEN, BOLD_BLUE, BOLD_RED, PLAIN = "\x1b[1;32m", "\x1b[1;34m", "\x1b[1;31m", "\x1b[0m"


def pattern_of(pattern: str, ignore_case: bool = False, unicode: bool = False) -> str:
    node = parse(pattern, ignore_case, unicode)
    if may_match_newline(node):
        raise RegexError(f"{pattern!r} asks for a line feed; lines are searched one by one")
    return java(node, unicode)


def matches(text: Column, pattern: str, ignore_case: bool = False, unicode: bool = False) -> Column:
    return text.rlike(pattern_of(pattern, ignore_case, unicode))


def lines_of(text: Column) -> Column:
    """The lines, without an empty one after the last line feed."""
    a = F.split(text, "\n", -1)
    return F.slice(a, F.lit(1), F.when(text.endswith("\n") | (text == ""), F.size(a) - 1).otherwise(F.size(a)))


def text_of(contents: DataFrame) -> DataFrame:
    """contents with `text`: invalid bytes become replacement characters."""
    raw = F.col("content")
    kind = dict(contents.dtypes)["content"]
    return contents.withColumn("text", raw if kind == "string" else F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.make_valid_utf8(raw.cast("string")))).drop("content")


def matching_lines(contents: DataFrame, pattern: str, ignore_case: bool = False, max_count: int | None = None, unicode: bool = False) -> DataFrame:
    """(doc_id, name, line_no, line): each matching line once, numbered from 1; at most max_count a document where given.
    One stage: a document's lines are numbered, tested and cut off within its row."""
    test = pattern_of(pattern, ignore_case, unicode)
    rows = text_of(contents)
    if max_count is None:
        out = rows.select("doc_id", "name", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).where(F.col("line").rlike(test))
        return out.select("doc_id", "name", (F.col("pos") + 1).cast("long").alias("line_no"), "line")
    numbered = F.transform(lines_of(F.col("text")), lambda x, k: F.struct((k + 1).cast("long").alias("line_no"), x.alias("line")))
    kept = F.slice(F.filter(numbered, lambda x: x["line"].rlike(test)), 1, max(0, max_count))
    return rows.select("doc_id", "name", F.explode(kept).alias("m")).select("doc_id", "name", "m.line_no", "m.line")


def matching_files(contents: DataFrame, pattern: str, ignore_case: bool = False, unicode: bool = False) -> DataFrame:
    """(doc_id, name) with a matching line: stops at a document's first, explodes nothing."""
    test = pattern_of(pattern, ignore_case, unicode)
    return text_of(contents).where(F.exists(lines_of(F.col("text")), lambda x: x.rlike(test))).select("doc_id", "name")


def relative(name: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(name.startswith(root), F.substring(name, len(root) + 1, 1 << 30)).otherwise(name)


def formatted(found: DataFrame, style: str = "normal", line_numbers: bool = False, relative_to: str | None = None) -> DataFrame:
    """found with `output`: "name:line", "name:number:line", or "name(number):line" in style "vs", which keeps whole names."""
    name = F.col("name") if style == "vs" or relative_to is None else relative(F.col("name"), relative_to)
    number = F.col("line_no").cast("string")
    if style == "vs":
        out = F.concat(name, F.lit("("), number, F.lit("):"), F.col("line"))
    else:
        out = F.concat_ws(":", name, *([number] if line_numbers else []), F.col("line"))
    return found.withColumn("output", out)


def highlighted(line: Column, pattern: str, ignore_case: bool = False, on: str = BOLD_RED, off: str = PLAIN, unicode: bool = False) -> Column:
    """Every non-overlapping match between the marks."""
    return F.regexp_replace(line, f"({pattern_of(pattern, ignore_case, unicode)})", on.replace("\\", "\\\\").replace("$", "\\$") + "$1" + off.replace("\\", "\\\\").replace("$", "\\$"))
