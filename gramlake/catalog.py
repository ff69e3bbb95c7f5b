"""The registered queries of the search engine over the test tables, each with independent SQL.

A document's name is /source/doc_id. The index that searches use here skips nothing, so that a brute-force SQL over all texts
is the oracle; the skip rules have queries of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import trigrams as tg
from .operators import inspect, merge, postings, search
from .operators.index import TrigramIndex
from .plans.trigram_query import ALL, NONE, trigram_query
from .sources.files import excluded
from .storage import shared_path
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NAME = "'/' || source || '/' || CAST(doc_id AS VARCHAR)"
FILES_SQL = f"f AS (SELECT doc_id, {NAME} AS name, text, encode(text) AS b, octet_length(encode(text)) AS n FROM documents)"
GRAMS_SQL = f"""{FILES_SQL}, h AS (SELECT doc_id, hex(b) AS h, n FROM f WHERE n >= 3),
g AS (SELECT doc_id, CAST('0x' || substr(h, 2 * i + 1, 6) AS BIGINT) AS trigram FROM (SELECT doc_id, h, unnest(range(0, n - 2)) AS i FROM h)),
p AS (SELECT DISTINCT doc_id, trigram FROM g)"""
LINES_SQL = f"""{FILES_SQL}, a AS (SELECT doc_id, name, text, string_split(text, chr(10)) AS a FROM f),
c AS (SELECT doc_id, name, CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN a[1 : len(a) - 1] ELSE a END AS a FROM a),
l AS (SELECT doc_id, name, CAST(k AS BIGINT) AS line_no, a[k] AS line FROM (SELECT doc_id, name, a, unnest(range(1, len(a) + 1)) AS k FROM c))"""


def query(sql: str):
    def add(f: Callable) -> Callable:
        name = f.__name__.rstrip("_")
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def files(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content"))


def index(spark: SparkSession, d: str, limits: tg.Limits = tg.NO_LIMITS) -> TrigramIndex:
    return TrigramIndex.build(spark, files(spark, d), limits=limits, id_col="doc_id")


def stored(spark: SparkSession, d: str) -> TrigramIndex:
    """The same index, written and opened again."""
    ix, path = index(spark, d), shared_path(spark, "index")
    ix.paths = files(spark, d).select(F.regexp_extract("name", "^/[^/]*", 0).alias("path")).distinct()
    ix.write(path)
    return TrigramIndex.open(spark, path)


def posts(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).postings


# Sources and skip rules


@query(f"WITH {FILES_SQL} SELECT doc_id, name, CAST(n AS BIGINT) AS n_bytes FROM f")
def scan_documents(spark, d):
    return files(spark, d).select("doc_id", "name", F.octet_length("content").cast("long").alias("n_bytes"))


@query(f"WITH {FILES_SQL} SELECT DISTINCT name FROM f")
def scan_dedup(spark, d):
    f = files(spark, d)
    return TrigramIndex.build(spark, f.unionByName(f), limits=tg.NO_LIMITS, id_col="doc_id").docs.select("name")


@query(f"WITH {FILES_SQL} SELECT name FROM f WHERE NOT (name LIKE '/src1/%' OR name LIKE '%7')")
def scan_exclude_glob(spark, d):
    return files(spark, d).where(~excluded(F.col("name"), ["/src1", "*7"])).select("name")


@query("SELECT DISTINCT '/' || source AS path FROM documents")
def list_paths(spark, d):
    return stored(spark, d).list_paths()


@query(f"WITH {FILES_SQL} SELECT doc_id FROM f WHERE n > 4000")
def skip_file_too_long(spark, d):
    skipped = index(spark, d, tg.Limits(4000, 1 << 30, 1 << 30, 1.0)).skipped
    return skipped.where(F.col("reason") == tg.TOO_LONG).select(F.regexp_extract("name", "[^/]*$", 0).cast("long").alias("doc_id"))


@query("SELECT * FROM (VALUES (0, FALSE), (1, TRUE), (2, TRUE), (3, FALSE), (4, TRUE)) v(id, skipped)")
def skip_binary(spark, d):
    rows = spark.createDataFrame([(0, "\0abc"), (1, "a\0bc"), (2, "abc\0"), (3, "a\0"), (4, "ab\0c")], "id int, t string")
    return rows.select("id", tg.has_binary(F.col("t")).alias("skipped"))


@query("SELECT * FROM (VALUES (0, 'HighInvalidUtf8Ratio'), (1, NULL), (2, 'BinaryDataPresent')) v(id, reason)")
def skip_invalid_utf8(spark, d):
    rows = spark.createDataFrame([(0, bytearray(b"a\xff\xfe\xfd\xfcb")), (1, bytearray("né à côté".encode())), (2, bytearray(b"ab\0\xff\xff\xff"))], "id int, content binary")
    return rows.select("id", tg.examine(F.col("content"), tg.Limits()).getField("reason").alias("reason"))


LONG_LINES_SQL = """x AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM f),
y AS (SELECT doc_id, k, len(a) AS last, octet_length(encode(a[k])) AS n, COALESCE(octet_length(encode(array_to_string(a[1 : k - 1], chr(10)))) + 1, 0) * CAST(k > 1 AS INT) AS pos
      FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS k FROM x)),
z AS (SELECT doc_id, k, last, n - LEAST(n, GREATEST(0, 2 - pos)) AS n FROM y),
long AS (SELECT DISTINCT doc_id FROM z WHERE n >= 2002 OR (n = 2001 AND k < last))"""


@query(f"WITH {FILES_SQL}, {LONG_LINES_SQL} SELECT doc_id FROM long")
def skip_line_too_long(spark, d):
    return files(spark, d).where(tg.line_too_long(F.col("content"), 2000)).select("doc_id")


@query(f"WITH {GRAMS_SQL} SELECT doc_id FROM p GROUP BY doc_id HAVING COUNT(*) > 700")
def skip_too_many_trigrams(spark, d):
    return tg.trigram_counts(files(spark, d)).groupBy("doc_id").count().where("count > 700").select("doc_id")


@query(f"""WITH {GRAMS_SQL}, {LONG_LINES_SQL}, m AS (SELECT doc_id FROM p GROUP BY doc_id HAVING COUNT(*) > 900)
SELECT name, CASE WHEN n > 9000 THEN 'FileTooLong' WHEN doc_id IN (SELECT doc_id FROM long) THEN 'LineTooLong' ELSE 'TooManyTrigrams' END AS reason
FROM f WHERE n > 9000 OR doc_id IN (SELECT doc_id FROM long) OR doc_id IN (SELECT doc_id FROM m)""")
def skip_report(spark, d):
    return index(spark, d, tg.Limits(9000, 2000, 900, 0.1)).skipped


# Trigrams and the index


@query(f"WITH {GRAMS_SQL} SELECT doc_id, trigram, COUNT(*) AS n FROM g GROUP BY ALL")
def trigrams_explode(spark, d):
    return tg.trigram_counts(files(spark, d))


@query(f"WITH {GRAMS_SQL} SELECT doc_id, trigram FROM p")
def trigrams_distinct(spark, d):
    return posts(spark, d).select("doc_id", F.col("trigram").cast("long").alias("trigram"))


@query(f"WITH {GRAMS_SQL} SELECT DISTINCT trigram, lpad(hex(trigram), 6, '0') AS bytes FROM p")
def trigram_pack(spark, d):
    return posts(spark, d).select(F.col("trigram").cast("long").alias("trigram")).distinct().withColumn("bytes", tg.gram_hex(F.col("trigram")))


@query(f"WITH {FILES_SQL} SELECT name, row_number() OVER (ORDER BY name) - 1 AS file_id FROM f")
def assign_file_ids(spark, d):
    return TrigramIndex.build(spark, files(spark, d).drop("doc_id"), limits=tg.NO_LIMITS).docs.select("name", F.col("doc_id").alias("file_id"))


@query(f"WITH {GRAMS_SQL} SELECT (SELECT COUNT(*) FROM f) AS n_docs, CAST((SELECT SUM(n) FROM f) AS BIGINT) AS n_bytes, (SELECT COUNT(*) FROM p) AS n_postings")
def index_stats(spark, d):
    return index(spark, d).stats()


@query(f"WITH {GRAMS_SQL} SELECT trigram, doc_id FROM p ORDER BY 1, 2")
def postings_sorted(spark, d):
    return posts(spark, d).select(F.col("trigram").cast("long").alias("trigram"), "doc_id").orderBy("trigram", "doc_id")


@query(f"WITH {GRAMS_SQL} SELECT trigram, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids FROM p GROUP BY trigram")
def posting_lists(spark, d):
    return postings.posting_lists(posts(spark, d)).select(F.col("trigram").cast("long").alias("trigram"), F.array_join("doc_ids", ",").alias("doc_ids"))


@query(f"WITH {GRAMS_SQL} SELECT trigram, COUNT(*) AS doc_count FROM p GROUP BY trigram")
def trigram_doc_count(spark, d):
    return postings.doc_counts(posts(spark, d)).withColumn("trigram", F.col("trigram").cast("long"))


DELTAS_SQL = """d AS (SELECT trigram, row_number() OVER w - 1 AS pos, doc_id - lag(doc_id, 1, -1) OVER w AS delta FROM p WINDOW w AS (PARTITION BY trigram ORDER BY doc_id)
UNION ALL SELECT trigram, COUNT(*), 0 FROM p GROUP BY trigram)"""
SIZES_SQL = "s AS (SELECT trigram, COUNT(*) - 1 AS doc_count, CAST(3 + SUM(CASE WHEN delta < 128 THEN 1 WHEN delta < 16384 THEN 2 WHEN delta < 2097152 THEN 3 ELSE 4 END) AS BIGINT) AS n_bytes FROM d GROUP BY trigram)"


@query(f"WITH {GRAMS_SQL}, {DELTAS_SQL} SELECT trigram, pos, delta FROM d")
def posting_deltas(spark, d):
    return postings.deltas(posts(spark, d)).withColumn("trigram", F.col("trigram").cast("long"))


@query(f"WITH {GRAMS_SQL} SELECT trigram, doc_id FROM p")
def posting_decode(spark, d):
    return postings.decoded(postings.deltas(posts(spark, d))).withColumn("trigram", F.col("trigram").cast("long"))


@query(f"WITH {GRAMS_SQL}, {DELTAS_SQL}, {SIZES_SQL} SELECT * FROM s")
def posting_varint_bytes(spark, d):
    return postings.list_sizes(posts(spark, d)).withColumn("trigram", F.col("trigram").cast("long"))


@query(f'WITH {GRAMS_SQL}, {DELTAS_SQL}, {SIZES_SQL} SELECT trigram, doc_count, CAST(SUM(n_bytes) OVER (ORDER BY trigram) - n_bytes AS BIGINT) AS "offset" FROM s')
def posting_offsets(spark, d):
    return postings.list_offsets(posts(spark, d)).withColumn("trigram", F.col("trigram").cast("long"))


@query(f'WITH {FILES_SQL} SELECT name, CAST(SUM(octet_length(encode(name)) + 1) OVER (ORDER BY name) - octet_length(encode(name)) - 1 AS BIGINT) AS "offset" FROM f')
def name_offsets(spark, d):
    rows = files(spark, d).select("name", (F.octet_length("name") + 1).cast("long").alias("n"), F.regexp_extract("name", "^/[^/]*", 0).alias("block"))
    return postings.running(rows.withColumn("block", F.concat("block", F.lit("/"))), "name", "n").select("name", "offset")


@query(f"""WITH {GRAMS_SQL}, {DELTAS_SQL}, {SIZES_SQL}
SELECT trigram, doc_count, CAST(SUM(n_bytes) OVER (ORDER BY trigram) - n_bytes AS BIGINT) AS "offset" FROM (SELECT * FROM s UNION ALL SELECT 16777215, 0, 4)""")
def dump_posting_index(spark, d):
    return stored(spark, d).dictionary(end=True).withColumn("trigram", F.col("trigram").cast("long"))


@query(f'WITH {GRAMS_SQL}, {DELTAS_SQL}, {SIZES_SQL}, o AS (SELECT trigram, doc_count, CAST(SUM(n_bytes) OVER (ORDER BY trigram) - n_bytes AS BIGINT) AS "offset" FROM s) SELECT * FROM o WHERE "offset" = 0')
def dictionary_entry(spark, d):
    return index(spark, d).list_at(0).withColumn("trigram", F.col("trigram").cast("long"))


@query(f"""WITH {GRAMS_SQL}, {DELTAS_SQL} SELECT trigram, lpad(hex(trigram), 6, '0') || string_agg(CASE WHEN delta < 128 THEN printf('%02X', delta)
WHEN delta < 16384 THEN printf('%02X%02X', (delta & 127) + 128, delta >> 7) ELSE printf('%02X%02X%02X', (delta & 127) + 128, ((delta >> 7) & 127) + 128, delta >> 14) END, '' ORDER BY pos) AS bytes FROM d GROUP BY trigram""")
def encoded_lists(spark, d):
    return index(spark, d).encoded_lists().select(F.col("trigram").cast("long").alias("trigram"), F.hex("bytes").alias("bytes"))


VARINT_SQL = """SELECT doc_id, v, CASE WHEN v < 128 THEN printf('%02X', v)
WHEN v < 16384 THEN printf('%02X%02X', (v & 127) + 128, v >> 7)
WHEN v < 2097152 THEN printf('%02X%02X%02X', (v & 127) + 128, ((v >> 7) & 127) + 128, v >> 14)
WHEN v < 268435456 THEN printf('%02X%02X%02X%02X', (v & 127) + 128, ((v >> 7) & 127) + 128, ((v >> 14) & 127) + 128, v >> 21)
ELSE printf('%02X%02X%02X%02X%02X', (v & 127) + 128, ((v >> 7) & 127) + 128, ((v >> 14) & 127) + 128, ((v >> 21) & 127) + 128, v >> 28) END AS bytes
FROM (SELECT doc_id, CAST((doc_id * 7919 * 7919) % 4294967296 AS BIGINT) >> CAST(doc_id % 30 AS INT) AS v FROM documents)"""


@query(VARINT_SQL)
def varint_encode(spark, d):
    v = F.expr("shiftright((doc_id * 7919 * 7919) % 4294967296, cast(doc_id % 30 as int))")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", v.alias("v")).withColumn("bytes", postings.varint_hex(F.col("v")))


@query(f"SELECT doc_id, v FROM ({VARINT_SQL})")
def varint_decode(spark, d):
    return varint_encode(spark, d).select("doc_id", postings.varint_value(F.concat("bytes", F.lit("FF"))).alias("v"))


# Lookups and queries; the SQL never touches postings


@query("SELECT doc_id FROM documents WHERE contains(text, 'ion')")
def lookup_list(spark, d):
    return index(spark, d).posting_list(b"ion")


@query("SELECT doc_id FROM documents WHERE contains(text, 'ion') AND contains(text, 'hea')")
def lookup_and(spark, d):
    ix = index(spark, d)
    return ix.and_(ix.posting_list(b"ion"), b"hea")


@query("SELECT doc_id FROM documents WHERE contains(text, 'eau') OR contains(text, 'hea')")
def lookup_or(spark, d):
    ix = index(spark, d)
    return ix.or_(ix.or_(ix.posting_list(b"eau"), b"\x01\x02\x03"), b"hea")


@query("SELECT doc_id FROM documents WHERE contains(text, 'ion') AND source = 'src3'")
def lookup_restrict(spark, d):
    ix = index(spark, d)
    return ix.posting_list(b"ion", ix.docs.where("name like '/src3/%'"))


@query("SELECT doc_id FROM documents")
def query_all(spark, d):
    return index(spark, d).query(ALL)


@query("SELECT doc_id FROM documents WHERE FALSE")
def query_none(spark, d):
    return index(spark, d).query(NONE)


@query("SELECT doc_id FROM documents WHERE contains(text, 'tio') AND contains(text, 'ion') AND contains(text, 'the')")
def query_and(spark, d):
    return index(spark, d).query(trigram_query("tion.*the"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'eit') OR contains(text, 'eau')")
def query_or(spark, d):
    return index(spark, d).query(trigram_query("eit|eau"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'the') AND ((contains(text, 'tio') AND contains(text, 'ion')) OR contains(text, 'eau'))")
def query_nested(spark, d):
    return index(spark, d).query(trigram_query("the.*(tion|eau)"))


@query(f"WITH {FILES_SQL} SELECT doc_id, name FROM f WHERE contains(text, 'eau')")
def candidates_names(spark, d):
    return index(spark, d).candidates("eau")


# Search


@query(f"WITH {FILES_SQL} SELECT doc_id, name FROM f WHERE contains(text, 'tio') AND contains(text, 'ion') AND contains(text, 'on ') AND contains(text, 'the')")
def search_candidates(spark, d):
    return index(spark, d).candidates("tion .*the")


PATTERN, SQL_PATTERN = r"tion .*the\b", r"tion .*the\b"


@query(f"WITH {LINES_SQL} SELECT doc_id, name, line_no, line FROM l WHERE regexp_matches(line, '{SQL_PATTERN}')")
def search_lines(spark, d):
    return index(spark, d).search(PATTERN)


@query(f"WITH {LINES_SQL} SELECT doc_id, name, line_no, line FROM l WHERE regexp_matches(line, 'tion .*the\\b')")
def search_stored(spark, d):
    return stored(spark, d).search(PATTERN)


@query(f"WITH {LINES_SQL} SELECT doc_id, name, line_no, line FROM l WHERE regexp_matches(line, 'e')")
def search_stored_many(spark, d):
    return stored(spark, d).search("e|[^\\x00-\\x{10FFFF}]the")


@query(f"WITH {LINES_SQL} SELECT doc_id, name, line_no, line FROM l WHERE regexp_matches(line, '[.]$')")
def search_brute(spark, d):
    return index(spark, d).search("[.]$", brute=True)


@query(f"WITH {LINES_SQL} SELECT doc_id, name, line_no, line FROM l WHERE regexp_matches(line, '(?i)the.*ion')")
def search_ignore_case(spark, d):
    return index(spark, d).search("the.*ion", ignore_case=True)


@query(f"WITH {LINES_SQL} SELECT doc_id, name, line_no, line FROM l WHERE regexp_matches(line, '(auf|sch)en') AND regexp_matches(name, 'src1[0-4]?/')")
def search_file_pattern(spark, d):
    return index(spark, d).search("(auf|sch)en", file_pattern="src1[0-4]?/")


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no FROM l WHERE regexp_matches(line, 't[io]+n\\b')")
def search_line_numbers(spark, d):
    return index(spark, d).search(r"t[io]+n\b").select("doc_id", "line_no")


@query(f"WITH {LINES_SQL} SELECT DISTINCT doc_id, name FROM l WHERE regexp_matches(line, 'eau.*ment')")
def search_files_with_matches(spark, d):
    return index(spark, d).search_files("eau.*ment")


@query(f"WITH {LINES_SQL} SELECT doc_id, name, COUNT(*) AS n_lines FROM l WHERE regexp_matches(line, 'thing') GROUP BY ALL")
def search_count(spark, d):
    return index(spark, d).search_counts("thing")


@query(f"WITH {LINES_SQL} SELECT doc_id, name, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM l WHERE regexp_matches(line, 'ing')) WHERE k <= 2")
def search_max_count(spark, d):
    return index(spark, d).search("ing", max_count=2)


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, name || ':' || line_no || ':' || line AS output FROM l WHERE regexp_matches(line, 'License')")
def search_format_normal(spark, d):
    return search.formatted(index(spark, d).search("License"), line_numbers=True).select("doc_id", "line_no", "output")


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, name || '(' || line_no || '):' || line AS output FROM l WHERE regexp_matches(line, 'License')")
def search_format_vs(spark, d):
    return search.formatted(index(spark, d).search("License"), "vs").select("doc_id", "line_no", "output")


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, CASE WHEN name LIKE '/src1/%' THEN substr(name, 7) ELSE name END || ':' || line AS output FROM l WHERE regexp_matches(line, 'License')")
def search_relative_names(spark, d):
    return search.formatted(index(spark, d).search("License"), relative_to="/src1").select("doc_id", "line_no", "output")


@query(f"WITH {LINES_SQL} SELECT doc_id, line_no, regexp_replace(line, '([a-z]+tion)', '<\\1>', 'g') AS line FROM l WHERE regexp_matches(line, '[a-z]+tion')")
def search_highlight(spark, d):
    return index(spark, d).search("[a-z]+tion").select("doc_id", "line_no", search.highlighted(F.col("line"), "[a-z]+tion", on="<", off=">").alias("line"))


# Merge: A holds every document but those of src5, B the documents of /src1 and /src5 with another text


def halves(spark: SparkSession, d: str) -> tuple[TrigramIndex, TrigramIndex]:
    f = files(spark, d)
    a = f.where(~F.col("name").startswith("/src5/"))
    b = f.where(F.col("name").startswith("/src1/") | F.col("name").startswith("/src5/")).withColumn("content", F.concat(F.lit("newer "), "content"))
    roots = sorted({f"/src{k}" for k in range(20)} - {"/src5"})
    make = lambda rows, paths: TrigramIndex.build(spark, rows.drop("doc_id"), paths, tg.NO_LIMITS)
    return make(a, roots), make(b, ["/src1", "/src5"])


AB_SQL = f"""{FILES_SQL}, o AS (SELECT name, text FROM f WHERE name NOT LIKE '/src5/%' AND name NOT LIKE '/src1/%'),
nw AS (SELECT name, 'newer ' || text AS text FROM f WHERE name LIKE '/src1/%' OR name LIKE '/src5/%'),
m AS (SELECT 'old' AS src, name, text FROM o UNION ALL SELECT 'new', name, text FROM nw),
ids AS (SELECT src, name, text, row_number() OVER (ORDER BY name) - 1 AS new_id FROM m)"""


@query(f"WITH {AB_SQL} SELECT name FROM o")
def merge_shadow(spark, d):
    a, b = halves(spark, d)
    return merge.unshadowed(a.docs, b.paths).select("name")


@query(f"WITH {AB_SQL} SELECT src, name, new_id FROM ids")
def merge_id_map(spark, d):
    a, b = halves(spark, d)
    return merge.id_map(merge.unshadowed(a.docs, b.paths), b.docs).select("src", "name", "new_id")


@query("SELECT '/src' || k AS path FROM (SELECT unnest(range(0, 20)) AS k)")
def merge_paths(spark, d):
    a, b = halves(spark, d)
    return merge.merged_paths(a.paths, b.paths)


@query(f"WITH {AB_SQL} SELECT new_id AS doc_id, name FROM ids")
def merge_names(spark, d):
    a, b = halves(spark, d)
    return a.merge(b).docs.select("doc_id", "name")


@query(f"""WITH {AB_SQL}, h AS (SELECT new_id, hex(encode(text)) AS h FROM ids)
SELECT DISTINCT CAST('0x' || substr(h, 2 * i + 1, 6) AS BIGINT) AS trigram, new_id AS doc_id
FROM (SELECT new_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 2)) AS i FROM h WHERE len(h) >= 6)""")
def merge_postings(spark, d):
    a, b = halves(spark, d)
    return a.merge(b).postings.select(F.col("trigram").cast("long").alias("trigram"), "doc_id")


@query(f"""WITH {AB_SQL}, h AS (SELECT new_id, name, text FROM ids)
SELECT new_id AS doc_id, name FROM h WHERE contains(text, 'newer') AND contains(text, 'ion')""")
def merge_stored(spark, d):
    (a, b), path = halves(spark, d), shared_path(spark, "index")
    a.write(path)
    TrigramIndex.open(spark, path).merge(b).write(path)
    return TrigramIndex.open(spark, path).candidates("newer.*ion|ion.*newer").select("doc_id", "name")


@query(f"WITH {AB_SQL} SELECT name FROM m WHERE contains(text, 'eau')")
def segments_search(spark, d):
    root = shared_path(spark, "segments")
    for k, ix in enumerate(halves(spark, d)):
        ingest.write_segment(ix, root, k)
    return ingest.latest(spark, root).candidates("eau").select("name")


# Inspection


@query(f"WITH {FILES_SQL} SELECT doc_id, name FROM f ORDER BY doc_id")
def inspect_files(spark, d):
    return inspect.files(index(spark, d).docs).orderBy("doc_id")


@query(f"WITH {GRAMS_SQL} SELECT DISTINCT trigram >> 16 AS b0, (trigram >> 8) & 255 AS b1, trigram & 255 AS b2 FROM p")
def inspect_trigrams(spark, d):
    return inspect.trigrams(posts(spark, d))


# Pattern -> trigram query, by value


GOLDEN = {
    "Abcdef": '"Abc" "bcd" "cde" "def"',
    "abc.*(def|ghi)": '"abc" ("def"|"ghi")',
    "abc(def|ghi)": '"abc" ("bcd" "cde" "def")|("bcg" "cgh" "ghi")',
    "(a+hello|b+world)": '("ahe" "ell" "hel" "llo")|("bwo" "orl" "rld" "wor")',
    "ab[cde]f": '("abc" "bcf")|("abd" "bdf")|("abe" "bef")',
    "(z*abcz*defz*)|(z*(ghi|jkl)z*)": '("ghi"|"jkl")|("abc" "def")',
    "(a|ab)cde": '"cde" ("abc" "bcd")|("acd")',
    "(?i)ab~": '("AB~"|"Ab~"|"aB~"|"ab~")',
    "a.b": "+",
    "[^\\x00-\\x{10FFFF}]abc": "-",
    "z*xy(a+|ba+)": '("xya")|("xyb" "yba")',
}


@query("SELECT * FROM (VALUES " + ", ".join("('" + p + "', '" + q + "')" for p, q in GOLDEN.items()) + ") v(pattern, trigrams)")
def regex_query_golden(spark, d):
    return spark.createDataFrame([(p, trigram_query(p).format()) for p in GOLDEN], "pattern string, trigrams string")
