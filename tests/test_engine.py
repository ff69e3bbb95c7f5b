"""The index, searches and merges against fixtures and brute force."""

from __future__ import annotations

import re
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from gramlake import catalog, commands
from gramlake.functions import trigrams as tg
from gramlake.operators import merge, postings, search
from gramlake.operators.index import TrigramIndex
from gramlake.plans.lower import by_sets
from gramlake.plans.regex import RegexError
from gramlake.plans.trigram_query import trigram_query
from gramlake.sources.files import file_tree
from gramlake.streaming import ingest
from gramlake.streaming.ingest import latest, stream_files

from .oracle import differences

SF = "/root/testdata/sf0.001"


def built(spark, rows, roots=(), limits=tg.Limits()):
    return TrigramIndex.build(spark, spark.createDataFrame(rows, "name string, content string"), list(roots), limits)


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


# Names, texts, expected ids and offsets of this file's index and merge cases; results must equal them.


def test_posting_lists(spark):
    ix = built(spark, [("file0", ""), ("file1", "Google Code Search"), ("file2", "Google Code Project Hosting"), ("file3", "Google Web Search")])
    sea, goo = ix.posting_list(b"Sea"), ix.posting_list(b"Goo")
    assert ids(sea) == [1, 3] and ids(goo) == [1, 2, 3]
    assert ids(ix.and_(sea, b"Goo")) == ids(ix.and_(goo, b"Sea")) == [1, 3]
    assert ids(ix.or_(sea, b"Goo")) == [1, 2, 3] and ids(ix.or_(sea, b"zzz")) == [1, 3]
    assert ids(ix.posting_list(b"Goo", sea)) == [1, 3] and ids(ix.docs) == [0, 1, 2, 3]


def test_index_layout(spark):
    ix = built(spark, [("thefile2", "\nab\n"), ("file3", "\nabc\n"), ("afile4", "\ndabc\n"), ("file1", "\na\n"), ("file5", "\nxyzw\n"), ("f0", "\n\n")])
    assert [r.name for r in ix.docs.orderBy("doc_id").collect()] == ["afile4", "f0", "file1", "file3", "file5", "thefile2"]
    got = {r.trigram.to_bytes(3, "big"): (r.doc_count, r.offset) for r in postings.list_offsets(ix.postings).collect()}
    assert got == {b"\na\n": (1, 0), b"\nab": (2, 5), b"\nda": (1, 11), b"\nxy": (1, 16), b"ab\n": (1, 21), b"abc": (2, 26), b"bc\n": (2, 32), b"dab": (1, 38), b"xyz": (1, 43), b"yzw": (1, 48), b"zw\n": (1, 53)}


@pytest.mark.parametrize(
    ("content", "limits", "reason"),
    [
        (b"", {}, None), (b"\0a", {}, None), (b"\0abc", {}, None), (b"a\0bc", {}, tg.BINARY), (b"ab\0", {}, tg.BINARY),
        (b"x" * 13, {"max_line_len": 10}, None), (b"x" * 14, {"max_line_len": 10}, tg.LINE_TOO_LONG),
        (b"x" * 12 + b"\n", {"max_line_len": 10}, None), (b"x" * 13 + b"\n", {"max_line_len": 10}, tg.LINE_TOO_LONG),
        (b"ab\n" + b"x" * 11, {"max_line_len": 10}, None), (b"ab\n" + b"x" * 11 + b"\n", {"max_line_len": 10}, tg.LINE_TOO_LONG), (b"ab\n" + b"x" * 12, {"max_line_len": 10}, tg.LINE_TOO_LONG),
        (b"\n" + b"x" * 12, {"max_line_len": 10}, None), (b"\n" + b"x" * 13, {"max_line_len": 10}, tg.LINE_TOO_LONG),
        (b"abcd", {"max_file_len": 3}, tg.TOO_LONG), (b"abcdef", {"max_trigrams": 3}, tg.TOO_MANY), (b"abcde", {"max_trigrams": 3}, None),
        (b"ab" + b"\xff" * 20, {}, tg.INVALID_UTF8), (b"a" * 30 + b"\xff" + b"a" * 30, {}, None),
    ],
)
def test_skip_rules(spark, content, limits, reason):
    assert tg.examined(content, tg.Limits(**limits))[1] == reason
    if "max_line_len" in limits:
        row = spark.createDataFrame([(content.decode(),)], "t string").select(tg.line_too_long(F.col("t"), 10)).first()
        assert row[0] == (reason is not None)


def test_trigrams_in_order():
    assert tg.examined(b"hello", tg.Limits())[0].tolist() == sorted(tg.packed(g) for g in (b"hel", b"ell", b"llo"))


def test_trigram_counts(spark):
    rows = [(1, "hello"), (1, "hello hé"), (2, None), (3, "ab"), (None, "xyz"), (4, "aaaaa" * 9), (5, ""), (6, "ab\0c"), (7, "x" * 70 + "yz"), (None, "xyzxyz"), (7, "")]
    want = {}
    for ident, text in rows:
        b = (text or "").encode()
        for k in range(len(b) - 2):
            key = ident, tg.packed(b[k : k + 3])
            want[key] = want.get(key, 0) + 1
    files = spark.createDataFrame(rows, "doc_id long, content string")
    small = [pa.array([(t or "").encode() for _, t in rows], pa.binary()).slice(k) for k in range(3)]
    for size in (1, 7, 1 << 20):  # pieces that cut texts anywhere
        for texts in small:
            got = {}
            for keys, n in tg.counted(texts, np.arange(len(texts)), size):
                for key, c in zip(keys.tolist(), n.tolist(), strict=True):
                    got[key] = got.get(key, 0) + c
            assert sum(got.values()) == sum(max(0, len(t) - 2) for t in texts.to_pylist())
    for n in (1, 3):
        got = [tuple(r) for r in tg.trigram_counts(files.repartition(n)).collect()]
        assert len(got) == len(want) and {(i, t): c for i, t, c in got} == want


def test_long_texts_take_time_by_their_bytes(spark, tmp_path):
    text = " ".join(str(k * 7919 % 1000003) for k in range(60_000))
    spark.createDataFrame([(5, text, "src1")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    start = time.monotonic()
    assert sum(r.n for r in catalog.QUERIES["trigrams_explode"](spark, str(tmp_path)).collect()) == len(text) - 2
    assert ids(catalog.QUERIES["skip_too_many_trigrams"](spark, str(tmp_path))) == [5]
    assert time.monotonic() - start < 30  # by the square of the length it took minutes


def test_batches_are_examined_in_parts(monkeypatch):
    """A task's memory beside its batch doesn't grow with the batch: what it gives back comes in small parts, with all rows."""
    import pyspark

    class Rows:
        schema = StructType([StructField("name", StringType()), StructField("content", BinaryType()), StructField("error", StringType())])
        columns = schema.names
        mapInArrow = staticmethod(lambda run, _: run)  # noqa: N815

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda _: SimpleNamespace(partitionId=lambda: 7)))
    names = [f"/a/{k // 3:05d}" if k % 9 < 3 else f"/b/{k:05d}" for k in range(4000)]
    contents = [None if k % 500 == 0 else (f"{k} " * 1000).encode()[: 1 + k] for k in range(4000)]
    contents[77] = b"x" * (3 << 20)
    b = pa.RecordBatch.from_arrays([pa.array(names), pa.array(contents, pa.binary()), pa.array([None] * 4000, pa.string())], ["name", "content", "error"])
    out = list(tg.numbered(Rows(), tg.NO_LIMITS)(iter([b])))
    whole = pa.Table.from_batches(out)
    kept = [k for k in range(4000) if k == 0 or names[k] != names[k - 1]]
    assert whole["name"].to_pylist() == [names[k] for k in kept] and whole["content"].to_pylist() == [contents[k] for k in kept]
    assert whole["local"].to_pylist() == list(range(len(kept))) and set(whole["part"].to_pylist()) == {7}
    assert [len(g) for g in whole["grams"].to_pylist()] == [len(tg.examined(contents[k], tg.NO_LIMITS)[0]) for k in kept]
    assert len(out) > 5 and max(o.column("content").nbytes for o in out if o.num_rows > 1) <= 1 << 21


A = [("/a/x", "hello world"), ("/a/y", "goodbye world"), ("/b/xx", "now is the time"), ("/b/xy", "for all good men"), ("/c/ab", "give me all the potatoes"), ("/c/de", "or give me death now")]
B = [("/b/www", "world wide indeed"), ("/b/xx", "no, not now"), ("/b/yy", "first potatoes, now liberty?"), ("/cc", "come to the aid of his potatoes")]


def test_merge(spark):
    m = built(spark, A, ["/a", "/b", "/c"]).merge(built(spark, B, ["/b", "/cc"]))
    assert [r.name for r in m.docs.orderBy("doc_id").collect()] == ["/a/x", "/a/y", "/b/www", "/b/xx", "/b/yy", "/c/ab", "/c/de", "/cc"]
    for gram, want in ((b"all", [5]), (b"wor", [0, 1, 2]), (b"now", [3, 4, 6]), (b"pot", [4, 5, 7])):
        assert ids(m.posting_list(gram)) == want
    fresh = built(spark, [r for r in A if not r[0].startswith("/b/")] + B)
    assert sorted(map(tuple, m.postings.collect())) == sorted(map(tuple, fresh.postings.collect()))
    assert sorted(r.path for r in m.paths.collect()) == ["/a", "/b", "/c", "/cc"]
    with pytest.raises(ValueError):
        built(spark, A).merge(built(spark, B, ["/b"]))


def test_merging_sorts_no_postings(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a, b = built(spark, A, ["/a", "/b", "/c"]), built(spark, B, ["/b", "/cc"])
        ids = merge.id_map(a.docs.where("name not like '/b/%'"), b.docs)
        plan = merge.merged_postings(a.postings, b.postings, ids)._jdf.queryExecution().executedPlan().toString()
        top = plan[: plan.index("Generate explode")]
        assert "ShuffledHashJoin" in top and "Sort " not in top
        for k, ix in enumerate((a, b)):
            ingest.write_segment(ix, str(tmp_path), k)
        shown = latest(spark, str(tmp_path)).postings._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"ShuffledHashJoin \[doc_id#\d+L\], \[doc_id#\d+L\], LeftSemi", shown)
        assert sorted(map(tuple, a.merge(b).postings.collect())) == sorted(map(tuple, built(spark, [r for r in A if not r[0].startswith("/b/")] + B).postings.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_merge_by_component_or_prefix(spark):
    a, b = built(spark, [("/bb/x", "one")], ["/bb"]), built(spark, [("/b/y", "two")], ["/b"])
    assert a.merge(b).docs.count() == 2
    assert a.merge(b, compat_prefix=True).docs.count() == 1


ROWS = [("/p/a.txt", "one tion the\nTwo\r\nno final"), ("/p/b.txt", "xyba\nxyba\n\nthe end\n"), ("/q/c.txt", "ÉCOLE école\nthing"), ("/q/d.txt", "")]


@pytest.mark.parametrize("pattern", ["the", "z*xy(a+|ba+)", "(?i)école", "^$", "t.*n", ".", "[^\\x00-\\x{10FFFF}]", r"\bno\b", "final$", "Two\r$", "a|e|o"])
def test_search_equals_brute_force(spark, pattern):
    ix = built(spark, ROWS)
    indexed, brute = (sorted(map(tuple, ix.search(pattern, brute=b, unicode=True).collect())) for b in (False, True))
    assert indexed == brute
    q = trigram_query(pattern, unicode=True)
    assert ids(ix.query(q)) == ids(by_sets(q, ix.docs, ix.postings))
    assert {r[0] for r in indexed} <= set(ids(ix.candidates(pattern, unicode=True)))


def test_output(spark):
    ix = built(spark, ROWS)
    found = ix.search("xyba", max_count=1)
    assert [r.output for r in search.formatted(found, line_numbers=True, relative_to="/p").collect()] == ["b.txt:1:xyba"]
    assert [r.output for r in search.formatted(found, "vs").collect()] == ["/p/b.txt(1):xyba"]
    assert [tuple(r)[1:] for r in ix.search_counts("xyba").collect()] == [("/p/b.txt", 2)]
    assert [r.name for r in ix.search_files("the", file_pattern="b").collect()] == ["/p/b.txt"]
    assert [r.line for r in ix.search("école", ignore_case=True, unicode=True).collect()] == ["ÉCOLE école"]
    with pytest.raises(RegexError):
        ix.search("a\nb")


def test_files_and_storage(spark, tmp_path):
    (tmp_path / "x" / "skip").mkdir(parents=True)
    (tmp_path / "x" / "one.txt").write_text("hello trigram\n")
    (tmp_path / "x" / "skip" / "two.txt").write_text("hello trigram\n")
    (tmp_path / "x" / "bin").write_bytes(b"ab\0cd")
    (tmp_path / "x" / "gone").symlink_to(tmp_path / "nowhere")
    files = file_tree(spark, [str(tmp_path / "x")], ["skip"])
    assert sorted((r.name.rsplit("/", 1)[1], r.error) for r in files.collect()) in ([("bin", None), ("one.txt", None)], [("bin", None), ("gone", tg.IO), ("one.txt", None)])
    broken = spark.createDataFrame([("/u", None, tg.IO), ("/v", bytearray(b"fine text"), None)], "name string, content binary, error string")
    ix = TrigramIndex.build(spark, broken)
    assert [tuple(r) for r in ix.skipped.collect()] == [("/u", tg.IO)] and [r.name for r in ix.docs.collect()] == ["/v"]
    ix = TrigramIndex.build(spark, files.where("error is null"), [str(tmp_path)])
    ix.write(str(tmp_path / "index"))
    ix = TrigramIndex.open(spark, str(tmp_path / "index"))
    assert [r.line for r in ix.search("tri.ram").collect()] == ["hello trigram"]
    assert [r.reason for r in ix.skipped.collect()] == [tg.BINARY]


def test_streaming(spark, tmp_path):
    spark.createDataFrame([("/a", "first text"), ("/b", "second text")], "name string, content string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("name string, content string").parquet(str(tmp_path / "in"))
    stream_files(source(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("/a", "third text")], "name string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream_files(source(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    ix = latest(spark, str(tmp_path / "out"))
    assert sorted(r.line for r in ix.search("text").collect()) == ["second text", "third text"]


@pytest.mark.parametrize("name", ["trigrams_explode", "skip_line_too_long", "skip_report", "search_candidates", "search_lines", "posting_offsets", "name_offsets", "merge_postings"])
def test_against_sql(spark, name):
    assert not differences(spark, SF, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_are_dense_at_any_size(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 50_000
        files = spark.range(n, numPartitions=13).select(F.concat(F.lit("/f/"), F.sha1(F.col("id").cast("string"))).alias("name"), F.rpad(F.concat(F.lit("text "), F.col("id").cast("string")), 2000, "x").alias("content"))
        ix = TrigramIndex.build(spark, files, ["/f"])
        m = ix.merge(TrigramIndex.build(spark, spark.createDataFrame([("/g/a", "newer text")], "name string, content string"), ["/g"]))
        for index, size in ((ix, n), (m, n + 1)):
            for df in (index.docs, index.contents.select("doc_id", "name"), index.postings.select("doc_id").distinct()):
                got = df.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
                assert tuple(got) == (size, size, 0, size - 1)
        wrong = ix.docs.join(ix.contents.select("name", F.col("doc_id").alias("other")), "name").where("doc_id <> other").count()
        assert wrong == 0 and [r.name for r in ix.docs.orderBy("doc_id").limit(3).collect()] == [r.name for r in ix.docs.orderBy("name").limit(3).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_lists_in_chunks(spark):
    posts = spark.createDataFrame([(t, i) for t in (1, 2) for i in range(0, 100, t)], "trigram int, doc_id long")
    want = {}
    for t in (1, 2):
        own = list(range(0, 100, t))
        want[t] = [(k, a - b) for k, (a, b) in enumerate(zip(own, [-1, *own], strict=False))] + [(len(own), 0)]
    d = postings.deltas(posts, chunk_bits=3)
    assert {t: sorted((r.pos, r.delta) for r in d.collect() if r.trigram == t) for t in (1, 2)} == want
    assert sorted(map(tuple, postings.decoded(d, chunk_bits=2).collect())) == sorted(map(tuple, posts.collect()))
    assert max(len(r.doc_ids) for r in postings.posting_lists(posts, 4).collect()) == 16


def exchanged(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_sizes_of_lists(spark, tmp_path):
    lists = {7: range(0, 1000, 3), 8: [0, 127, 128, 300, 16700, 3_000_000, 3_000_001, 1 << 29], 9: [5], 0xABCDEF: range(100, 40_000, 200)}
    posts = spark.createDataFrame([(t, i) for t, own in lists.items() for i in own], "trigram int, doc_id long")
    want = {}
    for t, own in lists.items():
        deltas = [a - b for a, b in zip(own, [-1, *own], strict=False)]
        want[t] = len(own), 4 + sum(1 + sum(d >= 1 << k for k in (7, 14, 21, 28)) for d in deltas)
    got = lambda df: {r.trigram: (r.doc_count, r.n_bytes) for r in df.collect()}
    for bits in (3, 20):
        assert exchanged(sized := postings.list_sizes(posts, bits)) == 2 and got(sized) == want  # postings once, chunks once
    posts.repartitionByRange(5, "trigram", "doc_id").sortWithinPartitions("trigram", "doc_id").write.option("parquet.block.size", 1024).parquet(str(tmp_path / "p"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size, rows in ((700, 3), (1 << 30, 10), (1 << 30, 10_000)):  # parts of files, and runs that go on in the next batch
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            assert got(postings.stored_sizes(spark.read.schema("trigram int, doc_id long").parquet(str(tmp_path / "p")))) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])


def test_dictionary_sizes_are_worked_out_once(spark, tmp_path, monkeypatch):
    built(spark, A, ["/a", "/b", "/c"]).write(str(tmp_path / "index"))
    ix = TrigramIndex.open(spark, str(tmp_path / "index"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(postings.list_offsets(ix.postings, end=True))
    found = ix.dictionary(end=True)
    assert rows(found) == want and not [f for f in found.inputFiles() if "/postings/" in f]
    monkeypatch.setattr(postings, "list_sizes", None)  # which shuffles postings
    assert rows(ix.dictionary(end=True)) == want


def test_varints(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**21, 2**28, 2**32 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", postings.varint_hex(F.col("v")))
    got = {r.v: (r.b, r.back) for r in rows.withColumn("back", postings.varint_value(F.col("b"))).collect()}
    assert got[300] == ("AC02", 300) and all(got[v][1] == v for v in values)
    odd = spark.createDataFrame([("",), ("80",), ("8080808080808080808001",), ("FFFFFFFFFFFFFFFFFF02",)], "b string")
    assert [r.v for r in odd.select(postings.varint_value(F.col("b")).alias("v")).collect()] == [None] * 4


def test_versions_and_pruning(spark, tmp_path):
    path = str(tmp_path / "index")
    a, b = built(spark, A, ["/a", "/b", "/c"]), built(spark, B, ["/b", "/cc"])
    a.write(path)
    reader = TrigramIndex.open(spark, path)
    reader.merge(b).write(path)  # to where its input lies
    (tmp_path / "index" / "v000000000009-broken" / "docs").mkdir(parents=True)  # an unfinished version
    assert TrigramIndex.open(spark, path).docs.count() == 8 and reader.docs.count() == 6
    found = TrigramIndex.open(spark, path).search("potatoes")
    assert found.count() == 3
    assert "PartitionFilters: [isnotnull(bucket" in (plan := found._jdf.queryExecution().toString()) or "bucket" in plan.split("PartitionFilters")[1][:80]
    assert TrigramIndex.reset(spark, path)
    with pytest.raises(FileNotFoundError):
        TrigramIndex.open(spark, path)


def test_merged_paths_by_slashes(spark):
    p = lambda *x: spark.createDataFrame([(v,) for v in x], "path string")
    got = lambda a, b, **k: sorted(r.path for r in merge.merged_paths(a, b, **k).collect())
    assert got(p("/a", "/a/b/c", "/bb"), p("/a/", "/b")) == ["/a", "/b", "/bb"]
    assert got(p("/a", "/bb"), p("/b", "/a"), compat_prefix=True) == ["/a", "/b"]
    assert got(p("/", "/x"), p("/y/z")) == ["/"]


def test_commands(spark, tmp_path, caplog):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("hello there\nno\nhello again\n")
    (tmp_path / "src" / "b.bin").write_bytes(b"ab\0cd")
    where, said = ["--indexpath", str(tmp_path / "ix")], []
    commands.index(spark, [*where, "--logskip", str(tmp_path / "src"), str(tmp_path / "src" / "a.txt")], said.append)
    assert said == [f"{tmp_path}/src/b.bin: skipped: {tg.BINARY}"] and "no directory" in caplog.text
    (tmp_path / "src" / "c.txt").write_text("hello new\n")
    commands.index(spark, where)  # the known paths again
    out = lambda *argv: [r.output for r in commands.found(spark, [*where, *argv]).collect()]
    name = f"{tmp_path}/src/a.txt"
    assert out("-n", "-m", "1", "hello") == [f"{name}:1:hello there", f"{tmp_path}/src/c.txt:1:hello new"]
    assert out("-c", "-G", "a[.]txt", "HELLO", "-i") == [f"{name}: 2"] and out("-l", "again") == [name] == out("--files", "there")
    assert out("--format-vs", "again") == [f"{name}(3):hello again"]
    said.clear()
    commands.index(spark, [*where, "--list"], said.append)
    assert said == [f"{tmp_path}/src"]
    commands.index(spark, [*where, "--reset"])
    with pytest.raises(SystemExit):
        commands.index(spark, [*where, "--reset", "--list"])


def test_segments(spark, tmp_path):
    root = str(tmp_path / "s")
    for k, text in enumerate(["first text", "second text", "third text"]):
        ingest.write_segment(built(spark, [("/a", text), (f"/{k}", "other text")]), root, k)
    ingest.write_segment(built(spark, [("/a", "again text")]), root, 2)  # a batch that runs twice
    lines = lambda: sorted(r.line for r in latest(spark, root).search("text").collect())
    assert lines() == ["again text", "other text", "other text"]
    ingest.compact(spark, root)
    assert len(ingest.live_segments(spark, root)) == 1 and lines() == ["again text", "other text", "other text"]
    assert ids(latest(spark, root).docs) == [0, 1, 2]
    ingest.write_segment(built(spark, [("/0", "x"), ("/a", "last text")]), root, 3)
    assert lines() == ["last text", "other text"]
