"""The corpus operators against brute force, exact round trips and planted cases, on small tables with nulls, ties and odd columns."""

from __future__ import annotations

import hashlib
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gramlake.llm import common, decontaminate, html_extract, language_id, license_scan, linking, media_match, ngram_join, packing, registry, token_counts, token_files, toxicity
from gramlake.llm.bpe import PieceEncoder

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, shard string, ids string"
ODD = [None, "", " ", "\n", "One two  three\n\nfour", "don't we'll <|endoftext|> it.", "x " * 9000, "naïve ΑΣ 中文 字 é", "the same words here", "the same words here", "a\tb\x85c", "\x1c .,;"]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(k, t, "en", "s", "clash", "clash") for k, t in enumerate(ODD)], SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize(("path", "spaces", "width"), [(BYTE, "kept", 4), (WORD, "dropped", 2)])
def test_piecewise_ids_are_the_librarys(path, spaces, width):
    rng = np.random.default_rng(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choice(list(" \n.,'saé1\t<!Σ"), n)) for n in rng.integers(0, 40, 3000)]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, f"<u{width}").tolist() for x in PieceEncoder.get(path, spaces, width).ids(texts)] == want


@pytest.mark.parametrize(("path", "spaces", "width"), [(BYTE, "kept", 4), (WORD, "dropped", 2)])
def test_piecewise_ids_after_clearing_and_in_parts(path, spaces, width, monkeypatch):
    """A small table that starts anew often, batches of some bytes and long texts cut into parts give the library's ids too."""
    from gramlake.llm import bpe

    monkeypatch.setattr(bpe, "BATCH_BYTES", 300)
    monkeypatch.setattr(bpe, "ODD_BYTES", 200)
    rng = np.random.default_rng(4)
    alphabet = list("  \n.,'stredÉÀ×÷éß1\t\r\u0301<|Σšжя³½中\x1c\x00")
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 800)] + ["ab cd " * 700 + "中" * 50, "x" * 5000, " ", "Don't we'LL 12345 <|endoftext|> É́ "]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    enc = PieceEncoder(path, spaces, width, 50)
    assert [np.frombuffer(x, f"<u{width}").tolist() for x in enc.ids(texts)] == want
    flat, counts = enc.ended(pa.array(texts).slice(3, 5), 7)
    assert flat.tolist() == [i for w in want[3:8] for i in [*w, 7]] and counts.tolist() == [len(w) + 1 for w in want[3:8]]
    assert enc.encode(pa.array(texts, pa.string()), counts_only=True)[1].tolist() == [len(w) for w in want]


def test_piecewise_table_grows():
    texts = [",".join(map(str, range(k, k + 30_000))) for k in (0, 20_000, 60_000)]  # one text's pieces pass the table's size
    enc = PieceEncoder(BYTE, "kept", 4, 50)
    want = [x.ids for x in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.ids(texts)] == want and len(enc.table) > 1 << 16


def test_token_counts(docs, empty):
    tk = Tokenizer.from_file(BYTE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTE).collect()}
    want = {}
    for k, t in enumerate(ODD):
        n = len(tk.encode(t or "", add_special_tokens=False).ids)
        want[k] = (len((t or "").encode()), n, n > 1024)
    assert got == want
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_token_files_round_trip(spark, docs, tmp_path):
    tk = Tokenizer.from_file(BYTE)
    token_files.write_token_files(docs, str(tmp_path / "t"), BYTE, parts=3)
    back = token_files.read_token_files(spark, str(tmp_path / "t"))
    ids = [tk.encode(t or "", add_special_tokens=False).ids + [0] for t in ODD]
    assert [r.ids for r in back.orderBy("doc_id").collect()] == ids
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.checksums(back).collect()}
    assert got == {k: (starts[k], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)}


def test_packing_places_each_id_once(docs, empty):
    tk = Tokenizer.from_file(WORD)
    want = {k: [*tk.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(ODD)}
    rows = packing.pack(docs, WORD, window=256).collect()
    for k, ids in want.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in {r.sequence_id for r in rows}:
        part = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        end = 0
        for offset, length in part:
            assert offset == end
            end += length
        assert end <= 256 and (end == 256 or end & (end - 1) == 0)
    assert packing.pack(empty, WORD).count() == 0


def test_packing_prefers_neighbours():
    a, b = np.arange(100, 160, dtype=np.uint16), np.arange(900, 960, dtype=np.uint16)
    first = packing.pack_shard([60, 60, 60, 60], [a, b, b, a], 120)[0]
    assert {r for r, _, _ in first} in ({0, 3}, {1, 2})


def test_packing_brings_copies_together_across_shards(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in ("river", "stone", "cloud", "apple", "horse", "table") for b in ("man", "land", "ship", "work")]
    texts = [" ".join(rng.permutation(words[4 * (k % 6) : 4 * (k % 6) + 4] * 15)) for k in range(36)]
    rows = spark.createDataFrame([(k, texts[k % 36]) for k in range(72)], "doc_id long, text string")
    got = packing.pack(rows, WORD, window=256, shard_tokens=500).collect()
    assert len({r.sequence_id >> 32 for r in got}) > 3
    tasks = {k: {r.sequence_id >> 32 for r in got if r.doc_id == k} for k in range(72)}
    assert sum(bool(tasks[k] & tasks[k + 36]) for k in range(36)) >= 30  # 36 in the number of tasks are expected of a hash


def test_packing_statistics_are_of_all_pieces():
    a, b = np.array([1, 1, 2], np.uint16), np.array([2, 3], np.uint16)
    whole = packing.Statistics.of([a, b, b])
    assert whole.df[:4].tolist() == [0, 1, 3, 2] and whole.mean == 7 / 3
    assert whole.route(a) == (2, -1, -1) and sorted(whole.route(b)) == [-1, 2, 3]
    index = packing.ShardIndex([a], whole)
    assert index.weight[index.first[2]] == whole.weights(np.array([2]), np.array([1]), 3)[0]


def test_packing_routes_by_likeness():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 5000, 300).astype(np.uint16) for _ in range(200)]
    edited = [np.where(rng.random(300) < 0.1, rng.integers(0, 5000, 300), b).astype(np.uint16) for b in base]
    s = packing.Statistics.of([*base, *edited])
    same = [s.route(a)[0] == s.route(b)[0] for a, b in zip(base, edited, strict=True)]
    other = [s.route(a)[0] == s.route(b)[0] for a, b in zip(base, edited[1:], strict=False)]
    assert np.mean(same) > 0.7 and np.mean(other) < 0.15


def test_packing_neighbours_equal_brute_force():
    rng = np.random.default_rng(6)
    pieces = [rng.integers(0, 60, rng.integers(0, 30)).astype(np.uint16) for _ in range(80)]
    s = packing.Statistics.of(pieces)
    index, unused = packing.ShardIndex(pieces, s), np.ones(80, bool)
    for k in range(80):
        unused[k] = False
        index.drop(unused)
        score = {d: sum(float(s.weights(np.array([t]), np.array([(p == t).sum()]), len(p))[0]) for t in set(pieces[k].tolist()) & set(p.tolist())) for d, p in enumerate(pieces) if unused[d]}
        got = index.neighbours(k, unused).tolist()
        assert set(got) == {d for d, x in score.items() if x > 0}
        assert all(score[a] > score[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))


def test_language_id(spark, empty):
    rows = [(k, "the cat and the dog sit in the house" if k % 2 else "der Hund und die Katze sind in dem Haus", "en" if k % 2 else "de", "s", "", "") for k in range(40)]
    profiles = language_id.fit_profiles(spark.createDataFrame(rows, SCHEMA))
    assert profiles.predict("the house and the cat")[0] == "en" and profiles.predict("die Katze und der Hund")[0] == "de"
    assert profiles.predict(None) == profiles.predict("12 !") == profiles.predict("½ ² ① Ⅷ") == ("und", 0.0)
    assert profiles.predict("½ the house ²")[0] == "en"
    assert language_id.identify(empty, profiles).count() == 0
    test = spark.createDataFrame([(1, None), (2, "123"), (3, "in the house"), (4, "ツ")], "doc_id long, text string")
    assert [r.doc_id for r in language_id.keep_identified(test, profiles).collect()] == [3]
    assert language_id.fit_profiles(empty).predict("word") == ("und", 0.0)


def test_language_id_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.lang, r.text) for r in docs.collect() if r.text]
    profiles = language_id.fit_profiles(docs, size=80)

    def ranking(texts):
        counts = {}
        for t in texts:
            for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
                grams = [*w, *(f" {w} "[k : k + 2] for k in range(len(w) + 1)), *(f" {w} "[k : k + 3] for k in range(len(w)))]
                for g in grams:
                    counts[g] = counts.get(g, 0) + 1
        key = lambda g: int("".join(f"{ord(c):05x}" for c in g), 16)  # noqa: E731  ties by code
        return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], key(g)))[:80])}

    known = {lang: ranking([t for x, t in texts if x == lang]) for lang in {x for x, _ in texts if x}}
    assert profiles.languages == sorted(known)
    for _, text in texts[:60]:
        mine = ranking([text])
        apart = [sum(abs(r - known[lang][g]) if g in known[lang] else 80 for g, r in mine.items()) for lang in sorted(known)]
        got = profiles.distances(text)
        assert (got is None and not mine) or got[0].tolist() == apart


def test_language_id_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = language_id.op4_language_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_toxicity_grammar():
    g = toxicity.Grammar({"idiot": 2.0, "fool": 3.0}, {"vequ": 4.0})
    plain, negated, said = (g.score(t) for t in ("he is an idiot", "he is not an idiot", "she said he is an idiot"))
    assert plain > negated > 0 and plain > said > 0
    assert g.score("I will kill you") > 0 and g.score("kill the process") == 0
    assert g.score(None) == g.score("") == g.score("a clean text. not more") == g.score("idiots, foolish unfool") == 0
    assert g.score("la vequoir est") >= 0.3
    text = "All is well. You are an idiot! The end"
    assert [text[a:b].strip() for a, b, _ in g.matches(text)] == ["You are an idiot"]
    text = "İİİ. An IDIOT here. End"  # lower-casing makes these longer
    assert [text[a:b].strip() for a, b, _ in g.matches(text)] == ["An IDIOT here"]


def by_rules(g, words):
    """A clause's weight, rule by rule, without any machine."""
    kinds, total, threat = [g.symbol(w) for w in words], 0.0, None
    near = lambda k, on, reach: any(kinds[j][0] == on for j in range(max(0, k - reach + 1) if reach else 0, k + 1))
    for k, (kind, value) in enumerate(kinds):
        weak = (0.5 if near(k, toxicity.NEGATION, 3) else 1) * (0.7 if near(k, toxicity.REPORT, 0) else 1)
        if kind == toxicity.INSULT:
            total += value * weak * (1.25 if near(k, toxicity.TARGET, 3) else 1)
        if kind == toxicity.THREAT:
            threat = (k, weak)
        elif kind == toxicity.TARGET and threat and k - threat[0] <= 3:
            total, threat = total + 1.5 * threat[1], None
    return total


def test_toxicity_machine_equals_its_rules():
    g, rng = toxicity.Grammar({"idiot": 2.0, "fool": 3.0}, {"vequ": 4.0}), np.random.default_rng(1)
    pool = ["idiot", "fool", "vequor", "kill", "hurt", "you", "him", "not", "never", "said", "claims", "the", "a", "house"]
    for _ in range(3000):
        words = rng.choice(pool, rng.integers(0, 12)).tolist()
        assert g.clause(words) == pytest.approx(by_rules(g, words))
    heads = ["".join(rng.choice(list("abé.+"), rng.integers(1, 5))) for _ in range(40)]
    pattern = re.compile(toxicity.trie(heads))
    for text in ("".join(rng.choice(list("abé.+"), 6)) for _ in range(300)):
        m, known = pattern.match(text), [h for h in heads if text.startswith(h)]
        assert (m.group() if m else "") == max(known, key=len, default="")


def test_toxicity_fit_and_scores(spark, empty):
    rng = np.random.default_rng(9)
    filler = ["word" + "".join(chr(97 + k // 26**i % 26) for i in (0, 1)) for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        words, toxic = rng.choice(filler, 30).tolist(), k % 5 == 0
        if toxic:
            words[int(rng.integers(0, 30))] = ["grobnak", "zottelmann", f"vrix{filler[k % 40][4:]}"][k // 5 % 3]
        rows.append((k, " ".join(words), "en", "s", "clash", "clash"))
        labels += [(k, 1, int(toxic))] * (k != 7)
    docs = spark.createDataFrame([*rows, (900, None, None, None, None, None), (901, "", None, None, None, None), (1, rows[1][1], "en", "s", "", "")], SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 0, None), (12345, 1, 1)], "doc_id long, quality int, toxic int")
    g = toxicity.fit_grammar(toxicity.labelled_rows(docs, marks))
    assert set(g.insults) >= {"grobnak", "zottelmann"} and any(s.startswith("vri") for s in g.stems) and not any("word" in w[:4] for w in [*g.insults, *g.stems])
    got = toxicity.score_documents(docs, g).collect()
    assert len(got) == 603 and all(r.predicted == int(r.doc_id % 5 == 0 and r.doc_id < 900) for r in got)
    assert all(r.score == 0 for r in got if r.doc_id >= 900)
    kept = toxicity.keep_clean(docs, g)
    assert kept.columns == docs.columns and kept.count() == 483
    none = toxicity.fit_grammar(toxicity.labelled_rows(empty, marks))
    assert not none.insults and none.score("grobnak") == 0 and toxicity.score_documents(empty, none).count() == 0


def test_benchmark_windows(spark, docs):
    words = [f"w{k}" for k in range(30)]
    items = spark.createDataFrame([("b", " ".join(words[:12])), ("a", "Short item"), ("c", None), ("d", "...")], "item_id string, text string")
    texts = {1: "É " + "; ".join(words[1:12]).upper() + " tail", 2: "a short ITEM, here", 3: " ".join(words[:9]), 4: None, 5: "shortitem"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_benchmark(rows, items).collect()}
    assert [(got[k].n_words, got[k].n_hit, got[k].n_items) for k in range(1, 6)] == [(13, 11, 1), (4, 2, 1), (9, 0, 0), (0, 0, 0), (1, 0, 0)]
    assert got[1].items_sha256 == hashlib.sha256(b"b").hexdigest() and got[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    s = got[2].spans[0]
    assert texts[2][s["start"] : s["end"]] == "short ITEM"
    s = got[1].spans[0]
    assert texts[1][s["start"] : s["end"]].startswith("W1;")
    assert sorted(r.doc_id for r in decontaminate.remove_benchmark(rows, items).collect()) == [3, 4, 5]
    none = items.limit(0)
    assert not any(r.contaminated for r in decontaminate.find_benchmark(rows, none).collect()) and decontaminate.remove_benchmark(rows, none).count() == 5
    assert decontaminate.find_benchmark(rows.limit(0), items).count() == decontaminate.remove_benchmark(rows.limit(0), items).count() == 0


def test_benchmark_in_parts(spark):
    rng = np.random.default_rng(2)
    items = [(f"i{k}", " ".join(f"w{x}" for x in rng.integers(0, 30, rng.integers(1, 9)))) for k in range(40)]
    docs = [(k, " ".join(f"w{x}" for x in rng.integers(0, 30, rng.integers(0, 200)))) for k in range(60)] + [(60, None), (7, "w1 w2"), (7, "w1 w2")]
    items, docs = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = [sorted(map(tuple, decontaminate.find_benchmark(docs, items, width=3, bound=b).collect())) for b in (1 << 20, 700)]
    assert got[0] == got[1] and len(got[0]) == 63
    kept = [sorted(map(str, decontaminate.remove_benchmark(docs, items, width=3, bound=b).collect())) for b in (1 << 20, 700)]
    assert kept[0] == kept[1]


def classes(texts, width, num, den):
    sets = {k: set(ngram_join.shingles(t, width).tolist()) for k, t in texts.items()}
    parent = {k: k for k in sets}
    for a in sorted(sets):
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                x, y = parent[a], parent[b]
                parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
    return {k: (len(sets[k]), parent[k]) for k in sets}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_ngram_join_equals_brute_force(spark, width, num):
    rng = np.random.default_rng(width)
    texts = {0: None, 1: "", 2: "one two", 3: "one TWO"}
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 40, rng.integers(8, 120))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(0, len(w))] = "changed"
            texts[len(texts)] = " ".join(w)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    join = ngram_join.NgramJoin(rows, width, num, 100)
    got = {r.id: (r.n_shingles, r.component_id) for r in join.classes().collect()}
    assert got == classes(texts, width, num, 100)
    sets = {k: frozenset(ngram_join.shingles(t, width).tolist()) for k, t in texts.items()}
    rep = {k: min(j for j in sets if sets[j] == sets[k]) for k in sets if sets[k]}
    assert dict(join.members().collect()) == rep
    ends = sorted(set(rep.values()))
    want = {(a, b) for a in ends for b in ends if a < b and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    assert {tuple(r) for r in join.links().collect()} == want and want


def test_near_copies_keep_one(docs, empty):
    kept = {r.doc_id for r in ngram_join.drop_near_copies(docs).collect()}
    assert kept == set(range(len(ODD))) - {9}
    assert ngram_join.drop_near_copies(empty).count() == 0


def test_html(spark):
    page = '<html><body><nav><a href="/">Home</a></nav><div class="cookie-notice">Cookies</div><article><h1>A &amp; B</h1><p>One\n two<p><b>Three</b> &lt;x&gt;<script>var t="</p>";</script><aside>Ad</aside><div id="comments"><p>First!</p></div></article><footer>End</footer>'
    assert html_extract.main_text(page, None) == "A & B\nOne two\nThree <x>"
    assert html_extract.main_text(None, None) == html_extract.main_text("", None) == ""
    plain = [(k, "http://h.example/x", f"<body><div class=m><p>Our site</p></div><div class=t><p>Text number {k} of many words</p><p>and {k} more</p></div>") for k in range(6)] + [(9, None, None)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(plain, "page_id long, url string, html string")).collect()}
    assert got[3] == ("Text number 3 of many words\nand 3 more", 38) and got[9] == ("", 0)


def extracted(spark, pages):
    rows = spark.createDataFrame([(k, "http://h.example/x", page) for k, page in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extract.extract(rows).orderBy("page_id").collect()]


def test_html_template_is_read_within_articles(spark):
    page = "<body><article><h1>Title {k}</h1><div class=kicker><p>Part of our series</p></div><p>Body {k}.</p>{more}<div class=outro><p>Thank you for reading</p></div></article>"
    tips = "<div class=tip><p>Tip of the day</p></div>"
    got = extracted(spark, [page.format(k=k, more=tips * (k < 4) + "<p>Thank you for reading</p>" * (k == 5)) for k in range(6)])
    assert got[:5] == [f"Title {k}\nBody {k}." for k in range(5)]
    assert got[5] == "Title 5\nBody 5.\nThank you for reading"  # the same words at another place are no token


def test_html_nested_classes():
    token = lambda role, key, pages, at: {"role": role, "key": key, "n": pages, "free": 0, "pages": pages, "at": at * pages}
    nodes = html_extract.nested([[token("b/p", 1, 6, 0), token("b/p", 2, 6, 9)], [token("b/div/p", 3, 4, 4)]])
    assert [(n["parent"], n["slot"]) for n in nodes] == [(-1, 0), (0, 1)]
    assert html_extract.constant_blocks(["b/p", "b/div/p", "b/p", "b/div/p"], [1, 3, 2, 3], nodes) == {0, 1, 2}


def test_html_class_membership_matters():
    token = lambda role, key, pages, at: {"role": role, "key": key, "n": pages, "free": 0, "pages": pages, "at": at * pages}
    x, y, z = token("b/p", 1, 6, 0), token("b/p", 2, 6, 9), token("b/p", 3, 4, 4)
    page = ["b/p"] * 3, [1, 2, 3]  # the third token stands outside its gap
    apart, together = html_extract.nested([[x, y], [z]]), html_extract.nested([[x, y, z]])
    assert html_extract.constant_blocks(*page, apart) == {0, 1} and html_extract.constant_blocks(*page, together) == {0, 1, 2}


def test_html_names_are_whole_names():
    article = "<p>One sentence of the text.</p><p>And one more of it.</p>"
    whole = "One sentence of the text.\nAnd one more of it."
    for head in ("<div class='layout has-sidebar'>", "<div id=share-wrapper-page>", "<div class=page-with-menu>", "<div class=menu>", "<main class=notice>"):
        assert html_extract.main_text(f"<body>{head}{article}", None) == whole, head
    inner = "<article>" + article + "<div class=notice-board><p>Board</p></div><p class=share>Share</p><div data-hidden=no><p>Seen</p></div></article>"
    assert html_extract.main_text(inner, None) == whole + "\nBoard\nShare\nSeen"
    for other in ("<div class=cookie-notice>", "<div id=comments>", "<div class='x comment-list'>", "<div class=siteFooter>", "<section class=ad>", "<div hidden>", "<div role=navigation>", "<div class=sidebar-left>"):
        assert html_extract.main_text(f"<body><article>{article}{other}<p>Other</p></div></section></article>", None) == whole, other


def test_html_templates_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    pages, want = [], {}
    for host in range(3):
        fixed = [f"fixed words {host} {k}" for k in range(4)]
        for n in range(8):
            body = [f"own words {host} {n} {k}" for k in range(int(rng.integers(1, 4)))]
            shown = [f for f in fixed if rng.random() < 0.8]
            cut = int(rng.integers(0, len(body) + 1))
            parts = shown[:2] + body[:cut] + shown[2:] + body[cut:] if n else fixed[:2] + body + fixed[2:]
            pages.append((100 * host + n, f"https://h{host}.example/{n}", "<body><article>" + "".join(f"<p>{x}</p>" for x in parts) + "</article>", parts))
    for host in range(3):
        own = [p for p in pages if p[0] // 100 == host]
        often = {x for p in own for x in p[3] if sum(x in q[3] for q in own) >= max(3, len(own) / 2)}
        want |= {p[0]: "\n".join(x for x in p[3] if x not in often) for p in own}
    rows = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(rows).collect()}
    assert np.mean([got[k] == want[k] for k in want]) > 0.8  # a token outside its gap is no template text
    assert all(set(want[k].split("\n")) <= set(got[k].split("\n")) for k in want)
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_html_copies_keep_their_article(spark):
    page = "<body><div class=t><p>The article {k} of many words</p><p>and more of {k}</p></div>"
    kept = [f"The article {k} of many words\nand more of {k}" for k in (0, 0, 1, 2)]
    assert extracted(spark, [page.format(k=k) for k in (0, 0, 1, 2)]) == kept
    assert extracted(spark, [page.format(k=k) for k in (0, 0, 0, 0, 0, 1)]) == [kept[0]] * 5 + [kept[2]]


def test_licenses(spark, docs):
    index = license_scan.TemplateIndex(license_scan.known_licenses())
    text = "Ünïcode head.\n" + license_scan.TEMPLATES["mit"].replace("publish, ", "").replace("merge", "blend") + "\nReleased under the MIT License."
    got = index.scan(text)
    assert [m[0] for m in got] == ["mit", "mit-reference"] and got[0][1] > 0.95 and got[1][1] == 1.0
    assert text[got[0][3] : got[0][4]].startswith("Permission is") and text[got[1][3] : got[1][4]] == "under the MIT License"
    assert license_scan.scan_licenses(docs).count() == 0


def test_licenses_back_to_back():
    index = license_scan.TemplateIndex(license_scan.known_licenses())
    for between in ("", " - lib{k}", " - lib{k} of the list, version {k}"):
        text = "".join(f"Released under the MIT License.{between.format(k=k)}\n" for k in range(40))
        got = index.scan(text)
        assert [(m[0], m[1]) for m in got] == [("mit-reference", 1.0)] * 40
        assert [m[3] for m in got] == [m.start() for m in re.finditer("under", text)]


@pytest.mark.parametrize(
    ("line", "name"),
    [("Released under an MIT License.", "mit"), ("You may use it under the terms of the Apache License, Version 2.0!", "apache-2.0"), ("Text is available under CC-BY-SA 4.0", "cc-by-sa-4.0"), ("distributed under a modified BSD license", "bsd-3-clause"), ("under the GNU General Public License, version 2 or later", "gpl-2.0")],
)
def test_license_references(line, name):
    got = license_scan.TemplateIndex(license_scan.known_licenses()).scan(f"some words before. {line}\nand after")
    assert f"{name}-reference" in [m[0] for m in got]


@pytest.mark.parametrize("name", ["apache-2.0", "gpl-3.0", "mpl-2.0", "lgpl-2.1"])
def test_whole_licenses(name):
    index, texts = license_scan.TemplateIndex(license_scan.known_licenses()), dict(license_scan.known_licenses())
    words = texts[name].split()
    edited = " ".join(w for k, w in enumerate(words) if k % 40 != 7)
    got = [m for m in index.scan("Before it.\n" + edited + "\nAfter it.") if m[0] == name]
    assert len(got) == 1 and got[0][1] > 0.95
    assert not [m for m in index.scan(" ".join(words[: len(words) // 2])) if m[0] == name]


def test_license_alignment_equals_brute_force():
    rng = np.random.default_rng(5)
    index = license_scan.TemplateIndex({"t": "a b c d e f g h a b"})
    t = index.codes[0].tolist()
    for _ in range(300):
        words = rng.integers(-1, 8, rng.integers(1, 40))
        lo, d = 0, int(rng.integers(-5, 12))
        table = np.zeros((len(t) + 1, len(words) + 1), int)  # the longest common subsequence within the band
        for i in range(len(t)):
            for k in range(len(words)):
                near = abs(k - i - d) <= license_scan.BAND
                table[i + 1, k + 1] = max(table[i, k + 1], table[i + 1, k], table[i, k] + (t[i] == words[k] and near))
        got = index.align(words, 0, np.full(len(t), d), lo, len(words))
        assert (got[0] if got else 0) == table[-1, -1]
        if got:
            n, a, b = got
            inner = words[a : b + 1].tolist()
            assert words[a] in t and words[b] in t and n <= len(inner)


def test_licenses_in_odd_documents(spark):
    line = "under the MIT License"
    rows = [(1, None, ""), (2, "", ""), (3, line, ""), (3, line, ""), (4, "x " * 300_000 + line, ""), (None, line, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = license_scan.scan_licenses(docs).collect()
    assert sorted((r.doc_id or 0, r.start) for r in got) == [(0, 0), (3, 0), (3, 0), (4, 600_000)]
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0


ENDINGS = {
    "bsd-3-clause": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "isc": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "gpl-3.0-notice": "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/",
    "unlicense": 'In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/',
}


@pytest.mark.parametrize("name", list(ENDINGS))
def test_licenses_are_whole(name):
    index = license_scan.TemplateIndex(license_scan.known_licenses())
    head, end = license_scan.TEMPLATES[name].split(ENDINGS[name][:24])[0], ENDINGS[name]
    text = f"A head.\n{head}{end}"
    got = [m for m in index.scan(text + "> and a tail.") if m[0] == name]
    assert len(got) == 1 and got[0][4] == len(text.rstrip("/"))
    assert all(m[1] < 1 for m in index.scan(head) if m[0] == name)


def test_media(spark):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:96, :96]
    images = {}
    for k in range(4):
        f = sum(rng.normal() * np.cos((np.cos(t) * x + np.sin(t) * y) * 2 * np.pi / n + p) for t, n, p in zip(rng.uniform(0, 3.1, 30), rng.uniform(6, 18, 30), rng.uniform(0, 6, 30), strict=True))
        images[k] = np.clip(128 + 45 * f / f.std(), 0, 255)
    pgm = lambda a: b"P5 %d %d 255\n" % a.shape[::-1] + a.astype(np.uint8).tobytes()
    data = {k: pgm(a) for k, a in images.items()} | {10: pgm(images[0][12:, 9:]), 11: pgm(np.clip(images[1] * 0.8 + 20, 0, 255)), 12: pgm(images[2]), 13: None, 14: b"", 15: b"broken"}
    rows = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in data.items()], "id long, image binary")
    got = {r.id: r.component_id for r in media_match.match_media(rows, "id", "image").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 10: 0, 11: 1, 12: 2, 13: 13, 14: 14, 15: 15}


def test_media_large_images(spark):
    rng = np.random.default_rng(8)
    y, x = np.mgrid[:256, :256]
    images = []
    for _ in range(3):
        f = sum(rng.normal() * np.cos((np.cos(t) * x + np.sin(t) * y) * 2 * np.pi / n + p) for t, n, p in zip(rng.uniform(0, 3.1, 40), rng.uniform(6, 24, 40), rng.uniform(0, 6, 40), strict=True))
        images.append(np.clip(128 + 45 * f / f.std(), 0, 255))
    crop, half = images[0][40:221, 60:241], images[1].reshape(128, 2, 128, 2).mean(axis=(1, 3))
    pgm = lambda a: b"P5 %d %d 255\n" % a.shape[::-1] + a.astype(np.uint8).tobytes()
    rows = spark.createDataFrame([(k, bytearray(pgm(a))) for k, a in enumerate([*images, crop, half])], "id long, image binary")
    assert {r.id: r.component_id for r in media_match.match_media(rows, "id", "image").collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1}


def turned(a, degrees):
    h, w = a.shape
    t, (y, x) = np.deg2rad(degrees), np.mgrid[:h, :w]
    at = np.stack([(np.cos(t) * (x - w / 2) - np.sin(t) * (y - h / 2)) + w / 2, (np.sin(t) * (x - w / 2) + np.cos(t) * (y - h / 2)) + h / 2])
    return media_match.between(a[None], np.zeros(h, np.int64), at[1], at[0])


EDITS = {
    "crop to a half of the area": lambda a: a[18:109, 18:109],
    "half size": lambda a: a.reshape(64, 2, 64, 2).mean(axis=(1, 3)),
    "scale 0.8": lambda a: media_match.resized((a + media_match.box(a, 1)) / 2, 1.25),
    "scale 1.5": lambda a: media_match.resized(a, 1 / 1.5),
    "noise": lambda a: np.clip(a + np.random.default_rng(1).normal(0, 8, a.shape), 0, 255),
    "turn by 20 degrees": lambda a: turned(a, 20),
    "quarter turn": np.rot90,
    "blur": lambda a: media_match.box(a, 1),
    "sixteen greys": lambda a: np.round(a / 16) * 16,
}


def test_media_recall_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:128, :128]
    pgm = lambda a: b"P5 %d %d 255\n" % a.shape[::-1] + np.clip(a, 0, 255).astype(np.uint8).tobytes()
    rows = []
    for k in range(8):
        f = sum(rng.normal() * np.cos((np.cos(t) * x + np.sin(t) * y) * 2 * np.pi / n + p) for t, n, p in zip(rng.uniform(0, 3.1, 40), rng.uniform(6, 30, 40), rng.uniform(0, 6, 40), strict=True))
        a = np.clip(128 + 45 * f / f.std(), 0, 255)
        rows += [(100 * k + e, bytearray(pgm(edit(a)))) for e, edit in enumerate([lambda a: a, *EDITS.values()])]
    got = {r.id: r.component_id for r in media_match.match_media(spark.createDataFrame(rows, "id long, image binary"), "id", "image").collect()}
    found = {name: np.mean([got[100 * k + e + 1] == got[100 * k] for k in range(8)]) for e, name in enumerate(EDITS)}
    assert min(found.values()) >= 0.9, found
    assert len(set(got.values())) >= 8 and all(v // 100 == k // 100 for k, v in got.items())
    points = dict(zip([i for i, _ in rows], media_match.keypoints([media_match.decode(bytes(d)) for _, d in rows]), strict=True))
    ids = sorted(points)
    pairs = [(a, b) for a in ids for b in ids if a < b and (a // 100 == b // 100 or (a + b) % 61 == 0)]
    brute = [p for p in pairs if media_match.alike(points[p[0]][0], points[p[1]][0], *(np.ascontiguousarray(points[i][1]).view(np.uint64).reshape(-1, 4) for i in p))]
    assert np.mean([got[a] == got[b] for a, b in brute]) >= 0.9 and all(a // 100 == b // 100 for a, b in brute)


def test_differing_bits_with_signs():
    u = np.array([0, -1, 5, -(2**63), 2**63 - 1], np.int64)
    v = np.array([-(2**63) | 1, 0, 5, 3, -(2**63)], np.int64)
    assert media_match.differing(u, v).tolist() == [2, 64, 0, 3, 64]


def test_media_points_stay_where_they_lie(spark):
    rng = np.random.default_rng(11)
    y, x = np.mgrid[:128, :128]
    pgm = lambda a: b"P5 %d %d 255\n" % a.shape[::-1] + np.clip(a, 0, 255).astype(np.uint8).tobytes()
    images = {}
    for k in range(60):
        f = sum(rng.normal() * np.cos((np.cos(t) * x + np.sin(t) * y) * 2 * np.pi / n + p) for t, n, p in zip(rng.uniform(0, 3.1, 30), rng.uniform(5, 16, 30), rng.uniform(0, 6, 30), strict=True))
        images[k] = np.clip(128 + 45 * f / f.std(), 0, 255)
    images |= {100 + k: images[k] * 0.8 + 20 for k in range(4)} | {200 + k: images[k][9:, 7:] for k in range(4)}
    data = [(k, bytearray(pgm(a))) for k, a in images.items()]
    size = sum(40 * len(p) for p, _ in media_match.keypoints([media_match.decode(bytes(d)) for _, d in data]))
    moved = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = moved()
    got = {r.id: r.component_id for r in media_match.match_media(spark.createDataFrame(data, "id long, image binary"), "id", "image").collect()}
    assert got == {k: k % 100 for k in images}
    assert moved() - before < 3 * size, (moved() - before, size)


def test_written_files_are_small(spark):
    out = common.written(spark.range(0, 100, 1, 2), "few", 20)
    assert sorted(r.id for r in out.collect()) == list(range(100))
    assert max(r["count"] for r in out.groupBy(F.input_file_name()).count().collect()) <= 20


def test_media_repeats_and_empty_tables(spark):
    blank = b"P5 32 32 255\n" + bytes(1024)
    rows = spark.createDataFrame([(1, bytearray(blank), "x"), (1, bytearray(b"other"), "x"), (2, bytearray(blank), "y"), (None, bytearray(blank), "z")], "id long, data binary, component_id string")
    assert sorted((r.id or 0, r.component_id) for r in media_match.match_media(rows, "id", "data").collect() if r.id) == [(1, 1), (1, 1), (2, 1)]
    assert media_match.match_media(rows.limit(0), "id", "data").count() == 0


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    from ..oracle import differences

    assert not differences(spark, SF, registry.QUERIES[name], registry.ORACLE_SQL[name])


ODD_DOCS = [
    (1, None, "en", "s", "a"), (2, "", "en", "s", "a"), (3, "½ ²", None, None, None), (4, "a clean text about the house and the garden", "en", "s", "a"),
    (4, "a clean text about the house and the garden", "en", "s", "a"), (5, "word " * 60_000, "en", "s", "a"), (None, "the house and the garden again", None, "s", "a"),
]


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_on_odd_rows(spark, stage):
    import corpus_pipeline

    name, run = corpus_pipeline.STAGES[stage]
    schema = "doc_id long, text string, lang string, source string, n_chars string, `a.b` string, id string, _language string, component string"
    docs = spark.createDataFrame([(*r, "x", "y", "z", "c") for r in ODD_DOCS], schema)
    out = run(spark, docs, SF)
    if stage < 4:
        assert out.columns == docs.columns
        kept = sorted((r["doc_id"] or 0) for r in out.collect())
        assert kept == ([0, 4, 4, 5] if stage == 0 else [0, 1, 2, 3, 4, 4, 5])
    else:
        assert {r.doc_id for r in out.collect()} == {None, 1, 2, 3, 4, 5}
    assert run(spark, docs.limit(0), SF).count() == 0


def test_pipeline_equals_its_stages_by_hand(spark):
    """The near-copy and benchmark stages by brute force, the others' rejections by their own per-text functions."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    profiles = language_id.fit_profiles(language_id.training_rows(docs))
    kept = {k: t for k, t in texts.items() if profiles.predict(t)[1] > 0}
    fit = docs.where(F.col("doc_id").isin(list(kept)))
    grammar = toxicity.fit_grammar(toxicity.labelled_rows(fit, spark.read.parquet(f"{SF}/labels.parquet")))
    kept = {k: t for k, t in kept.items() if grammar.score(t) < 0.3}
    near = classes(kept, 5, 80, 100)
    kept = {k: t for k, t in kept.items() if near[k][1] == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w.split(b" ")) for _, t in items for w in decontaminate.windows_of(decontaminate.normal(t).split(), 10)}

    def hit(text):
        words = decontaminate.normal(text).split()
        return any(tuple(words[k : k + n]) in windows for n in {len(w) for w in windows} for k in range(len(words) - n + 1))

    kept = {k for k, t in kept.items() if not hit(t)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == kept


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len({r.doc_id for r in rows}) <= 200


def test_whole_runs_cut_no_run():
    rng = np.random.default_rng(3)
    key = np.sort(np.concatenate([rng.integers(0, 40, 300), np.full(200, 17)]))
    for width in (1, 7, 64, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[k : k + width])], ["key"]) for k in range(0, len(key), width)]
        got = [(t.column("key").to_numpy(), ends) for t, ends in linking.whole_runs(iter([batches[0].slice(0, 0), *batches]), ["key"], rows=16)]
        assert np.concatenate([x for x, _ in got]).tolist() == key.tolist()
        assert all(a[0][-1] < b[0][0] for a, b in zip(got, got[1:], strict=False))
        for x, ends in got:
            assert ends.tolist() == np.searchsorted(x, x, "right").tolist()
    assert list(linking.whole_runs(iter([]), ["key"])) == []


def test_token_files_have_stripes_indexes_and_pruning(spark, tmp_path):
    from pyarrow import orc

    rows = spark.range(12000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.sha2(F.col("id").cast("string"), 512)).alias("text"))
    path = str(tmp_path / "t")
    token_files.write_token_files(rows, path, BYTE, part_bytes=400_000, stride=1000)
    files = sorted((tmp_path / "t").glob("*.orc"))
    assert len(files) >= 4  # by bytes, not by shuffle partitions
    low = []
    for f in files:
        o = orc.ORCFile(str(f))
        ids = o.read(columns=["doc_id"])["doc_id"].to_pylist()
        low.append((ids[0], ids[-1]))
        assert ids == sorted(ids) and o.row_index_stride == 1000 and o.nstripes >= 1
        stripes = [o.read_stripe(k, columns=["doc_id"]).column(0).to_pylist() for k in range(o.nstripes)]  # stripe by stripe
        assert [x for s in stripes for x in s] == ids
    low = sorted(low)
    assert all(a[1] < b[0] for a, b in zip(low, low[1:], strict=False))  # one id range a file
    back = token_files.read_token_files(spark, path)
    found = back.where("doc_id = 4321")
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4321)" in plan or "EqualTo(doc_id,4321)" in plan
    assert found.count() == 1 and found.first().ids[-1] == 0

    def bloom_streams(file):
        """Streams of Bloom filters (kinds 7 and 8) in the stripe footers, by the ORC library's own reader."""
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(str(file))
        reader = jvm.org.apache.orc.OrcFile.createReader(p, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        r = reader.rows()
        stripe = reader.getStripes().get(0)
        return [s.getKind().toString() for s in r.readStripeFooter(stripe).getStreamsList()]

    kinds = bloom_streams(files[0])
    assert any(k.startswith("BLOOM_FILTER") for k in kinds) and "ROW_INDEX" in kinds


def test_token_files_odd_rows(spark, tmp_path, empty):
    token_files.write_token_files(empty, str(tmp_path / "e"), BYTE)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0
    rows = spark.createDataFrame([(1, "b", ""), (1, "a", ""), (None, "c", ""), (2, None, ""), (1, "a", "")], "doc_id long, text string, ids string")
    token_files.write_token_files(rows, str(tmp_path / "o"), BYTE, parts=3)
    got = token_files.checksums(token_files.read_token_files(spark, str(tmp_path / "o"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 1, 2] and [r.start for r in got] == [0, 2, 4, 6, 8] and got[-1].n_tokens == 1


def test_odd_inputs_break_nothing():
    rng = np.random.default_rng(0)
    parts = ["<div", "<p>", "</p>", "</div>", " class='ad'", ">", "<article>", "</article>", "&amp;", "&bogus;", "<!--", "-->", "<![CDATA[", "]]>", "<script>", "\x00", "é", "text ", " id=comments", "<a href=x>", "</a>", "<", "=", "'", '"', "<td>", "hidden", "under the MIT License ", "2 0 gnu general public "]
    index, grammar = license_scan.TemplateIndex(license_scan.known_licenses()), toxicity.Grammar({"text": 2.0}, {"gen": 3.0})
    auto = decontaminate.automaton([("a", "text gnu general"), ("b", "İ é text")], 2)
    for _ in range(400):
        s = "".join(rng.choice(parts, rng.integers(0, 40)))
        html_extract.main_text(s, None)
        for name, _, _, start, end in index.scan(s):
            assert name and 0 <= start < end <= len(s)
        for start, end, weight in grammar.matches(s):
            assert 0 <= start < end <= len(s) and weight > 0
        words, ranges, _ = decontaminate.hits(s, auto)
        assert decontaminate.told(s, len(words), ranges, True)[0] <= len(words)
    for head in (b"", b"P5 ", b"P6 3 4 255\n", b"BM", b"\x89PNG\r\n\x1a\n", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"):
        for _ in range(60):
            image = media_match.decode(head + rng.integers(0, 256, rng.integers(0, 80)).astype(np.uint8).tobytes())
            assert image is None or image.ndim == 2
    for h, w in rng.integers(1, 60, (40, 2)):
        (places, bits), = media_match.keypoints([rng.integers(0, 255, (h, w)).astype(float)])
        assert len(places) == len(bits)


LEAN = """
import re
import numpy as np
from gramlake.llm.common import lean

def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", f.read()))) / 1024

pins = []

def rows(batches):
    large = []
    for _ in range(6000):  # 120 MB, with something small left between
        large.append(np.ones(20_000, np.uint8))
        pins.append(np.ones(2000, np.uint8))
    yield from batches

before = held()
assert list(lean(rows)(iter([1, 2]))) == [1, 2]
print(held() - before)
"""


def test_a_task_gives_back_what_it_held():
    got = subprocess.run([sys.executable, "-c", LEAN], capture_output=True, text=True, timeout=120, check=True, cwd=Path(__file__).parents[2])
    assert float(got.stdout) < 60


def test_pipeline_workers_stay_lean(spark, monkeypatch):
    import corpus_pipeline

    seen, kind = [], type(spark.range(0))
    inner = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: seen.append(f) or inner(self, f, *a, **b))
    corpus_pipeline.run(spark, SF)
    assert len(seen) > 8
    assert {f.__name__ for f in seen} == {"lean_rows"}
    PieceEncoder.get(WORD, "dropped", 2)
    list(seen[-2](iter([])))  # the route of packing
    assert not PieceEncoder._made
