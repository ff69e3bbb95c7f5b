"""Packing (operator 3): lexical retrieval packing over a sharded BM25 inverted index.

Document frequencies and the mean length are counted over all documents' pieces. Documents are routed to shards by a
weighted min-hash of their terms: ranged by its first three terms, copies side by side, and cut in this order into shards of
bounded size, so alike texts meet at any scale, the likelier the more they are alike; a group of copies larger than a task's
range is cut by id. A shard's index holds all its pieces.
A seed (the rest of the document cut last, else the longest one unused) asks the index for its neighbours with all its terms;
those unused fill its window greedily in order of score, whole where they fit, and the best one left is cut to close the
window. Full windows of longer documents are sequences of their own. What is left when a shard is used up is cut into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PieceEncoder
from .common import bounded_batches, lean, table, written

SHARD_TOKENS, SHARDS_A_TASK, VOCABULARY = 2_400_000, 4, 1 << 16
K1, B = 1.2, 0.75
#: A fixed exponential waiting time for each term.
CLOCK = -np.log(np.random.default_rng(2).random(VOCABULARY))
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def terms_of(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A piece's different terms in order and how often each stands there."""
    s = np.sort(piece, kind="stable")
    first = np.flatnonzero(np.diff(s, prepend=s[:1] ^ 1))
    return s[first], np.diff(first, append=len(s))


class Statistics:
    """Of all pieces: how many hold each term, and their mean length."""

    def __init__(self, df: np.ndarray, n: int, tokens: int):
        self.df, self.idf, self.mean = df, np.log1p((n - df + 0.5) / (df + 0.5)), max(tokens / max(n, 1), 1)

    @classmethod
    def of(cls, pieces: list[np.ndarray]) -> Statistics:
        df = np.zeros(VOCABULARY, np.int64)
        for p in pieces:
            df[terms_of(p)[0]] += 1
        return cls(df, len(pieces), sum(map(len, pieces)))

    def weights(self, terms: np.ndarray, tf: np.ndarray, lens: np.ndarray | int) -> np.ndarray:
        return (self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens / self.mean))).astype(np.float32)

    def route(self, piece: np.ndarray) -> tuple[int, int, int]:
        """Three of the terms that another piece holds too, a weighted min-hash: two pieces agree in the first about as likely as
        their terms, weighted by frequency and rareness, are alike. -1 for want of one."""
        terms, tf = terms_of(piece)
        shared = self.df[terms] > 1
        terms, tf = terms[shared], tf[shared]
        best = terms[np.argsort(CLOCK[terms] / np.maximum(self.idf[terms] * tf, 1e-9), kind="stable")[:3]].tolist()
        return (*best, -1, -1, -1)[:3]


class ShardIndex:
    """BM25 inverted index of one shard: for each term a slice of (piece, weight)."""

    def __init__(self, pieces: list[np.ndarray], statistics: Statistics):
        self.terms = [terms_of(p) for p in pieces]
        each = np.array([len(t) for t, _ in self.terms], np.int64)
        term = np.concatenate([np.zeros(0, np.uint16), *(t for t, _ in self.terms)])
        tf = np.concatenate([np.zeros(0, np.int64), *(n for _, n in self.terms)])
        weight = statistics.weights(term, tf, np.repeat([len(p) for p in pieces], each))
        order = np.argsort(term, kind="stable")  # by term, then by piece
        self.n, self.term, self.doc, self.weight = len(pieces), term[order], np.repeat(np.arange(len(pieces)), each)[order], weight[order]
        self._cut()

    def _cut(self) -> None:
        self.first = np.searchsorted(self.term, np.arange(VOCABULARY + 1))
        self.held = len(self.term)

    def drop(self, unused: np.ndarray) -> None:
        """Leaves out the postings of used pieces once they are half of all."""
        alive = unused[self.doc]
        if 2 * alive.sum() < self.held:
            self.term, self.doc, self.weight = self.term[alive], self.doc[alive], self.weight[alive]
            self._cut()

    def neighbours(self, piece: int, unused: np.ndarray) -> np.ndarray:
        """Unused pieces that share a term with the seed, best first; ties by position."""
        query = self.terms[piece][0].astype(np.int64)
        a, b = self.first[query], self.first[query + 1]
        some = b > a
        cuts = [slice(x, y) for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True)]
        if not cuts:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.doc[s] for s in cuts]), np.concatenate([self.weight[s] for s in cuts]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def powers(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack_shard(lengths: list[int], tokens: list[np.ndarray], window: int, statistics: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (row, start, length); each token of each row lies in exactly one."""
    out, start = [], []
    for r, n in enumerate(lengths):
        full = n - n % window
        out += [[(r, s, window)] for s in range(0, full, window)]
        start.append(full)
    pool = [r for r, n in enumerate(lengths) if n > start[r]]
    if not pool:
        return out
    pieces = [tokens[r][start[r] :] for r in pool]
    index = ShardIndex(pieces, statistics or Statistics.of(pieces))
    at = {k: start[r] for k, r in enumerate(pool)}
    left = np.array([lengths[r] - start[r] for r in pool], np.int64)
    unused = np.ones(len(pool), bool)
    queue, rest = np.argsort(-left, kind="stable").tolist(), None
    place, total = 0, int(left.sum())
    sequence: list[tuple[int, int, int]] = []

    def take(k: int, n: int) -> None:
        sequence.append((pool[k], at[k], n))
        at[k] += n
        left[k] -= n
        unused[k] = left[k] > 0

    while total:
        size = room = min(window, total)
        if rest is None:
            while not unused[queue[place]]:
                place += 1
            seed = queue[place]
        else:
            seed = rest
        rest, sequence = None, []
        n = min(int(left[seed]), room)
        take(seed, n)
        room -= n
        if room:
            order = index.neighbours(seed, unused)
            for k in order.tolist():
                if left[k] <= room:
                    n = int(left[k])
                    take(k, n)
                    room -= n
                    if not room:
                        break
            while room:  # cut the best one left; without any, the longest one
                k = next((k for k in order.tolist() if unused[k]), None)
                if k is None:
                    k = next(k for k in queue[place:] if unused[k])
                n = min(int(left[k]), room)
                take(k, n)
                room -= n
                if unused[k]:
                    rest = k
        elif unused[seed]:
            rest = seed
        total -= size
        if len(out) % 64 == 0:
            index.drop(unused)
        if size == window:
            out.append(sequence)
            continue
        for part in powers(size):
            piece: list[tuple[int, int, int]] = []
            while part:
                r, s, n = sequence[0]
                m = min(n, part)
                piece.append((r, s, m))
                part -= m
                sequence[0] = (r, s + m, n - m)
                if n == m:
                    sequence.pop(0)
            out.append(piece)
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", forget: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, within sequences of `window`.

    A seed's query holds all its terms. Null text is an empty document (its end id alone). Repeated rows are packed each; an
    empty table gives no rows; other columns are left out, whatever their names. Sequence ids are unique: the task in the upper bits.
    forget: workers that route drop their encoder (60 MB after 84 MB of text): all ids are written by then.
    """

    def piece(tokens: np.ndarray) -> np.ndarray:
        return tokens[len(tokens) - len(tokens) % window :]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The documents' ids, then how many of this task's pieces hold each term; -1 counts the pieces, -2 their tokens, -3 all tokens.
        enc = PieceEncoder.get(tokenizer, "dropped", 2, 1_500_000)
        df, n, tokens, total = np.zeros(VOCABULARY, np.int64), 0, 0, 0
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                c = b.slice(k, 1000)
                flat, lens = enc.ended(c.column(1), end_id)
                ends = np.cumsum(lens)
                for e, m in zip(ends.tolist(), lens.tolist(), strict=True):
                    if len(p := piece(flat[e - m : e])):
                        df[terms_of(p)[0]] += 1
                        n, tokens = n + 1, tokens + len(p)
                total += int(lens.sum())
                offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                none = pa.nulls(len(lens), pa.int64())
                yield pa.RecordBatch.from_arrays([c.column(0), ids, none, none], ["doc_id", "ids", "term", "n"])
        held = np.flatnonzero(df)
        term, count = np.concatenate([held, [-1, -2, -3]]), np.concatenate([df[held], [n, tokens, total]])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(term), pa.int64()), pa.nulls(len(term), pa.binary()), pa.array(term), pa.array(count)], ["doc_id", "ids", "term", "n"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if forget:
            PieceEncoder.forget()
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                c = b.slice(k, 1000)
                routes = [statistics.route(piece(np.frombuffer(ids, "<u2"))) for ids in c.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*c.columns, *(pa.array([r[i] for r in routes], pa.int32()) for i in (0, 1, 2))], ["doc_id", "ids", "t1", "t2", "t3"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal number
            rows: list[tuple] = []
            for sequence in pack_shard([len(t) for _, t in held], [t for _, t in held], window, statistics):
                offset = 0
                for r, s, n in sequence:
                    rows.append((held[r][0], s, n, zlib.crc32(held[r][1][s : s + n].astype("<u4").tobytes()), len(held[r][1]), base | number, offset))
                    offset += n
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

        for b in batches:
            for i, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((i, np.frombuffer(ids, "<u2")))
                size += len(held[-1][1])
                if size >= shard_tokens:
                    yield packed()
                    held, size = [], 0
        if held:
            yield packed()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    encoded = written(rows.mapInArrow(lean(encode), "doc_id long, ids binary, term long, n long"), "ids")
    # At most one row a term of the vocabulary reaches the driver.
    counts = {r["term"]: r["n"] for r in encoded.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(VOCABULARY, np.int64)
    for term, n in counts.items():
        if term >= 0:
            df[term] = n
    statistics = Statistics(df, counts.get(-1, 0), counts.get(-2, 0))
    parts = -(-counts.get(-3, 0) // (SHARDS_A_TASK * shard_tokens)) or 1
    routed = encoded.where("term is null").select("doc_id", "ids").mapInArrow(lean(route), "doc_id long, ids binary, t1 int, t2 int, t3 int")
    order = ["t1", "t2", "t3", "h", "doc_id"]
    ranged = routed.withColumn("h", F.xxhash64("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "ids").mapInArrow(lean(fill), PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
