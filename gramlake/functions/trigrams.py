"""Trigrams and the indexer's skip rules: as built-in expressions for STRING columns, as an Arrow function for any bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The reasons a text is not indexed, in order of precedence at one byte.
TOO_LONG, BINARY, INVALID_UTF8, LINE_TOO_LONG, TOO_MANY = "FileTooLong", "BinaryDataPresent", "HighInvalidUtf8Ratio", "LineTooLong", "TooManyTrigrams"
# The reasons that a source gives, for names that are no UTF-8 and for files that can't be read.
FILE_NAME, IO = "FileNameError", "IoError"
#: Bytes of texts that a worker looks at together, about.
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class Limits:
    """The defaults."""

    max_file_len: int = 1 << 30
    max_line_len: int = 2000
    max_trigrams: int = 30000
    max_invalid_utf8: float = 0.1


NO_LIMITS = Limits(1 << 62, 1 << 30, 1 << 30, 1.0)


def slices(b: pa.RecordBatch, column: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `size` bytes of a BINARY column, or of one row: what a task makes of a batch is held for a part
    of it only, however many rows Spark puts into one and however long they are."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < b.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield b.slice(start, stop - start)
        start = stop


def counted(texts: pa.Array, numbers: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) for each piece of `size` bytes of all texts together: keys, in order, are a text's number << 24 | trigram."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if ends[-1] == ends[0]:
        return
    b, ends = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0]
    for at in range(0, max(0, len(b) - 2), size):
        wide = b[at : at + size + 2].astype(np.int64)
        place = np.arange(at, at + len(wide) - 2)
        text = np.searchsorted(ends, place, "right")
        keys = (numbers[text] << 24) | (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        yield np.unique(keys[place + 2 < ends[text]], return_counts=True)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of some (keys in order, counts)."""
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in parts]))
    return keys, n


def trigram_counts(files: DataFrame) -> DataFrame:
    """(doc_id, trigram, n): how often each trigram, packed as b0 << 16 | b1 << 8 | b2, stands in the UTF-8 bytes of an id's STRING
    contents. Texts, not trigrams, are shuffled, so that rows of one id meet; they are counted one piece after the other, so time
    follows the bytes and memory a piece and one id's distinct trigrams."""
    texts = files.select("doc_id", F.encode("content", "UTF-8").alias("content")).repartition("doc_id").sortWithinPartitions("doc_id")
    kind = texts.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, parts = None, []  # of the id whose texts may go on

        def rows(ids: pa.Array, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), PIECE_BYTES):
                own = keys[k : k + PIECE_BYTES]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own >> 24)), pa.array(own & 0xFFFFFF), pa.array(n[k : k + PIECE_BYTES])], ["doc_id", "trigram", "n"])

        for b in batches:
            for s in slices(b, "content"):
                ids = s.column("doc_id").to_pylist()
                first = np.array([k > 0 and v != ids[k - 1] for k, v in enumerate(ids)]).cumsum()
                own = s.column("doc_id").take(pa.array(np.searchsorted(first, np.arange(first[-1] + 1))))
                if parts and ids[0] != ident[0].as_py():
                    yield from rows(ident, *added(parts))
                    parts = []
                ident, at = own.slice(0, 1), 0
                for keys, n in counted(s.column("content"), first):
                    bounds = np.searchsorted(keys, [(at + 1) << 24, keys[-1] >> 24 << 24 if len(keys) else 0])
                    cut, top = bounds[0], max(bounds)
                    parts.append((keys[:cut] & 0xFFFFFF, n[:cut]))
                    if cut < len(keys):
                        yield from rows(ident, *added(parts))
                        yield from rows(own, keys[cut:top], n[cut:top])
                        at = int(keys[-1] >> 24)
                        ident, parts = own.slice(at, 1), [(keys[top:] & 0xFFFFFF, n[top:])]
                    elif sum(len(k) for k, _ in parts[1:]) > max(PIECE_BYTES, len(parts[0][0])):
                        parts = [added(parts)]
                if parts and at < first[-1]:  # texts without trigrams follow
                    yield from rows(ident, *added(parts))
                    parts = []
        if parts:
            yield from rows(ident, *added(parts))

    return texts.mapInArrow(run, f"doc_id {kind.simpleString()}, trigram long, n long")


def packed(gram: bytes) -> int:
    return int.from_bytes(gram, "big")


def gram_hex(trigram: Column) -> Column:
    return F.lpad(F.hex(trigram), 6, "0")


def line_too_long(text: Column, limit: int) -> Column:
    """The line rule of a STRING: lengths in bytes, without the text's first two bytes; a line that a line feed ends may have
    `limit` counted bytes, the last line one more."""
    lines = F.split(text, "\n", -1)
    last = F.size(lines) - 1
    # Bytes of the text's first two that the k-th line holds: the first line's own, then what an empty or one-byte first line leaves.
    first = F.octet_length(F.element_at(lines, 1))
    second = F.octet_length(F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit("")))

    def uncounted(k: Column) -> Column:
        return F.when(k == 0, F.least(first, F.lit(2))).when((k == 1) & (first == 0), F.least(second, F.lit(1))).otherwise(F.lit(0))

    def over(k: Column) -> Column:
        n = F.octet_length(F.element_at(lines, k + 1)) - uncounted(k)
        return (n >= limit + 2) | ((n == limit + 1) & (k < last))

    return F.exists(F.sequence(F.lit(0), last), over)


def has_binary(text: Column) -> Column:
    """A NUL from the second byte on, in a text of three bytes or more."""
    return (F.octet_length(text) >= 3) & (F.locate("\0", text, 2) > 0)


def examined(data: bytes | None, limits: Limits) -> tuple[np.ndarray | None, str | None]:
    """(distinct trigrams in order of value, reason it is skipped); one of them is None. Null counts as empty."""
    data = data or b""
    if len(data) > limits.max_file_len:
        return None, TOO_LONG
    if len(data) < 3:
        return np.zeros(0, np.int32), None
    b = np.frombuffer(data, np.uint8)
    c1, c2 = b[1:-1], b[2:]
    nul = (c1 == 0) | (c2 == 0)
    fine = np.select([c1 < 0x80, c1 < 0xC0, c1 < 0xF8], [(c2 < 0x80) | ((c2 >= 0xC0) & (c2 < 0xF8)), c2 < 0xF8, (c2 >= 0x80) & (c2 < 0xC0)], False)
    faults = []
    if nul.any():
        faults.append((int(nul.argmax()), 0, BINARY))
    bad = np.flatnonzero(~fine & ~nul)
    allowed = int(len(data) * limits.max_invalid_utf8)
    if len(bad) > allowed:
        faults.append((int(bad[allowed]), 1, INVALID_UTF8))
    taken = np.flatnonzero(fine & ~nul)
    feeds = np.flatnonzero(c2[taken] == 10)
    before = np.searchsorted(feeds, np.arange(len(taken)))  # line feeds taken before each byte
    length = np.arange(len(taken)) - np.where(before > 0, feeds[np.maximum(before - 1, 0)] + 1 if len(feeds) else 0, 0)
    if (long := length > limits.max_line_len).any():
        faults.append((int(taken[long.argmax()]), 2, LINE_TOO_LONG))
    if faults:
        return None, min(faults)[2]
    wide = b.astype(np.int32)
    grams = np.unique(((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:])[taken])
    return (None, TOO_MANY) if len(grams) > limits.max_trigrams else (grams, None)


def grams_array(found: list[np.ndarray | None]) -> pa.Array:
    """A list array of each one's trigrams, built from the arrays as they are."""
    ends = np.concatenate([[0], np.cumsum([0 if g is None else len(g) for g in found])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int32), *(g for g in found if g is not None)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([g is None for g in found], pa.bool_()))


def examine(content: Column, limits: Limits) -> Column:
    """struct<grams: array<int>, reason: string> of a BINARY column."""

    @F.arrow_udf("grams array<int>, reason string")
    def run(a: pa.Array) -> pa.Array:
        got = [examined(x, limits) for x in a.to_pylist()]
        return pa.StructArray.from_arrays([grams_array([g for g, _ in got]), pa.array([r for _, r in got], pa.string())], ["grams", "reason"])

    return run(content)


def numbered(rows: DataFrame, limits: Limits) -> DataFrame:
    """rows (name, content, error, ...), whose tasks hold ranges of names in order, without `error` but with grams, reason, part and
    local: the trigrams or the reason to skip, the task's number, and among its indexed rows the row's. Of equal names, which
    stand next to one another, the first row is kept."""
    kept = [c for c in rows.columns if c != "error"]
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, last = TaskContext.get().partitionId(), 0, ()
        for b in (s for batch in batches for s in slices(batch, "content")):
            new = []
            for name in b.column("name").to_pylist():
                new.append((name,) != last)
                last = (name,)
            b = b.filter(pa.array(new, pa.bool_()))
            faults, contents = b.column("error").to_pylist(), b.column("content").to_pylist()
            got = [(None, fault) if fault is not None else examined(content, limits) for fault, content in zip(faults, contents, strict=True)]
            local = []
            for g, _ in got:
                local.append(None if g is None else at)
                at += g is not None
            more = [grams_array([g for g, _ in got]), pa.array([r for _, r in got], pa.string()), pa.array([part] * len(got), pa.int32()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *more], [*kept, "grams", "reason", "part", "local"])

    return rows.mapInArrow(run, f"{rest}, grams array<int>, reason string, part int, local long")
