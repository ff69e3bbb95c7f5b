"""Exact tokenizer calls for whole corpora, a batch of texts at a time.

The bytes of a batch are cut into the pre-tokenizer's pieces by array operations: runs of letters, digits, other printable
characters and white space. A piece of at most 16 bytes is its own key in a hash table of arrays, which holds its token ids;
pieces that the table lacks are merged together, one merge of each a round, by the vocabulary's merge ranks. Words that hold
anything else (other scripts, combining or control characters, contractions, beginnings of special strings) and longer
pieces go through the library as they are, once for each different one. Words end where white space begins, which is where
the pre-tokenizer always cuts, so a long text is taken in several parts. The table starts anew at `limit` pieces or
ODD_BYTES of the others, so memory is bounded.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

BATCH_BYTES = 1 << 20
KEY = 16
#: Bytes of the parts that went through the library and are remembered, about.
ODD_BYTES = 32 << 20
SPACE, LETTER, DIGIT, OTHER, HARD = range(5)
#: The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = [chr(b) if b in _PRINTABLE else chr(256 + sorted({*range(256)}.difference(_PRINTABLE)).index(b)) for b in range(256)]
CUT = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def kinds(kept: bool) -> np.ndarray:
    """The class of each byte. Bytes above 0x7F are hard until their character is known to be a letter."""
    out = np.full(256, HARD, np.uint8)
    out[[*range(9, 14), 32]] = SPACE
    for b in range(33, 127):
        out[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER
    out[[ord("'"), ord("<")]] = HARD
    return out


def mixed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    h = lo * MIX[0] ^ (hi + MIX[2]) * MIX[1]
    h ^= h >> np.uint64(32)
    h *= MIX[2]
    return h


class Merges:
    """The merge rules as an open hash table: pair of token ids -> (rank, id)."""

    SLOTS = 1 << 18

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.table = np.full(self.SLOTS, -1, np.int32)
        slot, left = self.slots(self.key), np.arange(len(pairs))
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free][::-1]] = left[free][::-1]  # of several for one slot the first stays
            stay = self.table[slot] != left
            slot, left = (slot[stay] + 1) & (self.SLOTS - 1), left[stay]

    def slots(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * MIX[0]) >> np.uint64(46)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's rule, -1 without one."""
        key = a.astype(np.int64) << 20 | b
        slot = self.slots(key)
        out = self.table[slot]
        todo = np.flatnonzero((out >= 0) & (self.key[out] != key))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (self.SLOTS - 1)
            out[todo] = got = self.table[slot[todo]]
            todo = todo[(got >= 0) & (self.key[got] != key[todo])]
        return out

    def apply(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many each) of pieces given as columns of `symbols` (KEY x pieces). Each round does in every piece
        the merge of least rank, the leftmost of equals."""
        n, never = symbols.shape[1], np.int32(2**31 - 1)
        place = np.arange(KEY, dtype=np.int32)[:, None]
        after = np.broadcast_to(np.arange(1, KEY + 1, dtype=np.int8)[:, None], (KEY, n)).copy()
        before = np.broadcast_to(np.arange(-1, KEY - 1, dtype=np.int8)[:, None], (KEY, n)).copy()
        alive = place < lens[None, :]
        order = np.full((KEY, n), never, np.int32)  # rank and place in one number
        j, i = np.nonzero(place[: KEY - 1] + 1 < lens[None, :])
        rank = self.ranks(symbols[j, i], symbols[j + 1, i])
        known = rank >= 0
        order[j[known], i[known]] = rank[known] * KEY + j[known]
        i = np.arange(n)
        while True:
            best = order.min(axis=0) if len(i) == n else order[:, i].min(axis=0)
            some = best < never
            i, best = i[some], best[some]
            if not len(i):
                break
            rule, j = best // KEY, best % KEY
            k = after[j, i].astype(np.int64)
            symbols[j, i] = self.made[rule]
            alive[k, i] = False
            order[k, i] = order[j, i] = never
            then = after[k, i].astype(np.int64)
            after[j, i] = then
            inner = np.flatnonzero(then < lens[i])
            before[then[inner], i[inner]] = j[inner]
            for x, y, z in ((j[inner], then[inner], i[inner]), self._earlier(before, j, i)):
                rank = self.ranks(symbols[x, z], symbols[y, z])
                order[x, z] = np.where(rank >= 0, rank * KEY + x, never)
        i, j = np.nonzero(alive.T)
        return symbols[j, i], alive.sum(axis=0)

    @staticmethod
    def _earlier(before: np.ndarray, j: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left = before[j, i].astype(np.int64)
        some = left >= 0
        return left[some], j[some], i[some]


class PieceEncoder:
    """ids of whole texts through one tokenizers file.

    spaces: "kept" for byte-level vocabularies (a piece's leading space is part of it), "dropped" for lower-case vocabularies
    with word ends whose pre-tokenizer removes white space. width: bytes an id takes in the results (2 or 4).
    """

    _made: dict[tuple, PieceEncoder] = {}
    def __init__(self, path: str, spaces: str, width: int, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.no_truncation()
        self.tk.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.kind, self.limit, self.kept = np.dtype("<u2" if width == 2 else "<u4"), limit, spaces == "kept"
        assert width == 4 or self.tk.get_vocab_size() <= 1 << 16
        vocab = model["vocab"]
        self.merges = Merges(vocab, model["merges"])
        self.inner = np.array([vocab[c] for c in ALPHABET], np.int32)
        self.last = self.inner if self.kept else np.array([vocab[c + model["end_of_word_suffix"]] for c in ALPHABET], np.int32)
        self.kinds = kinds(self.kept)
        self.fold = np.arange(256, dtype=np.uint8)
        if not self.kept:
            self.fold[65:91] += 32
        self._clear()

    def _clear(self) -> None:
        self.slot_bits = max(16, (2 * self.limit).bit_length())
        self.table = np.full(1 << self.slot_bits, -1, np.int32)
        self.size, self.used = 0, 0
        self.lo, self.hi = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.at, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, self.kind)
        self.odd: dict[bytes, int] = {}
        self.odd_bytes = 0

    @classmethod
    def get(cls, *key) -> PieceEncoder:
        """One for each Python worker."""
        if key not in cls._made:
            cls._made[key] = cls(*key)
        return cls._made[key]

    @classmethod
    def forget(cls) -> None:
        """Drops this worker's encoders."""
        cls._made.clear()

    # The table

    def _add(self, ids: np.ndarray, n: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Entries for pieces of these ids; returns their numbers."""
        first, m = self.size, len(n)
        for name in ("lo", "hi", "at", "n"):
            a = getattr(self, name)
            if first + m > len(a):
                setattr(self, name, np.concatenate([a, np.zeros(max(len(a), m), a.dtype)]))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        own = slice(first, first + m)
        self.n[own], self.at[own] = n, self.used + np.cumsum(n) - n
        if lo is not None:
            self.lo[own], self.hi[own] = lo, hi
        self.size, self.used = first + m, self.used + len(ids)
        return np.arange(first, first + m)

    def _find(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry or -1, the slot where the search ended) of each key."""
        slot = (mixed(lo, hi) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        out = self.table[slot]
        todo = np.flatnonzero((out >= 0) & ((self.lo[out] != lo) | (self.hi[out] != hi)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
            out[todo] = got = self.table[slot[todo]]
            todo = todo[(got >= 0) & ((self.lo[got] != lo[todo]) | (self.hi[got] != hi[todo]))]
        return out, slot

    def _learn(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Entries for new keys, equal ones once."""
        order = np.lexsort((hi, lo))
        lo, hi = lo[order], hi[order]
        first = np.ones(len(lo), bool)
        first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        lo, hi = lo[first], hi[first]
        for k in range(0, len(lo), 1 << 15):
            a, b = lo[k : k + (1 << 15)], hi[k : k + (1 << 15)]
            raw = np.ascontiguousarray(np.stack([a, b], axis=1)).view(np.uint8)
            lens = (raw != 0).sum(axis=1)
            symbols = self.inner[raw.T].copy()
            if not self.kept:
                every = np.arange(len(lens))
                symbols[lens - 1, every] = self.last[raw[every, lens - 1]]
            self._insert(self._add(*self.merges.apply(symbols, lens), a, b))

    def _insert(self, own: np.ndarray) -> None:
        """Gives entries, whose keys the table lacks, their slots; a table that is half full is made anew, twice as large."""
        if 2 * self.size > len(self.table):
            self.slot_bits = (4 * self.size).bit_length()
            self.table = np.full(1 << self.slot_bits, -1, np.int32)
            own = np.flatnonzero(self.lo[: self.size] | self.hi[: self.size])
        slot = (mixed(self.lo[own], self.hi[own]) >> np.uint64(64 - self.slot_bits)).astype(np.int64)
        while len(own):
            free = self.table[slot] < 0
            self.table[slot[free][::-1]] = own[free][::-1]
            stay = self.table[slot] != own
            slot, own = (slot[stay] + 1) & (len(self.table) - 1), own[stay]

    def _odd_entries(self, parts: list[bytes]) -> list[int]:
        """The entries of parts that the library encodes."""
        known = self.odd
        if new := list({p for p in parts if p not in known}):
            got = [x.ids for x in self.tk.encode_batch_fast([p.decode("utf-8", "replace") for p in new], add_special_tokens=False)]
            ids = np.array([i for x in got for i in x], self.kind)
            self.odd_bytes += sum(map(len, new))
            known.update(zip(new, self._add(ids, np.array([len(x) for x in got], np.int32)).tolist(), strict=True))
        return [known[p] for p in parts]

    # Texts

    def _pieces(self, a: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, start) of each piece of a batch: bytes `a`, padded by KEY zeros, of texts that start at `edges`."""
        n = len(a) - KEY
        kind = self.kinds[a]
        high = np.flatnonzero(a[:n] >= 0xC3)
        folded = self.fold[a] if not self.kept else a
        if len(high):
            # Two-byte letters: U+00C0 to U+024F and, as spaces are kept, U+0400 to U+047F; without the signs of times and division.
            lead, cont = a[high], a[high + 1]
            fine = (cont >= 0x80) & (cont < 0xC0) & ~((lead == 0xC3) & ((cont == 0x97) | (cont == 0xB7)))
            fine &= (lead <= 0xC9) | (lead == 0xD0) | (lead == 0xD1) if self.kept else lead == 0xC3
            high, cont = high[fine], cont[fine]
            kind[high] = kind[high + 1] = LETTER
            if not self.kept:
                upper = high[cont < 0x9F] + 1
                folded[upper] += 0x20
        edge = np.zeros(n + 1, bool)
        edge[edges] = edge[n] = True
        k = kind[:n]
        start = np.ones(n, bool)
        start[1:] = (k[1:] != k[:-1]) | edge[1:n]
        runs = np.flatnonzero(start)
        space = k[runs] == SPACE
        ends = np.append(runs[1:], n)
        # Words: from white space after a known other character to before the next.
        before = k[np.maximum(runs - 1, 0)]
        word = edge[runs] | space & (before != HARD)
        hard = k[runs] == HARD
        if not self.kept:
            start |= k == DIGIT
            start &= k != SPACE
        else:
            inner = space & ~edge[ends]
            last = ends[inner] - 1
            start[last] = True
            start[ends[inner][a[last] == 32]] = False
        long_words = hard.any()
        if long_words:
            number = np.cumsum(word) - 1
            odd = np.bincount(number[hard], minlength=number[-1] + 1) > 0
            firsts = np.append(runs[word], n)
            begin, stop = firsts[:-1][odd], firsts[1:][odd]
            change = np.zeros(n + 1, np.int8)
            change[begin] += 1
            change[stop] -= 1
            start &= np.cumsum(change[:n], dtype=np.int8) == 0
            start[begin] = True
        starts = np.flatnonzero(start)
        if not len(starts):
            return np.zeros(0, np.int64), starts
        # A piece ends at the next one or, where spaces are dropped, at the white space before it.
        lens = np.diff(np.append(starts, n))
        if not self.kept:
            close = np.flatnonzero(np.diff((k != SPACE).astype(np.int8), append=np.int8(0)) < 0) + 1
            bound = close[np.minimum(np.searchsorted(close, starts, side="right"), len(close) - 1)] if len(close) else np.full(len(starts), n)
            lens = np.minimum(lens, np.maximum(bound - starts, 1))
        strange = lens > KEY
        if long_words:
            at = np.searchsorted(starts, begin)
            lens[at] = stop - begin
            strange[at] = True
        words = np.ndarray((n + KEY - 7,), "<u8", np.ascontiguousarray(folded).data, strides=(1,))
        lo = words[starts] & MASKS[np.minimum(lens, 8)]
        hi = words[starts + 8] & MASKS[np.clip(lens - 8, 0, 8)]
        plain = np.flatnonzero(~strange) if strange.any() else slice(None)
        entry = np.zeros(len(starts), np.int64)
        entry[plain], _ = self._find(lo[plain], hi[plain])
        new = np.flatnonzero(entry < 0)
        if len(new):
            self._learn(lo[new], hi[new])
            entry[new], _ = self._find(lo[new], hi[new])
        if strange.any():
            raw = a.data
            which = np.flatnonzero(strange)
            entry[which] = self._odd_entries([bytes(raw[s : s + m]) for s, m in zip(starts[which].tolist(), lens[which].tolist(), strict=True)])
        return entry, starts

    def _spans(self, data: np.ndarray, offsets: np.ndarray):
        """(text of the first byte, cuts): byte positions of batches of texts and of parts of long ones."""
        row, rows = 0, len(offsets) - 1
        while row < rows:
            stop = int(np.searchsorted(offsets, offsets[row] + BATCH_BYTES, side="right")) - 1
            if stop > row:
                yield row, offsets[row : stop + 1]
                row = stop
                continue
            at, end = int(offsets[row]), int(offsets[row + 1])
            while at < end:
                m = CUT.search(data, at + BATCH_BYTES, end) if end - at > BATCH_BYTES else None
                cut = m.start() if m else end
                yield row, np.array([at, cut])
                at = cut
            row += 1

    def encode(self, texts: pa.Array, counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in a row, how many of them are each text's); null is empty."""
        texts = texts.cast(pa.large_binary()) if texts.type != pa.large_binary() else texts
        if texts.null_count:
            texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        counts, out = np.zeros(len(texts), np.int64), []
        if len(texts) and offsets[-1] > offsets[0]:
            data = np.frombuffer(texts.buffers()[2], np.uint8)
            for row, cuts in self._spans(data, offsets):
                if self.size > self.limit or self.used > 8 * self.limit or self.odd_bytes > ODD_BYTES:
                    self._clear()
                a = np.zeros(int(cuts[-1] - cuts[0]) + KEY, np.uint8)
                a[:-KEY] = data[cuts[0] : cuts[-1]]
                if len(a) == KEY:
                    continue
                edges = cuts[:-1] - cuts[0]
                entry, starts = self._pieces(a, edges[edges < len(a) - KEY])
                n = self.n[entry].astype(np.int64)
                total = np.concatenate([[0], np.cumsum(n)])
                counts[row : row + len(edges)] += np.diff(total[np.searchsorted(starts, np.append(edges, len(a) - KEY))])
                if not counts_only:
                    out.append(self.pool[np.repeat(self.at[entry] - total[:-1], n) + np.arange(total[-1])])
        return np.concatenate(out) if out else np.zeros(0, self.kind), counts

    def ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """encode() with one more id after each text."""
        flat, counts = self.encode(texts)
        ends = np.cumsum(counts + 1)
        out = np.empty(len(flat) + len(counts), self.kind)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[keep] = flat
        out[~keep] = end_id
        return out, counts + 1

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: none) as little-endian integers."""
        flat, counts = self.encode(pa.array([None if t is None else t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()))
        ends = np.cumsum(counts)
        return [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
