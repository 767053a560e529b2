"""Packing of tokenised documents into fixed-length training sequences.

A document's ids are cut into pieces of at most ``capacity``.  Documents go to random
groups, and each group is packed on its own by first-fit decreasing: pieces in
falling order of length take the first open sequence with room, found by descending
a tournament tree that holds the largest free room below each node.  A piece of full
length fills a sequence alone wherever it is, so the full pieces of a document are dealt
one by one, and only its last piece goes where the document goes.  Groups are of
bounded size, whatever the number and the length of documents, and never exchange rows,
so a lost executor costs one group.

Defined results
* null text: the empty text, one piece that holds the end id alone;
* null or repeated ids, repeated rows: each row is a document of its own;
* empty table: no rows;
* very long text: cut at word boundaries into spans before it is tokenised, so only
  its ids are held as a whole; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.scratch import Scratch
from traceloom.llm.textcore import chunks, mix, powers, running_hash, texts_of

CAPACITY = 1024
END_ID = 0
#: Pieces in a group, on average.
GROUP_PIECES = 4096
#: Bits of the places in a worker's table of tokenised units; a table two thirds full starts anew.
TABLE_BITS = 21
#: Bytes tokenised at once.
SPAN = 1 << 20

_U = np.uint64
#: Whitespace and invisible characters on whose kind regular-expression libraries differ.
_ODD = re.compile("[\t\r\f\v\x1c-\x1f\x85\xa0\u1680\u180e\u200b-\u200f\u2000-\u200a\u2028-\u202f\u205f-\u206f\u3000\ufeff]").search
#: Bytes with which such a character may begin.
_MAY_BE_ODD = np.zeros(256, dtype=bool)
_MAY_BE_ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_GAP, _LETTER, _MARK, _SECOND = (np.zeros(256, dtype=bool) for _ in range(4))
_GAP[[0x20, 0x0A]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Second bytes of the accented letters whose first byte is C3.
_SECOND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


class UnitTable:
    """Ids of units by two 64-bit marks of each: open addressing in numpy arrays.

    The second mark holds a unit's first and last eight bytes, so it tells short units apart by itself.
    """

    def __init__(self, bits: int = TABLE_BITS):
        self.mask = _U((1 << bits) - 1)
        self.clear()

    def clear(self) -> None:
        n = int(self.mask) + 1
        self.keys, self.checks = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        self.first, self.count = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)
        self.ids, self.used, self.held = np.zeros(1 << 16, dtype="<u4"), 0, 0

    def full(self, more: int) -> bool:
        return 3 * (self.held + more) > 2 * len(self.keys)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each unit, or -1."""
        out, at, live = np.full(len(key), -1, dtype=np.int64), (key & self.mask).astype(np.int64), np.arange(len(key))
        while len(live):
            here = at[live]
            there = self.keys[here]
            met = (there == key[live]) & (self.checks[here] == check[live])
            out[live[met]] = here[met]
            live = live[~met & (there != 0)]
            at[live] = (at[live] + 1) & int(self.mask)
        return out

    def add(self, key: np.ndarray, check: np.ndarray, flat: np.ndarray, count: np.ndarray) -> None:
        """Units that are not in the table, each once, with their ids one after the other and their numbers."""
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), dtype="<u4"))
        first = self.used + np.cumsum(count) - count
        self.ids[self.used : self.used + len(flat)] = flat
        self.used, self.held = self.used + len(flat), self.held + len(key)
        at, live = (key & self.mask).astype(np.int64), np.arange(len(key))
        while len(live):
            here = at[live]
            free = live[self.keys[here] == 0]
            self.keys[at[free]] = key[free]  # of several for one place the last stays
            mine = free[self.keys[at[free]] == key[free]]
            _, one = np.unique(at[mine], return_index=True)
            mine = mine[one]
            self.checks[at[mine]], self.first[at[mine]], self.count[at[mine]] = check[mine], first[mine], count[mine]
            live = np.setdiff1d(live, mine, assume_unique=True)
            at[live] = (at[live] + 1) & int(self.mask)


class WordMerges:
    """The merges of a byte-level tokeniser, applied to many words at once.

    In each step every word merges its first pair of lowest rank, as the tokeniser does.
    Only words of plain letters, after a space or not, are done: these are never split before.
    The first words are also given to the tokeniser; if any comes out otherwise, all go there.
    """

    LONGEST = 32
    _PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch

    def __init__(self, inner):
        model = json.loads(inner.to_str())["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in side], dtype=np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.width = max(vocab.values()) + 1  # also the id of an empty place
        # open addressing by a multiplicative hash, at most a fifth full
        self.bits = max(4, (5 * len(pairs)).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.rank, self.made = np.full(1 << self.bits, len(pairs), dtype=np.int32), np.zeros(1 << self.bits, dtype=np.int32)
        for key, at, rank, new in zip((keys := left * self.width + right).tolist(), self._slot(keys).tolist(), range(len(pairs)), made.tolist(), strict=True):
            while self.key[at] >= 0:
                at = (at + 1) % (1 << self.bits)
            self.key[at], self.rank[at], self.made[at] = key, rank, new
        self.never = np.int32(len(pairs))
        shown = [c for c in range(256) if 0x21 <= c < 0x7F or c > 0xA0 and c != 0xAD]  # bytes that stand for themselves; the others follow after 255
        other = [c for c in range(256) if c not in shown]
        chars = dict(zip(shown, shown, strict=True)) | {c: 256 + k for k, c in enumerate(other)}
        self.byte = np.array([vocab[chr(chars[c])] for c in range(256)], dtype=np.int64)
        sample = [b"a", b" b", b"Of", b" the", b"qzxjk", b" abababab", b" tokeniser", b"mississippi", b" WordMerges", " d\u00e9j\u00e0ing\u00dfen".encode()]
        flat, count = self._merged(sample)
        want = [inner.encode(w.decode(), add_special_tokens=False).ids for w in sample]
        self.agrees = not model.get("ignore_merges") and flat.tolist() == sum(want, []) and count.tolist() == [len(w) for w in want]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def _places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair, or of a free slot, which has the last rank, if it never merges."""
        key = left.astype(np.int64) * self.width + right
        at = self._slot(key)
        there = self.key[at]
        live = np.flatnonzero((there != key) & (there >= 0))
        while len(live):
            at[live] = (at[live] + 1) & ((1 << self.bits) - 1)
            there = self.key[at[live]]
            live = live[(there != key[live]) & (there >= 0)]
        return at

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and their numbers."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        wide = int(size.max())
        cols = np.arange(wide)
        there = cols < size[:, None]
        ids = np.full((len(words), wide + 1), self.width, dtype=np.int32)  # and a column that stays empty
        ids[:, :-1][there] = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        rank = np.full((len(words), wide + 1), self.never, dtype=np.int32)
        pair = cols < size[:, None] - 1
        rank[:, :-1][pair] = self.rank[self._places(ids[:, :-1][pair], ids[:, 1:][pair])]
        rows, done = np.arange(len(words)), np.full((len(words), wide), self.width, dtype=np.int32)
        while len(rows):
            at = rank.argmin(axis=1)
            on = rank[np.arange(len(rows)), at] < self.never
            if not on.all():
                done[rows[~on]] = ids[~on, :-1]
                rows, ids, rank, at = rows[on], ids[on], rank[on], at[on]
            here = np.arange(len(rows))
            made = self.made[self._places(ids[here, at], ids[here, at + 1])]
            # what stands behind the pair moves up
            behind = cols[1:] > at[:, None]
            for x in (ids, rank):
                np.copyto(x[:, 1:-1], x[:, 2:].copy(), where=behind)
            ids[here, at] = made
            rank[here, at] = self.rank[self._places(made, ids[here, at + 1])]
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.rank[self._places(ids[before, at[before] - 1], made[before])]
        held = done < self.width
        return done[held].astype(np.int64), held.sum(axis=1)

    def encode(self, units: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Which of the units are plain words, their ids one after the other, and their numbers."""
        plain = [k for k, u in enumerate(units) if len(u) <= self.LONGEST and self._PLAIN(u)] if self.agrees else []
        plain.sort(key=lambda k: len(units[k]))  # words of about one length are merged together
        found = [self._merged([units[k] for k in plain[a : a + 4096]]) for a in range(0, len(plain), 4096)]
        return plain, *(np.concatenate([np.zeros(0, dtype=np.int64), *(f[j] for f in found)]) for j in (0, 1))


class UnitTokenizer:
    """Byte-level BPE ids of whole texts, by a table of independent units.

    The pre-tokeniser never joins a character to a space or line feed that follows it, a
    single line feed to what follows it, or a letter to a mark after it.
    Texts are cut at such places, and the units between cuts, which repeat a lot, are
    looked up all at once.  A unit that is met first is encoded: words of plain letters by
    the tokeniser's own merges, all at once, and any other by the tokeniser.  A span that
    holds white space of another kind, or a special token, goes to the tokeniser uncut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.words = WordMerges(self.inner)
        self.special = [t.content.encode() for t in self.inner.get_added_tokens_decoder().values()]
        self.table = UnitTable()

    def _encoded(self, units: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The order in which units that are met first are encoded, their ids one after the other, and their numbers."""
        order, flat, count = self.words.encode(units)
        plain = set(order)
        other = [k for k in range(len(units)) if k not in plain]
        ids = [e.ids for a in range(0, len(other), 4096) for e in self.inner.encode_batch_fast([units[k].decode("utf-8", "replace") for k in other[a : a + 4096]], add_special_tokens=False)]
        more = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return order + other, np.concatenate([flat, np.fromiter((x for u in ids for x in u), dtype=np.int64, count=int(more.sum()))]), np.concatenate([count, more])

    def _units(self, raw: bytes, buf: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units of texts at these places of a buffer in which a byte follows each text."""
        gap = _GAP[buf]
        start = np.zeros(len(buf), dtype=bool)
        start[1:] = gap[1:] & ~gap[:-1]
        start[2:] |= ~gap[2:] & (buf[1:-1] == 0x0A) & ~gap[:-2]
        mark = np.flatnonzero(_MARK[buf[2:]]) + 2
        start[mark] |= _LETTER[buf[mark - 1]] | _SECOND[buf[mark - 1]] & (buf[mark - 2] == 0xC3)
        start[at + size] = False
        some = size > 0
        start[at[some]] = True
        begins = np.flatnonzero(start)
        ends = np.append(begins[1:], len(buf))
        last = np.searchsorted(begins, at[some] + size[some]) - 1
        ends[last] = at[some] + size[some]
        return begins, ends

    @staticmethod
    def _marks(raw: bytes, buf: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = running_hash(buf)
        _, down = powers(len(buf))
        n = (z - a).astype(np.uint64)
        key = mix((run[z] - run[a]) * down[a] + n)
        key[key == 0] = 1
        eight = np.ndarray((len(buf),), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
        short = n < 8
        head, tail = eight[a], eight[np.maximum(z - 8, 0)]
        head[short] &= (_U(1) << (n[short] * _U(8))) - _U(1)
        tail[short] = n[short]
        return key, head * _U(0x9E3779B97F4A7C15) ^ tail

    def _looked_up(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts without odd characters, as little-endian 32-bit numbers."""
        raw = b"\n".join([*texts, b""])
        if not raw:
            return []
        buf = np.frombuffer(raw, dtype=np.uint8)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        at = np.cumsum(size + 1) - size - 1
        a, z = self._units(raw, buf, at, size)
        key, check = self._marks(raw, buf, a, z)
        place = self.table.find(key, check)
        while len(missing := np.flatnonzero(place < 0)):
            _, one = np.unique(key[missing], return_index=True)
            new = missing[one]
            if self.table.full(len(new)):
                self.table.clear()
                if self.table.full(len(new)):
                    self.table = UnitTable((3 * len(new)).bit_length())
                place[:] = -1
                continue
            order, flat, many = self._encoded([raw[x:y] for x, y in zip(a[new].tolist(), z[new].tolist(), strict=True)])
            self.table.add(key[new][order], check[new][order], flat, many)
            place[missing] = self.table.find(key[missing], check[missing])
        count = self.table.count[place].astype(np.int64)
        ends = np.cumsum(count)
        flat = self.table.ids[np.repeat(self.table.first[place] - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        units = np.searchsorted(a, np.append(at, len(buf)))
        cuts = (4 * np.append(0, ends)[units]).tolist()
        return [flat[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        spans, owner = [], []
        for i, t in enumerate(texts):
            for span in self._cut(t) if len(t) > SPAN else (t,):
                spans.append(span)
                owner.append(i)
        out: list[list[bytes]] = [[] for _ in texts]
        for lo, hi in chunks(spans):
            part = spans[lo:hi]
            whole = {}
            for k, span in enumerate(part):
                if any(x in span for x in self.special) or _MAY_BE_ODD[np.frombuffer(span, dtype=np.uint8)].any() and _ODD(span.decode("utf-8", "replace")):
                    whole[k] = np.array(self.inner.encode(span.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()
                    part[k] = b""
            for k, ids in enumerate(self._looked_up(part)):
                out[owner[lo + k]].append(whole.get(k, ids))
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    @staticmethod
    def _cut(text: bytes) -> Iterator[bytes]:
        """Spans of a long text, cut after a letter and before a space or line feed."""
        at = 0
        while at < len(text):
            to = at + SPAN
            while to < len(text) and not (_GAP[text[to]] and _LETTER[text[to - 1]]):
                to += 1
            yield text[at:to]
            at = to


_tokenizers: dict[str, UnitTokenizer] = {}


def tokenizer(path: str) -> UnitTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = UnitTokenizer(path)
    return _tokenizers[path]


class TournamentTree:
    """Free room of the open bins; inner nodes hold the larger room of their two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts size into the first bin with room for it; returns the bin and the room it had."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        had = room[k]
        room[k] = had - size
        found, k = k - self.leaves, k // 2
        while k:
            larger = room[2 * k] if room[2 * k] > room[2 * k + 1] else room[2 * k + 1]
            if room[k] == larger:
                break
            room[k] = larger
            k //= 2
        return found, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; equal sizes keep their order."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    if len(rest):
        tree = TournamentTree(len(rest), capacity)
        for i, size in zip(rest.tolist(), sizes[rest].tolist(), strict=True):
            found, had = tree.place(size)
            bins[i], offsets[i] = full + found, capacity - had
    return bins, offsets


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, a random dealing key, and the ids as bytes if wanted."""
    kept = pa.binary() if with_ids else None
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, made = tokenizer(tokenizer_path), 0
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        for b in batches:
            ids, cols = b.column(0), [[] for _ in range(5 + with_ids)]
            texts = texts_of(b.column(1))
            for lo, hi in chunks(texts):
                for i, ids_of in enumerate(tok.encode_all(texts[lo:hi]), lo):
                    stream = ids_of + end
                    n = len(stream) // 4
                    for s in range(0, n, capacity):
                        part = stream[4 * s : 4 * (s + capacity)]
                        for c, v in zip(cols, (i, s, len(part) // 4, zlib.crc32(part), n, part), strict=False):
                            c.append(v)
            at = np.array(cols[0], dtype=np.int64)
            # a last piece goes where its document goes, a full piece anywhere
            last = np.array(cols[1], dtype=np.int64) + np.array(cols[2], dtype=np.int64) == np.array(cols[4], dtype=np.int64)
            seed = (np.arange(made, made + len(at)).astype(np.uint64) << _U(24)) + _U(task + 1)
            deal = mix(np.where(last, seed, ~seed)) >> _U(1)
            made += len(at)
            arrays = [ids.take(pa.array(at)), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(deal.astype(np.int64))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "deal"]
            if kept:
                arrays, names = [*arrays, pa.array(cols[5], kept)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, deal long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: sequence_id and offset in that sequence.

    Sequence ids are unique: the group in the upper bits, the bin of the group below.
    """
    pieces = Scratch(docs.sparkSession, "packing").keep(tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids))
    groups = max(1, -(-pieces.count() // group_pieces))
    pieces = pieces.withColumn("pack_group", F.col("deal") % F.lit(groups))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("deal", "ascending")])
        sizes = table["length"].to_numpy()
        bins, offsets = first_fit_decreasing(sizes, capacity)
        at = (table["pack_group"].to_numpy() << 32) + bins
        table = table.drop_columns(["deal", "pack_group"])
        return table.append_column("sequence_id", pa.array(at, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("deal", "pack_group")]
    return pieces.groupBy("pack_group").applyInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))
