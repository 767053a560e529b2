"""Removal of byte strings that occur more than once, by suffix arrays over shards.

A position is removed if a string of ``LENGTH`` bytes that covers it also starts
somewhere else.  Strings of that length are called windows here.

1. Dealing.  The hash of 32 bytes that is smallest within a window (the leftmost of
   equals) is its anchor.  Equal windows have equal anchors at equal distance, so windows
   can only be equal if their anchors are.  Neighbouring windows share anchors; a run of
   windows with one anchor, with its bytes, is a segment, named by the anchor's and its
   own hash.  Anchors met once are done: their windows occur once.
2. Equal segments are counted, not gathered: where one is met twice, all its windows
   repeat.  Only anchors met with different segments go on, each segment once, to shards.
3. Per shard suffix arrays of all windows, of whole anchors each: ranks by the first 8 bytes, then
   Larsson-Sadakane refinement, which doubles the depth and sorts only groups that are
   still tied.  Kasai's walk in text order then gives the common prefixes of neighbours,
   with many segments as lanes of one numpy walk.
4. An anchor with very many segments is cut into slices.  Each slice is a shard, and each
   two slices are merged: the windows of one are looked up in the other's suffix array by
   binary search.

Defined results
* null or empty text, or one shorter than a window: nothing is removed;
* null or repeated ids, repeated rows: every row is a document; rows with equal texts are copies;
* ties need no order: all places of a repeated string are removed, the first included;
* very long text: its windows are anchored in pieces, so only the text is held as a whole;
* empty table: no rows; further columns of the input are ignored.

A text is named by 96 bits of hashes, so it is read from the documents where it is
needed, and only texts with such segments are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.scratch import Scratch, marked, sieve
from traceloom.llm.textcore import chunks, mix, powers, running_hash, texts_of

LENGTH = 200
GRAM = 32
#: Bytes of segments in a shard, on average, and in a suffix array, unless one slice of an anchor has more.
SHARD_BYTES = 1 << 20
#: Segments of one anchor in a slice.
SLICE = 4096
#: Windows of a text that are anchored at once.
PIECE = 1 << 22

_U = np.uint64
#: Of positions and ranks in a suffix array.
_I = np.int32
_AT = _U((1 << 28) - 1)


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text, anchor and segment hash, first window, windows."""
    joined = b"\n".join([*texts, b""])
    n, width = len(joined), length - gram + 1
    none = {c: np.zeros(0, dtype=np.int64) for c in ("doc", "lo", "windows")} | {c: np.zeros(0, dtype=np.uint64) for c in ("anchor", "segment")}
    if n < length:
        return none
    buf = np.frombuffer(joined, dtype=np.uint8)
    run = running_hash(buf)
    _, down = powers(n)
    h = mix((run[gram:] - run[:-gram]) * down[: n - gram + 1])
    key = (h & ~_AT) | np.arange(len(h), dtype=np.uint64)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    usable = np.zeros(n, dtype=bool)
    for a, t in zip(starts, texts, strict=False):
        key[max(a, a + len(t) - gram + 1) : a + len(t) + 1] = _U(0xFFFFFFFFFFFFFFFF)
        usable[a : max(a, a + len(t) - length + 1)] = True
    # smallest of each width keys: from the left and from the right within blocks
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, _U(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = np.flatnonzero(usable)
    if not len(at):
        return none
    anchor = (np.minimum(right[at], left[at + width - 1]) & _AT).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    lo, count = at[first], np.diff(np.append(first, len(at)))
    doc = np.searchsorted(starts, lo, side="right") - 1
    size = count + length - 1
    segment = mix((run[lo + size] - run[lo]) * down[lo] ^ (size.astype(np.uint64) * _U(0xA0761D6478BD642F)))
    return {"doc": doc, "lo": lo - starts[doc], "windows": count, "anchor": h[anchor[first]], "segment": segment}


def _words_at(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    out = np.zeros(len(buf), dtype=np.uint64)
    for k in range(8):
        out <<= _U(8)
        out |= padded[k : k + len(buf)]
    return out


class SuffixArray:
    """The suffixes of concatenated segments to a given depth, none across segments.

    ``order`` has the positions of all windows, sorted by their strings, ``rank`` an
    order-preserving number of each window's string: equal for equal strings.
    """

    def __init__(self, parts: list[bytes], windows: np.ndarray, depth: int = LENGTH):
        self.depth, self.buf = depth, np.frombuffer(b"".join(parts), dtype=np.uint8)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.starts = np.cumsum(sizes) - sizes
        n = len(self.buf)
        room = np.repeat((self.starts + sizes).astype(_I), sizes)
        room -= np.arange(n, dtype=_I)
        self.words = _words_at(self.buf)
        act = np.flatnonzero(room >= min(8, depth)).astype(_I)
        tie = self.words[act]
        by = np.argsort(tie, kind="stable")
        act, tie = act[by], tie[by]
        del by
        rank = np.full(n, -1, dtype=_I)
        new = np.ones(len(act), dtype=bool)
        new[1:] = tie[1:] != tie[:-1]
        del tie
        rank[act] = np.maximum.accumulate(np.where(new, np.arange(len(act), dtype=_I), _I(0)))
        h = 8
        while h < depth and len(act):
            step = min(h, depth - h)
            act = act[room[act] >= h + step]
            act = act[self._tied(rank[act])]
            first, second = rank[act], rank[act + step]
            by = np.lexsort((second, first))
            act, first, second = act[by], first[by], second[by]
            if len(act):
                group = np.ones(len(act), dtype=bool)
                group[1:] = first[1:] != first[:-1]
                inner = group.copy()
                inner[1:] |= second[1:] != second[:-1]
                here = np.arange(len(act), dtype=_I)
                rank[act] = first + np.maximum.accumulate(np.where(inner, here, _I(0))) - np.maximum.accumulate(np.where(group, here, _I(0)))
            h += step
        self.rank = rank
        at = np.arange(int(windows.sum()), dtype=_I)
        at += np.repeat((self.starts - np.cumsum(windows) + windows).astype(_I), windows)
        self.at, self.windows = at, windows
        self.order = at[np.argsort(rank[at], kind="stable")]

    @staticmethod
    def _tied(rank: np.ndarray) -> np.ndarray:
        """Members of groups of two or more; equal ranks stand together."""
        same = np.zeros(len(rank) + 1, dtype=bool)
        same[1:-1] = rank[1:] == rank[:-1]
        return same[1:] | same[:-1]

    def common_prefixes(self) -> np.ndarray:
        """Kasai: for each window's position its common prefix with the window before it in order, up to depth."""
        n, depth = len(self.buf), self.depth
        before = np.full(n, -1, dtype=_I)
        before[self.order[1:]] = self.order[:-1]
        lcp = np.zeros(n, dtype=_I)
        # only windows tied at full depth can reach it; each run of them is a lane
        tied = np.sort(self.order[1:][self.rank[self.order[1:]] == self.rank[self.order[:-1]]])
        if not len(tied):
            return lcp
        new = np.flatnonzero(np.append(True, tied[1:] != tied[:-1] + 1))
        length = np.diff(np.append(new, len(tied)))
        p, left, h = tied[new], length.copy(), np.zeros(len(new), dtype=_I)
        while len(p):
            q = before[p]
            live = np.arange(len(p))
            while len(live):
                x, y, at = p[live], q[live], h[live]
                word = at + 8 <= depth
                gain = np.zeros(len(live), dtype=_I)
                gain[word] = 8 * (self.words[x[word] + at[word]] == self.words[y[word] + at[word]])
                byte = (gain == 0) & (at < depth)
                gain[byte] = self.buf[x[byte] + at[byte]] == self.buf[y[byte] + at[byte]]
                h[live] += gain
                live = live[(gain > 0) & (h[live] < depth)]
            lcp[p] = h
            h = np.maximum(h - 1, 0)
            p, left = p + 1, left - 1
            on = left > 0
            p, left, h = p[on], left[on], h[on]
        return lcp

    def repeated(self) -> np.ndarray:
        """Positions of windows whose string is met again."""
        lcp = self.common_prefixes()
        mark = np.zeros(len(self.buf), dtype=bool)
        full = lcp[self.order] >= self.depth
        mark[self.order[full]] = True
        mark[self.order[np.flatnonzero(full) - 1]] = True
        return mark

    def compare(self, at: np.ndarray, other: SuffixArray, to: np.ndarray) -> np.ndarray:
        """Signs of the comparison of this array's strings at ``at`` with other's at ``to``."""
        out, live = np.zeros(len(at), dtype=np.int8), np.arange(len(at))
        for k in range(0, self.depth, 8):
            if not len(live):
                break
            x, y = self.words[at[live] + k], other.words[to[live] + k]
            if k + 8 > self.depth:
                cut = _U(8 * (k + 8 - self.depth))
                x, y = x >> cut, y >> cut
            out[live] = (x > y).astype(np.int8) - (x < y).astype(np.int8)
            live = live[x == y]
        return out

    def met_in(self, other: SuffixArray) -> np.ndarray:
        """Positions of windows that other has too, by binary search in its order."""
        mark = np.zeros(len(self.buf), dtype=bool)
        lo, hi = np.zeros(len(self.at), dtype=_I), np.full(len(self.at), len(other.order), dtype=_I)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            sign = self.compare(self.at[live], other, other.order[mid])
            mark[self.at[live[sign == 0]]] = True
            lo[live] = np.where(sign > 0, mid + 1, lo[live])
            hi[live] = np.where(sign < 0, mid, hi[live])
            live = live[(sign != 0) & (lo[live] < hi[live])]
        return mark

    def spans(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of marked windows: segment, first, and one past the last."""
        m = np.zeros(len(self.at) + 2, dtype=np.int8)
        m[1:-1] = mark[self.at]
        owner = np.repeat(np.arange(len(self.windows), dtype=_I), self.windows)
        edge = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        starts = np.flatnonzero(np.diff(m) == 1)
        ends = np.flatnonzero(np.diff(m) == -1)
        inner = edge[(mark[self.at[edge - 1]] & mark[self.at[edge]])] if len(edge) else edge
        starts, ends = np.sort(np.append(starts, inner)), np.sort(np.append(ends, inner))
        own = owner[starts] if len(starts) else starts
        base = (np.cumsum(self.windows) - self.windows)[own] if len(starts) else starts
        return own, starts - base, ends - base


def _named(docs: DataFrame) -> DataFrame:
    """docs with the name of the text."""
    return docs.withColumns({"r1": F.xxhash64("text"), "r2": F.hash("text")})


def _anchored(docs: DataFrame, length: int, piece: int = PIECE) -> DataFrame:
    """A row per text and distinct segment: anchor, segment, the text's name, windows, and all first windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, of, offset = texts_of(b.column(0)), [], []
            texts = []
            for i, t in enumerate(whole):
                for at in range(0, max(1, len(t)), piece):
                    texts.append(t if len(t) <= piece else t[at : at + piece + length - 1])
                    of.append(i)
                    offset.append(at)
            of, offset = np.array(of, dtype=np.int64), np.array(offset, dtype=np.int64)
            for a, z in chunks(texts):
                s = segments(texts[a:z], length)
                s["lo"] += offset[a + s["doc"]]
                s["doc"] = of[a + s["doc"]]
                order = np.lexsort((s["lo"], s["segment"], s["anchor"], s["doc"]))
                doc, anchor, segment = (s[c][order] for c in ("doc", "anchor", "segment"))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])
                at = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), pa.array(s["lo"][order].astype(np.int32)))
                name = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[at].view(np.int64)), pa.array(segment[at].view(np.int64)), b.column(1).take(name), b.column(2).take(name), pa.array(s["windows"][order][at].astype(np.int32)), lists], ["anchor", "segment", "r1", "r2", "windows", "lo"])

    return _named(docs.where(F.octet_length("text") >= length)).select("text", "r1", "r2").mapInArrow(run, "anchor long, segment long, r1 long, r2 int, windows int, lo array<int>")


def _sharded(texts: DataFrame, length: int) -> DataFrame:
    """From rows (text, picks) the picked segments with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, picks in zip(texts_of(b.column(0)), b.column(1), strict=True):
                p = picks.values.flatten()
                named = {f.name: x for f, x in zip(picks.values.type, p, strict=True)}
                parts = [text[lo : lo + w + length - 1] for lo, w in zip(named["lo"].to_pylist(), named["windows"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(named[c] for c in ("anchor", "segment", "times", "windows", "i", "j", "second", "shard")), pa.array(parts, pa.binary())], ["anchor", "segment", "times", "windows", "i", "j", "second", "shard", "part"])

    return texts.mapInArrow(run, "anchor long, segment long, times long, windows int, i long, j long, second boolean, shard long, part binary")


def repeated_windows(table: pa.Table, length: int = LENGTH, array_bytes: int = SHARD_BYTES) -> pa.Table:
    """Runs of windows that repeat among a shard's segments: anchor, segment, first, one past the last.

    A suffix array takes more whole slices while they have up to array_bytes together, so
    memory does not grow with the shard.
    """
    anchor, i, j, second = table["anchor"].to_numpy(), table["i"].to_numpy(), table["j"].to_numpy(), table["second"].to_numpy(zero_copy_only=False)
    windows, parts = table["windows"].to_numpy().astype(np.int64), table["part"].to_pylist()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def slices(rows: np.ndarray) -> list[np.ndarray]:
        """The rows of each anchor and two slices of it."""
        rows = rows[np.lexsort((j[rows], i[rows], anchor[rows]))]
        new = (anchor[rows][1:] != anchor[rows][:-1]) | (i[rows][1:] != i[rows][:-1]) | (j[rows][1:] != j[rows][:-1])
        return np.split(rows, np.flatnonzero(new) + 1) if len(rows) else []

    def add(rows: np.ndarray, array: SuffixArray, mark: np.ndarray) -> None:
        own, a, z = array.spans(mark)
        found.append((rows[own], a, z))

    def repeated(rows: list[np.ndarray]) -> None:
        plain = np.concatenate(rows)
        array = SuffixArray([parts[r] for r in plain], windows[plain], length)
        add(plain, array, array.repeated())

    held, size = [], 0
    for rows in slices(np.flatnonzero(i == j)):
        more = int(windows[rows].sum()) + len(rows) * (length - 1)
        if held and size + more > array_bytes:
            repeated(held)
            held, size = [], 0
        held.append(rows)
        size += more
    if held:
        repeated(held)
    # each two slices by themselves: a segment is the second in one merge and the first in another
    for rows in slices(np.flatnonzero(i != j)):
        sides = [rows[second[rows] == s] for s in (False, True)]
        if all(map(len, sides)):
            one, two = (SuffixArray([parts[r] for r in side], windows[side], length) for side in sides)
            add(sides[0], one, one.met_in(two))
            add(sides[1], two, two.met_in(one))
    rows, a, z = (np.concatenate([f[k] for f in found]).astype(np.int64) if found else np.zeros(0, dtype=np.int64) for k in range(3))
    picked = table.select(["anchor", "segment"]).take(pa.array(rows))
    return picked.append_column("a", pa.array(a.astype(np.int32))).append_column("z", pa.array(z.astype(np.int32)))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, slice_size: int = SLICE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per text (r1, r2) the lists of first and one past the last byte of what repeats; docs: text."""
    seen = _anchored(docs, length).withColumn("times", F.size("lo").cast("long"))
    met = seen.groupBy("anchor").agg(F.sum("times").alias("total")).where("total > 1").select("anchor")
    kept = scratch.keep(seen.join(met, "anchor"))
    distinct = scratch.keep(kept.groupBy("anchor", "segment").agg(F.sum("times").alias("times"), F.first("windows").alias("windows"), F.min(F.struct("r1", "r2", F.col("lo")[0].alias("lo"))).alias("at")))
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("windows") + (length - 1)).alias("bytes")).where("kinds > 1")
    total = mixed.agg(F.sum(F.col("bytes") * F.ceil(F.col("kinds") / slice_size))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    picks = distinct.join(mixed.select("anchor", F.ceil(F.col("kinds") / slice_size).alias("slices")), "anchor")
    picks = picks.withColumn("own", F.expr("pmod(segment, slices)")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    picks = picks.select("anchor", "segment", "times", "windows", "at.r1", "at.r2", "at.lo", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))
    picks = picks.withColumn("shard", F.expr(f"pmod(xxhash64(anchor, i, j), {shards}L)"))
    listed = scratch.keep(picks.groupBy("r1", "r2").agg(F.collect_list(F.struct("anchor", "segment", "times", "windows", "lo", "i", "j", "second", "shard")).alias("picks")))
    texts = sieve(_named(docs.where(F.octet_length("text") >= length)), listed, "r1").join(listed.select("r1", "r2"), ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.min("text").alias("text"))
    parts = _sharded(texts.join(listed, ["r1", "r2"]).select("text", "picks"), length)
    found = parts.groupBy("shard").applyInArrow(lambda t: repeated_windows(t, length), "anchor long, segment long, a int, z int")
    whole = distinct.where("times > 1").select("anchor", "segment", F.lit(0).alias("a"), F.col("windows").alias("z"))
    single = distinct.where("times = 1").select("anchor", "segment")
    runs = scratch.keep(whole.unionByName(found.join(single, ["anchor", "segment"])))
    scratch.drop(3)
    spans = kept.join(runs, ["anchor", "segment"]).select("r1", "r2", F.explode("lo").alias("lo"), "a", "z")
    # copies of a text have the same spans
    spans = spans.groupBy("r1", "r2").agg(F.collect_set(F.struct((F.col("lo") + F.col("a")).alias("start"), (F.col("lo") + F.col("z") + (length - 1)).alias("end"))).alias("spans"))
    return scratch.keep(spans.select("r1", "r2", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends")))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs; touching spans are one run."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", slice_size: int = SLICE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each row's id, n_bytes, n_removed, n_spans, the removed runs, and the bytes kept."""
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    spans = repeated_spans(rows.select("text"), scratch, length, slice_size, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, first, last = [], [], []
            for text, s, e in zip(texts_of(b.column(1)), b.column(2), b.column(3), strict=True):
                if s.values is None:
                    kept.append(text)
                    first.append([])
                    last.append([])
                    continue
                a, z = merged(s.values.to_numpy(), e.values.to_numpy())
                kept.append(b"".join(text[x:y] for x, y in zip([0, *z], [*a, len(text)], strict=True)))
                first.append(a)
                last.append(z)
            sizes = pa.array([len(x) for x in first], pa.int64())
            gone = pa.array([int((z - a).sum()) if len(a) else 0 for a, z in zip(first, last, strict=True)], pa.int64())
            n = pa.array([len(k) for k in kept], pa.int64())
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.compute.add(n, gone), gone, sizes, pa.array(first, kind), pa.array(last, kind), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    none = F.lit(None).cast("array<int>")
    rows = marked(_named(rows), spans, "r1", "may")
    joined = rows.where("may").join(spans, ["r1", "r2"], "left").select("id", "text", "starts", "ends")
    joined = joined.unionByName(rows.where("not may").select("id", "text", none.alias("starts"), none.alias("ends")))
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, starts array<int>, ends array<int>, kept binary")
