"""Removal of line blocks that a document shares with an earlier one.

Documents are ordered by id.  A rare line, of some length and in at most ``RARE`` places,
brings each two of its holders together.  A more common line pairs every later holder with
the first one, found by an aggregation, so it gives n - 1 pairs and needs no cap.  A line
that its first holder leaves in place, out of order or in a further copy, meets its next
earlier holders, twice as many in each round, until one aligns it or all have been tried.
Runs of shorter lines count as a line: from each line on, as many as make a block that is
deleted, so that every such block has a holder.

A pair is aligned by patience diff: lines met once in either document, in the longest
common order, are anchors; the gaps between them are aligned in the same way, and
blocks grow from the anchors over equal lines.  A gap without such lines is aligned by
its longest common subsequence.  Aligned blocks with enough text are
deleted from the later document.  Partners are always taken as they came, so the result
does not depend on the order of work.  Only line hashes and lengths travel.

Defined results
* lines are split at line feeds and compared without surrounding white space;
* null text stays null, empty text stays empty; both have no partners;
* ties: equal ids are ordered by a hash of the text; rows equal in id and text are one
  document and get the same result, each row once;
* null ids come after all others;
* empty table: no rows; further columns are carried along unchanged, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.scratch import Scratch, free_name
from traceloom.llm.textcore import mix

#: Characters of a line that can bring two documents together by itself.
MIN_LINE = 20
#: Characters of an aligned block that is deleted.
MIN_BLOCK = 20
#: Places of a line that is rare.
RARE = 4
#: Bits held while a gap is aligned; larger gaps are halved.
MAX_BITS = 1 << 28
#: Pairs whose line lists are Python objects at once.
ROWS = 64

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def unique_anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Positions of lines met once in both spans, in the longest order common to both."""
    in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    at = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
    pairs = [(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in at]
    ends: list[int] = []  # the least last position of an increasing run of each length
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        back[k] = piles[n - 1] if n else -1
        if n == len(ends):
            ends.append(j)
            piles.append(k)
        else:
            ends[n], piles[n] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def common_order(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of both spans, by rows of bits."""
    in_a, in_b = set(a[a0:a1]), set(b[b0:b1])
    rows = [i for i in range(a0, a1) if a[i] in in_b]
    cols = [j for j in range(b0, b1) if b[j] in in_a]
    out: list[tuple[int, int]] = []
    work = [(rows, cols)]
    while work:
        rows, cols = work.pop()
        if not rows or not cols:
            continue
        if len(rows) > 1 and len(rows) * len(cols) > MAX_BITS:  # halve the rows where both parts have most in common
            half = len(rows) // 2
            left = common_lengths(a, b, rows[:half], cols)
            right = common_lengths(a, b, rows[half:][::-1], cols[::-1])[::-1]
            cut = int(np.argmax(left + right))
            work += [(rows[:half], cols[:cut]), (rows[half:], cols[cut:])]
            continue
        steps = list(_bit_rows(a, b, rows, cols))
        r, c = len(rows), len(cols)
        while r and c:
            if steps[r - 1] >> (c - 1) & 1:
                c -= 1
                continue
            r -= 1
            if not r or steps[r - 1] >> (c - 1) & 1:
                c -= 1
                out.append((rows[r], cols[c]))
    return sorted(out)


def _bit_rows(a: list[int], b: list[int], rows: list[int], cols: list[int]) -> Iterator[int]:
    """After each row, bits of the columns at which the longest common subsequence does not grow."""
    at: dict[int, int] = {}
    for k, j in enumerate(cols):
        at[b[j]] = at.get(b[j], 0) | 1 << k
    full = (1 << len(cols)) - 1
    v = full
    for i in rows:
        u = v & at.get(a[i], 0)
        v = ((v + u) | (v - u)) & full
        yield v


def common_lengths(a: list[int], b: list[int], rows: list[int], cols: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of the rows and each prefix of the columns."""
    v = 0
    for v in _bit_rows(a, b, rows, cols):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(cols) // 8), "little"), dtype=np.uint8), bitorder="little")[: len(cols)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned blocks (start in a, start in b, lines), in order."""
    matched: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        anchors = unique_anchors(a, b, a0, a1, b0, b1)
        if not anchors:
            matched += common_order(a, b, a0, a1, b0, b1)
            continue
        for i, j in [*anchors, (a1, b1)]:
            while i > a0 and j > b0 and i < a1 and a[i - 1] == b[j - 1]:  # grow back from the anchor
                i, j = i - 1, j - 1
            if i < a1 or j < b1:
                work.append((a0, i, b0, j))
                while i < a1 and j < b1 and a[i] == b[j]:  # and on from it
                    matched.append((i, j))
                    i, j = i + 1, j + 1
                a0, b0 = max(a0, i), max(b0, j)
            else:
                work.append((a0, a1, b0, b1))
    out: list[tuple[int, int, int]] = []
    for i, j in sorted(set(matched)):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def short_runs(hashes: np.ndarray, sizes: np.ndarray, ends: np.ndarray, min_line: int, min_block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and hashes of the shortest runs of lines below min_line that have min_block characters.

    The lines are those of several documents, ends the number of lines up to the end of each line's document.
    """
    n = len(sizes)
    chars = np.append(0, np.cumsum(sizes))
    long = np.append(0, np.cumsum(sizes >= min_line))
    at = np.flatnonzero(sizes > 0)
    stop = np.searchsorted(chars, chars[at] + max(min_block, 1))
    ok = stop <= ends[at]
    at, stop = at[ok], stop[ok]
    ok = long[stop] == long[at]
    at, stop = at[ok], stop[ok]
    up, down = (np.append(_U(1), np.cumprod(np.full(n, m, dtype=np.uint64))) for m in (_U(_STEP), _U(pow(_STEP, -1, 1 << 64))))
    sums = np.append(_U(0), np.cumsum(mix(hashes.copy()) * up[:n]))
    return at, stop - at, mix((sums[stop] - sums[at]) * down[at])


def aligned_lines(batches: Iterator[pa.RecordBatch], min_block: int) -> Iterator[pa.RecordBatch]:
    """From rows (doc, hashes, sizes, other) the numbers of lines that align with other, a few rows as Python lists at once."""
    for batch in batches:
        for b in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
            found = []
            for mine, sizes, other in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                gone: list[int] = []
                for i, _, n in patience_blocks(mine, other):
                    if sum(sizes[i : i + n]) >= min_block:
                        gone.extend(range(i, i + n))
                found.append(gone)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc", "gone"])


def _lines(text_col: str) -> Column:
    return F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")))


def shared_blocks(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, min_line: int = MIN_LINE, min_block: int = MIN_BLOCK) -> DataFrame:
    """Per later document (id, mark) the numbers of its deleted lines."""
    lines = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), _lines(text_col).alias("lines"))
    lines = lines.select("id", "mark", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.length(x)).alias("sizes"))
    lines = scratch.keep(lines.dropDuplicates(["id", "mark"]).select(F.struct(F.col("id").isNull().alias("last"), "id", "mark").alias("doc"), "hashes", "sizes"))
    kind = lines.schema["doc"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, size = b.column(1), b.column(2)
            many = np.diff(h.offsets.to_numpy())
            ends = np.repeat(np.cumsum(many), many)
            at, n, key = short_runs(h.flatten().to_numpy().view(np.uint64), size.flatten().to_numpy().astype(np.int64), ends, min_line, min_block)
            starts = ends - np.repeat(many, many)
            doc = np.repeat(np.arange(len(many)), many)[at]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array((at - starts[at]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64))], ["doc", "at", "n", "line"])

    def aligned(pairs: DataFrame) -> DataFrame:
        """Numbers of the lines (doc, at) that these pairs (doc, early) align."""
        early = lines.select(F.col("doc").alias("early"), F.col("hashes").alias("other"))
        both = pairs.join(lines, "doc").join(early, "early")
        return both.select("doc", "hashes", "sizes", "other").mapInArrow(lambda batches: aligned_lines(batches, min_block), f"doc {kind}, gone array<int>").select("doc", F.explode("gone").alias("at"))

    def kept(df: DataFrame) -> DataFrame:
        """df, written in small Arrow batches: an early document's lines come with each of its pairs."""
        conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(name)
        conf.set(name, str(ROWS))
        try:
            return scratch.keep(df)
        finally:
            conf.set(name, before)

    placed = lines.select("doc", F.posexplode(F.arrays_zip("hashes", "sizes")).alias("at", "l")).where(F.col("l.sizes") >= min_line).select("doc", "at", F.lit(1).alias("n"), F.col("l.hashes").alias("line"))
    placed = placed.unionAll(kept(lines.select("doc", "hashes", "sizes").mapInArrow(runs, f"doc {kind}, at int, n int, line long")))
    held = placed.select("doc", "line")
    first = held.groupBy("line").agg(F.min("doc").alias("early"), F.count("*").alias("times")).where("times > 1")
    met = held.join(first, "line")
    rare = met.where(F.col("times") <= RARE).select("line", "doc")
    both = rare.join(rare.withColumnRenamed("doc", "early"), "line").where("early < doc").select("doc", "early")  # at most RARE * (RARE - 1) / 2 a line
    pairs = met.where((F.col("times") > RARE) & (F.col("early") < F.col("doc"))).select("doc", "early").unionByName(both)
    gone = kept(aligned(pairs.distinct()))
    # what the first holders leave; holders are numbered only for lines among it
    left = placed.join(first.drop("times"), "line").where("early < doc").select("doc", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at"), "line").join(gone, ["doc", "at"], "left_anti")
    left = scratch.keep(left)
    ranked = held.join(left.select("line").distinct(), "line", "left_semi").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("line").orderBy("doc")) - 1)
    ranked = scratch.keep(ranked)
    left = left.join(ranked.withColumnRenamed("rank", "own"), ["doc", "line"])
    low = 1
    while not (left := scratch.keep(left.where(F.col("own") > low))).isEmpty():
        tries = left.select("doc", "line", F.explode(F.sequence(F.lit(low), F.least(F.lit(2 * low), "own") - 1)).alias("rank")).distinct()
        more = kept(aligned(tries.join(ranked.withColumnRenamed("doc", "early"), ["line", "rank"]).select("doc", "early").distinct()))
        gone = gone.unionAll(more)
        left = left.join(more, ["doc", "at"], "left_anti")
        low *= 2
    gone = gone.groupBy("doc").agg(F.collect_set("at").alias("gone"))
    return gone.select(F.col("doc.id").alias("id"), F.col("doc.mark").alias("mark"), "gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line: int = MIN_LINE, min_block: int = MIN_BLOCK) -> DataFrame:
    """The rows of docs with shared lines deleted from their texts, and two more columns: lines, and lines deleted.

    These are the last ones, __n_lines and __n_removed unless docs has such names.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    gone = shared_blocks(docs, id_col, text_col, scratch, min_line, min_block).select(F.col("id").alias("gone_id"), "mark", "gone")
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # names of docs cannot clash with others
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    text = F.col(names[text_col])
    out = rows.join(gone, F.col(names[id_col]).eqNullSafe(F.col("gone_id")) & (F.xxhash64(text) == F.col("mark")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), text).otherwise(kept)
    columns = [(text if c == text_col else F.col(n)).alias(c) for c, n in names.items()]
    n_lines = F.coalesce(F.when(F.col(names[text_col]) != "", F.size(lines)), F.lit(0)).cast("long")
    return out.select(*columns, n_lines.alias(free_name(docs, "__n_lines")), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(free_name(docs, "__n_removed")))
