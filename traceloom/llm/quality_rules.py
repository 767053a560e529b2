"""Quality rules: counts per text, fixed rules, and an isolation forest over the counts.

As the method has it, each tree draws its splits from ``TREE_ROWS`` random rows of its
own.  All rows then go down all trees, and a leaf's path length follows from its share of
them.  A row's anomaly score follows from its mean path length.  The threshold is
calibrated from all labelled rows: of the thresholds that keep at least ``KEEP_GOOD`` of
the good rows it takes the one that rejects most of the bad.  It is found by counts of
16 bits of the scores at a time, so no row is gathered.
Counts, leaves, threshold, scores and verdicts cover every row.

Defined results
* null or empty text: no words, all counts zero, so ``base_failed``;
* null or repeated ids, repeated rows: each row is judged on its own text;
* no labelled row of both kinds: no calibration, only the fixed rules reject;
* empty table: no rows;
* further columns are kept by ``filter_documents`` and ignored by ``quality_rules``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.scratch import Scratch
from traceloom.llm.textcore import Words, chunks, shingles, texts_of

TREES = 128
TREE_ROWS = 256
#: Share of good labelled rows that the threshold must keep.
KEEP_GOOD = 0.99
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: The counts with those that only the forest sees.
NAMES = [*COUNTS, "n_other", "n_lines"]
#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_SPACE = b" \t\n\x0b\x0c\r"


def _sums(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marked positions in each span [at[i], at[i + 1])."""
    run = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=run[1:])
    return run[np.minimum(at[1:], len(marks))] - run[np.minimum(at[:-1], len(marks))]


def rule_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text, and some more that only the forest sees."""
    w = Words(texts, lower=False)
    n = w.count
    inside = np.zeros(len(w.buf) + 1, dtype=np.int8)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside)[:-1].astype(bool)
    head = (w.buf & 0xC0) != 0x80
    word_chars = _sums(inside & head, w.at)
    symbols = _sums(_SYMBOL[w.buf], w.at)
    letters = (w.buf >= 0x80) | (((w.buf | 0x20) >= 0x61) & ((w.buf | 0x20) <= 0x7A))
    other = _sums(inside & ~letters, w.at)
    # windows of words: those seen again, and the words that they cover
    h, made = shingles(w, WINDOW, short_whole=False)
    repeat = np.zeros(len(texts), dtype=np.int64)
    if len(h):
        owner = np.repeat(np.arange(len(texts)), made)
        order = np.lexsort((h, owner))
        same = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        again = np.zeros(len(h), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = np.flatnonzero(again)
        word = at - (np.cumsum(made) - made)[owner[at]] + w.first[:-1][owner[at]]
        cover = np.zeros(len(w.start) + 1, dtype=np.int64)
        np.add.at(cover, word, 1)
        np.add.at(cover, word + WINDOW, -1)
        repeat = _sums(np.cumsum(cover)[:-1] > 0, w.first)
    dup = np.zeros(len(texts), dtype=np.int64)
    lines = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            full = [x for x in t.split(b"\n") if x.strip(_SPACE)]
            lines[i], dup[i] = len(full), len(full) - len(set(full))
        else:
            lines[i] = n[i] > 0
    return {"n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_other": other, "n_lines": lines}


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest splits on: shares, which hardly depend on a text's length."""
    n = np.maximum(c["n_words"], 1)
    chars = np.maximum(c["word_chars"], 1)
    return np.column_stack([
        c["n_symbols"] / chars,
        c["n_other"] / chars,
        c["word_chars"] / n,
        c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        c["n_repeat_words"] / n,
    ])


def _expected(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length of an unsuccessful search among n rows; n may be a mean number of rows."""
    n = np.asarray(n, dtype=float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, np.maximum(2 * h - 2 * (n - 1) / np.maximum(n, 1), 1.0), np.clip(n - 1, 0.0, 1.0))


class IsolationForest:
    """Trees as arrays: a node's column, split value, children, and at a leaf its path length."""

    def __init__(self, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7):
        self.trees, self.rows, self.seed = trees, rows, seed

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        self.used = min(self.rows, len(x))
        deepest = max(1, math.ceil(math.log2(max(2, self.used))))
        column, value, left, right, depths, length = [], [], [], [], [], []
        self.roots = []

        def grow(part: np.ndarray, depth: int) -> int:
            at = len(column)
            for a in (column, value, left, right, length):
                a.append(0)
            depths.append(depth)
            spread = np.flatnonzero(part.min(axis=0) < part.max(axis=0)) if len(part) > 1 else []
            if depth >= deepest or not len(spread):
                column[at], length[at] = -1, depth + float(_expected(len(part)))
                return at
            c = int(rng.choice(spread))
            v = float(rng.uniform(part[:, c].min(), part[:, c].max()))
            low = part[:, c] <= v
            column[at], value[at] = c, v
            left[at] = grow(part[low], depth + 1)
            right[at] = grow(part[~low], depth + 1)
            return at

        apart = rng.permutation(len(x)) if len(x) >= self.trees * self.used else None
        for k in range(self.trees):
            own = apart[k * self.used : (k + 1) * self.used] if apart is not None else rng.choice(len(x), self.used, replace=False)
            self.roots.append(grow(x[own], 0))
        self.column, self.value = np.array(column, dtype=np.int16), np.array(value)
        self.left, self.right, self.depth, self.length = np.array(left), np.array(right), np.array(depths), np.array(length)
        return self

    def weigh(self, rows: np.ndarray) -> IsolationForest:
        """Path lengths from the rows of the whole table in each leaf, instead of those of the trees' own rows."""
        share = rows / max(1, rows.sum() / len(self.roots))
        self.length = np.where(self.column < 0, self.depth + _expected(self.used * share), 0.0)
        return self

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of each tree the leaves of all rows."""
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            live = rows
            while len(live):
                c = self.column[at[live]]
                live, c = live[c >= 0], c[c >= 0]
                here = at[live]
                low = x[live, c] <= self.value[here]
                at[live] = np.where(low, self.left[here], self.right[here])
            yield at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path, the higher."""
        total = np.zeros(len(x))
        for at in self.leaves(x):
            total += self.length[at]
        return np.exp2(-total / len(self.roots) / max(float(_expected(self.used)), 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The threshold above which rows are rejected; infinite without rows of both kinds.  For rows in memory."""
    if not good.any() or good.all():
        return math.inf
    kept = np.sort(scores[good])
    least = kept[min(len(kept) - 1, math.ceil(keep_good * len(kept)) - 1)]
    bad = np.sort(scores[~good])
    # the middle of the gap to the next bad row, so that rows like the good ones stay
    above = bad[bad > least]
    return float((least + above[0]) / 2) if len(above) else float(least)


def counted(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """The counts of each row, with the columns in keep."""
    keep = keep or [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(len(keep)))
            for lo, hi in chunks(texts):
                c = rule_counts(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(len(keep))), *(pa.array(c[n].astype(np.int64)) for n in NAMES)], [*(f"kept{i}" for i in range(len(keep))), *NAMES])

    schema = ", ".join([*(f"kept{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *(f"{n} long" for n in NAMES)])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


def _weighed(forest: IsolationForest, counts: DataFrame) -> IsolationForest:
    """forest with the leaves' shares of all rows of counts."""
    held = counts.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = held.value
        rows = np.zeros(len(forest.column), dtype=np.int64)
        for b in batches:
            c = {n: b.column(b.schema.get_field_index(n)).to_numpy() for n in NAMES}
            for at in forest.leaves(statistics(c)):
                rows += np.bincount(at, minlength=len(rows))
        met = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(rows[met])], ["leaf", "rows"])

    found = counts.select(*NAMES).mapInArrow(run, "leaf int, rows long").groupBy("leaf").agg(F.sum("rows").alias("rows")).toArrow()  # as many as the trees have leaves
    rows = np.zeros(len(forest.column))
    rows[found["leaf"].to_numpy()] = found["rows"].to_numpy()
    return forest.weigh(rows)


def calibrated(scores: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """``calibrate`` for a table of scores, as bits of positive doubles, and good."""
    n = {r["good"]: r["n"] for r in scores.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return math.inf
    # the order of positive doubles is that of their bits
    place, least = min(n[True], math.ceil(keep_good * n[True])), 0
    for shift in (48, 32, 16, 0):
        within = scores.where(F.col("good") & (F.col("bits") >= least) & (F.col("bits") <= least + ((1 << min(63, shift + 16)) - 1)))
        found = within.groupBy(F.shiftright("bits", shift).bitwiseAND(F.lit(0xFFFF)).alias("part")).agg(F.count("*").alias("n")).toArrow()  # at most 2**16 rows
        part, held = found["part"].to_numpy(), found["n"].to_numpy()
        order = np.argsort(part)
        run = np.cumsum(held[order])
        at = int(np.searchsorted(run, place))
        place -= int(run[at] - held[order][at])
        least |= int(part[order][at]) << shift
    above = scores.where(~F.col("good") & (F.col("bits") > least)).agg(F.min("bits")).first()[0]
    of = lambda bits: float(np.array([bits], dtype=np.int64).view(np.float64)[0])
    return of(least) if above is None else (of(least) + of(above)) / 2


def _drawn(counts: DataFrame, n: int):
    """The n rows with the smallest hashes, which only rows that may be among them are sorted for."""
    key, last = F.xxhash64("kept0", *NAMES, F.lit(17)), (1 << 63) - 1
    total = counts.count()
    for most in (min(last, int(1.25 * n / max(1, total) * (1 << 64)) - (1 << 63)), last):
        rows = counts.where(key <= most).orderBy(key).limit(n).select(*NAMES).toPandas()
        if len(rows) == min(n, total):  # not if many rows are copies
            break
    return rows


def fitted(counts: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> tuple[IsolationForest, float]:
    """The forest, its leaves weighed by all rows, and the threshold calibrated from all labelled rows."""
    good = F.when(F.col("quality").isNotNull(), F.col("quality") > 0)
    worded = counts.where(f"n_words >= {MIN_WORDS}")
    drawn = _drawn(worded, TREES * TREE_ROWS)
    if not len(drawn):
        return IsolationForest(trees=1).fit(np.zeros((1, 5))), math.inf
    forest = _weighed(IsolationForest(TREES, TREE_ROWS).fit(statistics({n: drawn[n].to_numpy() for n in NAMES})), worded)
    held = counts.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = held.value
        for b in batches:
            c = {n: b.column(b.schema.get_field_index(n)).to_numpy() for n in NAMES}
            score = forest.score(statistics(c)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(score.view(np.int64)), b.column(len(NAMES))], ["bits", "good"]).filter(pa.array(~base_failed(c)))

    judged = labels.select(F.col(id_col).alias("labelled"), good.alias("good")).where("good is not null")
    rows = counts.join(judged, F.col("kept0") == F.col("labelled")).select(*NAMES, "good")
    return forest, calibrated(scratch.keep(rows.mapInArrow(run, "bits long, good boolean")))


def judged(counts: DataFrame, forest: IsolationForest, threshold: float) -> DataFrame:
    """counts with base_failed, anomaly and kept."""
    held = counts.sparkSession.sparkContext.broadcast((forest, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, threshold = held.value
        for b in batches:
            c = {n: b.column(b.schema.get_field_index(n)).to_numpy() for n in NAMES}
            failed = base_failed(c)
            score = forest.score(statistics(c)) if len(failed) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(score), pa.array(~failed & (score <= threshold))], [*b.schema.names, "base_failed", "anomaly", "kept"])

    return counts.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema) + ", base_failed boolean, anomaly double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, counts, base_failed, kept, and anomaly score."""
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.keep(counted(docs, id_col, text_col))
    out = judged(counts, *fitted(counts, labels, scratch, id_col))
    return out.select(F.col("kept0").alias(id_col), *COUNTS, "base_failed", "kept", "anomaly")


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    scratch = Scratch(docs.sparkSession, "quality")
    counts = scratch.keep(counted(docs, id_col, text_col))
    forest, threshold = fitted(counts, labels, scratch, id_col)
    held = docs.sparkSession.sparkContext.broadcast((forest, threshold))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, threshold = held.value
        for b in batches:
            texts = texts_of(b.column(at))
            for lo, hi in chunks(texts):
                c = rule_counts(texts[lo:hi])
                good = ~base_failed(c) & (forest.score(statistics(c)) <= threshold)
                yield b.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
