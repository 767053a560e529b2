"""Ordinal quality classifier: cumulative-link regression on hashed texts.

Labelled rows are graded 0 (toxic), 1 (poor) or 2 (good).  One weight vector over
hashed features is shared by all grades; ordered thresholds cut its score into grades:
P(grade <= j) = sigmoid(threshold_j - score).  The expected grade and the probability
of the best grade follow for every row.

The model is fitted on a bounded sample of labelled rows, ``FIT_ROWS``, taken by a
hash of the id.  All rows are scored.

Features of a text, each present or not: its words; the last three and the first bytes of
its words; its share of distinct words, its symbols' share and its length, in steps.

Defined results
* null or empty text: only the features of the steps;
* null or repeated ids, repeated rows: each row is scored on its own text;
* rows without grade are not learned from; no graded row: score 0, thresholds at even odds;
* several labels for an id: the worst counts; several rows with a labelled id: one is fitted on;
* empty table: no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.textcore import Words, chunks, distinct_by_owner, mix, powers, running_hash, texts_of

BITS = 18
#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 8192
STEPS = 300
RATE = 0.3
#: Weight of the sum of absolute weights: most weights are zero, so rare words do not stand for their texts.
PENALTY = 3e-4
#: Labelled rows that a feature must be met in to get a weight.
LEAST_ROWS = 3
#: Lengths of words' beginnings, in bytes.
HEADS = (5, 6, 7)
GRADES = 3
#: Probability of the best grade that a selected row has at least.
SELECT = 0.5

_U = np.uint64
#: ASCII marks stand for spaces, so a word is the same with and without marks around it.
_APART = bytes(c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256))
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>@{}")] = True


def hashed_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and index of each feature that a text has, ordered by owner."""
    w = Words([t.translate(_APART) for t in texts])
    h, owner = w.hashes(), w.owner()
    tail = np.zeros(len(h), dtype=np.uint64)
    for k in range(3):
        at = w.end - 1 - k
        tail = tail * _U(257) + np.where(at >= w.start, w.buf[np.maximum(at, 0)], 0).astype(np.uint64)
    o, v = distinct_by_owner(owner, h)
    distinct = np.bincount(o, minlength=len(texts))
    n = np.maximum(w.count, 1)
    raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    run = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(_SYMBOL[raw], out=run[1:])
    symbols = run[np.minimum(w.at[1:], len(raw))] - run[np.minimum(w.at[:-1], len(raw))]
    long_run, down = running_hash(w.buf), powers(len(w.buf))[1]
    heads = []
    for size in HEADS:
        at = np.flatnonzero(w.end - w.start > size)
        begin = w.start[at]
        heads.append(distinct_by_owner(owner[at], mix((long_run[begin + size] - long_run[begin]) * down[begin] + _U(size))))
    steps = [10 * distinct // n, np.minimum(20 * symbols // n, 40), np.log2(w.count + 1).astype(np.int64)]
    docs = np.arange(len(texts))
    t, u = distinct_by_owner(owner, mix(tail + _U(0x5EED)))
    owners = np.concatenate([o, t, *(a for a, _ in heads), *(docs for _ in steps)])
    values = np.concatenate([v, u, *(b for _, b in heads), *(mix(s.astype(np.uint64) + _U(1000 * (k + 1))) for k, s in enumerate(steps))])
    order = np.argsort(owners, kind="stable")
    return owners[order], (values[order] >> _U(64 - BITS)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """Shared weights and ordered thresholds; the gaps between thresholds are exponentials."""

    def __init__(self, grades: int = GRADES, bits: int = BITS):
        self.grades, self.weights = grades, np.zeros(1 << bits)
        even = np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1))
        self.first, self.gaps = even[0], np.log(np.diff(even))

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def score(self, owner: np.ndarray, index: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(owner, weights=self.weights[index], minlength=rows)

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """A row's probability of each grade."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        return np.diff(np.column_stack([np.zeros(len(score)), below, np.ones(len(score))]), axis=1)

    def fit(self, owner: np.ndarray, index: np.ndarray, grade: np.ndarray, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> CumulativeLink:
        """Proximal gradient steps on the mean log likelihood, sized per weight by its gradients so far."""
        rows, size, last = len(grade), len(self.weights), self.grades - 1
        met = np.bincount(index, minlength=size) >= LEAST_ROWS
        owner, index = owner[met[index]], index[met[index]]
        squares, edge_squares = np.zeros(size), np.full(last, 1e-8)
        for _ in range(steps):
            edges = np.concatenate([[-np.inf], self.thresholds, [np.inf]])
            s = self.score(owner, index, rows)
            hi = np.where(grade == last, 1.0, _sigmoid(edges[grade + 1] - s))
            lo = np.where(grade == 0, 0.0, _sigmoid(edges[grade] - s))
            p = np.maximum(hi - lo, 1e-12) * rows
            d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            g = np.bincount(index, weights=(d_hi - d_lo)[owner], minlength=size)
            squares += g * g
            step = rate / (np.sqrt(squares) + 1e-8)
            w = self.weights - step * g
            self.weights = np.where(met, np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0), 0.0)
            d_edge = np.bincount(grade, weights=-d_hi, minlength=self.grades)[:-1] + np.bincount(grade, weights=d_lo, minlength=self.grades)[1:]
            d = np.array([d_edge.sum(), *(d_edge[k + 1 :].sum() * np.exp(gap) for k, gap in enumerate(self.gaps))])
            edge_squares += d * d
            d *= rate / np.sqrt(edge_squares)
            self.first, self.gaps = self.first - d[0], self.gaps - d[1:]
        return self


def grade_of(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good; null if the label is."""
    return F.when(toxic > 0, 0).when(quality > 0, 2).when(quality <= 0, 1)


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> CumulativeLink:
    """The model, fitted on at most so many labelled rows."""
    graded = labels.select(F.col(id_col).alias("labelled"), grade_of(F.col("quality"), F.col("toxic")).alias("grade")).where("grade is not null")
    graded = graded.groupBy("labelled").agg(F.min("grade").alias("grade"))  # of several labels the worst
    picked = graded.orderBy(F.xxhash64("labelled", F.lit(23)), "labelled").limit(rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("labelled"))  # picked: at most FIT_ROWS rows of two numbers
    sample = sample.groupBy("labelled").agg(F.first("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text")).select("grade", "text")  # of several rows with an id one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in chunks(texts):
                owner, index = hashed_features(texts[lo:hi])
                at = np.searchsorted(owner, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(index.astype(np.int32)))], ["grade", "features"])

    found = sample.mapInArrow(run, "grade int, features array<int>").toArrow()
    model = CumulativeLink()
    if found.num_rows:
        features = found["features"].combine_chunks()
        sizes = np.diff(features.offsets.to_numpy())
        # the order of rows is not part of the sample
        by = np.lexsort((np.array([hash(tuple(x)) for x in features.to_pylist()]), sizes, found["grade"].to_numpy()))
        features = features.take(pa.array(by))
        model.fit(np.repeat(np.arange(len(features)), np.diff(features.offsets.to_numpy())), features.values.to_numpy().astype(np.int64), found["grade"].to_numpy()[by].astype(np.int64))
    return model


def classify(docs: DataFrame, model: CumulativeLink, select: float = SELECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, expected_grade, toxic and top-grade probability, and whether it is selected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in chunks(texts):
                owner, index = hashed_features(texts[lo:hi])
                p = model.probabilities(model.score(owner, index, hi - lo))
                top = p[:, -1]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p @ np.arange(model.grades)), pa.array(p[:, 0]), pa.array(top), pa.array(top >= select)], [id_col, "expected_grade", "toxic_prob", "top_prob", "selected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, expected_grade double, toxic_prob double, top_prob double, selected boolean")


def quality_classifier(docs: DataFrame, labels: DataFrame, select: float = SELECT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return classify(docs, fit_model(docs, labels, id_col=id_col, text_col=text_col), select, id_col, text_col)
