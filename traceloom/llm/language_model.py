"""Hashed maximum-entropy language model with a softmax factored by classes on two levels.

A token's probability is P(class | context) * P(subclass | class, context) * P(token | subclass).
The class follows from the token's last bytes, the subclass from its hash; the end of a
text is a class of its own.  Both conditional factors are softmaxes over hashed features
of the tokens before: the last one, the last two, and the second and third last alone
(skips); those of subclasses are taken together with the class.  So context tells words
apart down to one of CLASSES * CLASSES cells.  P(token | subclass) comes from smoothed
training counts; a cell has one slot for all unknown tokens, so probabilities sum to one.

Counts are summed per task, then over tasks, and stay a distributed table.  Training goes
in rounds over disjoint parts of the training texts: each task starts from the
current weights, makes gradient updates on its texts in batches, and gives back its
weights; they are averaged in slices, each feature weighted by how often a task met it,
so a feature that one task met keeps what that task learned, whatever the number of
tasks.  All sizes that reach the driver are fixed: weights, cells, and the ``COMMON``
most frequent tokens.

Scoring looks up frequent tokens in a broadcast table of fixed size.  All others leave
as distinct (text, token) rows, meet the count table in a join and return as sums.

Defined results
* null or empty text: the end token alone;
* null id: the text of the id is empty; repeated ids and rows: each row is scored;
* no training text: all tokens are unknown, N and V are 0;
* ties in frequency: the smaller hash is the more common token;
* empty table: no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.scratch import Scratch
from traceloom.llm.textcore import Words, chunks, mix, texts_of

#: Classes, and subclasses of a class; a power of two.
CLASSES = 32
END_CLASS = CLASSES - 1
BITS = 15
FEATURES = 4
ROUNDS = 2
BATCH = 4096
RATE = 0.15
#: Rows of a feature in a batch that are added one by one; longer runs are summed as a whole.
SHORT = 6
SMOOTH = 0.1
FOLDS = 10
#: Frequent tokens whose counts are broadcast.
COMMON = 1 << 18
#: Weight of a feature that a task has not met.
UNMET = 1e-6
#: Rows of weights in a slice when they are averaged.
SLICE = 2048
#: Tokens counted at once.
COUNT_TOKENS = 2_000_000

_U = np.uint64
END = _U(0xE17A1465B3D2F4C9)


def fold_of(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS for i in ids], dtype=np.int64)


class Tokens:
    """Tokens of some texts, each text's end included: hash, class, subclass, cell, text, and place in the text."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts)
        h, docs = w.hashes(), len(texts)
        tail = np.zeros(len(h), dtype=np.uint64)
        for k in range(3):
            at = w.end - 1 - k
            tail = tail * _U(257) + np.where(at >= w.start, w.buf[np.maximum(at, 0)], 0).astype(np.uint64)
        self.count = w.count + 1
        self.first = np.cumsum(self.count) - self.count
        n = len(h) + docs
        word = np.ones(n, dtype=bool)
        word[self.first + w.count] = False
        self.hash = np.full(n, END)
        self.hash[word] = h
        self.cls = np.full(n, END_CLASS, dtype=np.int64)
        self.cls[word] = (mix(tail) % _U(END_CLASS)).astype(np.int64)
        self.sub = np.zeros(n, dtype=np.int64)
        self.sub[word] = (mix(h + _U(0x5851F42D4C957F2D)) % _U(CLASSES)).astype(np.int64)
        self.cell = self.cls * CLASSES + self.sub
        self.doc = np.repeat(np.arange(docs), self.count)
        self.place = np.arange(n) - self.first[self.doc]

    def features(self, a: int, z: int, within: bool = False) -> np.ndarray:
        """Feature rows of tokens a to z; within a class, each taken together with the class."""
        at = np.arange(a, z)
        before = [np.where(self.place[a:z] >= k, self.hash[np.maximum(at - k, 0)], _U(k)) for k in (1, 2, 3)]
        keys = (before[0], before[0] * _U(0x9E3779B97F4A7C15) + before[1], before[1] ^ _U(0xABCDEF1234567891), before[2] ^ _U(0x1357924680ACE135))
        if within:
            cls = mix(self.cls[a:z].astype(_U) + _U(0x2545F4914F6CDD1D))
            keys = tuple(k + cls for k in keys)
        return np.stack([(mix(k + _U(j + 1)) >> _U(64 - BITS)).astype(np.int64) for j, k in enumerate(keys)])


class ClassModel:
    """Softmax over classes, or over the subclasses of each class; weights of hashed features, and a bias.

    Counts are of classes, or a row of subclasses for each class; ``group`` is then the class.
    """

    def __init__(self, class_counts: np.ndarray):
        self.weights = np.zeros((1 << BITS, CLASSES), dtype=np.float32)
        counts = np.atleast_2d(class_counts) + 1.0
        self.bias = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    def _scores(self, features: np.ndarray, group: np.ndarray | int = 0) -> np.ndarray:
        """Scores of the classes, the largest of each row taken off."""
        s = self.weights.take(features[0], axis=0)
        for f in features[1:]:
            s += self.weights.take(f, axis=0)
        s += self.bias[group] if isinstance(group, int) else self.bias.take(group, axis=0)
        top = s
        while top.shape[1] > 1:  # by halves, as rows are short
            half = top.shape[1] // 2
            top = np.maximum(top[:, :half], top[:, half:])
        s -= top
        return s

    def log_probabilities(self, features: np.ndarray, cls: np.ndarray, group: np.ndarray | int = 0) -> np.ndarray:
        """Natural logarithms of the probabilities of these classes."""
        s = self._scores(features, group)
        own = s[np.arange(len(cls)), cls].astype(np.float64)
        return own - np.log(np.exp(s, out=s) @ np.ones(CLASSES, dtype=np.float32))

    def update(self, features: np.ndarray, cls: np.ndarray, squares: np.ndarray, rate: float = RATE, group: np.ndarray | int = 0, met: np.ndarray | None = None) -> None:
        """One gradient step on a batch, with step sizes per feature from its squared gradients so far.

        ``met`` takes how often each feature was met.
        """
        g = self._scores(features, group)
        np.exp(g, out=g)
        g /= (g @ np.ones(CLASSES, dtype=np.float32))[:, None]
        g[np.arange(len(cls)), cls] -= 1
        for f in features:
            order = np.argsort(f.astype(np.uint16), kind="stable")  # by radix
            by = f[order]
            at = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
            times = np.diff(np.append(at, len(by)))
            # longest runs first, so that the runs with a k-th row are the first ones
            longest = np.argsort((SHORT + 1 - np.minimum(times, SHORT + 1)).astype(np.uint16), kind="stable")
            at, times = at[longest], times[longest]
            rows = by[at]
            sums = g.take(order[at], axis=0)
            many = np.count_nonzero(times > SHORT)
            for k in range(1, SHORT):
                few = np.count_nonzero(times > k)
                sums[many:few] += g.take(order[at[many:few] + k], axis=0)
            if many:
                n = times[:many]
                first = np.cumsum(n) - n
                member = np.repeat(at[:many] - first, n) + np.arange(n.sum())
                sums[:many] = np.add.reduceat(g.take(order[member], axis=0), first, axis=0)
            if met is not None:
                met[rows] += times
            squares[rows] += np.einsum("ij,ij->i", sums, sums) / CLASSES
            sums *= (rate / np.sqrt(squares[rows] + 1e-6))[:, None]
            self.weights[rows] = self.weights.take(rows, axis=0) - sums


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Training tokens: hash, cell, count."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, cell = (np.concatenate(x) for x in zip(*held, strict=True))
        u, at, n = np.unique(h, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(cell[at].astype(np.int32)), pa.array(n.astype(np.int64))], ["token", "cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            learn = fold_of(b.column(0).to_pylist()) != 0
            texts = texts_of(b.column(1).filter(pa.array(learn)))
            for lo, hi in chunks(texts):
                t = Tokens(texts[lo:hi])
                held.append((t.hash, t.cell.astype(np.int16)))
                if sum(len(h) for h, _ in held) >= COUNT_TOKENS:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    counted = docs.select(id_col, text_col).mapInArrow(run, "token long, cell int, n long")
    return counted.groupBy("token").agg(F.min("cell").alias("cell"), F.sum("n").alias("n"))


class Levels:
    """The model of classes and that of subclasses within them."""

    def __init__(self, cell_counts: np.ndarray):
        self.models = (ClassModel(cell_counts.sum(axis=1)), ClassModel(cell_counts))

    def log_probabilities(self, t: Tokens, a: int, z: int) -> np.ndarray:
        """Natural logarithms of the probabilities of the cells of tokens a to z."""
        top, low = self.models
        out = top.log_probabilities(t.features(a, z), t.cls[a:z])
        words = np.flatnonzero(t.cls[a:z] != END_CLASS)
        out[words] += low.log_probabilities(t.features(a, z, within=True)[:, words], t.sub[a:z][words], t.cls[a:z][words])
        return out

    def update(self, t: Tokens, a: int, z: int, squares: np.ndarray, met: np.ndarray) -> None:
        """One gradient step of both models on tokens a to z."""
        top, low = self.models
        top.update(t.features(a, z), t.cls[a:z], squares[0], met=met[0])
        words = np.flatnonzero(t.cls[a:z] != END_CLASS)
        if len(words):
            low.update(t.features(a, z, within=True)[:, words], t.sub[a:z][words], squares[1], group=t.cls[a:z][words], met=met[1])


def trained(docs: DataFrame, cell_counts: np.ndarray, id_col: str, text_col: str, rounds: int = ROUNDS) -> Levels:
    """Both models after rounds of gradient updates on disjoint parts of the training texts."""
    levels = Levels(cell_counts)
    spark = docs.sparkSession
    per_level = (1 << BITS) // SLICE
    slices = 2 * per_level
    kind, names = "part int, met binary, weights binary", ["part", "met", "weights"]

    def rows(parts: list[int], met: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
        met_bytes = [m.astype(np.float32).tobytes() for m in met]
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(met_bytes, pa.binary()), pa.array([w.astype(np.float16).tobytes() for w in weights], pa.binary())], names)

    for r in range(rounds):
        held = spark.sparkContext.broadcast(levels)

        def run(batches: Iterator[pa.RecordBatch], held=held, r=r) -> Iterator[pa.RecordBatch]:
            own = Levels(cell_counts)
            for mine, start in zip(own.models, held.value.models, strict=True):
                mine.weights = start.weights.copy()
            squares = np.full((2, 1 << BITS), 1.0, dtype=np.float32)
            met = np.full((2, 1 << BITS), UNMET)
            seen = False
            for b in batches:
                fold = fold_of(b.column(0).to_pylist())
                texts = texts_of(b.column(1).filter(pa.array((fold != 0) & (fold % rounds == r))))
                for lo, hi in chunks(texts):
                    t = Tokens(texts[lo:hi])
                    for a in range(0, len(t.hash), BATCH):
                        own.update(t, a, min(a + BATCH, len(t.hash)), squares, met)
                    seen = True
            if seen:
                at = [(k, s) for k in range(2) for s in range(0, 1 << BITS, SLICE)]
                yield rows([k * per_level + s // SLICE for k, s in at], [met[k, s : s + SLICE] for k, s in at], [own.models[k].weights[s : s + SLICE] for k, s in at])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Means by slice of what a task has read, each feature weighted by how often it was met."""
            sums: dict[int, list] = {}
            for b in batches:
                for part, n, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    at = sums.setdefault(part, [np.zeros(SLICE), np.zeros((SLICE, CLASSES))])
                    n = np.frombuffer(n, dtype=np.float32).astype(np.float64)
                    at[0] += n
                    at[1] += n[:, None] * np.frombuffer(w, dtype=np.float16).reshape(SLICE, CLASSES)
            if sums:
                yield rows(list(sums), [n for n, _ in sums.values()], [s / n[:, None] for n, s in sums.values()])

        made = docs.select(id_col, text_col).mapInArrow(run, kind)
        # two levels, so that no task reads what all others give back
        groups = max(1, docs.rdd.getNumPartitions() // 32)
        made = made.withColumn("grp", F.expr(f"pmod(spark_partition_id(), {groups})")).repartition(slices * groups, "part", "grp").drop("grp").mapInArrow(average, kind)
        made = made.repartition(slices, "part").mapInArrow(average, kind).toArrow()
        levels = Levels(cell_counts)
        for part, w in zip(made["part"].to_pylist(), made["weights"].to_pylist(), strict=True):
            k, s = divmod(part, per_level)
            levels.models[k].weights[s * SLICE : (s + 1) * SLICE] = np.frombuffer(w, dtype=np.float16).reshape(SLICE, CLASSES)
        held.unpersist()
    return levels


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON, rounds: int = ROUNDS) -> DataFrame:
    """Each row's id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    counts = scratch.keep(token_counts(docs, id_col, text_col))
    by_cell = counts.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()  # CLASSES * CLASSES rows
    total, kinds = np.zeros(CLASSES * CLASSES), np.zeros(CLASSES * CLASSES)
    for row in by_cell:
        total[row["cell"]], kinds[row["cell"]] = row["n"], row["kinds"]
    n_all, v_all = int(total.sum()), int(kinds.sum())
    levels = trained(docs, total.reshape(CLASSES, CLASSES), id_col, text_col, rounds)
    frequent = counts.orderBy(F.desc("n"), "token").limit(common).select("token", "n").toArrow()  # at most COMMON rows of two numbers
    tokens = frequent["token"].to_numpy().view(np.uint64) if frequent.num_rows else np.zeros(0, dtype=np.uint64)
    order = np.argsort(tokens)
    tokens, times = tokens[order], frequent["n"].to_numpy()[order] if frequent.num_rows else np.zeros(0, dtype=np.int64)
    base_all = n_all + SMOOTH * (v_all + 1)
    in_cell = total + SMOOTH * (kinds + 1)
    held = spark.sparkContext.broadcast((levels, tokens, times, in_cell))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, tokens, times, in_cell = held.value
        for b in batches:
            texts = texts_of(b.column(2))
            folds = fold_of(b.column(1).to_pylist())
            for lo, hi in chunks(texts):
                t, docs_here = Tokens(texts[lo:hi]), hi - lo
                score = np.empty(len(t.hash))
                for a in range(0, len(t.hash), BATCH):
                    z = min(a + BATCH, len(t.hash))
                    score[a:z] = levels.log_probabilities(t, a, z)
                score /= np.log(10)
                at = np.searchsorted(tokens, t.hash)
                at[at == len(tokens)] = 0
                met = tokens[at] == t.hash if len(tokens) else np.zeros(len(t.hash), dtype=bool)
                known, base = np.zeros(len(t.hash), dtype=np.int64), np.zeros(len(t.hash))
                if met.any():
                    c = times[at[met]] + SMOOTH
                    known[met], base[met] = 1, np.log10(c / base_all)
                    score[met] += np.log10(c / in_cell[t.cell[met]])
                sums = [np.bincount(t.doc, weights=x, minlength=docs_here) for x in (known, base, score)]
                # the rest: distinct tokens of each text, with their number
                rest = np.flatnonzero(~met)
                by = rest[np.lexsort((t.hash[rest], t.doc[rest]))]
                new = np.ones(len(by), dtype=bool)
                new[1:] = (t.hash[by][1:] != t.hash[by][:-1]) | (t.doc[by][1:] != t.doc[by][:-1])
                first = np.flatnonzero(new)
                offsets = np.searchsorted(t.doc[by][first], np.arange(docs_here + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(t.hash[by][first].view(np.int64)), pa.array(t.cell[by][first].astype(np.int32)), pa.array(np.diff(np.append(first, len(by))).astype(np.int32))], ["token", "cell", "m"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, docs_here), b.column(1).slice(lo, docs_here), pa.array(folds[lo:hi] == 0), pa.array(t.count.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(pa.array(offsets), rows)],
                    ["rid", id_col, "held_out", "n_tokens", "known", "base", "model", "rest"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), id_col, text_col)
    rows = scratch.keep(rows.mapInArrow(run, f"rid long, `{id_col}` {kind}, held_out boolean, n_tokens long, known long, base double, model double, rest array<struct<token:long,cell:int,m:int>>"))
    rest = rows.select("rid", F.inline("rest")).join(counts.select("token", "n"), "token", "left")
    c = F.coalesce("n", F.lit(0)) + F.lit(SMOOTH)
    slots = F.array(*(F.lit(float(x)) for x in in_cell))
    rest = rest.groupBy("rid").agg(F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("known2"), F.sum(F.col("m") * F.log10(c / F.lit(base_all))).alias("base2"), F.sum(F.col("m") * F.log10(c / F.element_at(slots, F.col("cell") + 1))).alias("model2"))
    out = rows.drop("rest").join(rest, "rid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(id_col, "held_out", "n_tokens", plus("known", "known2").cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), plus("base", "base2").alias("base_score"), plus("model", "model2").alias("score"))
