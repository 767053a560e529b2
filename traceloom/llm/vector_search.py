"""Largest inner products by a forest of random-projection trees.

Inner products become distances by one more component, which makes all vectors equally
long.  Trees are fitted on a bounded sample: a node splits at the median along the
difference of two random rows, of several tries the one with the largest spread.  All
rows are indexed: each is in one leaf of each tree.

A query opens leaves of all trees through one priority queue, nearest split first.
How many is calibrated against brute force within the sample, so that the recall
reaches ``RECALL``; a larger table has denser leaves, and the same number finds no less.
Leaves are dealt to buckets.  A query goes to a bucket once, with the leaves that it
opens there, and is compared with their rows by matrix products; the scores returned
are computed on the original vectors, in double precision.

Equal vectors are one point with its smallest ids; of them, more than k + 1 can never
be among the k nearest.

Defined results
* vectors null, zero, or with null or non-finite components take no part, nor do rows
  without id or of another length than most vectors;
* of rows with one id the one with the smallest vector takes part;
* ties go to the smaller id; fewer than k candidates: all of them;
* empty table or no query: no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.scratch import Scratch

TREES = 4
#: Rows in the sample that trees are fitted on, at most.
FIT_ROWS = 16384
#: Rows in a leaf, on average, as far as the sample allows; and of the sample at least.
LEAF_ROWS = 512
LEAF_SAMPLE = 16
TRIES = 8
RECALL = 0.95
CALIBRATION_QUERIES = 256
#: Points in a bucket, on average, and queries in a block that meets it.
BUCKET_ROWS = 16384
QUERY_ROWS = 16384


class Forest:
    """Split planes as rows of one matrix; a child is a node, or a leaf as its complement."""

    def __init__(self, sample: np.ndarray, trees: int, leaves: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        planes, cuts, children = [], [], []
        self.roots, self.leaves = [], 0
        least = max(1, len(sample) // max(1, leaves))

        def grow(part: np.ndarray) -> int:
            spread = None
            if len(part) > least:
                for _ in range(TRIES):
                    a, b = sample[rng.choice(part, 2, replace=False)]
                    plane = a - b
                    size = np.linalg.norm(plane)
                    if size > 0:
                        along = sample[part] @ (plane / size)
                        if spread is None or along.std() > spread[0]:
                            spread = (along.std(), plane / size, along)
            if spread is None or not (spread[2] <= np.median(spread[2])).any() or (spread[2] <= np.median(spread[2])).all():
                self.leaves += 1
                return ~(self.leaves - 1)
            _, plane, along = spread
            at, cut = len(planes), float(np.median(along))
            planes.append(plane)
            cuts.append(cut)
            children.append([0, 0])
            children[at] = [grow(part[along <= cut]), grow(part[along > cut])]
            return at

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(sample))))
        self.planes, self.cuts = np.array(planes).reshape(len(planes), sample.shape[1]), np.array(cuts)
        self.children = np.array(children, dtype=np.int64).reshape(-1, 2)

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Each row's leaf in each tree."""
        out = np.empty((len(x), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            live = np.flatnonzero(at >= 0)
            while len(live):
                node = at[live]
                right = np.einsum("ij,ij->i", x[live], self.planes[node]) > self.cuts[node]
                at[live] = self.children[node, right.astype(np.int64)]
                live = live[at[live] >= 0]
            out[:, t] = ~at
        return out

    def search(self, x: np.ndarray, probes: int) -> Iterator[list[int]]:
        """For each query the leaves that it opens, nearest first."""
        sides = (x @ self.planes.T - self.cuts).tolist() if len(self.planes) else [[]] * len(x)
        children = self.children.tolist()
        for side in sides:
            queue, opened = [(0.0, k, root) for k, root in enumerate(self.roots)], []
            heapq.heapify(queue)
            made = len(queue)
            while queue and len(opened) < probes:
                far, _, at = heapq.heappop(queue)
                while at >= 0:
                    d = side[at]
                    near, other = (children[at][1], children[at][0]) if d > 0 else (children[at][0], children[at][1])
                    made += 1
                    heapq.heappush(queue, (max(far, abs(d)), made, other))
                    at = near
                opened.append(~at)
            yield opened


def calibrated(forest: Forest, sample: np.ndarray, original: np.ndarray, queries: int, k: int, recall: float) -> int:
    """The fewest leaves to open for this recall, measured on queries from the sample."""
    picked = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(np.int64)
    scores = original[picked] @ original.T
    scores[np.arange(len(picked)), picked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return forest.leaves
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    where = forest.leaves_of(sample)
    ranks = []
    plain = np.column_stack([original[picked], np.zeros(len(picked))])
    for row, opened in zip(best, forest.search(plain, forest.leaves), strict=True):
        place = np.full(forest.leaves, forest.leaves)
        place[opened] = np.arange(len(opened))
        ranks.append(place[where[row]].min(axis=1))
    found = np.sort(np.concatenate(ranks))
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))) - 1)]) + 1


def _sound(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(owner: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each owner, best first."""
    order = np.lexsort((ident, -score, owner))
    o = owner[order]
    at = np.arange(len(o)) - np.searchsorted(o, o)
    return order[at < k]


def scored_leaves(points: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """Best k points for each query among the leaves that it opens in one bucket."""
    p, q = _matrix(points["vec"]), _matrix(queries["qvec"])
    uid, leaf = points["uid"].to_numpy(), points["leaf"].to_numpy()
    order = np.argsort(leaf, kind="stable")
    p, uid, leaf = p[order], uid[order], leaf[order]
    names, starts = np.unique(leaf, return_index=True)
    ends = np.append(starts[1:], len(leaf))
    lists = queries["leaves"].combine_chunks() if isinstance(queries["leaves"], pa.ChunkedArray) else queries["leaves"]
    asked = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
    wanted = lists.flatten().to_numpy()
    by = np.argsort(wanted, kind="stable")
    asked, wanted = asked[by], wanted[by]
    held = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for name, a, z in zip(names, starts, ends, strict=True):
        rows = asked[np.searchsorted(wanted, name) : np.searchsorted(wanted, name, side="right")]
        for lo in range(0, len(rows), 512):
            part = rows[lo : lo + 512]
            s = q[part] @ p[a:z].T
            n = min(k, z - a)
            # some more than k, as equal scores may differ in their last bits here
            n = min(z - a, n + 8)
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            held.append((np.repeat(part, n), a + top.ravel()))
    owner, at = (np.concatenate([h[i] for h in held]) for i in range(2))
    both = np.unique(owner * (len(p) + 1) + at)
    owner, at = both // (len(p) + 1), both % (len(p) + 1)
    score = np.concatenate([np.einsum("ij,ij->i", q[owner[i : i + 65536]], p[at[i : i + 65536]]) for i in range(0, len(owner), 65536)] or [np.zeros(0)])
    # a point may be in several leaves of the bucket
    new = np.unique(np.stack([owner, uid[at]], axis=1), axis=0, return_index=True)[1] if len(owner) else np.zeros(0, dtype=np.int64)
    owner, at, score = owner[new], at[new], score[new]
    best = _best(owner, score, uid[at], k)
    return pa.table({"query_id": queries["query_id"].combine_chunks().take(pa.array(owner[best])), "uid": pa.array(uid[at[best]], pa.int64()), "score": pa.array(score[best])})


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The k nearest rows of each query row: query_id, rank, id and score.  queries: which rows ask, by their ids."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    ident, vec = F.col(f"`{id_col}`").cast("long"), F.col(f"`{vector_col}`")
    rows = vectors.where(ident.isNotNull() & _sound(vec)).select(ident.alias("id"), vec.cast("array<double>").alias("vec"), queries.alias("asks"))
    rows = scratch.keep(rows.groupBy("id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks")))
    sizes = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = sizes["size"] if sizes else 1
    rows = rows.where(F.size("vec") == size)
    few = Window.partitionBy("vec").orderBy("id")
    points = rows.select("vec", "id", F.row_number().over(few).alias("nth")).where(f"nth <= {k + 1}")
    points = scratch.keep(points.groupBy("vec").agg(F.min("id").alias("uid"), F.sort_array(F.collect_list("id")).alias("ids")))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    facts = points.agg(F.count("*").alias("n"), F.max(square).alias("longest")).first()
    n, longest = facts["n"], facts["longest"] or 0.0
    sample = _matrix(points.orderBy(F.xxhash64("uid"), "uid").limit(fit_rows).select("vec").toArrow()["vec"])
    if not len(sample):
        sample = np.zeros((1, size))

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0.0))])

    leaves = min(max(1, n // leaf_rows), max(1, len(sample) // LEAF_SAMPLE))
    forest = Forest(lifted(sample), trees if leaves > 1 else 1, leaves)
    probes = calibrated(forest, lifted(sample), sample, CALIBRATION_QUERIES, k, recall)
    held = spark.sparkContext.broadcast((forest, probes))  # at most FIT_ROWS / LEAF_SAMPLE planes a tree
    buckets = min(forest.leaves, max(1, -(-n * len(forest.roots) // BUCKET_ROWS)))
    asked = rows.where("asks").count()
    blocks = max(1, -(-asked * min(probes, buckets) // (buckets * QUERY_ROWS)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, _ = held.value
        for b in batches:
            at = forest.leaves_of(lifted(_matrix(b.column(1)))) if len(b) else np.zeros((0, 1), dtype=np.int64)
            for t in range(at.shape[1]):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at[:, t]), pa.array(at[:, t] % buckets)], ["uid", "vec", "leaf", "bucket"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, probes = held.value
        for b in batches:
            x = _matrix(b.column(1))
            row, bucket, opened = [], [], []
            for i, found in enumerate(forest.search(np.column_stack([x, np.zeros(len(x))]), probes) if len(b) else ()):
                found = np.array(found)
                to = found % buckets
                for g in np.unique(to):
                    row.append(i)
                    bucket.append(int(g))
                    opened.append(found[to == g])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), b.column(1).take(pa.array(row, pa.int64())), pa.array(bucket, pa.int64()), pa.array(opened, pa.list_(pa.int64()))], ["query_id", "qvec", "qbucket", "leaves"])

    indexed = points.select("uid", "vec").mapInArrow(index, "uid long, vec array<double>, leaf long, bucket long").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    wanted = rows.where("asks").select("id", "vec").mapInArrow(ask, "query_id long, qvec array<double>, qbucket long, leaves array<long>").withColumn("qblock", F.expr(f"cast(pmod(xxhash64(query_id), {blocks}) as int)"))
    found = indexed.groupBy("bucket", "block").cogroup(wanted.groupBy("qbucket", "qblock")).applyInArrow(lambda p, q: scored_leaves(p, q, k + 1), "query_id long, uid long, score double")
    near = found.groupBy("query_id", "uid").agg(F.max("score").alias("score"))
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "uid"))).where(f"nth <= {k + 1}")
    near = near.join(points.select("uid", "ids"), "uid").select("query_id", F.explode("ids").alias("vec"), "score").where("vec != query_id")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec"))).where(f"rank <= {k}")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias(id_col), "score")
