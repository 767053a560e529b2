"""Exact Jaccard self-join of documents on word shingles, by a grouped prefix join.

1. A first pass finds shingles that a task meets in more than one of ``HEAVY``
   documents.  They are marked in a bitmap of fixed size, by hash bits.  All shingles
   get one global order: unmarked before marked, then by hash.
2. A document's set is named by a 128-bit hash; equal sets are one node.  Its prefix is
   its first M + K shingles in the order.  M is the largest number of its shingles that a
   linked set can lack, so linked sets share K shingles of their prefixes: of the two
   prefixes, take the one that ends first; at most M of its shingles are missing in the
   other set, and those not missing lie within the other's prefix.
3. Nodes with the same prefix and size are one group.  Group prefixes meet in shingles.
   Each shingle is counted with the size classes of its holders.  Shingles leave that no group
   of about the same size has too, then groups with fewer than K.
   The first shingle that linked prefixes share is among the first M + 1 of either.
4. Each shingle's groups are compared with one pivot of them only, a number that does not
   grow with the square of a group.  This connects most of what is linked.
5. Then all pairs of groups that may link and are not connected yet.  A pair is made at its
   first common shingle, if the sizes, the shingles left after their places, and the exact
   lower bound that parity sketches give for the symmetric difference allow a link.
6. Groups are expanded into member pairs, and each pair is verified on its whole texts.
   Pairs near each other are dealt together, large groups of them cut into blocks, so a
   text is sent once for each block pair that needs it and no task gets a whole group.
   Only texts of such pairs are moved at all.

Defined results
* null or empty text, or no word: no shingles, linked with nothing;
* fewer words than a shingle takes: the whole word sequence is the one shingle;
* repeated rows and ids: every row is kept, rows with equal sets are linked;
* null id: the row is kept; it never names a component that has another id;
* empty table: no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.components import connected_components
from traceloom.llm.scratch import Scratch, sieve
from traceloom.llm.textcore import Words, chunks, distinct_by_owner, mix, shingles, texts_of

#: A shingle in more than one of so many documents of a task is put last.
HEAVY = 1000
HEAVY_BITS = 22
#: Shingles that linked prefixes share, where sets are large enough.
SHARED = 8
SKETCH_WORDS = 8
#: Nodes of a block in verification, and texts in a task's bucket, on average.
BLOCK = 256
#: First shingles of a group by which a pair is known to have been made before.
HEAD = 6

_U = np.uint64
_SKETCH = [f"k{i}" for i in range(SKETCH_WORDS)]


def _sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and hash of each distinct shingle, and the set sizes."""
    values, made = shingles(Words(texts), k)
    owner, value = distinct_by_owner(np.repeat(np.arange(len(texts)), made), values)
    return owner, value, np.bincount(owner, minlength=len(texts))


def _set_names(value: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """128-bit names of the sets; an empty set has none."""
    out: list[bytes | None] = [None] * len(sizes)
    full = np.flatnonzero(sizes)
    if len(full):
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        both = np.empty((len(full), 2), dtype=np.uint64)
        for j, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            both[:, j] = mix(np.add.reduceat(mix(value ^ _U(salt)), at) + sizes[full].astype(np.uint64))
        for i, name in zip(full, both, strict=True):
            out[i] = name.tobytes()
    return out


def heavy_shingles(docs: DataFrame, k: int, text_col: str) -> np.ndarray:
    """A bitmap over hash buckets with the shingles that are common in some task's documents."""
    width = 1 << HEAVY_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs_seen = np.zeros(width, dtype=np.uint32), 0
        for b in batches:
            texts = texts_of(b.column(0))
            docs_seen += len(texts)
            for lo, hi in chunks(texts):
                _, value, _ = _sets(texts[lo:hi], k)
                bucket, times = np.unique(value & _U(width - 1), return_counts=True)
                seen[bucket.astype(np.int64)] += times.astype(np.uint32)
        found = np.flatnonzero(seen > max(8, docs_seen // HEAVY))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], ["bucket"])

    rows = docs.select(text_col).mapInArrow(run, "bucket int").distinct()
    marks = np.zeros(width // 8, dtype=np.uint8)
    packed = rows.groupBy(F.expr("bucket div 8").cast("int").alias("byte")).agg(F.sum(F.expr("shiftleft(1, bucket % 8)")).cast("int").alias("bits"))
    table = packed.toArrow()  # at most 2**19 rows
    marks[table["byte"].to_numpy()] = table["bits"].to_numpy().astype(np.uint8)
    return marks


def most_missing(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles of a set of this size that a linked set can lack."""
    return sizes - -(-sizes * num // den)


def features(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, marks: np.ndarray) -> DataFrame:
    """A row per document: mark of the text, set name and size, the group's name, prefix, and sketch."""
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            texts = texts_of(b.column(1))
            for lo, hi in chunks(texts):
                part = texts[lo:hi]
                owner, value, n = _sets(part, k)
                names = _set_names(value, n)
                bucket = value & _U((1 << HEAVY_BITS) - 1)
                last = (bits[(bucket >> _U(3)).astype(np.int64)] >> (bucket & _U(7)).astype(np.uint8)) & 1
                order = np.lexsort((value, last, owner))
                missing = most_missing(n, num, den)
                shared = np.minimum(SHARED, n - missing)
                wanted = missing + shared
                at = np.concatenate([[0], np.cumsum(n)[:-1]])
                to = np.concatenate([[0], np.cumsum(wanted)])
                pick = order[np.repeat(at - to[:-1], wanted) + np.arange(to[-1])]
                prefix = value[pick]
                groups: list[int | None] = [None] * len(part)
                full = np.flatnonzero(n)
                if len(full):
                    sums = np.add.reduceat(mix(prefix ^ _U(0x2545F4914F6CDD1D)), to[:-1][full])
                    for i, g in zip(full, mix(sums + n[full].astype(np.uint64)).view(np.int64).tolist(), strict=True):
                        groups[i] = g
                parity = np.bincount(owner * (64 * SKETCH_WORDS) + (value >> _U(64 - 6 - (SKETCH_WORDS - 1).bit_length())).astype(np.int64), minlength=len(part) * 64 * SKETCH_WORDS) & 1
                sketch = np.packbits(parity.astype(np.uint8).reshape(len(part), -1), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(names, pa.binary()), pa.array(n.astype(np.int32)), pa.array(shared.astype(np.int32)), pa.array(groups, pa.int64()), pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(prefix.view(np.int64))), *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(SKETCH_WORDS))],
                    ["id", "mark", "node", "n", "shared", "grp", "prefix", *_SKETCH],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, mark long, node binary, n int, shared int, grp long, prefix array<long>, " + ", ".join(f"{c} long" for c in _SKETCH)
    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, schema)


def _least_common(a: str, b: str, num: int, den: int):
    """Shingles that two linked rows have in common at least."""
    return F.expr(f"(({a}.n + {b}.n) * {num}L + {num + den - 1}L) div {num + den}L")


def _may_link(a: str, b: str, num: int, den: int):
    """Whether sizes and sketches of two rows leave room for a link; a row without sketch passes."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    both = (na + nb).cast("long")
    differing = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _SKETCH[1:]), F.bit_count(F.col(f"{a}.k0").bitwiseXOR(F.col(f"{b}.k0"))))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & F.coalesce(differing <= both - 2 * _least_common(a, b, num, den), F.lit(True))


class Candidates:
    """Groups of nodes that share enough prefix shingles with others, and those shingles.

    groups: grp, n, shared, tokens (place in the order and shingle, of those met in other groups), sketch of a single member.
    members: grp, node, n, sketch, of these groups and of all with several nodes.
    """

    def __init__(self, rows: DataFrame, nodes: DataFrame, num: int, den: int, scratch: Scratch):
        self.num, self.den, self.scratch = num, den, scratch
        # sizes that may link are of one class or of two neighbouring ones; a token's classes are kept as bits
        size = F.floor(F.log("n") / (math.log(den / num) * (1 + 1e-9))) if num < den else F.col("n").cast("long")
        bit = lambda d: F.expr(f"shiftleft(1L, cast(pmod(size + {d}, 64) as int))")
        once = sieve(rows.where("node is not null").select("row", "grp", "n", "prefix"), nodes.select("row"), "row")  # copies that pass only let more tokens through
        placed = once.select("grp", size.alias("size"), F.posexplode("prefix").alias("pos", "token"))
        several = scratch.keep(placed.groupBy("token").agg(F.count("*").alias("times"), F.bit_or(bit(0)).alias("sizes")).where("times > 1"))
        placed = sieve(placed, several, "token").join(several, "token")
        near = (F.col("times") > F.bit_count("sizes")) | (F.col("sizes").bitwiseAND(bit(1).bitwiseOR(bit(-1))) != 0)
        met = placed.where(near).groupBy("grp").agg(F.sort_array(F.collect_set(F.struct("pos", "token"))).alias("tokens"))
        one = lambda c: F.when(F.count("*") == 1, F.min(c)).alias(c)
        groups = nodes.groupBy("grp").agg(F.count("*").alias("members"), F.min("n").alias("n"), F.min("shared").alias("shared"), *map(one, _SKETCH))
        groups = groups.join(met, "grp", "left").withColumn("enough", F.coalesce(F.size("tokens") >= F.col("shared"), F.lit(False)))
        groups = scratch.keep(groups.where("enough or members > 1"))
        self.groups = groups.where("enough").drop("enough", "members")
        scratch.drop(scratch.n - 1)  # several, which nothing reads from here on
        self.members = scratch.keep(nodes.select("grp", "node", "n", *_SKETCH).join(groups.select("grp"), "grp"))

    def _rows(self, groups: DataFrame, *columns: str) -> DataFrame:
        """A row per group and shingle that may be the first one shared with a linked group."""
        rows = groups.select("grp", "n", *columns, F.size("tokens").alias("hits"), F.transform(F.slice("tokens", 1, HEAD), lambda x: x["token"]).alias("head"), F.posexplode("tokens").alias("i", "t"))
        return rows.select("grp", "n", "hits", *columns, "t.pos", "t.token", F.slice("head", 1, F.least("i", F.lit(HEAD))).alias("before")).where(F.expr(f"pos <= n - (n * {self.num}L + {self.den - 1}L) div {self.den}L"))

    def _sides(self, pairs: DataFrame, *columns) -> DataFrame:
        """The pairs (ga, gb) with these columns of both groups, as x and y."""
        side = lambda g, c: self.groups.select(F.col("grp").alias(g), F.struct(*columns).alias(c))
        return pairs.join(side("ga", "x"), "ga").join(side("gb", "y"), "gb")

    def _may_meet(self, pairs: DataFrame) -> DataFrame:
        """The pairs of groups whose prefixes have as many shingles in common as linked ones have."""
        both = self._sides(pairs, "shared", F.transform("tokens", lambda x: x["token"]).alias("tokens"))
        return both.where(F.size(F.array_intersect("x.tokens", "y.tokens")) >= F.least("x.shared", "y.shared")).select("ga", "gb")

    def pivots(self) -> DataFrame:
        """Pairs of nodes: of each group and one group of each of its shingles, and of each node and one of its group.

        The pivot is the group that shares most shingles with others, an unchanged copy rather than an edited one.
        """
        rows = self._rows(self.groups).select("token", "grp", "hits", "n")
        pivot = rows.groupBy("token").agg(F.max(F.struct("hits", "grp", "n")).alias("p"))
        met = rows.join(pivot, "token").where((F.col("grp") != F.col("p.grp")) & (F.least("n", "p.n") * F.lit(self.den) >= F.greatest("n", "p.n") * F.lit(self.num)))
        pairs = self._sides(met.select(F.least("grp", "p.grp").alias("ga"), F.greatest("grp", "p.grp").alias("gb")).distinct(), "n", *_SKETCH)
        pairs = self._may_meet(pairs.where(_may_link("x", "y", self.num, self.den)).select("ga", "gb"))
        head = self.members.groupBy("grp").agg(F.min(F.struct("node", "n", *_SKETCH)).alias("h"))
        across = pairs.join(head.select(F.col("grp").alias("ga"), F.col("h.node").alias("a")), "ga").join(head.select(F.col("grp").alias("gb"), F.col("h.node").alias("b")), "gb").select("a", "b")
        within = self.members.alias("x").join(head.select("grp", F.col("h").alias("y")), "grp").where(F.col("x.node") != F.col("y.node")).where(_may_link("x", "y", self.num, self.den))
        both = across.unionByName(within.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def across(self, parts: DataFrame) -> DataFrame:
        """All pairs of nodes that may link and are not in one component yet.  parts: node, component.

        If a pair of groups has a common shingle that stands before this one in both heads, it
        is made there.  At its first common shingle, what follows must hold all that linked sets share.
        """
        num, den = self.num, self.den
        members = self.scratch.keep(self.members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")))
        # a group stands for its members' component, if it is one
        of = members.groupBy("grp").agg(F.min("component").alias("component"), F.max("component").alias("other"), F.min("node").alias("first"), F.max("node").alias("last"))
        of = self.scratch.keep(of.select("grp", F.xxhash64("component").alias("part"), (F.col("component") == F.col("other")).alias("sure"), (F.col("first") == F.col("last")).alias("single")))
        rows = self._rows(self.groups.join(of, "grp"), "part", "sure", "single", *_SKETCH).drop("hits")
        mixed = rows.groupBy("token").agg(F.min("part").alias("one"), F.max("part").alias("other"), F.bool_and("sure").alias("all"), F.count_if(F.col("single")).alias("times"), F.bool_and("single").alias("singles")).where("one != other and (times > 2 or not singles) or not all").select("token", "other", "all")  # of two single nodes one was the other's pivot
        mixed = self.scratch.keep(mixed)
        rows = sieve(rows.drop("single"), mixed, "token")
        # a pair goes from the smaller component to the larger, so a token's largest starts none
        starts = rows.join(mixed, "token").where("part < other or not all").drop("other", "all")
        x, y = starts.alias("x"), rows.alias("y")
        up = (F.col("x.part") < F.col("y.part")) | ((F.col("x.part") == F.col("y.part")) & (F.col("x.grp") < F.col("y.grp")))
        apart = (F.col("x.part") != F.col("y.part")) | ~F.col("x.sure") | ~F.col("y.sure")
        after = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= _least_common("x", "y", num, den)
        new = ~F.arrays_overlap("x.before", "y.before")
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & up & apart & after & _may_link("x", "y", num, den) & new)
        pairs = self._may_meet(pairs.select(F.col("x.grp").alias("ga"), F.col("y.grp").alias("gb")).distinct())
        a, b = members.alias("a"), members.alias("b")
        may = (F.col("a.component") != F.col("b.component")) & _may_link("a", "b", num, den)
        between = pairs.join(a, F.col("ga") == F.col("a.grp")).join(b, (F.col("gb") == F.col("b.grp")) & may)
        several = members.join(of.where("not sure").select("grp"), "grp", "left_semi")
        c, d = several.alias("a"), several.alias("b")
        within = c.join(d, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.node") < F.col("b.node")) & may)
        return between.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).unionByName(within.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))).distinct()


class Texts:
    """Texts of nodes, read again from the documents when they are needed."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, text_col: str):
        self.docs = docs.select(F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")).where("text is not null")
        self.nodes = nodes.select("node", "mark")

    def of(self, needed: DataFrame) -> DataFrame:
        """needed (node and more) with the text of each row's node."""
        wanted = self.nodes.join(needed, "node")
        texts = sieve(self.docs, wanted, "mark").join(wanted.select("mark").distinct(), "mark", "left_semi").groupBy("mark").agg(F.min("text").alias("text"))
        return wanted.join(texts, "mark").drop("mark")


def _named_sets(texts: list[bytes], k: int) -> dict[bytes, np.ndarray]:
    of: dict[bytes, np.ndarray] = {}
    for lo, hi in chunks(texts):
        _, value, n = _sets(texts[lo:hi], k)
        ends = np.cumsum(n)
        for i, name in enumerate(_set_names(value, n)):
            if name is not None and name not in of:
                of[name] = value[ends[i] - n[i] : ends[i]].copy()
    return of


def _links(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(s, t, assume_unique=True))
    return den * common >= num * (len(s) + len(t) - common)


def verified(pairs: DataFrame, texts: Texts, k: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs whose sets, made from whole texts, reach the similarity."""
    pairs = scratch.keep(pairs)
    scratch.free()
    if pairs.isEmpty():
        return pairs
    # pairs that are near each other go together: by the smaller of the smallest neighbours of their nodes
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = scratch.keep(ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("near")))
    placed = pairs.join(near.select(F.col("node").alias("a"), F.col("near").alias("x")), "a").join(near.select(F.col("node").alias("b"), F.col("near").alias("y")), "b")
    placed = scratch.keep(placed.select("a", "b", F.least("x", "y").alias("near")))
    blocks = placed.groupBy("near").agg(F.ceil(F.count("*") / (4 * BLOCK)).alias("blocks"))
    placed = placed.join(blocks, "near").withColumn("i", F.expr("pmod(xxhash64(a), blocks)")).withColumn("j", F.expr("pmod(xxhash64(b), blocks)"))
    buckets = max(1, -(-near.count() // BLOCK))
    dealt = scratch.keep(placed.select("a", "b", F.expr(f"pmod(xxhash64(near, least(i, j), greatest(i, j)), {buckets}L)").alias("bucket")))
    needed = dealt.select(F.col("bucket").alias("part"), F.col("a").alias("node")).unionByName(dealt.select("bucket", "b").toDF("part", "node")).distinct()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of = _named_sets(texts_of(right["text"]), k)
        good = [_links(of[x], of[y], num, den) for x, y in zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True)]
        return left.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    found = dealt.groupBy("bucket").cogroup(texts.of(needed).select("part", "text").groupBy("part")).applyInArrow(run, "a binary, b binary")
    found = scratch.keep(found)
    scratch.drop(*range(scratch.n - 4, scratch.n))
    scratch.free()
    return found


def link_counts(parts: DataFrame, nodes: DataFrame, texts: Texts, k: int, num: int, den: int) -> DataFrame:
    """For each node of a component the rows that it links to in other nodes.

    All links are within components.  A component is cut into blocks of nodes, and each two
    blocks are compared in one task, which returns sums and never pairs.
    """
    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = parts.join(sizes, "component").withColumn("own", F.expr("pmod(xxhash64(node), blocks)")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    buckets = max(1, -(-parts.count() // BLOCK))
    placed = placed.select("node", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))
    placed = placed.withColumn("part", F.expr(f"pmod(xxhash64(component, i, j), {buckets}L)"))
    known = placed.join(nodes.select("node", "n", "copies", *_SKETCH), "node")
    texts = texts.of(placed.select(F.col("part").alias("at"), "node").distinct()).select("at", "text")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        of = _named_sets(texts_of(right["text"]), k)
        left = left.sort_by([("component", "ascending"), ("i", "ascending"), ("j", "ascending")])
        node, second = left["node"].to_pylist(), left["second"].to_numpy()
        n, copies = left["n"].to_numpy().astype(np.int64), left["copies"].to_numpy()
        sketch = np.stack([left[c].to_numpy() for c in _SKETCH], axis=1).view(np.uint64)
        task = list(zip(left["component"].to_pylist(), left["i"].to_pylist(), left["j"].to_pylist(), strict=True))
        edges = [0, *(r for r in range(1, len(task)) if task[r] != task[r - 1]), len(task)]
        sums = np.zeros(len(node), dtype=np.int64)
        for a, z in zip(edges, edges[1:], strict=False):
            rows = np.arange(a, z)
            same = z > a and task[a][1] == task[a][2]
            one, two = (rows, rows) if same else (rows[~second[a:z]], rows[second[a:z]])
            for r in one:
                to = two[two > r] if same else two
                both = n[r] + n[to]
                differing = np.bitwise_count(sketch[r] ^ sketch[to]).sum(axis=1, dtype=np.int64)
                may = (den * np.minimum(n[r], n[to]) >= num * np.maximum(n[r], n[to])) & (differing <= both - 2 * -(-num * both // (num + den)))
                for t in to[may]:
                    if _links(of[node[r]], of[node[t]], num, den):
                        sums[r] += copies[t]
                        sums[t] += copies[r]
        return pa.table({"node": left["node"], "others": pa.array(sums)})

    found = known.groupBy("part").cogroup(texts.groupBy("at")).applyInArrow(run, "node binary, others long")
    return found.groupBy("node").agg(F.sum("others").alias("others"))


class Linked:
    """rows: each row's id, node and n; nodes: with their smallest id and copies; parts: node, component if linked."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str, scratch: Scratch):
        made = features(docs, k, num, den, id_col, text_col, heavy_shingles(docs, k, text_col))
        rows, whole = scratch.keep(made.withColumn("row", F.monotonically_increasing_id())), scratch.n
        any_of = [F.min(c).alias(c) for c in ("n", "shared", "grp", "mark", "row", *_SKETCH)]
        self.nodes = scratch.keep(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *any_of))
        self.texts = Texts(docs, self.nodes, text_col)
        found = Candidates(rows, self.nodes, num, den, scratch)
        self.rows = scratch.keep(rows.select("id", "node", "n"))
        scratch.drop(whole)  # prefixes and sketches of all rows
        scratch.free()
        links = verified(found.pivots(), self.texts, k, num, den, scratch)
        parts = scratch.keep(connected_components(links, scratch))
        rest = verified(found.across(parts), self.texts, k, num, den, scratch)
        # without further links the components stay
        self.parts = parts if rest.isEmpty() else scratch.keep(connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest), scratch))
        scratch.free()


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """Each row's id, n_shingles, component_id and, if wanted, n_links.

    Rows link when den * intersection >= num * union of their shingle sets.
    component_id is the smallest id reachable by links, n_links the number of other rows
    linked, for which each two nodes of a component are compared.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    linked = Linked(docs, k, num, den, id_col, text_col, scratch)
    smallest = linked.parts.join(linked.nodes, "node").groupBy("component").agg(F.min("id").alias("smallest"))
    known = linked.nodes.select("node", "id", "copies").join(linked.parts, "node", "left").join(smallest, "component", "left")
    columns = ["node", F.coalesce("smallest", "id").alias("component_id")]
    if count_links:
        known = known.join(link_counts(linked.parts, linked.nodes, linked.texts, k, num, den), "node", "left")
        columns.append((F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = linked.rows.select("id", "node", F.col("n").cast("long").alias("n_shingles")).join(known.select(*columns), "node", "left")
    links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"), *links)


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one row of each component: the one with the smallest id, then the first."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # names of docs cannot clash with these
    rows = scratch.keep(docs.select(whole, F.monotonically_increasing_id().alias("at")))
    found = jaccard_components(rows.select("at", F.col(f"row.`{text_col}`").alias("text")), k, num, den, "at", "text")
    found = found.join(rows.select("at", F.col(f"row.`{id_col}`").alias("id")), "at")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "at")).alias("best"))
    return rows.join(best.select("best.at"), "at", "left_semi").select("row.*")
