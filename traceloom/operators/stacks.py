"""Folding of call stacks: tree, hot functions, and the heaviest path.

Samples are summed by stack before any frame is looked at, so the work grows with the
number of distinct stacks.  Frames are stored leaf first and folded root first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.expressions import format_bytes, format_cycles, format_ns, percent
from traceloom.model import Table, TableError
from traceloom.plans import predicates as P

MAX_DEPTH, DEPTH_MOST = 6, 40
TREE_TOP, HOT_TOP, TOP_MOST = 8, 20, 50
SPINE_TAIL = 30
#: Below this share of its parent a step of the heaviest path is no longer clear.
CLEAR_SHARE = 0.8
#: Own weight over total weight from which a wait frame counts as waiting.
WAIT_SHARE = 0.5
SEPARATOR = " > "

# Frames in which a thread waits.
WAIT_FRAMES = """_DPSBlockUntilNextEventMatchingListInMode CFRunLoopRun CFRunLoopRunSpecific mach_msg2_trap mach_msg_trap mach_msg_overwrite_trap
__psynch_cvwait __psynch_mutexwait semaphore_wait_trap semaphore_wait __semwait_signal __ulock_wait __ulock_wait2 __workq_kernreturn
__select __select_nocancel __ppoll kevent_qos __kevent usleep nanosleep""".split()


def frame_key(f: Column) -> Column:
    """name@binary; a frame without name is ?"""
    name = F.when(F.coalesce(f["name"], F.lit("")) == "", F.lit("?")).otherwise(f["name"])
    return F.when(F.coalesce(f["binary"], F.lit("")) == "", name).otherwise(F.concat(name, F.lit("@"), f["binary"]))


@dataclass
class Folded:
    """Distinct stacks, root first, with their weight and samples."""

    stacks: DataFrame  # path array<string>, weight double, samples long
    unit: str = "nanoseconds"

    def shown(self, c: Column) -> Column:
        return {"cycles": format_cycles, "bytes": format_bytes}.get(self.unit, format_ns)(c)

    def total(self) -> float:
        return self.stacks.agg(F.sum("weight")).first()[0] or 0.0

    def nodes(self) -> DataFrame:
        """Every prefix of a stack: its shown path and parent, name, depth, total and own weight, samples, and both paths as arrays.

        The arrays are the keys; the shown paths may be equal for names that hold the separator.
        """
        up_to = F.explode(F.sequence(F.lit(1), F.size("path")))
        rows = self.stacks.select("path", "weight", "samples", up_to.alias("depth"))
        rows = rows.select(
            F.slice("path", 1, F.col("depth")).alias("key"), F.element_at("path", F.col("depth")).alias("name"), "depth", "weight", "samples",
            F.when(F.col("depth") == F.size("path"), F.col("weight")).otherwise(0.0).alias("own"),
        )
        out = rows.groupBy("key", "name", "depth").agg(F.sum("weight").alias("total_weight"), F.sum("own").alias("self_weight"), F.sum("samples").alias("samples"))
        above = F.slice("key", 1, F.col("depth") - 1)
        return out.select(F.array_join("key", SEPARATOR).alias("node"), F.array_join(above, SEPARATOR).alias("parent"), "name", "depth", "total_weight", "self_weight", "samples", "key", above.alias("above"))

    def tree(self, max_depth: int = MAX_DEPTH, top: int = TREE_TOP) -> DataFrame:
        """Nodes down to a depth; of each node's children the heaviest, and how many were left out."""
        max_depth, top = min(max_depth, DEPTH_MOST), min(top, TOP_MOST)
        nodes = self.nodes().where(F.col("depth") <= max_depth)
        w = Window.partitionBy("above")
        nodes = nodes.withColumn("nth", F.row_number().over(w.orderBy(F.desc("total_weight"), "name"))).withColumn("siblings", F.count("*").over(w))
        kept = nodes.where(F.col("nth") <= top)
        # a node stays only if all above it stay
        above = F.explode(F.expr("transform(sequence(1, depth), i -> slice(key, 1, i))"))
        whole = kept.select("key", "depth", above.alias("at")).join(kept.select(F.col("key").alias("at")), "at").groupBy("key").agg(F.count("*").alias("found"), F.first("depth").alias("d")).where("found = d").select("key")
        all_weight = self.stacks.agg(F.sum("weight").alias("all"))
        return kept.join(whole, "key").crossJoin(F.broadcast(all_weight)).select("node", "depth", "name", "total_weight", "self_weight", "samples", percent(F.col("total_weight"), F.col("all")).alias("percent"), (F.col("siblings") - F.least("siblings", F.lit(top))).alias("siblings_omitted"))  # all_weight is one row

    def hot(self, top: int | None = HOT_TOP) -> DataFrame:
        """Functions by own weight; a stack counts once for a function however often it is in it."""
        seen = self.stacks.select(F.explode(F.array_distinct("path")).alias("name"), "weight", "samples", F.element_at("path", -1).alias("leaf"))
        out = seen.groupBy("name").agg(F.sum(F.when(F.col("name") == F.col("leaf"), F.col("weight")).otherwise(0.0)).alias("self_weight"), F.sum("weight").alias("total_weight"), F.sum("samples").alias("samples"))
        out = out.withColumn("is_wait", wait_flag(F.substring_index("name", "@", 1), F.col("self_weight"), F.col("total_weight")))
        return out.orderBy(F.desc("self_weight"), F.desc("total_weight"), "name").limit(min(top, TOP_MOST)) if top else out

    def spine(self, leaf: int | None = None, full: bool = False) -> list[dict]:
        """From the root the heaviest child of each node; a walk over one row per step.

        Trimmed to what comes after the last wait frame, else to the last steps; leaf=N
        gives the last N, full all.
        """
        nodes = self.nodes().persist()
        try:
            best = nodes.groupBy("above").agg(F.max_by(F.struct("key", "node", "name", "depth", "total_weight", "self_weight", "samples"), F.struct("total_weight", F.expr("transform(array(name), x -> -length(x))"))).alias("b")).persist()
            out, at, before = [], [], None
            while row := best.where(F.col("above") == F.array(*map(F.lit, at)).cast("array<string>")).select("b.*").first():
                step = row.asDict()
                key = step.pop("key")
                step["percent_of_parent"] = round(1000 * step["total_weight"] / before) / 10 if before else 100.0
                step["is_wait"] = step["name"].split("@")[0] in WAIT_FRAMES and step["total_weight"] > 0 and step["self_weight"] / step["total_weight"] >= WAIT_SHARE
                out.append(step)
                at, before = key, step["total_weight"]
            best.unpersist()
        finally:
            nodes.unpersist()
        if full:
            return out
        if leaf:
            return out[-leaf:]
        waits = [k for k, s in enumerate(out) if s["name"].split("@")[0] in WAIT_FRAMES]
        return out[waits[-1] + 1 :] if waits and waits[-1] + 1 < len(out) else out[-SPINE_TAIL:]

    def unclear_depth(self, spine: list[dict]) -> int | None:
        """The first depth of the path whose share of its parent is under CLEAR_SHARE."""
        return next((s["depth"] for s in spine if s["percent_of_parent"] < 100 * CLEAR_SHARE), None)


def wait_flag(name: Column, own: Column, total: Column) -> Column:
    return F.coalesce(name.isin(*WAIT_FRAMES) & (total > 0) & (own / total >= WAIT_SHARE), F.lit(False))


def fold(table: Table, thread: str | None = None, start: int | None = None, end: int | None = None, weight: str | None = None) -> Folded:
    """Distinct stacks of the rows in the window and on threads that hold the text."""
    stack = table.stack_column()
    if stack is None:
        raise TableError(f"{table.schema} has no call stacks to fold")
    weights = [c for c in table.classified() if c.role == "weight"]
    weight = weight or table.duration_column()
    unit = next((c.unit for c in weights if c.mnemonic == weight), "nanoseconds")
    unit = "cycles" if weight and table.type_of(weight) == "cycle-weight" else unit
    condition = P.time_range(table, start, end)
    if thread is not None and (name := table.thread_column()):
        condition &= P.like_text(table.fmt(name), thread)
    value = table.raw(weight).cast("double") if weight else F.lit(1.0)
    rows = table.df.where(condition).select(table.raw(stack).alias("frames"), value.alias("weight"))
    rows = rows.groupBy("frames").agg(F.sum("weight").alias("weight"), F.count("*").alias("samples"))
    rows = rows.where((F.size("frames") > 0) & (F.col("weight") > 0) & (F.abs("weight") < float("inf")))
    return Folded(rows.select(F.reverse(F.transform("frames", frame_key)).alias("path"), "weight", "samples"), unit or "nanoseconds")


def diagnosis(table: Table, thread: str | None, start: int | None, end: int | None) -> str | None:
    """Why there is nothing to fold: no row, none in the window, or none on the thread."""
    inside = table.where(P.time_range(table, start, end))
    if not table.df.limit(1).count():
        return f"{table.schema} has no rows"
    if not inside.df.limit(1).count():
        return "no row lies in the time range"
    name = table.thread_column()
    if thread is not None and name and not inside.df.where(P.like_text(table.fmt(name), thread)).limit(1).count():
        return f"no row in the time range is on a thread like {thread!r}"
    return None


def captured_note(table: Table, start: int | None, end: int | None, folded: Folded) -> str | None:
    """Whether under half of the window's time was captured, for weights in nanoseconds."""
    if folded.unit != "nanoseconds" or start is None or end is None or end <= start:
        return None
    share = folded.total() / (end - start)
    return f"samples cover {100 * share:.0f} % of the window" if share < 0.5 else None


def cut_off_note(folded: Folded) -> str | None:
    """Whether all of at least ten samples are one frame that says that stacks were cut off."""
    rows = folded.stacks.groupBy("path").agg(F.sum("samples").alias("n")).limit(2).collect()
    if len(rows) == 1 and len(rows[0]["path"]) == 1 and rows[0]["n"] >= 10 and rows[0]["path"][0].startswith("Call stack limit reached"):
        return "the recording kept no call stacks: every sample is one frame"
    return None
