"""Why a thread was off the CPU: the longest overlapping wait, classified by its stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.model import ROW, Table
from traceloom.operators.stacks import WAIT_FRAMES
from traceloom.plans import predicates as P

WAITS = 200
SCHEDULING_NS = 1_000_000

# Further frames at the end of a wait.
WAIT_LEAVES = WAIT_FRAMES + "kevent_id __kevent_id kevent __wait4 __wait4_nocancel poll __ppoll_nocancel".split()
# Frames of a synchronous wait for other work.
BLOCK_FRAMES = """_dispatch_sync_f_slow _dispatch_barrier_sync_f_slow _dispatch_sync_wait __DISPATCH_WAIT_FOR_QUEUE__ _dispatch_event_loop_wait_for_ownership
_dispatch_thread_event_wait_slow _dispatch_group_wait_slow __psynch_cvwait __psynch_mutexwait __psynch_rw_rdlock __psynch_rw_wrlock pthread_cond_wait
pthread_mutex_lock _pthread_mutex_firstfit_lock_slow semaphore_wait_trap semaphore_wait sem_wait __ulock_wait __ulock_wait2""".split()
# How frames start that run work from a run loop.
CALLOUTS = ["__CFRUNLOOP_IS_CALLING_OUT_TO_", "__CFRUNLOOP_IS_SERVICING_"]
# Marks of a sleep, and of a parked loop or worker, the most telling first.
TIMERS = ["+[NSThread sleepForTimeInterval:]", "-[NSThread sleepUntilDate:]", "thread_sleep", "nanosleep", "usleep", "sleep"]
IDLE = """_DPSNextEvent _DPSBlockUntilNextEventMatchingListInMode _BlockUntilNextEventMatchingListInMode ReceiveNextEventCommon _dispatch_worker_thread
_dispatch_worker_thread2 _dispatch_worker_thread3 _pthread_wqthread start_wqthread __CFRunLoopServiceMachPort""".split()
# How frames start that only carry a wait.
PLUMBING = ["_dispatch", "__DISPATCH", "_pthread", "__psynch", "mach_msg", "__ulock"]


def _texts(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _first_of(frames: Column, marks: list[str]) -> Column:
    """The first of the marks that is among the frames."""
    return F.get(F.filter(_texts(marks), lambda m: F.array_contains(frames, m)), F.lit(0))


def _last_index(frames: Column, names: list[str]) -> Column:
    """1-based place of the frame farthest from the leaf that is one of the names, or null."""
    at = F.filter(F.transform(frames, lambda x, i: F.when(x.isin(*names), i + 1)), lambda x: x.isNotNull())
    return F.array_max(at)


def _starts(x: Column, heads: list[str]) -> Column:
    return P.any_of([x.startswith(h) for h in heads])


def _work_above(frames: Column, at: Column) -> Column:
    """The first frame beyond a place that does more than carry the wait."""
    rest = F.slice(frames, at + 1, F.greatest(F.size(frames) - at, F.lit(0)))
    return F.get(F.filter(rest, lambda x: ~(x.isin(*WAIT_LEAVES, *BLOCK_FRAMES) | _starts(x, PLUMBING))), F.lit(0))


def classified(frames: Column) -> Column:
    """Of a stack, leaf first: its class, the deepest wait frame, and the frame that the class rests on.

    An explicit synchronous wait comes before a run-loop callout, a sleep, and a parked
    loop, which also needs a known wait frame; all else stays unclassified.
    """
    names = F.transform(frames, lambda f: F.coalesce(f["name"], F.lit("?")))
    wait = F.get(F.filter(names, lambda x: x.isin(*WAIT_LEAVES)), F.lit(0))
    block = _last_index(names, BLOCK_FRAMES)
    callout = F.get(F.filter(F.transform(names, lambda x, i: F.when(_starts(x, CALLOUTS), i + 1)), lambda x: x.isNotNull()), F.lit(0))
    timer, idle = _first_of(names, TIMERS), _first_of(names, IDLE)
    deepest = F.coalesce(wait, F.get(names, F.lit(0)))
    none = F.lit(None).cast("string")
    made = lambda kind, on, waiting: F.struct(F.lit(kind).alias("class"), deepest.alias("deepest_wait"), on.alias("rests_on"), waiting.alias("waiting_on"))
    return (
        F.when(block.isNotNull(), made("blocked-on-work", F.element_at(names, block), _work_above(names, block)))
        .when(callout.isNotNull(), made("blocked-on-work", F.element_at(names, callout), _work_above(names, callout)))
        .when(timer.isNotNull(), made("timer-wait", timer, none))
        .when(idle.isNotNull() & wait.isNotNull(), made("idle-in-runloop", idle, none))
        .otherwise(made("unclassified", none, none))
    )


def waits(table: Table, start: int, end: int, thread: str | None = None, wait: str = "wait-time") -> DataFrame:
    """Waits with a stack that overlap the window, the longest first."""
    condition = P.overlaps(table.raw(table.time_column()), table.raw(table.duration_column()), start, end) & table.raw(wait).isNotNull() & table.raw(table.stack_column()).isNotNull()
    if thread and table.thread_column():
        condition &= P.like_text(table.fmt(table.thread_column()), thread)
    frames = table.raw(table.stack_column())
    return table.df.where(condition).orderBy(table.raw(wait).desc(), ROW).limit(WAITS).select(F.col(ROW).alias("row_idx"), table.raw(wait).alias("wait_ns"), frames.alias("frames"), classified(frames).alias("found"))


def scheduling_delay(states: Table, start: int, end: int, thread: str | None = None, state: str = "state") -> DataFrame:
    """The longest overlap with a runnable but not running thread, if long enough."""
    a, d = states.raw(states.time_column()), states.raw(states.duration_column())
    overlap = F.least(a + d, F.lit(end)) - F.greatest(a, F.lit(start))
    condition = P.overlaps(a, d, start, end) & (states.fmt(state) == "Runnable")
    if thread and states.thread_column():
        condition &= P.like_text(states.fmt(states.thread_column()), thread)
    return states.df.where(condition).select(F.col(ROW).alias("row_idx"), overlap.alias("delay_ns")).where(F.col("delay_ns") >= SCHEDULING_NS).orderBy(F.desc("delay_ns"), "row_idx").limit(1)


def explain(table: Table, start: int, end: int, thread: str | None = None, wait: str = "wait-time", states: Table | None = None) -> dict:
    """The dominant wait and its class; without any wait a long scheduling delay explains the gap."""
    top = waits(table, start, end, thread, wait).limit(1).collect()
    delay = scheduling_delay(states, start, end, thread).collect() if states else []
    if top:
        found = top[0]["found"].asDict()
        return found | {"row_idx": top[0]["row_idx"], "wait_ns": top[0]["wait_ns"], "delay_ns": delay[0]["delay_ns"] if delay else None}
    if delay:
        return {"class": "scheduling-delay", "row_idx": delay[0]["row_idx"], "delay_ns": delay[0]["delay_ns"]}
    return {"class": None}
