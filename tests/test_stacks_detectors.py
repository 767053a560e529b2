import pytest

from traceloom.model import ROW, Catalog, Column, Table, TableError
from traceloom.operators import catalog as M
from traceloom.operators import detectors as X
from traceloom.operators import off_cpu as O
from traceloom.operators import stacks as S

FRAME = "struct<name:string,addr:string,binary:string,binary_path:string>"


def frames(*names):
    return [{"name": n, "addr": None, "binary": None, "binary_path": None} for n in names]


@pytest.fixture(scope="module")
def samples(spark):
    rows = [
        (0, 1, "Main Thread", 10, frames("leaf", "work", "main")),
        (1, 2, "Main Thread", 30, frames("work", "work", "main")),
        (2, 3, "worker 1", 5, frames("mach_msg2_trap", "", "start")),
        (3, 4, "worker 2", 0, frames("x", "start")),
        (4, 5, "worker 2", 9, []),
    ]
    df = spark.createDataFrame(rows, f"{ROW} long, time long, thread string, weight long, stack array<{FRAME}>")
    return Table("s", df, [Column("time", "sample-time"), Column("thread", "thread"), Column("weight", "weight"), Column("stack", "backtrace")], hints={"roles": {"weight": ("weight", "nanoseconds")}})


def test_tree_hot_and_spine_agree(samples):
    f = S.fold(samples)
    nodes = f.nodes().collect()
    assert sum(n["self_weight"] for n in nodes) == f.total() == 45
    hot = {r["name"]: r for r in f.hot().collect()}
    assert hot["work"]["total_weight"] == 40 and hot["work"]["self_weight"] == 30  # recursion counts once
    assert "?" in hot and hot["mach_msg2_trap"]["is_wait"]
    spine = f.spine(full=True)
    assert [s["name"] for s in spine] == ["main", "work", "work"]
    assert [s["percent_of_parent"] for s in spine] == [100.0, 100.0, 75.0] and f.unclear_depth(spine) == 3
    tree = f.tree(max_depth=2, top=1).collect()
    assert {t["name"] for t in tree} == {"main", "work"} and max(t["siblings_omitted"] for t in tree) == 1


def test_thread_text_and_diagnosis(samples):
    assert S.fold(samples, thread="MAIN").total() == 40
    assert "thread" in S.diagnosis(samples, "nobody", None, None)
    assert "time range" in S.diagnosis(samples, None, 100, 200)
    with pytest.raises(TableError):
        S.fold(Table("x", samples.df, [Column("time", "sample-time")]))


@pytest.mark.parametrize(
    ("names", "kind", "on"),
    [
        (["mach_msg2_trap", "__CFRunLoopServiceMachPort", "_DPSNextEvent", "main"], "idle-in-runloop", "_DPSNextEvent"),
        (["kevent_id", "__DISPATCH_WAIT_FOR_QUEUE__", "_dispatch_sync_f_slow", "commit", "_DPSNextEvent"], "blocked-on-work", "_dispatch_sync_f_slow"),
        (["mach_msg2_trap", "__CFRUNLOOP_IS_CALLING_OUT_TO_A_TIMER_CALLBACK_FUNCTION__", "draw"], "blocked-on-work", "__CFRUNLOOP_IS_CALLING_OUT_TO_A_TIMER_CALLBACK_FUNCTION__"),
        (["__semwait_signal", "nanosleep", "+[NSThread sleepForTimeInterval:]"], "timer-wait", "+[NSThread sleepForTimeInterval:]"),
        (["mystery", "_DPSNextEvent"], "unclassified", None),
    ],
)
def test_off_cpu_classes(spark, names, kind, on):
    df = spark.createDataFrame([(frames(*names),)], f"f array<{FRAME}>")
    found = df.select(O.classified(df["f"]).alias("c")).first()["c"]
    assert (found["class"], found["rests_on"]) == (kind, on)


def test_explain_prefers_the_longest_wait_and_falls_back_to_scheduling(spark):
    rows = [(0, 0, 10_000_000, "main", 5, frames("mach_msg2_trap", "_DPSNextEvent")), (1, 5, 10_000_000, "main", 9, frames("kevent_id", "_dispatch_sync_f_slow", "commit"))]
    df = spark.createDataFrame(rows, f"{ROW} long, start long, duration long, thread string, `wait-time` long, stack array<{FRAME}>")
    t = Table("syscall", df, [Column("start", "start-time"), Column("duration", "duration"), Column("thread", "thread"), Column("wait-time", "duration-waiting"), Column("stack", "backtrace")])
    found = O.explain(t, 0, 100, "MAIN")
    assert found["row_idx"] == 1 and found["waiting_on"] == "commit"
    states = Table("st", spark.createDataFrame([(0, 0, 3_000_000, "main", "Runnable")], f"{ROW} long, start long, duration long, thread string, state string"), [Column("start", "start-time"), Column("duration", "duration"), Column("thread", "thread"), Column("state", "thread-state")])
    empty = Table("syscall", df.where("false"), t.columns)
    assert O.explain(empty, 0, 10_000_000, states=states)["class"] == "scheduling-delay"
    assert O.explain(empty, 0, 10)["class"] is None


def _updates(spark, n, gap, duration):
    df = spark.createDataFrame([(i, i * gap, duration, "Row", "View Body Updates") for i in range(n)], f"{ROW} long, start long, duration long, description string, `update-type` string")
    return Table("swiftui-updates", df, [Column("start", "start-time"), Column("duration", "duration"), Column("description", "string"), Column("update-type", "swiftui-update")])


def test_detectors_fire_only_above_their_thresholds(spark):
    quiet, loud = Catalog([_updates(spark, 100, 5_000_000, 2_000_000)]), Catalog([_updates(spark, 101, 500_000, 2_000_000)])
    assert X.run_detectors(quiet) == ([], {})
    found, failed = X.run_detectors(loud)
    assert not failed and {f.detector for f in found} == {"swiftui-over-invalidation", "swiftui-rebuild-storm"}
    assert found[0].score >= found[1].score and found[0].severity == "medium"


def _hitches(spark, values_ms):
    df = spark.createDataFrame([(i, i * 10**9, int(v * 1e6), "No") for i, v in enumerate(values_ms)], f"{ROW} long, start long, duration long, `is-system` string")
    return Table("hitches", df, [Column("start", "start-time"), Column("duration", "duration"), Column("is-system", "boolean")])


def test_hitch_sweeps_use_the_frame_budget(spark):
    c = Catalog([_hitches(spark, [10.0] * 6)])
    assert X.frame_budget_ms(c) == pytest.approx(16.67, abs=0.01)
    assert X.near_miss_sweep(c) and not X.outlier_sweep(c)
    c = Catalog([_hitches(spark, [20.0] * 6 + [40.0] * 2)])
    assert X.outlier_sweep(c) and not X.near_miss_sweep(c)
    c.add(Table("unused", c.get("hitches").df, []))
    c = Catalog([_hitches(spark, [10.0] * 8 + [40.0])])
    found = X.near_miss_sweep(c)  # one long hitch does not silence it
    assert found and found.row == 0 and found.detail["closest_ms"] == 10.0
    display = spark.createDataFrame([(0, "1", 120, "Yes"), (1, "2", 60, "No")], f"{ROW} long, `display-id` string, `max-refresh-rate` long, `is-main-display` string")
    c.add(Table("device-display-info", display, [Column("display-id", "uint64"), Column("max-refresh-rate", "uint32"), Column("is-main-display", "boolean")]))
    assert X.frame_budget_ms(c) == pytest.approx(1000 / 120) and X.frame_budget_ms(c, "Display 2") == pytest.approx(1000 / 60)


def test_cadence_of_swaps(spark):
    ticks = spark.createDataFrame([(t,) for t in range(0, 130, 10)], "tick long")
    swaps = spark.createDataFrame([(31, 10), (40, 30), (70, 10), (80, 10), (200, 10), (90, None)], "swap long, shown long")
    out = {r["tick"]: r for r in X.cadence_table(ticks, swaps, "tick", "swap", "shown", 10, 50, 80).collect()}
    assert sorted(out) == list(range(30, 101, 10))
    assert [out[t]["status"] for t in range(30, 101, 10)] == ["normal", "3 frames held (2 dropped)", "no new frame", "no new frame", "recovery swap", "normal", "idle", "idle"]
    assert out[40]["frames"] == 3 and out[50]["frames"] is None


def test_names_that_hold_the_separator_stay_in_the_tree(spark):
    frame = "array<struct<name:string,binary:string>>"
    rows = [(0, [("leaf", None), ("operator > (A)", None), ("main", None)], 5), (1, [("leaf", None), ("main", None)], 1)]
    df = spark.createDataFrame(rows, f"{ROW} long, stack {frame}, weight long")
    t = Table("time-sample", df, [Column("stack", "backtrace"), Column("weight", "cycle-weight")])
    names = {(r["depth"], r["name"]): r["total_weight"] for r in S.fold(t, weight="weight").tree().collect()}
    assert names == {(1, "main"): 6.0, (2, "operator > (A)"): 5.0, (3, "leaf"): 5.0, (2, "leaf"): 1.0}
    assert [s["name"] for s in S.fold(t, weight="weight").spine(full=True)] == ["main", "operator > (A)", "leaf"]


def test_failing_detector_does_not_hide_others(spark):
    broken = Table("SwiftActorQueueSize", spark.createDataFrame([(0,)], f"{ROW} long"), [])
    found, failed = X.run_detectors(Catalog([broken, _updates(spark, 101, 500_000, 2_000_000)]))
    assert found and "fm-main-actor-saturation" in failed


def test_edges_are_order_invariant(spark, samples):
    a, b = samples, _updates(spark, 1, 1, 1)
    one, two = M.EdgeRegistry().edges([a, b]), M.EdgeRegistry().edges([b, a])
    assert one == two and [e.kind for e in one] == ["time-window"] and one[0].inverted().inverted() == one[0]
    pinned = M.Edge("s", "swiftui-updates", "equi", (("thread", "description"),), True)
    assert M.EdgeRegistry([pinned]).edges([a, b]) == [pinned] and M.EdgeRegistry([pinned]).latent([a]) == [pinned]
    assert M.size_tier(0) == "empty" and M.size_tier(10**6) == "firehose" and M.grain(b) == "interval"


def test_memo_and_response():
    memo, made = M.CallMemo(), []
    for args in ({"a": 1, "b": 2}, {"b": 2, "a": 1}):
        memo.get("query", 1, "s", args, lambda: made.append(1))
    assert len(made) == 1
    r = M.Response("x", None, [{"recommended": True}, {"recommended": True}])
    assert [a["recommended"] for a in r.next_actions] == [True, False]
