"""Detectors: canned analytics with thresholds, scored by how far they are exceeded.

A detector is a plan that returns at most one row of metrics.  Its finding fires if the
rule holds; the score is the geometric mean of value over threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.expressions import trailing_number
from traceloom.model import ROW, Catalog, Table, TableError
from traceloom.operators.relate import containing
from traceloom.plans import predicates as P

HIGH, MEDIUM = 5.0, 2.0
DEFAULT_BUDGET_MS = 1000 / 60
MIN_ROWS = 5
EAGER = 4
#: Ticks and swaps that are looked at around a window.
CADENCE_ROWS = 64


@dataclass
class Finding:
    detector: str
    metrics: list[tuple[str, float, float]]  # name, value, threshold
    row: int | None = None
    detail: dict = field(default_factory=dict)

    @property
    def score(self) -> float:
        return math.exp(sum(math.log(max(v / t if t else v, 1e-9)) for _, v, t in self.metrics) / len(self.metrics))

    @property
    def severity(self) -> str:
        return self.detail.get("severity") or ("high" if self.score >= HIGH else "medium" if self.score >= MEDIUM else "low")


def score(ratios: list[Column]) -> Column:
    """The geometric mean of ratios as an expression."""
    return F.exp(sum((F.log(F.greatest(r, F.lit(1e-9))) for r in ratios[1:]), F.log(F.greatest(ratios[0], F.lit(1e-9)))) / len(ratios))


def _ns(t: Table) -> Column:
    return t.raw(t.duration_column()).cast("double")


def top_label(df: DataFrame, label: str, duration: str, row: str) -> DataFrame:
    """Labels by count with their whole duration and longest row."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.sum(duration).alias("total"), F.max_by(row, F.struct(F.col(duration), -F.col(row))).alias("longest_row"))


def dense_gaps(df: DataFrame, label: str, time: str, row: str, gap: int) -> DataFrame:
    """By label how many rows follow the one before within a short gap, not at once."""
    w = Window.partitionBy(label).orderBy(time, row)
    d = F.col(time) - F.lag(time).over(w)
    return df.select(label, d.alias("d")).where((F.col("d") > 0) & (F.col("d") < gap)).groupBy(label).agg(F.count("*").alias("n"))


def peak_total(df: DataFrame, order: str, row: str, size: str) -> DataFrame:
    """The highest running total.  Days, or other parts of the order, are summed first, so no task orders all rows."""
    sums = df.groupBy(order).agg(F.sum(size).alias("s"))
    return sums.select(F.sum("s").over(Window.orderBy(order)).alias("running")).agg(F.max("running").alias("peak"))


def band_counts(df: DataFrame, value: str, low: float, high: float, strict: bool = True) -> DataFrame:
    """Rows over low, rows over high, rows from low to high, and the largest value, of all and of those between."""
    v = F.col(value)
    return df.where(v.isNotNull()).agg(F.count("*").alias("n"), F.count_if(v > low).alias("over_low"), F.count_if(v > high if strict else v >= high).alias("over_high"), F.count_if((v >= low) & (v <= high)).alias("between"), F.max(v).alias("worst"), F.max(F.when((v >= low) & (v <= high), v)).alias("worst_between"))


def contained(a: DataFrame, b: DataFrame, start: str, duration: str, time: str, row: str, exists: bool = True) -> DataFrame:
    """Intervals with, or without, a point inside."""
    inside = containing(a, b.select(time), start, duration, time).select(row).distinct()
    return a.join(inside, row, "left_semi" if exists else "left_anti")


def over_invalidation(c: Catalog) -> Finding | None:
    t = c.get("swiftui-updates")
    rows = top_label(t.df.select(t.fmt("description").alias("label"), _ns(t).alias("d"), ROW), "label", "d", ROW).orderBy(F.desc("n"), "label").first()
    if rows and rows["n"] > 100 and rows["total"] / 1e6 > 150:
        return Finding("swiftui-over-invalidation", [("updates", rows["n"], 100), ("total ms", rows["total"] / 1e6, 150)], rows["longest_row"], {"label": rows["label"]})
    return None


def _app_hitches(c: Catalog) -> tuple[Table, DataFrame]:
    t = c.get("hitches")
    return t, t.df.where(t.fmt("is-system") == "No").select(ROW, (_ns(t) / 1e6).alias("ms"), t.raw(t.time_column()).alias("start"), t.raw(t.duration_column()).alias("duration"))


def hitch_distribution(c: Catalog) -> Finding | None:
    _, rows = _app_hitches(c)
    budget = frame_budget_ms(c)
    p = rows.agg(F.count("*").alias("n"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY ms)").alias("p99"), F.max_by(ROW, "ms").alias("row")).first()
    fired = [(n, v, t) for n, v, t in (("p95 ms", p["p95"], 2 * budget), ("p99 ms", p["p99"], 3 * budget)) if p["n"] >= MIN_ROWS and v > t]
    return Finding("animation-hitches-distribution", fired, p["row"]) if fired else None


def rebuild_storm(c: Catalog) -> Finding | None:
    t = c.get("swiftui-updates")
    top = dense_gaps(t.df.select(t.fmt("description").alias("label"), t.raw(t.time_column()).alias("t"), ROW), "label", "t", ROW, 1_000_000).orderBy(F.desc("n"), "label").first()
    return Finding("swiftui-rebuild-storm", [("dense gaps", top["n"], 50)], detail={"label": top["label"]}) if top and top["n"] > 50 else None


def allocation_growth(c: Catalog) -> Finding | None:
    t = c.get("Allocations/Allocations List")
    peak = peak_total(t.df.select(t.raw(t.time_column()).alias("t"), ROW, t.raw("size").cast("double").alias("size")), "t", ROW, "size").first()["peak"]
    return Finding("allocations-growth", [("peak bytes", peak, 50e6)]) if peak and peak > 50e6 else None


def hitch_cause(c: Catalog) -> Finding | None:
    _, rows = _app_hitches(c)
    s = c.get("time-sample")
    running = s.df.where(s.fmt("thread-state") == "Running").select(s.raw(s.time_column()).alias("sample_time"))
    n = contained(rows, running, "start", "duration", "sample_time", ROW, exists=False).count()
    return Finding("hitch-cause-split", [("hitches without a running sample", n, 10)]) if n > 10 else None


def unfreed(c: Catalog) -> Finding | None:
    t = c.get("Allocations/Allocations List")
    r = t.df.where(P.truth(t, "live", True)).agg(F.count("*").alias("n"), F.sum(t.raw("size").cast("double")).alias("bytes"), F.max_by(ROW, t.raw("size").cast("double")).alias("row")).first()
    return Finding("leak-alloc-without-free", [("live allocations", r["n"], 1000), ("live bytes", r["bytes"], 10e6)], r["row"]) if r["n"] > 1000 and (r["bytes"] or 0) > 10e6 else None


def body_in_runloop(c: Catalog) -> Finding | None:
    t, u = c.get("runloop-intervals"), c.get("swiftui-updates")
    busy = t.df.where((t.fmt("interval-type") == "Busy") & P.truth(t, "is-main", True)).select(ROW, t.raw(t.time_column()).alias("start"), t.raw(t.duration_column()).alias("duration"))
    bodies = u.df.where(u.fmt("update-type") == "View Body Updates").select(u.raw(u.time_column()).alias("update_time"))
    n = contained(busy, bodies, "start", "duration", "update_time", ROW).count()
    return Finding("runloop-contains-body-eval", [("busy turns with a body update", n, 50)]) if n > 50 else None


def caching_miss(c: Catalog) -> Finding | None:
    t = c.get("ModelInferenceTable")
    total, cached = (t.raw(n).cast("string").try_cast("double") for n in ("total-tokens", "cached-tokens"))
    r = t.df.where(total > 32).agg(F.count("*").alias("n"), F.count_if(cached == 0).alias("misses")).first()
    if r["n"] and r["misses"] > 10 and r["misses"] / r["n"] > 0.5:
        return Finding("fm-prompt-caching-miss", [("misses", r["misses"], 10), ("miss rate", r["misses"] / r["n"], 0.5)])
    return None


def actor_saturation(c: Catalog) -> Finding | None:
    t = c.get("SwiftActorQueueSize")
    v = t.raw("count").cast("double")
    r = t.df.agg(F.max(v).alias("deepest"), F.count_if(v > 10).alias("over"), F.max_by(ROW, v).alias("row")).first()
    return Finding("fm-main-actor-saturation", [("queue depth", r["deepest"], 10), ("samples", r["over"], 20)], r["row"]) if r["over"] > 20 and r["deepest"] > 10 else None


def outlier_sweep(c: Catalog) -> Finding | None:
    _, rows = _app_hitches(c)
    b = frame_budget_ms(c)
    r = band_counts(rows, "ms", b, 2 * b).first()
    fired = [(n, v, t) for n, v, t in (("over budget", r["over_low"], 5), ("over twice the budget", r["over_high"], 1)) if r["n"] >= MIN_ROWS and v > t]
    return Finding("outlier-sweep", fired, worst_row(rows, "ms")) if fired else None


def worst_row(rows: DataFrame, value: str) -> int | None:
    """The row with the largest value, the first of equals."""
    found = rows.agg(F.max_by(ROW, F.struct(F.col(value), -F.col(ROW))).alias("row")).first()
    return found["row"]


def near_miss_sweep(c: Catalog) -> Finding | None:
    _, rows = _app_hitches(c)
    b = frame_budget_ms(c)
    r = band_counts(rows, "ms", 0.5 * b, b).first()
    if r["n"] < MIN_ROWS or r["between"] <= 5:
        return None
    row = worst_row(rows.where(F.col("ms").between(0.5 * b, b)), "ms")
    return Finding("near-miss-sweep", [("near misses", r["between"], 5)], row, {"closest_ms": r["worst_between"], "budget_ms": b})


def render_hitch_sweep(c: Catalog) -> Finding | None:
    t = c.get("hitches-renders")
    base = render_baseline_ms(c)
    rows = t.df.select(ROW, (_ns(t) / 1e6).alias("ms"))
    r = band_counts(rows, "ms", base, 2 * base, strict=False).first()
    fired = [(n, v, k) for n, v, k in (("over the baseline", r["over_low"], 5), ("twice the baseline", r["over_high"], 1)) if r["n"] >= MIN_ROWS and v > k]
    return Finding("render-hitch-sweep", fired, worst_row(rows, "ms")) if fired else None


def qos_mismatch(c: Catalog) -> Finding | None:
    t, e = c.get("ThreadQoSTable"), c.get("runloop-events")
    state = next(n.mnemonic for n in t.columns if n.mnemonic.endswith("state"))
    rows = t.df.where(t.fmt(state) == "QoS classes mismatch").select(ROW, t.fmt(t.thread_column()).alias("thread"))
    n = rows.count()
    if not n:
        return None
    main = e.df.where(P.truth(e, "is-main", True)).select(e.fmt(e.thread_column()).alias("thread")).distinct()
    on_main = rows.join(main, "thread", "left_semi").limit(1).count() > 0
    return Finding("qos-classes-mismatch", [("mismatches", n, 1)], detail={"severity": "high"} if on_main else {})


def priority_inversion(c: Catalog) -> Finding | None:
    t = c.get("ThreadPriority")
    low = t.raw("scheduled-priority").cast("double") < t.raw("base-priority").cast("double")
    r = t.df.where(low & (_ns(t) > 50e6)).agg(F.max(_ns(t)).alias("worst"), F.max_by(ROW, _ns(t)).alias("row")).first()
    return Finding("thread-priority-inversion", [("longest inversion ms", r["worst"] / 1e6, 50)], r["row"]) if r["worst"] else None


def n_plus_one_groups(df: DataFrame, key: str, objects: str) -> DataFrame:
    """Keys with many calls of few objects each."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("calls"), F.avg(objects).alias("average")).where("calls > 20 and average < 2")


def n_plus_one(c: Catalog) -> Finding | None:
    t = c.get("core-data-fetch")
    top = n_plus_one_groups(t.df.select(t.fmt("fetch-entity").alias("entity"), t.raw("fetch-count").cast("double").alias("objects")), "entity", "objects").orderBy(F.desc("calls"), "entity").first()
    return Finding("core-data-fetch-n-plus-one", [("calls", top["calls"], 20), ("objects a call", top["average"], 2)], detail={"entity": top["entity"]}) if top else None


def median_gap(df: DataFrame, group: str, time: str) -> DataFrame:
    """By group the interpolated median of the gaps between successive times, for at least five rows."""
    gaps = df.withColumn("gap", F.col(time) - F.lag(time).over(Window.partitionBy(group).orderBy(time)))
    return gaps.groupBy(group).agg(F.count("*").alias("rows"), F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("gap")).where(f"rows >= {MIN_ROWS} and gap is not null")


def frame_budget_ms(c: Catalog, display: str | None = None) -> float:
    """From the display's refresh rate: the one named by its digits, the only, the main, or the fastest; else from vsyncs."""
    try:
        t = c.get("device-display-info")
        rows = t.df.select(trailing_number(t.fmt("display-id")).alias("id"), t.raw("max-refresh-rate").cast("double").alias("rate"), P.truth(t, "is-main-display", True).alias("main")).where("rate > 0").collect()
    except TableError:
        rows = []
    if rows:
        digits = "".join(x for x in (display or "") if x.isdigit())
        named = [r for r in rows if digits and r["id"] == float(digits)]
        main = [r for r in rows if r["main"]]
        picked = named or (rows if len(rows) == 1 else main) or rows
        return 1000 / max(r["rate"] for r in picked)
    try:
        v = c.get("display-vsyncs-interval")
        rows = v.df.orderBy(ROW).limit(2000).select(v.fmt("display-name").alias("display"), v.raw(v.time_column()).alias("t"))
        best = median_gap(rows, "display", "t").agg(F.min("gap")).first()[0]
        if best:
            return best / 1e6
    except TableError:
        pass
    return DEFAULT_BUDGET_MS


def render_baseline_ms(c: Catalog) -> float:
    """(depth - 1) / 2 frame budgets; depth is the median number of render buffers, 2 if unknown."""
    depth = None
    for schema in ("display-surface-swap", "display-vsyncs-interval"):
        try:
            t = c.get(schema)
            d = t.raw("color").cast("string").try_cast("double")
            depth = t.df.where((d > 0) & (d < 100)).agg(F.median(d)).first()[0]
        except TableError:
            continue
        if depth:
            break
    return ((depth or 2) - 1) / 2 * frame_budget_ms(c)


def cadence_table(ticks: DataFrame, swaps: DataFrame, tick: str, swap: str, shown: str, cadence: int, start: int, end: int) -> DataFrame:
    """Each tick from two cadences before a window to two after it, and what was shown.

    A swap within half a cadence of the tick holds as many frames as its time on screen has
    cadences; several are drops, and the next swap with one is the recovery.  Without a swap
    the frame before is still shown, or nothing is.  ticks: tick; swaps: swap, shown (time on screen).
    """
    low, high = start - 2 * cadence, end + 2 * cadence
    near = ticks.where(F.col(tick).between(low, high)).select(F.col(tick).alias("t")).orderBy("t").limit(CADENCE_ROWS)
    held = swaps.where(F.col(swap).between(low - cadence, high)).select(F.col(swap).alias("s"), F.col(shown).alias("d")).where("d is not null").orderBy("s").limit(CADENCE_ROWS)
    met = near.join(F.broadcast(held), (F.abs(F.col("s") - F.col("t")) <= cadence / 2) | (F.col("s") <= F.col("t")) & (F.col("t") < F.col("s") + F.col("d")), "left")  # both have at most 64 rows
    own = F.abs(F.col("s") - F.col("t")) <= cadence / 2
    rows = met.groupBy("t").agg(F.min(F.when(own, F.struct("s", "d"))).alias("own"), F.count("s").alias("covering"))
    frames = F.greatest(F.lit(1), F.floor(F.col("own.d") / cadence + 0.5)).cast("int")
    rows = rows.select("t", "own", "covering", F.when(F.col("own").isNotNull(), frames).alias("frames"))
    before = F.last(F.when(F.col("own").isNotNull(), F.col("frames") > 1), ignorenulls=True).over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1))  # at most 64 rows
    text = F.concat(F.col("frames").cast("string"), F.lit(" frames held ("), (F.col("frames") - 1).cast("string"), F.lit(" dropped)"))
    note = F.when(F.col("frames") > 1, text).when(F.col("own").isNotNull(), F.when(F.coalesce(before, F.lit(False)), F.lit("recovery swap")).otherwise(F.lit("normal"))).when(F.col("covering") > 0, F.lit("no new frame")).otherwise(F.lit("idle"))
    return rows.select(F.col("t").alias(tick), F.col("own.s").alias("swap"), (F.col("own.d") / 1e6).alias("on_screen_ms"), "frames", note.alias("status"))


DETECTORS: dict[str, tuple[list[str], Callable[[Catalog], Finding | None]]] = {
    "swiftui-over-invalidation": (["swiftui-updates"], over_invalidation),
    "animation-hitches-distribution": (["hitches"], hitch_distribution),
    "swiftui-rebuild-storm": (["swiftui-updates"], rebuild_storm),
    "allocations-growth": (["Allocations/Allocations List"], allocation_growth),
    "hitch-cause-split": (["hitches", "time-sample"], hitch_cause),
    "leak-alloc-without-free": (["Allocations/Allocations List"], unfreed),
    "runloop-contains-body-eval": (["runloop-intervals", "swiftui-updates"], body_in_runloop),
    "fm-prompt-caching-miss": (["ModelInferenceTable"], caching_miss),
    "fm-main-actor-saturation": (["SwiftActorQueueSize"], actor_saturation),
    "outlier-sweep": (["hitches"], outlier_sweep),
    "near-miss-sweep": (["hitches"], near_miss_sweep),
    "render-hitch-sweep": (["hitches-renders"], render_hitch_sweep),
    "qos-classes-mismatch": (["ThreadQoSTable", "runloop-events"], qos_mismatch),
    "thread-priority-inversion": (["ThreadPriority"], priority_inversion),
    "core-data-fetch-n-plus-one": (["core-data-fetch"], n_plus_one),
}


def run_detectors(c: Catalog, names: list[str] | None = None) -> tuple[list[Finding], dict[str, str]]:
    """Findings, the highest score first, and the detectors that failed; those without their tables are skipped."""
    found, failed, there = [], {}, set(c.schemas(c.runs()[-1])) if c.runs() else set()
    for name, (needs, rule) in DETECTORS.items():
        if (names is None or name in names) and set(needs) <= there:
            try:
                if (f := rule(c)) is not None:
                    found.append(f)
            except Exception as e:  # one broken table must not hide the others' findings
                failed[name] = str(e)
    return sorted(found, key=lambda f: -f.score), failed


def eager_schemas(c: Catalog) -> list[str]:
    """The first schemas that detectors need, at most four."""
    wanted = dict.fromkeys(s for needs, _ in DETECTORS.values() for s in needs)
    there = set(c.schemas(c.runs()[-1])) if c.runs() else set()
    return [s for s in wanted if s in there][:EAGER]
