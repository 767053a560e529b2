import pytest
from pyspark.sql import functions as F

from traceloom.model import ROW, Catalog, Column, Table, TableError
from traceloom.operators import aggregate as A
from traceloom.operators import relate as R
from traceloom.operators import rows as Q
from traceloom.operators import timeline as L
from traceloom.plans import predicates as P
from traceloom.plans import roles


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (0, 10, 5, "main", "a", "1", "Yes", 1.0, 3.0),
        (1, 20, 5, "main", "a", "0", "No", 2.0, 2.0),
        (2, 20, 0, "worker", "b", "true", "true", 3.0, 1.0),
        (3, 40, 7, None, None, "false", "false", None, None),
        (4, None, 9, "worker", "", "3", "Yes", 4294967295.0, 4.0),
    ]
    df = spark.createDataFrame(rows, f"{ROW} long, time long, duration long, thread string, kind string, live string, live__fmt string, `event-n` double, other double")
    columns = [Column("time", "start-time"), Column("duration", "duration"), Column("thread", "thread"), Column("kind", "event-type"), Column("live", "boolean"), Column("event-n", "event-count"), Column("other", "weight")]
    return Table("sample", df, columns)


def ids(df):
    return sorted(r["row_idx"] for r in df.collect())


def test_roles(table):
    assert table.time_column() == "time" and table.duration_column() == "duration"
    assert table.thread_column() == "thread" and table.label_column() == "kind"
    assert roles.classify("model-request-id", "string").role == "detail"
    assert roles.classify("total-tokens", "string").unit == "count"
    assert roles.classify("main-thread", "boolean").role == "detail"
    assert roles.facts("string").categorical and not roles.facts("size-in-bytes").categorical and not roles.facts("bit-rate").categorical and roles.facts("row-number").categorical
    assert roles.max_sentinel("start-time") == 2**50 - 1 and roles.max_sentinel("event-count") is None


def test_boolean_vocabularies(table):
    assert ids(Q.query(table, [], {"live": True}, limit=0)) == [0, 2, 4]
    assert ids(Q.query(table, [], {"live": False}, limit=0)) == [1, 3]


def test_number_and_text_equality(table):
    assert ids(Q.query(table, [], {"duration": 5}, limit=0)) == [0, 1]
    assert ids(Q.query(table, [], {"duration": "5", "kind": "a"}, limit=0)) == [0, 1]


def test_time_range_is_inclusive_and_optional(table):
    assert ids(Q.query(table, [], start=20, end=40, limit=0)) == [1, 2, 3]
    timeless = Table("x", table.df, [Column("kind", "event-type")])
    assert len(ids(Q.query(timeless, [], start=20, end=40, limit=0))) == 5


def test_find_nulls_missing_values_and_trees(table):
    find = lambda *w: ids(Q.find(table, list(w), limit=0))
    assert find({"field": "thread", "op": "ne", "val": "main"}) == [2, 4]
    assert find({"field": "thread", "op": "is-null"}) == [3]
    assert find({"field": "duration", "op": "gt"}) == []
    assert find({"anyOf": []}) == [] and len(find({"allOf": []})) == 5
    assert find({"field": "duration", "op": "is-sentinel"}) == [2]
    assert find({"field": "time", "op": "not-sentinel"}) == [0, 1, 2, 3]
    assert find({"field": "event-n", "op": "is-sentinel"}) == [4]
    assert find({"field": "event-n", "op": "lt", "compareCol": "other"}) == [0]
    assert find({"field": "kind", "op": "regex", "val": "^A$"}) == [0, 1]
    assert find({"field": "kind", "op": "not-contains", "val": "a"}) == [2, 4]


@pytest.mark.parametrize("where", [{"field": "kind", "op": "regex", "val": "("}, {"field": "live", "op": "gt", "val": True}, {"field": "nothing", "op": "eq", "val": 1}, {"field": "kind", "op": "is-sentinel"}, {"field": "time", "op": "eq", "val": 1, "compareCol": "duration"}])
def test_bad_conditions(table, where):
    with pytest.raises(TableError):
        Q.find(table, [where])


def test_sort_puts_nulls_first_upwards_and_last_downwards(table):
    assert [r["row_idx"] for r in Q.query(table, [], sort="time").collect()] == [4, 0, 1, 2, 3]
    assert [r["row_idx"] for r in Q.query(table, [], sort="time", descending=True).collect()] == [3, 1, 2, 0, 4]
    assert [r["row_idx"] for r in Q.query(table, [], limit=2, offset=1).collect()] == [1, 2]


def test_windows(table):
    rows = Q.query(table.where(F.col("time").isNotNull()), [], window={"op": "running-total", "orderBy": "time", "measure": "duration", "as": "w"}, limit=0).collect()
    assert [(r["row_idx"], r["w"]) for r in rows] == [(0, 5.0), (1, 10.0), (2, 10.0), (3, 17.0)]  # peers share a total
    rows = Q.query(table, [], window={"op": "delta", "orderBy": "time", "partitionBy": "thread", "as": "w"}, limit=0).collect()
    assert {r["row_idx"]: r["w"] for r in rows}[1] == 10
    with pytest.raises(TableError):
        Q.query(table, [], window={"op": "running-total", "orderBy": "time"})


def test_aggregate(table):
    out = {r["group_key"]: (r["value"], r["row_count"]) for r in A.aggregate(table, "kind", "duration", "sum", top=None).collect()}
    assert out == {"a": (10.0, 2), "b": (0.0, 1), "": (9.0, 1)}  # a null key is in no group
    out = A.aggregate(table, ["thread", "kind"], op="count", top=1).collect()[0]
    assert out["group_key"] == "main / a" and out["value"] == 2
    assert {r["group_key"] for r in A.aggregate(table, "thread", "event-n", "max", top=None).collect()} == {"main", "worker"}
    assert A.totals(table, "thread", "event-n", "max") == {"total_rows": 5, "total_groups": 2, "sentinel_rows": 1}
    for bad in ({"measure": None}, {"measure": "kind"}, {"measure": "duration", "op": "mode"}):
        with pytest.raises(TableError):
            A.aggregate(table, "kind", **bad)


def test_nearest_rank(spark):
    for n in (1, 2, 3, 10, 99, 100, 101):
        df = spark.range(1, n + 1).select(F.col("id").alias(ROW), F.col("id").alias("v"), F.lit("k").alias("kind"))
        t = Table("r", df, [Column("v", "weight"), Column("kind", "event-type")])
        for op, p in (("p50", 50), ("p90", 90), ("p99", 99)):
            assert A.aggregate(t, "kind", "v", op).first()["value"] == -(-p * n // 100)


def test_containment_equals_nested_loop(spark):
    import random

    random.seed(3)
    ivs = [(i, random.randrange(2000), random.choice([0, 1, 3, 50, 900, -4])) for i in range(120)] + [(200, None, 5), (201, 7, None)]
    pts = [(i, random.randrange(-50, 3000)) for i in range(200)] + [(500, None)]
    a, b = spark.createDataFrame(ivs, "r long, s long, d long"), spark.createDataFrame(pts, "p long, t long")
    got = sorted((x["r"], x["p"]) for x in R.containing(a, b, "s", "d", "t").collect())
    assert got == sorted((r, p) for r, s, d in ivs for p, t in pts if None not in (s, d, t) and d >= 0 and s <= t <= s + d)


def test_relation_polarity_partitions_rows(spark, table):
    points = spark.createDataFrame([(0, 12, "main"), (1, 22, "x"), (2, 41, "worker")], f"{ROW} long, time long, thread string")
    b = Table("points", points, [Column("time", "event-time"), Column("thread", "thread")])
    any_thread = R.Relation(table, b, "kind", match_thread=False)
    yes, no = ids(any_thread.rows(True)), ids(any_thread.rows(False))
    assert yes == [0, 1] and no == [2, 4]  # row 3 has no label
    assert ids(R.Relation(table, b, "kind").rows(True)) == [0]
    rows = {r["label"]: r for r in any_thread.groups().collect()}
    assert (rows["a"]["a_count"], rows["a"]["match_count"], rows["b"]["a_unmatched"]) == (2, 2, 1)
    with pytest.raises(TableError):
        R.Relation(table, b, "kind", "equality")


def test_timeline(table):
    out = L.timeline([table, table], 10, 20).collect()
    assert [(r["time"], r["row_idx"]) for r in out] == [(10, 0), (10, 0), (20, 1), (20, 1), (20, 2), (20, 2)]
    with pytest.raises(TableError):
        L.timeline([table], None, None)
    with pytest.raises(TableError):
        L.timeline([Table("x", table.df, [Column("kind", "event-type")])], 0, 1)


def test_get_row_and_notes(table):
    assert Q.get_row(table, 2).first()["kind"] == "b"
    with pytest.raises(TableError):
        Q.get_row(table, 99)
    assert "none of the 5" in Q.empty_note(table, 0)


def test_catalog_positions(spark, table):
    c = Catalog([table, Table("sample", table.df, table.columns, position=2)])
    with pytest.raises(TableError):
        c.get("sample")
    assert c.get("sample", position=2).position == 2
    c.add(Table("later", table.df, table.columns, run=2))
    assert c.get("later").run == 2 and c.instruments()["in_all_runs"] == []


def test_overlap_includes_both_ends(spark, table):
    assert ids(Q.query(table.where(R.overlap_rows(table, 15, 20)), [], limit=0)) == [0, 1, 2]
    assert P.number_text(5.0) == "5"


def test_row_index_over_many_partitions(spark):
    from traceloom.model import with_row_index

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        df = spark.range(0, 60000, 1, 7).selectExpr("(id * 7919) % 60000 AS k", "repeat('x', 40) AS wide", "id % 3 AS _row_place")
        out = with_row_index(df, "k")
        assert out.where("k = _row_idx").count() == 60000 and out.columns == ["k", "wide", "_row_place", "_row_idx"]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_filters_reach_the_scan(spark):
    from traceloom import testdata as D
    from traceloom.operators import rows as Q

    def pushed(df):
        text = df._jdf.queryExecution().executedPlan().toString()
        return text[text.index("PushedFilters") :].split("\n")[0]

    sf = "/root/testdata/sf0.001"
    a = pushed(Q.query(D.lineitems(spark, sf), ["price"], filter={"flag": "R", "line": 3}, limit=0))
    assert "EqualTo(l_returnflag,R)" in a and "EqualTo(l_linenumber,3)" in a
    b = pushed(Q.find(D.lineitems(spark, sf), [{"field": "quantity", "op": "gte", "val": 10}], limit=0))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in b
    c = pushed(Q.query(D.events(spark, sf), ["kind"], start=1_704_067_200 * 10**9, end=1_704_153_600 * 10**9, limit=0))
    assert "GreaterThanOrEqual(ts," in c and "LessThanOrEqual(ts," in c


def test_neighbours_of_64_bit_numbers_differ(spark):
    from traceloom.model import ROW, Column, Table
    from traceloom.operators import rows as Q

    big = 1_704_067_200_000_000_001
    df = spark.createDataFrame([(i, big + i, str(big + i)) for i in range(3)], f"{ROW} long, t long, s string")
    t = Table("x", df, [Column("t", "uint64"), Column("s", "string")])
    assert [Q.query(t, ["t"], filter={c: big}).count() for c in ("t", "s")] == [1, 1]
    assert Q.find(t, [{"field": "t", "op": "ne", "val": big}]).count() == 2
