"""Registered queries over the bundled tables, one per operator, with DuckDB SQL for each.

Every query covers its whole tables; a limit stands only where a page or top list is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from traceloom import testdata as D
from traceloom.functions import expressions as E
from traceloom.model import ROW, Catalog, Column, Table, with_row_index
from traceloom.operators import aggregate as A
from traceloom.operators import detectors as X
from traceloom.operators import relate as R
from traceloom.operators import rows as Q
from traceloom.operators import stacks as S
from traceloom.operators import timeline as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DAY = 86_400 * 10**9
T0 = 1_704_067_200 * 10**9  # 2024-01-01
NS = "epoch_us(ts) * 1000"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def find_query(name: str, table: Callable, where: list[dict], columns: list[str], sql: str, renames: dict | None = None) -> None:
    """A find over a whole table, all rows returned, raw cells."""

    def run(spark, sf):
        out = Q.find(table(spark, sf), where, columns, limit=0, display=False)
        return out.select("row_idx", *(F.col(f"`{c.replace('.', '_')}`").alias((renames or {}).get(c, c.replace(".", "_").replace("-", "_"))) for c in columns))

    run.__name__ = name
    QUERIES[name], ORACLE_SQL[name] = run, sql


# --- query ---------------------------------------------------------------------------


@query("SELECT l_orderkey * 8 + l_linenumber AS row_idx, l_quantity AS quantity, l_extendedprice AS price FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 3 ORDER BY l_extendedprice DESC NULLS LAST, row_idx LIMIT 50 OFFSET 20")
def q_query_filter_sort_page(spark, sf):
    return Q.query(D.lineitems(spark, sf), ["quantity", "price", "no-such-column"], {"flag": "R", "line": 3}, sort="price", descending=True, limit=50, offset=20, display=False)


@query("SELECT o_orderkey AS row_idx, o_orderpriority AS priority, o_totalprice AS price FROM orders ORDER BY o_totalprice ASC NULLS FIRST, row_idx LIMIT 500")
def q_query_sort_ascending(spark, sf):
    return Q.query(D.orders(spark, sf), ["priority", "price"], sort="price", limit=500, display=False)


@query(f"SELECT event_id AS row_idx, {NS} AS time, event_type AS kind FROM events WHERE {NS} BETWEEN {T0 + 3 * DAY} AND {T0 + 9 * DAY}")
def q_query_time_range(spark, sf):
    return Q.query(D.events(spark, sf), ["time", "kind"], start=T0 + 3 * DAY, end=T0 + 9 * DAY, limit=0, display=False)


@query(f"SELECT event_id AS row_idx, {NS} AS time FROM events WHERE {NS} >= {T0 + 20 * DAY}")
def q_query_open_range(spark, sf):
    return Q.query(D.events(spark, sf), ["time"], start=T0 + 20 * DAY, limit=0, display=False)


@query("SELECT doc_id AS row_idx, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0")
def q_query_boolean_truthy(spark, sf):
    return Q.query(D.labels(spark, sf), ["lang"], {"quality": True, "toxic": False}, limit=0, display=False)


@query("SELECT event_id AS row_idx, event_type AS kind, props FROM events WHERE event_type = 'purchase'")
def q_query_display(spark, sf):
    return Q.query(D.events(spark, sf), ["kind", "props"], {"kind": "purchase"}, limit=0)


@query("SELECT event_id AS row_idx, event_type AS kind, value FROM events WHERE user_id = 7")
def q_query_number_filter(spark, sf):
    return Q.query(D.events(spark, sf), ["kind", "value"], {"thread": 7}, limit=0, display=False)


# --- find ----------------------------------------------------------------------------

find_query("q_find_numeric_ops", D.lineitems, [{"field": "quantity", "op": "gte", "val": 10}, {"field": "quantity", "op": "lt", "val": 40}, {"field": "discount", "op": "gt", "val": 0.05}, {"field": "tax", "op": "lte", "val": 0.04}], ["quantity", "discount"], "SELECT l_orderkey * 8 + l_linenumber AS row_idx, l_quantity AS quantity, l_discount AS discount FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount > 0.05 AND l_tax <= 0.04")
find_query("q_find_eq_number", D.lineitems, [{"field": "quantity", "op": "eq", "val": 17}], ["quantity", "price"], "SELECT l_orderkey * 8 + l_linenumber AS row_idx, l_quantity AS quantity, l_extendedprice AS price FROM lineitem WHERE l_quantity = 17")
find_query("q_find_ne", D.orders, [{"field": "status", "op": "ne", "val": "O"}, {"field": "customer", "op": "ne", "val": 10}], ["status", "customer"], "SELECT o_orderkey AS row_idx, o_orderstatus AS status, o_custkey AS customer FROM orders WHERE o_orderstatus <> 'O' AND o_custkey <> 10")
find_query("q_find_contains", D.documents, [{"field": "text", "op": "contains", "val": "the "}], ["lang", "size"], "SELECT doc_id AS row_idx, lang, n_chars AS size FROM documents WHERE contains(text, 'the ')")
find_query("q_find_not_contains", D.documents, [{"field": "text", "op": "not-contains", "val": "the "}], ["lang", "size"], "SELECT doc_id AS row_idx, lang, n_chars AS size FROM documents WHERE NOT contains(text, 'the ')")
find_query("q_find_regex", D.pages, [{"field": "html", "op": "regex", "val": "<h[12]>[a-z]+"}], ["url"], "SELECT page_id AS row_idx, url FROM pages WHERE regexp_matches(html, '<h[12]>[a-z]+', 'i')")
find_query("q_find_null", D.labels, [{"field": "quality", "op": "is-null"}], ["lang"], "SELECT doc_id AS row_idx, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
find_query("q_find_notnull", D.labels, [{"field": "quality", "op": "not-null"}], ["lang", "quality"], "SELECT doc_id AS row_idx, lang, quality FROM documents JOIN labels USING (doc_id)")
find_query("q_find_boolean_ne", D.labels, [{"field": "toxic", "op": "ne", "val": True}], ["lang"], "SELECT doc_id AS row_idx, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 0")
find_query("q_find_sentinel", D.lineitems, [{"field": "marked-time", "op": "is-sentinel"}], ["order"], "SELECT l_orderkey * 8 + l_linenumber AS row_idx, l_orderkey AS \"order\" FROM lineitem WHERE l_linenumber = 1")
find_query("q_find_not_sentinel", D.lineitems, [{"field": "marked-time", "op": "not-sentinel"}], ["order", "line"], "SELECT l_orderkey * 8 + l_linenumber AS row_idx, l_orderkey AS \"order\", l_linenumber AS line FROM lineitem WHERE l_linenumber <> 1")
find_query("q_find_missing_value", D.orders, [{"field": "price", "op": "gt"}], ["price"], "SELECT o_orderkey AS row_idx, o_totalprice AS price FROM orders WHERE false")
find_query("q_find_crosscol", D.lineitems, [{"field": "discount", "op": "gt", "compareCol": "tax"}, {"field": "order", "op": "ne", "compareCol": "line"}], ["discount", "tax"], "SELECT l_orderkey * 8 + l_linenumber AS row_idx, l_discount AS discount, l_tax AS tax FROM lineitem WHERE l_discount > l_tax AND l_orderkey <> l_linenumber")
find_query("q_find_and_or_tree", D.events, [{"anyOf": [{"field": "kind", "op": "eq", "val": "error"}, {"allOf": [{"field": "value", "op": "gt", "val": 50}, {"field": "kind", "op": "contains", "val": "c"}]}]}, {"allOf": []}], ["kind", "value"], "SELECT event_id AS row_idx, event_type AS kind, value FROM events WHERE event_type = 'error' OR (value > 50 AND contains(event_type, 'c'))")
find_query("q_find_empty_or", D.events, [{"anyOf": []}], ["kind"], "SELECT event_id AS row_idx, event_type AS kind FROM events WHERE false")
find_query("q_find_nested_path", D.events, [{"field": "props.k", "op": "gte", "val": 50}], ["kind", "props.k"], "SELECT event_id AS row_idx, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")


@query(f"SELECT event_id AS row_idx, {NS} AS start, CAST(floor(value * 1e9) AS BIGINT) AS duration FROM events WHERE event_type = 'error' AND {NS} <= {T0 + 12 * DAY} AND {NS} + CAST(floor(value * 1e9) AS BIGINT) >= {T0 + 10 * DAY}")
def q_find_overlap(spark, sf):
    t = D.intervals(spark, sf)
    return Q.query(t.where(R.overlap_rows(t, T0 + 10 * DAY, T0 + 12 * DAY)), ["start", "duration"], limit=0, display=False)


@query("SELECT event_id AS row_idx, event_type AS kind FROM events WHERE event_type ILIKE '%Ch%'")
def q_find_like_thread(spark, sf):
    from traceloom.plans.predicates import like_text

    t = D.events(spark, sf)
    return Q.query(t.where(like_text(t.fmt("kind"), "Ch")), ["kind"], limit=0, display=False)


# --- aggregate -----------------------------------------------------------------------


def _agg(name: str, op: str, expr: str, measured: bool = True) -> None:
    def run(spark, sf):
        out = A.aggregate(D.lineitems(spark, sf), "flag", "price" if measured else None, op, top=None)
        return out.select("group_key", F.round("value", 4).alias("value"), "row_count")

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT l_returnflag AS group_key, round({expr}, 4) AS value, count(*) AS row_count FROM lineitem GROUP BY 1"


for _op, _expr in {"sum": "sum(l_extendedprice)", "avg": "avg(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "count": "count(*)::DOUBLE", "p50": "quantile_disc(l_extendedprice, 0.5)", "p90": "quantile_disc(l_extendedprice, 0.9)", "p99": "quantile_disc(l_extendedprice, 0.99)"}.items():
    _agg(f"q_agg_{_op}", _op, _expr, _op != "count")


@query("SELECT event_type AS group_key, quantile_disc(value, 0.95) AS value, count(*) AS row_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q_agg_p95(spark, sf):
    return A.aggregate(D.events(spark, sf), "kind", "value", "p95").select("group_key", "value", "row_count")


@query("SELECT l_returnflag || ' / ' || l_linestatus AS group_key, l_returnflag AS part_1, l_linestatus AS part_2, round(sum(l_quantity), 4) AS value, count(*) AS row_count FROM lineitem GROUP BY l_returnflag, l_linestatus")
def q_agg_composite_key(spark, sf):
    out = A.aggregate(D.lineitems(spark, sf), ["flag", "status"], "quantity", "sum", top=None)
    return out.select("group_key", F.col("key_parts")[0].alias("part_1"), F.col("key_parts")[1].alias("part_2"), F.round("value", 4).alias("value"), "row_count")


@query("SELECT o_custkey::VARCHAR AS group_key, round(sum(o_totalprice), 4) AS value, count(*) AS row_count FROM orders GROUP BY 1 HAVING count(*) >= 12 AND sum(o_totalprice) <= 5e6")
def q_agg_having(spark, sf):
    out = A.aggregate(D.orders(spark, sf), "customer", "price", "sum", top=None, having={"minRowCount": 12, "maxValue": 5e6})
    return out.select("group_key", F.round("value", 4).alias("value"), "row_count")


@query("SELECT o_custkey::VARCHAR AS group_key, round(min(o_totalprice), 4) AS value, count(*) AS row_count FROM orders GROUP BY 1 ORDER BY min(o_totalprice) DESC, 1 LIMIT 25")
def q_agg_topn_of_min(spark, sf):
    return A.aggregate(D.orders(spark, sf), "customer", "price", "min", top=25).select("group_key", F.round("value", 4).alias("value"), "row_count")


@query("SELECT l_returnflag AS group_key, round(sum(l_quantity), 4) AS value, count(*) AS row_count FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1")
def q_agg_sentinel_excluded(spark, sf):
    out = A.aggregate(D.lineitems(spark, sf), "flag", "marked-count", "sum", top=None)
    return out.select("group_key", F.round("value", 4).alias("value"), "row_count")


@query("SELECT CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS group_key, count(*)::DOUBLE AS value, count(*) AS row_count FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def q_agg_null_key_excluded(spark, sf):
    return A.aggregate(D.labels(spark, sf), "quality", op="count", top=None).select("group_key", "value", "row_count")


@query(f"SELECT event_type AS group_key, round(avg(value), 6) AS value, count(*) AS row_count FROM events WHERE {NS} BETWEEN {T0 + 5 * DAY} AND {T0 + 15 * DAY} AND event_type <> '' GROUP BY 1")
def q_agg_time_range(spark, sf):
    out = A.aggregate(D.events(spark, sf), "kind", "value", "avg", top=None, start=T0 + 5 * DAY, end=T0 + 15 * DAY)
    return out.select("group_key", F.round("value", 6).alias("value"), "row_count")


@query("""SELECT source AS group_key, sum(n_chars)::DOUBLE AS value,
  CASE WHEN sum(n_chars) >= 1073741824 THEN printf('%.2f GB', sum(n_chars) / 1073741824.0) WHEN sum(n_chars) >= 1048576 THEN printf('%.2f MB', sum(n_chars) / 1048576.0)
       WHEN sum(n_chars) >= 1024 THEN printf('%.2f KB', sum(n_chars) / 1024.0) ELSE printf('%.0f B', sum(n_chars)::DOUBLE) END AS shown FROM documents GROUP BY 1""")
def q_agg_format_value(spark, sf):
    return A.aggregate(D.documents(spark, sf), "source", "size", "sum", top=None).select("group_key", "value", "shown")


@query("SELECT count(*) AS total_rows, count(DISTINCT l_returnflag) AS total_groups, count(*) FILTER (l_linenumber = 7) AS sentinel_rows FROM lineitem")
def q_agg_totals(spark, sf):
    return spark.createDataFrame([A.totals(D.lineitems(spark, sf), "flag", "marked-count", "sum")], "total_rows long, total_groups long, sentinel_rows long")


# --- windows -------------------------------------------------------------------------


@query("SELECT o_orderkey AS row_idx, round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate), 2) AS total FROM orders")
def q_win_running_total(spark, sf):
    out = Q.query(D.orders(spark, sf), [], window={"op": "running-total", "orderBy": "time", "partitionBy": "priority", "measure": "price", "as": "total"}, limit=0)
    return out.withColumn("total", F.round("total", 2))


@query(f"SELECT event_id AS row_idx, {NS} - lag({NS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events")
def q_win_delta(spark, sf):
    return Q.query(D.events(spark, sf), [], window={"op": "delta", "orderBy": "time", "partitionBy": "thread", "as": "gap"}, limit=0)


@query("SELECT l_orderkey * 8 + l_linenumber AS row_idx, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity) AS place FROM lineitem")
def q_win_rank(spark, sf):
    return Q.query(D.lineitems(spark, sf), [], window={"op": "rank", "orderBy": "quantity", "partitionBy": ["flag", "status"], "as": "place"}, limit=0)


@query("SELECT o_orderkey AS row_idx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders")
def q_win_row_number(spark, sf):
    return Q.query(D.orders(spark, sf), [], window={"op": "row-number", "orderBy": "time", "partitionBy": "customer", "as": "nth"}, limit=0)


# --- relate --------------------------------------------------------------------------

_IVL = f"a AS (SELECT event_id AS r, {NS} AS s, CAST(floor(value * 1e9) AS BIGINT) AS d, user_id AS u, (user_id % 7)::VARCHAR AS label, value FROM events WHERE event_type = 'error'), b AS (SELECT event_id AS r, {NS} AS t, user_id AS u, value FROM events WHERE event_type = 'click')"
_LONG = _IVL.replace("* 1e9", "* 3.6e12")
_MATCH = "m AS (SELECT a.r, count(*) AS n, sum(b.value) AS v FROM a JOIN b ON b.t >= a.s AND b.t <= a.s + a.d GROUP BY a.r)"


def _relation(spark, sf, factor=1e9, **how) -> R.Relation:
    clicks = D.events(spark, sf)
    return R.Relation(D.intervals(spark, sf, "error", factor), clicks, "label", b_filter={"kind": "click"}, **({"match_thread": False} | how))


@query(f"WITH {_IVL}, {_MATCH} SELECT a.r AS row_idx, label FROM a WHERE r IN (SELECT r FROM m)")
def q_rel_range_exists(spark, sf):
    return _relation(spark, sf).rows(True, None)


@query(f"WITH {_IVL}, {_MATCH} SELECT a.r AS row_idx, label FROM a WHERE r NOT IN (SELECT r FROM m)")
def q_rel_range_not_exists(spark, sf):
    return _relation(spark, sf).rows(False, None)


@query(f"WITH {_LONG} SELECT a.r AS row_idx, label FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.u = a.u AND b.t >= a.s AND b.t <= a.s + a.d)")
def q_rel_range_thread(spark, sf):
    return _relation(spark, sf, 3.6e12, match_thread=True).rows(True, None)


@query(f"WITH {_IVL}, {_MATCH} SELECT label, count(*) AS a_count, coalesce(sum(n), 0)::BIGINT AS match_count, count(n) AS a_matched, count(*) - count(n) AS a_unmatched, round(sum(v), 4) AS measure_sum FROM a LEFT JOIN m USING (r) GROUP BY 1")
def q_rel_group_counts(spark, sf):
    return _relation(spark, sf, measure="value").groups(True).withColumn("measure_sum", F.round("measure_sum", 4))


@query(f"WITH {_IVL}, {_MATCH} SELECT label, count(*) AS a_count, coalesce(sum(n), 0)::BIGINT AS match_count, count(n) AS a_matched, count(*) - count(n) AS a_unmatched, round(sum(CASE WHEN n IS NULL THEN value END), 4) AS measure_sum FROM a LEFT JOIN m USING (r) GROUP BY 1")
def q_rel_measure_not_exists(spark, sf):
    return _relation(spark, sf, measure="value").groups(False).withColumn("measure_sum", F.round("measure_sum", 4))


@query(f"WITH {_IVL}, {_MATCH} SELECT label, count(*) AS windows, coalesce(sum(n), 0)::BIGINT AS events_inside, count(n) AS windows_with_events, round(sum(v), 4) AS measure_inside FROM a LEFT JOIN m USING (r) GROUP BY 1 ORDER BY events_inside DESC, label LIMIT 10")
def q_correlate(spark, sf):
    out = R.correlate(D.intervals(spark, sf), D.events(spark, sf), "label", "value", b_filter={"kind": "click"}, match_thread=False)
    return out.withColumn("measure_inside", F.round("measure_inside", 4))


def _equal(spark, sf) -> R.Relation:
    return R.Relation(D.orders(spark, sf), D.lineitems(spark, sf), "priority", "equality", [("key", "order")], measure="price", b_filter={"flag": "R"})


@query("SELECT o_orderkey AS row_idx, o_orderpriority AS label FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q_rel_equality_exists(spark, sf):
    return _equal(spark, sf).rows(True, None)


@query("SELECT o_orderkey AS row_idx, o_orderpriority AS label FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q_rel_equality_not_exists(spark, sf):
    return _equal(spark, sf).rows(False, None)


@query("WITH m AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderpriority AS label, count(*) AS a_count, sum(coalesce(n, 0))::BIGINT AS match_count, count(n) AS a_matched, count(*) - count(n) AS a_unmatched, round(sum(v), 2) AS measure_sum FROM orders LEFT JOIN m ON k = o_orderkey GROUP BY 1")
def q_rel_equality_counts(spark, sf):
    return _equal(spark, sf).groups(True).withColumn("measure_sum", F.round("measure_sum", 2))


@query("SELECT user_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_kind FROM events GROUP BY 1")
def q_lastwins_join(spark, sf):
    out = R.last_by(D.read(spark, sf, "events"), "user_id", "event_id", ["event_id", "event_type"])
    return out.select("user_id", F.col("event_id").alias("last_event"), F.col("event_type").alias("last_kind"))


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY 1")
def q_firstmatch_lookup(spark, sf):
    return D.read(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"))


@query(f"WITH a AS (SELECT event_id AS r, {NS} AS t FROM events WHERE event_type = 'error'), b AS (SELECT {NS} AS u FROM events WHERE event_type = 'click') SELECT r, t, min(u) AS u FROM a LEFT JOIN b ON u BETWEEN t - 60000000000 AND t + 60000000000 GROUP BY 1, 2")
def q_rel_nearest_within(spark, sf):
    e = D.events(spark, sf).df
    a = e.where("kind = 'error'").select(F.col(ROW).alias("r"), F.col("time").alias("t"))
    return R.nearest_within(a, e.where("kind = 'click'").select(F.col("time").alias("u")), "t", "u", 60 * 10**9, "r")


# --- timeline, rows ------------------------------------------------------------------


@query(f"""SELECT * FROM (SELECT 'events' AS origin, {NS} AS time, NULL::BIGINT AS duration, event_type AS label, event_id AS row_idx FROM events WHERE {NS} BETWEEN {T0 + DAY} AND {T0 + 4 * DAY}
  UNION ALL SELECT 'error-intervals', {NS}, CAST(floor(value * 1e9) AS BIGINT), (user_id % 7)::VARCHAR, event_id FROM events WHERE event_type = 'error' AND {NS} BETWEEN {T0 + DAY} AND {T0 + 4 * DAY}) ORDER BY time, origin, row_idx LIMIT 1000""")
def q_timeline_merge(spark, sf):
    return L.timeline([D.events(spark, sf), D.intervals(spark, sf)], T0 + DAY, T0 + 4 * DAY, 1000)


@query("SELECT event_id AS row_idx, event_type AS kind FROM events WHERE event_id = 42")
def q_get_row(spark, sf):
    return Q.get_row(D.events(spark, sf), 42).select("row_idx", "kind")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS _row_idx FROM orders")
def q_row_idx_dense(spark, sf):
    return with_row_index(D.read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", ROW)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS _row_idx FROM lineitem")
def q_row_idx_lineitem(spark, sf):
    return with_row_index(D.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate", "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", ROW)


@query("SELECT event_id AS row_idx, 1704067200000000000 + event_id AS key FROM events WHERE event_id IN (7, 8, 9) OR event_id >= 500 AND event_id <= 600")
def q_find_64_bit_key(spark, sf):
    df = D.read(spark, sf, "events").select(F.col("event_id").alias(ROW), (F.lit(T0) + F.col("event_id")).alias("key"))
    wanted = [{"field": "key", "op": "eq", "val": T0 + k} for k in (7, 8, 9)]
    where = [{"anyOf": [*wanted, {"allOf": [{"field": "key", "op": "gte", "val": T0 + 500}, {"field": "key", "op": "lte", "val": T0 + 600}]}]}]
    return Q.find(Table("keys", df, [Column("key", "uint64")]), where, limit=0, display=False)


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '… [truncated — ' || length(text) || ' chars total]' ELSE text END AS cell FROM documents")
def q_cell_truncate(spark, sf):
    return D.read(spark, sf, "documents").select("doc_id", E.shown_cell(F.col("text")).alias("cell"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS snippet FROM conversations")
def q_snippet(spark, sf):
    return D.read(spark, sf, "conversations").select("conv_id", "turn", E.snippet(F.col("text")).alias("snippet"))


@query("SELECT event_id, CASE WHEN floor(value) * 10 >= 1e3 THEN printf('%.2f µs', floor(value) / 1e2) ELSE printf('%.0f ns', floor(value) * 10) END AS shown FROM events")
def q_format_ns(spark, sf):
    return D.read(spark, sf, "events").select("event_id", E.format_ns(F.floor("value") * 10).alias("shown"))


@query("SELECT doc_id, (contains(lower(source), 'src1'))::INT + (contains(lower(source), '3'))::INT AS score FROM documents ORDER BY score DESC, doc_id LIMIT 10")
def q_find_trace_rank(spark, sf):
    docs = D.read(spark, sf, "documents")
    return docs.select("doc_id", E.word_score(F.col("source"), ["SRC1", "3"]).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("WITH m AS (SELECT event_id, 'ev,' || event_type || ',' || user_id || ',x::' || props AS message FROM events) SELECT event_id, split_part(split_part(message, '::', 1), ',', 3) AS request, CAST(json_extract(substr(message, instr(message, '::') + 2), '$.k') AS BIGINT) AS k FROM m")
def q_message_parse(spark, sf):
    m = D.read(spark, sf, "events").select("event_id", F.concat(F.lit("ev,"), "event_type", F.lit(","), F.col("user_id").cast("string"), F.lit(",x::"), "props").alias("message"))
    head, tail = F.split(F.substring_index("message", "::", 1), ","), F.expr("substring(message, instr(message, '::') + 2)")
    return m.select("event_id", F.get(head, F.lit(2)).alias("request"), F.get_json_object(tail, "$.k").cast("long").alias("k"))


@query(f"SELECT user_id, min(CASE WHEN event_type = 'view' THEN {NS} END) AS viewed, min(CASE WHEN event_type = 'click' THEN {NS} END) AS clicked, min(CASE WHEN event_type = 'purchase' THEN {NS} END) AS bought, min(CASE WHEN event_type = 'purchase' THEN {NS} END) - min(CASE WHEN event_type = 'view' THEN {NS} END) AS total_ns FROM events GROUP BY 1")
def q_fm_timing_messages(spark, sf):
    from traceloom.operators.lenses import first_times

    e = D.events(spark, sf).df.select(F.col("thread").alias("user_id"), "kind", "time")
    out = first_times(e, "user_id", "kind", "time", {"viewed": "view", "clicked": "click", "bought": "purchase"})
    return out.withColumn("total_ns", F.col("bought") - F.col("viewed"))


@query("WITH e AS (SELECT user_id::VARCHAR AS request, event_id, event_type, epoch_us(ts) * 1000 AS t, json_extract(props, '$.k')::DOUBLE AS k FROM events), f AS (SELECT request, arg_min(t, event_id) FILTER (event_type = 'view') AS a, arg_min(t, event_id) FILTER (event_type = 'click') AS b, arg_min(t, event_id) FILTER (event_type = 'purchase') AS c, arg_min(k, event_id) FILTER (event_type = 'purchase') AS k FROM e GROUP BY 1) SELECT request, (b - a) / 1e6 AS prefill_ms, (c - b) / 1e6 AS generation_ms, (c - a) / 1e6 AS total_ms, k AS deltas FROM f")
def q_fm_request_timing(spark, sf):
    from traceloom.operators.lenses import request_timing

    event = F.when(F.col("kind") == "view", "request_start").when(F.col("kind") == "click", "response_start").when(F.col("kind") == "purchase", "response_complete").otherwise("other")
    message = F.concat(F.lit("TX,"), F.col(ROW).cast("string"), F.lit(","), F.col("thread").cast("string"), F.lit(',1,2::{"event": "'), event, F.lit('", "data": {"deltasCount": '), F.coalesce(F.col("props.k").cast("string"), F.lit("null")), F.lit("}}"))
    table = Table("FMEventTable", D.events(spark, sf).df.select(ROW, F.col("time").alias("timestamp"), message.alias("message")), [Column("timestamp", "event-time"), Column("message", "string")])
    return request_timing(table).select("request", "prefill_ms", "generation_ms", "total_ms", "deltas")


# --- call stacks ---------------------------------------------------------------------

_STACK = "s AS (SELECT [r_name, n_name, c_mktsegment, o_orderpriority] AS p, CAST(round(o_totalprice) AS BIGINT)::DOUBLE AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_NODES = f"{_STACK}, n AS (SELECT list_aggregate(p[1:d], 'string_agg', ' > ') AS node, coalesce(list_aggregate(p[1:d-1], 'string_agg', ' > '), '') AS parent, p[d] AS name, d AS depth, sum(w) AS total_weight, sum(CASE WHEN d = 4 THEN w ELSE 0 END) AS self_weight, count(*) AS samples FROM s, (SELECT unnest([1, 2, 3, 4]) AS d) GROUP BY ALL)"


@query(f"WITH {_NODES} SELECT node, parent, name, depth::INT AS depth, total_weight, self_weight, samples FROM n")
def q_call_tree_nodes(spark, sf):
    return S.fold(D.stacks(spark, sf), weight="weight").nodes().drop("key", "above")


@query(f"WITH {_STACK}, t AS (SELECT [p[1] || ' > ' || p[2], p[3]] AS p, w FROM s) SELECT list_aggregate(p[1:d], 'string_agg', ' > ') AS node, p[d] AS name, d::INT AS depth, sum(w) AS total_weight, sum(CASE WHEN d = 2 THEN w ELSE 0 END) AS self_weight, count(*) AS samples FROM t, (SELECT unnest([1, 2]) AS d) GROUP BY ALL")
def q_call_tree_separator_in_name(spark, sf):
    stacks = S.fold(D.stacks(spark, sf), weight="weight").stacks.select(F.array(F.concat_ws(" > ", F.get("path", F.lit(0)), F.get("path", F.lit(1))), F.get("path", F.lit(2))).alias("path"), "weight", "samples")
    return S.Folded(stacks).tree(max_depth=40, top=50).select("node", "name", "depth", "total_weight", "self_weight", "samples")


@query(f"""WITH {_NODES}, k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY total_weight DESC, name) AS nth, count(*) OVER (PARTITION BY parent) AS sib FROM n WHERE depth <= 3),
t AS (SELECT * FROM k WHERE nth <= 3)
SELECT node, depth::INT AS depth, name, total_weight, self_weight, samples, round(total_weight * 100 / (SELECT sum(w) FROM s), 1) AS percent, sib - least(sib, 3) AS siblings_omitted FROM t
WHERE depth = 1 OR (depth = 2 AND parent IN (SELECT node FROM t WHERE depth = 1)) OR (depth = 3 AND parent IN (SELECT node FROM t WHERE depth = 2 AND parent IN (SELECT node FROM t WHERE depth = 1)))""")
def q_call_tree_tree(spark, sf):
    return S.fold(D.stacks(spark, sf), weight="weight").tree(3, 3)


@query(f"WITH {_STACK}, x AS (SELECT unnest(list_distinct(p)) AS name, p[4] AS leaf, w FROM s) SELECT name, sum(CASE WHEN name = leaf THEN w ELSE 0 END) AS self_weight, sum(w) AS total_weight, count(*) AS samples, false AS is_wait FROM x GROUP BY 1")
def q_call_tree_hot(spark, sf):
    return S.fold(D.stacks(spark, sf), weight="weight").hot(None)


@query(f"""WITH {_NODES}, d1 AS (SELECT * FROM n WHERE depth = 1 ORDER BY total_weight DESC LIMIT 1), d2 AS (SELECT n.* FROM n JOIN d1 ON n.parent = d1.node ORDER BY n.total_weight DESC LIMIT 1),
d3 AS (SELECT n.* FROM n JOIN d2 ON n.parent = d2.node ORDER BY n.total_weight DESC LIMIT 1), d4 AS (SELECT n.* FROM n JOIN d3 ON n.parent = d3.node ORDER BY n.total_weight DESC LIMIT 1)
SELECT depth::INT AS depth, name, total_weight FROM (FROM d1 UNION ALL FROM d2 UNION ALL FROM d3 UNION ALL FROM d4)""")
def q_call_tree_spine(spark, sf):
    steps = S.fold(D.stacks(spark, sf), weight="weight").spine(full=True)
    return spark.createDataFrame([(s["depth"], s["name"], s["total_weight"]) for s in steps], "depth int, name string, total_weight double")


@query(f"WITH s AS (SELECT [r_name, n_name, c_mktsegment, o_orderpriority] AS p, CAST(round(o_totalprice) AS BIGINT)::DOUBLE AS w FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment ILIKE '%build%'), x AS (SELECT unnest(list_distinct(p)) AS name, w FROM s) SELECT name, sum(w) AS total_weight FROM x GROUP BY 1")
def q_call_tree_thread(spark, sf):
    return S.fold(D.stacks(spark, sf), thread="build", weight="weight").hot(None).select("name", "total_weight")


# --- detectors -----------------------------------------------------------------------


@query(f"WITH g AS (SELECT user_id AS label, {NS} - lag({NS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT label, count(*) AS n FROM g WHERE d > 0 AND d < {3600 * 10**9} GROUP BY 1")
def q_storm_detector(spark, sf):
    e = D.events(spark, sf).df.select(F.col("thread").alias("label"), "time", ROW)
    return X.dense_gaps(e, "label", "time", ROW, 3600 * 10**9)


@query("SELECT round(max(t), 2) AS peak FROM (SELECT sum(o_totalprice) OVER (ORDER BY o_orderdate) AS t FROM orders)")
def q_growth_detector(spark, sf):
    return X.peak_total(D.orders(spark, sf).df, "time", ROW, "price").select(F.round("peak", 2).alias("peak"))


@query(f"WITH {_IVL}, {_MATCH} SELECT label, count(*) AS n FROM a WHERE r NOT IN (SELECT r FROM m) GROUP BY 1")
def q_gpu_bound_detector(spark, sf):
    return X.contained(D.intervals(spark, sf).df, _clicks(spark, sf), "start", "duration", "point", ROW, exists=False).groupBy("label").agg(F.count("*").alias("n"))


def _clicks(spark, sf) -> DataFrame:
    return D.events(spark, sf).df.where("kind = 'click'").select(F.col("time").alias("point"))


@query(f"WITH {_IVL}, {_MATCH} SELECT label, count(*) AS n FROM a WHERE r IN (SELECT r FROM m) GROUP BY 1")
def q_contains_detector(spark, sf):
    return X.contained(D.intervals(spark, sf).df, _clicks(spark, sf), "start", "duration", "point", ROW).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (value > 50) AS over_low, count(*) FILTER (value > 100) AS over_high, count(*) FILTER (value BETWEEN 50 AND 100) AS between_, max(value) AS worst FROM events WHERE event_type = 'error'")
def q_outlier_sweep(spark, sf):
    return X.band_counts(D.events(spark, sf).df.where("kind = 'error'"), "value", 50, 100).withColumnRenamed("between", "between_").drop("worst_between")


@query("SELECT o_custkey AS label, count(*) AS n, round(sum(o_totalprice), 2) AS total, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS longest_row FROM orders GROUP BY 1 HAVING count(*) > 10")
def q_over_invalidation(spark, sf):
    o = D.orders(spark, sf).df.select(F.col("customer").alias("label"), "price", ROW)
    return X.top_label(o, "label", "price", ROW).where("n > 10").withColumn("total", F.round("total", 2))


@query("SELECT o_custkey AS customer, count(*) AS calls, round(avg(n), 6) AS average FROM (SELECT o_custkey, o_orderkey, count(*) FILTER (l_returnflag = 'R') AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 20 AND avg(n) < 2")
def q_n_plus_one(spark, sf):
    li = D.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n"))
    rows = D.read(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("customer"), "n")
    return X.n_plus_one_groups(rows, "customer", "n").withColumn("average", F.round("average", 6))


@query("SELECT event_type AS kind, count(*) FILTER (value > 32) AS n, count(*) FILTER (value > 32 AND user_id % 2 = 0) AS misses, round(count(*) FILTER (value > 32 AND user_id % 2 = 0) / count(*) FILTER (value > 32), 6) AS rate FROM events GROUP BY 1")
def q_cache_miss(spark, sf):
    big = F.col("value") > 32
    out = D.events(spark, sf).df.groupBy("kind").agg(F.count_if(big).alias("n"), F.count_if(big & (F.col("thread") % 2 == 0)).alias("misses"))
    return out.withColumn("rate", F.round(F.col("misses") / F.col("n"), 6))


@query(f"WITH g AS (SELECT event_type AS kind, {NS} AS t, {NS} - lag({NS}) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events) SELECT kind, count(*) AS rows, median(CASE WHEN gap > 0 THEN gap END) AS gap FROM g GROUP BY 1 HAVING count(*) >= 5")
def q_frame_budget(spark, sf):
    return X.median_gap(D.events(spark, sf).df.select("kind", F.col("time").alias("t")), "kind", "t")


@query("SELECT event_type AS kind, round(exp((ln(greatest(count(*) / 10.0, 1e-9)) + ln(greatest(max(value) / 50.0, 1e-9))) / 2), 6) AS score FROM events GROUP BY 1")
def q_detector_score(spark, sf):
    out = D.events(spark, sf).df.groupBy("kind").agg(F.count("*").alias("n"), F.max("value").alias("worst"))
    return out.select("kind", F.round(X.score([F.col("n") / 10.0, F.col("worst") / 50.0]), 6).alias("score"))


@query("SELECT event_type AS kind, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def q_percentile_detector(spark, sf):
    return D.events(spark, sf).df.groupBy("kind").agg(E.nearest_rank("value", 0.95).alias("p95"), E.nearest_rank("value", 0.99).alias("p99"))


def _finding(spark, found: X.Finding | None) -> DataFrame:
    """A row per metric of a finding, none if the detector is silent."""
    rows = [(found.detector, name, float(value), found.row) for name, value, _ in found.metrics] if found else []
    return spark.createDataFrame(rows, "detector string, metric string, value double, row_idx long")


def _catalog(schema: str, df: DataFrame, columns: dict[str, str]) -> Catalog:
    return Catalog([Table(schema, df, [Column(m, kind) for m, kind in columns.items()])])


def _hitches(spark, sf, schema: str = "hitches") -> Catalog:
    df = D.events(spark, sf).df.where("kind = 'error'").select(ROW, F.col("time").alias("start"), F.floor(F.col("value") * 1e6).alias("duration"), F.when(F.col("thread") % 2 == 0, F.lit("No")).otherwise(F.lit("Yes")).alias("is-system"))
    return _catalog(schema, df, {"start": "start-time", "duration": "duration", "is-system": "boolean"})


_HITCHES = "h AS (SELECT event_id AS r, floor(value * 1e6) / 1e6 AS ms, user_id % 2 = 0 AS app FROM events WHERE event_type = 'error'), b AS (SELECT 1000 / 60.0::DOUBLE AS b)"


@query(f"WITH {_HITCHES} SELECT 'near-miss-sweep' AS detector, 'near misses' AS metric, count(*)::DOUBLE AS value, arg_max(r, (ms, -r)) AS row_idx FROM h, b WHERE app AND ms BETWEEN 0.5 * b AND b HAVING count(*) > 5")
def q_detector_near_miss(spark, sf):
    return _finding(spark, X.near_miss_sweep(_hitches(spark, sf)))


_OVER = "o AS (SELECT count(*) FILTER (ms > low) AS n1, count(*) FILTER ({high}) AS n2, count(*) AS n, arg_max(r, (ms, -r)) AS w FROM g) SELECT '{name}' AS detector, '{one}' AS metric, n1::DOUBLE AS value, w AS row_idx FROM o WHERE n >= 5 AND n1 > 5 UNION ALL SELECT '{name}', '{two}', n2::DOUBLE, w FROM o WHERE n >= 5 AND n2 > 1"


@query(f"WITH {_HITCHES}, g AS (SELECT r, ms, b AS low FROM h, b WHERE app), " + _OVER.format(high="ms > 2 * low", name="outlier-sweep", one="over budget", two="over twice the budget"))
def q_detector_outliers(spark, sf):
    return _finding(spark, X.outlier_sweep(_hitches(spark, sf)))


@query(f"WITH {_HITCHES}, g AS (SELECT r, ms, b / 2 AS low FROM h, b), " + _OVER.format(high="ms >= 2 * low", name="render-hitch-sweep", one="over the baseline", two="twice the baseline"))
def q_detector_render_hitches(spark, sf):
    return _finding(spark, X.render_hitch_sweep(_hitches(spark, sf, "hitches-renders")))


@query(f"WITH {_HITCHES}, p AS (SELECT count(*) AS n, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, arg_max(r, ms) AS w FROM h WHERE app) SELECT 'animation-hitches-distribution' AS detector, 'p95 ms' AS metric, p95 AS value, w AS row_idx FROM p, b WHERE n >= 5 AND p95 > 2 * b UNION ALL SELECT 'animation-hitches-distribution', 'p99 ms', p99, w FROM p, b WHERE n >= 5 AND p99 > 3 * b")
def q_detector_hitch_distribution(spark, sf):
    return _finding(spark, X.hitch_distribution(_hitches(spark, sf)))


@query("WITH c AS (SELECT count(*) AS n, count(*) FILTER (user_id % 4 < 3) AS m FROM events WHERE floor(value) > 32) SELECT 'fm-prompt-caching-miss' AS detector, 'misses' AS metric, m::DOUBLE AS value, NULL::BIGINT AS row_idx FROM c WHERE m > 10 AND m / n > 0.5 UNION ALL SELECT 'fm-prompt-caching-miss', 'miss rate', m / n, NULL FROM c WHERE m > 10 AND m / n > 0.5")
def q_detector_caching_miss(spark, sf):
    df = D.events(spark, sf).df.select(ROW, F.floor("value").alias("total-tokens"), F.when(F.col("thread") % 4 < 3, F.lit(0)).alias("cached-tokens"))
    return _finding(spark, X.caching_miss(_catalog("ModelInferenceTable", df, {"total-tokens": "uint64", "cached-tokens": "uint64"})))


@query("WITH p AS (SELECT max(floor(value * 2e6)) AS worst, arg_max(event_id, floor(value * 2e6)) AS r FROM events WHERE user_id % 5 < 3 AND floor(value * 2e6) > 50e6) SELECT 'thread-priority-inversion' AS detector, 'longest inversion ms' AS metric, worst / 1e6 AS value, r AS row_idx FROM p WHERE worst IS NOT NULL")
def q_detector_priority_inversion(spark, sf):
    df = D.events(spark, sf).df.select(ROW, F.col("time").alias("start"), F.floor(F.col("value") * 2e6).alias("duration"), (F.col("thread") % 5).alias("scheduled-priority"), F.lit(3).alias("base-priority"))
    return _finding(spark, X.priority_inversion(_catalog("ThreadPriority", df, {"start": "start-time", "duration": "duration", "scheduled-priority": "sched-priority", "base-priority": "sched-priority"})))


@query("WITH p AS (SELECT count(*) AS n, sum(floor(value * 1e5)) AS bytes, arg_max(event_id, floor(value * 1e5)) AS r FROM events WHERE user_id % 3 > 0) SELECT 'leak-alloc-without-free' AS detector, 'live allocations' AS metric, n::DOUBLE AS value, r AS row_idx FROM p WHERE n > 1000 AND bytes > 10e6 UNION ALL SELECT 'leak-alloc-without-free', 'live bytes', bytes::DOUBLE, r FROM p WHERE n > 1000 AND bytes > 10e6")
def q_detector_unfreed(spark, sf):
    df = D.events(spark, sf).df.select(ROW, F.col("time").alias("timestamp"), F.floor(F.col("value") * 1e5).alias("size"), F.when(F.col("thread") % 3 > 0, F.lit("true")).otherwise(F.lit("false")).alias("live"))
    return _finding(spark, X.unfreed(_catalog("Allocations/Allocations List", df, {"timestamp": "start-time", "size": "size-in-bytes", "live": "boolean"})))


@query("WITH p AS (SELECT max(floor(value)) AS deepest, count(*) FILTER (floor(value) > 10) AS n, arg_max(event_id, floor(value)) AS r FROM events WHERE true) SELECT 'fm-main-actor-saturation' AS detector, 'queue depth' AS metric, deepest::DOUBLE AS value FROM p WHERE n > 20 UNION ALL SELECT 'fm-main-actor-saturation', 'samples', n::DOUBLE FROM p WHERE n > 20")
def q_detector_actor_saturation(spark, sf):
    df = D.events(spark, sf).df.select(ROW, F.col("time").alias("start"), F.floor("value").alias("count"))
    return _finding(spark, X.actor_saturation(_catalog("SwiftActorQueueSize", df, {"start": "start-time", "count": "event-count"}))).drop("row_idx")  # several rows are as deep


# --- lenses and catalogue ------------------------------------------------------------


@query("SELECT count(*) FILTER (m IS NULL)::BIGINT AS unattributed, count(*) AS total FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def q_lens_unattributable(spark, sf):
    from traceloom.operators.lenses import unattributed

    leaks = D.read(spark, sf, "customer").select(F.col("c_custkey").alias("address"))
    allocs = D.read(spark, sf, "orders").select(F.col("o_custkey").alias("address"), F.col("o_orderkey").alias("row"), F.col("o_orderpriority").alias("site"))
    return unattributed(leaks, allocs, "address", "row", ["site"])


@query("SELECT o_orderpriority AS group_key, sum(floor(o_totalprice))::DOUBLE AS value, count(*) AS row_count FROM orders GROUP BY 1")
def q_lens_hangs(spark, sf):
    from traceloom.operators.lenses import hangs

    df = D.orders(spark, sf).df.select(ROW, F.col("time").alias("start"), F.floor("price").alias("duration"), F.col("priority").alias("hang-type"))
    return hangs(Table("potential-hangs", df, [Column("start", "start-time"), Column("duration", "duration"), Column("hang-type", "event-concept")])).select("group_key", "value", "row_count")


@query("SELECT count(*) AS open_at_start FROM events WHERE user_id % 10 = 0")
def q_lens_open_at_start(spark, sf):
    from traceloom.operators.lenses import AT_START, open_at_start

    df = D.events(spark, sf).df.select(ROW, "time", F.when(F.col("thread") % 10 == 0, F.lit(AT_START)).otherwise(F.lit("00:01.000.000")).alias("time__fmt"))
    return open_at_start(Table("network-connection-update", df, [Column("time", "event-time")]))


@query("SELECT event_id AS row_idx, event_type AS category FROM events WHERE user_id % 2 = 0 AND event_type IN ('error', 'click')")
def q_lens_runtime_issues(spark, sf):
    from traceloom.operators.lenses import runtime_issues

    df = D.events(spark, sf).df.select(ROW, "time", F.lit("com.example.issues").alias("subsystem"), F.when(F.col("thread") % 2 == 0, F.lit("Fault")).otherwise(F.lit("Default")).alias("message-type"), F.col("kind").alias("category"))
    table = Table("os-log", df, [Column("time", "event-time"), Column("subsystem", "subsystem"), Column("message-type", "event-type"), Column("category", "category")])
    return runtime_issues(table, "com.example.issues", "Fault", ["error", "click"], columns=["category"], limit=0)


@query("SELECT event_id AS row_idx FROM events WHERE event_type = 'view' AND user_id % 3 = 0")
def q_lens_busy_main_turns(spark, sf):
    from traceloom.operators.lenses import busy_main_turns

    df = D.events(spark, sf).df.select(ROW, F.col("time").alias("start"), F.when(F.col("kind") == "view", F.lit("Busy")).otherwise(F.lit("Waiting")).alias("interval-type"), F.when(F.col("thread") % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("is-main"))
    table = Table("runloop-intervals", df, [Column("start", "start-time"), Column("interval-type", "event-type"), Column("is-main", "boolean")])
    return busy_main_turns(table, columns=[], limit=0)


@query(f"WITH i AS (SELECT event_id AS r, {NS} AS a, {NS} + floor(value * 1e9)::BIGINT AS z FROM events WHERE event_type = 'error' AND user_id % 7 = 3) SELECT r AS row_idx, least(z, {T0 + 20 * DAY}) - greatest(a, {T0 + DAY}) AS delay_ns FROM i WHERE a <= {T0 + 20 * DAY} AND z >= {T0 + DAY} AND least(z, {T0 + 20 * DAY}) - greatest(a, {T0 + DAY}) >= 1000000 ORDER BY delay_ns DESC, row_idx LIMIT 1")
def q_off_cpu_scheduling_delay(spark, sf):
    from traceloom.operators.off_cpu import scheduling_delay

    df = D.intervals(spark, sf).df.select(ROW, "start", "duration", F.when(F.col("label") == "3", F.lit("Runnable")).otherwise(F.lit("Running")).alias("state"))
    table = Table("thread-state", df, [Column("start", "start-time"), Column("duration", "duration"), Column("state", "thread-state")])
    return scheduling_delay(table, T0 + DAY, T0 + 20 * DAY)


@query("SELECT doc_id AS row_idx, lang, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS snippet FROM documents ORDER BY doc_id LIMIT 200 OFFSET 50")
def q_lens_list_requests(spark, sf):
    from traceloom.operators.lenses import list_requests

    return list_requests(D.documents(spark, sf), "text", ["lang"], limit=200, offset=50)


@query(None)
def q_describe_roles(spark, sf):
    from traceloom.operators.catalog import describe

    return describe(spark, D.catalog(spark, sf))


@query(None)
def q_schema_edges(spark, sf):
    from traceloom.operators.catalog import edges

    rows = [(e.a, e.b, e.kind, str(e.keys)) for e in edges(D.catalog(spark, sf))]
    return spark.createDataFrame(rows, "schema_a string, schema_b string, kind string, on string")
