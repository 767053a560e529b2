"""The bundled tables as tables of cells.

Times are nanoseconds as BIGINT.  Row indexes are the tables' dense keys.
"""

from __future__ import annotations

from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.model import ROW, Catalog, Column, Table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(c: str) -> Expr:
    """Nanoseconds of a timestamp without zone, read as UTC whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c}) * 1000L")


def events(spark: SparkSession, sf_dir: str) -> Table:
    """Point events: when, who, what, how much, and a nested cell."""
    props = F.struct(F.get_json_object("props", "$.k").try_cast("long").alias("k")).alias("props")
    df = read(spark, sf_dir, "events").select(F.col("event_id").alias(ROW), ns("ts").alias("time"), F.expr("cast(ts AS timestamp_ntz)").alias("time__at"), F.col("user_id").alias("thread"), F.col("event_type").alias("kind"), "value", props, F.col("props").alias("props__fmt"))
    return Table("events", df, [Column("time", "event-time"), Column("thread", "thread"), Column("kind", "event-type"), Column("value", "weight"), Column("props", "narrative")], hints={"roles": {"value": ("weight", "count")}})


def intervals(spark: SparkSession, sf_dir: str, kind: str = "error", factor: float = 1e9) -> Table:
    """Events of a kind as intervals, as long as their value, in nanoseconds times factor / 1e9."""
    df = read(spark, sf_dir, "events").where(F.col("event_type") == kind)
    df = df.select(F.col("event_id").alias(ROW), ns("ts").alias("start"), F.floor(F.col("value") * F.lit(factor)).cast("long").alias("duration"), F.col("user_id").alias("thread"), F.pmod("user_id", F.lit(7)).cast("string").alias("label"), "value")
    return Table(f"{kind}-intervals", df, [Column("start", "start-time"), Column("duration", "duration"), Column("thread", "thread"), Column("label", "event-type"), Column("value", "weight")])


def orders(spark: SparkSession, sf_dir: str) -> Table:
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(ROW), F.col("o_orderkey").alias("key"), ns("o_orderdate").alias("time"), F.expr("cast(o_orderdate AS timestamp_ntz)").alias("time__at"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    return Table("orders", df, [Column("key", "uint64"), Column("time", "event-time"), Column("customer", "uint64"), Column("status", "event-type"), Column("priority", "event-type"), Column("price", "weight")])


def lineitems(spark: SparkSession, sf_dir: str) -> Table:
    df = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(ROW), F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), ns("l_shipdate").alias("time"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        # the first line of an order stands for a time that was not recorded
        F.when(F.col("l_linenumber") == 1, F.lit((1 << 50) - 1)).otherwise(ns("l_shipdate")).alias("marked-time"), F.when(F.col("l_linenumber") == 7, F.lit(float((1 << 32) - 1))).otherwise(F.col("l_quantity")).alias("marked-count"),
    )
    kinds = {"order": "uint64", "line": "uint64", "time": "event-time", "quantity": "weight", "price": "weight", "discount": "weight", "tax": "weight", "flag": "event-type", "status": "event-type", "marked-time": "sample-time", "marked-count": "event-count"}
    return Table("lineitem", df, [Column(m, t) for m, t in kinds.items()])


def documents(spark: SparkSession, sf_dir: str) -> Table:
    df = read(spark, sf_dir, "documents").select(F.col("doc_id").alias(ROW), F.col("doc_id").alias("key"), "text", "lang", "source", F.col("n_chars").alias("size"))
    return Table("documents", df, [Column("key", "uint64"), Column("text", "string"), Column("lang", "category"), Column("source", "domain-name"), Column("size", "size-in-bytes")])


def pages(spark: SparkSession, sf_dir: str) -> Table:
    df = read(spark, sf_dir, "pages").select(F.col("page_id").alias(ROW), F.col("page_id").alias("key"), "url", "html")
    return Table("pages", df, [Column("key", "uint64"), Column("url", "string"), Column("html", "string")])


def labels(spark: SparkSession, sf_dir: str) -> Table:
    """Documents with their labels; those without one have nulls."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    df = docs.join(read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"), "left")
    word = lambda c: F.when(F.col(c) == 1, "Yes").when(F.col(c) == 0, "No")
    df = df.select(F.col("doc_id").alias(ROW), "lang", "quality", word("quality").alias("quality__fmt"), "toxic", word("toxic").alias("toxic__fmt"))
    return Table("labels", df, [Column("lang", "category"), Column("quality", "boolean"), Column("toxic", "boolean")])


def stacks(spark: SparkSession, sf_dir: str) -> Table:
    """Orders as samples: region, nation, segment and priority as frames, leaf first."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    frame = lambda name: F.struct(F.col(name).alias("name"), F.lit(None).cast("string").alias("addr"), F.lit(None).cast("string").alias("binary"), F.lit(None).cast("string").alias("binary_path"))
    df = rows.select(F.col("o_orderkey").alias(ROW), ns("o_orderdate").alias("time"), F.expr("cast(o_orderdate AS timestamp_ntz)").alias("time__at"), F.col("c_mktsegment").alias("thread"), F.round("o_totalprice").cast("long").alias("weight"), F.array(*map(frame, ("o_orderpriority", "c_mktsegment", "n_name", "r_name"))).alias("stack"))
    return Table("order-samples", df, [Column("time", "sample-time"), Column("thread", "thread"), Column("weight", "weight"), Column("stack", "backtrace")], hints={"roles": {"weight": ("weight", "count")}})


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog([events(spark, sf_dir), intervals(spark, sf_dir), orders(spark, sf_dir), lineitems(spark, sf_dir), documents(spark, sf_dir), pages(spark, sf_dir), labels(spark, sf_dir), stacks(spark, sf_dir)])
