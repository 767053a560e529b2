import pytest
from pyspark.sql import functions as F

from traceloom.functions import expressions as E
from traceloom.model import TableError
from traceloom.operators import rows as Q
from traceloom.sources.discovery import search
from traceloom.sources.store import Store, source_mark
from traceloom.sources.xml_tables import read_table
from traceloom.streaming.follow import append, follow, spans

HANGS = """<?xml version="1.0"?><trace-query-result><node xpath='//x'><schema name="demo">
<col><mnemonic>start</mnemonic><name>Start</name><engineering-type>start-time</engineering-type></col>
<col><mnemonic>kind</mnemonic><name>Kind</name><engineering-type>event-type</engineering-type></col>
<col><mnemonic>first</mnemonic><name>First</name><engineering-type>uint64</engineering-type></col>
<col><mnemonic>second</mnemonic><name>Second</name><engineering-type>uint64</engineering-type></col>
<col><mnemonic>thread</mnemonic><name>Thread</name><engineering-type>thread</engineering-type></col>
<col><mnemonic>stack</mnemonic><name>Stack</name><engineering-type>backtrace</engineering-type></col></schema>
<row><start-time id="1" fmt="00:01">1000</start-time><event-type id="2" fmt="Hang">h</event-type><uint64 id="3">7</uint64><uint64>18446744073709551615</uint64>
<thread id="4" fmt="Main (1)"><tid id="5" fmt="0x1">1</tid><process id="6" fmt="App"><pid id="7">42</pid></process></thread>
<backtrace id="8"><frame name="leaf &amp; co" addr="0x1"><binary name="App" path="/App"/></frame><frame name="main" addr="0x2"/></backtrace></row>
<row><start-time ref="1"/><sentinel/><sentinel/><uint64 ref="3"/><thread ref="4"/><backtrace ref="8"/></row></node></trace-query-result>"""

ALLOCS = """<?xml version="1.0"?><trace-query-result><node>
<row timestamp="00:01.500.250" size="16" live="true" resident-%="5"><backtrace><frame name="malloc" addr="0x1"><binary name="libc" path="/l"/></frame></backtrace></row>
<row timestamp="1:00:00.000.001" size="32" live="false" extra="x"/></node></trace-query-result>"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.xml").write_text(HANGS)
    (tmp_path / "b.xml").write_text(ALLOCS)
    return tmp_path


def test_schema_table(spark, files):
    t = read_table(spark, str(files / "a.xml"), "demo")
    one, two = t.df.orderBy("_row_idx").collect()
    assert (one["start"], one["start__fmt"], one["kind__fmt"], one["first"]) == (1000, "00:01", "Hang", 7)
    assert one["second"] is None and one["second__fmt"] == "18446744073709551615"  # too large for a double: text alone
    assert (two["start"], two["kind__fmt"], two["first"], two["second"]) == (1000, None, None, 7)
    assert one["thread__process__pid"] == two["thread__process__pid"] == "42"
    assert [f["name"] for f in two["stack"]] == ["leaf & co", "main"] and one["stack"] == two["stack"]
    assert Q.query(t, ["stack"]).first()["stack"] == "2 frames, top: leaf & co"
    assert Q.find(t, [{"field": "kind", "op": "is-null"}]).count() == 1


def test_track_detail(spark, files):
    t = read_table(spark, str(files / "b.xml"), "Allocations/Allocations List")
    one, two = t.df.orderBy("_row_idx").collect()
    assert one["timestamp"] == 1_500_250_000 and two["timestamp"] == 3_600_000_001_000
    assert (one["size"], one["extra__fmt"], two["extra"], one["resident-pct"]) == (16, None, "x", 5)
    assert one["backtrace"][0]["binary"] == "libc" and two["backtrace"] is None
    assert t.time_column() == "timestamp" and t.duration_column() == "size"


def test_store_is_whole_or_nothing(spark, files, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    source, made = str(files / "a.xml"), []
    make = lambda: made.append(1) or read_table(spark, source, "demo")
    assert store.ensure("demo", source, make).df.count() == store.ensure("demo", source, make).df.count() == store.rows("demo") == 2
    assert len(made) == 1 and store.fresh("demo", source_mark(spark, source))
    assert store.catalog().get("demo").time_column() == "start"
    manifest = next((tmp_path / "store").rglob("manifest.json"))
    manifest.unlink()
    with pytest.raises(TableError):
        store.read("demo")


def test_expressions(spark):
    row = spark.range(1).select(
        E.clock_ns(F.lit("01:02.003.004")).alias("clock"), E.clock_ns(F.lit("soon")).alias("none"), E.shown_cell(F.lit("(Authorization : Bearer abc), (Host : x), ( api-key:s3cret)"), "request-headers").alias("secret"), E.shown_cell(F.lit("a (cookie : chocolate) and milk"), "message").alias("prose"), E.format_bytes(F.lit(1536)).alias("bytes"), E.format_ns(F.lit(2_500_000)).alias("ns"),
        E.format_count(F.lit(1234567)).alias("count"), E.percent(F.lit(1), F.lit(0)).alias("nothing"), E.trailing_number(F.lit("Display 12 ")).alias("number"), E.chain(F.lit("a ← b, c")).alias("chain"), E.snippet(F.lit("x" * 81)).alias("snippet"),
    ).first()
    assert row["clock"] == 62_003_004_000 and row["none"] is None
    assert row["secret"] == "(Authorization : [REDACTED]), (Host : x), (api-key : [REDACTED])" and row["prose"] == "a (cookie : chocolate) and milk"
    assert (row["bytes"], row["ns"], row["count"], row["nothing"], row["number"]) == ("1.50 KB", "2.50 ms", "1,234,567", 0.0, 12.0)
    assert row["chain"] == ["a", "b", "c"] and len(row["snippet"]) == 81


def test_search(spark):
    r = spark.createDataFrame([("hang-run.trace", "p", 1), ("hang-old.trace", "p", 0), ("cpu.trace", "p", 5)], "name string, path string, changed long")
    assert [x["name"] for x in search(r, "hang run").collect()] == ["hang-run.trace", "hang-old.trace"]
    assert search(r, "latest").first()["name"] == "cpu.trace"


def test_follow_takes_each_row_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1.0), (1, "2024-01-01 00:00:00", "a", 1.0), (2, "2024-01-01 00:00:05", "a", 2.0)], "id long, at string, kind string, v double").withColumn("at", F.to_timestamp("at"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = append(follow(spark, f"{tmp_path}/in", rows.schema, "id", "at"), f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 2
    assert spans(out, "at", "1 minute", "kind", "v").first()["total"] == 3.0
