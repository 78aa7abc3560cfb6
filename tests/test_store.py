import json
import time

import pytest
from pyspark.sql import functions as F

from strandline.catalog import BOOL, FLOAT, INT, STRING, STRUCTURE, UNKNOWN, ColumnAttribute
from strandline.errors import DatabaseClosed, EmptyValue, LateRecord, NoDataForTag, TableExists, TableNotFound, TagNotFound, TimestampOutOfRange, TypeMismatch, UnsupportedFloat
from strandline.functions.predicates import Condition, build
from strandline.sources.store import Config, Database
from strandline.streaming.ingest_stream import kept_stream, start_ingest, windowed

T0, S = 1_700_000_000_000_000_000, 10**9


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, Config("file://" + str(tmp_path / "db")))


def test_tables(spark, db):
    db.create_table("f", ColumnAttribute("value", FLOAT))
    with pytest.raises(TableExists):
        db.create_table("f")
    with pytest.raises(TableNotFound):
        db.write_batch("none", [("a", 1, 1)])
    with pytest.raises(TableNotFound):
        db.query_latest("none", "a")
    assert db.query_all("none", "a", 0, 9, missing_ok=True).count() == 0
    again = Database(spark, db.config)
    assert again.tables() == ["f"] and again.catalog.get("f").column.float_precision == 4
    with pytest.raises(TagNotFound):
        again.query_all("f", "cpu", 0, T0)


def test_float_series(db):
    db.create_table("f", ColumnAttribute("value", FLOAT, float_precision=2))
    assert db.write_batch("f", []) == 0
    assert db.write_batch("f", [("cpu", T0 + i, i * 0.5) for i in range(10_000)] + [("mem", T0, 0.123)]) == 10_001
    got = db.query_all("f", "cpu", T0, T0 + 10_000).collect()
    assert len(got) == 10_000 and got[0].ts_ns == T0 and got[-1].ts_ns == T0 + 9999
    assert db.query_all("f", "cpu", T0 + 10, T0 + 20).count() == 11
    assert db.query_latest("f", "cpu") == (T0 + 9999, 4999.5)
    assert db.query_latest("f", "mem") == (T0, 0.13)
    assert {r.tag for r in db.query_latest_all("f").collect()} == {r.tag for r in db.tags("f").collect()} == {"cpu", "mem"}
    with pytest.raises(TagNotFound):
        db.query_latest("f", "gpu")
    db.compact("f")
    assert db.query_all("f", "cpu", T0, T0 + 10_000).count() == 10_000


def test_guards_and_single_writes(spark, db):
    db.config.max_ahead_s = 10
    with pytest.raises(TimestampOutOfRange):
        db.write("", "a", T0 + 11 * S, 1, now_ns=T0)
    with pytest.raises(EmptyValue):
        db.write("", "a", T0, None, now_ns=T0)
    assert db.write("", "a", T0, {"x": 1}, now_ns=T0) and db.tables() == ["default"]
    with pytest.raises(LateRecord):
        db.write("", "a", T0 - 1, 1, now_ns=T0)
    db.create_table("f", ColumnAttribute("value", FLOAT))
    with pytest.raises(UnsupportedFloat):
        db.write("f", "a", T0, float("nan"), now_ns=T0)
    db.config.dedup_ms = 1000
    assert db.write_batch("f", [("a", T0 + i * S // 2, 1.0) for i in range(6)], now_ns=T0) == 2


def test_struct_and_adaptive(db):
    db.create_table("s", ColumnAttribute("value", STRUCTURE, structure=[ColumnAttribute("score", INT), ColumnAttribute("name", STRING), ColumnAttribute("on", BOOL)]))
    db.write_batch("s", [("t", T0 + i, {"score": i, "name": f"n{i}"}) for i in range(100)])
    assert db.query_all("s", "t", T0, T0 + 100, Condition("score", ">", 50)).count() == 49
    first = db.query_all("s", "t", T0, T0, zero_fill=True).first().value
    assert tuple(first) == (0, "n0", False)
    db.create_table("v", ColumnAttribute("value", UNKNOWN))
    db.write_batch("v", [("t", T0 + i * S, {"value": i * 0.5, "name": f"sensor_{i % 100}"}) for i in range(2000)])
    assert db.query_all("v", "t", T0, T0 + 2000 * S).count() == 2000
    assert db.query_all("v", "t", T0, T0 + 2000 * S, Condition("value", ">=", 999.0)).count() == 2
    assert db.query_latest("v", "t")[0] == T0 + 1999 * S and db.query_latest_all("v").count() == 1
    db.create_table("b", ColumnAttribute("value", BOOL))
    with pytest.raises(TypeMismatch):
        db.append("b", db.spark.createDataFrame([("t", T0, "perhaps")], "tag string, ts_ns long, value string"))
    db.append("b", db.spark.createDataFrame([("t", T0, "perhaps"), ("t", T0, "true")], "tag string, ts_ns long, value string"), strict=False)
    assert db.query_latest("b", "t") == (T0, True)
    assert 1 <= db.query("v", "t", T0, T0 + 7200 * S, 5).count() <= 5


def test_out_of_order_and_downsampling(db):
    db.create_table("i", ColumnAttribute("value", INT))
    db.write_batch("i", [("r", x, x) for x in (100, 50, 75, 200, 150)])
    assert [r.ts_ns for r in db.query_all("i", "r", 60, 160).collect()] == [75, 100, 150]
    db.write_batch("i", [("d", T0 + i * S, i) for i in range(10)] + [("d", T0 + 5 * S + x * 10**6, x) for x in (300, 100, 400, 200, 500)])
    got = db.query("i", "d", T0, T0 + 7200 * S, 5, "min").collect()
    assert 1 <= len(got) <= 5 and [r.ts_ns for r in got] == sorted(r.ts_ns for r in got)
    assert db.query("i", "d", T0, T0 + 3600 * S, 1).count() == 15  # not longer than an hour: raw
    with pytest.raises(ValueError):
        db.query("i", "d", T0, T0 + 7200 * S, -1)


def test_expiration(db):
    day = 86_400 * S
    db.create_table("i", ColumnAttribute("value", INT))
    db.write_batch("i", [("a", T0 - k * day, k) for k in range(5)])
    db.config.expiration_min = 2 * 1440
    assert [r.value for r in db.query_all("i", "a", 0, 2 * T0, now_ns=T0).collect()] == [2, 1, 0]
    assert db.sweep("i", T0) == 2 and db.series("i").count() == 3
    db.config.sweep_s = 10**9
    db.write_batch("i", [("old", T0 - 2 * day, 7)], T0)
    assert db.sweep("i", T0 + 99 * day) == 2 and db.query_latest("i", "a") == (T0, 0)
    with pytest.raises(NoDataForTag):
        db.query_latest("i", "old")
    with pytest.raises(TagNotFound):
        db.query_latest("i", "never")


def test_stream_keeps_what_batch_keeps(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(f"t{i % 3}", T0 + (i - i % 5) * S, float(i // 9)) for i in range(300)]
    schema = "tag string, ts_ns long, value double"
    for k in range(0, 300, 100):
        spark.createDataFrame(rows[k : k + 100], schema).coalesce(1).write.mode("append").parquet(src)
    db = Database(spark, Config("file://" + str(tmp_path / "db"), min_interval_ms=2000, dedup_ms=20_000))
    db.create_table("f", ColumnAttribute("value", FLOAT))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    at = "file://" + str(tmp_path / "ckpt")
    for _ in range(2):  # the second run starts from the checkpoint and finds nothing new
        q = start_ingest(stream, db, "f", checkpoint=at, available_now=True)
        q.awaitTermination(120)
        assert q.exception() is None
    batch = Database(spark, Config("file://" + str(tmp_path / "db2"), min_interval_ms=2000, dedup_ms=20_000))
    batch.create_table("f", ColumnAttribute("value", FLOAT))
    batch.append("f", spark.createDataFrame(rows, schema))
    see = lambda x: sorted((r.tag, r.ts_ns, r.value) for r in x.series("f").collect())
    assert see(db) == see(batch) and 0 < len(see(db)) < 300
    q = windowed(stream).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("win").collect()) == 300


def test_batches_are_judged_against_stored_points(spark, db):
    schema = "tag string, ts_ns long, value double"
    seen = lambda name, tag="a": [(r.ts_ns - T0) // S for r in db.query_all(name, tag, 0, 2 * T0).collect()]
    for name in ("late", "close", "same", "json"):
        db.create_table(name, ColumnAttribute("value", UNKNOWN if name == "json" else FLOAT, float_precision=2))
    db.write_batch("late", [("a", T0 + 10 * S, 1.0), ("a", T0, 1.0)])
    assert db.write_batch("late", [("a", T0 + 9 * S, 2.0), ("a", T0 + 10 * S, 3.0), ("a", T0 + 12 * S, 4.0), ("b", T0, 1.0)]) == 3
    db.append("late", spark.createDataFrame([("a", T0 + 11 * S, 5.0), ("a", T0 + 13 * S, 6.0), ("c", T0, 7.0)], schema))
    assert seen("late") == [0, 10, 10, 12, 13] and seen("late", "b") == seen("late", "c") == [0]
    db.config.min_interval_ms = 10_000
    for at in (0, 9, 10, 19, 5, 21):
        db.append("close", spark.createDataFrame([("a", T0 + at * S, float(at))], schema))
    assert seen("close") == [0, 10, 21]
    db.config.min_interval_ms, db.config.dedup_ms = 0, 10_000
    for name, value in (("same", float), ("json", lambda x: {"x": x})):
        kept = [db.write_batch(name, [("a", T0 + at * S, value(x)), ("new", T0 + at * S, value(at))]) for at, x in ((0, 1), (9, 1), (10, 1), (11, 1), (12, 2), (5, 3), (22, 2), (23, 2))]
        assert kept == [2, 1, 1, 2, 2, 0, 1, 2] and seen(name) == [0, 11, 12, 23]


def test_quantised_members_and_adaptive_floats(spark, db):
    parts = [ColumnAttribute("a", FLOAT, float_precision=1), ColumnAttribute("b", FLOAT), ColumnAttribute("c", STRUCTURE, structure=[ColumnAttribute("d", FLOAT, float_precision=2)])]
    db.create_table("s", ColumnAttribute("value", STRUCTURE, structure=parts))
    db.write_batch("s", [("t", T0, {"a": 1.23, "b": 1.23456, "c": {"d": -0.128}})])
    value = db.query_latest("s", "t")[1]
    assert (value.a, value.b, value.c.d) == (1.3, 1.23456, -0.12)
    db.create_table("v", ColumnAttribute("value", UNKNOWN, float_precision=2))
    values = [1.234, {"x": 0.001, "y": [1.5, 2.005, 7], "z": "1.234"}, "1.234", 3, True, [0.111]]
    db.write_batch("v", [("t", T0 + i, x) for i, x in enumerate(values)])
    got = [r[0] for r in db.query_all("v", "t", T0, T0 + 9).select(F.to_json("value")).collect()]
    assert [json.loads(x) for x in got] == [1.24, {"x": 0.01, "y": [1.5, 2.01, 7], "z": "1.234"}, "1.234", 3, True, [0.12]]
    assert [db.catalog.get(t).column.float_precision for t in ("v",)] == [2]


def test_type_changes_can_be_refused(db):
    db.config.refuse_type_changes = True
    db.create_table("v")
    with pytest.raises(TypeMismatch, match="v is .*int.*string"):
        db.write_batch("v", [("t", T0 + i, {"v": x}) for i, x in enumerate((1, 2, "hello"))])
    with pytest.raises(TypeMismatch):
        db.write_batch("v", [("t", T0, 1), ("t", T0 + 1, {"a": 1})])
    assert db.write_batch("v", [("t", T0 + i, {"v": x, "w": i}) for i, x in enumerate((1.5, 2, True, None))]) == 4


def test_versions_closing_and_replays(spark, db):
    db.create_table("f", ColumnAttribute("value", FLOAT))
    other = Database(spark, db.config)
    db.write_batch("f", [("a", T0, 1.0)])
    db.write_batch("f", [("a", T0, 2.0), ("a", T0, 3.0)])
    for _ in range(3):
        db.compact("f")
        assert other.query_latest("f", "a") == (T0, 3.0) and other.series("f").count() == 3
    assert db.catalog.get("f").version == 3
    rows = spark.createDataFrame([("b", T0, 5.0)], "tag string, ts_ns long, value double")
    first = db.append("f", rows, source="s-1")
    db.compact("f")
    assert db.append("f", rows, source="s-1") == first and db.append("f", rows, source="s-2") > first
    other.close()
    with pytest.raises(DatabaseClosed):
        other.series("f")


def test_unequal_to_another_kind(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "n long, value string")
    structs = df.select("n", F.struct("value").alias("value"))
    variants = df.select("n", F.parse_json(F.to_json(F.struct("value"))).alias("value"))
    for rows in (structs, variants):
        kind = rows.schema["value"].dataType
        assert [r.n for r in rows.where(build(Condition("value", "!=", 5), "value", kind)).collect()] == [1]
        assert rows.where(build(Condition("value", "=", 5), "value", kind)).count() == 0


def test_state_with_a_time_to_live(spark, tmp_path):
    with pytest.raises(ValueError):
        start_ingest(None, None, "t", available_now=True, ttl_s=5)
    src, schema = str(tmp_path / "src"), "tag string, ts_ns long, value double"
    for k in range(2):
        spark.createDataFrame([("a", T0 + (10 * k + i) * S, float(i // 5)) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name, ttl in (("never", 0), ("ttl", 3600)):
        kept = kept_stream(stream, dedup_ns=3600 * S, ttl_s=ttl)
        q = kept.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/{name}-ckpt").start(f"file://{tmp_path}/{name}")
        until = time.time() + 90
        while sum(x["numInputRows"] for x in q.recentProgress) < 20 and time.time() < until:
            time.sleep(0.5)  # a query whose state expires is never done
        q.stop()
        got = sorted(r.ts_ns for r in spark.read.schema(schema).parquet(f"file://{tmp_path}/{name}").collect())
        assert [(t - T0) // S for t in got] == [0, 5, 10, 15]
