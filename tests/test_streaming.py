"""Streams over the events table, run to the end of what is there."""

import os

import pytest
from pyspark.sql import functions as F

from quern.streaming import events as stream

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture
def folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    return tmp_path


def run(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_equal_the_batch(spark, folder):
    own = spark.read.parquet(str(folder / "in"))
    got = run(stream.tumbling(stream.read(spark, str(folder / "in"), own.schema)), folder, "windows", "complete")
    want = stream.tumbling(own.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted((r["start"], r["event_type"], r["n"]) for r in got.collect()) == sorted((r["start"], r["event_type"], r["n"]) for r in want.collect())


def test_streaks_keep_state(spark, folder):
    own = spark.read.parquet(str(folder / "in"))
    calls = stream.read(spark, str(folder / "in"), own.schema).select(F.col("event_type").alias("source"), "ts", (F.col("event_type") != "error").alias("ok"))
    got = {r["source"]: r for r in run(stream.streaks(calls), folder, "streaks", "update").collect()}
    assert got["error"]["opened"] and got["error"]["failures"] >= 4 and all(not r["opened"] for s, r in got.items() if s != "error")


def test_upsert_keeps_the_latest(spark, tmp_path):
    write = stream.upsert(str(tmp_path / "t"), "k")
    for epoch, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (2, 0, "old")]]):
        write(spark.createDataFrame(rows, "k int, ts int, v string"), epoch)
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "c"), (2, "b")}


def test_upsert_outlives_a_crash(spark, tmp_path):
    """A driver that dies between the renames leaves the old table aside; the next batch starts from it."""
    write = stream.upsert(str(tmp_path / "t"), "k")
    write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, ts int, v string"), 0)
    (tmp_path / "t").rename(tmp_path / "t.old")
    write(spark.createDataFrame([(1, 2, "c")], "k int, ts int, v string"), 1)
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "c"), (2, "b")}


def test_breakers_as_a_stream(spark, tmp_path):
    """Batches in order give what the batch operator gives; pauses end by a timer."""
    from quern.operators import ops

    base = 1_700_000_000_000
    calls = [("s", base + i * 1000, False) for i in range(4)] + [("s", base + 10_000, True), ("s", base + 33_500, False), ("s", base + 80_000, True), ("t", base + 90_000, True), ("s", base + 100_000, True)]
    calls += [("u", base + 200_000 + i, False) for i in range(4)] + [("t", base + 3_600_000 + i, i % 3 > 0) for i in range(6)]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKSDB)
    try:
        schema = "source string, ts timestamp, ok boolean"
        for k, part in enumerate((calls[:3], calls[3:6], calls[6:9], calls[9:13], calls[13:])):
            df = spark.createDataFrame(part, "source string, ms long, ok boolean").selectExpr("source", "timestamp_millis(ms) as ts", "ok")
            df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = stream.breakers(rows, "0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        out = spark.read.parquet(f"{tmp_path}/out").selectExpr("source", "unix_millis(ts) as ts", "ok", "state").collect()
        batch = ops.breaker(spark.createDataFrame(calls, "source string, ts long, ok boolean"))
        assert sorted((r["source"], r["ts"], r["ok"], r["state"]) for r in out if r["ok"] is not None) == sorted((r["source"], r["ts"], r["ok"], r["state"]) for r in batch.collect())
        assert [(r["source"], r["ts"] - base, r["state"]) for r in out if r["ok"] is None] == [("u", 230_003, "half-open")]
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
