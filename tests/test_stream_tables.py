"""Tables kept by streams: batches, crashes and late rows."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import ops
from quern.streaming import events, tables

SCHEMA = "k long, ts long, v string"


def latest(batches):
    out = {}
    for rows in batches:
        for k, ts, v in rows:
            out[k] = max(out.get(k, (ts, v)), (ts, v))
    return {(k, *x) for k, x in out.items()}


def written(path):
    return {f"{d}/{f}" for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    rng = random.Random(1)
    path = str(tmp_path / "t")
    write = tables.upsert_buckets(path, "k", 16)
    assert tables.read_buckets(spark, path) is None
    batches = [[(k, 1, f"a{k}") for k in range(400)] + [(None, 1, "null")], [(7, 2, "new"), (9, 0, "old"), (None, 3, "later")], [(rng.randrange(500), rng.randrange(5), f"c{i}") for i in range(50)]]
    for epoch, rows in enumerate(batches):
        before = written(path)
        write(spark.createDataFrame(rows, SCHEMA), epoch)
        assert {tuple(r) for r in tables.read_buckets(spark, path).select("k", "ts", "v").collect()} == latest(batches[: epoch + 1])
        if epoch == 1:
            assert 1 <= len({f.split("/b=")[1].split("/")[0] for f in written(path) - before if "/b=" in f}) <= 3
    # A batch that comes again changes nothing.
    before = written(path)
    write(spark.createDataFrame([(1, 99, "again")], SCHEMA), 2)
    assert written(path) == before
    write(spark.createDataFrame([], SCHEMA), 3)
    assert tables.read_buckets(spark, path).count() == len(latest(batches))


def test_upserts_outlive_a_crash_before_the_log(spark, tmp_path):
    path = str(tmp_path / "t")
    write = tables.upsert_buckets(path, "k", 4)
    write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], SCHEMA), 0)
    # A driver died after writing a folder: nobody reads it, and the batch that comes again writes it anew.
    spark.createDataFrame([(1, 9, "half", 0)], SCHEMA + ", b int").write.partitionBy("b").parquet(f"{path}/data/2")
    assert {tuple(r) for r in tables.read_buckets(spark, path).select("k", "v").collect()} == {(1, "a"), (2, "b")}
    write(spark.createDataFrame([(1, 2, "c")], SCHEMA), 1)
    assert {tuple(r) for r in tables.read_buckets(spark, path).select("k", "v").collect()} == {(1, "c"), (2, "b")}


def test_late_rows_and_others_are_the_input(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, i * 10_000 - (rng.randrange(3_000_000) if i % 9 == 0 else rng.randrange(60_000))) for i in range(600)] + [(600, None)]
    seen, late = None, set()
    for epoch in range(7):
        own = rows[epoch * 100 : epoch * 100 + 100]
        late |= {i for i, ms in own if seen is not None and ms is not None and ms < seen - 600_000}
        seen = max([x for _, x in own if x is not None] + ([seen] if seen is not None else []))  if any(x is not None for _, x in own) else seen
        spark.createDataFrame(own, "id long, ms long").selectExpr("id", "timestamp_millis(ms) as ts").coalesce(1).write.parquet(str(tmp_path / f"in/{epoch}"))
    source = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    source.writeStream.foreachBatch(tables.split_late(path, 600_000)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    got_late = {r["id"]: r["late_ms"] for r in spark.read.parquet(f"{path}/late").collect()}
    on_time = {r["id"] for r in spark.read.parquet(f"{path}/on_time").collect()}
    assert set(got_late) == late and len(late) > 20 and all(x > 0 for x in got_late.values()) and on_time == set(range(601)) - late
    # The same batch again gives the same tables.
    tables.split_late(path, 600_000)(spark.read.parquet(str(tmp_path / "in/6")), 6)
    assert spark.read.parquet(f"{path}/on_time").count() + spark.read.parquet(f"{path}/late").count() == 601


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_cache_stream_equals_the_batch(spark, tmp_path):
    own = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id").limit(400)
    stored = F.col("event_id") % 3 == 0
    rows = own.select(F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.when(~stored, F.col("event_id")).alias("probe_id"), F.when(stored, F.concat(F.lit("p"), F.col("event_id").cast("string"))).alias("payload"), F.when(stored, (F.col("event_id") % 4) * 7_200_000 + 1000).alias("ttl_ms"))
    all_rows = sorted(rows.collect(), key=lambda r: r["ts"])
    for k in range(4):
        spark.createDataFrame(all_rows[k * 100 : k * 100 + 100], rows.schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", events.ROCKSDB)
    try:
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        tables.cache_hits(source, "0 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    ms = F.unix_millis("ts")
    entries = rows.where("probe_id is null").select("key", ms.alias("stored_at"), (ms + F.col("ttl_ms")).alias("expires_at"), "payload")
    want = ops.as_of(rows.where("probe_id is not null").select("key", "probe_id", ms.alias("at")), entries, "key")
    got = {(r["probe_id"], r["payload"], r["hit"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["probe_id"], r["payload"], r["hit"]) for r in want.collect()} and len({x[2] for x in got}) == 2
