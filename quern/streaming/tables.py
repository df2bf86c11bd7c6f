"""Tables that streams keep up to date: upserts by buckets of the key, late rows in a table of their own, and a cache whose entries end by event time.

Nothing here renames or deletes: data goes to a new folder, and one row appended to a log, which Spark's committer publishes as a whole,
makes it the current one. So whenever a driver dies, readers see the state before or after a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LOG = "epoch long, version long, bucket int"


def _log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{path}/log")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _current(spark: SparkSession, path: str) -> dict[int, int]:
    """The version that each bucket is read from: as many rows as buckets."""
    return {r["bucket"]: r["version"] for r in _log(spark, path, LOG).groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def read_buckets(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame | None:
    """The rows of an upserted table, or of some of its buckets; None before the first batch. Only current folders are listed."""
    now = {b: v for b, v in _current(spark, path).items() if only is None or b in only}
    if not now:
        return None
    by_version: dict[int, list[int]] = {}
    for b, v in now.items():
        by_version.setdefault(v, []).append(b)
    own = [f"{path}/data/{v}/b={b}" for v, bs in by_version.items() for b in bs]
    return spark.read.parquet(*own)


def upsert_buckets(path: str, key: str, buckets: int = 64, order: str = "ts"):
    """For foreachBatch: keeps the latest row of a key, by order, then by the other columns. A batch reads and writes only the buckets that its keys fall in.

    A batch that is run again after its log row was written changes nothing; one that died before writes its folder anew. Null keys are one key.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        log = _log(spark, path, LOG).agg(F.max("epoch").alias("epoch"), F.max("version").alias("version")).first()
        if log["epoch"] is not None and epoch <= log["epoch"]:
            return
        version = (log["version"] or 0) + 1
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # numbers of buckets, at most `buckets`
        if not touched:
            return
        old = read_buckets(spark, path, touched)
        rows = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
        rest = [x for x in rows.columns if x not in (order, key)]
        # Sketch of a row for ties: any total order of rows will do, as long as it is always the same.
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, *[F.col(x).cast("string") for x in rest])).alias("x")).select("x.*")
        latest.withColumn("b", bucket).repartition(len(touched), "b").write.mode("overwrite").partitionBy("b").parquet(f"{path}/data/{version}")
        spark.createDataFrame([(epoch, version, b) for b in touched], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")

    return write


def split_late(path: str, delay_ms: int, ts: str = "ts"):
    """For foreachBatch: rows older than the watermark go to {path}/late, with how late they are, all others to {path}/on_time; none is lost.

    The watermark of a batch is the latest time of all batches before it, less the delay, as Spark's is. Both tables are written by epoch, so that a batch that is run again replaces its own rows.
    """
    schema = "epoch long, upto timestamp"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = _log(spark, path, schema).where(F.col("epoch") < epoch).agg(F.max("upto").alias("upto")).first()["upto"]
        own = batch.persist()
        mark = F.lit(seen).cast("timestamp") - F.expr(f"make_dt_interval(0, 0, 0, {delay_ms / 1000})")
        late = F.coalesce(F.col(ts) < mark, F.lit(False))
        stale = (F.unix_millis(mark) - F.unix_millis(F.col(ts))).alias("late_ms")
        own.where(late).select("*", stale).write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        own.where(~late).write.mode("overwrite").parquet(f"{path}/on_time/epoch={epoch}")
        own.agg(F.lit(epoch).cast("long").alias("epoch"), F.max(ts).cast("timestamp").alias("upto")).where("upto is not null").coalesce(1).write.mode("append").parquet(f"{path}/log")
        own.unpersist()

    return write


def cache_hits(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(key, probe_id, ts, payload, hit) of each probe, as a stream: ops.as_of with an entry a key as state.

    rows: (key, ts timestamp, probe_id, payload, ttl_ms): a probe has a probe_id, all others store payload for ttl_ms. Of a micro-batch stores of the same time
    come before probes, as in the batch. An entry answers until its end by event time; a timer then clears it, so state holds live entries only.
    The session must use events.ROCKSDB as its state store.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Cache(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.entry = handle.getValueState("entry", "stored long, ends long, payload string")

        def handleInputRows(self, key, rows, timerValues):
            own = pd.concat(rows)
            own = own.assign(_probe=own["probe_id"].notna()).sort_values(["ts", "_probe", "probe_id"])
            now = self.entry.get() if self.entry.exists() else None
            said, changed = [], False
            for ts, probe, payload, ttl in zip(own["ts"], own["probe_id"], own["payload"], own["ttl_ms"], strict=True):
                ms = ts.value // 1_000_000
                if pd.isna(probe):
                    if now is None or ms >= now[0]:
                        now, changed = (ms, ms + int(ttl), payload), True
                    continue
                hit = now is not None and now[0] <= ms < now[1]
                said.append((key[0], int(probe), ts, now[2] if hit else None, hit))
            if changed:
                self.entry.update(now)
                self.handle.registerTimer(now[1])
            yield pd.DataFrame(said, columns=["key", "probe_id", "ts", "payload", "hit"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # An entry that has been stored anew has a later end, and a timer of its own.
            if self.entry.exists() and self.entry.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
            yield pd.DataFrame([], columns=["key", "probe_id", "ts", "payload", "hit"])

    own = rows.select("key", "ts", F.col("probe_id").cast("long").alias("probe_id"), "payload", F.col("ttl_ms").cast("long").alias("ttl_ms")).withWatermark("ts", late)
    return own.groupBy("key").transformWithStateInPandas(Cache(), "key string, probe_id long, ts timestamp, payload string, hit boolean", "Append", "EventTime")
