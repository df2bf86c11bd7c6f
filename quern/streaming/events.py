"""Streams: windows over late data, sessions, deduplication, and state per key."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files as they come, a bounded number at a time; event times as timestamps with a zone, which watermarks ask for."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by window; with `late` set, a watermark lets state go."""
    own = events if late is None else events.withWatermark("ts", late)
    return own.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, finish, n): events of a user with less than the gap between them."""
    own = events if late is None else events.withWatermark("ts", late)
    return own.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def once(items: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark: what a corpus that is refreshed again and again takes in."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def streaks(calls: DataFrame, threshold: int = 4) -> DataFrame:
    """(source, failures, opened): failures in a row of each source, kept as state, emitted as calls come in."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        for own in batches:
            for ok in own.sort_values("ts")["ok"]:
                failures = 0 if ok else failures + 1
        state.update((failures,))
        yield pd.DataFrame({"source": [key[0]], "failures": [failures], "opened": [failures >= threshold]})

    return calls.groupBy("source").applyInPandasWithState(step, "source string, failures int, opened boolean", "failures int", "update", GroupStateTimeout.NoTimeout)


#: The state store that transformWithState needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def breakers(calls: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(source, ts, ok, state): ops.breaker as a stream. Each source keeps failures and the end of its pause; a timer on event time tells when a pause is over.

    calls: (source, ts timestamp, ok). Calls of a micro-batch go by time, then failures first; a row with a null ok and state half-open is a timer's.
    The session must use ROCKSDB as its state store. Only what the watermark has not passed counts, so state stays one row a source.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    from quern.operators import ops

    class Breaker(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("breaker", "failures int, until long")

        def handleInputRows(self, key, rows, timerValues):
            failures, until = self.state.get() if self.state.exists() else (0, 0)
            own = pd.concat(rows).sort_values(["ts", "ok"])
            said = []
            for ts, ok in zip(own["ts"], own["ok"], strict=True):
                ms = int(ts.timestamp() * 1000)
                if failures >= ops.THRESHOLD and ms < until:
                    said.append((key[0], ts, ok, "open"))
                    continue
                said.append((key[0], ts, ok, "half-open" if failures >= ops.THRESHOLD else "closed"))
                failures = 0 if ok else min(failures + 1, ops.MOST_FAILURES)
                if failures >= ops.THRESHOLD:
                    until = ms + min(ops.MAX_MS, ops.BASE_MS * 2 ** (failures - ops.THRESHOLD))
                    self.handle.registerTimer(until)
            self.state.update((failures, until))
            yield pd.DataFrame(said, columns=["source", "ts", "ok", "state"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = expiredTimerInfo.getExpiryTimeInMs()
            failures, until = self.state.get() if self.state.exists() else (0, 0)
            # A timer of an earlier pause, which a later failure has prolonged, says nothing.
            if failures >= ops.THRESHOLD and until == now:
                yield pd.DataFrame({"source": [key[0]], "ts": pd.to_datetime([now], unit="ms"), "ok": pd.array([None], dtype="boolean"), "state": ["half-open"]})

    own = calls.select("source", "ts", F.coalesce("ok", F.lit(False)).alias("ok")).withWatermark("ts", late)
    return own.groupBy("source").transformWithStateInPandas(Breaker(), "source string, ts timestamp, ok boolean, state string", "Append", "EventTime")


def upsert(path: str, key: str):
    """For foreachBatch: keeps the latest row a key in a table, written anew beside the old one and then put in its place.

    The old table is renamed aside before the new one takes its name, and deleted after that: whenever a driver dies, one
    whole table is there, and the next batch puts it back first. A batch that is written again changes nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        own, new, aside = fs_path(path), fs_path(f"{path}.new"), fs_path(f"{path}.old")
        fs = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(own) and fs.exists(aside):
            fs.rename(aside, own)
        all_rows = batch if not fs.exists(own) else spark.read.parquet(path).unionByName(batch)
        latest = all_rows.groupBy(key).agg(F.max_by(F.struct(*all_rows.columns), F.struct("ts", *[x for x in all_rows.columns if x not in ("ts", key)])).alias("x")).select("x.*")
        latest.write.mode("overwrite").parquet(new.toString())
        fs.delete(aside, True)
        if fs.exists(own):
            fs.rename(own, aside)
        fs.rename(new, own)
        fs.delete(aside, True)

    return write
