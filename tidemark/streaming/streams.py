"""Structured Streaming forms. Each runs over what is there (``availableNow``) and gives what its batch twin gives."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle



def drain(stream: DataFrame, handle, progress: str, mode: str = "append") -> None:
    """Run a stream over all there is, a batch at a time. ``progress`` is the caller's folder: a run under the same one
    goes on where the last ended, and a batch that was not finished runs again under its number."""
    query = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()


def files(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def incremental_archives(stream: DataFrame, path: str, archive: str, progress: str, prepare=lambda rows: rows) -> DataFrame:
    """New files become rows of the corpus once. Each batch has a folder of its own with its archives in it: an archive
    whose files come in several batches keeps them all, and a batch that runs again replaces what it wrote."""

    def write(rows: DataFrame, batch: int) -> None:
        prepare(rows).write.mode("overwrite").partitionBy(archive).parquet(f"{path}/batch={batch:06d}")

    drain(stream, write, progress)
    return stream.sparkSession.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def state_table(stream: DataFrame, path: str, progress: str, mode: str = "complete") -> DataFrame:
    """The last state of a stateful aggregate, each batch in a folder of its own."""
    spark = stream.sparkSession

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch:06d}")

    drain(stream, write, progress, mode)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{path}/batch=*")
    return rows


def last_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key over the batches of a table in update mode."""
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started in here keep their state in RocksDB; a stream takes its settings when it starts."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def drain_stateful(stream: DataFrame, path: str, progress: str) -> DataFrame:
    """Write each batch of a stateful stream to a folder of its own, so that one that runs again replaces it."""
    with state_store(stream.sparkSession):
        drain(stream, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch:06d}"), progress)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/batch=*")


DAY_MS = 86_400_000


class Once(StatefulProcessor):
    """Remembers the digest of each key of a bucket until the watermark has passed it by ``horizon`` ms."""

    def __init__(self, columns: Sequence[str], key: str, digest: str, horizon: int):
        self.columns, self.key, self.digest, self.horizon = list(columns), key, digest, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.swept = handle, {}
        self.seen = handle.getMapState("seen", "key string", "digest string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        empty, last = not self.seen.exists(), None  # nothing has to be looked up in an empty state
        for some in rows:
            new: dict[str, tuple[str, int]] = {}
            kept = []
            for k, d, at in zip(some[self.key].astype(str), some[self.digest], some["event_ms"]):
                held = new.get(k) or (None if empty else self.seen.getValue((k,)))
                if held is not None and held[0] != d:
                    raise ValueError(f"conflicting record: {k}")
                kept.append(held is None)
                if held is None:
                    new[k] = d, int(at)
            for k, v in new.items():
                self.seen.updateValue((k,), v)
            empty = empty and not new
            if new:
                last = max(last, *(at for _, at in new.values())) if last is not None else max(at for _, at in new.values())
            yield some.loc[kept, self.columns]
        if last is not None:  # on the next whole day, so a bucket has a timer for each day and not for each chunk of rows
            self.handle.registerTimer(-(-(last + self.horizon) // DAY_MS) * DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        past = timerValues.getCurrentWatermarkInMs() - self.horizon
        if self.swept.get(key) != past:  # timers that pass together look through a bucket once
            self.swept[key] = past
            gone = [k for k, (_, at) in self.seen.iterator() if at <= past]
            for k in gone:
                self.seen.removeKey(k)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def append_once(stream: DataFrame, path: str, key: str, digest: str, at: str, progress: str, late: str = "1 day", horizon_days: int = 7, buckets: int = 64) -> DataFrame:
    """Append by key, once; the same key with other content fails the batch and with it the stream.

    What was seen is in keyed state and the store is never read, so a batch costs what it brings. A key is kept for
    ``horizon_days`` after its event time ``at`` and to the end of that day, once the watermark (``late`` behind the newest row) is past that; rows
    older than the watermark are dropped, so what has been forgotten can't come again.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    keyed = stream.withWatermark(at, late).withColumns({"key_bucket": bucket, "event_ms": F.unix_millis(at)})
    once = keyed.groupBy("key_bucket").transformWithStateInPandas(Once(stream.columns, key, digest, horizon_days * DAY_MS), stream.schema, "Append", "EventTime")
    return drain_stateful(once, path, progress)


FOLDED = "user_id long, event_id long, state long, since long"


class Fold(StatefulProcessor):
    """The event that set a session's state last, and the events since; both go when the session has been idle."""

    def __init__(self, reset: str, idle: int):
        self.reset, self.idle = reset, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, since long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, since, timer = self.held.get() if self.held.exists() else (None, -1, 0)
        # one session's events of one small batch: plain lists, as a session has few and a frame costs more than its rows
        some = sorted(e for part in rows for e in zip(part["event_ms"].tolist(), part["event_id"].tolist(), part["event_type"].tolist()))
        ids, states, ages = [], [], []
        for _, event_id, kind in some:
            at, since = (event_id, 0) if kind == self.reset else (at, since + 1)
            ids.append(event_id), states.append(at), ages.append(since)
        due = some[-1][0] + self.idle
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.held.update((at, since, due))
        yield pd.DataFrame({"user_id": key[0], "event_id": ids, "state": pd.array(states, dtype="Int64"), "since": ages})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def fold_sessions(stream: DataFrame, path: str, progress: str, reset: str, late: str = "1 day", idle_days: int = 3650) -> DataFrame:
    """The state set by the last reset event of a session and the events since, for each event of a live log.

    A session without an event for ``idle_days`` leaves the state when the watermark passes; a later event of its name
    starts anew, as one does in ``windows.fold_log`` where a session has a name of its own.
    """
    folded = stream.withWatermark("ts", late).withColumn("event_ms", F.unix_millis("ts")).groupBy("user_id").transformWithStateInPandas(Fold(reset, idle_days * DAY_MS), FOLDED, "Append", "EventTime")
    return drain_stateful(folded, path, progress)
