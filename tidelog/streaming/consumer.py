"""Continuous consumption: a topic's files as a stream, handlers with commits, windows, delays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidelog.operators.log import PART
from tidelog.sources.shared import names, remove
from tidelog.sources.store import SCHEMA, LogStore

#: Offsets of one window; and handled offsets [first, next), fresh where the last micro-batch had some of them.
STRETCH = 100_000
RUNS = "topic string, partition int, first bigint, next bigint, fresh boolean"


def topic_stream(spark: SparkSession, path: str, topics: list[str] | None = None, files: int = 100, schema: str = SCHEMA) -> DataFrame:
    """New batches of a store as they are put in place; files bounds what a micro-batch takes. What compaction writes is not new."""
    base = f"{path}/data"
    out = spark.readStream.schema(f"{schema}, entry string").option("basePath", base).option("maxFilesPerTrigger", files).parquet(f"{base}/entry=batch-*").drop("entry")
    return out.where(F.col("topic").isin(topics)) if topics else out


class Subscription:
    """A group's poll loop: starting it again while it runs changes nothing; closing it stops it."""

    def __init__(self, store: LogStore, group: str, topics: list[str], handler: Callable[[DataFrame, int], None], commits: str, checkpoint: str, every: str | None = None):
        if not group or not topics:
            raise ValueError("a group and topics are needed")
        self.start_with = (store, group, topics, handler, commits, checkpoint, every)
        self.query: StreamingQuery | None = None

    def start(self) -> StreamingQuery:
        if self.query is None or not self.query.isActive:
            store, group, topics, handler, commits, checkpoint, every = self.start_with
            stored = lambda: store.segments().where(F.col("topic").isin(topics) & F.startswith("entry", F.lit("batch-")))
            self.query = consume(topic_stream(store.spark, store.path, topics), handler, group, commits, checkpoint, every, stored)
        return self.query

    def close(self) -> None:
        if self.query is not None:
            self.query.stop()


def consume(stream: DataFrame, handler: Callable[[DataFrame, int], None], group: str, commits: str, checkpoint: str, every: str | None = None, stored: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Runs handler on each micro-batch, then commits: at least once, and a replayed batch's commit replaces its own.

    Files come by their times, not by their offsets, so a later micro-batch may hold lower ones. A partition's commit is its first offset
    that isn't handled yet; what was handled above it is kept beside the checkpoint's own tables, and counts once the gap is filled.
    stored() gives the segments (topic, partition, base, hi) that the stream reads: gaps between them, and below the first, will never be
    filled. Without it offsets are dense from 0, so a message that the stream leaves out holds the commit: leave it out in the handler.
    """

    def one(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            handler(rows, batch)
            done = handled(rows, batch, f"{checkpoint}/handled", stored).where("first = 0 and fresh")
            done = done.select(*PART, F.col("next").alias("offset"), F.lit(group).alias("group_id"), F.lit(batch).cast("long").alias("commit_seq"))
            done.write.mode("overwrite").parquet(f"{commits}/group={group}/seq={batch}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def handled(rows: DataFrame, batch: int, path: str, stored: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The runs of offsets handled up to a micro-batch, written under its number from those of the one before it."""
    spark = rows.sparkSession
    every = runs(rows)
    before = sorted(n for n in (int(x.removeprefix("seq=")) for x in names(spark, path)) if n < batch)
    if before:
        every = every.unionByName(spark.read.schema(RUNS).parquet(f"{path}/seq={before[-1]}").withColumn("fresh", F.lit(False)))
    if stored is not None:
        every = every.unionByName(gaps(stored()))
    merged(every).coalesce(1).write.mode("overwrite").parquet(f"{path}/seq={batch}")
    for n in before[:-1]:  # the last micro-batch alone may be replayed
        remove(spark, f"{path}/seq={n}")
    return spark.read.schema(RUNS).parquet(f"{path}/seq={batch}")


def runs(rows: DataFrame) -> DataFrame:
    """Rows' offsets as runs, found inside stretches, so that a hot partition is not one task."""
    at = rows.select(*PART, "offset", F.floor(F.col("offset") / STRETCH).alias("__s"))
    near = Window.partitionBy(*PART, "__s").orderBy("offset")
    each = at.withColumn("__k", F.col("offset") - F.dense_rank().over(near)).groupBy(*PART, "__s", "__k").agg(F.min("offset").alias("first"), (F.max("offset") + 1).alias("next"))
    return each.select(*PART, "first", "next", F.lit(True).alias("fresh"))


def gaps(segments: DataFrame) -> DataFrame:
    """The runs of offsets below and between segments: deleted ones."""
    by = Window.partitionBy(*PART).orderBy("base")
    first = F.coalesce(F.lag("hi").over(by) + 1, F.lit(0))
    return segments.select(*PART, first.cast("long").alias("first"), F.col("base").alias("next"), F.lit(False).alias("fresh")).where("first < next")


def merged(every: DataFrame) -> DataFrame:
    """Runs that meet or overlap as one."""
    by = Window.partitionBy(*PART).orderBy("first", "next")
    reach = F.max("next").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("first") > reach, F.lit(True)).cast("int")
    marked = every.withColumn("__a", apart).withColumn("__k", F.sum("__a").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*PART, "__k").agg(F.min("first").alias("first"), F.max("next").alias("next"), F.max("fresh").alias("fresh")).drop("__k")


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("topic", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def sliding(stream: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("topic", F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def within(left: DataFrame, right: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, left_id, right_id) of messages of one key, the right one at most so many seconds after the left; both sides' state is bounded by the watermark."""
    a = left.withWatermark("ts", late).select("key", F.col("id").alias("left_id"), F.col("ts").alias("left_ts"))
    b = right.withWatermark("ts", late).select(F.col("key").alias("__key"), F.col("id").alias("right_id"), F.col("ts").alias("right_ts"))
    near = (F.col("right_ts") >= F.col("left_ts")) & (F.col("right_ts") <= F.col("left_ts") + F.expr(f"interval {int(seconds)} seconds"))
    return a.join(b, (F.col("key") == F.col("__key")) & near).select("key", "left_id", "right_id")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Messages by id, once within the watermark: what retried publishing repeats is dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["topic", "id"])


class Delay(StatefulProcessor):
    """Holds a key's messages until the watermark passes ts + delay, by a timer for each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", StructType([StructField("id", StringType()), StructField("due", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, ready = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            for message, due in zip(pdf.id, pdf.due_ms, strict=True):
                if due <= now:
                    ready.append((key[0], message, due))
                else:
                    self.held.appendValue((message, int(due)))
                    self.handle.registerTimer(int(due))
        yield pd.DataFrame(ready, columns=["key", "id", "due_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.held.get())
        self.held.put([x for x in held if x[1] > at]) if any(x[1] > at for x in held) else self.held.clear()
        yield pd.DataFrame([(key[0], x[0], x[1]) for x in held if x[1] <= at], columns=["key", "id", "due_ms"])

    def close(self) -> None:
        pass


def delayed(stream: DataFrame, seconds: str, late: str = "0 seconds") -> DataFrame:
    """(key, id, due_ms) of each message when it is due: ts + seconds (a column). Needs the RocksDB state store."""
    due = stream.withWatermark("ts", late).select("key", "id", "ts", (F.unix_millis("ts") + F.col(seconds) * 1000).cast("long").alias("due_ms"))
    return due.groupBy("key").transformWithStateInPandas(Delay(), outputStructType="key string, id string, due_ms bigint", outputMode="Append", timeMode="EventTime")
