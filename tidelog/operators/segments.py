"""Segments: rolling, statistics, location, indexes.

Rolling by count is arithmetic. Rolling by bytes, time span, or any of several limits starts anew at each
segment, which no window frame says; a partition's (offset, size, ts) stream through one pass in bounded
memory, which finds segment ends by bisection on running sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.routing import big_endian, from_big_endian

PART = ["topic", "partition"]
#: The default roll policy: by size, 64 MiB. The default sparse interval.
MAX_BYTES, INTERVAL = 64 << 20, 4096
SEGMENT = "topic string, partition int, base bigint, hi bigint, n bigint, bytes bigint, first_us bigint, last_us bigint"


def should_roll(bytes_: Column | None = None, n: Column | None = None, age_us: Column | None = None, max_bytes: int | None = None, max_count: int | None = None, span_us: int | None = None) -> Column:
    """Whether a segment of these figures is to be closed: any limit reached, inclusive."""
    out = F.lit(False)
    for value, limit in ((bytes_, max_bytes), (n, max_count), (age_us, span_us)):
        if value is not None and limit is not None:
            out = out | (value >= limit)
    return out


def first_at_least(values: np.ndarray, begin: int, limit: int) -> int:
    """The first place from begin on whose value reaches limit, in whatever order the values are; their number if none."""
    step = 256
    while begin < len(values):
        hit = values[begin : begin + step] >= limit
        if hit.any():
            return begin + int(hit.argmax())
        begin, step = begin + step, step * 2
    return len(values)


def roll(log: DataFrame, max_bytes: int | None = None, max_count: int | None = None, span_us: int | None = None) -> DataFrame:
    """Segments of each partition: a message that would exceed a limit opens the next.

    A message larger than max_bytes is an error. A partition's rows arrive sorted (outside Python, where
    sorting can spill) and in batches; only the open segment's figures are carried from one to the next.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SEGMENT.split(", ")]
        now: list | None = None  # the open segment, as a row
        for pdf in batches:
            rows = []
            for (topic, partition), part in pdf.groupby(PART, sort=False, dropna=False):
                if now is not None and now[:2] != [topic, partition]:
                    rows.append(now)
                    now = None
                size, us, offset = (part[c].to_numpy() for c in ("size", "us", "offset"))
                if max_bytes is not None and (size > max_bytes).any():
                    raise ValueError("a message is larger than a segment")
                sums, begin = np.concatenate([[0], np.cumsum(size)]), 0
                while begin < len(size):
                    n, held, first = (now[4], now[5], now[6]) if now is not None else (0, 0, us[begin])
                    end = len(size)
                    if max_bytes is not None:
                        end = min(end, int(np.searchsorted(sums, sums[begin] + max_bytes - held, "right")) - 1)
                    if max_count is not None:
                        end = min(end, begin + max_count - n)
                    if span_us is not None:
                        end = min(end, first_at_least(us, begin + (n == 0), first + span_us))
                    if end > begin:
                        base = now[2] if now is not None else offset[begin]
                        now = [topic, partition, base, offset[end - 1], n + end - begin, held + int(sums[end] - sums[begin]), first, us[end - 1]]
                        begin = end
                    if begin < len(size):  # a limit was met
                        rows.append(now)
                        now = None
            yield pd.DataFrame(rows, columns=columns)
        yield pd.DataFrame([now] if now is not None else [], columns=columns)

    rows = log.select(*PART, "offset", "size", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rows.repartition(*PART).sortWithinPartitions(*PART, "offset").mapInPandas(run, SEGMENT)


def roll_default(log: DataFrame) -> DataFrame:
    return roll(log, max_bytes=MAX_BYTES)


def by_count(log: DataFrame, max_count: int) -> DataFrame:
    """Segments of max_count messages; the last of a partition is active."""
    seg = log.groupBy(*PART, F.floor(F.col("offset") / max_count).alias("segment")).agg(
        F.min("offset").alias("base"), F.max("offset").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return seg.withColumn("active", F.col("base") == F.max("base").over(Window.partitionBy(*PART)))


def as_of(entries: DataFrame, at: str, targets: DataFrame) -> DataFrame:
    """(topic, partition, target, hit): the last entry at or below each target, as a struct; null if none.

    One sort of entries and targets together, so the cost is linear in both.
    """
    e = entries.select(*PART, F.col(at).alias("__at"), F.lit(0).alias("__kind"), F.struct("*").alias("hit"))
    t = targets.select(*PART, F.col("target").alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(e.schema["hit"].dataType).alias("hit"))
    w = Window.partitionBy(*PART).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = e.unionByName(t).withColumn("hit", F.last("hit", ignorenulls=True).over(w))
    return found.where("__kind = 1").select(*PART, F.col("__at").alias("target"), "hit")


def locate(segments: DataFrame, targets: DataFrame) -> DataFrame:
    """(topic, partition, target) -> base of the segment that holds it; the last is open-ended, below the first is -1."""
    return as_of(segments.select(*PART, "base"), "base", targets).select(*PART, "target", F.coalesce("hit.base", F.lit(-1).cast("long")).alias("base"))


def dense_index(log: DataFrame, stretch: int = 100_000) -> DataFrame:
    """Byte position of every message in its partition.

    Sizes run up inside stretches of offsets, and a stretch starts at the sum of those before it, so a
    hot partition is spread over as many tasks as it has stretches.
    """
    marked = log.select(*PART, "offset", "size", "ts", F.floor(F.col("offset") / stretch).alias("__b"))
    before = Window.partitionBy(*PART).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(*PART, "__b").agg(F.sum("size").alias("__n"))
    starts = sums.select(*PART, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*PART, "__b").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    out = marked.withColumn("__p", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, [*PART, "__b"])
    return out.select(*PART, "offset", (F.col("__start") + F.col("__p")).cast("long").alias("position"), "size", "ts")


def sparse_index(dense: DataFrame, interval: int = INTERVAL, unit: str | None = None) -> DataFrame:
    """Every interval-th message's offset and position; none if the interval isn't positive. unit: "s" or "us", for times as numbers of it."""
    if interval <= 0:
        return sparse_index(dense, 1, unit).limit(0)
    whole = {"s": F.unix_seconds, "us": F.unix_micros}
    ts = F.col("ts") if unit is None else whole[unit](F.col("ts").cast("timestamp")).alias("ts")
    return dense.where(F.pmod(F.col("offset"), F.lit(interval)) == 0).select(*PART, "offset", "position", ts)


class StoredIndex:
    """A sparse index kept as Parquet: (topic, partition) folders of 24-byte entries (offset, position, time in seconds; big-endian)."""

    SCHEMA = "entry binary, topic string, partition int"

    def __init__(self, spark: SparkSession, path: str, interval: int = INTERVAL):
        self.spark, self.path, self.interval = spark, path, interval

    def append(self, dense: DataFrame, number: int) -> None:
        """Adds the entries of newer messages; append number n, given again, replaces itself."""
        entries = sparse_index(dense, self.interval, "s").select(*PART, big_endian(F.col("offset"), F.col("position"), F.col("ts")).alias("entry"))
        entries.write.mode("overwrite").partitionBy(*PART).parquet(f"{self.path}/n={number}")

    def load(self) -> DataFrame:
        """(topic, partition, offset, position, ts) of every entry."""
        rows = self.spark.read.schema(f"{self.SCHEMA}, n int").parquet(self.path)
        return rows.select(*PART, *(from_big_endian(F.col("entry"), i).alias(c) for i, c in enumerate(("offset", "position", "ts"))))


def floor_entry(index: DataFrame, targets: DataFrame, strict: bool = False) -> DataFrame:
    """The greatest entry at or below each target; strict: null outside [first, last] entry."""
    entries = index.select(*PART, F.col("offset").alias("entry"), "position", F.max("offset").over(Window.partitionBy(*PART)).alias("last"))
    found = as_of(entries, "entry", targets.select(*PART, "target").distinct())
    good = F.col("target") <= F.col("hit.last") if strict else F.lit(True)
    return found.select(*PART, "target", F.when(good, F.col("hit.entry")).alias("entry"), F.when(good, F.col("hit.position")).alias("position"))


def offset_for_time(log: DataFrame, times: list) -> DataFrame:
    """The first offset at or after each of the times, by partition (an extension), in one pass; null times' rows are left out."""
    firsts = [F.min(F.when(F.col("ts") >= F.lit(t), F.col("offset"))).alias(f"o{i}") for i, t in enumerate(times)]
    each = F.array(*(F.struct(F.lit(t).cast("timestamp_ntz").alias("t"), F.col(f"o{i}").alias("offset")) for i, t in enumerate(times)))
    return log.groupBy(*PART).agg(*firsts).select(*PART, F.inline(each)).where(F.col("offset").isNotNull())
