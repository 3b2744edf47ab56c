"""The log: offsets, range scans, pulls, look-ups.

A log is a DataFrame of (topic, partition, offset, id, key, body, ts, ...); offsets are dense from 0 in
each (topic, partition).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = ["topic", "partition"]


def assign_offsets(df: DataFrame, order: list[str], bucket: Column, base: DataFrame | None = None) -> DataFrame:
    """Dense offsets by topic and partition, in the given order.

    bucket is a coarse prefix of the order (a day of the first column, say). Rows are numbered inside
    buckets, and a bucket starts at the number of rows in earlier ones, so a hot partition is spread over
    as many tasks as it has buckets. base: (topic, partition, next_offset) of what is stored.
    """
    marked = df.withColumn("__b", bucket)
    counts = marked.groupBy(*PART, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*PART).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*PART, "__b"]
    starts = counts.select(*(F.col(c).alias(f"__s_{c}") for c in keys), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = marked.withColumn("__r", F.row_number().over(inside))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in keys))
    out = numbered.join(starts, same).drop(*(f"__s_{c}" for c in keys))
    if base is not None:
        out = out.join(base, PART, "left")
    first = F.coalesce(F.col("next_offset"), F.lit(0)) if base is not None else F.lit(0)
    return out.withColumn("offset", (first + F.col("__start") + F.col("__r") - 1).cast("long")).drop("__b", "__r", "__start", "next_offset")


def scan(log: DataFrame, begin: int, count: int, topic: str | None = None, partition: int | None = None) -> DataFrame:
    """Offsets [begin, begin + count) of each partition. On a stored log (LogStore.read) the bounds, topic and partition reach the files; on one that is numbered here, they come after the numbering."""
    out = log.where((F.col("offset") >= begin) & (F.col("offset") < begin + count))
    if topic is not None:
        out = out.where(F.col("topic") == topic)
    return out if partition is None else out.where(F.col("partition") == partition)


def check_range(begin: Column, on_out_of_range: str = "error") -> Column:
    """begin, or what on_out_of_range makes of one below the first retained offset (column first_offset)."""
    if on_out_of_range == "earliest":
        return F.greatest(begin, F.col("first_offset"))
    return F.when(begin >= F.col("first_offset"), begin).otherwise(F.raise_error(F.lit("offset below the first retained one")))


def pull(log: DataFrame, assigned: DataFrame, committed: DataFrame, most: int) -> DataFrame:
    """What each group gets: from each assigned partition, floor(most / partitions) messages from the committed offset.

    assigned: (group_id, topic, partition); committed: (group_id, topic, partition, committed). Both are
    control tables; the offset range filters the log after one join, without a window.
    """
    n = Window.partitionBy("group_id")
    wanted = assigned.join(committed, ["group_id", *PART], "left").select("group_id", *PART, F.coalesce("committed", F.lit(0)).alias("from"), F.floor(F.lit(most) / F.count(F.lit(1)).over(n)).alias("share"))
    return log.join(wanted, PART).where((F.col("offset") >= F.col("from")) & (F.col("offset") < F.col("from") + F.col("share"))).drop("from", "share")


def locate(log: DataFrame, ids: DataFrame) -> DataFrame:
    """(topic, id) -> partition and offset."""
    return log.join(ids.select("topic", "id").distinct(), ["topic", "id"]).select("topic", "id", "partition", "offset")


def dedup(log: DataFrame) -> DataFrame:
    """The first occurrence of each (topic, id)."""
    keep = log.groupBy("topic", "id").agg(F.min(F.struct("partition", "offset")).alias("at"))
    return keep.select("topic", "id", "at.partition", "at.offset")


def known(messages: DataFrame, topics: DataFrame) -> DataFrame:
    """The messages of topics that exist."""
    return messages.join(topics.select("topic"), "topic", "left_semi")


def drain(messages: DataFrame, ready: Column) -> DataFrame:
    """Delayed messages that are due, as they are published again: NORMAL, without attributes."""
    return messages.where((F.col("kind") == "DELAYED") & ready).withColumn("kind", F.lit("NORMAL")).drop("attributes")


def dead_letters(attempts: DataFrame, most: int = 3, topic: str = "dead-letter") -> DataFrame:
    """attempts: (topic, id, failed), a row a delivery. (topic, id, origin, attempts) of each message: to the dead-letter topic once most deliveries failed and none did not."""
    each = attempts.groupBy("topic", "id").agg(F.count_if("failed").alias("attempts"), F.min(F.col("failed").cast("int")).alias("all"))
    gone = (F.col("attempts") >= most) & (F.col("all") == 1)
    return each.select(F.when(gone, topic).otherwise(F.col("topic")).alias("topic"), "id", F.col("topic").alias("origin"), "attempts")


def partitions(log: DataFrame) -> DataFrame:
    return log.select(*PART).distinct()


def replicas_of(log: DataFrame, placed: DataFrame) -> DataFrame:
    """A copy of each message for each replica of its partition."""
    return log.join(placed.select(*PART, F.explode("replicas").alias("node")), PART)
