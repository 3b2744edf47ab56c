"""Retention: policies as DataFrames of doomed segments. The active segment is always kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["topic", "partition", "base"]
#: The default policy: by time, seven days.
KEEP_S = 7 * 86_400


def by_time(segments: DataFrame, now: Column, keep_s: int) -> DataFrame:
    age = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(keep_s).cast("decimal(18,6)"))
    return segments.where(~F.col("active") & (F.col("last_ts") < now - age)).select(*KEY)


def by_size(segments: DataFrame, max_bytes: int) -> DataFrame:
    """Oldest first, until what is left of a partition is at most max_bytes."""
    w = Window.partitionBy("topic", "partition")
    before = F.coalesce(F.sum("bytes").over(w.orderBy("base").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.withColumn("left", F.sum("bytes").over(w) - before).where((F.col("left") > max_bytes) & ~F.col("active")).select(*KEY)


def by_offset(segments: DataFrame, least: int) -> DataFrame:
    return segments.where(~F.col("active") & (F.col("hi") < least)).select(*KEY)


def composite(segments: DataFrame, now: Column, keep_s: int, max_bytes: int, least: int) -> DataFrame:
    """What any of the three policies dooms, from one reading of the segments."""
    w = Window.partitionBy("topic", "partition")
    before = F.coalesce(F.sum("bytes").over(w.orderBy("base").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    age = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(keep_s).cast("decimal(18,6)"))
    doomed = (F.col("last_ts") < now - age) | (F.col("left") > max_bytes) | (F.col("hi") < least)
    return segments.withColumn("left", F.sum("bytes").over(w) - before).where(~F.col("active") & doomed).select(*KEY)


def any_of(*doomed: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, doomed).distinct()


def apply(log: DataFrame, segments: DataFrame, doomed: DataFrame, max_count: int) -> DataFrame:
    """The log without the doomed segments' messages (segments of max_count)."""
    gone = doomed.select("topic", "partition", F.col("base").alias("__base"))
    return log.withColumn("__base", F.col("offset") - F.pmod(F.col("offset"), F.lit(max_count))).join(gone, ["topic", "partition", "__base"], "left_anti").drop("__base")
