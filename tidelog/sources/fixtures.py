"""The driver's tables as a log and its control tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.routing import message_size, partition_of
from tidelog.operators.log import PART, assign_offsets

PARTITIONS = 3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages without offsets: topic = event_type, key = user_id, body = props."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("topic"), partition_of(F.col("event_id").cast("string"), PARTITIONS).alias("partition"), F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("body"), "ts", "value",
    ).withColumn("size", message_size(F.col("id"), F.col("body")))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_offsets(routed(spark, sf_dir), ["ts", "seq"], F.date_trunc("day", F.col("ts")))


def leo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End offsets; dense offsets make them counts, so no numbering is needed."""
    return routed(spark, sf_dir).groupBy(*PART).agg(F.count(F.lit(1)).alias("leo"))


GROUPS = ("g1", "g2")


def for_groups(df: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """Each row once for each group."""
    return df.withColumn("group_id", F.explode(F.array(*map(F.lit, groups))))


def newest(spark: SparkSession, sf_dir: str) -> Column:
    """The newest event's time, as a scalar subquery: "now" comes from the data, so reruns agree."""
    return read(spark, sf_dir, "events").agg(F.max("ts")).scalar()


def members(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values ('g1', 'c2'), ('g1', 'c1'), ('g2', 'c1') as t(group_id, consumer_id)")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three commits of each group and partition; the last goes back."""
    rows = for_groups(leo(spark, sf_dir))
    part = F.explode(F.array(F.struct(F.lit(1).alias("q"), F.lit(4).alias("d")), F.struct(F.lit(2).alias("q"), F.lit(2).alias("d")), F.struct(F.lit(3).alias("q"), F.lit(3).alias("d"))))
    rows = rows.select("group_id", *PART, "leo", part.alias("c")).where("not (group_id = 'g2' and partition = 2)")
    return rows.select("group_id", *PART, F.floor(F.col("leo") / F.col("c.d")).alias("offset"), F.col("c.q").cast("long").alias("commit_seq"))


def brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as brokers, their regions as racks; last seen up to a minute before the newest event."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("now", newest(spark, sf_dir))
    seen = F.col("now") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((F.col("n_nationkey") * 17 + 20) % 60).cast("decimal(18,6)"))
    return rows.select(F.col("n_name").alias("broker"), F.col("r_name").alias("rack"), F.col("n_nationkey").alias("k"), seen.alias("last_seen"), "now")
