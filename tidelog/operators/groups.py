"""Consumer groups: assignment, commits, acknowledgements, lag, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART = ["topic", "partition"]


def assign(partitions: DataFrame, members: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Partition i of a topic goes to the group's consumer i mod n, consumers by name.

    members: (group_id, consumer_id); subscriptions: (group_id, topic).
    """
    who = members.distinct().withColumn("o", F.row_number().over(Window.partitionBy("group_id").orderBy("consumer_id")) - 1)
    sizes = members.groupBy("group_id").agg(F.countDistinct("consumer_id").alias("n"))
    parts = partitions.select(*PART, (F.row_number().over(Window.partitionBy("topic").orderBy("partition")) - 1).alias("i"))
    turn = parts.join(subscriptions, "topic").join(sizes, "group_id").withColumn("o", F.pmod(F.col("i"), F.col("n")).cast("int"))
    return turn.join(who, ["group_id", "o"]).select("group_id", "consumer_id", *PART)


def assigned_to(assigned: DataFrame, group: str, consumer: str) -> DataFrame:
    """A consumer's partitions; an unknown consumer gets the whole group's."""
    own = assigned.where(F.col("group_id") == group)
    known = own.where(F.col("consumer_id") == consumer).agg(F.count(F.lit(1))).scalar()
    return own.where((F.col("consumer_id") == consumer) | (known == 0)).select(*PART).distinct()


def members_or_default(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, consumer_id) of each group; a group without consumers has one of its own name."""
    who = F.coalesce("consumer_id", F.concat("group_id", F.lit("-consumer")))
    return groups.join(members.distinct(), "group_id", "left").select("group_id", who.alias("consumer_id"))


def committed(commits: DataFrame) -> DataFrame:
    """The latest commit of each (group, topic, partition) wins, even if it goes back."""
    return commits.groupBy("group_id", *PART).agg(F.max_by("offset", "commit_seq").alias("committed"))


def ack_last(acks: DataFrame, log: DataFrame) -> DataFrame:
    """acks: (group_id, topic, ids). Commits the last id's offset + 1, for its partition alone."""
    last = acks.select("group_id", "topic", F.element_at("ids", -1).alias("id"))
    return last.join(log.select("topic", "id", "partition", "offset"), ["topic", "id"]).select("group_id", *PART, (F.col("offset") + 1).alias("offset"))


def ack_all(acks: DataFrame, log: DataFrame) -> DataFrame:
    """Commits each partition's highest acknowledged offset + 1 (an extension)."""
    ids = acks.select("group_id", "topic", F.explode("ids").alias("id"))
    return ids.join(log.select("topic", "id", "partition", "offset"), ["topic", "id"]).groupBy("group_id", *PART).agg((F.max("offset") + 1).alias("offset"))


def end_offsets(log: DataFrame) -> DataFrame:
    return log.groupBy(*PART).agg((F.max("offset") + 1).alias("leo"))


def lag(groups: DataFrame, leo: DataFrame, commits: DataFrame) -> DataFrame:
    """groups: (group_id, topic). Lag is max(0, end - committed); an empty partition's is 0."""
    rows = groups.join(leo, "topic").join(committed(commits), ["group_id", *PART], "left")
    done = F.coalesce("committed", F.lit(0)).cast("long")
    return rows.select("group_id", *PART, done.alias("committed"), "leo", F.greatest(F.lit(0), F.col("leo") - done).cast("long").alias("lag"))


def unacked(delivered: DataFrame, acked: DataFrame) -> DataFrame:
    return delivered.join(acked, ["group_id", "topic", "id"], "left_anti")
