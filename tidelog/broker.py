"""What a client asks of the log: publish, subscribe, pull, acknowledge, and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.routing import attribute
from tidelog.operators import groups, log
from tidelog.sources.metadata import Metadata
from tidelog.sources.store import LogStore

PART = ["topic", "partition"]


class Broker:
    """Messages in a LogStore, control tables in Metadata, both under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store, self.meta = spark, LogStore(spark, f"{path}/log"), Metadata(spark, f"{path}/meta")

    def publish(self, messages: DataFrame, batch: int, keyed: bool = False, new_ids: bool = False) -> DataFrame:
        """Appends (topic, id, key, body, ts[, kind, attributes]) and returns (id, topic, partition, offset, ts) of the batch.

        All topics must exist, else nothing is written. Batches are numbered by the caller and go in rising
        order; one that is sent again changes nothing, so retries repeat nothing.
        """
        topics = self.meta.view("topics").select("topic", "partitions")
        unknown = messages.select("topic").distinct().join(topics, "topic", "left_anti").limit(5).collect()
        if unknown:
            raise ValueError(f"no topic {', '.join(sorted(str(r['topic']) for r in unknown))}")
        fresh = self.store.publish(messages, batch, keyed, topics, new_ids)
        stored = self.store.read(batch=batch).select("id", *PART, "offset", "ts")
        if fresh:
            self.meta.record("publish", stored.count())
        return stored

    def replicate(self, messages: DataFrame, batch: int, node: str) -> DataFrame:
        """The follower's side: appends messages whose attribute partition_id says their partition, and reports how far each goes.

        Returns (topic, partition, node, offset). They are stored under the partition they name, not routed again.
        """
        self.store.append(messages.withColumn("partition", attribute(F.col("attributes"), "partition_id", F.lit("0")).cast("int")), batch)
        status = self.store.end_offsets().select(*PART, F.lit(node).alias("node"), (F.col("next_offset") - 1).alias("offset"))
        self.meta.replicated(status)
        return status

    def _known(self, group: str, topics: list[str]) -> None:
        if not group or not topics or not all(topics):
            raise ValueError("a group and topics are needed")

    def subscribe(self, group: str, topics: list[str], members: list[str]) -> None:
        self._known(group, topics)
        self.meta.subscribe(group, topics, members)
        self.meta.record("subscribe")

    def pull(self, group: str, consumer: str | None = None, most: int = 100, topics: list[str] | None = None) -> DataFrame:
        """From each of the consumer's partitions (the group's, if it is unknown), floor(most / partitions) messages from the committed offset on.

        topics: of these alone, which must exist. The offsets wanted reach the files, so a pull reads what lies behind the least of them.
        """
        self._known(group, ["any"] if topics is None else topics)
        missing = [t for t in topics or () if not self.meta.topic(t)]
        if missing:
            raise ValueError(f"no topic {', '.join(missing)}")
        own = groups.assigned_to(self.meta.view("assignments"), group, consumer or "").withColumn("group_id", F.lit(group))
        own = own if topics is None else own.where(F.col("topic").isin(topics))
        self.meta.record("pull")
        return log.pull(self.store.read(), own, self.meta.committed(), most)

    def ack(self, group: str, topic: str, ids: list[str], every: bool = False) -> None:
        """Commits behind the last id, for its partition; every: behind each partition's highest of the ids."""
        self._known(group, [topic])
        if not ids:
            raise ValueError("ids are needed")
        acks = self.spark.createDataFrame([(group, topic, ids)], "group_id string, topic string, ids array<string>")
        wanted = ids if every else ids[-1:]
        found = self.store.read(topic).where(F.col("id").isin(wanted))  # reaches the scan
        self.meta.commit(groups.ack_all(acks, found) if every else groups.ack_last(acks, found))
        self.meta.record("ack", len(ids))

    def republish(self, messages: DataFrame, ready: Column, batch: int) -> DataFrame:
        """Delayed messages that are due, published again as NORMAL ones without attributes; those that aren't are returned."""
        self.publish(log.drain(messages, ready).drop("attributes"), batch)
        return messages.where((F.col("kind") == "DELAYED") & ~ready)

    def bury(self, attempts: DataFrame, batch: int, most: int = 3, topic: str = "dead-letter") -> DataFrame:
        """attempts: (topic, id, failed). Publishes the stored messages that failed most times to the dead-letter topic, their topic and attempts as attributes."""
        dead = log.dead_letters(attempts, most, topic).where(F.col("topic") == topic)
        rows = self.store.read().join(dead.select(F.col("origin").alias("topic"), "id", "attempts"), ["topic", "id"])
        notes = F.create_map(F.lit("origin"), F.col("topic"), F.lit("attempts"), F.col("attempts").cast("string"))
        return self.publish(rows.select(F.lit(topic).alias("topic"), "id", "key", "body", "ts", F.lit("DEAD_LETTER").alias("kind"), notes.alias("attributes")), batch)

    def ends(self) -> DataFrame:
        return self.store.end_offsets().withColumnRenamed("next_offset", "leo")

    def lag(self) -> DataFrame:
        """(group_id, topic, partition, committed, leo, lag); a partition without messages ends at 0. From control tables alone."""
        ends = self.meta.view("partitions").select(*PART).join(self.ends(), PART, "left").select(*PART, F.coalesce("leo", F.lit(0)).cast("long").alias("leo"))
        subscribed = self.meta.view("groups").select("group_id", F.explode("topics").alias("topic"))
        return groups.lag(subscribed, ends, self.meta.changes("commits").withColumnRenamed("seq", "commit_seq"))

    def topic_stats(self) -> DataFrame:
        """(topic, partitions: [(partition, latest, leader, isr_size)]); latest is -1 where nothing is stored."""
        rows = self.meta.view("partitions").join(self.ends(), PART, "left")
        each = F.struct("partition", (F.coalesce("leo", F.lit(0)) - 1).cast("long").alias("latest"), "leader", F.size("isr").alias("isr_size"))
        return rows.groupBy("topic").agg(F.array_sort(F.collect_list(each)).alias("partitions"))  # control rows, few a topic

    def metrics(self) -> list[str]:
        """Totals of operations, end offsets and lags as lines of text."""
        ops = [f'operations_total{{op="{r.op}"}} {r.n}' for r in self.meta.totals().collect()]
        ends = [f'log_end_offset{{topic="{r.topic}",partition="{r.partition}"}} {r.next_offset}' for r in self.store.end_offsets().collect()]
        lags = [f'consumer_lag{{group="{r.group_id}",topic="{r.topic}",partition="{r.partition}"}} {r.lag}' for r in self.lag().collect()]
        return sorted(ops) + sorted(ends) + sorted(lags)

    def metrics_json(self) -> DataFrame:
        """(kind, line): the same and the topics' partitions, a JSON object a line."""
        kinds = {"counter": self.meta.totals(), "topic": self.topic_stats(), "lag": self.lag()}
        lines = [df.select(F.lit(k).alias("kind"), F.to_json(F.struct("*")).alias("line")) for k, df in kinds.items()]
        return lines[0].unionByName(lines[1]).unionByName(lines[2])
