"""A log kept as Parquet: one folder a batch, in it one a (topic, partition), which is a segment.

A batch is written aside and put in its place by one rename, so readers see all of it or nothing, and a
batch number that is there is not written again: a replay changes nothing. Beside a batch's rows lie two control
tables, its segments (offsets, bytes, times) and the end offsets after it, so that publishing, lag, retention and
listings never read the log itself. Retention deletes segments' folders. compact() puts one folder in place of many.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.routing import keyed_partition, message_size
from tidelog.operators.log import PART, assign_offsets
from tidelog.operators.retention import KEEP_S, by_time
from tidelog.sources.shared import names, remove, rename

SCHEMA = "id string, key string, body string, ts timestamp, kind string, attributes map<string,string>, size bigint, offset bigint, batch bigint, topic string, partition int"
SEGMENTS = "topic string, partition int, base bigint, hi bigint, n bigint, bytes bigint, first_ts timestamp, last_ts timestamp"
GONE = "topic string, partition int, base bigint, entry string"
ENDS = "topic string, partition int, next_offset bigint"


class LogStore:
    """One writer for each store; batches are numbered by the caller, in rising order."""

    def __init__(self, spark: SparkSession, path: str, partitions: int = 3, compression: str = "zstd"):
        self.spark, self.path, self.partitions, self.compression = spark, path, partitions, compression

    # Folders: entry=batch-<number>, entry=compact-<first>-<last>, numbers of 12 digits; so that an entry is a partition column of one read.

    def _entries(self) -> list[tuple[int, int, str]]:
        """(first batch, last batch, entry) of what is in force, by number; one listing."""
        every = []
        for name in names(self.spark, f"{self.path}/data"):
            entry = name.removeprefix("entry=")
            kind, *numbers = entry.split("-")
            if kind in ("batch", "compact"):
                every.append((int(numbers[0]), int(numbers[-1]), entry))
        wide = [e for e in every if e[2].startswith("compact")]
        inside = lambda a, b: a != b and b[0] <= a[0] and a[1] <= b[1] and (b[1] - b[0] > a[1] - a[0] or a[2].startswith("batch"))
        return sorted(e for e in every if not any(inside(e, w) for w in wide))

    def _from(self, table: str, schema: str, entries: list[tuple[int, int, str]]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], f"{schema}, entry string")
        return self.spark.read.schema(f"{schema}, entry string").option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/entry={e[2]}" for e in entries))

    def read(self, topic: str | None = None, partition: int | None = None, begin: int | None = None, end: int | None = None, batch: int | None = None) -> DataFrame:
        """The log; of a topic and partition alone folders are read, and an offset range [begin, end) reaches the files' statistics."""
        out = self._from("data", SCHEMA, [e for e in self._entries() if batch is None or e[0] <= batch <= e[1]]).drop("entry")
        for column, value in (("topic", topic), ("partition", partition), ("batch", batch)):
            out = out if value is None else out.where(F.col(column) == value)
        out = out if begin is None else out.where(F.col("offset") >= begin)
        return out if end is None else out.where(F.col("offset") < end)

    def scan(self, topic: str, partition: int, begin: int, most: int) -> DataFrame:
        """Offsets [begin, begin + most) of one partition; one that nothing was ever written to is an error."""
        if self.end_offsets().where((F.col("topic") == topic) & (F.col("partition") == partition)).isEmpty():
            raise ValueError(f"no partition {partition} of topic {topic}")
        return self.read(topic, partition, begin, begin + most)

    def end_offsets(self) -> DataFrame:
        """(topic, partition, next_offset), from the last batch's control table."""
        return self._from("ends", ENDS, self._entries()[-1:]).drop("entry")

    def segments(self) -> DataFrame:
        """(topic, partition, base, hi, n, bytes, first_ts, last_ts, entry, active): what is stored; the last of a partition is active."""
        every = self._from("segments", SEGMENTS, self._entries())
        gone = names(self.spark, f"{self.path}/gone")
        if gone:
            every = every.join(self.spark.read.schema(GONE).parquet(*(f"{self.path}/gone/{n}" for n in gone)), [*PART, "base", "entry"], "left_anti")
        return every.withColumn("active", F.col("base") == F.max("base").over(Window.partitionBy(*PART)))

    def publish(self, messages: DataFrame, batch: int, keyed: bool = False, topics: DataFrame | None = None, new_ids: bool = False) -> bool:
        """messages: (topic, id, key, body, ts[, kind, attributes]). Offsets go on where earlier batches end. False if the batch is there.

        topics: (topic, partitions), where topics differ in their number of partitions; others have the store's. new_ids: messages without
        an id get one, and are written with it before they are routed, so that a task that is redone finds the same; without it, a null id is an error.
        """
        if self._has(batch):
            return False
        tried = f"{self.path}/tried/{uuid.uuid4().hex}"
        full = messages
        if new_ids:
            full.withColumn("id", F.coalesce("id", F.uuid()) if "id" in messages.columns else F.uuid()).write.parquet(f"{tried}/ids")
            full = self.spark.read.parquet(f"{tried}/ids")
        count = F.lit(self.partitions)
        if topics is not None:
            full = full.join(topics.select("topic", F.col("partitions").alias("__n")), "topic", "left")
            count = F.coalesce("__n", count)
        route = keyed_partition(F.col("key") if keyed else F.lit(None).cast("string"), F.col("id").cast("string"), count)
        return self.append(full.withColumn("partition", route), batch, tried)

    def _has(self, batch: int) -> bool:
        entries = self._entries()
        if entries and batch <= entries[-1][1]:
            if any(e[0] <= batch <= e[1] for e in entries):
                return True
            raise ValueError("batches go in rising order")
        return False

    def append(self, messages: DataFrame, batch: int, tried: str | None = None) -> bool:
        """As publish(), of messages whose partition is given."""
        if self._has(batch):
            return False
        have = messages.columns
        full = messages.withColumns({
            "kind": F.col("kind") if "kind" in have else F.lit("NORMAL"),
            "attributes": F.col("attributes") if "attributes" in have else F.lit(None).cast("map<string,string>"),
            "id": F.when(F.col("id").isNotNull(), F.col("id").cast("string")).otherwise(F.raise_error(F.lit("a message has no id"))),
        })
        full = full.withColumn("size", message_size(F.col("id"), F.col("body")))
        ends = self.end_offsets()
        placed = assign_offsets(full, ["ts", "id"], F.date_trunc("day", F.col("ts")), ends).withColumn("batch", F.lit(batch))
        rows = placed.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")))
        self._commit(rows, ends, tried or f"{self.path}/tried/{uuid.uuid4().hex}", f"batch-{batch:012}")
        return True

    def _commit(self, rows: DataFrame, ends: DataFrame, tried: str, name: str) -> None:
        rows.sortWithinPartitions(*PART, "offset").write.option("compression", self.compression).partitionBy(*PART).parquet(f"{tried}/rows")
        done = self.spark.read.schema(SCHEMA).parquet(f"{tried}/rows")
        segments, ends_path = f"{self.path}/segments/entry={name}", f"{self.path}/ends/entry={name}"
        found = done.groupBy(*PART).agg(F.min("offset").alias("base"), F.max("offset").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        found.coalesce(1).write.mode("overwrite").parquet(segments)  # what is there is of a writer that died before its rows were in place
        after = self.spark.read.schema(SEGMENTS).parquet(segments).select(*PART, (F.col("hi") + 1).alias("next_offset"))
        ends.unionByName(after).groupBy(*PART).agg(F.max("next_offset").alias("next_offset")).coalesce(1).write.mode("overwrite").parquet(ends_path)
        if not rename(self.spark, f"{tried}/rows", f"{self.path}/data/entry={name}"):
            raise ValueError(f"{name} is there: a store has one writer")
        remove(self.spark, tried)

    def compact(self) -> bool:
        """One folder in place of all; a partition's rows in order, a large one in several files. False if there is one folder or none."""
        entries = self._entries()
        if len(entries) < 2:
            return False
        name = f"compact-{entries[0][0]:012}-{entries[-1][1]:012}"
        rows = self.read().repartitionByRange(*PART, "offset")
        self._commit(rows, self.end_offsets(), f"{self.path}/tried/{uuid.uuid4().hex}", name)
        for e in entries:  # out of force already
            for table in ("data", "segments", "ends"):
                remove(self.spark, f"{self.path}/{table}/entry={e[2]}")
        return True

    def delete(self, doomed: DataFrame) -> int:
        """Deletes the segments of (topic, partition, base); how many went. The active one of a partition stays."""
        wanted = self.segments().where(~F.col("active")).join(doomed.select(*PART, "base").distinct(), [*PART, "base"]).select(*PART, "base", "entry").collect()  # control rows
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for r in wanted:
            remove(self.spark, f"{self.path}/data/entry={r.entry}/topic={escape(r.topic)}/partition={r.partition}")
        if wanted:
            self.spark.createDataFrame([tuple(r) for r in wanted], GONE).coalesce(1).write.parquet(f"{self.path}/gone/{uuid.uuid4().hex}")
        return len(wanted)

    def cleanup(self, now, doomed: DataFrame | None = None) -> int:
        """The retention job: deletes the doomed segments (by default, those whose newest message is over seven days older than now)."""
        return self.delete(by_time(self.segments(), F.lit(now), KEEP_S) if doomed is None else doomed)

    def recover(self) -> DataFrame:
        """(topic, partition, base, entry) of every segment, from the folders and files alone, as after a loss of the control tables."""
        return self._from("data", SCHEMA, self._entries()).groupBy(*PART, "entry").agg(F.min("offset").alias("base"))

    def render_metrics(self) -> DataFrame:
        """End offsets as lines of text."""
        return self.end_offsets().select(F.format_string('log_end_offset{topic="%s",partition="%d"} %d', "topic", "partition", "next_offset").alias("value"))

