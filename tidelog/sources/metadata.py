"""Control tables: topics, partitions, groups, assignments, commits, replica status, brokers.

Each table is an append-only log of numbered changes kept as Parquet; its view is the latest change of
each key, unless that one removes it. Changes have one writer, as the coordinator is one. A change's rows
are written once under its number, so a replayed change replaces itself.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import groups, placement

#: Table -> (key columns, other columns).
TABLES = {
    "topics": ("topic string", "partitions int, rf int"),
    "partitions": ("topic string, partition int", "leader string, isr array<string>, replicas array<string>"),
    "groups": ("group_id string", "topics array<string>, members array<string>"),
    "assignments": ("group_id string, topic string, partition int", "consumer_id string"),
    "commits": ("group_id string, topic string, partition int", "offset bigint"),
    "replica_status": ("topic string, partition int, node string", "offset bigint"),
    "brokers": ("broker string", "address string, rack string, last_seen timestamp"),
    "services": ("service string, node string", "address string, last_seen timestamp"),
    "generations": ("group_id string", "generation bigint"),
    "operations": ("op string", "n bigint"),
}


def names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def latest(changes: DataFrame, key: list[str], order: str = "seq", gone: str = "gone") -> DataFrame:
    """The last change of each key; keys whose last change removes them are left out."""
    rest = [c for c in changes.columns if c not in (*key, order)]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__last"))
    return last.select(*key, "__last.*").where(~F.col(gone)).drop(gone)


class Metadata:
    """The control tables under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def changes(self, table: str) -> DataFrame:
        key, rest = TABLES[table]
        schema = f"{key}, {rest}, gone boolean, seq bigint"
        fs, p = self._fs(f"{self.path}/{table}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}") if fs.exists(p) else self.spark.createDataFrame([], schema)

    def view(self, table: str) -> DataFrame:
        return latest(self.changes(table), names(TABLES[table][0]))

    def next_seq(self, table: str) -> int:
        fs, p = self._fs(f"{self.path}/{table}")
        done = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return 1 + max((int(n.removeprefix("seq=")) for n in done if n.startswith("seq=")), default=0)

    def put(self, table: str, rows: DataFrame, gone: bool = False, seq: int | None = None) -> int:
        """Appends one change and returns its number; columns that rows lack are null."""
        key, rest = TABLES[table]
        types = dict(c.split() for c in f"{key}, {rest}".split(", "))
        cols = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
        seq = self.next_seq(table) if seq is None else seq
        rows.select(*cols, F.lit(gone).alias("gone")).write.mode("overwrite").parquet(f"{self.path}/{table}/seq={seq}")
        return seq

    def put_rows(self, table: str, rows: list[dict], gone: bool = False) -> int:
        key, rest = TABLES[table]
        cols = names(key) if gone else names(f"{key}, {rest}")
        types = dict(c.split() for c in f"{key}, {rest}".split(", "))
        return self.put(table, self.spark.createDataFrame([tuple(r.get(c) for c in cols) for r in rows], ", ".join(f"{c} {types[c]}" for c in cols)), gone)

    # Services, and what was asked of the log

    def register(self, service: str, node: str, address: str, last_seen=None) -> None:
        self.put_rows("services", [{"service": service, "node": node, "address": address, "last_seen": last_seen}])

    def unregister(self, service: str, node: str) -> None:
        self.put_rows("services", [{"service": service, "node": node}], gone=True)

    def discover(self, service: str) -> DataFrame:
        """(node, address, last_seen) of a service."""
        return self.view("services").where(F.col("service") == service).drop("service")

    def record(self, op: str, n: int = 1) -> None:
        """One operation in the operation log, which counts n."""
        self.put_rows("operations", [{"op": op, "n": n}])

    def totals(self) -> DataFrame:
        """(op, n): how much of each operation there was."""
        return self.changes("operations").groupBy("op").agg(F.sum("n").alias("n"))

    # Brokers

    def join(self, broker: str, address: str, rack: str | None = None, last_seen=None) -> None:
        """Joins a broker, or renews it: what a heartbeat does."""
        self.put_rows("brokers", [{"broker": broker, "address": address, "rack": rack, "last_seen": last_seen}])

    def leave(self, broker: str) -> None:
        self.put_rows("brokers", [{"broker": broker}], gone=True)

    def add_broker(self, broker: str, address: str, rack: str | None = None) -> dict[str, str]:
        """Joins a broker and places every topic anew with the least movement; (topic, what was wrong) of those that couldn't be, the others being done."""
        self.join(broker, address, rack)
        return self.rebalance_all()

    def remove_broker(self, broker: str) -> dict[str, str]:
        self.leave(broker)
        return self.rebalance_all()

    def rebalance_all(self) -> dict[str, str]:
        faults = {}
        for topic in self.topics():
            try:
                self.rebalance(topic)
            except ValueError as fault:
                faults[topic] = str(fault)
        return faults

    def brokers(self) -> list[str]:
        return sorted(r["broker"] for r in self.view("brokers").select("broker").collect())

    # Topics and partitions

    def topic(self, topic: str) -> dict | None:
        row = self.view("topics").where(F.col("topic") == topic).first()
        return row.asDict() if row else None

    def topics(self) -> list[str]:
        return sorted(r["topic"] for r in self.view("topics").select("topic").collect())

    def create_topic(self, topic: str, partitions: int = 3, rf: int = 1) -> None:
        """Places a new topic's partitions in turn; every replica is in sync at first."""
        if self.topic(topic):
            raise ValueError(f"topic {topic} exists")
        placed = placement.least_movement(partitions, self.brokers(), rf, None)
        self._place(topic, placed, [replicas for _, replicas in placed])
        self.put_rows("topics", [{"topic": topic, "partitions": partitions, "rf": rf}])

    def _place(self, topic: str, placed: list[tuple[str, list[str]]], isr: list[list[str]]) -> None:
        self.put_rows("partitions", [{"topic": topic, "partition": p, "leader": leader, "isr": i, "replicas": r} for p, ((leader, r), i) in enumerate(zip(placed, isr, strict=True))])

    def create_partition(self, topic: str, partition: int, leader: str, replicas: list[str]) -> None:
        """One partition of a topic, all replicas in sync; an error if it is there."""
        if self.partition(topic, partition):
            raise ValueError(f"partition {partition} of topic {topic} exists")
        self.put_rows("partitions", [{"topic": topic, "partition": partition, "leader": leader, "isr": replicas, "replicas": replicas}])

    def delete_partition(self, topic: str, partition: int) -> None:
        self.put_rows("partitions", [{"topic": topic, "partition": partition}], gone=True)

    def partition(self, topic: str, partition: int) -> dict | None:
        row = self.partitions(topic).where(F.col("partition") == partition).first()
        return row.asDict() if row else None

    def leads(self, node: str, topic: str, partition: int) -> bool:
        found = self.partition(topic, partition)
        return found is not None and found["leader"] == node

    def delete_topic(self, topic: str) -> None:
        if not self.topic(topic):
            raise ValueError(f"no topic {topic}")
        self.put("partitions", self.partitions(topic).select("topic", "partition"), gone=True)
        self.put_rows("topics", [{"topic": topic}], gone=True)

    def partitions(self, topic: str | None = None) -> DataFrame:
        """(topic, partition, leader, isr, replicas, followers)."""
        out = self.view("partitions").withColumn("followers", F.array_except("replicas", F.array("leader")))
        return out if topic is None else out.where(F.col("topic") == topic)

    def of_node(self, node: str, role: str = "replica") -> DataFrame:
        """The partitions of which a node is a replica, the leader, or a follower."""
        return self.partitions().where(node_role(F.lit(node), role))

    def rebalance(self, topic: str) -> None:
        """Places a topic's partitions anew with the least movement; in sync are the leader and old members that are still replicas."""
        old = self.partitions(topic).orderBy("partition").collect()
        placed = placement.least_movement(len(old), self.brokers(), self.topic(topic)["rf"], [(r["leader"], list(r["replicas"])) for r in old])
        isr = [[leader, *(x for x in r["isr"] if x in replicas and x != leader)] for (leader, replicas), r in zip(placed, old, strict=True)]
        self._place(topic, placed, isr)

    def fail_over(self, dead: list[str]) -> None:
        """Partitions led by a dead broker go to the first living member of their in-sync set; one that has none keeps its leader."""
        chosen = placement.elect(self.view("partitions"), self.spark.createDataFrame([(d,) for d in dead], "broker string")).where(F.col("new_leader").isNotNull())
        rows = self.view("partitions").join(chosen.select("topic", "partition", "new_leader"), ["topic", "partition"])
        self.put("partitions", rows.withColumn("leader", F.col("new_leader")))

    def set_isr(self, topic: str, partition: int, add: list[str] = (), remove: list[str] = ()) -> None:
        rows = self.view("partitions").where((F.col("topic") == topic) & (F.col("partition") == partition))
        self.put("partitions", rows.withColumn("isr", changed(F.col("isr"), list(add), list(remove))))

    # Groups

    def subscribe(self, group: str, topics: list[str], members: list[str]) -> None:
        """Registers a group, creates topics that aren't there, and deals their partitions to the members in turn."""
        for t in topics:
            if not self.topic(t):
                self.create_topic(t)
        self.put_rows("groups", [{"group_id": group, "topics": topics, "members": members}])
        who = self.spark.createDataFrame([(group, m) for m in members or [f"{group}-consumer"]], "group_id string, consumer_id string")
        subscribed = self.spark.createDataFrame([(group, t) for t in topics], "group_id string, topic string")
        self.put("assignments", groups.assign(self.view("partitions").select("topic", "partition"), who, subscribed))

    def assign(self, group: str, consumer: str, topic: str, partition: int) -> None:
        """Gives one partition to one consumer."""
        self.put_rows("assignments", [{"group_id": group, "topic": topic, "partition": partition, "consumer_id": consumer}])

    def group(self, group: str) -> dict | None:
        row = self.view("groups").where(F.col("group_id") == group).first()
        return row.asDict() if row else None

    def partition_of(self, group: str, topic: str, consumer: str) -> int:
        """The consumer's first partition of a topic; 0 where it has none."""
        own = self.view("assignments").where((F.col("group_id") == group) & (F.col("topic") == topic) & (F.col("consumer_id") == consumer))
        return own.agg(F.coalesce(F.min("partition"), F.lit(0))).first()[0]

    def trigger_rebalance(self, group: str) -> int:
        """A group's next generation: consumers that hold an older one are to take their assignments anew."""
        now = self.generation(group) + 1
        self.put_rows("generations", [{"group_id": group, "generation": now}])
        return now

    def generation(self, group: str) -> int:
        row = self.view("generations").where(F.col("group_id") == group).first()
        return row["generation"] if row else 0

    def replicated(self, status: DataFrame) -> None:
        """(topic, partition, node, offset): how far nodes' copies go; the latest of each counts."""
        self.put("replica_status", status)

    def unsubscribe(self, group: str) -> None:
        self.put("assignments", self.view("assignments").where(F.col("group_id") == group).select("group_id", "topic", "partition"), gone=True)
        self.put_rows("groups", [{"group_id": group}], gone=True)

    def members(self, group: str) -> list[str]:
        """The group's consumers by name; one of the group's own name where it has none."""
        row = self.view("groups").where(F.col("group_id") == group).first()
        return sorted((row["members"] if row else None) or [f"{group}-consumer"])

    def commit(self, offsets: DataFrame) -> None:
        """(group_id, topic, partition, offset); the last commit counts, even if it goes back."""
        self.put("commits", offsets)

    def committed(self) -> DataFrame:
        return self.view("commits").withColumnRenamed("offset", "committed")

    def dump(self, table: str) -> list[dict]:
        """A control table as plain records."""
        return [json.loads(r[0]) for r in self.view(table).select(F.to_json(F.struct("*"))).collect()]


def node_role(node: Column, role: str) -> Column:
    """Whether a partition (leader, replicas) has the node as replica, leader or follower."""
    leads, holds = F.col("leader") == node, F.array_contains("replicas", node)
    return {"replica": holds, "leader": leads, "follower": holds & ~leads}[role]


def changed(members: Column, add: list[str], remove: list[str]) -> Column:
    """A set of members after additions and removals; additions come last."""
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return F.array_except(F.array_union(members, lit(add)), lit(remove))
