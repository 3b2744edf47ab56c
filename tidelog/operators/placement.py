"""Placement of replicas, in-sync sets, failures and elections.

Round robin is an expression. The rack-aware and least-movement policies decide partition after
partition with a running load, over metadata alone (partitions, not messages), so they run on the driver.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = ["topic", "partition"]


def round_robin(partitions: DataFrame, brokers: DataFrame, rf: int) -> DataFrame:
    """Replica i of partition p is broker (p + i) mod n, brokers by name; the leader is the first."""
    names = brokers.agg(F.array_sort(F.collect_set("broker"))).scalar()
    n = F.size("b")
    enough = F.when(n >= rf, F.col("b")).otherwise(F.raise_error(F.lit("fewer brokers than replicas")))
    out = partitions.withColumn("b", names).withColumn("b", enough)
    replicas = F.transform(F.sequence(F.lit(0), F.lit(rf - 1)), lambda i: F.element_at(F.col("b"), F.pmod(F.col("partition") + i, n) + 1))
    return out.select(*PART, replicas.alias("replicas")).withColumn("leader", F.element_at("replicas", 1))


def rack_aware(partitions: int, brokers: list[tuple[str, str]], rf: int) -> list[list[str]]:
    """Replicas of each partition: of each rack one broker, racks in turn from the partition's number on; then, where there are more
    replicas than racks, brokers by name in turn from the partition's number on.

    brokers: (name, rack), names unique; by name inside a rack, so the result is one.
    """
    if rf > len(brokers) or not brokers:
        raise ValueError("fewer brokers than replicas")
    every = sorted(name for name, _ in brokers)
    racks: dict[str, list[str]] = {}
    for name, rack in sorted(brokers):
        racks.setdefault(rack, []).append(name)
    order = sorted(racks)
    turn = lambda xs, p: xs[p % len(xs) :] + xs[: p % len(xs)]
    out = []
    for p in range(partitions):
        firsts = [racks[r][p % len(racks[r])] for r in turn(order, p)]
        out.append([*firsts, *(b for b in turn(every, p) if b not in firsts)][:rf])
    return out


def least_movement(partitions: int, brokers: list[str], rf: int, current: list[tuple[str, list[str]]] | None) -> list[tuple[str, list[str]]]:
    """(leader, replicas) of each partition. Keeps one whose leader and rf replicas live (its leader too, wherever that stands
    among them); else the rf least loaded brokers, ties by name, the first of them leading. Without a current placement, or one of another size: round robin.
    """
    if rf > len(brokers) or not brokers:
        raise ValueError("fewer brokers than replicas")
    every = sorted(brokers)
    if not current or len(current) != partitions:
        return [(every[p % len(every)], [every[(p + i) % len(every)] for i in range(rf)]) for p in range(partitions)]
    load: Counter[str] = Counter({b: 0 for b in every})
    out = []
    for leader, replicas in current:
        alive = [r for r in replicas if r in load]
        if leader in load and len(alive) >= rf:
            kept = alive[:rf]
            chosen = kept if leader in kept else [*kept[: rf - 1], leader]  # a leader holds its partition
        else:
            chosen = sorted(every, key=lambda b: (load[b], b))[:rf]
            leader = chosen[0]
        load.update(chosen)
        out.append((leader, chosen))
    return out


def new_isr(leader: Column, isr: Column, replicas: Column) -> Column:
    """After placement: the leader, and those of the old set that are still replicas."""
    return F.array_union(F.array(leader), F.array_intersect(isr, replicas))


def in_sync(placed: DataFrame, status: DataFrame, most: int = 10) -> DataFrame:
    """status: (topic, partition, node, offset). The leader, and followers at most so far behind it; one without status is out."""
    leads = placed.join(status.select(*PART, F.col("node").alias("leader"), F.col("offset").alias("at")), [*PART, "leader"]).select(*PART, "leader", "at", "replicas")
    rows = leads.select(*PART, "leader", "at", F.explode("replicas").alias("node")).join(status, [*PART, "node"])
    return rows.where((F.col("node") == F.col("leader")) | (F.col("at") - F.col("offset") <= most)).groupBy(*PART, "leader").agg(F.array_sort(F.collect_set("node")).alias("isr"))


def replica_lag(placed: DataFrame, status: DataFrame) -> DataFrame:
    """How far each replica with a status is behind its leader; a partition whose leader has none is left out."""
    leads = placed.select(*PART, "leader").join(status.select(*PART, F.col("node").alias("leader"), F.col("offset").alias("at")), [*PART, "leader"])
    return status.join(leads, PART).select(*PART, "node", (F.col("at") - F.col("offset")).alias("behind"))


def node_counts(placed: DataFrame) -> DataFrame:
    """Each node's number of partitions, as replica, leader and follower."""
    rows = placed.select("leader", F.explode("replicas").alias("node"))
    leads = F.count_if(F.col("leader") == F.col("node"))
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("replicas"), leads.alias("leaders"), (F.count(F.lit(1)) - leads).alias("followers"))


def elect(partitions: DataFrame, dead: DataFrame) -> DataFrame:
    """Partitions led by a dead broker, with the first living member of their in-sync set (null if none)."""
    gone = dead.agg(F.collect_set("broker")).scalar()
    rows = partitions.withColumn("dead", gone).where(F.array_contains("dead", F.col("leader")))
    living = F.filter("isr", lambda x: ~F.array_contains(F.col("dead"), x))
    return rows.select(*PART, F.col("leader").alias("old_leader"), F.get(living, 0).alias("new_leader"))


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(broker, change): added, removed, updated (another address) or kept."""
    a, b = old.select("broker", F.col("address").alias("was")), new.select("broker", F.col("address").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "updated").otherwise("kept")
    return a.join(b, "broker", "full_outer").select("broker", change.alias("change"))
