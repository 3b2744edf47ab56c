"""Queries of a log that is stored, of its control tables, and of the expressions that go with them; each with its SQL."""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.broker import Broker
from tidelog.functions import routing as X31
from tidelog.operators import groups as G
from tidelog.operators import iosim, placement
from tidelog.operators import log as L
from tidelog.operators import segments as S
from tidelog.plans.catalog import HASH, INTERVAL, query
from tidelog.producer import Producer
from tidelog.sources import fixtures as X
from tidelog.sources.metadata import Metadata
from tidelog.sources.shared import settled, shared_dir
from tidelog.sources.store import LogStore
from tidelog.streaming import consumer

PART = L.PART
MESSAGE = ["topic", "id", "key", "body", "ts"]
#: Messages of a stored log: two batches, cut by time.
CUT = "2024-01-16"
SLOG = f""", slog as (select topic, partition, id, key, body, ts, size, value, (row_number() over (partition by topic, partition order by ts, id) - 1)::bigint as "offset",
  case when ts < timestamp '{CUT}' then 1 else 2 end::bigint as batch from log
), sends as (select topic, partition, count(*)::bigint as leo from slog group by all
), subs as (select * from (values ('g1', 'click'), ('g1', 'error'), ('g1', 'login'), ('g1', 'purchase'), ('g1', 'view'), ('g1', 'signup'), ('g1', 'extra'), ('g2', 'click'), ('g2', 'view'), ('g2', 'extra')) t(group_id, topic)
), topics as (select distinct topic, 2 as rf from log union all select 'extra', 1
), parts as (select t.topic, p::int as partition, rf, ['b0', 'b1', 'b2', 'b3'][(p % 4 + 1)::bigint] as leader,
    case when rf = 2 then [['b0', 'b1', 'b2', 'b3'][(p % 4 + 1)::bigint], ['b0', 'b1', 'b2', 'b3'][((p + 1) % 4 + 1)::bigint]] else [['b0', 'b1', 'b2', 'b3'][(p % 4 + 1)::bigint]] end as replicas
  from topics t, range(0, 3) r(p)
), acked as (select topic, partition, "offset" + 1 as committed from slog where topic = 'click' and id::bigint = (select max(event_id) from events where event_type = 'click'))"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return X.routed(spark, sf).select(*MESSAGE)


def cut(rows: DataFrame, batch: int) -> DataFrame:
    return rows.where(F.col("ts") < CUT) if batch == 1 else rows.where(F.col("ts") >= CUT)


@functools.cache
def _broker(spark: SparkSession, sf: str) -> Broker:
    b = Broker(spark, f"{shared_dir(spark)}/broker-{spark.sparkContext.applicationId}-{hashlib.md5(sf.encode()).hexdigest()[:8]}")
    for i in range(4):
        b.meta.join(f"b{i}", f"h{i}:9000", f"r{i % 2}")
    rows = messages(spark, sf)
    topics = sorted(r[0] for r in rows.select("topic").distinct().collect())
    for t in topics:
        b.meta.create_topic(t, 3, 2)
    for batch in (1, 2, 1):  # the first is sent again
        b.publish(cut(rows, batch), batch)
    b.subscribe("g1", [*topics, "extra"], ["c2", "c1"])  # a topic that isn't there is made
    b.subscribe("g2", ["click", "view", "extra"], [])
    last = X.read(spark, sf, "events").where("event_type = 'click'").agg(F.max("event_id")).first()[0]
    b.ack("g1", "click", [str(last)])
    return b


def broker(spark: SparkSession, sf: str) -> Broker:
    """The events as a stored log with its control tables: made once an application and read by the queries below."""
    b = _broker(spark, sf)
    if not b.meta.topics():  # its folder is gone
        _broker.cache_clear()
        b = _broker(spark, sf)
    return b


# The stored log


@query("store_log", SLOG + ' select topic, partition, "offset", id, batch, size from slog')
def store_log(spark, sf):
    return broker(spark, sf).store.read().select(*PART, "offset", "id", "batch", "size")


@query("store_scan", SLOG + ' select topic, partition, "offset", id, body from slog where topic = \'click\' and partition = 1 and "offset" >= 10 and "offset" < 260')
def store_scan(spark, sf):
    return broker(spark, sf).store.scan("click", 1, 10, 250).select(*PART, "offset", "id", "body")


@query("store_partitions", SLOG + " select distinct topic, partition from slog")
def store_partitions(spark, sf):
    return L.partitions(broker(spark, sf).store.segments())


@query("store_segments", SLOG + ' select topic, partition, min("offset") as base, max("offset") as hi, count(*)::bigint as n, sum(size)::bigint as bytes, batch = max(batch) over (partition by topic, partition) as active from slog group by topic, partition, batch')
def store_segments(spark, sf):
    return broker(spark, sf).store.segments().select(*PART, "base", "hi", "n", "bytes", "active")


@query("store_recover", SLOG + ' select topic, partition, min("offset") as base from slog group by topic, partition, batch')
def store_recover(spark, sf):
    return broker(spark, sf).store.recover().select(*PART, "base")


@query("store_ends", SLOG + " select topic, partition, leo from sends")
def store_ends(spark, sf):
    return broker(spark, sf).ends()


@query("store_compact", SLOG + ' select topic, partition, "offset", id from slog')
def store_compact(spark, sf):
    def build(folder: str) -> DataFrame:
        store, rows = LogStore(spark, folder), messages(spark, sf)
        for batch in (1, 2):
            store.publish(cut(rows, batch), batch)
        store.compact()
        store.publish(cut(rows, 1), 1)  # a replay, after its batch was compacted
        return store.read().select(*PART, "offset", "id")

    return settled(spark, build)


@query("store_keyed", f'select topic, ({HASH.format("key")} % 3)::int as partition, (row_number() over (partition by topic, {HASH.format("key")} % 3 order by ts, id) - 1)::bigint as "offset", id from log')
def store_keyed(spark, sf):
    def build(folder: str) -> DataFrame:
        store = LogStore(spark, folder)
        store.publish(messages(spark, sf), 1, keyed=True)
        return store.read().select(*PART, "offset", "id")

    return settled(spark, build)


@query("store_new_ids", "select topic, count(*)::bigint as n, count(*)::bigint as ids, count(*)::bigint as well_formed, count(*)::bigint as routed, (select count(*) from (select distinct topic from log) t where t.topic = log.topic)::bigint as dense from log group by topic")
def store_new_ids(spark, sf):
    """Messages without ids: each gets one of its own, by which it is routed; offsets stay dense."""

    def build(folder: str) -> DataFrame:
        store = LogStore(spark, folder)
        store.publish(messages(spark, sf).drop("id"), 1, new_ids=True)
        rows = store.read()
        good = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
        by = rows.groupBy(*PART).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.count_if(good).alias("w"), F.count_if(X31.partition_of(F.col("id"), 3) == F.col("partition")).alias("r"), (F.max("offset") + 1 == F.countDistinct("offset")).alias("d"))
        return by.groupBy("topic").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.sum("w").alias("well_formed"), F.sum("r").alias("routed"), F.min(F.col("d").cast("bigint")).alias("dense"))

    return settled(spark, build)


WEEK = "least(3, date_diff('day', timestamp '2024-01-01', date_trunc('day', ts)) // 7)"


@query("store_cleanup", SLOG + f""", w as (select *, {WEEK} as week, (select max(ts) from events) as now from slog), c as (
    select *, max(ts) over (partition by topic, partition, week) < now - interval 7 day and week < max(week) over (partition by topic, partition) as gone from w)
  select topic, partition, "offset", id from c where not gone""")
def store_cleanup(spark, sf):
    """Four weekly batches, then the retention job by its default, seven days: whole segments' folders go."""

    def build(folder: str) -> DataFrame:
        store, rows = LogStore(spark, folder), messages(spark, sf)
        week = F.least(F.lit(3), F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7))
        for k in range(4):
            store.publish(rows.where(week == k), k + 1)
        now = X.read(spark, sf, "events").agg(F.max("ts")).first()[0]
        store.cleanup(now)
        store.cleanup(now)  # again: nothing is left to delete
        return store.read().select(*PART, "offset", "id")

    return settled(spark, build)


# Broker: publish, subscribe, pull, acknowledge, figures


@query("subscribe_assign", SLOG + """ select s.group_id, case when s.group_id = 'g2' then 'g2-consumer' when p.partition % 2 = 0 then 'c1' else 'c2' end as consumer_id, p.topic, p.partition from subs s join parts p using (topic)""")
def subscribe_assign(spark, sf):
    return broker(spark, sf).meta.view("assignments").select("group_id", "consumer_id", *PART)


@query("topic_partitions", SLOG + " select topic, partition, leader, array_to_string(replicas, ',') as isr, array_to_string(replicas, ',') as replicas, array_to_string(replicas[2:], ',') as followers from parts")
def topic_partitions(spark, sf):
    rows = broker(spark, sf).meta.partitions()
    return rows.select(*PART, "leader", *(F.array_join(c, ",").alias(c) for c in ("isr", "replicas", "followers")))


@query("topic_records", SLOG + " select topic, 3 as partitions, rf from topics")
def topic_records(spark, sf):
    return broker(spark, sf).meta.view("topics")


OWN = """ , own as (select s.group_id, p.topic, p.partition, count(*) over (partition by s.group_id) as n from subs s join parts p using (topic))
  select o.group_id, o.topic, o.partition, "offset", id from own o join slog using (topic, partition) left join acked a on a.topic = o.topic and a.partition = o.partition and o.group_id = 'g1'
  where "offset" >= coalesce(committed, 0) and "offset" < coalesce(committed, 0) + {most} // n"""


@query("store_pull", SLOG + OWN.format(most=100))
def store_pull(spark, sf):
    """What two groups get by default (100 messages), one of them after an acknowledgement."""
    b = broker(spark, sf)
    rows = [b.pull(g).select("group_id", *PART, "offset", "id") for g in ("g1", "g2")]
    return rows[0].unionByName(rows[1])


@query("store_pull_consumer", SLOG + """ select partition, "offset", id from slog s left join acked a using (topic, partition)
  where topic = 'click' and partition % 2 = 0 and "offset" >= coalesce(committed, 0) and "offset" < coalesce(committed, 0) + 500""")
def store_pull_consumer(spark, sf):
    return broker(spark, sf).pull("g1", "c1", 1000, ["click"]).select("partition", "offset", "id")


@query("store_lag", SLOG + """ select s.group_id, p.topic, p.partition, coalesce(a.committed, 0)::bigint as committed, coalesce(leo, 0)::bigint as leo, greatest(0, coalesce(leo, 0) - coalesce(a.committed, 0))::bigint as lag
  from subs s join parts p using (topic) left join sends e on e.topic = p.topic and e.partition = p.partition left join acked a on a.topic = p.topic and a.partition = p.partition and s.group_id = 'g1'""")
def store_lag(spark, sf):
    return broker(spark, sf).lag()


@query("store_metrics", SLOG + """, stat as (select p.topic, 'topic' as kind, '{"topic":"' || p.topic || '","partitions":[' || string_agg('{"partition":' || p.partition || ',"latest":' || (coalesce(leo, 0) - 1) || ',"leader":"' || leader || '","isr_size":' || rf || '}', ',' order by p.partition) || ']}' as line
    from parts p left join sends e on e.topic = p.topic and e.partition = p.partition group by p.topic),
  lags as (select 'lag' as kind, '{"group_id":"' || s.group_id || '","topic":"' || p.topic || '","partition":' || p.partition || ',"committed":' || coalesce(a.committed, 0) || ',"leo":' || coalesce(leo, 0) || ',"lag":' || greatest(0, coalesce(leo, 0) - coalesce(a.committed, 0)) || '}' as line
    from subs s join parts p using (topic) left join sends e on e.topic = p.topic and e.partition = p.partition left join acked a on a.topic = p.topic and a.partition = p.partition and s.group_id = 'g1')
  select kind, line from stat union all select kind, line from lags""")
def store_metrics(spark, sf):
    return broker(spark, sf).metrics_json().where("kind <> 'counter'")


@query("operation_totals", "select * from (select 'publish' as op, count(*)::bigint as n from log union all select * from (values ('subscribe', 2::bigint), ('pull', 3), ('ack', 4)) t(op, n))")
def operation_totals(spark, sf):
    """Totals of an operation log: all events published (and sent again), two subscriptions, three pulls, four acknowledged ids."""

    def build(folder: str) -> DataFrame:
        b, rows = Broker(spark, folder), messages(spark, sf)
        b.meta.join("b0", "h0:9000")
        topics = sorted(r[0] for r in rows.select("topic").distinct().collect())
        b.subscribe("g1", topics, ["c1"])
        b.publish(rows, 1)
        b.publish(rows, 1)
        b.subscribe("g2", topics[:1], ["c1"])
        for _ in range(3):
            b.pull("g1")
        ids = [r.id for r in b.store.read(topics[0]).orderBy("partition", "offset").limit(4).collect()]
        b.ack("g1", topics[0], ids, every=True)
        return b.meta.totals()

    return settled(spark, build)


@query("producer_sends", SLOG + ' select topic, partition, "offset", id, case batch when 1 then 3 else 1 end as tries from slog')
def producer_sends(spark, sf):
    """A batch that is stored only by its third try, and one that is sent in the background; a second try after a lost answer stores nothing twice."""

    def build(folder: str) -> DataFrame:
        b, rows = Broker(spark, folder), messages(spark, sf)
        b.meta.join("b0", "h0:9000")
        for t in sorted(r[0] for r in rows.select("topic").distinct().collect()):
            b.meta.create_topic(t)
        calls = []

        def flaky(*args):
            calls.append(1)
            if len(calls) == 1:
                raise OSError("not reached")
            out = b.publish(*args)
            if len(calls) == 2:
                raise OSError("the answer is lost")
            return out

        p = Producer(b, wait=lambda n: 0.0, publish=flaky)
        got = [(*p.send(cut(rows, 1), 1),), (*p.send_async(cut(rows, 2), 2).result(),)]
        p.close()
        return functools.reduce(DataFrame.unionByName, (df.select(*PART, "offset", "id", F.lit(n).alias("tries")) for df, n in got))

    return settled(spark, build)


@query("replica_report", "select topic, partition, 'n2' as node, leo - 1 as \"offset\" from leo")
def replica_report(spark, sf):
    """A follower's copies, in the partitions their attributes name, and how far it says they go."""

    def build(folder: str) -> DataFrame:
        b = Broker(spark, folder)
        rows = X.routed(spark, sf)
        marked = rows.withColumn("attributes", X31.with_attribute(F.lit(None).cast("map<string,string>"), "partition_id", F.col("partition"))).select(*MESSAGE, "attributes")
        for batch in (1, 2):
            b.replicate(cut(marked, batch), batch, "n2")
        return b.meta.view("replica_status")

    return settled(spark, build)


@query("delay_republish", """, due as (select * from (select *, 3600 * json_extract_string(body, '$.k')::bigint as d from log), (select max(ts) as now from events) where topic = 'purchase' and (d is null or now > ts + to_seconds(d)))
  select topic, partition, (row_number() over (partition by topic, partition order by ts, id) - 1)::bigint as "offset", id, 'NORMAL' as kind, true as bare from due""")
def delay_republish(spark, sf):
    """Delayed messages that are due, published again into a log."""

    def build(folder: str) -> DataFrame:
        b = Broker(spark, folder)
        b.meta.join("b0", "h0:9000")
        b.meta.create_topic("purchase")
        rows = messages(spark, sf).withColumn("kind", F.when(F.col("topic") == "purchase", "DELAYED").otherwise("NORMAL")).withColumn("attributes", F.create_map(F.lit("a"), F.lit("b")))
        delay = 3600 * F.get_json_object("body", "$.k").cast("long")
        b.republish(rows, X31.delay_ready(F.col("kind"), delay, F.col("ts"), X.newest(spark, sf)), 1)
        return b.store.read().select(*PART, "offset", "id", "kind", F.col("attributes").isNull().alias("bare"))

    return settled(spark, build)


@query("dead_letters", "select case when failed >= 3 and failed = n then 'dead-letter' else topic end as topic, id, topic as origin, failed as attempts from (select topic, key as id, count(*)::bigint as n, count(*) filter (value > 2)::bigint as failed from log group by topic, key)")
def dead_letters(spark, sf):
    """Each event a delivery of its user's message, failed by its value."""
    return L.dead_letters(X.routed(spark, sf).select("topic", F.col("key").alias("id"), (F.col("value") > 2).alias("failed")))


# Streams


@query("stream_commits", SLOG + ' select topic, partition, leo as "offset", \'g1\' as group_id from sends')
def stream_commits(spark, sf):
    """A subscription, started twice, that reads the stored log to its end and commits after its handler."""
    b = broker(spark, sf)

    def build(folder: str) -> DataFrame:
        topics = [t for t in b.meta.topics() if t != "extra"]
        sub = consumer.Subscription(b.store, "g1", topics, lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/seen/n={n}"), f"{folder}/commits", f"{folder}/checkpoint")
        sub.start()
        sub.start().awaitTermination()
        commits = spark.read.parquet(f"{folder}/commits").select("group_id", *PART, "offset", "commit_seq")
        return G.committed(commits).select("group_id", *PART, F.col("committed").alias("offset"))

    return settled(spark, build)


@query("stream_join", "select l.key, l.id as left_id, r.id as right_id from log l join log r on l.key = r.key and l.topic = 'click' and r.topic = 'purchase' and r.ts >= l.ts and r.ts <= l.ts + interval 6 hour")
def stream_join(spark, sf):
    """Clicks and the purchases of the same user within six hours, as two streams of the stored log."""
    b = broker(spark, sf)

    def build(folder: str) -> DataFrame:
        side = lambda t: consumer.topic_stream(spark, b.store.path, [t], files=10_000)
        joined = consumer.within(side("click"), side("purchase"), 6 * 3600)
        joined.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination(600)
        return spark.read.parquet(f"{folder}/out")

    return settled(spark, build)


@query("sliding_counts", "select topic, date_trunc('day', ts) - to_days(k::int) as first_day, count(*)::bigint as n from log, range(0, 2) r(k) group by all")
def sliding_counts(spark, sf):
    e = X.routed(spark, sf)
    return e.groupBy("topic", F.window(F.col("ts"), "2 days", "1 day")).agg(F.count(F.lit(1)).alias("n")).select("topic", F.col("window.start").cast("timestamp_ntz").alias("first_day"), "n")


# Control tables


@query("metadata_changes", """select * from (values
  ('topic', 'a', 3, 'b0'), ('topic', 'c', 2, 'b0'),
  ('partition', 'a', 0, 'b0:b0,b1:b0,b1,x'), ('partition', 'a', 1, 'b1:b1,b2:b1,b2'), ('partition', 'a', 3, 'b2:b2:b2'), ('partition', 'c', 0, 'b0:b0:b0'), ('partition', 'c', 1, 'b1:b1:b1'),
  ('leads b1', 'a', 1, 'yes'), ('leads b1', 'a', 0, 'no'), ('of b1', 'a', 2, 'replica'), ('of b1', 'a', 1, 'leader'), ('of b1', 'a', 1, 'follower')) t(what, name, n, value)""")
def metadata_changes(spark, sf):
    """Topics and partitions made, changed and deleted; what is left, and look-ups in it."""

    def build(folder: str) -> DataFrame:
        m = Metadata(spark, folder)
        for i in range(3):
            m.join(f"b{i}", f"h{i}")
        for topic, n, rf in (("a", 3, 2), ("b", 1, 1), ("c", 2, 1)):
            m.create_topic(topic, n, rf)
        m.delete_topic("b")
        m.create_partition("a", 3, "b2", ["b2"])
        m.delete_partition("a", 2)
        m.set_isr("a", 0, add=["x"])
        rows = [("topic", t, m.topic(t)["partitions"], "b0") for t in m.topics()]
        for r in m.partitions().collect():
            rows.append(("partition", r.topic, r.partition, f"{r.leader}:{','.join(r.replicas)}:{','.join(r.isr)}"))
        rows += [("leads b1", "a", p, "yes" if m.leads("b1", "a", p) else "no") for p in (1, 0)]
        rows += [("of b1", "a", m.of_node("b1", role).where("topic = 'a'").count(), role) for role in ("replica", "leader", "follower")]
        return spark.createDataFrame(rows, "what string, name string, n int, value string")

    return settled(spark, build)


@query("service_registry", "select 'log' as service, n_name as node, 'h' || case when n_nationkey % 3 = 0 then n_nationkey + 100 else n_nationkey end as address from nation where n_nationkey % 5 <> 0")
def service_registry(spark, sf):
    """Every broker registered, each third again with another address, each fifth unregistered."""

    def build(folder: str) -> DataFrame:
        m, b = Metadata(spark, folder), X.brokers(spark, sf)
        at = lambda k: F.concat(F.lit("h"), k.cast("string")).alias("address")
        name = [F.lit("log").alias("service"), F.col("broker").alias("node")]
        m.put("services", b.select(*name, at(F.col("k"))))
        m.put("services", b.where("k % 3 = 0").select(*name, at(F.col("k") + 100)))
        m.put("services", b.where("k % 5 = 0").select(*name), gone=True)
        return m.discover("log").select(F.lit("log").alias("service"), "node", "address")

    return settled(spark, build)


@query("group_records", """select * from (values ('g1', 'c1,c2', 2::bigint, 1), ('g2', 'g2-consumer', 0, 0), ('g3', 'g3-consumer', 1, 0)) t(group_id, members, generation, partition)""")
def group_records(spark, sf):
    """Groups registered, again, and unregistered; generations; a consumer's first partition, 0 by default."""

    def build(folder: str) -> DataFrame:
        m = Metadata(spark, folder)
        m.join("b0", "h0")
        m.subscribe("g1", ["t"], ["old"])
        m.subscribe("g1", ["t"], ["c2", "c1"])
        m.subscribe("g2", ["t"], [])
        m.subscribe("g3", ["t"], ["c9"])
        m.unsubscribe("g3")
        m.assign("g1", "c2", "t", 1)
        for g in ("g1", "g3", "g1"):
            m.trigger_rebalance(g)
        rows = [(g, ",".join(m.members(g)), m.generation(g), m.partition_of(g, "t", "c2" if g == "g1" else "c9")) for g in ("g1", "g2", "g3")]
        return spark.createDataFrame(rows, "group_id string, members string, generation bigint, partition int")

    return settled(spark, build)


def _placed(rows: list, case: str) -> list[tuple]:
    return [(case, r.topic, r.partition, r.leader, ",".join(r.replicas), ",".join(r.isr)) for r in rows]


@query("rebalance_brokers", """select * from (values
  ('made', 't', 0, 'b0', 'b0,b1', 'b0,b1'), ('made', 't', 1, 'b1', 'b1,b2', 'b1,b2'), ('made', 't', 2, 'b2', 'b2,b0', 'b2,b0'), ('made', 'u', 0, 'b0', 'b0,b1,b2', 'b0,b1,b2'),
  ('joined', 't', 0, 'b0', 'b0,b1', 'b0,b1'), ('joined', 't', 1, 'b1', 'b1,b2', 'b1,b2'), ('joined', 't', 2, 'b2', 'b2,b0', 'b2,b0'), ('joined', 'u', 0, 'b0', 'b0,b1,b2', 'b0,b1,b2'),
  ('left', 't', 0, 'b0', 'b0,b2', 'b0'), ('left', 't', 1, 'b3', 'b3,b0', 'b3'), ('left', 't', 2, 'b2', 'b2,b0', 'b2,b0'), ('left', 'u', 0, 'b0', 'b0,b2,b3', 'b0,b2'),
  ('too few', 't', 0, 'b0', 'b0,b2', 'b0'), ('too few', 't', 1, 'b0', 'b0,b2', 'b0'), ('too few', 't', 2, 'b2', 'b2,b0', 'b2,b0'), ('too few', 'u', 0, 'b0', 'b0,b2,b3', 'b0,b2')
  ) t(step, topic, partition, leader, replicas, isr)""")
def rebalance_brokers(spark, sf):
    """A broker joins (nothing moves), one leaves (its partitions move), another leaves (the topic of three replicas can't be placed and stays, the other moves)."""

    def build(folder: str) -> DataFrame:
        m = Metadata(spark, folder)
        for i in range(3):
            m.join(f"b{i}", f"h{i}")
        m.create_topic("t", 3, 2)
        m.create_topic("u", 1, 3)
        rows = _placed(m.partitions().collect(), "made")
        m.add_broker("b3", "h3")
        rows += _placed(m.partitions().collect(), "joined")
        m.remove_broker("b1")
        rows += _placed(m.partitions().collect(), "left")
        faults = m.remove_broker("b3")
        assert list(faults) == ["u"]
        rows += _placed(m.partitions().collect(), "too few")
        return spark.createDataFrame(rows, "step string, topic string, partition int, leader string, replicas string, isr string")

    return settled(spark, build)


@query("fail_over_return", """select * from (values
  ('failed', 't', 0, 'b0', 'b0,b1', 'b0'), ('failed', 't', 1, 'b2', 'b1,b2', 'b2'), ('failed', 't', 2, 'b2', 'b2,b0', 'b2,b0'),
  ('returned', 't', 0, 'b0', 'b0,b1', 'b0'), ('returned', 't', 1, 'b2', 'b1,b2', 'b2'), ('returned', 't', 2, 'b2', 'b2,b0', 'b2,b0')) t(step, topic, partition, leader, replicas, isr)""")
def fail_over_return(spark, sf):
    """A broker fails and its partition is led by another; when it is back, a rebalance leaves the new leader where it is."""

    def build(folder: str) -> DataFrame:
        m = Metadata(spark, folder)
        for i in range(3):
            m.join(f"b{i}", f"h{i}")
        m.create_topic("t", 3, 2)
        m.fail_over(["b1"])
        for p in (0, 1):
            m.set_isr("t", p, remove=["b1"])
        rows = _placed(m.partitions().collect(), "failed")
        m.rebalance("t")
        rows += _placed(m.partitions().collect(), "returned")
        return spark.createDataFrame(rows, "step string, topic string, partition int, leader string, replicas string, isr string")

    return settled(spark, build)


# Placement with racks, and with the least movement

RACK = """, b as (select list_sort(list(broker)) as names, count(distinct rack)::bigint as racks from brokers),
  r as (select rack, list_sort(list(broker)) as own, row_number() over (order by rack) - 1 as i from brokers group by rack),
  p as (select distinct partition, rf from leo, (values (3), (7)) f(rf)),
  firsts as (select p.partition, rf, list(own[(p.partition % len(own) + 1)::bigint] order by (i - p.partition % racks + racks) % racks) as f from p, r, b group by all),
  filled as (select partition, rf, list_concat(f, list_filter(list_concat(names[(partition % len(names) + 1)::bigint:], names[:(partition % len(names))::bigint]), lambda x: not list_contains(f, x)))[:rf] as chosen from firsts, b)
  select rf, partition, (k - 1)::int as replica, chosen[k] as broker from filled, range(1, 8) n(k) where k <= rf"""


@query("place_rack_aware", RACK)
def place_rack_aware(spark, sf):
    """Three replicas over five racks, and seven: more replicas than racks."""
    brokers = [(r["broker"], r["rack"]) for r in X.brokers(spark, sf).select("broker", "rack").collect()]
    n = X.leo(spark, sf).agg(F.max("partition") + 1).first()[0]
    rows = [(rf, p, i, b) for rf in (3, 7) for p, r in enumerate(placement.rack_aware(n, brokers, rf)) for i, b in enumerate(r)]
    return spark.createDataFrame(rows, "rf int, partition int, replica int, broker string")


@query("place_min_movement", """select * from (values
  ('some dead', 0, 'NATION_0', 'NATION_0,NATION_10,NATION_11'), ('some dead', 1, 'NATION_13', 'NATION_13,NATION_14,NATION_17'), ('some dead', 2, 'NATION_18', 'NATION_18,NATION_20,NATION_21'),
  ('kept', 0, 'NATION_10', 'NATION_10,NATION_11'), ('kept', 1, 'NATION_0', 'NATION_10,NATION_0'), ('kept', 2, 'NATION_13', 'NATION_13,NATION_14')) t(step, partition, leader, replicas)""")
def place_min_movement(spark, sf):
    """Round robin over all brokers, placed anew over the living; then leaders that aren't the first of their replicas, one that would be cut off, and one that is dead."""
    alive = [r["broker"] for r in X.brokers(spark, sf).where(~X31.is_down(F.col("last_seen"), F.col("now"))).select("broker").collect()]
    placed = placement.round_robin(X.leo(spark, sf).select("partition").distinct().withColumn("topic", F.lit("")), X.brokers(spark, sf), 3).orderBy("partition").collect()
    name = lambda *ks: [f"NATION_{k}" for k in ks]
    odd = [("NATION_10", name(1, 10, 11)), ("NATION_0", name(10, 11, 0)), ("NATION_1", name(1, 10))]
    cases = {"some dead": placement.least_movement(len(placed), alive, 3, [(r["leader"], list(r["replicas"])) for r in placed]), "kept": placement.least_movement(3, alive, 2, odd)}
    return spark.createDataFrame([(c, p, leader, ",".join(r)) for c, rows in cases.items() for p, (leader, r) in enumerate(rows)], "step string, partition int, leader string, replicas string")


# Segments and indexes


@query("segments_default", "select topic, partition, 0::bigint as base, max(\"offset\") as hi, count(*)::bigint as n, sum(size)::bigint as bytes, epoch_us(min_by(ts, \"offset\")) as first_us, epoch_us(max_by(ts, \"offset\")) as last_us from log group by topic, partition having sum(size) <= 67108864")
def segments_default(spark, sf):
    """Rolled by the default, 64 MiB, which these partitions don't reach."""
    return S.roll_default(X.log(spark, sf))


@query("sparse_index_seconds", 'select topic, partition, "offset", position, epoch(date_trunc(\'second\', ts))::bigint as ts from sparse')
def sparse_index_seconds(spark, sf):
    return S.sparse_index(S.dense_index(X.log(spark, sf)), INTERVAL, "s")


@query("sparse_index_off", 'select topic, partition, "offset", position from sparse where false')
def sparse_index_off(spark, sf):
    return S.sparse_index(S.dense_index(X.log(spark, sf)), 0).drop("ts")


@query("index_reload", 'select topic, partition, "offset", position, epoch(date_trunc(\'second\', ts))::bigint as ts from sparse')
def index_reload(spark, sf):
    """A sparse index stored in two parts, the second written twice, and loaded."""

    def build(folder: str) -> DataFrame:
        index, dense = S.StoredIndex(spark, folder, INTERVAL), S.dense_index(X.log(spark, sf))
        for n, part in ((1, dense.where("offset < 200")), (2, dense.where("offset >= 200")), (2, dense.where("offset >= 200"))):
            index.append(part, n)
        return index.load()

    return settled(spark, build)


@query("index_entries", 'select topic, partition, "offset", lower(format(\'{:016x}{:016x}{:016x}\', "offset", position, epoch(date_trunc(\'second\', ts))::bigint)) as entry from sparse')
def index_entries(spark, sf):
    """Entries as 24 bytes, in hexadecimal digits."""
    rows = S.sparse_index(S.dense_index(X.log(spark, sf)), INTERVAL, "s")
    return rows.select(*PART, "offset", F.lower(F.hex(X31.big_endian(F.col("offset"), F.col("position"), F.col("ts")))).alias("entry"))


# Expressions


@query("attribute_edits", "select id, topic as origin, (seq % 3)::varchar as partition_id, case when seq % 2 = 0 then key else 'none' end as owner, case when seq % 2 = 0 then 3 else 2 end as n, '{\"origin\":\"' || topic || '\"' || case when seq % 2 = 0 then ',\"owner\":\"' || key || '\"' else '' end || ',\"partition_id\":\"' || (seq % 3) || '\"}' as line from log")
def attribute_edits(spark, sf):
    """Attributes added, changed, removed, read with a default, and as JSON there and back."""
    had = F.when(F.col("seq") % 2 == 0, F.create_map(F.lit("owner"), F.col("key"), F.lit("partition_id"), F.lit("9"), F.lit("old"), F.lit("x")))
    a = X31.without_attribute(X31.with_attribute(X31.with_attribute(had, "origin", F.col("topic")), "partition_id", F.col("seq") % 3), "old")
    rows = X.routed(spark, sf).select("id", "topic", "seq", a.alias("a")).withColumn("a", F.from_json(F.to_json("a"), "map<string,string>"))
    value = lambda k: X31.attribute(F.col("a"), k, F.lit("none"))
    return rows.select("id", value("origin").alias("origin"), value("partition_id").alias("partition_id"), value("owner").alias("owner"), F.size("a").alias("n"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("a")))).alias("line"))


@query("node_ids", "select broker, substr(md5(broker || '-h' || k || '-' || (9000 + k) || '-' || k), 1, 12) as node_id, 'h' || k as host, 9000 + k as port, broker || '-' || k as consumer_id from brokers")
def node_ids(spark, sf):
    """Ids of nodes by host, address and stamp; addresses split; consumers' ids."""
    rows = X.brokers(spark, sf).withColumn("address", F.concat(F.lit("h"), F.col("k").cast("string"), F.lit(":"), (F.col("k") + 9000).cast("string")))
    return rows.select("broker", X31.node_id(F.col("broker"), F.col("address"), F.col("k")).alias("node_id"), X31.host_of(F.col("address")).alias("host"), X31.port_of(F.col("address")).alias("port"), F.concat_ws("-", "broker", F.col("k").cast("string")).alias("consumer_id"))


@query("request_checks", "select seq, case when seq % 4 = 0 then 'group' when seq % 5 = 0 then 'topic' when seq % 7 = 0 then 'ids' end as fault from log")
def request_checks(spark, sf):
    """What is wrong with requests that lack a group, a topic or ids, null or empty."""
    s = F.col("seq")
    group = F.when(s % 8 == 0, F.lit(None)).when(s % 4 == 0, "").otherwise("g1")
    topic = F.when(s % 10 == 0, F.lit(None)).when(s % 5 == 0, "").otherwise(F.col("topic"))
    ids = F.when(s % 14 == 0, F.lit(None)).when(s % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("id"))
    return X.routed(spark, sf).select("seq", X31.request_fault(group, topic, ids).alias("fault"))


@query("isr_changed", "select topic, partition, partition <> 0 as changed, false as turned, not list_has_any(replicas, dead) as all_alive from placed, (select list(broker) as dead from brokers where now - last_seen > to_seconds(30))")
def isr_changed(spark, sf):
    """Whether in-sync sets differ from before: one lost, only turned round, or cut to the living brokers."""
    placed = placement.round_robin(X.leo(spark, sf).select(*PART), X.brokers(spark, sf), 3)
    now = F.when(F.col("partition") == 0, F.reverse("replicas")).otherwise(F.slice("replicas", 1, 2))
    living = X.brokers(spark, sf).where(~X31.is_down(F.col("last_seen"), F.col("now"))).agg(F.collect_set("broker")).scalar()
    alive = F.array_intersect(F.col("replicas"), F.col("living"))
    return placed.withColumn("living", living).select(*PART, (~X31.same_members(F.col("replicas"), now)).alias("changed"), (~X31.same_members(F.col("replicas"), F.reverse("replicas"))).alias("turned"), X31.same_members(F.col("replicas"), alive).alias("all_alive"))


@query("least_loaded", "select broker, load, (row_number() over (order by load, broker) - 1)::int as place from (select b.broker, count(r.node)::bigint as load from brokers b left join (select unnest(replicas) as node from placed) r on r.node = b.broker group by all) qualify row_number() over (order by load, broker) <= 3")
def least_loaded(spark, sf):
    """The three least loaded brokers, ties by name."""
    placed = placement.round_robin(X.leo(spark, sf).select(*PART), X.brokers(spark, sf), 3)
    load = X.brokers(spark, sf).select("broker").join(placed.select(F.explode("replicas").alias("broker")).groupBy("broker").agg(F.count(F.lit(1)).alias("load")), "broker", "left").select("broker", F.coalesce("load", F.lit(0)).cast("long").alias("load"))
    return load.orderBy("load", "broker").limit(3).withColumn("place", (F.row_number().over(Window.orderBy("load", "broker")) - 1).cast("int"))


# I/O equivalents


@query("read_batches", """, q as (select topic || '-' || partition as file, position as b, size, (row_number() over (partition by topic, partition order by position, size) - 1) // 100 as batch from dense)
  select file, batch::bigint as batch, min(b) as begin, max(b + size) as "end", count(*)::bigint as requests, sum(size)::bigint as bytes from q group by file, batch""")
def read_batches(spark, sf):
    dense = S.dense_index(X.log(spark, sf))
    return iosim.batched_reads(dense.select(F.concat_ws("-", "topic", F.col("partition").cast("string")).alias("file"), F.col("position").alias("begin"), F.col("size").alias("length")))


@query("page_states", """, a as (select topic as cache, seq, key as page, case when value < 5 then 'read' when value < 15 then 'write' else 'flush' end as op from log),
  m as (select *, lag(op) over w as was, lead(op) over w as next from a where op <> 'read' window w as (partition by cache, page order by seq)),
  s as (select cache, count(*) filter (op = 'write' and was is distinct from 'write')::bigint as marked, count(*) filter (op = 'flush' and was = 'write')::bigint as flushed, count(*) filter (op = 'write' and next is null)::bigint as dirty from m group by cache)
  select cache, pages, marked, flushed, dirty from s join (select cache, count(distinct page)::bigint as pages from a group by cache) using (cache)""")
def page_states(spark, sf):
    op = F.when(F.col("value") < 5, "read").when(F.col("value") < 15, "write").otherwise("flush")
    return iosim.page_states(X.routed(spark, sf).select(F.col("topic").alias("cache"), "seq", F.col("key").alias("page"), op.alias("op")))


@query("io_totals", """, q as (select topic, partition, (row_number() over (partition by topic, partition order by position) - 1) // 100 as batch, value < 5 as failed, partition = 0 as reading from dense join log using (topic, partition, "offset"))
  select count(*)::bigint as requests, count(*) filter (reading)::bigint as reads, count(*) filter (not reading)::bigint as writes, (select count(*) from (select distinct topic, partition, batch from q))::bigint as batched, count(*) filter (failed)::bigint as errors from q""")
def io_totals(spark, sf):
    rows, dense = X.routed(spark, sf), S.dense_index(X.log(spark, sf))
    op = F.when(F.col("partition") == 0, "read").otherwise("write")
    by = iosim.io_stats(rows.select(op.alias("op"), F.col("size").alias("bytes"), (F.col("value") < 5).alias("failed")))
    one = by.agg(F.sum("n").alias("requests"), F.sum(F.when(F.col("op") == "read", F.col("n")).otherwise(0)).alias("reads"), F.sum(F.when(F.col("op") == "write", F.col("n")).otherwise(0)).alias("writes"), F.sum("errors").alias("errors"))
    batches = iosim.batched_reads(dense.select(F.concat_ws("-", "topic", F.col("partition").cast("string")).alias("file"), F.col("position").alias("begin"), F.col("size").alias("length")))
    return one.join(batches.agg(F.count(F.lit(1)).alias("batched"))).select("requests", "reads", "writes", "batched", "errors")

