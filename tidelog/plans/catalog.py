"""Every query of the engine with the SQL that states its result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidelog.functions.routing import base_of, delay_ready, hash31, is_down, partition_of, segment_name
from tidelog.operators import groups as G
from tidelog.operators import iosim, placement
from tidelog.operators import log as L
from tidelog.operators import retention as R
from tidelog.operators import segments as S
from tidelog.sources import fixtures as X
from tidelog.sources import metadata

PART = L.PART
QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Messages a segment, bytes a segment, span of a segment, sparse interval.
COUNT, BYTES, SPAN_US, INTERVAL = 100, 20_000, 3 * 86_400_000_000, 64
HASH = "list_reduce(list_prepend(0::bigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint)), lambda a, c: (a * 31 + c) & 2147483647)"
LOG = f"""log as (
  select *, (row_number() over (partition by topic, partition order by ts, seq) - 1)::bigint as "offset" from (
    select event_type as topic, ({HASH.format("event_id::varchar")} % 3)::int as partition, event_id as seq, event_id::varchar as id,
      user_id::varchar as key, props as body, ts, value, (32 + strlen(event_id::varchar) + strlen(props))::bigint as size
    from events)
), leo as (select topic, partition, count(*)::bigint as leo from log group by all
), grp as (select * from (values ('g1'), ('g2')) t(group_id)
), members as (select * from (values ('g1', 'c2'), ('g1', 'c1'), ('g2', 'c1')) t(group_id, consumer_id)
), commits as (
  select group_id, topic, partition, (leo // d)::bigint as "offset", q::bigint as commit_seq
  from leo, grp, (values (1, 4), (2, 2), (3, 3)) c(q, d) where not (group_id = 'g2' and partition = 2)
), committed as (select group_id, topic, partition, max_by("offset", commit_seq) as committed from commits group by all
), brokers as (
  select n_name as broker, r_name as rack, n_nationkey as k, now - to_seconds((n_nationkey * 17 + 20) % 60) as last_seen, now
  from nation join region on n_regionkey = r_regionkey, (select max(ts) as now from events)
), placed as (
  select topic, partition, list_transform(range(0, 3), lambda i: b[((partition + i) % len(b) + 1)::bigint]) as replicas
  from leo, (select list_sort(list(distinct broker)) as b from brokers)
), seg as (
  select topic, partition, ("offset" // {COUNT})::bigint as segment, min("offset") as base, max("offset") as hi, count(*)::bigint as n,
    sum(size)::bigint as bytes, min(ts) as first_ts, max(ts) as last_ts from log group by all
), segments as (select *, base = max(base) over (partition by topic, partition) as active from seg
), dense as (
  select topic, partition, "offset", coalesce(sum(size) over (partition by topic, partition order by "offset" rows between unbounded preceding and 1 preceding), 0)::bigint as position, size, ts from log
), sparse as (select topic, partition, "offset", position, ts from dense where "offset" % {INTERVAL} = 0
), targets as (select distinct topic, partition, "offset" as target from commits
)"""


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"with recursive {LOG}\n{sql}"
        return f

    return add


# Routing and offsets


@query("hash_partition", f"select id, {HASH.format('id')}::bigint as h, partition from log")
def hash_partition(spark, sf):
    return X.read(spark, sf, "events").select(F.col("event_id").cast("string").alias("id")).select("id", hash31(F.col("id")).alias("h"), partition_of(F.col("id"), 3).alias("partition"))


@query("partition_skew", "select topic, partition, count(*)::bigint as n, (sum(count(*)) over (partition by topic))::bigint as n_topic, (max(count(*)) over (partition by topic))::bigint as most from log group by topic, partition")
def partition_skew(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("topic")
    return X.leo(spark, sf).select(*PART, F.col("leo").alias("n"), F.sum("leo").over(w).alias("n_topic"), F.max("leo").over(w).alias("most"))


@query("keyed_routing", f"select user_id::varchar as key, ({HASH.format('user_id::varchar')} % 3)::int as partition, count(*)::bigint as n from events group by all")
def keyed_routing(spark, sf):
    return X.routed(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", partition_of(F.col("key"), 3).alias("partition"), "n")


@query("offset_assign", 'select topic, partition, "offset", id from log')
def offset_assign(spark, sf):
    return X.log(spark, sf).select(*PART, "offset", "id")


@query("offset_append", 'select topic, partition, "offset" + 1000 * (partition + 1) as "offset", id from log')
def offset_append(spark, sf):
    base = X.leo(spark, sf).select(*PART, (1000 * (F.col("partition") + 1)).cast("long").alias("next_offset"))
    return L.assign_offsets(X.routed(spark, sf), ["ts", "seq"], F.date_trunc("day", F.col("ts")), base).select(*PART, "offset", "id")


@query("log_scan_range", 'select topic, partition, "offset", id, body from log where "offset" >= 10 and "offset" < 60')
def log_scan_range(spark, sf):
    return L.scan(X.log(spark, sf), 10, 50).select(*PART, "offset", "id", "body")


@query("topic_scan_1000", """select topic, partition, "offset", id from log where topic = 'click' and "offset" < 1000""")
def topic_scan_1000(spark, sf):
    return L.scan(X.log(spark, sf), 0, 1000, topic="click").select(*PART, "offset", "id")


@query("list_topics", "select topic, count(distinct partition)::bigint as partitions from log group by all")
def list_topics(spark, sf):
    return X.leo(spark, sf).groupBy("topic").agg(F.count(F.lit(1)).alias("partitions"))


# Pull and look-up

ASSIGNED = "leo l join grp g on true left join committed c using (group_id, topic, partition)"
PULL = 'select group_id, l.topic, l.partition, "offset", id from (select g.group_id, l.topic, l.partition, coalesce(committed, 0) as c0, {share} as share from leo l, grp g left join committed c on c.group_id = g.group_id and c.topic = l.topic and c.partition = l.partition{where}) l join log using (topic, partition) where "offset" >= c0 and "offset" < c0 + share'


@query("pull_batch", PULL.format(share="(100 // count(*) over (partition by g.group_id))", where=""))
def pull_batch(spark, sf):
    assigned = X.for_groups(X.leo(spark, sf)).select("group_id", *PART)
    return L.pull(X.log(spark, sf), assigned, G.committed(X.commits(spark, sf)), 100).select("group_id", *PART, "offset", "id")


@query("pull_after_commit", PULL.format(share="30", where="") + " and group_id = 'g1'")
def pull_after_commit(spark, sf):
    assigned = X.for_groups(X.leo(spark, sf), ("g1",)).select("group_id", *PART)
    return L.pull(X.log(spark, sf), assigned, G.committed(X.commits(spark, sf)), 450).select("group_id", *PART, "offset", "id")


@query("pull_multi_topic", PULL.format(share="(120 // count(*) over (partition by g.group_id))", where=" where l.topic in ('click', 'view')"))
def pull_multi_topic(spark, sf):
    assigned = X.for_groups(X.leo(spark, sf).where(F.col("topic").isin("click", "view"))).select("group_id", *PART)
    return L.pull(X.log(spark, sf), assigned, G.committed(X.commits(spark, sf)), 120).select("group_id", *PART, "offset", "id")


@query("lookup_location", 'select topic, id, partition, "offset" from log where seq in (select max(event_id) from events group by event_type)')
def lookup_location(spark, sf):
    ids = X.routed(spark, sf).groupBy("topic").agg(F.max_by("id", "seq").alias("id"))
    return L.locate(X.log(spark, sf), ids)


@query("lookup_many", 'select topic, id, partition, "offset" from log where seq in (select max(event_id) from events group by event_type, user_id)')
def lookup_many(spark, sf):
    ids = X.routed(spark, sf).groupBy("topic", "key").agg(F.max_by("id", "seq").alias("id"))
    return L.locate(X.log(spark, sf), ids)


# Segments and indexes

FOLD = """, o as (select *, epoch_us(ts) as us, count(*) over (partition by topic, partition) as total from log), walk as (
  select topic, partition, "offset", size, us, 0::bigint as seg, size as bytes, 1::bigint as n, us as first_us from o where "offset" = 0
  union all
  select o.topic, o.partition, o."offset", o.size, o.us,
    case when {full} then w.seg + 1 else w.seg end, case when {full} then o.size else w.bytes + o.size end,
    case when {full} then 1 else w.n + 1 end, case when {full} then o.us else w.first_us end
  from walk w join o on o.topic = w.topic and o.partition = w.partition and o."offset" = w."offset" + 1
) select topic, partition, min("offset") as base, max("offset") as hi, count(*)::bigint as n, sum(size)::bigint as bytes, min(us) as first_us, max(us) as last_us from walk group by topic, partition, seg"""
FULL = {"bytes": f"w.bytes + o.size > {BYTES}", "span": f"o.us - w.first_us >= {SPAN_US}", "count": "w.n >= 150"}


@query("segments_by_count", "select topic, partition, base, hi, n, bytes, active from segments")
def segments_by_count(spark, sf):
    return S.by_count(X.log(spark, sf), COUNT).select(*PART, "base", "hi", "n", "bytes", "active")


@query("segments_by_size", FOLD.format(full=FULL["bytes"]))
def segments_by_size(spark, sf):
    return S.roll(X.log(spark, sf), max_bytes=BYTES)


@query("segments_by_time", FOLD.format(full=FULL["span"]))
def segments_by_time(spark, sf):
    return S.roll(X.log(spark, sf), span_us=SPAN_US)


@query("segments_composite", FOLD.format(full="(" + " or ".join(FULL.values()) + ")"))
def segments_composite(spark, sf):
    return S.roll(X.log(spark, sf), max_bytes=BYTES, max_count=150, span_us=SPAN_US)


@query("segment_should_roll", f"select topic, partition, base, (bytes >= 4400 or n >= {COUNT} or epoch_us(last_ts) - epoch_us(first_ts) >= {SPAN_US}) as roll from segments")
def segment_should_roll(spark, sf):
    age = F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))
    return S.by_count(X.log(spark, sf), COUNT).select(*PART, "base", S.should_roll(F.col("bytes"), F.col("n"), age, 4400, COUNT, SPAN_US).alias("roll"))


@query("segment_locate", f"select t.topic, t.partition, target, coalesce(max(base), -1)::bigint as base from targets t left join segments s on s.topic = t.topic and s.partition = t.partition and s.base <= target group by all")
def segment_locate(spark, sf):
    targets = X.commits(spark, sf).select(*PART, F.col("offset").alias("target")).distinct()
    return S.locate(S.by_count(X.log(spark, sf), COUNT), targets).select(*PART, "target", "base")


@query("dense_index_positions", 'select topic, partition, "offset", position, size from dense')
def dense_index_positions(spark, sf):
    return S.dense_index(X.log(spark, sf)).drop("ts")


@query("sparse_index_build", 'select topic, partition, "offset", position from sparse')
def sparse_index_build(spark, sf):
    return S.sparse_index(S.dense_index(X.log(spark, sf)), INTERVAL).drop("ts")


FLOOR = 'select t.topic, t.partition, target, coalesce(max(s."offset"), -1) as entry, coalesce(max_by(position, s."offset"), -1) as position from targets t left join (select *, max("offset") over (partition by topic, partition) as last from sparse) s on s.topic = t.topic and s.partition = t.partition and s."offset" <= target{strict} group by all'


@query("sparse_index_floor", FLOOR.format(strict=""))
def sparse_index_floor(spark, sf):
    targets = X.commits(spark, sf).select(*PART, F.col("offset").alias("target"))
    return S.floor_entry(S.sparse_index(S.dense_index(X.log(spark, sf)), INTERVAL), targets).fillna(-1, ["entry", "position"])


@query("sparse_index_strict", FLOOR.format(strict=" and target <= last"))
def sparse_index_strict(spark, sf):
    targets = X.commits(spark, sf).select(*PART, F.col("offset").alias("target"))
    return S.floor_entry(S.sparse_index(S.dense_index(X.log(spark, sf)), INTERVAL), targets, strict=True).fillna(-1, ["entry", "position"])


@query("offset_for_time", "select topic, partition, t, min(\"offset\") as \"offset\" from log, (values (timestamp '2024-01-10'), (timestamp '2024-01-20')) x(t) where ts >= t group by all")
def offset_for_time(spark, sf):
    return S.offset_for_time(X.log(spark, sf), [dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)])


# Retention

KEEP_S, KEEP_BYTES, KEEP_FROM = 20 * 86_400, 15_000, 150
DOOMED = {
    "time": f"select topic, partition, base from segments, (select max(ts) as now from events) where not active and last_ts < now - to_seconds({KEEP_S})",
    "size": f"select topic, partition, base from (select *, sum(bytes) over (partition by topic, partition order by base desc) as left_ from segments) where not active and left_ > {KEEP_BYTES}",
    "offset": f"select topic, partition, base from segments where not active and hi < {KEEP_FROM}",
}
DOOMED["any"] = " union ".join(DOOMED.values())


def _doomed(spark, sf, kind):
    seg = S.by_count(X.log(spark, sf), COUNT)
    if kind == "time":
        return R.by_time(seg, X.newest(spark, sf), KEEP_S)
    return R.by_size(seg, KEEP_BYTES) if kind == "size" else R.by_offset(seg, KEEP_FROM)


@query("retain_time", DOOMED["time"])
def retain_time(spark, sf):
    return _doomed(spark, sf, "time")


@query("retain_size", DOOMED["size"])
def retain_size(spark, sf):
    return _doomed(spark, sf, "size")


@query("retain_offset", DOOMED["offset"])
def retain_offset(spark, sf):
    return _doomed(spark, sf, "offset")


@query("retain_composite", DOOMED["any"])
def retain_composite(spark, sf):
    return R.composite(S.by_count(X.log(spark, sf), COUNT), X.newest(spark, sf), KEEP_S, KEEP_BYTES, KEEP_FROM)


@query("retain_any", DOOMED["any"])
def retain_any(spark, sf):
    """The same as a union of policies, each of which may be any DataFrame of segments."""
    return R.any_of(*(_doomed(spark, sf, k) for k in ("time", "size", "offset")))


@query("apply_retention", f'select topic, partition, "offset", id from log where (topic, partition, "offset" - "offset" % {COUNT}) not in (select (topic, partition, base) from ({DOOMED["any"]}))')
def apply_retention(spark, sf):
    return R.apply(X.log(spark, sf), None, retain_composite(spark, sf), COUNT).select(*PART, "offset", "id")


# Groups


@query("group_assign_rr", """select m.group_id, consumer_id, topic, partition from
  (select topic, partition, row_number() over (partition by topic order by partition) - 1 as i from leo) p,
  (select *, row_number() over (partition by group_id order by consumer_id) - 1 as o, count(*) over (partition by group_id) as n from members) m where i % n = o""")
def group_assign_rr(spark, sf):
    leo = X.leo(spark, sf)
    return G.assign(leo, X.members(spark), X.for_groups(leo.select("topic").distinct()))


@query("assigned_partitions", "select consumer, topic, partition from leo, (values ('c1'), ('stranger')) c(consumer) where consumer = 'stranger' or (partition % 2 = 0)")
def assigned_partitions(spark, sf):
    a = group_assign_rr(spark, sf)
    known = G.assigned_to(a, "g1", "c1").select(F.lit("c1").alias("consumer"), *PART)
    return known.unionByName(G.assigned_to(a, "g1", "stranger").select(F.lit("stranger").alias("consumer"), *PART))


@query("commit_latest_wins", "select group_id, topic, partition, committed from committed")
def commit_latest_wins(spark, sf):
    return G.committed(X.commits(spark, sf))


@query("committed_offsets", "select g.group_id, l.topic, l.partition, coalesce(committed, 0)::bigint as committed from leo l, grp g left join committed c on c.group_id = g.group_id and c.topic = l.topic and c.partition = l.partition")
def committed_offsets(spark, sf):
    every = X.for_groups(X.leo(spark, sf)).select("group_id", *PART)
    return every.join(G.committed(X.commits(spark, sf)), ["group_id", *PART], "left").select("group_id", *PART, F.coalesce("committed", F.lit(0)).cast("long").alias("committed"))


def _acks(spark, sf):
    rows = X.routed(spark, sf).groupBy("topic", "key").agg(F.max(F.struct("seq", "id")).alias("m"))
    ids = rows.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["id"]).alias("ids"))
    return ids.select(F.lit("g1").alias("group_id"), "topic", "ids")


ACKED = "(select max(event_id) as seq, event_type as topic from events group by event_type, user_id)"


@query("ack_last_id", f'select \'g1\' as group_id, topic, partition, "offset" + 1 as "offset" from log where (topic, seq) in (select (topic, max(seq)) from {ACKED} group by topic)')
def ack_last_id(spark, sf):
    return G.ack_last(_acks(spark, sf), X.log(spark, sf))


@query("ack_per_partition", f'select \'g1\' as group_id, topic, partition, max("offset") + 1 as "offset" from log join {ACKED} using (topic, seq) group by all')
def ack_per_partition(spark, sf):
    return G.ack_all(_acks(spark, sf), X.log(spark, sf))


@query("log_end_offset", "select topic, partition, leo from leo")
def log_end_offset(spark, sf):
    return G.end_offsets(X.log(spark, sf))


@query("consumer_lag", "select g.group_id, l.topic, l.partition, coalesce(committed, 0)::bigint as committed, leo, greatest(0, leo - coalesce(committed, 0))::bigint as lag from leo l, grp g left join committed c on c.group_id = g.group_id and c.topic = l.topic and c.partition = l.partition")
def consumer_lag(spark, sf):
    leo = X.leo(spark, sf)
    subscribed = X.for_groups(leo.select("topic").distinct())
    return G.lag(subscribed, leo, X.commits(spark, sf))


@query("topic_stats", "select topic, partition, leo - 1 as latest_offset, replicas[1] as leader, len(replicas)::int as isr_size from leo join placed using (topic, partition)")
def topic_stats(spark, sf):
    leo = X.leo(spark, sf)
    placed = placement.round_robin(leo.select(*PART), X.brokers(spark, sf), 3)
    return leo.join(placed, PART, "left").select(*PART, (F.col("leo") - 1).alias("latest_offset"), "leader", F.size("replicas").alias("isr_size"))


@query("op_counters", "select op, n from (select 'publish' as op, count(*)::bigint as n from log union all select 'commit', count(*)::bigint from commits union all select 'subscribe', count(*)::bigint from members)")
def op_counters(spark, sf):
    count = lambda df, op: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return count(X.routed(spark, sf), "publish").unionByName(count(X.commits(spark, sf), "commit")).unionByName(count(X.members(spark), "subscribe"))


@query("partition_bytes", "select topic, partition, sum(size)::bigint as bytes, count(*)::bigint as n from log group by all")
def partition_bytes(spark, sf):
    return X.routed(spark, sf).groupBy(*PART).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


# Placement and membership


@query("place_round_robin", "select topic, partition, array_to_string(replicas, ',') as replicas, replicas[1] as leader from placed")
def place_round_robin(spark, sf):
    return placement.round_robin(X.leo(spark, sf).select(*PART), X.brokers(spark, sf), 3).withColumn("replicas", F.array_join("replicas", ","))


@query("broker_load", "select b.broker, count(r.node)::bigint as load from brokers b left join (select unnest(replicas) as node from placed) r on r.node = b.broker group by all")
def broker_load(spark, sf):
    placed = placement.round_robin(X.leo(spark, sf).select(*PART), X.brokers(spark, sf), 3).select(F.explode("replicas").alias("broker")).groupBy("broker").agg(F.count(F.lit(1)).alias("load"))
    return X.brokers(spark, sf).select("broker").join(placed, "broker", "left").select("broker", F.coalesce("load", F.lit(0)).alias("load"))


@query("isr_update", "select topic, partition, leader, array_to_string(list_sort(list(node)), ',') as isr from (select topic, partition, replicas[1] as leader, replicas[i] as node, leo - 1 - 4 * (i - 1) * (partition + 1) as off, leo - 1 as lead_off from leo join placed using (topic, partition), range(1, 4) x(i)) where lead_off - off <= 10 group by all")
def isr_update(spark, sf):
    leo = X.leo(spark, sf)
    placed = placement.round_robin(leo.select(*PART), X.brokers(spark, sf), 3)
    status = placed.join(leo, PART).select(*PART, "leo", F.posexplode("replicas").alias("i", "node")).select(*PART, "node", (F.col("leo") - 1 - 4 * F.col("i") * (F.col("partition") + 1)).alias("offset"))
    return placement.in_sync(placed, status).withColumn("isr", F.array_join("isr", ","))


@query("dead_nodes", "select broker, rack from brokers where now - last_seen > to_seconds(30)")
def dead_nodes(spark, sf):
    return X.brokers(spark, sf).where(is_down(F.col("last_seen"), F.col("now"))).select("broker", "rack")


DEAD = "(select broker from brokers where now - last_seen > to_seconds(30))"


@query("leader_election", f"select topic, partition, replicas[1] as old_leader, list_filter(replicas, lambda x: not list_contains(d, x))[1] as new_leader from placed, (select list(broker) as d from {DEAD}) where list_contains(d, replicas[1])")
def leader_election(spark, sf):
    brokers = X.brokers(spark, sf)
    placed = placement.round_robin(X.leo(spark, sf).select(*PART), brokers, 3).withColumn("isr", F.col("replicas"))
    return placement.elect(placed, brokers.where(is_down(F.col("last_seen"), F.col("now"))))


@query("node_diff", "select coalesce(a.broker, b.broker) as broker, case when a.broker is null then 'added' when b.broker is null then 'removed' when a.address <> b.address then 'updated' else 'kept' end as change from (select broker, 'h' || k as address from brokers where k % 4 <> 0) a full join (select broker, 'h' || case when k % 7 = 0 then k + 100 else k end as address from brokers where k % 5 <> 0) b on a.broker = b.broker")
def node_diff(spark, sf):
    b = X.brokers(spark, sf)
    old = b.where("k % 4 <> 0").select("broker", F.concat(F.lit("h"), F.col("k").cast("string")).alias("address"))
    new = b.where("k % 5 <> 0").select("broker", F.concat(F.lit("h"), F.when(F.col("k") % 7 == 0, F.col("k") + 100).otherwise(F.col("k")).cast("string")).alias("address"))
    return placement.node_diff(old, new)


@query("rebalance_isr", "select topic, partition, array_to_string(list_filter(replicas, lambda x: x = replicas[1] or x <> replicas[2]), ',') as isr, array_to_string(replicas[2:], ',') as followers from placed")
def rebalance_isr(spark, sf):
    placed = placement.round_robin(X.leo(spark, sf).select(*PART), X.brokers(spark, sf), 3)
    old = F.array_except("replicas", F.slice("replicas", 2, 1))
    return placed.select(*PART, F.array_join(placement.new_isr(F.col("leader"), old, F.col("replicas")), ",").alias("isr"), F.array_join(F.array_except("replicas", F.array("leader")), ",").alias("followers"))


@query("membership_latest", """, ev as (
  select broker, 'h' || k as address, false as gone, 1 as seq from brokers union all select broker, 'h' || (k + 100), false, 2 from brokers where k % 2 = 1
  union all select broker, null, true, 3 from brokers where k % 5 = 0 union all select broker, 'r' || k, false, 4 from brokers where k % 10 = 0)
  select broker, address from (select broker, last(address order by seq) as address, last(gone order by seq) as gone from ev group by broker) where not gone""")
def membership_latest(spark, sf):
    b, k = X.brokers(spark, sf), F.col("k")
    change = lambda seq, when, address, gone: F.when(when, F.struct(address.alias("address"), F.lit(gone).alias("gone"), F.lit(seq).alias("seq")))
    name = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    changes = F.array(change(1, F.lit(True), name("h", k), False), change(2, k % 2 == 1, name("h", k + 100), False), change(3, k % 5 == 0, F.lit(None).cast("string"), True), change(4, k % 10 == 0, name("r", k), False))
    return metadata.latest(b.select("broker", F.inline(F.array_compact(changes))), ["broker"])


@query("node_counts", "select node, count(*)::bigint as replicas, count(*) filter (leader = node)::bigint as leaders, count(*) filter (leader <> node)::bigint as followers from (select replicas[1] as leader, unnest(replicas) as node from placed) group by node")
def node_counts(spark, sf):
    return placement.node_counts(placement.round_robin(X.leo(spark, sf).select(*PART), X.brokers(spark, sf), 3))


@query("node_partitions", """select role, topic, partition from placed, (select broker as b from brokers where k = 1), (values ('replica'), ('leader'), ('follower')) r(role)
  where list_contains(replicas, b) and (role = 'replica' or (role = 'leader') = (replicas[1] = b))""")
def node_partitions(spark, sf):
    b = X.brokers(spark, sf)
    placed = placement.round_robin(X.leo(spark, sf).select(*PART), b, 3).withColumn("node", b.where("k = 1").select("broker").scalar())
    roles = F.array(*(F.when(metadata.node_role(F.col("node"), r), F.lit(r)) for r in ("replica", "leader", "follower")))
    return placed.select(F.explode(F.array_compact(roles)).alias("role"), *PART)


@query("isr_members", "select topic, partition, array_to_string(list_filter(list_append(replicas, 'spare'), lambda x: x <> b), ',') as isr from placed, (select min(broker) as b from brokers)")
def isr_members(spark, sf):
    brokers = X.brokers(spark, sf)
    first = brokers.agg(F.min("broker")).first()[0]
    placed = placement.round_robin(X.leo(spark, sf).select(*PART), brokers, 3)
    return placed.select(*PART, F.array_join(metadata.changed(F.col("replicas"), ["spare"], [first]), ",").alias("isr"))


@query("replica_lag", "select topic, partition, replicas[i] as node, (4 * (i - 1) * (partition + 1))::bigint as behind from placed, range(1, 4) x(i) where i < 3 or partition > 0")
def replica_lag(spark, sf):
    leo = X.leo(spark, sf)
    placed = placement.round_robin(leo.select(*PART), X.brokers(spark, sf), 3)
    rows = placed.join(leo, PART).select(*PART, "leo", F.posexplode("replicas").alias("i", "node")).where("i < 2 or partition > 0")
    return placement.replica_lag(placed, rows.select(*PART, "node", (F.col("leo") - 4 * F.col("i") * (F.col("partition") + 1)).alias("offset")))


@query("group_members", "select group_id, coalesce(consumer_id, group_id || '-consumer') as consumer_id from (values ('g1'), ('g2'), ('g3')) g(group_id) left join members using (group_id)")
def group_members(spark, sf):
    return G.members_or_default(spark.sql("select * from values ('g1'), ('g2'), ('g3') as t(group_id)"), X.members(spark))


@query("segment_files", "select topic, partition, lpad(base::varchar, 20, '0') || '.log' as name, base from segments")
def segment_files(spark, sf):
    seg = S.by_count(X.log(spark, sf), COUNT)
    named = seg.select(*PART, segment_name(F.col("base")).alias("name"))
    return named.withColumn("base", base_of(F.col("name")))


# Delivery

KIND = "case when topic = 'purchase' then 'DELAYED' else 'NORMAL' end"


@query("delay_ready", f"select topic, id, kind from (select *, {KIND} as kind, 3600 * json_extract_string(body, '$.k')::bigint as d from log), (select max(ts) as now from events) where kind <> 'DELAYED' or d is null or now > ts + to_seconds(d)")
def delay_ready_(spark, sf):
    rows = X.routed(spark, sf).withColumn("now", X.newest(spark, sf)).withColumn("kind", F.when(F.col("topic") == "purchase", "DELAYED").otherwise("NORMAL"))
    delay = 3600 * F.get_json_object("body", "$.k").cast("long")
    return rows.where(delay_ready(F.col("kind"), delay, F.col("ts"), F.col("now"))).select("topic", "id", "kind")


@query("delay_drain", f"select topic, id, 'NORMAL' as kind from (select *, {KIND} as kind, 3600 * json_extract_string(body, '$.k')::bigint as d from log), (select max(ts) as now from events) where kind = 'DELAYED' and (d is null or now > ts + to_seconds(d))")
def delay_drain(spark, sf):
    rows = X.routed(spark, sf).withColumn("now", X.newest(spark, sf)).withColumn("kind", F.when(F.col("topic") == "purchase", "DELAYED").otherwise("NORMAL"))
    delay = 3600 * F.get_json_object("body", "$.k").cast("long")
    return L.drain(rows, delay_ready(F.col("kind"), delay, F.col("ts"), F.col("now"))).select("topic", "id", "kind")


@query("known_topics", "select topic, count(*)::bigint as n from log where topic in ('click', 'view') group by all")
def known_topics(spark, sf):
    topics = spark.sql("select * from values ('click'), ('view'), ('absent') as t(topic)")
    return L.known(X.routed(spark, sf), topics).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("dead_letter_route", "select case when (seq * 7) % 6 >= 5 then 'dead-letter' else topic end as topic, id, topic as origin from log")
def dead_letter_route(spark, sf):
    return X.routed(spark, sf).select(F.when((F.col("seq") * 7) % 6 >= 5, "dead-letter").otherwise(F.col("topic")).alias("topic"), "id", F.col("topic").alias("origin"))


@query("unacked_redelivery", "select 'g1' as group_id, topic, id from log where not (value < 5)")
def unacked_redelivery(spark, sf):
    rows = X.routed(spark, sf).select(F.lit("g1").alias("group_id"), "topic", "id", "value")
    return G.unacked(rows.drop("value"), rows.where("value < 5").drop("value"))


@query("filter_attributes", "select topic, id from log where json_extract_string(body, '$.k') = '7'")
def filter_attributes(spark, sf):
    from tidelog.functions.routing import has_attributes

    rows = X.routed(spark, sf).withColumn("attributes", F.from_json("body", "map<string,string>"))
    return rows.where(has_attributes(F.col("attributes"), {"k": "7"})).select("topic", "id")


@query("replica_copies", 'select topic, partition, unnest(replicas) as node, id from log join placed using (topic, partition)')
def replica_copies(spark, sf):
    placed = placement.round_robin(X.leo(spark, sf).select(*PART), X.brokers(spark, sf), 3)
    return L.replicas_of(X.routed(spark, sf), placed).select(*PART, "node", "id")


@query("dedup_by_id", "select topic, id, partition, \"offset\" from log")
def dedup_by_id(spark, sf):
    log = X.log(spark, sf)
    again = log.withColumn("offset", F.col("offset") + 1_000_000_000)
    return L.dedup(log.unionByName(again))


@query("tumbling_counts", "select topic, date_trunc('day', ts) as day, count(*)::bigint as n from log group by all")
def tumbling_counts(spark, sf):
    e = X.routed(spark, sf)
    return e.groupBy("topic", F.window(F.col("ts"), "1 day")).agg(F.count(F.lit(1)).alias("n")).select("topic", F.col("window.start").cast("timestamp_ntz").alias("day"), "n")


@query("session_counts", "select key, min(ts) as first_ts, max(ts) as last_ts, count(*)::bigint as n from (select *, sum(new) over (partition by key order by ts, seq) as s from (select *, case when ts - lag(ts) over (partition by key order by ts, seq) < interval 6 hour then 0 else 1 end as new from log)) group by key, s")
def session_counts(spark, sf):
    e = X.routed(spark, sf)
    return e.groupBy("key", F.session_window(F.col("ts"), "6 hours")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("session_window")


# I/O equivalents


@query("io_coalesce", """select file, min(b) as begin, sum(length)::bigint as length, count(*)::bigint as requests from (
  select *, sum(new) over (partition by file order by b, length) as run from (select *, case when lag(b + length) over (partition by file order by b, length) = b then 0 else 1 end as new from (
    select topic || '-' || partition as file, position + 64 * ("offset" // 7) as b, size as length from dense))) group by file, run""")
def io_coalesce(spark, sf):
    """All messages as writes, with a gap after every seventh."""
    begin = (F.col("position") + 64 * F.floor(F.col("offset") / 7)).alias("begin")
    return iosim.coalesce_writes(S.dense_index(X.log(spark, sf)).select(F.concat_ws("-", "topic", F.col("partition").cast("string")).alias("file"), begin, F.col("size").alias("length")))


@query("lru_stats", """, a as (select topic as cache, seq, key as page from log),
  p as (select *, lag(seq) over (partition by cache, page order by seq) as prev from a),
  d as (select p.cache, p.seq, p.page, p.prev, count(distinct a.page) as between_ from p left join a on a.cache = p.cache and a.seq > p.prev and a.seq < p.seq group by all),
  f as (select cache, count(*) filter (prev is not null and between_ < 40) as hits, count(*) as total, count(distinct page) as pages from d group by cache)
  select cache, hits::bigint as hits, (total - hits)::bigint as misses, (total - hits - least(40, pages))::bigint as evictions from f""")
def lru_stats(spark, sf):
    return iosim.lru(X.routed(spark, sf).select(F.col("topic").alias("cache"), "seq", F.col("key").alias("page")), 40)


@query("io_stats", "select case partition when 0 then 'read' when 1 then 'write' else 'sync' end as op, count(*)::bigint as n, sum(size)::bigint as bytes, count(*) filter (value < 5)::bigint as errors from log group by all")
def io_stats(spark, sf):
    op = F.when(F.col("partition") == 0, "read").when(F.col("partition") == 1, "write").otherwise("sync")
    return iosim.io_stats(X.routed(spark, sf).select(op.alias("op"), F.col("size").alias("bytes"), (F.col("value") < 5).alias("failed")))
