import datetime as dt
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelog.broker import Broker
from tidelog.functions import routing
from tidelog.operators import groups, iosim, log, placement, segments
from tidelog.producer import Producer
from tidelog.sources.metadata import Metadata
from tidelog.sources.store import LogStore
from tidelog.streaming import consumer


def h31(s, n):
    h = 0
    for c in s:
        h = h * 31 + ord(c)
    return (h & 0x7FFFFFFF) % n


def test_hash_is_the_31_fold(spark):
    ids = ["", "a", "msg-1", "é中", "x" * 300]
    got = spark.createDataFrame([(i,) for i in ids], "id string").select("id", routing.partition_of(F.col("id"), 7)).collect()
    assert {r[0]: r[1] for r in got} == {i: h31(i, 7) for i in ids}


def messages(spark, n, topic="t", start=0):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(topic, f"msg-{i}", str(i % 5), f"body-{i}", t0 + dt.timedelta(hours=i)) for i in range(start, start + n)]
    return spark.createDataFrame(rows, "topic string, id string, key string, body string, ts timestamp")


def test_publish_goes_on_where_it_ended_and_replays_once(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.publish(messages(spark, 100), 1)
    store.publish(messages(spark, 50, start=100), 2)
    store.publish(messages(spark, 50, start=100), 2)
    got = store.read().collect()
    assert len(got) == 150 and not store.publish(messages(spark, 1), 1)
    with pytest.raises(ValueError, match="no partition"):
        store.scan("t", 9, 0, 5)
    assert sorted(r.offset for r in store.scan("t", 0, 3, 4).collect()) == [3, 4, 5, 6]
    plan = store.read("t", 1, 3, 9)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(topic" in plan and "GreaterThanOrEqual(offset,3)" in plan
    for p in range(3):
        offsets = sorted(r.offset for r in got if r.partition == p)
        assert offsets == list(range(len(offsets)))
    assert all(r.partition == h31(r.id, 3) for r in got)
    assert store.render_metrics().count() == 3


def test_store_compacts_deletes_and_recovers(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    for k in range(3):
        store.publish(messages(spark, 40, start=40 * k), k + 1)
    want = sorted(tuple(r) for r in store.read().select("id", "partition", "offset").collect())
    ends = sorted(map(tuple, store.end_offsets().collect()))
    assert store.segments().count() == 9 == store.recover().count() and store.segments().where("active").count() == 3
    doomed = store.segments().where("hi < 20")
    n = doomed.count()
    assert store.delete(doomed) == n > 0 and store.delete(doomed.limit(0)) == 0 and store.segments().count() == 9 - n
    left = sorted(tuple(r) for r in store.read().select("id", "partition", "offset").collect())
    assert set(left) < set(want) and sorted(map(tuple, store.end_offsets().collect())) == ends
    assert store.compact() and not store.compact() and sorted(tuple(r) for r in store.read().select("id", "partition", "offset").collect()) == left
    assert not store.publish(messages(spark, 40), 1) and store.publish(messages(spark, 5, start=500), 9)
    with pytest.raises(ValueError, match="rising"):
        store.publish(messages(spark, 1), 8)
    assert store.cleanup(dt.datetime(2030, 1, 1)) == 3 and {r.batch for r in store.read().select("batch").distinct().collect()} <= {1, 2, 3, 9}
    with pytest.raises(Exception, match="no id"):
        store.publish(messages(spark, 3).withColumn("id", F.lit(None).cast("string")), 10)
    assert store.publish(messages(spark, 30).withColumn("id", F.lit(None).cast("string")), 10, new_ids=True)
    assert store.read(batch=10).select("id").distinct().count() == 30


def test_producer_retries(spark, tmp_path):
    tries = []

    def down(*args):
        tries.append(args)
        raise OSError("down")

    p = Producer(None, retries=2, wait=lambda n: 0.0, publish=down)
    with pytest.raises(OSError, match="down"):
        p.send(None, 1)
    assert len(tries) == 3
    told = []
    f = p.send_async(None, 2, done=lambda out, fault: told.append((out, str(fault))))
    with pytest.raises(OSError):
        f.result()
    assert told == [(None, "down")]
    p.close()


def test_binary_and_attributes(spark):
    rows = spark.sql("select * from values (0L, 1L), (-1L, 9223372036854775807L), (258L, -9223372036854775808L) t(a, b)")
    raw = rows.withColumn("raw", routing.big_endian(F.col("a"), F.col("b")))
    for r in raw.select("a", "b", "raw", routing.from_big_endian(F.col("raw"), 0).alias("x"), routing.from_big_endian(F.col("raw"), 1).alias("y")).collect():
        assert bytes(r.raw) == r.a.to_bytes(8, "big", signed=True) + r.b.to_bytes(8, "big", signed=True) and (r.x, r.y) == (r.a, r.b)
    ports = spark.createDataFrame([("h:80",), ("h",), ("h:x",), (None,)], "a string").select(routing.host_of(F.col("a")), routing.port_of(F.col("a"))).collect()
    assert [tuple(r) for r in ports] == [("h", 80), ("h", None), ("h", None), (None, None)]


def test_dead_letters_are_buried_with_their_attempts(spark, tmp_path):
    b = Broker(spark, str(tmp_path))
    b.meta.join("b0", "h0")
    b.meta.create_topic("t")
    b.meta.create_topic("dead-letter")
    b.publish(messages(spark, 10), 1)
    attempts = [("t", f"msg-{i}", k > i) for i in range(6) for k in range(1, 5)]  # msg-0 failed always, msg-1 from the second time on
    b.bury(spark.createDataFrame(attempts, "topic string, id string, failed boolean"), 2)
    got = b.store.read("dead-letter").collect()
    assert [(r.id, r.kind, r.attributes) for r in got] == [("msg-0", "DEAD_LETTER", {"origin": "t", "attempts": "4"})]
    with pytest.raises(ValueError, match="no topic"):
        b.pull("g", topics=["absent"])
    with pytest.raises(ValueError, match="needed"):
        b.pull("")
    with pytest.raises(ValueError, match="needed"):
        b.subscribe("g", [], [])


def test_writes_are_joined_over_stretches(spark):
    r = random.Random(9)
    at, rows = 0, []
    for _ in range(400):
        n = r.choice((0, 1, 5, 90, 250))
        at += r.choice((0, 0, 0, 3))
        rows.append(("f" if r.random() < 2 else "g", at, n))
        at += n
    was = iosim.STRETCH
    try:
        iosim.STRETCH = 64
        got = sorted(map(tuple, iosim.coalesce_writes(spark.createDataFrame(rows, "file string, begin bigint, length bigint")).collect()))
        reads = {(x.batch, x.begin, x.requests) for x in iosim.batched_reads(spark.createDataFrame(rows, "file string, begin bigint, length bigint"), 7).collect()}
    finally:
        iosim.STRETCH = was
    want, end = [], None
    for f, a, n in sorted(rows):
        if a == end:
            want[-1] = (f, want[-1][1], want[-1][2] + n, want[-1][3] + 1)
        else:
            want.append((f, a, n, 1))
        end = a + n
    assert got == sorted(want)
    order = sorted(rows)
    assert reads == {(i // 7, order[i][1], len(order[i : i + 7])) for i in range(0, 400, 7)}


def test_keyed_publish_keeps_a_key_together(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.publish(messages(spark, 40), 1, keyed=True)
    assert store.read().groupBy("key").agg(F.countDistinct("partition").alias("n")).agg(F.max("n")).first()[0] == 1


def sized(spark, sizes, gaps):
    t = dt.datetime(2024, 1, 1)
    rows = []
    for i, (s, g) in enumerate(zip(sizes, gaps, strict=True)):
        t += dt.timedelta(seconds=g)
        rows.append(("t", 0, i, s, t))
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint, size bigint, ts timestamp")


@pytest.mark.parametrize("limits", [{"max_bytes": 10}, {"max_count": 3}, {"span_us": 5_000_000}, {"max_bytes": 12, "max_count": 4, "span_us": 6_000_000}])
def test_roll_is_the_greedy_fold(spark, limits):
    sizes, gaps = [4, 4, 4, 1, 9, 10, 2, 2, 2, 2, 2, 2], [1, 1, 2, 3, 0, 0, 9, 1, 1, 1, 1, 2]
    want, at = [], 0
    for i, (s, g) in enumerate(zip(sizes, gaps, strict=True)):
        at += g
        full = want and (
            (want[-1][2] + s > limits.get("max_bytes", 1 << 60)) or (want[-1][1] - want[-1][0] + 1 >= limits.get("max_count", 1 << 60)) or (at - want[-1][3] >= limits.get("span_us", 1 << 60) / 1e6)
        )
        if not want or full:
            want.append([i, i, s, at])
        else:
            want[-1][1], want[-1][2] = i, want[-1][2] + s
    got = segments.roll(sized(spark, sizes, gaps), **limits).orderBy("base").collect()
    assert [(r.base, r.hi, r.bytes) for r in got] == [(a, b, c) for a, b, c, _ in want]


def test_oversize_is_an_error(spark):
    with pytest.raises(Exception, match="larger than a segment"):
        segments.roll(sized(spark, [5, 50], [1, 1]), max_bytes=10).collect()


def test_sparse_index_strict_and_floor(spark):
    dense = spark.createDataFrame([("t", 0, i, i * 100, None) for i in range(10)], "topic string, partition int, offset bigint, position bigint, ts timestamp")
    index = segments.sparse_index(dense, 2)
    assert index.count() == 5
    targets = spark.createDataFrame([("t", 0, x) for x in (4, 5, 20, -1)], "topic string, partition int, target bigint")
    strict = {r.target: r.position for r in segments.floor_entry(index, targets, strict=True).collect()}
    assert strict == {4: 400, 5: 400, 20: None, -1: None}
    assert {r.target: r.position for r in segments.floor_entry(index, targets).collect()}[20] == 800


def test_should_roll_limits_are_inclusive(spark):
    one = spark.sql("select 50L as b, 100L as n, 7200L as age")
    pick = lambda **k: one.select(segments.should_roll(F.col("b"), F.col("n"), F.col("age"), **k)).first()[0]
    assert [pick(max_bytes=60), pick(max_bytes=40), pick(max_bytes=50)] == [False, True, True]
    assert [pick(max_count=50), pick(max_count=150), pick(max_count=100)] == [True, False, True]
    assert [pick(span_us=3600), pick(span_us=10800)] == [True, False]


def test_placements():
    brokers = [(f"b{i}", f"r{i % 3}") for i in range(6)]
    for replicas in placement.rack_aware(6, brokers, 3):
        assert len(set(replicas)) == 3 and {dict(brokers)[b] for b in replicas} == {"r0", "r1", "r2"}
    assert [len(set(r)) for r in placement.rack_aware(2, brokers, 6)] == [6, 6]
    # More replicas than racks: one of each rack, then all brokers by name from the partition's number on.
    assert placement.rack_aware(3, [(f"b{i}", f"r{i % 2}") for i in range(5)], 4) == [["b0", "b1", "b2", "b3"], ["b3", "b2", "b1", "b4"], ["b4", "b1", "b2", "b3"]]
    now = [("b0", ["b0", "b1"]), ("b2", ["b1", "b2"]), ("b2", ["b2", "b0"])]
    assert placement.least_movement(3, ["b0", "b1", "b2"], 2, now) == now
    moved = placement.least_movement(3, ["b0", "b2", "b3"], 2, now)
    assert moved[2] == ("b2", ["b2", "b0"]) and all("b1" not in r and len(set(r)) == 2 and leader in r for leader, r in moved)
    assert placement.least_movement(2, ["b"], 1, None) == [("b", ["b"]), ("b", ["b"])]
    with pytest.raises(ValueError):
        placement.least_movement(1, ["b"], 2, None)


def test_lru(spark):
    rows = [("c", i, p) for i, p in enumerate("abcabdae")]
    got = iosim.lru(spark.createDataFrame(rows, "cache string, seq bigint, page string"), 3).first()
    assert (got.hits, got.misses, got.evictions) == (3, 5, 2)


def test_lru_of_a_null_cache(spark):
    rows = [(c, i, p) for c in (None, "c", "") for i, p in enumerate("abcabdae" * 2000)]  # more than one batch
    got = iosim.lru(spark.createDataFrame(rows, "cache string, seq bigint, page string"), 3).collect()
    assert len(got) == 3 and {r.cache for r in got} == {None, "c", ""}
    assert len({(r.hits, r.misses, r.evictions) for r in got}) == 1 and all(r.hits + r.misses == 16000 for r in got)


def test_out_of_range(spark):
    rows = spark.createDataFrame([(5,), (15,)], "first_offset bigint")
    assert [r[0] for r in rows.select(log.check_range(F.lit(10), "earliest")).collect()] == [10, 15]
    with pytest.raises(Exception, match="first retained"):
        rows.select(log.check_range(F.lit(10))).collect()


def test_consume_commits_after_the_handler(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.publish(messages(spark, 60), 1)
    seen = []
    q = consumer.consume(consumer.topic_stream(spark, store.path, ["t"]), lambda df, _: seen.extend(r.id for r in df.collect()), "g", str(tmp_path / "commits"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == sorted(f"msg-{i}" for i in range(60))
    commits = spark.read.parquet(str(tmp_path / "commits"))
    assert commits.agg(F.sum("offset")).first()[0] == 60


def later_first(store, *entries):
    """Files of the entries named first get the oldest times, by which a stream takes them."""
    now = dt.datetime.now().timestamp() - 1000
    for i, entry in enumerate(entries):
        for k, f in enumerate(sorted(Path(store.path, "data", f"entry={entry}").rglob("*.parquet"))):
            os.utime(f, (now + 100 * i + k,) * 2)


def test_commits_of_files_that_come_out_of_order(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    for batch in (1, 2, 3):
        store.publish(messages(spark, 60, start=60 * (batch - 1)), batch)
    later_first(store, "batch-000000000003", "batch-000000000001", "batch-000000000002")
    seen = []
    stream = consumer.topic_stream(spark, store.path, ["t"], files=1)
    q = consumer.consume(stream, lambda df, n: seen.extend((r.partition, r.offset, n) for r in df.collect()), "g", str(tmp_path / "commits"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert q.exception() is None and len(seen) == 180 and len({n for _, _, n in seen}) == 9
    commits = spark.read.parquet(str(tmp_path / "commits"))
    want = {r.partition: r.next_offset for r in store.end_offsets().collect()}
    assert {r.partition: r.committed for r in groups.committed(commits).collect()} == want
    for c in commits.collect():  # none passes what wasn't handled, or stays below what was
        done = {o for p, o, n in seen if p == c.partition and n <= c.commit_seq}
        assert set(range(c.offset)) <= done and c.offset not in done


def test_commits_pass_deleted_segments(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    for batch in (1, 2, 3, 4):
        store.publish(messages(spark, 60, start=60 * (batch - 1)), batch)
    rows = [(s.topic, s.partition, s.base) for s in store.segments().collect() if s.entry[-1] in "13"]
    store.delete(spark.createDataFrame(rows, "topic string, partition int, base bigint"))
    later_first(store, "batch-000000000004", "batch-000000000002")
    sub = consumer.Subscription(store, "g", ["t"], lambda df, n: None, str(tmp_path / "commits"), str(tmp_path / "cp"))
    sub.start().awaitTermination()
    store.publish(messages(spark, 60, start=240), 5)
    sub.start().awaitTermination()
    want = {r.partition: r.next_offset for r in store.end_offsets().collect()}
    assert {r.partition: r.committed for r in groups.committed(spark.read.parquet(str(tmp_path / "commits"))).collect()} == want


def test_runs_of_offsets(spark):
    rng = random.Random(5)
    rows = [(t, 0, o) for t in ("a", None) for o in rng.sample(range(250_000), 3_000) + list(range(99_990, 100_010)) * 2]
    got = consumer.merged(consumer.runs(spark.createDataFrame(rows, "topic string, partition int, offset bigint"))).collect()
    for t in ("a", None):
        have = sorted({o for x, _, o in rows if x == t})
        starts = [o for i, o in enumerate(have) if not i or have[i - 1] != o - 1]
        ends = [o + 1 for i, o in enumerate(have) if i + 1 == len(have) or have[i + 1] != o + 1]
        assert sorted((r.first, r.next) for r in got if r.topic == t) == list(zip(starts, ends, strict=True))


def test_streamed_windows_and_delays(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"))
    store.publish(messages(spark, 60), 1)
    run = lambda df, name: df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(180)
    run(consumer.tumbling(consumer.topic_stream(spark, store.path)), "days")
    assert spark.table("days").agg(F.sum("n")).first()[0] == 48  # the third day stays open
    run(consumer.once(consumer.topic_stream(spark, store.path)), "once")
    assert spark.table("once").count() == 60
    held = consumer.topic_stream(spark, store.path).withColumn("wait", F.lit(3600))
    run(consumer.delayed(held, "wait"), "delays")
    assert spark.table("delays").count() == 59


def test_roll_streams_over_batches_and_unordered_times(spark):
    rng = random.Random(3)
    rows, want = [], {}
    t0 = dt.datetime(2024, 1, 1)
    for topic, n in (("a", 700), ("b", 1), ("c", 300)):
        segments_, at = [], None
        for i in range(n):
            size, sec = rng.randint(1, 9), i + rng.randint(-20, 20)
            rows.append((topic, 0, i, size, t0 + dt.timedelta(seconds=sec)))
            if at is None or at[2] + size > 100 or i - at[0] >= 30 or sec - at[3] >= 25:
                at = [i, i, 0, sec]
                segments_.append(at)
            at[1], at[2] = i, at[2] + size
        want[topic] = [tuple(s[:3]) for s in segments_]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, size bigint, ts timestamp").repartition(5)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
        got = segments.roll(df, max_bytes=100, max_count=30, span_us=25_000_000).orderBy("topic", "base").collect()
        pages = [(c, i, rng.randint(0, 12)) for c in "xy" for i in range(200)]
        lru = {r.cache: (r.hits, r.misses, r.evictions) for r in iosim.lru(spark.createDataFrame(pages, "cache string, seq bigint, page bigint"), 5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {t: [(r.base, r.hi, r.bytes) for r in got if r.topic == t] for t in want} == want
    for c in "xy":
        held, hits, out = [], 0, 0
        for _, _, page in [p for p in pages if p[0] == c]:
            hits += page in held
            held = [x for x in held if x != page] + [page]
            out += len(held) > 5
            held = held[-5:]
        assert lru[c] == (hits, 200 - hits, out)


def test_roll_and_lru_of_nothing(spark):
    assert segments.roll(sized(spark, [], []), max_bytes=10).count() == 0
    assert iosim.lru(spark.createDataFrame([], "cache string, seq bigint, page string"), 3).count() == 0


def test_broker_end_to_end(spark, tmp_path):
    b = Broker(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no topic"):
        b.publish(messages(spark, 3), 1)
    for i in range(3):
        b.meta.join(f"b{i}", f"h{i}:9000", f"r{i}")
    b.meta.create_topic("t", 4, 2)
    with pytest.raises(ValueError, match="exists"):
        b.meta.create_topic("t")
    sent = b.publish(messages(spark, 40), 1).collect()
    assert len(sent) == 40 and all(r.partition == h31(r.id, 4) for r in sent)
    b.publish(messages(spark, 40), 1)  # a retry
    assert b.store.read().count() == 40
    b.subscribe("g", ["t", "new"], ["c2", "c1"])
    assert b.meta.topics() == ["new", "t"] and b.meta.members("g") == ["c1", "c2"] and b.meta.members("none") == ["none-consumer"]
    first = b.pull("g", "c1", 100).collect()
    assert {r.partition for r in first} == {p for p in (0, 2) if any(r.partition == p for r in sent)}
    assert len(b.pull("g", most=1000).collect()) == 40
    b.ack("g", "t", [r.id for r in b.pull("g", most=1000).collect()], every=True)
    assert b.pull("g", most=1000).count() == 0 and b.lag().agg(F.sum("lag")).first()[0] == 0
    b.ack("g", "t", [r.id for r in sent if r.offset == 0][:1])  # goes back
    lag = {(r.topic, r.partition): r.lag for r in b.lag().collect()}
    assert len(lag) == 4 + 3 and sum(lag.values()) > 0
    stats = {r.topic: r.partitions for r in b.topic_stats().collect()}
    assert len(stats["t"]) == 4 and {p.latest for p in stats["new"]} == {-1} and all(p.isr_size == 2 for p in stats["t"])
    assert any(line.startswith('consumer_lag{group="g"') for line in b.metrics())


def test_metadata_follows_nodes(spark, tmp_path):
    m = Metadata(spark, str(tmp_path / "meta"))
    for i in range(4):
        m.join(f"b{i}", f"h{i}")
    m.create_topic("t", 4, 2)
    assert m.of_node("b1").count() == 2 and m.of_node("b1", "leader").count() == 1 and m.of_node("b1", "follower").count() == 1
    m.fail_over(["b1"])
    assert {r.partition: r.leader for r in m.partitions("t").collect()} == {0: "b0", 1: "b2", 2: "b2", 3: "b3"}
    m.rebalance("t")  # b1 is back: the leaders stay
    assert {r.partition: r.leader for r in m.partitions("t").collect()} == {0: "b0", 1: "b2", 2: "b2", 3: "b3"}
    m.leave("b1")
    assert m.brokers() == ["b0", "b2", "b3"]
    m.rebalance("t")
    for r in m.partitions("t").collect():
        assert "b1" not in r.replicas and len(set(r.replicas)) == 2 and r.leader == r.isr[0] and r.leader not in r.followers
    m.set_isr("t", 0, add=["x"], remove=["b0"])
    assert m.partitions("t").where("partition = 0").first().isr[-1] == "x"
    m.subscribe("g", ["t"], [])
    assert m.view("assignments").count() == 4
    m.unsubscribe("g")
    assert m.view("assignments").count() == 0 and m.view("groups").count() == 0
    m.delete_topic("t")
    assert m.topics() == [] and m.partitions().count() == 0
    m.join("b9", "old")
    m.join("b9", "new")
    assert [r["address"] for r in m.dump("brokers") if r["broker"] == "b9"] == ["new"]


def test_segment_names(spark):
    rows = spark.createDataFrame([("t-0/00000000000000000120.log",), ("00000000000000000000.log",), ("x.index",), ("x.log",)], "n string")
    assert [r[0] for r in rows.select(routing.base_of(F.col("n"))).collect()] == [120, 0, None, None]


def test_offsets_keep_rows_with_nulls(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("t", 0, "a", t0), ("t", 0, "b", None), ("t", 0, "c", None), (None, 0, "d", t0), (None, 0, "e", t0 + dt.timedelta(days=2))]
    df = spark.createDataFrame(rows, "topic string, partition int, id string, ts timestamp")
    got = log.assign_offsets(df, ["ts", "id"], F.date_trunc("day", F.col("ts"))).collect()
    assert {r.id: r.offset for r in got} == {"b": 0, "c": 1, "a": 2, "d": 0, "e": 1}
    assert log.assign_offsets(df.limit(0), ["ts", "id"], F.date_trunc("day", F.col("ts"))).count() == 0
