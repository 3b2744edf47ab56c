"""Expressions: routing hash, sizes, predicates on messages and control rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash31(text: Column) -> Column:
    """h = 31 h + code point, kept to 31 bits at each step; not Spark's hash()."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0x7FFFFFFF).cast("long")))


def partition_of(text: Column, partitions: int | Column) -> Column:
    return (hash31(text) % partitions).cast("int")


def keyed_partition(key: Column, message_id: Column, partitions: int | Column) -> Column:
    """Routing by key where there is one (an extension: the default routes by id)."""
    return partition_of(F.coalesce(key, message_id), partitions)


def message_size(*fields: Column, overhead: int = 32) -> Column:
    """Bytes of a record: its fields and a fixed header."""
    total = F.lit(overhead).cast("long")
    for f in fields:
        total = total + F.coalesce(F.octet_length(f), F.lit(0))
    return total


def delay_ready(kind: Column, delay_s: Column, ts: Column, now: Column) -> Column:
    """A message is ready unless it is DELAYED, has a delay, and now isn't past ts + delay."""
    return F.coalesce(kind != "DELAYED", F.lit(True)) | delay_s.isNull() | (now > ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay_s.cast("decimal(18,6)")))


def is_down(last_seen: Column, now: Column, seconds: int = 30) -> Column:
    return (now - last_seen) > F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def in_sync(leader_offset: Column, follower_offset: Column, most: int = 10) -> Column:
    return leader_offset - follower_offset <= most


def same_members(a: Column, b: Column) -> Column:
    """Whether two lists hold the same members, in any order: whether an in-sync set has changed."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def has_attributes(attributes: Column, wanted: dict[str, str]) -> Column:
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (F.element_at(attributes, k) == v)
    return F.coalesce(out, F.lit(False))


def with_attribute(attributes: Column, name: str, value: Column) -> Column:
    """The attributes with one more, or with another value for one that is there; null attributes are none."""
    had = F.coalesce(attributes, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(had, lambda k, v: k != name), F.create_map(F.lit(name), value.cast("string")))


def without_attribute(attributes: Column, name: str) -> Column:
    return F.map_filter(attributes, lambda k, v: k != name)


def attribute(attributes: Column, name: str, default: Column) -> Column:
    return F.coalesce(F.try_element_at(attributes, F.lit(name)), default)


def host_of(address: Column) -> Column:
    return F.substring_index(address, ":", 1)


def port_of(address: Column) -> Column:
    """The port of host:port; null where there is none."""
    return F.when(F.contains(address, F.lit(":")), F.substring_index(address, ":", -1).try_cast("int"))


def big_endian(*numbers: Column) -> Column:
    """Numbers of 64 bits, most significant byte first, one after the other."""
    return F.unhex(F.concat(*(F.lpad(F.hex(n.cast("long")), 16, "0") for n in numbers)))


def from_big_endian(data: Column, place: int) -> Column:
    """The place-th (from 0) 64-bit number of such bytes."""
    raw = F.hex(F.substring(data, 8 * place + 1, 8))
    high, low = F.conv(F.substring(raw, 1, 8), 16, 10).cast("long"), F.conv(F.substring(raw, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def request_fault(group: Column, topic: Column, ids: Column | None = None) -> Column:
    """What is wrong with a request for a group and topic (and, to acknowledge, ids); null if nothing is."""
    out = F.when(group.isNull() | (group == ""), "group").when(topic.isNull() | (topic == ""), "topic")
    return out if ids is None else out.when(ids.isNull() | (F.size(ids) == 0), "ids")


def segment_name(base: Column) -> Column:
    return F.concat(F.lpad(base.cast("string"), 20, "0"), F.lit(".log"))


def base_of(name: Column) -> Column:
    """The base offset that a segment file's name, with or without its folder, stands for; null if it isn't one."""
    last = F.element_at(F.split(name, "/"), -1)
    return F.when(F.endswith(last, F.lit(".log")), F.substring(last, 1, 20).try_cast("bigint"))


def node_id(host: Column, address: Column, stamp: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("-", host, F.replace(address, F.lit(":"), F.lit("-")), stamp.cast("string"))), 1, 12)
