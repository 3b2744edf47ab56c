"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.sources.shared import give_back, hadoop, names, remove, rename, saved, settled, shared_dir, workspace  # noqa: F401

ROOT = str(Path(__file__).resolve().parents[2])
#: Characters that one vectorised step handles; it bounds a Python worker's arrays.
STEP_CHARS = 500_000
SALTS = 64
#: Texts are long: fewer rows to a batch than Spark's default, so workers that many stages share stay small.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver was started from, and bounds what one Arrow batch holds.

    A plan takes these settings when it is run, not when it is made, so they stay in the session; one that the session was
    given already stays as it is.
    """
    for key, value in ARROW.items():
        if not spark._jsparkSession.conf().contains(key):
            spark.conf.set(key, value)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))


def crc_mod(col: Column, n: int) -> Column:
    return F.crc32(col.cast("string")) % n


def unit_hash(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the columns' values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def lowest(rows: DataFrame, by: str, order: list[str], n: int, counts: dict) -> list[Row]:
    """The n first distinct rows of each value of by, collected. The first column of order is uniform in (0, 1); counts: how many rows each value has.

    Of a value with c rows only those are shuffled whose first column is at most 4 n / c, or 8 times as much as long as fewer than n distinct
    ones are found, so what is ranked doesn't grow with the input. They are ranked in each task, then in SALTS groups of a value, then over what
    is left of these, so many rows that share their first column (SALTS x n of a value at most) don't meet in one task either.
    """
    spark = rows.sparkSession
    edges = {y: min(1.0, 4 * n / c) for y, c in counts.items()}
    out: list[Row] = []
    while edges:
        near = spark.createDataFrame(list(edges.items()), T.StructType([rows.schema[by], T.StructField("__edge", T.DoubleType())]))  # a row a value
        some = rows.join(F.broadcast(near), by).where(F.col(order[0]) <= F.col("__edge")).drop("__edge").distinct()
        some = some.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        some = some.withColumn("__r", F.row_number().over(Window.partitionBy(by, "__salt").orderBy(*order))).where(F.col("__r") <= n).drop("__r", "__salt")
        found: dict = {y: [] for y in edges}
        for r in some.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r").collect():
            found[r[by]].append(r)
        short = {y for y, e in edges.items() if e < 1 and len(found[y]) < n}
        out += [r for y in edges if y not in short for r in found[y]]
        edges = {y: min(1.0, 8 * edges[y]) for y in short}
    return out


def bounded(rows: DataFrame, per: int, chars: int, counts: dict | None = None) -> list[tuple]:
    """(label, text) of at most per rows and chars characters of each label, in a fixed order: those of lowest hash of the key, or of the text where the key is null.

    rows: (k, y, t). What reaches the driver is bounded before it is collected: a first pass ranks rows by hash, without their texts,
    and the texts of those that fit are fetched by a second. Rows that repeat a text of a key and label count once; null texts and labels
    not at all. Labels must be few; counts: about how many rows each has, counted here if not given.
    """
    u = F.when(F.col("k").isNull(), unit_hash(F.col("t"))).otherwise(unit_hash(F.col("k")))
    known = rows.where(F.col("t").isNotNull() & F.col("y").isNotNull()).select("y", u.alias("u"), F.xxhash64("t").alias("d"), F.length("t").alias("n"), "t")
    if counts is None:
        counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    held: dict = {}
    chosen = []
    for x in sorted((r.y, r.u, r.d, r.n) for r in lowest(known.select("y", "u", "d", "n"), "y", ["u", "d"], per, counts)):
        held[x[0]] = held.get(x[0], 0) + x[3]
        if held[x[0]] <= chars:
            chosen.append(x[:3])
    if not chosen:
        return []
    wanted = rows.sparkSession.createDataFrame(chosen, known.select("y", "u", "d").schema)
    found = known.join(F.broadcast(wanted), ["y", "u", "d"]).groupBy("y", "u", "d").agg(F.first("t").alias("t"))  # per rows a label
    return [(r.y, r.t) for r in sorted(found.collect(), key=lambda r: (r.y, r.u, r.d))]


def steps(texts: list[str], size: int = STEP_CHARS):
    """Slices (from, to) of texts that hold about size characters; a longer text stands alone."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > size:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)
