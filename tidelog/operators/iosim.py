"""Write coalescing and page-cache figures from an access log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of a file that one task numbers.
STRETCH = 1 << 26


def coalesce_writes(requests: DataFrame) -> DataFrame:
    """requests: (file, begin, length). Runs where one ends at the next one's begin become one write.

    Runs are found inside stretches of a file (by begin, STRETCH bytes each); what ends at a stretch's last and goes on at
    the next one's first is joined over the stretches' edges alone, so a large file is several tasks.
    """
    keys = ["file", "__b"]
    w = Window.partitionBy(*keys).orderBy("begin", "length")
    marked = requests.withColumn("__b", F.floor(F.col("begin") / STRETCH))
    marked = marked.withColumn("new", F.when(F.lag(F.col("begin") + F.col("length")).over(w) == F.col("begin"), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.col("begin") + F.col("length"), F.struct("begin", "length"))  # where the run's last request ends
    inside = runs.groupBy(*keys, "run").agg(F.min("begin").alias("begin"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("requests"), last.alias("__end"))
    edge = Window.partitionBy("file").orderBy("__b", "run")
    joined = inside.withColumn("new", F.when(F.lag("__end").over(edge) == F.col("begin"), 0).otherwise(1))
    joined = joined.withColumn("__run", F.sum("new").over(edge.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("file", "__run").agg(F.min("begin").alias("begin"), F.sum("length").alias("length"), F.sum("requests").alias("requests")).drop("__run")


def batched_reads(requests: DataFrame, most: int = 100) -> DataFrame:
    """requests: (file, begin, length). Reads in the order of their begins, most to a batch: (file, batch, begin, end, requests, bytes).

    Numbering runs inside stretches of a file (by begin, STRETCH bytes each) from the numbers of those before, so a large file is several tasks.
    """
    marked = requests.withColumn("__b", F.floor(F.col("begin") / STRETCH))
    before = Window.partitionBy("file").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = marked.groupBy("file", "__b").agg(F.count(F.lit(1)).alias("__n")).select("file", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("file", "__b").orderBy("begin", "length")) - 1
    numbered = marked.withColumn("__r", place).join(starts, ["file", "__b"])
    batch = F.floor((F.col("__start") + F.col("__r")) / most).cast("long")
    return numbered.groupBy("file", batch.alias("batch")).agg(F.min("begin").alias("begin"), F.max(F.col("begin") + F.col("length")).alias("end"), F.count(F.lit(1)).alias("requests"), F.sum("length").alias("bytes"))


def page_states(accesses: DataFrame) -> DataFrame:
    """accesses: (cache, seq, page, op), op one of read, write, flush. By cache: pages, writes that found a page clean, pages flushed, pages still dirty.

    A write marks a page dirty, a flush of a dirty page cleans it; a flush of a clean one counts nothing.
    """
    w = Window.partitionBy("cache", "page").orderBy("seq")
    marks = accesses.where(F.col("op") != "read").withColumn("was", F.lag("op").over(w)).withColumn("next", F.lead("op").over(w))
    dirty = F.col("op") == "write"
    by = marks.groupBy("cache").agg(
        F.count_if(dirty & ~F.equal_null("was", F.lit("write"))).alias("marked"), F.count_if((F.col("op") == "flush") & F.equal_null("was", F.lit("write"))).alias("flushed"), F.count_if(dirty & F.col("next").isNull()).alias("dirty")
    )
    pages = accesses.groupBy("cache", "page").agg(F.lit(1).alias("one")).groupBy("cache").agg(F.count(F.lit(1)).alias("pages"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("marked", "flushed", "dirty")]
    return pages.join(by.withColumnRenamed("cache", "__c"), F.equal_null("cache", "__c"), "left").select("cache", "pages", *zero)


def io_stats(requests: DataFrame) -> DataFrame:
    """requests: (op, bytes, failed). Requests, bytes and errors by kind of operation."""
    return requests.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_if("failed").alias("errors"))


def lru(accesses: DataFrame, capacity: int) -> DataFrame:
    """accesses: (cache, seq, page). Hits, misses and evictions of an LRU cache of that capacity, by cache; null is a cache.

    A cache is a sequential machine: its accesses, sorted outside Python, stream through one task, which
    holds at most capacity pages.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held, figures, begun = None, {}, [0, 0, 0], False
        for pdf in batches:
            rows = []
            for cache, part in pdf.groupby("cache", sort=False, dropna=False):
                cache = None if pd.isna(cache) else cache
                if begun and cache != name:
                    rows.append((name, *figures))
                    held, figures = {}, [0, 0, 0]
                name, begun = cache, True
                for page in part.page:
                    if page in held:
                        figures[0] += 1
                        del held[page]
                    else:
                        figures[1] += 1
                        if len(held) >= capacity:
                            del held[next(iter(held))]
                            figures[2] += 1
                    held[page] = True
            yield pd.DataFrame(rows, columns=["cache", "hits", "misses", "evictions"])
        yield pd.DataFrame([(name, *figures)] if begun else [], columns=["cache", "hits", "misses", "evictions"])

    rows = accesses.select("cache", "seq", "page")
    return rows.repartition("cache").sortWithinPartitions("cache", "seq").mapInPandas(run, "cache string, hits bigint, misses bigint, evictions bigint")
