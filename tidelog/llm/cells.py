"""A stated query set against all rows, in cells of bounded size.

Rows are dealt by a hash of their id into shards of about shard_rows, queries into groups of about
group_rows; a cell holds one shard and one group, and returns each query's k best of its shard. So a
task's memory is bounded, a row is sent once for each query group, a query once for each shard, and what
leaves a cell is k rows a query at most, whatever the scores. Rows without an id take no part. Rows that
repeat an id count as one, with the best score; a query's own id is no candidate.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import ship

#: (queries, their ids, their extra column, vectors, their ids) -> query row, id, score of the k best or more.
CellSearch = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component."""
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of doubles; what a shorter vector lacks is 0."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def top(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k highest scores, ties to smaller ids, an id once."""
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    pairs = np.lexsort((-scores, ids, row))
    again = np.zeros(len(row), bool)
    again[pairs[1:]] = (row[pairs[1:]] == row[pairs[:-1]]) & (ids[pairs[1:]] == ids[pairs[:-1]])
    if again.any():
        row, ids, scores = row[~again], ids[~again], scores[~again]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], ids[keep], scores[keep]


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query, an id once, ties to the smaller."""
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cell_of(run: CellSearch, width: int, k: int, score: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def cell(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, "f8" if score == "double" else "i8")})
        q, d = q.sort_values("id", kind="stable"), d.sort_values("id", kind="stable")
        ids = q.id.to_numpy()
        found = run(matrix(q.vec, width), ids, q.extra.to_numpy(), matrix(d.vec, width), d.id.to_numpy())
        row, vec_id, points = top(*found, k)
        return pd.DataFrame({"query_id": ids[row], "vec_id": vec_id, "score": points})

    return cell


def search(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, width: int, k: int, run: CellSearch, score: str, shard_rows: int, group_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score. rows: (id, vec); queries: (id, vec, extra)."""
    ship(rows.sparkSession)
    shards, groups = max(1, math.ceil(n_rows / shard_rows)), max(1, math.ceil(n_queries / group_rows))
    each = lambda n: F.explode(F.array(*map(F.lit, range(n))) if n < 64 else F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("s"), each(groups).alias("g"))
    asked = queries.select("id", "vec", "extra", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("g"), each(shards).alias("s"))

    kind = rows.schema["id"].dataType if isinstance(rows.schema["id"].dataType, T.IntegralType) else T.LongType()
    best = asked.groupBy("g", "s").cogroup(dealt.groupBy("g", "s")).applyInPandas(cell_of(run, width, k, score), f"query_id {kind.simpleString()}, vec_id {kind.simpleString()}, score {score}")
    return best_of(best, k)


def search_leaves(rows: DataFrame, queries: DataFrame, parts: list[int], width: int, k: int, run: CellSearch, score: str, group_rows: int = 4096) -> DataFrame:
    """As search(), of rows dealt to leaves and queries sent to some. rows: (id, vec, leaf); queries: (id, vec, least, leaves).

    parts: into how many shards each leaf's rows are split. A leaf's queries are split into groups of about group_rows, by how many are sent to it.
    """
    ship(rows.sparkSession)
    of = lambda xs, leaf: F.element_at(F.array(*(F.lit(x) for x in xs)), leaf + 1)
    asked = queries.select("id", "vec", F.col("least").alias("extra"), F.explode("leaves").alias("leaf"))
    hits = {r["leaf"]: r["count"] for r in asked.groupBy("leaf").count().collect()}  # a row a leaf
    groups = [math.ceil(hits.get(i, 0) / group_rows) for i in range(len(parts))]
    kind = rows.schema["id"].dataType if isinstance(rows.schema["id"].dataType, T.IntegralType) else T.LongType()
    schema = f"query_id {kind.simpleString()}, vec_id {kind.simpleString()}, score {score}"
    if not hits:
        return best_of(rows.sparkSession.createDataFrame([], schema), k)
    to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = rows.withColumn("g", of(groups, F.col("leaf"))).where("g > 0").select("id", "vec", "leaf", F.pmod(F.xxhash64("id"), of(parts, F.col("leaf"))).cast("int").alias("s"), to(F.col("g")).alias("g"))
    sent = asked.withColumn("p", of(parts, F.col("leaf"))).where("p > 0").select("id", "vec", "extra", "leaf", F.pmod(F.xxhash64("id", F.lit(1)), of(groups, F.col("leaf"))).cast("int").alias("g"), to(F.col("p")).alias("s"))
    best = sent.groupBy("leaf", "g", "s").cogroup(dealt.groupBy("leaf", "g", "s")).applyInPandas(cell_of(run, width, k, score), schema)
    return best_of(best, k)
