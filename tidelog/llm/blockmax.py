"""Exact top-k by inner product, with block-at-a-time pruning.

Vectors' components are the terms' weights. Rows are put in one global order in which alike ones stand together: a tree of halvings along the
widest component, learned on a bounded sample, deals every row to a leaf, and a leaf that holds more than shard_rows (one vector
that a third of the rows repeat, say) to several shards by a hash of the id. Of each leaf the least and greatest weight of each
term are known (LEAVES leaves at most, so this table is bounded). A query bounds a leaf, or inside a shard a document-range block, by the sum over
terms of weight times the maximum (the minimum where its own weight is negative).

First each query searches the leaf of its highest bound; its k-th score there is a threshold. Then it is sent to those other leaves alone whose
bound reaches the threshold. In a shard it takes blocks in order of bounds, scores each through its forward index, and
stops when the next bound falls below the threshold or its k-th score there. A bound equal to it is still scored, so ties go
to the smaller id. Where nothing can be pruned, the work is queries x rows in bounded cells.

Weights are integers (floor(scale x)); sums are exact as long as they stay below 2^53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cells import best_of, matrix, search_leaves, usable
from tidelog.llm.common import saved, settled, ship, table, unit_hash

#: Leaves of the global order, at most.
LEAVES = 1024


def alike(x: np.ndarray, block: int) -> np.ndarray:
    """An order of rows in which blocks hold alike ones: halves along the widest component, again and again."""
    out: list[np.ndarray] = []
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= block:
            out.append(rows)
            continue
        part = x[rows]
        axis = int(part.var(axis=0).argmax()) if x.shape[1] else 0
        order = rows[np.argsort(part[:, axis], kind="stable")] if x.shape[1] else rows
        half = -(-len(rows) // block) // 2 * block
        todo += [order[half:], order[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.intp)


@dataclass
class Order:
    """Halvings: node i's children are 2 i + 1 and 2 i + 2; a leaf is where a vector comes to after depth of them."""

    depth: int
    axis: np.ndarray
    edge: np.ndarray
    low: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # leaf x term; a leaf without rows has inf, -inf
    high: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def of(cls, sample: np.ndarray, depth: int) -> Order:
        out = cls(depth, np.zeros(2**depth - 1, np.intp), np.zeros(2**depth - 1))
        parts = {0: sample}
        for i in range(2**depth - 1):
            part = parts.pop(i)
            right = np.zeros(len(part), bool)
            if part.size:
                out.axis[i] = part.var(axis=0).argmax()
                out.edge[i] = np.median(part[:, out.axis[i]])
                right = part[:, out.axis[i]] > out.edge[i]
            parts[2 * i + 1], parts[2 * i + 2] = part[~right], part[right]
        return out

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.intp)
        for _ in range(self.depth):
            right = x[np.arange(len(x)), self.axis[at]] > self.edge[at] if x.shape[1] else np.zeros(len(x), bool)
            at = 2 * at + 1 + right
        return at - (2**self.depth - 1)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """query x leaf; minus infinity for a leaf without rows."""
        live = np.flatnonzero((self.low <= self.high).all(axis=1))
        out = np.full((len(q), len(self.low)), -np.inf)
        out[:, live] = np.maximum(q, 0) @ self.high[live].T + np.minimum(q, 0) @ self.low[live].T
        return out


def block_search(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, block: int = 64, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, id, score) of each query's k best or more that reach least, and how many (query, block) pairs were scored. An id may be there twice."""
    order = alike(x, block)
    x, ids = x[order], ids[order]
    blocks = [slice(i, i + block) for i in range(0, len(x), block)]
    high, low = np.stack([x[b].max(axis=0) for b in blocks]), np.stack([x[b].min(axis=0) for b in blocks])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    turn = np.argsort(-bounds, axis=1, kind="stable")
    copies = len(np.unique(ids)) < len(ids)
    best = np.full((len(q), k), -np.inf)  # scores, highest first
    least = np.full(len(q), -np.inf) if least is None else least
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active, scored = np.arange(len(q)), 0
    for step in range(len(blocks)):
        at = turn[active, step]
        # With ids that repeat, the k-th score here isn't that of k ids.
        go = bounds[active, at] >= (least[active] if copies else np.maximum(best[active, -1], least[active]))
        active, at = active[go], at[go]
        if not len(active):
            break
        scored += len(active)
        by = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[by], prepend=-1, append=len(blocks)))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows, where = active[by[a:b]], blocks[at[by[a]]]
            s = q[rows] @ x[where].T
            s[own[rows][:, None] == ids[where][None, :]] = -np.inf
            r, c = np.nonzero((s >= (least[rows] if copies else np.maximum(best[rows, -1], least[rows]))[:, None]) & (s > -np.inf))
            kept.append((rows[r], ids[where][c], s[r, c]))
            both = np.concatenate([best[rows], s], axis=1)
            best[rows] = -np.sort(-np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
    row, vec, s = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, np.intp), ids[:0], np.zeros(0))
    good = s >= best[row, -1] if not copies else np.ones(len(s), bool)
    return row[good], vec[good], s[good], scored


def exact_top_k(df: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, key: str = "vec_id", vec: str = "embedding", shard_rows: int = 2048, sample_rows: int = 8192, spent: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products among df's other rows.

    Rows whose vector is null or holds null or non-finite components, and rows without an id, take no
    part. Rows that repeat an id are one, with its best score. Fewer than k candidates are all returned. Empty tables give an empty result. Other
    columns aren't read, whatever their names. spent, if given, gets the (query, leaf) pairs there are and those that were searched.
    """
    spark = df.sparkSession
    ship(spark)
    pick = lambda d: d.select(d[key].alias("id"), F.transform(d[vec], lambda v: F.floor(F.lit(float(scale)) * v.cast("double")).cast("double")).alias("vec"), d[vec].alias("raw")).where(F.col("id").isNotNull() & usable(F.col("raw"))).drop("raw")
    rows, asked = pick(df), pick(queries)
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    n_queries, wide = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    width = max(width, wide)
    depth = max(0, min(int(math.log2(LEAVES)), math.ceil(math.log2(max(n, 1) / shard_rows))))
    chosen = rows.withColumn("u", unit_hash(F.col("id"))).where(F.col("u") < min(1.0, 1.2 * sample_rows / max(n, 1))).orderBy("u", "id").limit(sample_rows).toPandas() if depth else None
    order = Order.of(matrix(chosen.vec, width) if depth else np.zeros((0, width)), depth)
    held = spark.sparkContext.broadcast(order)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=held.value.leaf(matrix(pdf.vec, width)).astype(np.int32))

    kind = rows.schema["id"].dataType.simpleString()
    dealt = saved(rows.mapInPandas(deal, f"id {kind}, vec array<double>, leaf int"))
    # A shorter vector's missing components are 0.
    extremes = [f(F.coalesce(F.get("vec", i), F.lit(0.0))) for i in range(width) for f in (F.min, F.max)]
    stats = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.array(*extremes).cast("array<double>").alias("x")).collect()  # LEAVES rows at most
    order.low, order.high = np.full((2**depth, width), np.inf), np.full((2**depth, width), -np.inf)
    parts = [0] * 2**depth
    for r in stats:
        order.low[r.leaf], order.high[r.leaf] = r.x[::2], r.x[1::2]
        parts[r.leaf] = math.ceil(r.n / shard_rows)
    known = spark.sparkContext.broadcast(order)

    def run(q, own, least, x, ids):
        row, vec_id, s, _ = block_search(q, own, x, ids, k, least=least)
        return row, vec_id, s.astype(np.int64)

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries with the leaves they go to: the best one first; after that, those others that may hold a score of least."""
        for pdf in batches:
            bounds = known.value.bounds(matrix(pdf.vec, width))
            first = bounds.argmax(axis=1)
            least = pdf.least.to_numpy()
            leaves = []
            for i, b in enumerate(bounds):
                go = b >= least[i]
                go[first[i]] = False
                leaves.append(np.flatnonzero(go & (b > -np.inf)).astype(np.int32) if pdf.again.iat[i] else np.array([first[i]], np.int32))
            yield pdf[["id", "vec", "least"]].assign(leaves=leaves)

    out = f"id {kind}, vec array<double>, least double, leaves array<int>"
    to_best = saved(asked.withColumns({"least": F.lit(-math.inf), "again": F.lit(False)}).mapInPandas(sent, out))
    one = saved(search_leaves(dealt, to_best, parts, width, k, run, "bigint"))
    worst = one.groupBy(F.col("query_id").alias("q")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("w"))
    again = asked.join(worst, F.col("id") == F.col("q"), "left").select("id", "vec", F.coalesce("w", F.lit(-math.inf)).alias("least"), F.lit(True).alias("again"))
    to_rest = saved(again.mapInPandas(sent, out))
    two = search_leaves(dealt, to_rest, parts, width, k, run, "bigint")
    if spent is not None:
        spent["pairs"] = n_queries * sum(p > 0 for p in parts)
        spent["searched"] = n_queries + (to_rest.agg(F.sum(F.size("leaves"))).first()[0] or 0)
    return best_of(one.drop("rank").unionByName(two.drop("rank")), k)


def query(spark, sf_dir):
    """op2: every 50th vector against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return settled(spark, lambda _: exact_top_k(vectors, vectors.where(vectors["vec_id"] % 50 == 0)))


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as w from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, d.vec_id, coalesce(list_sum(list_transform(list_zip(q.w, d.w), lambda p: p[1] * p[2])), 0)::bigint as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0
), r as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s
)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
