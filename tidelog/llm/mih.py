"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are rotated (principal directions of a bounded sample, then a rotation learned to lose least by
taking signs) and their signs make a code of up to 64 bits, cut into substrings, each with an index from
value to rows. For a radius r, pigeonhole: spread over m substrings, some substring differs in at most
floor(r / m) bits (one less for those beyond the remainder), so probing each index that far finds every
code within r. Those within r are ranked by their exact inner products.

Inner products become angles by one more component, sqrt(M^2 - |x|^2) with M the longest vector. The
radius is each query's own, found in two rounds: a small radius first gives k neighbours; the worst of
them bounds the angle of any better one, and the second radius holds codes at that angle but for a tail
measured on the sample. So radii shrink as rows grow denser. No bucket is capped.

Every row is indexed; only the codes are fitted on a sample. Vectors null, zero, or with null or
non-finite components, and rows without an id, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.cells import best_of, matrix, search, usable
from tidelog.llm.common import saved, settled, table, unit_hash

BITS, PIECE = 64, 8
PIECES = BITS // PIECE
#: All 8-bit masks by number of bits, fewest first; how many there are of at most so many bits.
MASKS = np.array(sorted(range(256), key=lambda x: (x.bit_count(), x)), np.uint8)
UPTO = np.searchsorted(np.bitwise_count(MASKS), np.arange(PIECE + 1), "right")


@dataclass
class Codes:
    mean: np.ndarray
    turn: np.ndarray  # width + 1 -> bits
    longest: float
    first: int  # radius of the first round
    tail: float = 2.0

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, 1 - (x**2).sum(axis=1) / self.longest**2))
        return np.column_stack([x / self.longest, rest])

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q / np.sqrt((q**2).sum(axis=1, keepdims=True)), np.zeros(len(q))])

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (as rows of bytes) of rows or queries with the added component."""
        bits = np.zeros((len(x), BITS), bool)
        bits[:, : self.turn.shape[1]] = (x - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1)

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        b = self.turn.shape[1]
        p = np.arccos(np.clip(cosine, -1, 1)) / np.pi
        return np.ceil(b * p + self.tail * np.sqrt(b * p * (1 - p) + 1)).astype(int)


def fit(sample: np.ndarray, longest: float, k: int, rounds: int = 30, seed: int = 5, wanted: float = 0.985) -> Codes:
    """Codes from a sample of vectors."""
    rng = np.random.default_rng(seed)
    codes = Codes(np.zeros(sample.shape[1] + 1), np.zeros((sample.shape[1] + 1, 0)), longest, BITS)
    x = codes.rows(sample)
    if len(x) < 2:
        return codes
    codes.mean = x.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov((x - codes.mean).T))
    axes = vectors[:, ::-1][:, : min(BITS, x.shape[1])]
    y = (x - codes.mean) @ axes
    turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))
    for _ in range(rounds):  # signs, then the rotation nearest to them, alternately
        u, _, v = np.linalg.svd(np.sign(y @ turn).T @ y)
        turn = (u @ v).T
    codes.turn = axes @ turn
    code = codes.encode(x)
    picks = np.arange(0, len(x), max(1, len(x) // 200))
    q = codes.asked(sample[picks])
    near = codes.encode(q)
    cosine = q @ x.T
    cosine[np.arange(len(picks)), picks] = -np.inf
    apart = np.bitwise_count(near[:, None, :] ^ code[None, :, :]).sum(axis=2)
    codes.first = int(np.quantile(apart, 0.02))
    kth = min(k, len(x) - 1)
    order = np.argsort(-cosine, axis=1)[:, :kth]
    worst = np.take_along_axis(cosine, order[:, -1:], axis=1)
    b = codes.turn.shape[1]
    p = np.arccos(np.clip(worst, -1, 1)) / np.pi
    codes.tail = float(np.quantile((np.take_along_axis(apart, order, axis=1) - b * p) / np.sqrt(b * p * (1 - p) + 1), wanted))
    return codes


class Index:
    """Of each substring of the codes: rows by value."""

    def __init__(self, code: np.ndarray):
        self.whole = code.view(np.uint64).ravel()
        self.order = [np.argsort(code[:, i], kind="stable") for i in range(PIECES)]
        self.begins = [np.searchsorted(code[o, i], np.arange(257)) for i, o in enumerate(self.order)]

    def within(self, code: np.ndarray, r: int) -> np.ndarray:
        """Every row whose code differs in r bits at most."""
        if r >= BITS:
            return np.arange(len(self.whole))
        seen = np.zeros(len(self.whole), bool)
        for i in range(PIECES):
            reach = r // PIECES - (i > r % PIECES)
            if reach < 0:
                continue
            values = code[i] ^ MASKS[: UPTO[min(reach, PIECE)]]
            a, n = self.begins[i][values], self.begins[i][values.astype(int) + 1] - self.begins[i][values]
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            seen[self.order[i][at]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.whole[rows] ^ code.view(np.uint64)[0]) <= r]


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vec: str = "embedding", sample_rows: int = 4096, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among df's other rows, by inner product.

    sample_rows bounds the rows the codes are fitted on.
    """
    pick = lambda d: d.select(d[key].alias("id"), F.transform(d[vec], lambda v: v.cast("double")).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")) & F.exists("vec", lambda v: v != 0))
    rows, asked = pick(df), pick(queries)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    n, width, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.max(norm), F.lit(1.0))).first()
    n_queries, wide = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    width, longest = max(width, wide), float(np.sqrt(longest))
    chosen = rows.withColumn("u", unit_hash(F.col("id"))).where(F.col("u") < min(1.0, 1.2 * sample_rows / max(n, 1))).toPandas().sort_values(["u", "id"], kind="stable").head(sample_rows)
    codes = fit(matrix(chosen.vec, width), longest, k)
    held = rows.sparkSession.sparkContext.broadcast(codes)

    def run(q, own, radius, x, ids):
        c = held.value
        index = Index(c.encode(c.rows(x)))
        code = c.encode(c.asked(q))
        once = len(np.unique(ids)) == len(ids)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(q)):
            found = index.within(code[i], int(radius[i]))
            found = found[ids[found] != own[i]]
            s = x[found] @ q[i]
            if once and len(found) > 4 * k:
                good = s >= np.partition(s, len(s) - k)[len(s) - k]
                found, s = found[good], s[good]
            out.append((np.full(len(found), i), ids[found], s))
        return tuple(np.concatenate(z) for z in zip(*out, strict=True))

    one = saved(search(rows, asked.withColumn("extra", F.lit(codes.first)), n, n_queries, width, k, run, "double", shard_rows))
    worst = one.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
    b, tail = codes.turn.shape[1], codes.tail
    length = F.sqrt(norm)
    p = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") / (longest * length)))) / F.lit(float(np.pi))
    radius = F.when((F.col("n") < k) | F.col("n").isNull(), F.lit(BITS)).otherwise(F.least(F.lit(BITS), F.ceil(b * p + tail * F.sqrt(b * p * (1 - p) + 1)).cast("int")))
    again = asked.join(worst, F.col("id") == F.col("query_id"), "left").select("id", "vec", radius.cast("int").alias("extra"))
    two = search(rows, again, n, n_queries, width, k, run, "double", shard_rows)
    return best_of(one.unionByName(two).drop("rank"), k)  # what only the first round found counts too


def query(spark, sf_dir):
    """op4: every 20th vector against all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return settled(spark, lambda _: nearest(vectors, vectors.where(vectors["vec_id"] % 20 == 0)))
