"""Toxicity by maximum-scoring segments.

Each word scores its log odds of standing in a toxic text. The odds are posterior means under a chain
of Dirichlet priors: a word's prior is its longest prefix's posterior, that one's the next shorter's,
down to even odds, so that rare and unseen words borrow from their stems. A fixed drift is taken from
every word, which makes clean text score below zero, and one linear scan finds every maximal segment.
A segment is significant by extreme-value statistics: in a clean text of n words the best segment S
exceeds the rest as 1 - exp(-K n exp(-lambda S)), with lambda and K fitted on clean labelled texts. The
significant segments' excesses add up, and a logistic curve fitted on labelled texts left out of the
word counts gives the score.

The fit is a bounded sample of labelled rows (``docs_per_class``, ``chars_per_class``); scoring takes every text whole. Null
and empty texts score as a text without evidence. With no label of either class to learn from, every
text scores 0. Repeated rows are scored each, alike; a null key is a key like others, held out nowhere. Other columns than the text and
the key aren't read, whatever their names. An empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import bounded, crc_mod, lowest, ship, table, unit_hash

WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 9


def nodes(word: str) -> list[str]:
    """A word's prefixes, shortest first, and the word itself (marked)."""
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + "$"]


class Scores(dict):
    """Word -> score, by its longest known node; bounded."""

    def __init__(self, odds: dict[str, float], drift: float, limit: int = 200_000):
        self.odds, self.drift, self.limit = odds, drift, limit

    def __missing__(self, word: str) -> float:
        odds = self.odds
        x = odds.get(word + "$")
        for k in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            if x is not None:
                break
            x = odds.get(word[:k])
        x = (x or 0.0) - self.drift
        if len(word) <= 40:
            if len(self) >= self.limit:
                self.clear()
            self[word] = x
        return x


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (from, to, score), from left to right, in linear time."""
    sums = np.cumsum(scores)
    rises = np.flatnonzero(scores > 0)
    before, after = (sums[rises] - scores[rises]).tolist(), sums[rises].tolist()
    stack: list[tuple[int, int, float, float, int]] = []  # from, to, sum before, sum after, the last with a lower sum before
    for i, low, high in zip(rises.tolist(), before, after, strict=True):
        start, j = i, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                break
            start, low = stack[j][0], stack[j][2]  # it joins what stands from j on
            del stack[j:]
            j = len(stack) - 1
        stack.append((start, i + 1, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in stack]


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    drift: float = 0.1
    rate: float = 1.0  # lambda
    share: float = 1.0  # K
    weight: float = 0.0
    bias: float = -math.inf

    def evidence(self, scores: np.ndarray, found: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The significant segments' summed excess; each with its p-value."""
        room = math.log(max(self.share * len(scores), 1.0))
        kept, total = [], 0.0
        for a, b, s in found:
            excess = self.rate * s - room
            if excess > 0:
                total += excess
                kept.append((a, b, s, -math.expm1(-math.exp(-excess))))
        return total, kept

    def probability(self, total: float) -> float:
        x = self.bias + self.weight * math.log1p(total)
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def word_odds(texts: list[list[str]], toxic: list[int], prior: float = 4.0, least: int = 3) -> dict[str, float]:
    """Log odds by node, from the number of texts of either class that hold it."""
    by: tuple[Counter, Counter] = (Counter(), Counter())
    for words, y in zip(texts, toxic, strict=True):
        by[y].update({n for w in set(words) for n in nodes(w)})
    scale = max(sum(toxic), 1) / max(len(toxic) - sum(toxic), 1)
    share: dict[str, float] = {}
    every = {n for c in by for n, k in c.items() if k + by[c is by[0]][n] >= least}
    for n in sorted(every, key=lambda n: (len(n), n)):
        stem = n[:-1][:LONGEST] if n[-1] == "$" else n[:-1]
        hot, cold = by[1][n], by[0][n] * scale
        share[n] = (hot + prior * share.get(stem, 0.5)) / (hot + cold + prior)
    return {n: math.log(p / (1 - p)) for n, p in share.items()}


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model of labelled texts; every third one is for calibration."""
    if len(set(toxic)) < 2:
        return Model()
    words = [WORD.findall(t.lower()) for t in texts]
    part = np.arange(len(words)) % 3 == 2 if min(Counter(toxic).values()) >= 6 else np.zeros(len(words), bool)
    learn = np.flatnonzero(~part)
    odds = word_odds([words[i] for i in learn], [toxic[i] for i in learn])
    spare = np.flatnonzero(part) if part.any() else learn
    y = np.array([toxic[i] for i in spare], float)
    best: tuple[float, Model] | None = None
    for drift in (0.1, 0.2, 0.4, 0.8):
        table_ = Scores(odds, drift)
        scored = [np.array([table_[w] for w in words[i]]) for i in spare]
        clean = np.concatenate([s for s, k in zip(scored, y, strict=True) if not k] or [np.zeros(0)])
        if not len(clean) or clean.mean() >= 0:
            continue
        model = Model(odds, drift)
        low, high = 1e-3, 20.0  # lambda: the mean of exp(lambda s) over clean words is 1
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if np.exp(np.minimum(mid * clean, 50)).mean() > 1 else (mid, high)
        model.rate = low
        found = [segments(s) for s in scored]
        top = [(len(s), max((x[2] for x in f), default=0.0)) for s, f, k in zip(scored, found, y, strict=True) if not k and len(s)]
        model.share = float(np.clip(np.mean([math.exp(min(model.rate * s, 50)) / n for n, s in top if s < np.quantile([x[1] for x in top], 0.98)] or [1.0]), 1e-4, 10.0))
        x = np.array([math.log1p(model.evidence(s, f)[0]) for s, f in zip(scored, found, strict=True)])
        w, b = 1.0, -1.0
        for _ in range(50):  # Newton, slightly held back
            p = 1 / (1 + np.exp(-np.clip(w * x + b, -30, 30)))
            g = np.array([((p - y) * x).sum() + 0.1 * w, (p - y).sum() + 0.1 * b])
            r = p * (1 - p)
            h = np.array([[(r * x * x).sum() + 0.1, (r * x).sum()], [(r * x).sum(), r.sum() + 0.1]])
            w, b = np.array([w, b]) - np.linalg.solve(h, g)
        model.weight, model.bias = max(float(w), 0.0), float(b)
        p = np.clip(1 / (1 + np.exp(-(model.weight * x + model.bias))), 1e-6, 1 - 1e-6)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1] if best else Model()


def learn(docs: DataFrame, labels: DataFrame, rows: Column | None = None, text: str = "text", key: str = "doc_id", label: str = "toxic", docs_per_class: int = 1500, chars_per_class: int = 8_000_000) -> Model:
    """A model of at most docs_per_class labelled texts and chars_per_class characters of each class (those of smallest hash of the key); rows: a condition on labels.

    A key with both labels counts as 1. Labels other than 0 and 1, and null keys, are left out.
    """
    marked = (labels if rows is None else labels.where(rows)).select(labels[key].alias("k"), labels[label].alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1))
    marked = marked.groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    ranked = lowest(marked.withColumn("u", unit_hash(F.col("k"))), "y", ["u", "k"], docs_per_class, counts)
    chosen = docs.sparkSession.createDataFrame([(r.k, r.y) for r in ranked], marked.schema)  # 2 x docs_per_class keys at most
    texts = docs.select(docs[key].alias("k"), docs[text].alias("t")).join(F.broadcast(chosen), "k")
    sample = bounded(texts, docs_per_class, chars_per_class, dict(Counter(r.y for r in ranked)))
    # Classes take turns, so that each part of the fit has both.
    turn = sorted(range(len(sample)), key=lambda i: (i - (0 if sample[i][0] == sample[0][0] else sum(y == sample[0][0] for y, _ in sample)), sample[i][0]))
    return fit([sample[i][1] for i in turn], [int(sample[i][0]) for i in turn])


PASSAGES = "array<struct<start:int,end:int,score:double,p_value:double>>"


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", passages: bool = True) -> DataFrame:
    """Row by row: key, score, predicted, n_passages, and the significant passages in code points. The text alone is read."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # bounded by the fit's sample
    source = docs.select(docs[key], docs[text])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        by_word = Scores(m.odds, m.drift)
        for pdf in batches:
            out: list[tuple] = []
            for t in pdf.iloc[:, 1]:
                t = t if isinstance(t, str) else ""
                words = WORD.findall(t.lower())
                scores = np.fromiter(map(by_word.__getitem__, words), np.float64, len(words))
                total, kept = m.evidence(scores, segments(scores))
                spans = []
                if passages and kept:
                    at = [x.span() for x in WORD.finditer(t)]
                    same = len(at) == len(words)  # lower() may change a few scripts' letters
                    spans = [(at[a][0], at[b - 1][1], s, p) for a, b, s, p in kept] if same else [(0, len(t), s, p) for a, b, s, p in kept]
                out.append((m.probability(total), len(kept), spans))
            p = [x[0] for x in out]
            frame = {key: pdf.iloc[:, 0].to_numpy(), "score": p, "predicted": [int(x >= 0.5) for x in p], "n_passages": [x[1] for x in out]}
            yield pd.DataFrame(frame | ({"passages": [[dict(zip(("start", "end", "score", "p_value"), s, strict=True)) for s in x[2]] for x in out]} if passages else {}))

    return source.mapInPandas(run, f"`{key}` {source.schema[0].dataType.simpleString()}, score double, predicted int, n_passages int" + f", passages {PASSAGES}" * passages)


def query(spark, sf_dir):
    """op1: the toxicity of every document; labels are learned from rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels, crc_mod(labels["doc_id"], 5) != 0)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model, passages=False).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_passages")
