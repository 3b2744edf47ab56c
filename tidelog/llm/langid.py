"""Language identification by interpolated Kneser-Ney character models.

One model per language, of order 5, over lower-case letters with every other run of characters as one
space. The languages' n-grams share sorted arrays of 64-bit hashes, one per order; beside each hash
stand its interpolated log probabilities in every language and, by context, the back-off weights. A text goes to
the language of lowest cross-entropy per character. What no language explains is rejected. The limit is
calibrated on texts left out of the model. A short text's is its language's noise over the root of its letters:
the median excess of pieces and four robust standard deviations, the largest of some bands of length (noise_of). A long text's lies, those texts being read once with their own
language and once as if it had not been learned, a third of the way from the one mean to the other (ten robust standard deviations above the own median, at
least). The larger of the two holds, but never more than the larger of twice the own mean and eight standard deviations with the noise at the
text's length, which alone holds where fewer than two languages are learned. A text over the limit stays if its pieces, each in the
language that suits it best, are not, noise being counted by the letters of its different words: it mixes languages that are learned.

Fitting takes at most ``docs_per_lang`` rows of each language (those of smallest hash of the id; a fit
is a bounded sample by design), scoring takes every text whole. Null texts and texts without a letter
are ``und`` with score 0. With no row to learn from, every text is ``und``.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import STEP_CHARS, bounded, crc_mod, ship, steps, table

ORDER, ALPHABET = 5, 65536
UND = "und"
#: Characters of a text that are taken to be in one language, where the whole fits none.
PIECE = 200
#: Lengths of the pieces on which a short text's noise is measured.
BANDS = (8, 16, 32, 64, 128)
#: Odd multipliers, one for each place of an n-gram.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, each after one space and with spaces for all but letters; where each begins; letters in each."""
    low = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) for t in low), np.int64, len(low))
    points = np.frombuffer((" " + " ".join(low)).encode("utf-32-le"), np.uint32)
    is_letter = letters()[points]
    first = np.cumsum(sizes + 1) - (sizes + 1)  # the space before each text
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one space after a letter
    keep[first] = True
    begins = np.searchsorted(np.flatnonzero(keep), first)
    held = np.concatenate([[0], np.cumsum(is_letter)])
    n_letters = held[first + sizes + 1] - held[first]
    return np.where(is_letter, points, 32)[keep], begins, n_letters


def normal_parts(text: str, size: int = STEP_CHARS) -> Iterator[tuple[np.ndarray, int, int]]:
    """normal() of one text, part by part: (code points, how many of them are this part's own, its letters); the others are the ORDER - 1 before."""
    held, after_letter = np.zeros(0, np.uint32), False
    for begin in range(0, len(text), size):
        points = np.frombuffer(text[begin : begin + size].lower().encode("utf-32-le"), np.uint32)
        is_letter = letters()[points]
        keep = is_letter | np.concatenate([[after_letter], is_letter[:-1]])  # one space after a letter
        after_letter = bool(is_letter[-1])
        own = np.where(is_letter, points, 32)[keep]
        if not begin:
            own = np.concatenate([np.array([32], np.uint32), own])
        held = np.concatenate([held, own])
        yield held, len(own), int(is_letter.sum())
        held = held[max(0, len(held) - ORDER + 1) :]


def distinct_letters(text: str) -> int:
    """Letters in the different words of a text."""
    return sum(len(w) for w in set(re.findall(r"[^\W\d_]+", text.lower())))


def hashes(points: np.ndarray) -> list[np.ndarray]:
    """[n - 1][i]: hash of the n characters that end at i; for i < n - 1 the missing ones count as nothing."""
    total, out = np.zeros(len(points), np.uint64), []
    p = points.astype(np.uint64) + np.uint64(1)
    for n in range(ORDER):
        total = total.copy()
        total[n:] += p[: len(p) - n] * PLACES[n]
        h = total ^ np.uint64((n + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(29)))
    return out


@dataclass
class Sorted:
    """A sorted array of hashes, with the places where each leading bit pattern begins."""

    keys: np.ndarray
    shift: int
    begins: np.ndarray
    reach: int

    @classmethod
    def of(cls, keys: np.ndarray) -> Sorted:
        bits = max(1, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        marks = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        begins = np.searchsorted(keys, marks)
        reach = int(np.diff(np.append(begins, len(keys))).max(initial=0))
        return cls(np.append(keys, np.uint64((1 << 64) - 1)), 64 - bits, begins, reach)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        at = self.begins[(h >> np.uint64(self.shift)).astype(np.intp)]
        here = self.keys[at]
        more = np.flatnonzero(here < h)
        for _ in range(self.reach):
            if not len(more):
                break
            at[more] += 1
            at[more] = np.minimum(at[more], len(self.keys) - 1)
            more = more[self.keys[at[more]] < h[more]]
        return np.where((self.keys[at] == h) & (at < len(self.keys) - 1), at, -1)


@dataclass
class Model:
    langs: list[str]
    grams: list[Sorted]  # by order
    logp: list[np.ndarray]  # by order: n-gram x language
    contexts: list[Sorted]  # by order, of the n - 1 characters before
    backoff: list[np.ndarray]
    unseen: np.ndarray  # log probability of a character that no language has
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    edge: np.ndarray  # what a long text may have above the mean
    warmth: float = 1.0

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language; letters in each text. Texts over STEP_CHARS are read in parts."""
        short = [t if len(t) <= STEP_CHARS else "" for t in texts]
        points, begins, n_letters = normal(short)
        counts = np.diff(np.append(begins, len(points)))
        # Between texts stand characters that no n-gram holds, so that none is read in another's context.
        at = np.arange(len(points)) + (ORDER - 1) * np.repeat(np.arange(1, len(begins) + 1), counts)
        apart = np.full(len(points) + (ORDER - 1) * len(begins), 0x110000, np.uint32)
        apart[at] = points
        out = self.logs(apart)[at]
        sums = np.add.reduceat(out, begins, axis=0, dtype=np.float64) if len(begins) else np.zeros((0, len(self.langs)))
        for i, t in enumerate(texts):
            if len(t) > STEP_CHARS:
                sums[i], counts[i], n_letters[i] = 0.0, 0, 0
                for part, fresh, own in normal_parts(t):
                    sums[i] += self.logs(part)[len(part) - fresh :].sum(axis=0, dtype=np.float64)
                    counts[i] += fresh
                    n_letters[i] += own
        return -sums / np.maximum(counts, 1)[:, None], n_letters

    def logs(self, points: np.ndarray) -> np.ndarray:
        """Log probability of each character, by those before it, in each language."""
        by_order = hashes(points)
        todo = np.arange(len(points))
        out = np.zeros((len(points), len(self.langs)), np.float32)
        for n in range(ORDER, 0, -1):
            at = self.grams[n - 1].find(by_order[n - 1][todo])
            hit = at >= 0
            if n == ORDER:
                out = self.logp[n - 1][np.where(hit, at, 0)]
                out[~hit] = 0
            else:
                out[todo[hit]] += self.logp[n - 1][at[hit]]
            todo = todo[~hit]
            if n > 1 and len(todo):  # those left are looked up by a shorter context
                context = self.contexts[n - 1].find(by_order[n - 2][np.maximum(todo - 1, 0)])
                seen = (context >= 0) & (todo > 0)
                out[todo[seen]] += self.backoff[n - 1][context[seen]]
        out[todo] += self.unseen
        return out

    def rejects(self, entropy: np.ndarray, best: np.ndarray, n: np.ndarray, texts: list[str]) -> np.ndarray:
        low = entropy[np.arange(len(best)), best]
        over, noise = low - self.mean[best], self.noise[best]
        most = np.maximum(np.sqrt((8 * self.spread[best]) ** 2 + noise**2 / np.maximum(n, 1)), self.mean[best])
        out = over > np.minimum(most, np.maximum(self.edge[best], noise / np.sqrt(np.maximum(n, 1))))
        for i in np.flatnonzero(out):
            above, held = 0.0, 0
            for begin in range(0, len(texts[i]), STEP_CHARS // PIECE * PIECE):
                part = texts[i][begin : begin + STEP_CHARS // PIECE * PIECE]
                h, m = self.entropy([part[p : p + PIECE] for p in range(0, len(part), PIECE)])
                above += ((h.min(axis=1) - self.mean[h.argmin(axis=1)]) * m).sum()
                held += m.sum()
            mixed = above / max(held, 1)
            few = noise[i] / np.sqrt(max(distinct_letters(texts[i]), 1))  # repeated words tell no more than one of them
            out[i] = min(over[i], mixed) > min(most[i], max(self.edge[best[i]], few))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, its share of the posterior, cross-entropy, and whether it's rejected."""
        h, n = self.entropy(texts)
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        best = h.argmin(axis=1)
        margin = (h - h.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None] * self.warmth
        share = 1 / np.exp(-margin).sum(axis=1)
        none = n == 0
        rejected = self.rejects(h, best, n, texts) | none
        langs = [UND if x else self.langs[b] for b, x in zip(best, none, strict=True)]
        return langs, np.where(none, 0.0, share), np.where(none, np.nan, h[np.arange(len(best)), best]), rejected


def count(points: np.ndarray) -> list[dict]:
    """By order: sorted n-grams of one language with probability, suffix and context; contexts with back-off weight."""
    by_order = hashes(points)
    raw = [np.unique(h[n:], return_index=True, return_counts=True) for n, h in enumerate(by_order)]
    out: list[dict] = []
    lower = None
    for n in range(1, ORDER + 1):
        keys, first, counts = raw[n - 1]
        place = first + n - 1
        suffix = by_order[n - 2][place] if n > 1 else None
        context = by_order[n - 2][place - 1] if n > 1 else np.zeros(len(keys), np.uint64)
        if n < ORDER:  # how many different characters stand before
            longer, at, _ = raw[n]
            before, times = np.unique(by_order[n - 1][at + n], return_counts=True)
            counts = np.ones(len(keys), np.int64)
            i = np.searchsorted(keys, before)
            counts[i] = np.maximum(times, 1)
        ones, twos = (counts == 1).sum(), (counts == 2).sum()
        discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))
        groups, group = np.unique(context, return_inverse=True)
        total = np.bincount(group, counts)
        left = discount * np.bincount(group) / total
        below = lower[np.searchsorted(out[-1]["keys"], suffix)] if n > 1 else 1.0 / ALPHABET
        lower = (counts - discount) / total[group] + left[group] * below
        out.append({"keys": keys, "p": lower, "suffix": suffix, "context": context, "groups": groups, "left": left})
    return out


def fit(samples: dict[str, list[str]]) -> Model:
    """The model of texts by language; every fifth text is kept for calibration where there are at least ten."""
    langs = sorted(samples)
    spare = {x: samples[x][::5] if len(samples[x]) >= 10 else samples[x] for x in langs}
    learn = {x: [t for i, t in enumerate(samples[x]) if i % 5] if len(samples[x]) >= 10 else samples[x] for x in langs}
    counted = [count(np.append(normal(learn[x])[0], np.full(ORDER, 32))) for x in langs]
    grams, logp, contexts, backoff = [], [], [], []
    for n in range(1, ORDER + 1):
        own = [c[n - 1] for c in counted]
        join = lambda k: np.concatenate([o[k] for o in own]) if own else np.zeros(0, np.uint64)  # noqa: E731,B023
        keys, first = np.unique(join("keys"), return_index=True)
        groups = np.unique(join("groups"))
        left = np.zeros((len(groups), len(langs)), np.float32)
        for k, o in enumerate(own):
            left[np.searchsorted(groups, o["groups"]), k] = np.log(o["left"])
        context = np.searchsorted(groups, join("context")[first]) if len(keys) else np.zeros(0, np.intp)
        if n == 1:
            p = np.full((len(keys), len(langs)), -np.log(ALPHABET)) + (left[context] if len(keys) else 0)
        else:
            p = logp[-1][np.searchsorted(grams[-1], join("suffix")[first])] + left[context] if len(keys) else np.zeros((0, len(langs)))
        p = p.astype(np.float32)
        for k, o in enumerate(own):
            p[np.searchsorted(keys, o["keys"]), k] = np.log(o["p"])
        grams.append(keys)
        logp.append(p)
        contexts.append(groups)
        backoff.append(left)
    unseen = (backoff[0][0] if len(backoff[0]) else 0) - np.float32(np.log(ALPHABET))
    some = lambda x: x if len(x) else np.zeros((1, len(langs)), np.float32)
    model = Model(langs, [Sorted.of(k) for k in grams], [some(x) for x in logp], [Sorted.of(k) for k in contexts], [some(x) for x in backoff], unseen, *np.zeros((4, len(langs))))
    model.mean, model.spread, model.noise = np.zeros(len(langs)), np.zeros(len(langs)), np.zeros(len(langs))
    margins, usual = [], np.zeros(len(langs))
    for k, x in enumerate(langs):
        h, n = model.entropy(spare[x])
        long = n >= 20
        own = h[long, k] if long.any() else h[:, k]
        if len(own):
            model.mean[k], model.spread[k] = own.mean(), own.std()
            middle = np.median(own)
            usual[k] = middle + 10 * 1.4826 * np.median(np.abs(own - middle)) - own.mean()
            model.noise[k] = noise_of(model, [t for t, m in zip(spare[x], n, strict=True) if m >= 20] or spare[x], k)
        margins.append((h, n, k))
    model.edge = np.full(len(langs), np.inf)
    apart = []  # of texts whose language is hidden, cross-entropy over the mean of the language they go to then
    for h, n, k in margins if len(langs) > 1 else ():
        h = np.where(np.arange(len(langs)) == k, np.inf, h[n >= 20])
        apart.extend(h.min(axis=1) / np.maximum(model.mean[h.argmin(axis=1)], 1e-9))
    if apart:
        model.edge = np.maximum(model.mean * (np.median(apart) - 1) / 3, usual)
    loss = lambda w: sum(-np.log(np.maximum(1e-9, np.exp(-(h[:, k] - h.min(1)) * np.sqrt(np.maximum(n, 1)) * w) / np.exp(-(h - h.min(1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None] * w).sum(1))).sum() for h, n, k in margins)
    model.warmth = min((0.25, 0.5, 1.0, 2.0, 4.0), key=loss)
    return model


def noise_of(model: Model, texts: list[str], k: int, far: float = 4.0) -> float:
    """How far over its language's mean a text of n letters may lie, times sqrt(n): of pieces of each band of lengths the median and far robust standard deviations, the largest of the bands'.

    Robust, as some calibration texts hold other languages' passages, which are no noise.
    """
    out = []
    for size in BANDS:
        h, n = model.entropy([t[p : p + size] for t in texts for p in range(0, min(len(t), 40 * size) - size + 1, size)])
        good = n >= size // 2
        if good.sum() >= 20:
            x = (h[good, k] - model.mean[k]) * np.sqrt(n[good])
            out.append(float(np.median(x) + far * 1.4826 * np.median(np.abs(x - np.median(x)))))
    return max(out, default=16.0)


def learn(docs: DataFrame, rows: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_lang: int = 400, max_langs: int = 256, chars_per_lang: int = 4_000_000) -> Model:
    """A model of the rows that have a text and a language (of those, where rows holds).

    The sample is bounded: docs_per_lang rows and about chars_per_lang characters for each language. More
    than max_langs languages are an error, as a model holds every n-gram for every language.
    """
    known = (docs if rows is None else docs.where(rows)).select(docs[key].alias("k"), docs[text].alias("t"), docs[lang].alias("y")).where(F.col("t").isNotNull() & F.col("y").isNotNull() & (F.col("y") != UND))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"over {max_langs} languages to learn")
    samples: dict[str, list[str]] = {}
    for y, t in bounded(known, docs_per_lang, chars_per_lang, counts):
        samples.setdefault(y, []).append(t)
    return fit(samples)


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Row by row: key, lang_pred, score, cross_entropy, rejected. Nothing but the text is an input; other columns aren't read."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # bounded by the fit's sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf.iloc[:, 1]]
            for a, b in steps(texts):
                langs, share, entropy, rejected = held.value.predict(texts[a:b])
                yield pd.DataFrame({key: pdf.iloc[a:b, 0].to_numpy(), "lang_pred": langs, "score": share, "cross_entropy": entropy, "rejected": rejected}, index=None)

    source = docs.select(docs[key], docs[text])
    return source.mapInPandas(run, f"`{key}` {source.schema[0].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text the model doesn't reject."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(col: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else "" for t in col]
        return pd.Series(np.concatenate([~held.value.predict(texts[a:b])[3] for a, b in steps(texts)] or [np.zeros(0, bool)]))

    return docs.where(accepted(docs[text]))


def query(spark, sf_dir):
    """op5: the language of every document; fitted on the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, crc_mod(docs["doc_id"], 4) != 2)
    return identify(docs, model).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
