"""Near duplicates: BagMinHash signatures, bands, exact verification of multiset overlap.

A text is its multiset of five-word shingles (lower-case runs of word characters; a shorter text is one shingle).
Texts of the same words are one node. Two nodes are linked if their weighted Jaccard similarity is at
least 0.8; a class is what links connect. A text without words is linked to equal raw texts only; null
texts, and rows without an id, are alone (the latter with a null class). A class's id is its smallest doc_id. Rows that repeat an id
are one document, in one class. Other columns than the text and the id aren't read, whatever their names. An empty table gives no row.

Signature. A shingle's weight, its count, is discretised in levels 1, 2, 3, ...; each level is a Poisson
process of rate 1 whose points fall on signature slots at random, and a slot keeps its earliest point.
The levels' processes are hierarchical: (0, 1], (1, 2], (2, 4], (4, 8], ... each have one, of rate its
length, and each point its level, so that a heavy shingle needs no process per level; points come in
ascending order and stop at the slots' latest. Equal slots are an unbiased estimate of the similarity.

Candidates. 24 bands of 4 slots: a pair at similarity 0.8 shares none with probability 3e-6. No group's
pairs are listed. 1: in each bucket every node is checked against one pivot, the same for all buckets
where possible; links join components. 2: in a bucket that still holds several components, every node
outside its largest is compared, exactly, with all the bucket's nodes of other components, through an inverted
index of their shingles in cells of bounded size, and one link is returned for each two components that have
any. So no link between components is lost to the pivots, a bucket that is one component costs
nothing more, and what is returned is linear in nodes. Buckets are never capped. A bucket of n nodes, CELL at most of
them outside its largest component, is n / CELL cells. 3: nodes of a bucket with more outside it are dealt anew, by their
rarest elements: of two texts at the threshold each has the other's fifth of elements, in any one order of all elements, that
comes first in part, so those who share none of these can't be linked. Rare elements come first, those of one node only
aren't dealt, and what many texts have in common (a passage, a template) thus brings nodes together only if little else is
in them. The nodes of an element go through step 2's cells; n nodes whose rarest elements are the same, in as many
components, are still n^2 / CELL^2 cells.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import saved, settled, ship, table

WORD = re.compile(r"\w+")
SHINGLE, SIMILAR = 5, 0.8
SLOTS, PER_BAND = 96, 4
BANDS = SLOTS // PER_BAND
CELL = 1024
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


@functools.cache
def word_hash() -> WordHash:
    return WordHash()


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the five-word shingles, with repetition."""
    h = np.fromiter(map(word_hash().__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(h))):
        out = mixed(out + h[i : i + n] + A)
    return out


def signatures(bags: list[np.ndarray]) -> np.ndarray:
    """BagMinHash signatures, a row of SLOTS for each multiset of hashes."""
    sizes = np.fromiter((len(b) for b in bags), np.int64, len(bags))
    doc = np.repeat(np.arange(len(bags)), sizes)
    h = np.concatenate(bags) if len(bags) else np.zeros(0, np.uint64)
    _, first, weight = np.unique(mixed(doc.astype(np.uint64) * A) ^ h, return_index=True, return_counts=True)
    doc, h = doc[first], h[first]
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)  # how many of the intervals a weight reaches into
    at = np.repeat(np.arange(len(h)), levels)
    interval = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
    doc, weight = doc[at], weight[at]
    seed = mixed(h[at] + interval.astype(np.uint64) * C + A)
    length = np.where(interval < 2, 1, 1 << np.maximum(interval - 1, 0)).astype(float)
    low = np.where(interval == 0, 0, 1 << np.maximum(interval - 1, 0))
    x = np.zeros(len(at))
    slots = np.full(len(bags) * SLOTS, np.inf)
    latest = np.full(len(bags), np.inf)
    step = 0
    while len(doc):
        u = mixed(seed + np.uint64((2 * step + 1) * int(A) & MASK))
        v = mixed(seed + np.uint64((2 * step + 2) * int(A) & MASK))
        x = x - np.log((((u >> np.uint64(11)).astype(float)) + 0.5) / 2.0**53) / length
        slot = doc * SLOTS + ((v >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64)
        level = low + np.floor((v & np.uint64(0xFFFFFFFF)).astype(float) / 2.0**32 * length)
        counts = (level < weight) & (x < latest[doc])
        np.minimum.at(slots, slot[counts], x[counts])
        step += 1
        if step < 8 or step % 8 == 0:
            latest = slots.reshape(-1, SLOTS).max(axis=1)
        go = x < latest[doc]
        doc, weight, seed, length, low, x = doc[go], weight[go], seed[go], length[go], low[go], x[go]
    bits = slots.astype(np.float32).view(np.uint32).astype(np.uint64)
    return (mixed(bits + A) >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(-1, SLOTS)


def elements(h: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: a hash's second, third, ... occurrence are elements of their own."""
    h = np.sort(h)
    again = np.arange(len(h)) - np.searchsorted(h, h)
    return np.sort(mixed(h + again.astype(np.uint64) * C))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets, given as elements."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 0.0


def sketched(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, node (digest of the words), n (shingles), sig; null texts are left out."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            ids, texts = pdf.iloc[:, 0].tolist(), pdf.iloc[:, 1].tolist()
            begin = 0
            while begin < len(texts):
                nodes, counts, bags, held = [], [], [], 0
                end = begin
                while end < len(texts) and (held < 200_000 or end == begin):
                    words = WORD.findall(texts[end].lower())
                    nodes.append(xxhash.xxh3_128_digest(" ".join(words) if words else "\0" + texts[end]))
                    s = shingles(words)
                    counts.append(len(s))
                    bags.append(s if len(words) >= SHINGLE else s[:0])
                    held += len(s) + 50
                    end += 1
                full = [i for i, b in enumerate(bags) if len(b)]
                sig: list = [None] * len(bags)
                for i, row in zip(full, signatures([bags[i] for i in full]), strict=True):
                    sig[i] = row
                yield pd.DataFrame({"doc_id": ids[begin:end], "node": nodes, "n": counts, "sig": sig})
                begin = end

    source = docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return source.mapInPandas(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, node binary, n int, sig array<int>")


def verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose similarity is at least SIMILAR. bags: (node, bag)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            same = [similarity(s, t) >= SIMILAR for s, t in zip(pdf.s, pdf.t, strict=True)]
            yield pdf.loc[np.array(same, bool), ["a", "b"]]

    left = bags.select(F.col("node").alias("a"), F.col("bag").alias("s"))
    right = bags.select(F.col("node").alias("b"), F.col("bag").alias("t"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node that has a link; comp is the component's smallest node.

    Each round every component takes the smallest label among itself and its neighbours, labels are
    followed twice, and links are contracted; what is left shrinks until no link crosses components.
    """
    both = links.select(F.col("a"), F.col("b")).unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = saved(both)
    label = both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node"))
    while not both.isEmpty():
        to = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        to = saved(to)
        for _ in range(2):
            to = to.join(to.select(F.col("a").alias("m"), F.col("m").alias("mm")), "m", "left").select("a", F.coalesce("mm", "m").alias("m"))
        to = saved(to)
        label = saved(label.join(to.withColumnRenamed("a", "comp"), "comp", "left").select("node", F.coalesce("m", "comp").alias("comp")))
        both = both.join(to, "a").select(F.col("m").alias("x"), "b").join(to.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        both = saved(both.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return label


def linked(bags: list[np.ndarray], comp: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Links between components (by number) that some pair (x, y) of similarity SIMILAR, x of asks, gives; each joins two that weren't yet."""
    sizes = np.array([len(x) for x in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    every = np.concatenate(bags)
    order = np.argsort(every, kind="stable")
    owner = owner[order]
    words, begins, df = np.unique(every[order], return_index=True, return_counts=True)
    root = np.arange(comp.max() + 1)
    out = []
    for x in asks:
        at = np.searchsorted(words, bags[x])
        a, n = begins[at], df[at]
        into = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[into], minlength=len(bags))
        for y in np.flatnonzero((both >= SIMILAR * (sizes[x] + sizes - both)) & (root[comp] != root[comp[x]])):
            if root[comp[y]] != root[comp[x]]:
                out.append((int(x), int(y)))
                root[root == root[comp[y]]] = root[comp[x]]
    return out


def opened(members: DataFrame, comps: DataFrame) -> DataFrame:
    """h, node, comp, asks, all, rest of the buckets (h, node) of several components: asks is true outside the largest; the cells of all nodes, and of those that ask."""
    known = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = known.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"))
    open_ = sizes.groupBy("h").agg(F.sum("c").alias("size"), F.max("c").alias("big"), F.max_by("comp", F.struct("c", "comp")).alias("core"), F.bit_xor("x").alias("x"), F.count(F.lit(1)).alias("k")).where("k > 1")
    open_ = open_.groupBy("size", "x", "core", "big").agg(F.min("h").alias("h"))  # buckets of the same nodes count once
    part = lambda n: F.ceil(n / CELL).cast("int")
    mine = known.join(open_.select("h", "core", part(F.col("size")).alias("all"), part(F.col("size") - F.col("big")).alias("rest")), "h")
    return mine.select("h", "node", "comp", (F.col("comp") != F.col("core")).alias("asks"), "all", "rest")


def rarest(nodes: DataFrame, bags: DataFrame) -> DataFrame:
    """(h, node): the elements by which a node can meet one of similarity SIMILAR among nodes (distinct), as buckets.

    Elements are ordered by the nodes that hold them. A node of s elements shares 4 s / 5 with such a one at least, so one of the
    s - ceil(4 s / 5) + 1 that come first, for both. Those of one node come before all others and are counted, not returned.
    """
    held = nodes.join(bags, "node").select("node", F.size("bag").alias("s"), F.explode("bag").alias("e"))
    often = held.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = held.join(often, "e").groupBy("node").agg(F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    first = F.col("s") - F.expr("(4 * s + 4) div 5") + 1 - (F.col("s") - F.size("es"))
    return common.select("node", F.explode(F.slice("es", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("k")).select(F.xxhash64(F.lit("e"), "k.e").alias("h"), "node")


def across(members: DataFrame, bags: DataFrame, comps: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of different components of a bucket, one at least for each two components that have any."""
    mine = saved(opened(members, comps))
    wide = mine.where("rest > 1").select("node").distinct()
    if not wide.isEmpty():
        mine = saved(mine.where("rest = 1").unionByName(opened(rarest(wide, bags), comps)))
    every = mine.select("h", "node", "comp", "asks", F.lit(False).alias("only"), F.pmod(F.xxhash64("node"), F.col("all")).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("rest") - 1)).alias("i"))
    asking = mine.where("asks and all * rest > 1").select("h", "node", "comp", "asks", F.lit(True).alias("only"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("rest")).cast("int").alias("i"))
    cells = every.unionByName(asking).join(bags, "node")

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["only", "node"], kind="stable").reset_index(drop=True)
        asks = np.flatnonzero(pdf.only if pdf.only.any() else pdf.asks)
        links = linked([np.asarray(b) for b in pdf.bag], pd.factorize(pdf.comp)[0], asks) if len(asks) else []
        node = pdf.node.to_numpy()
        return pd.DataFrame({"a": [node[x] for x, _ in links], "b": [node[y] for _, y in links]})

    found = cells.groupBy("h", "i", "j").applyInPandas(cell, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, class_id, n_rows: one row for each doc_id, with its class and how many rows repeat the id.

    If an id repeats with different texts, its rows' classes are one. Other columns of docs aren't read.
    """
    sketch = saved(sketched(docs, text, key))
    nodes = sketch.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    first = sketch.join(nodes.select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"]).where(F.col("sig").isNotNull()).select("node", "doc_id", "n", "sig").dropDuplicates(["node"])
    sigs = saved(first)
    bands = sigs.select("node", "n", F.posexplode(F.array(*(F.xxhash64(F.lit(i), F.slice("sig", i * PER_BAND + 1, PER_BAND)) for i in range(BANDS)))).alias("band", "h")).drop("band")
    pivots = bands.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("node", "n")).alias("pivot")).where("size > 1")
    members = saved(bands.join(pivots, "h").select("h", "node", "n", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("m")))
    asked = members.select("node").distinct().join(sigs.select("node", "doc_id"), "node")
    raw = docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).where(F.col("text").isNotNull())
    bags = saved(bagged(asked.join(raw, "doc_id")))
    pairs = members.where((F.col("node") != F.col("pivot")) & (F.least("n", "m") >= SIMILAR * F.greatest("n", "m"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = saved(verified(pairs, bags))
    comps = components(links)
    more = saved(across(members.select("h", "node"), bags, comps))
    if not more.isEmpty():
        comps = components(links.unionByName(more))
    # An id that repeats with different texts ties its nodes together.
    rows = sketch.select("doc_id", "node").join(comps, "node", "left").select("doc_id", F.coalesce("comp", "node").alias("comp"))
    per_id = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("comp").alias("comp"), F.max("comp").alias("other"))
    per_id = saved(per_id)
    ties = per_id.where("comp <> other").select(F.col("comp").alias("a"), F.col("other").alias("b"))
    if not ties.isEmpty():
        pairs = rows.join(per_id.where("comp <> other").select("doc_id", F.col("comp").alias("to")), "doc_id").select(F.col("to").alias("a"), F.col("comp").alias("b"))
        tied = components(pairs).withColumnRenamed("comp", "tied")
        per_id = per_id.join(tied.withColumnRenamed("node", "comp"), "comp", "left").withColumn("comp", F.coalesce("tied", "comp"))
    classes = saved(per_id.groupBy("comp").agg(F.min("doc_id").alias("class_id")))  # written, so that a large class's rows can be split in the join
    done = per_id.join(classes, "comp").select("doc_id", "class_id", "n_rows")
    alone = docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    alone = alone.join(done.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("class_id"), "n_rows")
    nameless = docs.where(docs[key].isNull()).select(docs[key].alias("doc_id"), docs[key].alias("class_id"), F.lit(1).cast("long").alias("n_rows"))
    return done.unionByName(alone).unionByName(nameless)


def bagged(rows: DataFrame) -> DataFrame:
    """(node, bag) of the rows (node, text) whose text is the node's (an id may repeat with another)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for pdf in batches:
            nodes, bags = [], []
            for node, text in zip(pdf.node, pdf.text, strict=True):
                words = WORD.findall(text.lower())
                if xxhash.xxh3_128_digest(" ".join(words)) == node:
                    nodes.append(node)
                    bags.append(elements(shingles(words)).view(np.int64))
            yield pd.DataFrame({"node": nodes, "bag": bags})

    return rows.select("node", "text").mapInPandas(run, "node binary, bag array<bigint>").dropDuplicates(["node"])


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows, all columns as they are, of each class's smallest id, once; rows without an id stay. Of rows that repeat the id, that of smallest hash, so reruns agree."""
    classes = near_duplicates(docs, text, key)
    first = classes.where("doc_id = class_id").select(F.col("doc_id").alias("__id"), F.col("n_rows").alias("__n"))
    rows = docs.select(F.struct("*").alias("__row"), docs[key].alias("__key"))  # names in docs can't clash
    kept = rows.join(first, F.col("__key") == F.col("__id"))
    one = F.min_by("__row", F.xxhash64(F.to_json("__row", {"ignoreNullFields": "false"})))
    again = kept.where("__n > 1").groupBy("__id").agg(one.alias("__row"))  # rows are combined where they lie
    out = kept.where("__n = 1").select("__row").unionByName(again.select("__row"))
    return out.unionByName(rows.where("__key is null").select("__row")).select("__row.*")


def query(spark, sf_dir):
    """op3: the near-duplicate class of every document."""
    return settled(spark, lambda _: near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id"))
