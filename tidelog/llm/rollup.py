"""Token counts kept up to date by deltas.

A change is an insert, a delete, or a revision: a row with the document's group (source, language,
tokenizer version), a sign and its counts. A revision is a delete of the old counts and an insert of the
new. A batch of changes is summed by group where it lies and written as one small delta; totals are the
sums of deltas in force, so nothing is recounted.

A batch is in force once its marker is: a file of the batch's id, written elsewhere and renamed, that
names its delta and the ids which that delta stands for. So a batch that is replayed or retried changes
nothing, and one lost before the rename leaves nothing that counts. compact() writes one delta in place of those
it has listed, whose marker names all of their ids: one rename puts it in force and them out of force,
and a batch committed meanwhile isn't among them. A compaction's id is a batch id like another: a retry finds
it in force and only deletes what it stands for. Each read takes one listing of the markers.

Where a file system's rename refuses a name that is there (HDFS does), writers may compete; elsewhere a store has one writer.

Groups may have null keys. Null texts have 0 tokens but count as documents; so do empty ones. Repeated
rows are counted as often as they stand there. An empty batch is committed and changes nothing. Columns other
than text, source and lang aren't read, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.bpe import merged
from tidelog.llm.common import hadoop, remove, settled, shared_dir, ship, table

GROUP = ["source", "lang", "tokenizer"]
TOTALS = ["n_docs", "n_tokens", "n_chars"]
DELTA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"


class Rollup:
    """Deltas and their markers under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _markers(self) -> dict[str, dict]:
        """Batch id -> {"delta": its folder, "covers": the ids it stands for, its own too}; one listing."""
        fs, folder = hadoop(self.spark, f"{self.path}/markers")
        if not fs.exists(folder):
            return {}
        out = {}
        for s in fs.listStatus(folder):
            stream = fs.open(s.getPath())
            try:
                out[s.getPath().getName()] = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        return out

    def _mark(self, batch: str, delta: str, covers: list[str]) -> bool:
        """Puts a delta in force; False if the batch's marker is there."""
        fs, tried = hadoop(self.spark, f"{self.path}/tried/{uuid.uuid4().hex}")
        stream = fs.create(tried, False)
        try:
            stream.write(json.dumps({"delta": delta, "covers": covers}).encode())
        finally:
            stream.close()
        _, folder = hadoop(self.spark, f"{self.path}/markers")
        fs.mkdirs(folder)
        _, goal = hadoop(self.spark, f"{self.path}/markers/{batch}")
        done = not fs.exists(goal) and bool(fs.rename(tried, goal))
        if not done:
            fs.delete(tried, False)
            remove(self.spark, f"{self.path}/deltas/{delta}")
        return done

    @staticmethod
    def _in_force(markers: dict[str, dict]) -> list[str]:
        gone = {c for batch, m in markers.items() for c in m["covers"] if c != batch}
        return sorted(set(markers) - gone)

    def committed(self) -> list[str]:
        """The deltas in force; one that is folded into another no longer is, even before it is deleted."""
        return self._in_force(self._markers())

    def covered(self) -> set[str]:
        """Ids of the batches in force, those folded into others too."""
        return {c for m in self._markers().values() for c in m["covers"]}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch of (source, lang, tokenizer, sign, n_tokens, n_chars); False if it was applied before."""
        if batch in self.covered():
            return False
        sums = changes.groupBy(*GROUP).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"), F.sum(F.col("sign") * F.col("n_chars")).alias("n_chars"))
        delta = uuid.uuid4().hex
        sums.select(*(F.col(c).cast("string").alias(c) for c in GROUP), *(F.col(c).cast("long") for c in TOTALS)).write.parquet(f"{self.path}/deltas/{delta}")
        return self._mark(batch, delta, [batch])

    def compact(self, batch: str) -> bool:
        """One delta in place of all that are in force now; False if the id was used before (what it stands for is deleted, if it still is there)."""
        markers = self._markers()
        covered = {c for m in markers.values() for c in m["covers"]}
        if batch in covered:
            self._sweep(markers)
            return False
        delta = uuid.uuid4().hex
        self._sums(markers).write.parquet(f"{self.path}/deltas/{delta}")
        done = self._mark(batch, delta, sorted(covered | {batch}))
        if done:
            self._sweep(self._markers())
        return done

    def _sweep(self, markers: dict[str, dict]) -> None:
        """Deletes what is out of force: markers first, so that no marker ever names a delta that is gone."""
        for batch in set(markers) - set(self._in_force(markers)):
            remove(self.spark, f"{self.path}/markers/{batch}")
            remove(self.spark, f"{self.path}/deltas/{markers[batch]['delta']}")

    def _sums(self, markers: dict[str, dict]) -> DataFrame:
        names = self._in_force(markers)
        if not names:
            return self.spark.createDataFrame([], DELTA)
        deltas = self.spark.read.schema(DELTA).parquet(*(f"{self.path}/deltas/{markers[n]['delta']}" for n in names))
        sums = deltas.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in TOTALS))
        return sums.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0) | (F.col("n_chars") != 0))

    def totals(self) -> DataFrame:
        """Totals by group; groups of which nothing is left are gone."""
        return self._sums(self._markers())


def counts(docs: DataFrame, tokenizer: str, count: Callable[[Column], Column], sign: int = 1, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """Changes: of each row its group, sign and counts."""
    return docs.select(docs[source].alias("source"), docs[lang].alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("sign"), F.coalesce(count(docs[text]), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.length(docs[text]), F.lit(0)).cast("long").alias("n_chars"))


def bpe_counter(spark: SparkSession, path: str, pattern: str) -> Callable[[Column], Column]:
    """Counts the ids of a rank file (path: readable by every executor)."""
    ship(spark)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {t: i for i, t in enumerate(merged(path).tokens) if t}
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(coder.encode_ordinary(t)) if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return count


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def query(spark, sf_dir):
    """op6: totals of all documents after four batches, one of them replayed.

    1: all documents are inserted as words-1. 2: those of even id are deleted from it and counted anew,
    by byte-level BPE. 3: documents without a letter n in their language's name are revised: their
    words-1 counts go, counts by runs of letters (words-2) come. 4: batch 2 again, which changes nothing.
    Then all are compacted, and the compaction is retried.
    """
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    bpe = bpe_counter(spark, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    even = docs.where(F.col("doc_id") % 2 == 0)
    moved = docs.where((F.col("doc_id") % 2 != 0) & ~F.contains("lang", F.lit("n")))
    letters = lambda t: F.regexp_count(t, F.lit(r"[A-Za-z]+"))
    path = f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}"
    rollup = Rollup(spark, path)
    second = counts(even, "words-1", word_count, -1).unionByName(counts(even, "byte_bpe_50k", bpe))
    rollup.commit("1-insert", counts(docs, "words-1", word_count))
    rollup.commit("2-recount", second)
    rollup.commit("3-revise", counts(moved, "words-1", word_count, -1).unionByName(counts(moved, "words-2", letters)))
    rollup.commit("2-recount", second)
    rollup.compact("all")
    rollup.compact("all")
    try:
        return settled(spark, lambda _: rollup.totals())
    finally:
        remove(spark, path)
