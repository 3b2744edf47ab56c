"""Mixing sources to target weights by Pareto order sampling; DataFrame operations only.

A source's target is its share of the mix by weight, at most ``most`` times its size; what a capped
source leaves over is shared again by weight until no target is above its cap. A source takes floor(target / size) whole
copies of every document, and a sample for the rest, of unequal inclusion probabilities: a document's pi is
proportional to its weight (a parameter; by default the logarithm of its size, so that long texts are a little likelier to be
kept whole), with the factor that makes the expected words of the sample the words that are left. Where pi would reach 1 the document is
certain, one whole copy more, and the factor is set for the others. Each other document has a random
number U, fixed by its id, its text and the seed, and the rank (U / (1 - U)) / (pi / (1 - pi)), its random odds
over its inclusion odds; the lowest ranks are taken up to the words that are left.

Nothing that grows with documents or sources reaches the driver. Sources are numbered by a sort over ranges, targets found by
rounds over the table of sources, of which the driver sees sums alone. The factor is found over bins of weight (STEPS to an octave, so a
document may be certain where its pi would be within a hundredth of 1). No source is sorted in one task: ranks fall into COARSE bins of FINE bins
each; words by (source, coarse bin) are summed up where they lie, a running total finds the coarse bin in which the
target lies, the same is done over the fine bins of that one, and only the fine bin found is ordered, by rank,
id and size, rows that are alike in these counting as one row and its number. Plans (a row a source) are broadcast only
where their files are below Spark's own threshold; beyond it they are joined, which splits a hot source.

Size is the number of runs of characters other than ASCII white space; null texts have 0 and are never
drawn. Null sources are a source, last in order. Repeated rows are documents each: of rows alike in id, text and
source as many are drawn as the words that are left allow, and reruns draw as many. A null id is an id. Weights
null or not positive are never drawn beyond the whole copies. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import saved, settled, table, unit_hash

WORDS = r"[^\x20\x09-\x0D]+"
COARSE, FINE, STEPS = 256, 4096, 64
#: Numbers that one array holds where rows are counted out.
STRETCH = 65536
#: Weights count in units of this, so that sums are exact and reruns agree.
UNIT = 1 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """sources with __i, their places in the order of code points, null last; sorted by ranges, not in one task."""
    spread = saved(sources.orderBy(F.col("__s").isNull(), "__s").withColumn("__m", F.monotonically_increasing_id()))
    spread = spread.withColumn("__p", F.shiftright("__m", 33)).withColumn("__m", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row a task of the sort
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.join(parts.select("__p", before.alias("__before")), "__p").withColumn("__i", F.col("__before") + F.col("__m")).drop("__p", "__m", "__before")


def shares(sources: DataFrame, weights: tuple[float, ...], factor: float, most: float) -> DataFrame:
    """sources (__s, __n: size) with __target; weights repeat in the order of code points, null last."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("__i"), F.lit(len(weights))) + 1).cast("int"))
    held = saved(numbered(sources).select("__s", "__n", weight.alias("__w")))
    first = held.agg(F.sum("__n"), F.sum("__w")).first()
    budget, over, capped = factor * (first[0] or 0), first[1] or 0.0, 0
    left = budget
    while True:
        aim = F.lit(left) * F.col("__w") / F.lit(over or 1.0)
        above = (aim > most * F.col("__n")) | F.lit(over == 0)
        now = held.agg(F.count_if(above), F.sum(F.when(above, most * F.col("__n"))), F.sum(F.when(~above, F.col("__w")))).first()
        if now[0] == capped or not now[0]:
            return held.select("__s", "__n", F.when(above, most * F.col("__n")).otherwise(aim).alias("__target"))
        capped, left, over = now[0], budget - (now[1] or 0.0), now[2] or 0.0


def measured(docs: DataFrame, weight: Column | None, seed: int, text: str, source: str, key: str) -> list[Column]:
    """Key, source, size, weight (in UNITs) and random number of each row."""
    size = words(docs[text])
    chosen = F.log1p(size.cast("double")) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
    units = F.greatest(F.round(chosen * UNIT), F.lit(0.0)).cast("long")
    return [docs[key].alias("__k"), docs[source].alias("__s"), size.alias("__size"), units.alias("__w"), unit_hash(docs[key], F.xxhash64(docs[text]), F.lit(seed)).alias("__u")]


def factors(one: DataFrame, weights: tuple[float, ...], factor: float, most: float) -> DataFrame:
    """A row a source: __source, __source_size, __target, __whole copies, __rest (words left after them and the certain), __c and __sure: pi = __c * weight, certain above __sure."""
    octave = F.when((F.col("__w") > 0) & (F.col("__size") > 0), F.floor(F.log2(F.col("__w")) * STEPS))
    product = F.col("__w").cast("decimal(19,0)") * F.col("__size").cast("decimal(19,0)")
    bins = saved(one.groupBy("__s", octave.cast("int").alias("__b")).agg(F.sum("__size").alias("__n"), F.sum(product).cast("double").alias("__wn"), F.max("__w").alias("__top")))
    plan = shares(bins.groupBy("__s").agg(F.sum("__n").alias("__n")), weights, factor, most)
    copies = F.when(F.col("__n") > 0, F.floor(F.col("__target") / F.col("__n"))).otherwise(0).cast("long")
    plan = plan.withColumn("__whole", copies).withColumn("__rest", F.greatest(F.col("__target") - F.col("__whole") * F.col("__n"), F.lit(0.0))).withColumnsRenamed({"__s": "__source", "__n": "__source_size"})
    up = Window.partitionBy("__s").orderBy("__b")  # a row a bin: some hundreds a source
    live = bins.where("__b is not null").join(plan.select("__source", "__rest"), F.equal_null("__s", "__source"))
    live = live.withColumn("__wn", F.sum("__wn").over(up)).withColumn("__above", F.sum("__n").over(Window.partitionBy("__s")) - F.sum("__n").over(up))
    tried = live.withColumn("__c", (F.col("__rest") - F.col("__above")) / F.col("__wn")).where("__c >= 0 and __c * __top <= 1")
    best = tried.groupBy("__s").agg(F.max(F.struct("__b", "__c", "__top", "__above")).alias("__best"))
    out = plan.join(best, F.equal_null("__source", "__s"), "left")
    # Where no bin will do, the words left are more than all that may be drawn: every row of positive weight is certain.
    return saved(out.select("__source", "__source_size", "__target", "__whole", F.coalesce(F.col("__rest") - F.col("__best.__above"), F.lit(0.0)).alias("__rest"), F.coalesce("__best.__c", F.lit(0.0)).alias("__c"), F.coalesce("__best.__top", F.lit(0)).alias("__sure")))


def ranked(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """rows (__k, __s, __size, __w, __u and others) with their source's plan, __pi, rank __q and its bin; both are null where nothing is drawn at random."""
    known = rows.join(plans, F.equal_null("__s", "__source"))
    live = (F.col("__size") > 0) & (F.col("__w") > 0)
    pi = F.when(live & (F.col("__w") > F.col("__sure")), 1.0).when(live, F.col("__c") * F.col("__w")).otherwise(0.0)
    known = known.withColumn("__pi", F.least(pi, F.lit(1.0)))
    q = F.when((F.col("__pi") > 0) & (F.col("__pi") < 1), F.col("__u") / (1 - F.col("__u")) * (1 - F.col("__pi")) / F.col("__pi"))
    return known.withColumn("__q", q).withColumn("__bin", F.floor(F.col("__q") / (1 + F.col("__q")) * (COARSE * FINE)).cast("int"))


def planned(docs: DataFrame, weights: tuple[float, ...], factor: float, most: float, weight: Column | None, seed: int, text: str, source: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows as measured(), one row a source with its plan and the last rank drawn)."""
    one = saved(docs.select(*measured(docs, weight, seed, text, source, key)))
    plan = factors(one, weights, factor, most)
    rows = ranked(one, plan).where("__q is not null")
    coarse = F.floor(F.col("__bin") / FINE).cast("int")
    first = edge_bin(rows.groupBy("__s", coarse.alias("b"), "__rest").agg(F.sum("__size").alias("n")).withColumn("upto", F.lit(0).cast("long")))
    inner = rows.drop("__rest").join(first, F.equal_null("__s", "__e") & (coarse == F.col("__edge"))).groupBy("__s", F.col("__bin").alias("b"), "__rest", F.col("before").alias("upto")).agg(F.sum("__size").alias("n"))
    edge = saved(edge_bin(inner))
    inside = rows.drop("__rest").join(edge, F.equal_null("__s", "__e") & (F.col("__bin") == F.col("__edge"))).groupBy("__e", "__q", "__k", "__size", "__rest", "before").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy("__e").orderBy("__q", "__k", "__size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum(F.col("__size") * F.col("__n")).over(order) - F.col("__size") * F.col("__n")
    # A row is drawn if that brings the total nearer: if half of it is within the words left.
    alike = inside.withColumn("__m", F.least(F.col("__n"), F.floor((F.col("__rest") - start) / F.col("__size") + 0.5))).where("__m > 0")
    last = alike.groupBy("__e").agg(F.max(F.struct("__q", "__k", "__size", "__n", "__m")).alias("__top")).select(F.col("__e").alias("__l"), F.struct(*(F.col("__top")[c].alias(c) for c in ("__q", "__k", "__size"))).alias("__last"), F.col("__top")["__n"].alias("__n"), F.col("__top")["__m"].alias("__m"))
    plans = plan.join(edge.select("__e", "__edge"), F.equal_null("__source", "__e"), "left").join(last, F.equal_null("__source", "__l"), "left").drop("__e", "__l")
    return one, saved(plans.withColumn("__last_k", F.col("__last")["__k"]).withColumn("__last_size", F.col("__last")["__size"]).withColumn("__last_q", F.col("__last")["__q"]))


def edge_bin(bins: DataFrame) -> DataFrame:
    """(__e, __edge, before, __rest) of each source: the bin in which the running total, from upto on, passes __rest. bins: (__s, b, n, __rest, upto)."""
    run = Window.partitionBy("__s").orderBy("b")
    bins = bins.withColumn("before", F.col("upto") + F.sum("n").over(run) - F.col("n"))
    inside = bins.where((F.col("before") <= F.col("__rest")) & (F.col("before") + F.col("n") > F.col("__rest")))
    return inside.groupBy(F.col("__s").alias("__e")).agg(F.min("b").alias("__edge"), F.min_by("before", "b").alias("before"), F.first("__rest").alias("__rest"))  # a row a source


def with_copies(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows as measured(), with their source's plan and __copies; __tied: of the last ones drawn, of which not all are (these have the whole copies alone)."""
    here = F.struct("__q", "__k", "__size")
    out = ranked(rows, plans)
    out = out.withColumn("__tied", F.coalesce(F.equal_null(here, F.col("__last")) & (F.col("__m") < F.col("__n")), F.lit(False)))
    drawn = (F.col("__bin") < F.col("__edge")) | ((F.col("__bin") == F.col("__edge")) & (here <= F.col("__last")))
    takes = (F.col("__pi") >= 1) | (F.coalesce(drawn, F.lit(False)) & ~F.col("__tied"))
    return out.withColumn("__copies", F.col("__whole") + F.when(takes, 1).otherwise(0))


def counted(n: Column) -> Column:
    """0, STRETCH, ... below n: the stretches of a count, which numbers() lists."""
    return F.sequence(F.lit(0).cast("long"), n - 1, F.lit(STRETCH).cast("long"))


def numbers(begin: Column, n: Column) -> Column:
    return F.sequence(begin, F.least(begin + STRETCH, n) - 1)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), factor: float = 1.5, most: float = 2.0, weight: Column | None = None, seed: int = 11, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Row by row: key, size, source, source_size, target, expected (copies, in the mean), copies, taken (copies x size).

    weight: a document's relative inclusion probability in its source (by default the logarithm of 1 + its size).
    """
    one, plans = planned(docs, weights, factor, most, weight, seed, text, source, key)
    # Tied rows are equal in every column here, so they are counted out rather than numbered.
    rows = with_copies(one, plans).withColumn("__expected", F.col("__whole") + F.col("__pi"))
    plain = rows.where(~F.col("__tied"))
    tie = rows.where("__tied").groupBy("__k", "__s", "__size", "__source_size", "__target", "__expected", "__whole", "__m").agg(F.count(F.lit(1)).alias("__n"))
    alike = tie.withColumn("__i", F.explode(counted(F.col("__n")))).withColumn("__i", F.explode(numbers(F.col("__i"), F.col("__n"))))
    alike = alike.withColumn("__copies", F.col("__whole") + (F.col("__i") < F.col("__m")).cast("long"))
    columns = ["__k", "__size", "__s", "__source_size", "__target", "__expected", "__copies"]
    names = [key, "size", "source", "source_size", "target", "expected", "copies"]
    every = plain.select(*columns).union(alike.select(*columns))
    return every.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), (F.col("__copies") * F.col("__size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), factor: float = 1.5, most: float = 2.0, weight: Column | None = None, seed: int = 11, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of the mix, all columns as they are, each as often as it is taken. Texts are shuffled only where plans are too many to broadcast."""
    _, plans = planned(docs, weights, factor, most, weight, seed, text, source, key)
    known = with_copies(docs.select(F.struct("*").alias("__row"), *measured(docs, weight, seed, text, source, key)), plans)
    out = known.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int")))).select("__row.*")
    if plans.where("__m < __n").isEmpty():
        return out
    # Of tied rows, those of lowest hash of the whole row; equal rows are one row and its count.
    alike = known.where("__tied").withColumn("__hash", F.xxhash64(F.to_json("__row", {"ignoreNullFields": "false"})))
    groups = alike.groupBy("__s", "__hash").agg(F.count(F.lit(1)).alias("__held"), F.first("__m").alias("__m"))
    before = F.sum("__held").over(Window.partitionBy("__s").orderBy("__hash")) - F.col("__held")
    takes = groups.withColumn("__take", F.least("__held", F.col("__m") - before)).where("__take > 0").withColumn("__i", F.explode(counted(F.col("__take"))))
    takes = saved(takes.select(F.col("__s").alias("__ts"), F.col("__hash").alias("__th"), F.least(F.col("__take") - F.col("__i"), F.lit(STRETCH)).cast("int").alias("__times")))
    chosen = alike.groupBy("__s", "__hash").agg(F.first("__row").alias("__row")).join(takes, F.equal_null("__s", "__ts") & (F.col("__hash") == F.col("__th")))
    again = chosen.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times"))))
    return out.unionByName(again.select("__row.*"))


def query(spark, sf_dir):
    """op9: every document with the words the mix takes of it."""
    return settled(spark, lambda _: mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "expected"))
