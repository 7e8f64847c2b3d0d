"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash.  A source's words are summed by hash bucket; the
bucket in which the running sum crosses the source's budget is the boundary, and
only that bucket is cut into finer ones, until one hash value is left.  What the
document there is too long for is a smaller budget, whose threshold is found in
the same way above the first one, among documents no longer than it; and so on
until no document fits.  What the mix takes is then a filter on the hash and the
size: no document is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_name, durable

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Bits of the hash that one level of the histogram tells apart.
LEVEL_BITS = 15
#: Plans of sources up to so many bytes (names and numbers, as counted) are joined by broadcast.
BROADCAST_BYTES = 16 << 20


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def mix_hash(id_col: str, text_col: str) -> Column:
    """The hash that decides about a document: of its identifier and text, so rows without an identifier differ too."""
    return F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text_col))


def _hinted(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def ranked(sources: DataFrame) -> tuple[DataFrame, int]:
    """``sources`` with ``place``, each one's position from 0 in order of code point, null last; and how many there are.

    Range-partitioned, numbered in each partition, and shifted by the number of
    rows in the partitions before, of which the driver learns only the counts.
    """
    parts = durable(
        sources.repartitionByRange(F.col("source").isNull(), F.col("source"))
        .withColumn("part", F.spark_partition_id())
        .withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())))
    )
    sizes = sorted((r.part, r["count"]) for r in parts.groupBy("part").count().collect())
    before, shift = 0, F
    for part, n in sizes:
        shift = shift.when(F.col("part") == part, F.lit(before))
        before += n
    place = F.col("within") - 1 + (shift if sizes else F.lit(0))
    return parts.withColumn("place", place).drop("part", "within"), before


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> tuple[DataFrame, bool]:
    """(source, source_size, target) from (source, source_size), and whether all of them may be broadcast.

    Weights repeat over the sources in order.  All sizes are shared by weight; a
    target stops at ``most`` times its source's size and its excess is shared
    among the others again, until none is above.  Each round is one sum.
    """
    rows, n = ranked(sources)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = durable(rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most))
    total, share, names = rows.agg(F.sum("source_size"), F.sum("weight"), F.sum(F.octet_length("source"))).first()
    total, share = total or 0, share or 1
    left = total
    while True:
        free = F.col("cap").cast("double") * share >= F.col("weight").cast("double") * left
        capped, open_weight = rows.agg(F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight")))).first()
        now = (total - (capped or 0), open_weight or 0)
        if now == (left, share) or not now[1]:
            break
        left, share = now
    fair = F.col("weight").cast("double") * left / share
    target = F.when(F.col("cap").cast("double") * share >= F.col("weight").cast("double") * left, fair).otherwise(F.col("cap").cast("double"))
    return rows.select("source", "source_size", target.alias("target")), 128 * n + 2 * (names or 0) <= BROADCAST_BYTES


def thresholds(sizes: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """(source, threshold, left): the hash at which the running sum of a source's sizes exceeds its budget.

    ``sizes`` has (source, h, size), ``budgets`` (source, budget, above, longest):
    only documents of a hash over ``above`` and a size up to ``longest`` count.
    Goes down the histogram one level at a time; at the end the boundary is one
    hash, whose documents aren't taken, and ``left`` what is then left of the
    budget.  ``threshold`` is null where all documents that count fit in.
    """
    state = budgets.select(F.col("source").alias("s"), F.col("budget").alias("left"), "above", "longest", F.lit(0).cast("long").alias("prefix"))
    ends = None
    for used in range(0, 60, LEVEL_BITS):
        bucket = F.shiftright("h", 60 - used - LEVEL_BITS)
        here = sizes.join(_hinted(state, small), F.col("source").eqNullSafe(F.col("s"))).filter((F.col("h") > F.col("above")) & (F.col("size") <= F.col("longest")) & (F.col("size") > 0))
        if used:
            here = here.filter(F.shiftright("h", 60 - used) == F.col("prefix"))
        sums = here.groupBy("source", "left", "above", "longest", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))
        run = Window.partitionBy("source").orderBy("bucket")
        upto = F.sum("words").over(run.rowsBetween(Window.unboundedPreceding, 0))
        found = durable(
            sums.withColumn("upto", upto)
            .groupBy("source", "above", "longest")
            .agg(
                F.min(F.when(F.col("upto") > F.col("left"), F.struct(F.col("bucket").alias("prefix"), (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"), "low", "high"))).alias("b"),
                F.min(F.col("left") - F.col("upto")).alias("rest"),
            )
            .select("source", "above", "longest", "b.*", F.coalesce("b.left", "rest").alias("now"))
        )
        done = found.filter(F.col("low").isNull() | (F.col("low") == F.col("high"))).select("source", F.col("low").alias("threshold"), F.col("now").alias("left"))
        ends = done if ends is None else ends.unionAll(done)
        open_ = found.filter(F.col("low") < F.col("high"))
        if used + LEVEL_BITS >= 60 or not open_.limit(1).count():
            break
        state = open_.select(F.col("source").alias("s"), "left", "above", "longest", "prefix")
    return ends


def cuts(sizes: DataFrame, budgets: DataFrame, small: bool) -> DataFrame:
    """(source, cuts): for every source its nested thresholds as structs (above, below, longest).

    A document is taken once more if its hash is over ``above`` and under ``below``,
    and its size at most ``longest``, of one of them.  Each next budget is what the
    last one left; ends where nothing is left or no longer document fits.
    """
    start = budgets.filter("budget > 0").select("source", F.col("budget").cast("double").alias("budget"), F.lit(-1).cast("long").alias("above"), F.lit((1 << 62) - 1).cast("long").alias("longest"))
    found = None
    while True:
        step = thresholds(sizes, start, small)
        last = start.select(F.col("source").alias("s"), "above", "longest")
        made = durable(
            step.join(_hinted(last, small), F.col("source").eqNullSafe(F.col("s"))).select(
                "source", "left", "threshold", F.struct("above", F.coalesce("threshold", F.lit((1 << 62) - 1)).alias("below"), "longest").alias("cut")
            )
        )
        found = made if found is None else found.unionAll(made)
        start = made.filter(F.col("threshold").isNotNull() & (F.col("left") >= 1)).select("source", F.col("left").alias("budget"), F.col("threshold").alias("above"), F.floor("left").alias("longest"))
        if not start.limit(1).count():
            break
    # as many rows for a source as it has nested budgets, a few tens at most: each is under the size of one document
    return found.groupBy("source").agg(F.collect_list("cut").alias("cuts"))


def _document_hash(id_col: str, text_col: str) -> Column:
    return F.shiftrightunsigned(mix_hash(id_col, text_col), 4)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, bool]:
    """(documents, sources, whether sources may be broadcast).

    Documents are (id, source, size, h); sources are (plan_source, source_size,
    target, times, cuts): every document of a source is taken ``times``, and once
    more if one of the cuts has it.
    """
    kept = durable(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            _document_hash(id_col, text_col).alias("h"),
        )
    )
    goals, small = targets(kept.groupBy("source").agg(F.sum("size").alias("source_size")))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goals = durable(goals.withColumn("times", times.cast("int")).withColumn("budget", F.col("target") - F.col("times") * F.col("source_size")))
    cut = durable(cuts(kept, goals.select("source", "budget"), small).withColumnRenamed("source", "cut_source"))
    sources = durable(goals.join(_hinted(cut, small), F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source", "budget"))
    return kept, sources.withColumnRenamed("source", "plan_source"), small


def repeats(h: Column, size: Column, times: Column, cuts: Column) -> Column:
    """How often the mix takes a document, by the plan of its source."""
    once_more = F.exists(cuts, lambda c: (h > c.above) & (h < c.below) & (size <= c.longest))
    return times + F.coalesce(once_more, F.lit(False)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, size, source_size, target, taken) for every row.

    ``size`` is the number of words, ``target`` that of the source and ``taken``
    the words that the mix takes of the document: whole repeats of it, at most
    MAX_REPEATS.  A source below its target gives all documents as often as they
    fit and some once more; one above it gives some documents once.  Which
    documents are taken depends on their hashes and sizes alone, so reruns agree,
    and rows that repeat exactly share their fate.  Null texts have size 0; null is
    a source of its own; an empty table gives an empty one.
    """
    kept, sources, small = plan(docs, id_col, text_col, source_col)
    return kept.join(_hinted(sources, small), F.col("source").eqNullSafe(F.col("plan_source"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * repeats(F.col("h"), F.col("size"), F.col("times"), F.col("cuts"))).alias("taken")
    )


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as it takes them, with all their columns and no shuffle of texts.

    (Sources whose plans are over BROADCAST_BYTES are joined by a shuffle.)
    """
    _, sources, small = plan(docs, id_col, text_col, source_col)
    name, key = distinct_name(docs.columns, "plan_source"), distinct_name(docs.columns, "mix_copies")
    packed = sources.select(F.col("plan_source").alias(name), F.struct("times", "cuts").alias(key))
    joined = docs.join(_hinted(packed, small), docs[source_col].eqNullSafe(F.col(name)))
    p = F.col(key)
    copies = F.array_repeat(F.lit(1), repeats(_document_hash(id_col, text_col), word_count(F.col(text_col)), p.times, p.cuts))
    out = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*out, F.explode(copies).alias(key)).select(*out)
