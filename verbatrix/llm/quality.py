"""Quality rules for documents, with a verdict on each host.

All of it is DataFrame operations.  What a document's words and lines are like
is computed row by row on arrays, without a shuffle; only counts by host and a
narrow table of figures move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, durable

MIN_WORDS = 50
#: A text fails when more than this share of its words, in percent, is in repeated 3-word windows.
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.7
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 1000.0)
#: Rejected hosts are joined by broadcast up to so many bytes, as counted.
BROADCAST_BYTES = 16 << 20
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that are found twice or more in ``words``.

    Windows are hashed; where all hashes differ no window repeats.  Else the
    windows of hashes that repeat, usually few, are sorted by their words, so that
    equal ones are neighbours whatever their hashes have in common.
    """

    def window(ws: Column, i: Column) -> list[Column]:
        return [F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)]

    def neighbours(sorted_: Column, same) -> Column:
        return F.filter(sorted_, lambda x, k: F.coalesce(same(x, F.get(sorted_, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(sorted_, k + 1)), F.lit(False)))

    def repeats(ws: Column, hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = let(by_hash, lambda s: neighbours(s, lambda x, y: x.h == y.h))
        by_words = F.sort_array(F.transform(near, lambda x: F.struct(F.concat_ws(" ", *window(ws, x.i)).alias("w"), x.i.alias("i"))))
        twice = let(by_words, lambda s: neighbours(s, lambda x, y: x.w == y.w))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))

    def of_windows(ws: Column) -> Column:
        hashes = F.transform(F.slice(ws, F.lit(1), F.size(ws) - 2), lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
        return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(repeats(ws, hs)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(of_windows(words)).cast("long")


def text_figures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; all 0 for null or empty text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def figures(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            (F.char_length(whole) - F.char_length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(ws).alias("n_repeat_words"),
        )

    return let(words_of(whole), figures)


def document_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, the five figures, base_failed) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text_figures(F.col(text_col)).alias("f")).select("id", "host", "f.*")
    return rows.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )


def host_verdicts(figures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_ok) for every host that isn't null.

    A host's failure rate is shrunk towards the hosts' mean by a beta prior whose
    mean and weight are fitted to the hosts' rates by moments; the weight stays
    within PRIOR_WEIGHT, and is its upper bound where the rates don't vary.
    """
    hosts = (
        figures.filter(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    )
    rate = F.col("n_failed") / F.col("n_docs")
    mean, spread = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    low, high = PRIOR_WEIGHT
    mean = mean or 0.0
    weight = min(high, max(low, mean * (1 - mean) / spread - 1)) if spread else high
    shrunk = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_ok", F.col("host_rate") <= F.lit(max_rate))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row per input row.

    ``kept`` is false where the document's own figures fail, else the verdict on
    its host; a document without a host is judged by its own figures only.  Rows
    that repeat count each; extra columns aren't read.
    """
    rows = durable(document_figures(docs, id_col, text_col, host_col))
    rejected = durable(host_verdicts(rows).filter(~F.col("host_ok")).select("host", "host_ok"))
    n, names = rejected.agg(F.count("*"), F.sum(F.octet_length("host"))).first()
    if 128 * n + 2 * (names or 0) <= BROADCAST_BYTES:
        rejected = F.broadcast(rejected)
    return rows.join(rejected, "host", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))).alias("kept"),
    )
