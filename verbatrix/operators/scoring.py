"""Scores of pages and of sentences against a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as c
from ..functions import text as t
from ..storage import durable


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, size: Column, mean: Column) -> Column:
    return tf * (c.K1 + 1) / (tf + c.K1 * (1 - c.B + c.B * size / mean))


def _page_idf() -> Column:
    return idf(F.lit(float(c.PAGE_DOCS)), F.lit(float(c.PAGE_DF)))


def _of_query(query: Column) -> Column:
    """A query's tokens as a struct: distinct terms, how often each stem and each pair of neighbours is there, and a pattern for words of its stems."""
    words = t.stems(query)
    return F.struct(
        F.array_distinct(query).alias("terms"), t.tally(words).alias("roots"), t.tally(t.bigrams(query)).alias("pairs"), t.beginning(F.array_distinct(words)).alias("pattern")
    )


def _near(words: Column, q: Column) -> Column:
    """The words that begin with a stem of the query: no other can count."""
    return F.filter(words, lambda w: F.regexp_instr(w, q.pattern) == 1)


def _found(words: Column, terms: Column) -> Column:
    """How often each of ``terms`` that is among ``words`` is there, as a map."""
    return t.tally(F.filter(words, lambda w: F.array_contains(terms, w)))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x)


def page_score(words: Column, query: Column) -> Column:
    """The score of a page from its tokens and the query's; 0 if either has none.

    Only words that begin with a stem of the query can count, so the others are
    passed over before anything is compared.
    """

    def with_query(words: Column, q: Column) -> Column:
        def of_near(ws: Column) -> Column:
            size = F.size(words).cast("double")
            weights = F.transform(F.map_values(_found(ws, q.terms)), lambda tf: _page_idf() * term_weight(tf.cast("double"), size, F.lit(float(c.PAGE_LENGTH))) + c.WORD_BONUS)
            return _sum(weights) + c.STEM_BONUS * F.size(F.filter(t.stems(ws), lambda w: F.map_contains_key(q.roots, w)))

        return t.let(_near(words, q), lambda ws: F.when(F.size(ws) == 0, F.lit(0.0)).otherwise(of_near(ws)))

    return t.let(F.struct(words.alias("words"), _of_query(query).alias("q")), lambda p: with_query(p.words, p.q))


def page_scores(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row for one query; a null text scores 0.

    Row by row, so nothing is shuffled, and rows that repeat an identifier or
    have none get a score each.
    """
    score = page_score(t.tokens(F.coalesce(F.col(text_col), F.lit(""))), t.tokens(F.lit(query)))
    return docs.select(F.col(id_col), score.alias("score"))


def corpus_scores(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row: BM25 with the numbers of this corpus in the place of fixed ones; no bonuses.

    Each text is read once: its length and the counts of the query's terms are
    written, and summed up to one row of statistics, before they are scored.
    Rows that repeat an identifier or have none count each.
    """
    words = docs.sparkSession.range(1).select(t.tokens(F.lit(query)).alias("q")).first().q
    terms = list(dict.fromkeys(words))
    tokens = t.tokens(F.coalesce(F.col(text_col), F.lit("")))
    known = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    counted = t.let(tokens, lambda ws: F.struct(F.size(ws).alias("size"), t.let(F.filter(ws, lambda w: w.isin(terms)), lambda near: F.transform(known, lambda q: F.size(F.filter(near, lambda w: w == q)))).alias("tf")))
    rows = durable(docs.select(F.col(id_col).alias("id"), counted.alias("c")).select("id", "c.*"))
    found = [F.sum((F.get("tf", i) > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))]
    stats = rows.agg(F.count("*").alias("n"), F.avg("size").alias("mean"), *found).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        weight = term_weight(F.get("tf", i).cast("double"), F.col("size"), F.lit(max(stats["mean"] or 1.0, 1e-9)))
        score = score + idf(F.lit(float(stats["n"])), F.lit(float(stats[f"df{i}"] or 0))) * weight
    return rows.select(F.col("id").alias(id_col), score.alias("score"))


def scored_sentences(items: Column, query: Column) -> Column:
    """Sentences of one page as structs (idx, s, score), from its sentences and the query's tokens.

    Statistics are of this page alone, so all of it is one row's arrays: pages
    spread over the cluster without a shuffle.  A sentence's words are looked up
    among the query's, never the other way round, so a long query costs no more
    passes over the page.
    """

    def facts(s: Column, i: Column, q: Column) -> Column:
        def of_near(ws: Column, near: Column) -> Column:
            pairs = F.when(F.size(near) < 2, F.lit(0)).otherwise(t.occurrences(t.bigrams(ws), q.pairs))
            return F.struct(_found(near, q.terms).alias("tf"), t.occurrences(t.stems(near), q.roots).alias("alike"), pairs.alias("pairs"))

        def of_words(ws: Column) -> Column:
            hits = t.let(_near(ws, q), lambda near: F.when(F.size(near) > 0, of_near(ws, near)))
            return F.struct(i.alias("idx"), s.alias("s"), F.size(ws).alias("size"), hits.alias("hits"))

        return t.let(t.tokens(s), of_words)

    def scored(rows: Column) -> Column:
        n = F.size(rows)
        mean = F.greatest(F.floor(F.aggregate(rows, F.lit(0), lambda acc, r: acc + r["size"]) / F.greatest(n, F.lit(1))), F.lit(1)).cast("double")
        terms = F.flatten(F.transform(F.filter(rows, lambda r: r.hits.isNotNull()), lambda r: F.map_keys(r.hits.tf)))
        idfs = F.transform_values(t.tally(terms), lambda _, df: idf(n.cast("double"), df.cast("double")))

        def one(r: Column, p: Column) -> Column:
            def of_hits(h: Column) -> Column:
                weights = F.transform(F.map_entries(h.tf), lambda e: F.element_at(p.idfs, e.key) * term_weight(e.value.cast("double"), r["size"].cast("double"), p.mean) + c.WORD_BONUS)
                return _sum(weights) + c.BIGRAM_BONUS * h.pairs + c.STEM_BONUS * h.alike

            bonus = F.when(r.hits.isNull(), F.lit(0.0)).otherwise(of_hits(r.hits))
            place = c.POSITION_BONUS * (1 - 0.5 * r.idx / n)
            code = F.when(t.has_code(r.s), F.lit(c.CODE_BONUS)).otherwise(F.lit(0.0))
            noise = F.when(t.is_noise(r.s), F.lit(c.NOISE_PENALTY)).otherwise(F.lit(0.0))
            return F.struct(r.idx.alias("idx"), r.s.alias("s"), (bonus + place + code - noise).alias("score"))

        return t.let(F.struct(idfs.alias("idfs"), mean.alias("mean")), lambda p: F.transform(rows, lambda r: one(r, p)))

    return t.let(_of_query(query), lambda q: t.let(F.transform(items, lambda s, i: facts(s, i, q)), scored))
