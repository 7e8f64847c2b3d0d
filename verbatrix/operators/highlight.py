"""Selection of a page's best sentences under a budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from .scoring import scored_sentences


def page_sentences(content: Column) -> Column:
    """Sentences of a page, repaired and without near-duplicates, in order."""
    text = F.coalesce(content, F.lit(""))
    return t.dedupe(t.repair_sentences(t.sentences(text), text))


def truncate_sentences(items: Column, budget: Column, by_tokens: bool) -> Column:
    """The longest prefix of sentences whose costs together stay within the budget."""

    def step(acc: Column, s: Column) -> Column:
        spent = acc.spent + t.measure(s, by_tokens)
        return F.when(acc.open & (spent <= budget), F.struct(spent.alias("spent"), (acc.n + 1).alias("n"), F.lit(True).alias("open"))).otherwise(
            F.struct(acc.spent.alias("spent"), acc.n.alias("n"), F.lit(False).alias("open"))
        )

    start = F.struct(F.lit(0).alias("spent"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    return t.let(F.aggregate(items, start, step).n, lambda n: F.slice(items, F.lit(1), n))


def select_sentences(scored: Column, budget: Column, by_tokens: bool) -> Column:
    """Of structs (idx, s, score) the best, until the first that exceeds the budget; in page order.

    Scores of 0 and less are never taken; of equal ones the first comes first.
    """
    best = F.array_sort(F.transform(F.filter(scored, lambda r: r.score > 0), lambda r: F.struct(F.round(-r.score, 9).alias("k"), r.idx.alias("idx"), r.s.alias("s"))))
    taken = t.let(best, lambda rs: t.let(truncate_sentences(F.transform(rs, lambda r: r.s), budget, by_tokens), lambda ss: F.slice(rs, F.lit(1), F.size(ss))))
    return F.transform(F.array_sort(F.transform(taken, lambda r: F.struct(r.idx.alias("idx"), r.s.alias("s")))), lambda r: r.s)


def highlights(content: Column, query: Column, budget: Column, by_tokens: bool = True) -> Column:
    """The sentences of a page that bear on a query, within a budget of tokens or characters.

    Empty for empty content or a budget of 0 and less.  Pages of two sentences or
    fewer, queries without tokens and pages where nothing scores give the leading
    sentences that fit.
    """

    def of_sentences(items: Column) -> Column:
        lead = truncate_sentences(items, budget, by_tokens)

        def with_query(q: Column) -> Column:
            chosen = t.let(scored_sentences(items, q), lambda rs: select_sentences(rs, budget, by_tokens))
            best = t.let(chosen, lambda ss: F.when(F.size(ss) > 0, ss).otherwise(lead))
            return F.when((F.size(items) <= 2) | (F.size(q) == 0), lead).otherwise(best)

        return t.let(t.tokens(F.coalesce(query, F.lit(""))), with_query)

    text = F.array_join(t.let(page_sentences(content), of_sentences), "\n")
    return F.when((budget <= 0) | (F.coalesce(content, F.lit("")) == ""), F.lit("")).otherwise(text)


def token_highlights(content: Column, query: Column, max_tokens: Column) -> Column:
    return highlights(content, query, max_tokens, True)


def char_highlights(content: Column, query: Column, max_chars: Column) -> Column:
    return highlights(content, query, max_chars, False)
