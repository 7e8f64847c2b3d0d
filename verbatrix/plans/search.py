"""Search: queries and result listings to ranked results with highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as c
from ..functions import text as t
from ..operators.highlight import token_highlights
from ..operators.scoring import page_score
from ..sources.html import listing
from .fetch import page_texts


def listed_results(serp: DataFrame) -> DataFrame:
    """(query_id, rank, title, url, snippet) from (query_id, html) of listing pages; ``rank`` from 0."""
    rows = serp.select("query_id", F.posexplode(listing(F.col("html"))).alias("rank", "r"))
    return rows.select("query_id", "rank", F.col("r.title").alias("title"), t.resolve_redirect(F.col("r.href")).alias("url"), F.col("r.snippet").alias("snippet"))


def ranked_results(
    queries: DataFrame,
    results: DataFrame,
    pages: DataFrame,
    videos: DataFrame | None = None,
    page_limit: int = c.SEARCH_LIMIT,
    top_budget: int = c.TOP_BUDGET,
    rest_budget: int = c.REST_BUDGET,
) -> DataFrame:
    """(query_id, place, rank, title, url, snippet, score, highlights), ``place`` from 1.

    ``queries`` has (query_id, query, max_results); other columns, there or in
    ``results``, aren't read.  Each page is cut to
    ``page_limit`` bytes and scored; results go by score (to nine places, as sums may differ in the last), then by rank; the first
    half, rounded up, has the larger budget.  A page that failed scores 0 and
    keeps its place.
    """
    shown = results.select("query_id", "rank", "title", "url", "snippet")
    asked = shown.join(queries.select("query_id", "query", t.clamp_results(F.col("max_results")).alias("most")), "query_id")
    asked = asked.filter(F.col("rank") < F.col("most"))
    texts = page_texts(asked.select("url", F.lit(page_limit).alias("limit")), pages, videos).select("url", "text")
    # dealt by number: a page costs far more time than its bytes tell, so partitions mustn't be joined up by size
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = asked.join(texts, "url", "left").withColumn("text", F.coalesce("text", F.lit(""))).repartition(tasks, "query_id")
    scored = found.withColumn("score", page_score(t.tokens(F.col("text")), t.tokens(F.col("query"))))
    by_query = Window.partitionBy("query_id")
    placed = scored.withColumn("place", F.row_number().over(by_query.orderBy(F.round("score", 9).desc(), "rank"))).withColumn("n", F.count("*").over(by_query))
    budget = F.when(F.col("place") <= F.ceil(F.col("n") / 2), F.lit(top_budget)).otherwise(F.lit(rest_budget))
    return placed.select(
        "query_id", "place", "rank", "title", "url", "snippet", "score", token_highlights(F.col("text"), F.col("query"), budget).alias("highlights")
    )


def search(queries: DataFrame, results: DataFrame, pages: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """(query_id, text): each query's results as one text; ``No results found.`` where there is none."""
    rows = ranked_results(queries, results, pages, videos)
    block = F.concat(
        F.format_string("Title: %s\nURL: %s\nSnippet: %s", "title", "url", "snippet"),
        F.when(F.col("highlights") != "", F.concat(F.lit("\nHighlights:\n"), F.col("highlights"))).otherwise(F.lit("")),
    )
    joined = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))).alias("rs"))
    text = joined.select("query_id", F.array_join(F.transform("rs", lambda r: r.block), c.SEPARATOR).alias("text"))
    return queries.select("query_id").join(text, "query_id", "left").select("query_id", F.coalesce("text", F.lit("No results found.")).alias("text"))
