"""Scores, highlights and whole queries."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from verbatrix.functions import text as t
from verbatrix.operators import dedupe, highlight, ranking, scoring
from verbatrix.plans import fetch, search, video
from verbatrix.sources import html, video as video_source


def rerank(spark, content, query, budget, by_tokens=False):
    df = spark.createDataFrame([(content, query, budget)], "c string, q string, b int")
    return df.select(highlight.highlights(F.col("c"), F.col("q"), F.col("b"), by_tokens).alias("h")).first().h


def score(spark, content, query):
    return spark.createDataFrame([(content, query)], "c string, q string").select(scoring.page_score(t.tokens(F.col("c")), t.tokens(F.col("q"))).alias("s")).first().s


HARBOUR = [
    "Subscribe to our newsletter for weekly mail.",
    "The lighthouse keeper repairs the brass lamp every winter.",
    "Many visitors bring bread for the birds.",
    "A lighthouse needs a keeper who repairs lamps at night.",
    "Tickets are sold beside the gate.",
]


def test_rerank_without_query(spark):
    assert rerank(spark, " ".join(HARBOUR[1:]), "", 70) == HARBOUR[1]
    assert rerank(spark, " ".join(HARBOUR[1:]), "the of", 100) == "\n".join(HARBOUR[1:3])
    assert rerank(spark, " ".join(HARBOUR[1:]), "volcano", 100) == "\n".join(HARBOUR[1:3])  # position alone scores


def test_rerank_with_query(spark):
    out = rerank(spark, " ".join(HARBOUR), "lighthouse keeper lamp", 120)
    assert out == f"{HARBOUR[1]}\n{HARBOUR[3]}"
    assert rerank(spark, " ".join(HARBOUR), "lighthouse keeper lamp", 60) in HARBOUR[1:4:2]


def test_rerank_budget(spark):
    text = "Snow fell on the northern pass again. Snow closed a road near the pass. Snow melts late."
    assert [len(rerank(spark, text, "snow pass", n)) <= n for n in (0, 10, 24, 40, 80, 200)] == [True] * 6
    assert rerank(spark, text, "snow pass", 0) == "" == rerank(spark, "", "snow", 10) == rerank(spark, text, "snow", -1)
    assert rerank(spark, text, "snow", 10**6, True) == text.replace(". ", ".\n")


def test_rerank_drops_repeats(spark):
    out = rerank(spark, " ".join([HARBOUR[3], HARBOUR[2], HARBOUR[3], HARBOUR[4]]), "lighthouse keeper", 300)
    assert out.split("\n").count(HARBOUR[3]) == 1


def test_page_scores(spark):
    assert score(spark, "", "lamp") == 0 == score(spark, "lamp", "") == score(spark, "the of", "lamp")
    assert score(spark, HARBOUR[1], "keeper lamp") > score(spark, HARBOUR[2], "keeper lamp") == 0
    # two terms once each in two words, both alike and both found
    idf, weight = math.log(1 + 9.5 / 1.5), 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 200))
    assert score(spark, "harbour gulls", "gulls harbour") == pytest.approx(2 * idf * weight + 4 * 0.3)


def test_page_scores_by_rows_agree(spark):
    docs = spark.createDataFrame([(1, "mill tide mills"), (2, ""), (3, None), (4, "drying the nets")], "doc_id long, text string")
    by_rows = docs.select("doc_id", scoring.page_score(t.tokens(F.coalesce("text", F.lit(""))), t.tokens(F.lit("tide mill tide"))).alias("s")).collect()
    assert {r.doc_id: pytest.approx(r.s) for r in by_rows} == {r.doc_id: r.score for r in scoring.page_scores(docs, "tide mill tide").collect()}
    assert all(r.score == 0 for r in scoring.page_scores(docs, "the").collect())


def test_rows_without_an_identifier_of_their_own(spark):
    docs = spark.createDataFrame([(1, "tide mill", 3), (1, "tide mill", 3), (None, "mill", 4), (None, "nets", 5), (2, None, 6)], "doc_id long, text string, score int")
    assert sorted((r.doc_id or 0, r.score > 0) for r in scoring.page_scores(docs, "mill").collect()) == [(0, False), (0, True), (1, True), (1, True), (2, False)]
    corpus = scoring.corpus_scores(docs, "tide mill").collect()
    idf = {"tide": math.log(1 + (5 - 2 + 0.5) / 2.5), "mill": math.log(1 + (5 - 3 + 0.5) / 3.5)}

    def bm25(words):
        return sum(idf[w] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(words) / (6 / 5))) for w in words if w in idf)

    assert sorted(r.score for r in corpus) == pytest.approx(sorted(bm25(w) for w in (["tide", "mill"], ["tide", "mill"], ["mill"], ["nets"], [])))
    assert scoring.corpus_scores(docs.limit(0), "mill").count() == 0 and all(r.score == 0 for r in scoring.corpus_scores(docs, "the").collect())


def test_places(spark):
    rows = [(i, "hot" if i % 3 else None, i * 7 % 5, "x") for i in range(200)] + [(200, "one", 1, None)]
    df = spark.createDataFrame(rows, "id int, g string, v int, part string").repartition(6)
    want = {}
    for g in ("hot", None, "one"):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        want |= {r[0]: (k + 1, len(mine)) for k, r in enumerate(mine)}
    placed = ranking.places(df, "g", ["-v", "id"])
    assert placed.columns == ["id", "g", "v", "part", "place", "n"]
    assert {r.id: (r.place, r.n) for r in placed.collect()} == want
    assert ranking.places(df.limit(0), "g", ["v"]).count() == 0
    with pytest.raises(ValueError, match="already"):
        ranking.places(df, "g", ["v"], place_col="PART")


def test_other_columns_stay_as_they_are(spark):
    rows = spark.createDataFrame([(1, 0, "A b c", 5, "k"), (1, 1, "a  B, c", 6, "k"), (None, 0, "x", 7, "k"), (None, 1, "x", 8, "k")], "g int, o int, s string, nth int, _nth string")
    out = dedupe.dedupe_exact(rows, "g", "o", "s")
    assert out.columns == rows.columns and sorted(r.nth for r in out.collect()) == [5, 7]


PAGE = "<html><head><title>x</title></head><body><nav>menu</nav><article><h1>Mill</h1><p>The tide mill is <b>old</b>.<p>Second one<ul><li>a<li>b</ul>" + "word " * 60 + "</article></body></html>"


def test_main_content_and_markdown():
    inner = html.extract_main(PAGE)
    assert inner.startswith("<h1>Mill") and inner.endswith("word ")
    assert html.extract_main("<main>short</main><p>rest") == "<main>short</main><p>rest"
    long = "x" * 300
    assert html.extract_main(f"<div class='a content'>{long}</div><main>no</main>") == long
    assert html.extract_main(f"<div id=content>{long}<div>é</div></div>") == f"{long}<div>é</div>"
    md = html.to_markdown(inner)
    assert md.startswith("# Mill\n\nThe tide mill is **old**.\n\nSecond one\n\n- a\n- b")
    assert html.to_markdown("<pre>a\n b</pre><a href='/u'>l</a><script>no</script><ol><li>x</ol><hr>") == "```\na\n b\n```\n\n[l](/u)\n\n1. x\n\n---"
    assert html.to_markdown("") == ""


def test_markdown_tables_and_quotes():
    table = "<p>a</p><table><caption>Cap</caption><tr><th>x <b>y</b><th>z</tr>\n<tr><td>1</td><td>2|3</td><td><p>p</p><p>q</p></td></tr><tr><td>only</table>end"
    assert html.to_markdown(table) == "a\n\nCap\n\n| x **y** | z |  |\n| --- | --- | --- |\n| 1 | 2\\|3 | p q |\n| only |  |  |\n\nend"
    assert html.to_markdown("<blockquote><p>one</p><p>two<blockquote>in</blockquote></blockquote>after") == "> one\n>\n> two\n>\n> > in\n\nafter"
    assert html.to_markdown("<blockquote></blockquote><table></table>") == "" and html.to_markdown("x<tr><td>loose</td></tr>y") == "x\n\nloose\n\ny"


def test_listing_rows_after_an_inner_table():
    link = "<a class='result-link' href='{0}'>{0}</a>"
    inner = "<table><tr><td>" + link.format("in") + "</td></tr></table>"
    page = f"<table><tr><td>{link.format('a')}</td></tr></table><table><tr><td>{link.format('b')}</td></tr><tr><td>about b</td></tr></table>"
    assert [r["href"] for r in html.parse_listing(page)] == ["b"]
    nested = f"<table><tr><td>{inner}</td></tr><tr><td>{link.format('late')}</td></tr></table>"
    assert [r["href"] for r in html.parse_listing(nested)] == ["in"]


def test_decoding():
    assert html.decode_bytes("é".encode("latin-1"), "text/html; charset=iso-8859-1") == "é"
    assert html.decode_bytes(b"\xef\xbb\xbfab", "x; charset=utf-16") == "ab"
    assert html.decode_bytes(b"a\xff", None) == "a�" == html.decode_bytes(b"a\xff", "charset=nonsense")


SERP = (
    "<table><tr><td>old</td></tr></table><table><tr><td><a class='result-link' href='//l.x/?uddg=https%3A%2F%2Fa.b%2F1'> One </a></td></tr>"
    "<tr><td> about one </td></tr><tr><td><a class='result-link' href='https://a.b/2'>Two</a></td></tr></table>"
)


def test_search(spark):
    queries = spark.createDataFrame([(1, "tide mill", 0), (2, "none", 5)], "query_id int, query string, max_results int")
    serp = spark.createDataFrame([(1, SERP)], "query_id int, html string")
    pages = spark.createDataFrame([("https://a.b/2", PAGE)], "url string, html string")
    results = search.listed_results(serp)
    assert [tuple(r) for r in results.orderBy("rank").collect()] == [
        (1, 0, "One", "https://a.b/1", "about one"),
        (1, 1, "Two", "https://a.b/2", "(no description available)"),
    ]
    clashing = results.withColumns({"text": F.lit("x"), "query": F.lit(1), "most": F.lit(0), "score": F.lit(0)})
    ranked = search.ranked_results(queries.withColumn("url", F.lit(1)), clashing, pages.withColumn("text", F.lit(1))).orderBy("place").collect()
    assert [(r.place, r.rank, r.score > 0) for r in ranked] == [(1, 1, True), (2, 0, False)]
    texts = {r.query_id: r.text for r in search.search(queries, results, pages).collect()}
    assert texts[2] == "No results found."
    first, second = texts[1].split("\n\n---\n\n")
    assert first.startswith("Title: Two\nURL: https://a.b/2\nSnippet: (no description available)\nHighlights:\n") and "tide mill" in first
    assert second == "Title: One\nURL: https://a.b/1\nSnippet: about one"


def cut_pages(tmp_path, spark):
    """Three pages; two have a title that was cut within a reference, two have one URL, of which one fails in ``fetch_pipeline``."""
    body = "<html><article><h1>{}</h1><p>" + "some words " * 30 + "</p></article></html>"
    rows = [(1, "https://a.b/1", body.format("Ebb &amp; flow &amp;&amp")), (2, "https://a.b/2", body.format("Plain &amp#38 &copy;")), (4, "https://a.b/1", body.format("Ebb &amp; flow &amp;&amp"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_references_that_are_cut(spark, tmp_path):
    import duckdb

    from verbatrix import queries

    sf = cut_pages(tmp_path, spark)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet/*.parquet'")
    want = sorted(con.execute(queries.ORACLES["markdown"]).fetchall())
    assert sorted((r.page_id, r.markdown) for r in queries.QUERIES["markdown"](spark, sf).collect()) == want
    assert want[0][1].startswith("# Ebb & flow &&amp\n")
    assert html.to_markdown("<p>a &amp</p>") == "a &"  # the operator reads them as browsers do


def test_all_pages_of_a_url_are_fetched(spark, tmp_path):
    import duckdb

    from verbatrix import queries

    sf = cut_pages(tmp_path, spark)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet/*.parquet'")
    ((number, want),) = con.execute(queries.ORACLES["fetch_pipeline"]).fetchall()
    (got,) = queries.QUERIES["fetch_pipeline"](spark, sf).collect()
    blocks = got.text.split("\n\n---\n\n")
    assert got.request_id == number and sorted(blocks) == sorted(want.split("\n\n---\n\n"))
    assert [b[:9] for b in blocks] == ["# Ebb & f", "Fetch fai", "# Plain &"]  # by URL, then by text


def test_fetch(spark):
    requests = spark.createDataFrame([(1, {"https://b": 0, "https://a": 5}), (2, {})], "request_id int, urls map<string,int>")
    pages = spark.createDataFrame([("https://a", PAGE, None, 1), ("https://a", "zzz", "timed out", 2), (None, "x", None, 3)], "url string, html string, error string, limit int")
    got = {r.request_id: r.text for r in fetch.fetch(requests, pages).collect()}
    assert got[2] == "no url provided"
    assert got[1].startswith("# Mill") and got[1].endswith("\n\n---\n\nFetch failed: no page\n\n(from https://b)")


def test_video(spark):
    url = "https://youtu.be/abcdefghijk"
    info = '{"description":"about tide mill","comments":[{"author":"ann","text":"hi","like_count":2}]}'
    row = (url, '{"title":"Mill","author_name":"Bob","author_url":""}', 'x ytInitialPlayerResponse = {"videoDetails":{"lengthSeconds":"65"}};', "1\n0 --> 1\nThe tide mill is old and well known.\n", info)
    bare = ("https://youtu.be/abcdefghij2", '{"title":"T","author_name":"B"}', None, None, '{"description":"lost","comments":[]}')
    videos = spark.createDataFrame([row, bare, ("https://youtu.be/abcdefghij3", None, None, None, None)], "url string, oembed_json string, watch_html string, srt string, info_json string")
    texts = {r.url: r for r in video.video_texts(videos.withColumn("limit", F.lit(0))).collect()}
    assert texts[url].text == (
        f"Title: Mill\nAuthor: Bob\nDuration: 65s\nURL: {url}\n\n\nTranscript:\nThe tide mill is old and well known.\n\nDiscussion:\n- ann: hi (likes: 2)"
    )
    assert texts[bare[0]].text.startswith("Title: T\nAuthor: B\nURL: https://youtu.be/abcdefghij2\n\n\n---\n")
    assert texts["https://youtu.be/abcdefghij3"].error == "no metadata"
    failed = videos.select("*", F.lit("No luck.").alias("failure"), F.when(F.col("url") == url, F.lit(" it said so ")).otherwise("").alias("stderr"))
    told = {r.url: r.text for r in video.video_texts(failed.withColumn("limit", F.lit(0))).collect()}
    assert told[url].endswith(f"URL: {url}\n\n\n---\nNo luck.\nstderr: it said so") and told[bare[0]].endswith("\n---\nNo luck.")
    long = spark.range(1).select(t.extractor_error(F.lit("m"), F.lit("é" * 400)).alias("e")).first().e
    assert long == "m\nstderr: " + "é" * 150
    videos = videos.unionAll(videos)  # repeated rows count once
    requests = spark.createDataFrame([(1, {url: 0})], "request_id int, urls map<string,int>")
    pages = spark.createDataFrame([], "url string, html string")
    assert fetch.fetch(requests, pages, videos).first().text == texts[url].text


def test_video_files(spark, tmp_path):
    (tmp_path / "b.srt").write_text("1\n0 --> 1\nsecond file\n")
    (tmp_path / "a.srt").write_text("1\n0 --> 1\nfirst file\n")
    (tmp_path / "id1.info.json").write_text('{"description":"d","comments":[{"author":"a","text":"t","like_count":1}]}')
    assert video_source.subtitle_files(spark, str(tmp_path)).first().text == "first file"
    assert video_source.info_files(spark, str(tmp_path)).first().video_id == "id1"


def test_streamed_requests(spark, tmp_path):
    from verbatrix.streaming.cache import distinct_requests

    src = tmp_path / "in"
    spark.sql("SELECT 'u' AS url, 10 AS limit, timestamp'2024-01-01 00:00:00' AS ts UNION ALL SELECT 'u', 2000, timestamp'2024-01-01 00:01:00' UNION ALL SELECT 'v', 0, timestamp'2024-01-01 00:01:00'").write.parquet(str(src))
    stream = spark.readStream.schema("url string, limit int, ts timestamp").parquet(str(src))
    q = distinct_requests(stream).writeStream.format("memory").queryName("requests").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.url, r.limit) for r in spark.table("requests").collect()) == [("u", 2000), ("v", 0)]
