"""Text of video pages from their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.highlight import char_highlights
from ..sources import video

NO_ASSETS = "Subtitles and comments aren't available; only metadata is returned."
RECORDS = ["oembed_json", "watch_html", "srt", "info_json"]


def _line(label: str, value: Column, unit: str = "") -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value, F.lit(unit)))


def video_texts(assets: DataFrame) -> DataFrame:
    """(url, limit, text, error) from (url, limit, oembed_json, watch_html, srt, info_json).

    Missing metadata is an error; missing watch-page details leave lines out.  A
    video whose extractor failed (a ``failure`` message, perhaps with what it said
    in ``stderr``) gives its header and that message, one with neither subtitles
    nor comments its header and a general one.  A limit of 0 is none: the
    transcript is whole then.
    """
    told = [F.col(k) if k in assets.columns else F.lit(None).cast("string") for k in ("failure", "stderr")]
    meta, details, info = F.col("meta"), F.col("details"), F.col("info")
    rows = assets.select(
        "url",
        "limit",
        video.oembed(F.col("oembed_json")).alias("meta"),
        video.watch_details(F.coalesce("watch_html", F.lit(""))).alias("details"),
        video.transcript(F.col("srt")).alias("transcript"),
        video.info(F.col("info_json")).alias("info"),
        F.when(told[0].isNotNull(), t.extractor_error(told[0], F.coalesce(told[1], F.lit("")))).alias("failure"),
    )
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), F.coalesce(meta.title, F.lit(""))),
        F.concat(F.lit("Author: "), F.coalesce(meta.author_name, F.lit(""))),
        _line("Channel URL", meta.author_url),
        _line("Duration", details.lengthSeconds, "s"),
        _line("Views", details.viewCount),
        _line("Published", details.publishDate),
        F.concat(F.lit("URL: "), F.col("url"), F.lit("\n")),
    )
    query = t.trimmed(F.concat_ws(" ", F.coalesce(meta.title, F.lit("")), F.coalesce(info.description, F.lit(""))))
    unlimited = F.lit((1 << 31) - 1)
    budget = F.when(F.col("limit") <= 0, unlimited).otherwise(t.transcript_budget(F.col("limit")))
    spoken = F.concat(F.lit("\n\nTranscript:\n"), char_highlights(F.col("transcript"), query, budget))
    comments = t.truncate(t.format_comments(info.comments), t.discussion_budget(F.col("limit")))
    parts = F.concat(
        header,
        F.when(F.col("failure").isNotNull() | (F.col("transcript").isNull() & info.isNull()), F.concat(F.lit("\n\n---\n"), F.coalesce("failure", F.lit(NO_ASSETS)))).otherwise(
            F.concat(
                F.when(F.col("transcript").isNotNull(), spoken).otherwise(F.lit("")),
                F.when(info.isNotNull(), F.concat(F.lit("\n\nDiscussion:\n"), comments)).otherwise(F.lit("")),
            )
        ),
    )
    return rows.select("url", "limit", F.when(meta.isNotNull(), parts).alias("text"), F.when(meta.isNull(), F.lit("no metadata")).alias("error"))
