"""Records of video pages: metadata, subtitles and comments as JSON and text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

OEMBED = "title string, author_name string, author_url string"
DETAILS = "videoDetails struct<lengthSeconds:string,viewCount:string,publishDate:string,shortDescription:string>"
INFO = (
    "uploader string, duration double, view_count double, like_count double, upload_date string, description string, "
    "comments array<struct<author:string,text:string,like_count:double,is_pinned:boolean>>"
)
#: Bytes of a watch page that are searched.
WATCH_BYTES = 4 << 20
PLAYER = r"ytInitialPlayerResponse\s*=\s*(\{.*?\});"


def oembed(json: Column) -> Column:
    return F.from_json(json, OEMBED)


def watch_details(html: Column) -> Column:
    """The details that a watch page holds; null fields where it has none or they don't parse."""
    head = F.make_valid_utf8(F.substring(html.cast("binary"), 1, WATCH_BYTES).cast("string"))
    return F.from_json(F.regexp_extract(head, PLAYER, 1), DETAILS)["videoDetails"]


def info(json: Column) -> Column:
    """Description and comments; null without a comment, its description too."""
    parsed = F.from_json(json, INFO)
    return t.let(parsed, lambda p: F.when(F.size(p.comments) > 0, p))


def transcript(srt: Column) -> Column:
    """Cleaned subtitles; null if none are left."""
    return t.let(t.clean_subtitles(srt), lambda s: F.when(t.trimmed(s) != "", s))


def subtitle_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the first subtitle file in order of name under ``path``; fails where there is none."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.srt").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.agg(F.min("path").alias("path"), F.min_by("value", "path").alias("raw")).select("path", transcript(F.col("raw")).alias("text"))


def info_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, description, comments) of the ``<id>.info.json`` files under ``path`` that have comments."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.info.json").text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.info\.json$", 1)
    rows = files.select(name.alias("video_id"), info(F.col("value")).alias("i")).filter("i IS NOT NULL")
    return rows.select("video_id", "i.description", "i.comments")
