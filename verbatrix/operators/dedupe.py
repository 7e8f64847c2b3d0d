"""Deduplication of sentences across rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def dedupe_exact(rows: DataFrame, group_col: str, order_col: str, text_col: str) -> DataFrame:
    """Rows without those whose letters and digits equal an earlier row's of the same group.

    Null is a group of its own; of rows equal in ``order_col`` too any one stays.
    """
    everything = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("r")
    key = rows.select(everything, F.col(group_col).alias("g"), t.dedupe_key(F.col(text_col)).alias("k"), F.col(order_col).alias("o"))
    nth = key.withColumn("nth", F.row_number().over(Window.partitionBy("g", "k").orderBy("o")))
    return nth.filter("nth = 1").select("r.*")


def document_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = False) -> DataFrame:
    """(id_col, idx, sentence) of every text, without near-duplicates if ``near``; ``idx`` from 0."""
    items = t.sentences(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(id_col, F.posexplode(t.dedupe(items) if near else items).alias("idx", "sentence"))
