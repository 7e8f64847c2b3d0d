"""Exact deduplication by content-defined chunk recipes.

A text is normalised (runs of white space become one space) and cut where a
rolling hash of its last 32 bytes meets a mask, so equal passages give equal
chunks.  A document then is its *recipe*, the ordered list of its chunks' short
identifiers.  The dictionary of all chunks verifies the identifiers: one that
stands for two different digests would make recipes ambiguous, and the digests
themselves replace the identifiers then.  Only recipes are shuffled and
compared, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_name, durable, normalise_space, text_blocks

WINDOW = 32
MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 8192
BLOCK_BYTES = 1 << 22

#: One random-looking word for each byte value, made by rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=7) for b in range(256)], dtype=np.uint32)


def cut_candidates(data: bytes) -> np.ndarray:
    """Ends (exclusive) where the hash of the last 32 bytes meets the mask.

    Works through the data in overlapping pieces, so memory doesn't grow with it.
    """
    found, size = [], len(data)
    for start in range(0, size, BLOCK_BYTES):
        low = max(0, start - WINDOW + 1)
        h = GEAR[np.frombuffer(data, np.uint8, min(size, start + BLOCK_BYTES) - low, low)]
        step = 1
        while step < WINDOW:
            if step < len(h):
                h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        hits = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + (low + 1)
        found.append(hits[hits > start])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(candidates: list[int], start: int, end: int) -> list[int]:
    """Chunk ends of one text that lies at [start, end): 256 to 8192 bytes each.

    Candidates closer than MIN_CHUNK to the start of a chunk don't count, so
    what stands before the text can't move its cuts.
    """
    ends, at = [], start
    for c in candidates:
        while c - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if c - at >= MIN_CHUNK and c < end:
            ends.append(c)
            at = c
    while end - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    if end > at:
        ends.append(end)
    return ends


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
            part = [normalise_space(t or b"") for t in texts]
            data = part[0] if len(part) == 1 else b"".join(part)
            cuts = cut_candidates(data)
            ids, digests, sizes, shas, at = [], [], [0], [], 0
            for t in part:
                end = at + len(t)
                inner = cuts[np.searchsorted(cuts, at, "right") : np.searchsorted(cuts, end, "left")].tolist()
                for e in chunk_ends(inner, at, end):
                    chunk = data[at:e]
                    ids.append(xxhash.xxh64_intdigest(chunk))
                    digests.append(hashlib.sha256(chunk).digest()[:16])
                    at = e
                sizes.append(len(ids))
                shas.append(hashlib.sha256(t).hexdigest())
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(low, high - low),
                    pa.array(shas, pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.array(ids, np.uint64).view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(digests, pa.binary())),
                ],
                ["id", "text_sha256", "chunk_ids", "chunk_digests"],
            )


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256, chunk_ids, chunk_digests) for every row; null text counts as empty.

    ``chunk_ids`` are 64-bit hashes and ``chunk_digests`` 128-bit digests of the
    same chunks in order; an empty text has none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _recipes, f"id {kind}, text_sha256 string, chunk_ids array<bigint>, chunk_digests array<binary>"
    )


def chunk_dictionary(recipes: DataFrame) -> DataFrame:
    """(chunk_id, verified, digest, n_uses): one row per short identifier.

    ``verified`` is false where an identifier stands for different chunks.
    """
    each = recipes.select(F.explode(F.arrays_zip("chunk_ids", "chunk_digests")).alias("c"))
    return (
        each.groupBy(F.col("c.chunk_ids").alias("chunk_id"))
        .agg(F.min("c.chunk_digests").alias("digest"), F.max("c.chunk_digests").alias("last"), F.count("*").alias("n_uses"))
        .select("chunk_id", (F.col("digest") == F.col("last")).alias("verified"), "digest", "n_uses")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mark every row as kept or as a copy of the row that stays.

    Returns (id_col, keep_id, group_size, kept, text_sha256), one row per input
    row.  Texts are equal when identical after replacing each run of white space
    by one space; null counts as empty.  The row with the smallest id stays, a
    null id counts as the largest; of rows that repeat both id and text exactly
    one is kept.  Other columns are not read.  An empty table gives an empty one.
    """
    rows = durable(chunk_recipes(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()))
    ambiguous = chunk_dictionary(rows).filter(~F.col("verified")).limit(1).count()
    recipe = "chunk_digests" if ambiguous else "chunk_ids"
    rows = rows.select("id", "rid", "text_sha256", F.col(recipe).alias("recipe"))
    # written, so that the join reads both sides from exchanges and a hot recipe's rows can be split over tasks
    groups = durable(
        rows.groupBy("recipe").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid"))).alias("first"),
            F.count("*").alias("group_size"),
        )
    )
    return rows.join(groups, "recipe").select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without its exact copies, with all its columns.

    The identifiers of dropped rows are taken away, which are fewer than those that
    stay and seldom need the texts to move.  Where an identifier, or none, names
    several rows and not all of them go, they are told apart by the digest of
    their normalised text, and one row of each stays.  An empty table gives an
    empty one.
    """
    marked = durable(exact_dedup(docs, id_col, text_col))
    key, sha, wanted = (distinct_name(docs.columns, c) for c in ("gone_key", "kept_sha", "wanted_sha"))
    ids = marked.groupBy(F.col(id_col).alias(key)).agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("n_kept"))
    gone = ids.filter("n_kept < n")
    same_id = lambda df: df[id_col].eqNullSafe(F.col(key))
    out = docs.join(gone.select(key), same_id(docs), "left_anti")
    mixed = durable(gone.filter("n_kept > 0").select(key))
    if not mixed.limit(1).count():
        return out
    kept = marked.filter("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(wanted)).join(mixed, key, "left_semi")
    kept = kept.unionAll(marked.filter(F.col("kept") & F.col(id_col).isNull()).select(F.lit(None).alias(key), "text_sha256")).distinct()
    some = docs.join(mixed, same_id(docs), "left_semi")
    some = some.withColumn(sha, F.sha2(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256))
    some = some.join(kept, same_id(some) & (F.col(sha) == F.col(wanted)), "left_semi")
    return out.unionByName(some.dropDuplicates([id_col, sha]).drop(sha))
