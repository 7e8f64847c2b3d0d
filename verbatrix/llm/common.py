"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..storage import durable, remove, shared_dir  # noqa: F401  used by the operators

#: ``[\x20\x09-\x0D]``, the white space of every word-based operator here.  It
#: is also exactly what ``bytes.split()`` and ``bytes.isspace()`` use.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def text_blocks(column: pa.Array, most: int) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """(first row, end, values as UTF-8 bytes) of blocks of a string column of about ``most`` bytes, one row at least.

    Blocks are cut by the column's offsets, so of a batch of many megabytes no more
    than a block is held as Python objects.
    """
    data = column.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, 8 * data.offset) if len(data) else np.zeros(1, np.int64)
    start = 0
    while start < len(data):
        end = min(len(data), max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1))
        yield start, end, data.slice(start, end - start).to_pylist()
        start = end


def normalise_space(text: bytes) -> bytes:
    """``text`` with every run of white space replaced by one space."""
    if not text:
        return text
    words = b" ".join(text.split())
    if not words:
        return b" "
    return (b" " if text[:1].isspace() else b"") + words + (b" " if text[-1:].isspace() else b"")


def distinct_name(df_columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores added until it clashes with no column."""
    taken = {c.lower() for c in df_columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def crc_mod4(doc_id: str = "doc_id"):
    """crc32 of the identifier as text, mod 4; null for a null identifier."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training; false for a null identifier."""
    return F.coalesce(crc_mod4(doc_id) == 2, F.lit(False))


class WordTable:
    """Rows of numbers computed once for each distinct word.

    Holds ``most`` words and ``most_bytes`` bytes of them; what doesn't fit makes
    it start anew, so memory stays bounded however many and long a partition's
    words are.
    """

    def __init__(self, compute, width: int, most: int, most_bytes: int = 16 << 20):
        self.compute, self.most, self.most_bytes, self.at, self.held = compute, most, most_bytes, {}, 0
        self.values = np.zeros((1024, width))

    def rows(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """For each text, given as its words, the rows of its words in order."""
        words = set().union(*texts) if texts else set()
        new = words - self.at.keys()
        size = sum(map(len, new))
        if self.at and (len(self.at) + len(new) > self.most or self.held + size > self.most_bytes):
            self.at.clear()
            self.values = np.zeros((1024, self.values.shape[1]))
            new, self.held = words, 0
            size = sum(map(len, new))
        if new:
            new, start = list(new), len(self.at)
            if start + len(new) > len(self.values):
                self.values = np.concatenate([self.values[:start], np.zeros((start // 2 + len(new), self.values.shape[1]))])
            self.values[start : start + len(new)] = self.compute(new)
            self.at.update(zip(new, range(start, start + len(new))))
            self.held += size
        return [self.values[list(map(self.at.__getitem__, t))] for t in texts]
