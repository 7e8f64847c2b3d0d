"""Token counts as delta-maintained rollups.

Changes to documents come in batches: inserts, deletes and revised counts.  A
batch becomes signed deltas of (documents, tokens) by source, language and
tokenizer version; totals are the sum of the deltas of all committed batches.  A
ledger of each document's present count gives what a delete or a revision takes
away; it is kept in buckets by key, and a batch reads only those of its own keys
and shuffles only entries of its documents.

A batch is committed by a marker, which is created last and only if no other
writer has created the one of that number; who comes second starts anew.  One
that is delivered again changes nothing, and what one that broke off left behind
is never read.  ``compact`` folds what is committed into one part.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_blocks

#: Splits text before merging; belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEYS = ["source", "lang", "tokenizer"]
LEDGER = "doc_key string, source string, lang string, tokenizer string, n_tokens bigint, alive boolean, seq bigint, bucket int"
#: Buckets of a new ledger; each should be a file of some hundred megabytes in the end.
BUCKETS = 16
BLOCK_BYTES = 1 << 21
DELTAS = "source string, lang string, tokenizer string, d_docs bigint, d_tokens bigint"


@lru_cache(maxsize=2)
def encoding(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def bpe_counts(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``docs`` with the number of tokens of the whole text in the place of ``text_col``; 0 for null and empty texts.

    ``out_col`` must not be the name of another column.
    """
    if out_col.lower() in {c.lower() for c in docs.columns if c != text_col}:
        raise ValueError(f"there is a column {out_col} already")
    with open(ranks, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    at = docs.columns.index(text_col)
    fields = [f"`{c}` {t}" for c, t in docs.dtypes]
    fields[at] = f"`{out_col}` bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(shared.value).encode_ordinary
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(at), BLOCK_BYTES):
                counts = [len(encode(t.decode("utf-8", "replace"))) if t else 0 for t in texts]
                yield batch.slice(low, high - low).set_column(at, out_col, pa.array(counts, pa.int64()))

    return docs.mapInArrow(run, ", ".join(fields))


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What names a document: its identifier, or its text's hash where that is null."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))


class TokenRollup:
    """The state under one folder, which the driver and all executors must share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets, self.known = spark, path.rstrip("/"), buckets, {}

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _markers(self) -> dict[int, dict]:
        """What the markers say, by number; {} for one that its writer didn't finish."""
        fs, p = self._fs(f"{self.path}/commits")
        for status in fs.listStatus(p) if fs.exists(p) else ():
            seq = status.getPath().getName()
            if seq.isdigit() and not self.known.get(int(seq)):
                stream = fs.open(status.getPath())
                try:
                    text = bytes(stream.readAllBytes()).decode()
                finally:
                    stream.close()
                try:
                    self.known[int(seq)] = json.loads(text)
                except ValueError:
                    self.known[int(seq)] = {}
        return dict(sorted(self.known.items()))

    def _commit(self, seq: int, marker: dict) -> bool:
        """Create the marker; False if there is one of this number already."""
        fs, p = self._fs(f"{self.path}/commits/{seq:010d}")
        fs.mkdirs(p.getParent())
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(marker).encode()))
        finally:
            stream.close()
        return True

    def _parts(self) -> dict[int, dict]:
        """The markers that count: the last compaction and what came after it."""
        markers = {seq: m for seq, m in self._markers().items() if m}
        last = max((seq for seq, m in markers.items() if m["folded"]), default=0)
        return {seq: m for seq, m in markers.items() if seq >= last}

    def batches(self) -> dict[str, int]:
        """The committed batches and their numbers, in order of commit."""
        out: dict[str, int] = {}
        for seq, m in self._markers().items():
            if m and not m["folded"]:
                out[m["batch"]] = seq
        return out

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{m['part']}" for m in self._parts().values()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # each part by itself, as a bucket's folder belongs to its part
        frames = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionAll(f)
        return out

    @staticmethod
    def _latest(entries: DataFrame) -> DataFrame:
        rest = F.struct("seq", "source", "lang", "tokenizer", "n_tokens", "alive")
        latest = entries.groupBy("doc_key").agg(F.max_by(rest, "seq").alias("e"))
        return latest.select("doc_key", "e.source", "e.lang", "e.tokenizer", "e.n_tokens", "e.alive", "e.seq")

    def ledger(self) -> DataFrame:
        """(doc_key, source, lang, tokenizer, n_tokens, alive, seq): each document's latest entry."""
        return self._latest(self._read("ledger", LEDGER))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) that aren't zero; null is a source or language of its own."""
        sums = self._read("deltas", DELTAS).groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return sums.filter((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_key"), F.lit(self.buckets)).cast("int")

    def _write_ledger(self, entries: DataFrame, part: str) -> None:
        """One file a bucket, as a rule: rows are dealt by bucket; a bucket larger than a task may be is split by Spark."""
        entries.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/ledger/{part}")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch; False, without reading it, if one of this name is committed.

        ``changes`` has (doc_key, op, source, lang, tokenizer, n_tokens), ``op``
        being insert, revise or delete.  An insert of a document that is there is
        a revision, a revision of one that isn't an insert, a delete of one that
        isn't nothing.  Of several changes to one document in a batch a delete
        holds before a revision, that before an insert, then the larger count;
        rows that repeat count once.  A null count is 0.  Other operations, and a
        null ``doc_key``, are errors.  Other columns aren't read; an empty batch is
        committed too.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.]+", batch):
            raise ValueError("a batch's name has letters, digits, underscores and dots")
        order = F.when(F.col("op") == "delete", 2).when(F.col("op") == "revise", 1).when(F.col("op") == "insert", 0)
        checked = changes.select(
            F.when(F.col("doc_key").isNull() | order.isNull(), F.raise_error(F.lit("a change needs a doc_key and a known op"))).otherwise(F.col("doc_key")).alias("doc_key"),
            F.struct(order.alias("o"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), "tokenizer", "source", "lang").alias("c"),
        )
        news_at = f"{self.path}/news/{uuid.uuid4().hex}"
        while batch not in self.batches():
            fs, p = self._fs(news_at)
            if not fs.exists(p):
                # written, as it is read for its buckets, its keys and itself
                checked.groupBy("doc_key").agg(F.max("c").alias("c")).withColumn("bucket", self._bucket()).write.parquet(news_at)
            seq = max(self._markers(), default=0) + 1
            part = f"{seq}-{uuid.uuid4().hex}"
            self._write(part, seq, self.spark.read.parquet(news_at))
            done = self._commit(seq, {"batch": batch, "part": part, "folded": False})
            if done:
                fs.delete(p, True)
                return True
        return False

    def _write(self, part: str, seq: int, news: DataFrame) -> None:
        touched = [r.bucket for r in news.select("bucket").distinct().collect()]  # at most as many as there are buckets
        there = self._read("ledger", LEDGER).filter(F.col("bucket").isin(touched)).join(news.select("doc_key"), "doc_key", "left_semi")
        old = self._latest(there).filter("alive").select("doc_key", F.struct("source", "lang", "tokenizer", "n_tokens").alias("old"))
        rows = news.join(old, "doc_key", "left")
        gone = F.col("c.o") == 2
        entries = rows.filter(~gone | F.col("old").isNotNull()).select(
            "doc_key",
            *(F.when(gone, F.col(f"old.{k}")).otherwise(F.col(f"c.{k}")).alias(k) for k in ("source", "lang", "tokenizer", "n_tokens")),
            (~gone).alias("alive"),
            F.lit(seq).cast("long").alias("seq"),
            F.col("old"),
            "bucket",
        )
        # written before the deltas are derived from them, so that they are made once
        self._write_ledger(entries, part)
        made = self.spark.read.schema(entries.schema).parquet(f"{self.path}/ledger/{part}")
        signed = made.select(
            F.explode(
                F.array(
                    F.when(F.col("old").isNotNull(), F.struct("old.source", "old.lang", "old.tokenizer", F.lit(-1).alias("docs"), (-F.col("old.n_tokens")).alias("tokens"))),
                    F.when(F.col("alive"), F.struct("source", "lang", "tokenizer", F.lit(1).alias("docs"), F.col("n_tokens").alias("tokens"))),
                )
            ).alias("d")
        ).filter("d IS NOT NULL")
        deltas = signed.groupBy("d.source", "d.lang", "d.tokenizer").agg(F.sum("d.docs").alias("d_docs"), F.sum("d.tokens").alias("d_tokens"))
        deltas.write.parquet(f"{self.path}/deltas/{part}")

    def compact(self) -> bool:
        """Fold all committed parts into one: the entries of documents that are there, and the totals.

        False if another writer came first or there is nothing to fold; older parts
        stay for readers that are under way, ``vacuum`` removes them.
        """
        if len(self._parts()) < 2:
            return False
        seq, part = max(self._markers()) + 1, f"folded-{uuid.uuid4().hex}"
        self._write_ledger(self.ledger().filter("alive").withColumn("bucket", self._bucket()), part)
        sums = self.totals().select(*KEYS, F.col("n_docs").alias("d_docs"), F.col("n_tokens").alias("d_tokens"))
        sums.write.parquet(f"{self.path}/deltas/{part}")
        return self._commit(seq, {"batch": None, "part": part, "folded": True})

    def vacuum(self) -> None:
        """Remove parts that don't count any more; not while another writer or reader is at work."""
        kept = {m["part"] for m in self._parts().values()}
        for kind in ("ledger", "deltas", "news"):
            fs, p = self._fs(f"{self.path}/{kind}")
            for status in fs.listStatus(p) if fs.exists(p) else ():
                if status.getPath().getName() not in kept:
                    fs.delete(status.getPath(), True)
