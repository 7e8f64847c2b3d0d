"""Toxicity scores from a subword bag with a linear softmax, trained in numpy.

A word is the bag of its character n-grams with boundary marks and of itself,
each hashed to a row of an embedding table.  A text is the average of all rows
of all its words, and a linear softmax of two classes stands on the average.
Embeddings and softmax are trained jointly, so a misspelling that shares
n-grams with known words shares their vectors.

As the score is linear in the average, each table row reduces to one number for
scoring, and a word to two (their sum and how many there are).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, crc_mod4, durable, text_blocks

BUCKET_BITS = 18
MIN_N, MAX_N = 3, 5
DIM = 8
#: Bound of the sample of labelled rows that a model is fitted on, for each label.
SAMPLE_PER_LABEL = 2000
#: Table rows are trained whose presence differs between the labels by so many standard errors.
LEAST = 4.0
#: From this score on a text is predicted to be toxic.
THRESHOLD = 0.3
#: Most distinct words that a worker holds scores for.
CACHE_WORDS = 100_000
BLOCK_BYTES = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: bytes) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode()
    return text.lower().translate(_PUNCTUATION).split()


_PUNCTUATION = bytes(32 if 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 else b for b in range(256))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets): the hashed n-grams of each marked word, of 3 to 5 characters, and the word itself."""
    marked = [f"<{w.decode('utf-8', 'replace')}>" for w in words]
    data = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    shift = np.uint64(64 - BUCKET_BITS)
    ids, owners = [], []
    h = np.zeros(len(data), np.uint64)
    for n in range(1, MAX_N + 1):
        # h[i] is the hash of data[i:i+n]
        m = len(data) - n + 1
        if m <= 0:
            break
        h = (h[:m] + data[n - 1 :] + np.uint64(1)) * _MULTIPLIER
        h ^= h >> np.uint64(29)
        if n >= MIN_N:
            whole = ends[owner[:m]] - np.arange(m) >= n
            ids.append((h[whole] * _MULTIPLIER) >> shift)
            owners.append(owner[:m][whole])
    # the word itself: the sum of hashes of its characters at their places
    powers = np.arange(len(data), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    mixed = (data + np.uint64(257) * powers + np.uint64(11)) * _MULTIPLIER
    mixed ^= mixed >> np.uint64(31)
    total = np.add.reduceat(mixed * _MULTIPLIER, starts) if len(words) else np.zeros(0, np.uint64)
    ids.append((total * _MULTIPLIER) >> shift)
    owners.append(np.arange(len(words)))
    buckets, owners = np.concatenate(ids).astype(np.int32), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(words))
    return buckets[order], np.concatenate([[0], np.cumsum(counts)])


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares): the text's average as weights of table rows, summing to 1."""
    times = Counter(split_words(text))
    n, words = np.zeros(1 << BUCKET_BITS), list(times)
    for low in range(0, len(words), 50_000):
        part = words[low : low + 50_000]
        buckets, offsets = word_features(part)
        n += np.bincount(buckets, weights=np.repeat([times[w] for w in part], np.diff(offsets)), minlength=len(n))
    hit = np.flatnonzero(n)
    return hit.astype(np.int32), (n[hit] / max(n.sum(), 1)).astype(np.float32)


@dataclass
class ToxicityModel:
    """``weights``: what each table row adds to the logit; ``bias``: the logit of an empty text."""

    weights: np.ndarray
    bias: float

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buckets, offsets = word_features(words)
        return np.add.reduceat(self.weights[buckets].astype(np.float64), offsets[:-1]), np.diff(offsets)

    def scorer(self):
        """A small function to send to workers.  Called once in a task, it gives another one,
        which yields (first row, end, scores) for blocks of a text column."""
        hit = np.flatnonzero(self.weights).astype(np.int32)
        values, bias = self.weights[hit], self.bias

        def begin():
            weights = np.zeros(1 << BUCKET_BITS, np.float32)
            weights[hit] = values
            local = ToxicityModel(weights, bias)
            known = WordTable(lambda words: np.stack(local.word_scores(words), axis=1), 2, CACHE_WORDS)

            def scores(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
                for low, high, texts in text_blocks(column, BLOCK_BYTES):
                    sums = np.array([r.sum(0) for r in known.rows([split_words(t or b"") for t in texts])])
                    yield low, high, _sigmoid(bias + sums[:, 0] / np.maximum(sums[:, 1], 1))

            return scores

        return begin


def telling(spread: np.ndarray, totals: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Which table rows to train, from how many texts of each label have them: (2, rows) and (2,).

    Those whose presence differs between the labels by ``least`` standard errors;
    in a small sample, where none can, by half of what the most telling one has.
    """
    both = spread.sum(0) / max(totals.sum(), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.abs(np.nan_to_num((spread[1] / totals[1] - spread[0] / totals[0]) / np.sqrt(both * (1 - both) * (1 / totals).sum()), posinf=0, neginf=0))
    return z >= max(min(least, z.max(initial=0) / 2), 1e-9)


def step(mean: np.ndarray, out: np.ndarray, bias: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(loss, gradients of the texts' averages, of ``out`` and of ``bias``) of the mean cross entropy of a batch."""
    logit = mean @ out + bias
    p = np.exp(logit - logit.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    at = np.arange(len(y))
    loss = float(-np.log(np.maximum(p[at, y], 1e-30)).mean())
    p[at, y] -= 1
    p /= len(y)
    return loss, p @ out.T, mean.T @ p, p.sum(0)


def averages(rows: list[tuple[np.ndarray, np.ndarray]], emb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(averages, ids, shares, text of each id) of a batch of (ids, shares)."""
    ids, share = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    mean = np.stack([np.bincount(doc, weights=emb[ids, k] * share, minlength=len(rows)) for k in range(emb.shape[1])], axis=1)
    return mean.astype(np.float32), ids, share, doc


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = 10, rate: float = 0.2, scale: float = 40.0, decay: float = 1e-5, seed: int = 5) -> ToxicityModel:
    """Train embeddings and softmax jointly by Adagrad over minibatches.

    ``rows`` has (ids, shares) for each text, of the table rows to train.  ``scale``
    multiplies averages, as a few words must be able to decide a text.  Without
    rows of both labels every score is near 0 or 1, as the rows there are say, or
    near 0 without rows.
    """
    y = np.array(labels, np.int64)
    size = 1 << BUCKET_BITS
    if len(set(labels)) < 2:
        return ToxicityModel(np.zeros(size, np.float32), 20.0 if 1 in labels else -20.0)
    # the table has the rows in use only
    used = np.unique(np.concatenate([ids for ids, _ in rows]))
    rows = [(np.searchsorted(used, ids), (share * scale).astype(np.float32)) for ids, share in rows]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.05, (len(used), DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
    g_emb, g_out, g_bias = np.full(len(used), 1e-6, np.float32), np.full(out.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            mean, ids, share, doc = averages([rows[i] for i in batch], emb)
            _, back, d_out, d_bias = step(mean, out, bias, y[batch])
            here, where = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(where, weights=back[doc, k] * share, minlength=len(here)) for k in range(DIM)], axis=1).astype(np.float32) + decay * emb[here]
            g_emb[here] += (grad**2).mean(1)
            emb[here] -= now * grad / np.sqrt(g_emb[here])[:, None]
            d_out = d_out + decay * out
            g_out += d_out**2
            out -= now * d_out / np.sqrt(g_out)
            g_bias += d_bias**2
            bias -= 0.1 * now * d_bias / np.sqrt(g_bias)
    weights = np.zeros(size, np.float32)
    weights[used] = emb @ (out[:, 1] - out[:, 0]) * scale
    return ToxicityModel(weights, float(bias[1] - bias[0]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, ids, shares) of (y, text)."""
    for batch in batches:
        for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
            ids, shares = zip(*(text_features(t or b"") for t in texts))
            lists = [pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *lists], ["y", "ids", "shares"])


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of each label have each table row, of one task."""
    found, totals = np.zeros((2, 1 << BUCKET_BITS), np.int32), np.zeros(2, np.int64)
    for batch in batches:
        for y, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            found[y, ids.values.to_numpy()] += 1
            totals[y] += 1
    if totals.any():
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary()), pa.array([totals.tobytes()], pa.binary())], ["found", "totals"])


def _only(mask: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, ids, shares in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                at, share = ids.values.to_numpy(), shares.values.to_numpy()
                out.append({"y": y, "ids": at[mask[at]].tobytes(), "shares": share[mask[at]].tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("y", pa.int32()), ("ids", pa.binary()), ("shares", pa.binary())]))

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = SAMPLE_PER_LABEL,
) -> ToxicityModel:
    """Fit a model on a bounded sample of labelled rows that aren't held out.

    Of each label the ``per_label`` identifiers with the smallest hash are taken
    from ``labels`` alone, so documents are only scanned, not shuffled; the bias
    is corrected to the share that label 1 has among all labelled rows.  Rows
    with a null label or identifier are left out; of labels that contradict each
    other the largest holds, and rows of documents that repeat an identifier count
    each, up to twice ``per_label`` in all.  Empty tables give a model without
    weights.  Texts stay on the executors: the driver gets, for each text, the
    share of the table rows that are trained.
    """
    known = durable(
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (crc_mod4("id") != 2))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    order = F.xxhash64("id")
    # at most ``per_label`` numbers of each label
    picked = [known.filter(F.col("y") == y).orderBy(order, "id").limit(per_label) for y in (0, 1)]
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked[0].unionAll(picked[1])), "id")
    first = sample.select("y", "text", order.alias("o"), "id", F.xxhash64("text").alias("h")).orderBy("o", "id", "h").limit(2 * per_label)
    rows = durable(first.select("y", "text").mapInArrow(_features, "y int, ids array<int>, shares array<float>"))
    found, totals = np.zeros((2, 1 << BUCKET_BITS), np.int64), np.zeros(2, np.int64)
    for r in rows.select("y", "ids").coalesce(8).mapInArrow(_presence, "found binary, totals binary").collect():
        found += np.frombuffer(r.found, np.int32).reshape(2, -1)
        totals += np.frombuffer(r.totals, np.int64)
    mask = telling(found, totals) if totals.all() else np.zeros(1 << BUCKET_BITS, bool)
    taken = rows.mapInArrow(_only(mask), "y int, ids binary, shares binary").collect()
    model = fit([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.shares, np.float32)) for r in taken], [r.y for r in taken])
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) == 2 and totals.all():
        model.bias += float(np.log(counts[1] / counts[0]) - np.log(totals[1] / totals[0]))
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, score, predicted) for every row, from its whole text alone.

    A null or empty text, or one without words, gets the score of the bias; rows
    that repeat get the same score each; an empty table gives an empty one.
    """
    begin = model.scorer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = begin()
        for batch in batches:
            for low, high, s in scores(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int")
    return scored.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays under ``threshold``, with all their columns; repeats share their fate."""
    begin = model.scorer()
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = begin()
        for batch in batches:
            for low, high, s in scores(batch.column(where)):
                yield batch.slice(low, high - low).filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
