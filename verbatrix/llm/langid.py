"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability in a language is the sum over all ways to cut it into
pieces, which a forward algorithm gives; a text's is the product over its words.
Probabilities are learned by expectation maximisation over the same lattices.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordTable, crc_mod4, durable, text_blocks
from .sentencepiece_fst import DEFAULT_MODEL, NORMAL, SPACE, _fields
from .toxicity import split_words

#: Bound, in expectation, of the sample of documents of each language that is learned from.
SAMPLE_PER_LANG = 600
#: Bounds of what is learned from the sample: distinct words of a language (the most frequent
#: ones), those of all languages together, characters of a word, and languages (those of most documents).
WORDS_PER_LANG, WORDS_IN_ALL, LEARNED_WORD, MAX_LANGS = 30_000, 400_000, 1024, 400
ROUNDS, SMOOTHING, UNKNOWN = 4, 0.05, 1e-7
#: Words up to this length are summed in plain numbers, scaled by SCALE for each character;
#: longer ones in logarithms, in windows of WINDOW characters.
SHORT, SCALE, WINDOW = 64, 1e3, 1024
#: Scores and bytes of words that a worker holds.
CACHE_VALUES, BLOCK_BYTES = 1 << 20, 1 << 20
UNDETERMINED = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = re.compile(r"[^\W\d_]")


def vocabulary(path: str = DEFAULT_MODEL) -> list[str]:
    """The vocabulary's pieces, lower-cased and sorted."""
    with open(path, "rb") as f:
        data = f.read()
    entries = (dict(_fields(v)) for number, v in _fields(data) if number == 1)
    pieces = {e[1].decode().lower() for e in entries if e.get(3, NORMAL) == NORMAL}
    return sorted(p for p in pieces if p)


@dataclass
class Pieces:
    """A vocabulary to look runs of characters up in: sorted hashes, their numbers, and the longest length."""

    keys: np.ndarray
    ids: np.ndarray
    longest: int
    lengths: np.ndarray

    @classmethod
    def of(cls, pieces: list[str]) -> Pieces:
        keys = np.array([int(_hash(p)) for p in pieces], np.uint64)
        order = np.argsort(keys)
        return cls(keys[order], order, max(map(len, pieces), default=1), np.array([*map(len, pieces), 1]))


def _mix(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    h = (h ^ codes) * _BASE
    return h ^ h >> np.uint64(32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _hash(piece: str) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for code in _codes(piece):
        h = _mix(h, code)
    return h[0]


class Lattice:
    """All arcs (piece, word, start, end) of a list of words over a vocabulary.

    A character that begins no arc of its own gets an arc of piece -1.
    """

    def __init__(self, words: list[str], pieces: Pieces):
        self.n = len(words)
        codes = _codes("".join(words))
        sizes = np.fromiter(map(len, words), np.int64, self.n)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(self.n), sizes)
        place = np.arange(len(codes)) - begin[owner]
        left = sizes[owner] - place
        keys, ids, parts, h = pieces.keys, pieces.ids, [], np.zeros(len(codes), np.uint64)
        for length in range(1, pieces.longest + 1):
            if len(codes) < length:
                break
            h = _mix(h[: len(codes) - length + 1], codes[length - 1 :])
            at = np.flatnonzero(left[: len(h)] >= length)
            if not len(at):
                break
            here = h[at]
            found = np.minimum(np.searchsorted(keys, here), max(len(keys) - 1, 0))
            hit = keys[found] == here if len(keys) else np.zeros(len(here), bool)
            piece = np.where(hit, ids[found] if len(keys) else -1, -1)
            use = hit | (length == 1)
            parts.append((piece[use], owner[at[use]], place[at[use]], np.full(use.sum(), length)))
        self.piece, self.word, self.start, length = (np.concatenate(x).astype(np.int32) for x in zip(*parts)) if parts else [np.zeros(0, np.int32)] * 4
        self.end = self.start + length
        order = np.lexsort((self.word, self.end))
        self.piece, self.word, self.start, self.end = (x[order] for x in (self.piece, self.word, self.start, self.end))
        self.size = sizes
        self.longest = int(sizes.max(initial=0))

    def forward(self, weights: np.ndarray, begin: np.ndarray | None = None, log: bool = False) -> np.ndarray:
        """(longest + 1, words, languages): the sum over all paths to each place; row -1 of ``weights`` is the fallback's.

        ``begin`` are the sums at the first places, if they are known.
        """
        add, times, none = (np.logaddexp, np.add, -np.inf) if log else (np.add, np.multiply, 0.0)
        alpha = np.full((self.longest + 1, self.n, weights.shape[1]), none)
        alpha[0] = 0 if log else 1
        known = 1 if begin is None else len(begin)
        if begin is not None:
            alpha[:known] = begin
        cuts = np.searchsorted(self.end, np.arange(self.longest + 2))
        for e in range(known, self.longest + 1):
            a = slice(cuts[e], cuts[e + 1])
            word = self.word[a]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            alpha[e, word[first]] = add.reduceat(times(alpha[self.start[a], word], weights[self.piece[a]]), first, axis=0)
        return alpha

    def backward(self, weights: np.ndarray, log: bool = False) -> np.ndarray:
        """(longest + 1, words): the sum over all paths from each place to the end, in one language."""
        add, times, none = (np.logaddexp, np.add, -np.inf) if log else (np.add, np.multiply, 0.0)
        beta = np.full((self.longest + 1, self.n), none)
        beta[self.size, np.arange(self.n)] = 0 if log else 1
        order = np.lexsort((self.word, self.start))
        piece, word, start, end = (x[order] for x in (self.piece, self.word, self.start, self.end))
        cuts = np.searchsorted(start, np.arange(self.longest + 1))
        for s in range(self.longest - 1, -1, -1):
            a = slice(cuts[s], cuts[s + 1])
            first = np.flatnonzero(np.diff(word[a], prepend=-1))
            if len(first):
                at = s, word[a][first]
                beta[at] = add(beta[at], add.reduceat(times(beta[end[a], word[a]], weights[piece[a]]), first))
        return beta

    def expected(self, p: np.ndarray, times: np.ndarray, pieces: Pieces, log: bool) -> np.ndarray:
        """How often each piece is used in all segmentations, weighed by their probabilities."""
        w = np.log(p) if log else p * SCALE**pieces.lengths
        alpha, beta = self.forward(w[:, None], log=log)[:, :, 0], self.backward(w, log)
        total, known = alpha[self.size, np.arange(self.n)], self.piece >= 0
        ends = alpha[self.start, self.word], beta[self.end, self.word]
        if log:
            share = np.exp(ends[0] + w[self.piece] + ends[1] - total[self.word])
        else:
            share = ends[0] * w[self.piece] * ends[1] / total[self.word]
        return np.bincount(self.piece[known], weights=(share * times[self.word])[known], minlength=len(p) - 1)


def learn(counts: dict[str, int], pieces: Pieces, rounds: int = ROUNDS) -> np.ndarray:
    """The probabilities of the pieces, the fallback's last, by expectation maximisation over counted words."""
    words = sorted(counts, key=lambda w: (len(w), w))
    short = sum(len(w) <= SHORT for w in words)
    groups = [(words[:short], False)] if short else []
    groups += [(words[low : low + 128], True) for low in range(short, len(words), 128)]
    lattices = [(Lattice(group, pieces), np.array([counts[w] for w in group], float), log) for group, log in groups]
    n = len(pieces.ids)

    def normal(expected: np.ndarray) -> np.ndarray:
        return np.append((expected + SMOOTHING) / (expected.sum() + SMOOTHING * n), UNKNOWN)

    p = normal(sum((np.bincount(x.piece[x.piece >= 0], weights=times[x.word][x.piece >= 0], minlength=n) for x, times, _ in lattices), np.zeros(n)))
    for _ in range(rounds):
        p = normal(sum((x.expected(p, times, pieces, log) for x, times, log in lattices), np.zeros(n)))
    return p


def marked(word: bytes) -> str:
    """A word as the lattice reads it: with the mark of a word's beginning."""
    return SPACE + word.decode("utf-8", "replace")


@dataclass
class LanguageModel:
    """``langs`` in order of code points, and a row of their probabilities for each piece, the fallback's last."""

    langs: list[str]
    pieces: Pieces
    weights: np.ndarray

    def __post_init__(self):
        self.scaled = self.weights * (SCALE**self.pieces.lengths)[:, None]

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """The log probability of each word in each language, over all segmentations of the whole word."""
        out, texts = np.zeros((len(words), len(self.langs))), list(map(marked, words))
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        short = sum(len(t) <= SHORT for t in texts)
        # sums of so many words at a time, however many languages there are
        some = max(1, 2 * CACHE_VALUES // ((SHORT + 1) * max(len(self.langs), 1)))
        few = max(1, CACHE_VALUES // (WINDOW * max(len(self.langs), 1)))
        for low in range(0, short, some):
            group = order[low : min(low + some, short)]
            lattice = Lattice([texts[i] for i in group], self.pieces)
            last = lattice.forward(self.scaled)[lattice.size, np.arange(lattice.n)]
            out[group] = np.log(last) - lattice.size[:, None] * np.log(SCALE)
        for low in range(short, len(order), few):
            group = order[low : low + few]
            out[group] = self.long_scores([texts[i] for i in group])
        return out

    def long_scores(self, words: list[str]) -> np.ndarray:
        """The same in logarithms, a window of characters after the other; a window begins with
        the sums at the places where the window before it ended."""
        out, alive, at, begin, logs = np.zeros((len(words), len(self.langs))), np.arange(len(words)), 0, None, np.log(self.weights)
        while len(alive):
            lead = min(at, self.pieces.longest)
            lattice = Lattice([words[i][at - lead : at + WINDOW] for i in alive], self.pieces)
            alpha = lattice.forward(logs, begin, log=True)
            over = np.array([len(words[i]) <= at + WINDOW for i in alive])
            ended = np.flatnonzero(over)
            out[alive[ended]] = alpha[lattice.size[ended], ended]
            alive, at = alive[~over], at + WINDOW
            lead = min(at, self.pieces.longest)
            begin = alpha[len(alpha) - 1 - lead :, ~over]
        return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): the words of (lang, text), counted in blocks; those of over LEARNED_WORD characters aren't learned from."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for low, _, texts in text_blocks(batch.column(1), BLOCK_BYTES):
            counts = Counter()
            for k, t in enumerate(texts):
                counts.update((langs[low + k], w) for w in map(marked, split_words(t or b"")) if len(w) <= LEARNED_WORD)
            if counts:
                pairs = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs]), pa.array([w for _, w in pairs]), pa.array([counts[x] for x in pairs])], ["lang", "word", "n"])


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    model: str = DEFAULT_MODEL,
    per_lang: int = SAMPLE_PER_LANG,
) -> LanguageModel:
    """Learn from a sample of the rows that aren't held out and have a language and an identifier.

    Of each language a row is taken if its identifier's hash is below
    ``per_lang`` / (rows of that language): one pass, no sorting; rows that repeat
    count each.  Words are counted where they are; the driver gets each language's
    most frequent ones, of equal counts those of the least hash.  Without rows the
    model has no language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & (crc_mod4("id") != 2))
    langs = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGS).collect())
    pieces = Pieces.of(vocabulary(model))
    if not langs:
        return LanguageModel([], pieces, np.zeros((len(pieces.ids) + 1, 0)))
    # at most MAX_LANGS rows
    shares = docs.sparkSession.createDataFrame([(lang, per_lang / n) for lang, n in langs], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(shares), "lang").filter(draw < F.col("share"))
    counted = sample.select("lang", "text").mapInArrow(_counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), F.xxhash64("word"), "word"))
    most = min(WORDS_PER_LANG, WORDS_IN_ALL // len(langs))
    counts: dict[str, dict[str, int]] = {lang: {} for lang, _ in langs}
    for r in counted.withColumn("place", place).filter(F.col("place") <= most).select("lang", "word", "n").collect():
        counts[r.lang][r.word] = r.n
    columns = [learn(counts[lang], pieces) for lang, _ in langs]
    return LanguageModel([lang for lang, _ in langs], pieces, np.stack(columns, axis=1))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row, from its whole text alone.

    ``score`` is the language's share of the probability over all languages, all
    equally likely before.  A null text, one without a letter, or a model without
    languages gives ``und`` and 0; of equal scores the first language wins.  Rows
    that repeat are scored each, an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = WordTable(model.word_scores, len(model.langs), CACHE_VALUES // max(len(model.langs), 1))
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                part = [(t or b"").decode() for t in texts]
                names, scores = [], []
                for t, rows in zip(part, known.rows([split_words(t or b"") for t in texts])):
                    if not model.langs or not any(m[0].isalpha() for m in _LETTER.finditer(t)):
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    z = rows.sum(0)
                    best = int(np.argmax(z))
                    names.append(model.langs[best])
                    scores.append(float(1 / np.exp(z - z[best]).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
