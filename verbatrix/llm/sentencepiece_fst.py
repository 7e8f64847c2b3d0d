"""SentencePiece encoding and decoding with a weighted finite-state transducer.

A model file is compiled to a transducer: the normaliser (its character map,
escaped spaces and a prefix), an arc for every piece, and byte arcs for
characters that no piece has.
Composed with a text it gives a lattice, whose shortest path in the tropical
semiring (weights add along a path, the least total wins) is the encoding.

For a unigram model an arc weighs its negative log probability.  A merge (BPE)
model has no such weights: there a second acceptor is composed in, whose states
are the last piece and which admits only pairs of neighbours that merging would
leave as they are.  A sequence of pieces is the outcome of merging exactly if
all its neighbours are such pairs, so one path is left to every position.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks that a worker holds the encodings of, and pairs whose merging it knows.
CACHE_CHUNKS, CACHE_PAIRS, LONGEST_CACHED = 150_000, 300_000, 64
#: Alphabets that texts are cut by; more would take longer to tell apart.
ALPHABETS = 16
#: Characters of a text whose chunks are held together.
LONGEST_SPLIT = 1 << 20
BLOCK_BYTES = 1 << 20
_INF = float("inf")
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


def character_map(data: bytes) -> dict[str, str]:
    """What a normaliser's compiled character map replaces, and by what.

    The map is a trie in a double array: a unit has a label, an offset to its
    children and whether a value follows; values are places of strings that end
    in a zero byte.  The trie is walked a level at a time.
    """
    size = int.from_bytes(data[:4], "little")
    units, strings = np.frombuffer(data, "<u4", size // 4, 4).astype(np.int64), data[4 + size :]
    places, prefixes, out, labels = np.zeros(1, np.int64), [b""], {}, np.arange(1, 256)
    while len(places):
        unit = units[places]
        base = places ^ (unit >> 10 << ((unit & 512) >> 6))
        children = base[:, None] ^ labels
        there = units[np.minimum(children, len(units) - 1)]
        rows, which = np.nonzero((children < len(units)) & (there & 0x800000FF == labels))
        places, prefixes = children[rows, which], [prefixes[r] + bytes([c]) for r, c in zip(rows.tolist(), labels[which].tolist())]
        unit = units[places]
        for k in np.flatnonzero(unit >> 8 & 1).tolist():
            at = int(units[places[k] ^ (unit[k] >> 10 << ((unit[k] & 512) >> 6))]) & 0x7FFFFFFF
            out[prefixes[k].decode("utf-8", "replace")] = strings[at : strings.index(b"\0", at)].decode("utf-8", "replace")
    return out


class Memo(dict):
    """A dict that computes what is missing and holds two generations of ``most`` / 2 entries."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.half, self.old = compute, most // 2, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.compute(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceTransducer:
    """Encodes and decodes as the model file says."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.types = [], [], []
        trainer, normaliser = {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = {1: b"", 3: NORMAL} | dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                self.types.append(f[3])
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models can be compiled")
        self.map = character_map(normaliser[2]) if normaliser.get(2) else {}
        #: For a first character, how long what is replaced there can be.
        self.reach: dict[str, int] = {}
        for key in self.map:
            self.reach[key[0]] = max(self.reach.get(key[0], 0), len(key))
        self.prefix, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER_DEFINED)}
        self.unknown = self.types.index(UNKNOWN)
        of_bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.byte_ids = [of_bytes[b] for b in range(256)] if len(of_bytes) == 256 else None
        # no piece has a space after another character: texts can be cut before runs of spaces
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.whole = inner or self.kind == UNIGRAM and any("\n" in p for p in self.ids)
        broken = any("\n" in p for p in self.ids)
        if self.kind == BPE:
            self.chunk = re.compile("".join(f"{SPACE}*[{g}]+|" for g in self._alphabets()) + f"{SPACE}*[^{SPACE}]|{SPACE}+")
        else:
            self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if broken else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0)
        if self.kind == BPE:
            self._compile_merges()
        else:
            self.ids_made = self.ids
        self._compile_arcs()
        self.consistent = Memo(self._consistent, CACHE_PAIRS)
        self.encoded: dict[str, bytes] = {}
        self.text_of = [self._text_of(i) for i in range(len(self.pieces))]

    def _alphabets(self) -> list[str]:
        """Characters that stand beside others in pieces, as the insides of character classes: no piece has some of two.

        No merge crosses from one to another, nor to or from a character that is in
        none, so texts can be cut there.  The largest comes first, the smallest are one.
        """
        group: dict[str, set[str]] = {}
        for piece in self.ids:
            chars = piece.lstrip(SPACE)
            known = [group.get(c) for c in chars]
            if len(chars) > 1 and any(g is None or g is not known[0] for g in known):
                joined = set(chars).union(*filter(None, known))
                group.update(dict.fromkeys(joined, joined))
        groups = sorted({id(g): g for g in group.values()}.values(), key=lambda g: (-len(g), min(g)))
        groups[ALPHABETS:] = [set().union(*groups[ALPHABETS:])] if groups[ALPHABETS:] else []
        return ["".join(map(re.escape, sorted(g))) for g in groups]

    # normaliser

    def mapped(self, text: str) -> str:
        """``text`` through the character map: the longest that is replaced at each place, from the left."""
        reach, out, done, at = self.reach, [], 0, 0
        if not reach or reach.keys().isdisjoint(text):
            return text
        while at < len(text):
            for n in range(min(reach.get(text[at], 0), len(text) - at), 0, -1):
                new = self.map.get(text[at : at + n])
                if new is not None:
                    out += (text[done:at], new)
                    at = done = at + n
                    break
            else:
                at += 1
        out.append(text[done:])
        return "".join(out)

    def normalise(self, text: str) -> str:
        text = self.mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    # arcs

    def _compile_arcs(self) -> None:
        """The automaton of all pieces: a state is the longest beginning of a piece that a text read so far ends in.

        ``steps`` leads to longer beginnings and ``shorter`` to the next one that the
        text ends in too; ``ending`` has (length, piece) of the pieces it ends in, the
        longest first.
        """
        nothing: dict[str, int] = {}
        self.steps, self.shorter, self.ending = [{}], [0], [()]
        level = [(0, sorted(filter(None, self.ids_made)), 0)]
        while level:
            below = []
            for state, pieces, depth in level:
                first, at = 0, depth + 1
                while first < len(pieces):
                    char, end = pieces[first][depth], first + 1
                    while end < len(pieces) and pieces[end][depth] == char:
                        end += 1
                    back = self.shorter[state]
                    while back and char not in self.steps[back]:
                        back = self.shorter[back]
                    back, new = self.steps[back].get(char, 0) if state else 0, len(self.steps)
                    whole = len(pieces[first]) == at
                    self.steps[state][char] = new
                    self.steps.append(nothing if whole and end - first == 1 else {})
                    self.shorter.append(back)
                    self.ending.append(((at, self.ids_made[pieces[first]]), *self.ending[back]) if whole else self.ending[back])
                    if end - first > whole:
                        below.append((new, pieces[first + whole : end], at))
                    first = end
            level = below

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode()) if self.byte_ids else (self.unknown,)

    def merged(self, text: str) -> list[int]:
        """The encoding by merging itself: the best neighbours first, the leftmost of equals.

        Neighbours wait in a heap and those that are gone are passed over, so a text
        of any length takes little more than linear time.
        """
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if both in self.ids:
                    heapq.heappush(heap, (-self.scores[self.ids[both]], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            k = after[i]
            if parts[i] is None or k >= len(parts) or parts[i] + parts[k] != both:
                continue
            parts[i], parts[k], after[i] = both, None, after[k]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [i for p in parts if p is not None for i in ((self.ids[p],) if p in self.ids else self.fallback(p))]

    def _compile_merges(self) -> None:
        """How every piece was merged last, and which pieces merging can make at all.

        A piece is regular if every merge on the way to it is better than the next
        one, as training leaves it; pairs of regular pieces can be judged by undoing
        merges, other pairs only by merging.
        """
        self.halves, self.regular, made = {}, set(), {}
        for piece in sorted(self.ids, key=len):
            i = self.ids[piece]
            if len(piece) == 1:
                self.halves[i] = None
                self.regular.add(i)
                made[piece] = i
                continue
            split = self._last_merge(piece)
            if split is None:
                continue
            made[piece] = i
            left, right = self.ids[piece[:split]], self.ids[piece[split:]]
            self.halves[i] = (left, right)
            if {left, right} <= self.regular and all(self.halves[k] is None or self.scores[k] > self.scores[i] for k in (left, right)):
                self.regular.add(i)
        self.ids_made = made

    def _last_merge(self, piece: str) -> int | None:
        """Where the two parts meet that merging ``piece`` leaves last; None if it doesn't end in one part."""
        parts, scores, ids = list(piece), self.scores, self.ids
        if not all(p in ids for p in parts):
            return None
        while len(parts) > 2:
            best, at = -_INF, -1
            for i in range(len(parts) - 1):
                joined = ids.get(parts[i] + parts[i + 1])
                if joined is not None and scores[joined] > best:
                    best, at = scores[joined], i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts[0])

    def _consistent(self, pair: int) -> bool:
        """Whether merging leaves the boundary between two pieces, the first times the number of pieces plus the second, as it is.

        Undoes the merges next to the boundary, the latest first.  While two
        symbols stood there, they would have merged if that is better than the
        merge that took one of them away; on the left side an equal one came first.
        """
        a, b = divmod(pair, len(self.pieces))
        if a not in self.regular or b not in self.regular:
            return self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        ids, pieces, scores, halves = self.ids, self.pieces, self.scores, self.halves
        limit, by_left = -_INF, False
        while True:
            across = ids.get(pieces[a] + pieces[b])
            if across is not None and (scores[across] > limit or scores[across] == limit and not by_left):
                return False
            left, right = halves[a], halves[b]
            if left is None and right is None:
                return True
            # of equal merges the left one came first, so the right one is undone first
            by_left = right is None or left is not None and scores[a] < scores[b]
            if by_left:
                limit, a = scores[a], left[1]
            else:
                limit, b = scores[b], right[0]

    # shortest path

    def _paths(self, texts: list[str]) -> Iterator[list[int] | None]:
        """For each text the output of the shortest path through it composed with the transducer; None if there is none.

        ``last`` has the piece before each position on its best path: -1 for the
        start or a fallback character, -2 where no path leads.  What is known of
        the positions that a text shares with the one before stays, so sorted
        texts are walked like a tree of their beginnings.
        """
        steps, shorter, ending, scores, rare = self.steps, self.shorter, self.ending, self.scores, 10.0 - self.least
        consistent, many = self.consistent if self.kind == BPE else None, len(self.pieces)
        cost, last, back, states, shown = [0.0], [-1], [0], [0], ""
        for text in texts:
            size, same = len(text), 0
            for x, y in zip(shown, text):
                if x != y:
                    break
                same += 1
            del cost[same + 1 :], last[same + 1 :], back[same + 1 :], states[same + 1 :]
            shown, state = text, states[same]
            for end, char in enumerate(text[same:] if same else text, same + 1):
                while (step := steps[state].get(char)) is None and state:
                    state = shorter[state]
                state = step or 0
                best, chosen, origin, arcs = _INF, -2, 0, ending[state]
                for length, piece in arcs:
                    before = last[end - length]
                    if before == -2:
                        continue
                    if consistent is not None:
                        if before < 0 or consistent[before * many + piece]:
                            origin = end - length
                            best, chosen = cost[origin] - scores[piece], piece
                            break  # there is no other
                    elif cost[end - length] - scores[piece] < best:
                        origin = end - length
                        best, chosen = cost[origin] - scores[piece], piece
                if not (arcs and arcs[-1][0] == 1) and last[end - 1] != -2 and cost[end - 1] + rare < best:
                    best, chosen, origin = cost[end - 1] + rare, -1, end - 1
                cost.append(best)
                last.append(chosen)
                back.append(origin)
                states.append(state)
            if last[size] == -2:
                yield None
                continue
            out, end = [], size
            while end:
                out += (last[end],) if last[end] >= 0 else self.fallback(text[end - 1])[::-1]
                end = back[end]
            out.reverse()
            yield out

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        for text, path in zip(texts, self._paths(texts)):
            yield array("i", self.merged(text) if path is None else path).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The piece ids of each text as little-endian 32-bit numbers.

        Chunks that aren't known yet are encoded together, in order; what is known
        is dropped when it is too much, so memory doesn't grow with the texts.
        """
        out = self._encode_all(list(map(self.normalise, texts)))
        if self.byte_ids:
            return out
        # unknown characters that follow each other are one piece
        ids = [np.frombuffer(x, "<i4") for x in out]
        return [x[(x != self.unknown) | (np.concatenate([[-1], x[:-1]]) != self.unknown)].tobytes() if len(x) else b"" for x in ids]

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [next(self._encoded([t])) if t else b"" for t in texts]
        if any(len(t) > LONGEST_SPLIT for t in texts):
            return [b"".join(self._joined([c])[0] for c in self._parts(t)) for t in texts]
        return self._joined(list(map(self.chunk.findall, texts)))

    def _parts(self, text: str) -> Iterator[tuple[str, ...]]:
        """The chunks of ``text``, some at a time, so those of a long text are never held together."""
        return batched((m[0] for m in self.chunk.finditer(text)), 1 << 16)

    def _joined(self, split: list[list[str]]) -> list[bytes]:
        """The encodings of texts, given as their chunks."""
        known, wanted = self.encoded, set().union(*split)
        new = wanted.difference(known)
        long = {c for c in new if len(c) > LONGEST_CACHED}
        new = sorted(new - long if long else new)
        if len(known) + len(new) > CACHE_CHUNKS:
            # of what is known, what is in these texts is likely frequent
            known = self.encoded = {c: known[c] for c in wanted if c in known}
        known.update(zip(new, self._encoded(new)))
        if not long:
            return [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        return [b"".join(next(self._encoded([c])) if c in long else known[c] for c in chunks) for chunks in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _text_of(self, i: int) -> bytes:
        kind = self.types[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def decode(self, ids: bytes) -> str:
        """The text of piece ids, given as ``encode`` returns them; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(model: bytes) -> PieceTransducer:
    return PieceTransducer(model)


def _model(df: DataFrame, path: str):
    """The model's bytes as a broadcast; the driver reads them, so executors need no file."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _free(df: DataFrame, name: str, replaced: str) -> None:
    if name.lower() in {c.lower() for c in df.columns if c != replaced}:
        raise ValueError(f"there is a column {name} already")


def _lists(encoded: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "piece_ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """``docs`` with ``out_col`` (array<int>) in the place of ``text_col``; null text counts as empty and has no pieces.

    Rows that repeat are encoded each, an empty table stays one; another column
    of the name ``out_col`` is an error.
    """
    _free(docs, out_col, text_col)
    shared, at = _model(docs, model), docs.columns.index(text_col)
    fields = [f"`{c}` {t}" for c, t in docs.dtypes]
    fields[at] = f"`{out_col}` array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compiled(shared.value)
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(at), BLOCK_BYTES):
                ids = _lists(made.encode_all([(t or b"").decode() for t in texts]))
                yield batch.slice(low, high - low).set_column(at, out_col, ids)

    return docs.mapInArrow(run, ", ".join(fields))


def decode(df: DataFrame, ids_col: str = "piece_ids", out_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """``df`` with the decoded text in the place of ``ids_col``; null counts as no pieces, ids must be the model's.

    Another column of the name ``out_col`` is an error.
    """
    _free(df, out_col, ids_col)
    shared, at = _model(df, model), df.columns.index(ids_col)
    fields = [f"`{c}` {t}" for c, t in df.dtypes]
    fields[at] = f"`{out_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compiled(shared.value)
        for batch in batches:
            texts = [made.decode(ids.values.to_numpy().astype("<i4").tobytes() if ids.is_valid else b"") for ids in batch.column(at)]
            yield batch.set_column(at, out_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, ", ".join(fields))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """(id_col, n_pieces, ids_sha256, decoded_equal) for every row: encoded, decoded and compared in one pass.

    ``ids_sha256`` is of the ids as little-endian 32-bit numbers.  Null text counts
    as empty; rows that repeat count each.  Texts that have U+2581 themselves don't come back equal, as the
    model writes a space so; all others do.
    """
    shared = _model(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compiled(shared.value)
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                part = [(t or b"").decode() for t in texts]
                made_ids = made.encode_all(part)
                columns = [
                    pa.array([len(ids) // 4 for ids in made_ids], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids in made_ids], pa.string()),
                    pa.array([made.decode(ids) == t for ids, t in zip(made_ids, part)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], ["id", "n_pieces", "ids_sha256", "decoded_equal"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_pieces bigint, ids_sha256 string, decoded_equal boolean").withColumnRenamed("id", id_col)
