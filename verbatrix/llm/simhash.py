"""SimHash fingerprints and near-duplicate groups by pigeonring filtering.

A fingerprint is 64 majority votes of the hashes of all word shingles of a text.
Fingerprints link when they differ in few bits.  Candidates come from the
pigeonring principle: lay the bits out as a ring of segments; whatever the
differences, from some start every chain of consecutive segments differs in no
more than its proportional share of the budget.  The longest chain whose share
is below one bit must be equal, which is a key to join on; the longer chains
prune what the key brings together, before the full distance is counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_name, durable, text_blocks

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = 5
SEED = 42
BLOCK_BYTES = 1 << 22
#: Edges up to this number (16 bytes each) are connected in one task.
ONE_TASK = 500_000
#: For groups by similarity: cells in which shingles are counted to order them (4 bytes
#: each), and how many of them one row of the counts holds.
CELL_BITS, SLICE = 20, 1 << 14
#: Texts that share a shingle up to this number are paired by a join, more of them in blocks.
PAIRWISE = 128
#: Shingles of one block about, and columns multiplied at a time.
BLOCK_SHINGLES, TILE = 1 << 17, 1 << 11
#: Shingles whose bits are unpacked at a time.
VOTE_BLOCK = 1 << 14


def shingle_hashes(text: bytes, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of all word ``n``-grams of a text, in blocks; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= n:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    ends = list(accumulate(map(len, words), lambda at, size: at + size + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    for low in range(0, len(words) - n + 1, VOTE_BLOCK):
        spans = zip(starts[low : low + VOTE_BLOCK], ends[low + n - 1 : low + n - 1 + VOTE_BLOCK])
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all ``hashes``; 0 if there are none."""
    votes, total = np.zeros(64, np.int64), 0
    for h in hashes:
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(2 * votes > total, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """The 64-bit fingerprint of UTF-8 ``text``, A-Z lower-cased; 0 if it has no word."""
    return majority(shingle_hashes(text, n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id_col, fp) for every row; ``fp`` is the fingerprint as a signed long.  Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                fps = np.array([fingerprint(t or b"", n) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(fps)], ["id", "fp"])

    if id_col.lower() == "fp":
        raise ValueError("an identifier named fp clashes with the fingerprint; rename it")
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")
    return out.withColumnRenamed("id", id_col)


def ring_cuts(m: int) -> list[int]:
    """Where ``m`` segments of nearly equal length cut a ring of 64 bits."""
    return [-(-64 * i // m) for i in range(m + 1)]


def _masks(m: int) -> list[int]:
    cuts = ring_cuts(m)
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def free_chain(max_bits: int, m: int) -> int:
    """The longest chain whose share of the budget is below one bit."""
    return max(length for length in range(m) if length * max_bits < m)


def halves(max_bits: int, m: int) -> list[tuple[int, int]]:
    """For every start, two masks of what follows the free chain as far as one bit is allowed.

    The longest chain whose share is below two bits may differ in one bit beyond
    its free beginning, so one half of the rest is equal.  (0, 0) where there is
    no such rest.
    """
    masks, free = _masks(m), free_chain(max_bits, m)
    longest = max(length for length in range(m) if length * max_bits < 2 * m)
    out = []
    for s in range(m):
        bits = [b for k in range(free, longest) for b in range(64) if masks[(s + k) % m] >> b & 1]
        cut = len(bits) // 2
        out.append((sum(1 << b for b in bits[:cut]), sum(1 << b for b in bits[cut:])))
    return out


def chain_keys(fp: Column, max_bits: int, m: int) -> Column:
    """For every start on the ring and each half of what follows the free chain, the bits that must be equal.

    Five segments and two bits give keys of 38 bits, so what a key brings together
    grows slowly even with billions of fingerprints.
    """
    masks, length = _masks(m), free_chain(max_bits, m)
    if length < 1:
        raise ValueError(f"{m} segments are too few for {max_bits} bits")
    free = [sum(masks[(s + k) % m] for k in range(length)) for s in range(m)]
    return F.array(*(fp.bitwiseAND(F.lit(_signed(free[s] | half))) for s, pair in enumerate(halves(max_bits, m)) for half in pair))


def first_start(differences: Column, max_bits: int, m: int) -> Column:
    """The first start whose chains of all lengths stay within their shares; null if none does."""
    each = [F.bit_count(differences.bitwiseAND(F.lit(_signed(mask)))) for mask in _masks(m)]
    out = F
    for s in range(m):
        total, within = F.lit(0), F.lit(True)
        for k in range(m):
            total = total + each[(s + k) % m]
            within = within & (total <= F.lit((k + 1) * max_bits // m))
        out = out.when(within, F.lit(s))
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, m: int = SEGMENTS) -> DataFrame:
    """(a, b): the pairs of different fingerprints, a < b, that differ in ``max_bits`` or fewer bits.

    ``fps`` has one row (fp) for each distinct fingerprint.  Every pair comes once,
    from the first start on the ring that admits it and its first half that is equal.
    """
    keyed = fps.select("fp", F.posexplode(chain_keys(F.col("fp"), max_bits, m)).alias("place", "key"))
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    second = F
    for s, (half, _) in enumerate(halves(max_bits, m)):
        second = second.when(F.col("place") < 2 * s + 2, x.bitwiseAND(F.lit(_signed(half))) != 0)
    place = 2 * first_start(x, max_bits, m) + second.cast("int")
    return (
        left.join(right, ["place", "key"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(x) <= max_bits) & (place == F.col("place")))
        .select("a", "b")
    )


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of one task, by union-find over numbered nodes."""
    parts = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in ends.reshape(2, -1).T.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    roots = nodes[[find(x) for x in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); ``root`` is the smallest node of its component.

    Up to ONE_TASK edges, which are counted first, one task does it.  Beyond,
    large-star and small-star steps alternate until the edges stay as they are,
    which takes few rounds however long the paths are.  Each step is a minimum by
    node and a join, so no neighbourhood is gathered in one place.
    """

    def rounds(e: DataFrame) -> tuple[int, int]:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(pairs: DataFrame) -> DataFrame:
        """(u, v, m): each directed edge with the least of u and all its neighbours.

        The least ones are written, so that the join can split a node of many neighbours over tasks.
        """
        least = durable(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        return pairs.join(least, "u")

    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = rounds(edges)
    if state[0] <= ONE_TASK:
        return durable(edges.coalesce(1).mapInArrow(_union, "node bigint, root bigint"))
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        edges = durable(
            small.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        )
        after = rounds(edges)
        if after == state:
            break
        state = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def classes(fps: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, component): ``fps`` has (fp, least), ``component`` is the least of a component."""
    roots = components(linked)
    named = roots.join(fps, roots["node"] == fps["fp"])
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    moved = named.join(least, "root").select(F.col("fp"), F.col("component"))
    return fps.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, max_bits: int = MAX_BITS, m: int = SEGMENTS
) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row.

    ``fingerprint`` is 16 lower-case hex digits and ``component_id`` the smallest
    id that can be reached over links of ``max_bits`` or fewer bits.  Equal texts
    share one fingerprint, so only distinct ones are linked.  Null, empty and
    wordless texts have fingerprint zero and link like any other; null ids are
    never a component's id, unless it has no other.  Rows that repeat are
    returned each; an empty table gives an empty one.
    """
    rows = durable(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", n))
    distinct = durable(rows.groupBy("fp").agg(F.min("id").alias("least")))
    # written, so that the join reads both sides from exchanges and a hot fingerprint's rows can be split over tasks
    named = durable(classes(distinct, links(distinct.select("fp"), max_bits, m)))
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def distinct_hashes(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return distinct_hashes(list(shingle_hashes(text, n)))


def set_node(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles, the same for equal sets."""
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED))


def cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _named(n: int):
    """(id, h, node, fp) for every row, and at the end of a task its counts of shingles by cell, in slices."""
    names = ["id", "h", "node", "fp", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(1 << CELL_BITS, np.int32), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for low, high, texts in text_blocks(batch.column(2), BLOCK_BYTES):
                hashes = [list(shingle_hashes(t or b"", n)) for t in texts]
                sets = [distinct_hashes(parts) for parts in hashes]
                np.add.at(counts, cells(np.concatenate(sets)), 1)
                fps = np.array([majority(parts) for parts in hashes], np.uint64).view(np.int64)
                nodes = [set_node(x) if len(x) else None for x in sets]
                size = high - low
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, size), batch.column(1).slice(low, size), pa.array(nodes, pa.int64()), pa.array(fps), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names
                )
        if kind is not None:
            for k, part in enumerate(counts.reshape(-1, SLICE)):
                if part.any():
                    empty = [pa.nulls(1, kind), *(pa.nulls(1, pa.int64()) for _ in range(3))]
                    yield pa.RecordBatch.from_arrays([*empty, pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names)

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, np.uint32)
    for part in table.column("counts"):
        total += np.frombuffer(part.as_py(), np.int32).astype(np.uint32)
    return pa.table({"slice": table.column("slice")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def cell_counts(written: DataFrame) -> np.ndarray:
    """How many texts have the shingles of each cell, of all texts; ``CELL_BITS`` bound its size."""
    out = np.zeros(1 << CELL_BITS, np.uint32).reshape(-1, SLICE)
    for r in written.filter("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInArrow(_summed, "slice int, counts binary").collect():
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


def _prefixes(n: int, similarity: float, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_blocks(batch.column(0), BLOCK_BYTES):
                sets = [x for x in (shingle_set(t or b"", n) for t in texts) if len(x)]
                firsts = []
                for x in sets:
                    length = len(x) - int(np.ceil(similarity * len(x) - 1e-6)) + 1
                    firsts.append(x[np.lexsort((x, counts[cells(x)]))[:length]].view(np.int64))
                columns = [pa.array([set_node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array(firsts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "size", "prefix"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, texts in text_blocks(batch.column(1), BLOCK_BYTES):
                values = [shingle_set(t or b"", n).view(np.int64) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(values, pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of every set of ``left`` with every one of ``right``."""
    out = np.zeros((len(left), len(right)), np.int32)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        rows, values = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        known = both[at] == values
        order = np.argsort(at[known], kind="stable")
        return at[known][order], rows[known][order]

    if not len(both):
        return out
    (at_l, rows_l), (at_r, rows_r) = places(left), places(right)
    for low in range(0, len(both), TILE):
        tiles = []
        for at, rows, size in ((at_l, rows_l, len(left)), (at_r, rows_r, len(right))):
            a, b = np.searchsorted(at, (low, low + TILE))
            tile = np.zeros((size, TILE), np.float32)
            tile[rows[a:b], at[a:b] - low] = 1
            tiles.append(tile)
        out += (tiles[0] @ tiles[1].T).astype(np.int32)
    return out


def _block_links(similarity: float):
    """The links between two blocks of sets (or within one), as a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        block, nodes = table.column("block").to_numpy(), table.column("node").to_numpy()
        shingles = table.column("shingles").combine_chunks()
        if isinstance(shingles, pa.ChunkedArray):
            shingles = pa.concat_arrays(shingles.chunks)
        flat, ends = shingles.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(shingles).to_numpy())
        sets = np.split(flat, ends[:-1])
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        at_x, at_y = np.flatnonzero(block == x), np.flatnonzero(block == y)
        edges = []
        if len(at_x) and len(at_y):
            size = np.diff(ends, prepend=0)
            both = shared_sizes([sets[i] for i in at_x], [sets[i] for i in at_y])
            linked = both >= similarity * (size[at_x][:, None] + size[at_y][None, :] - both)
            root = list(range(len(nodes)))

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k

            for i, j in np.argwhere(linked).tolist():
                a, b = find(int(at_x[i])), find(int(at_y[j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    edges.append((nodes[at_x[i]], nodes[at_y[j]]))
        a, b = zip(*edges) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def block_pairs(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, block) and (x, y): blocks of texts, and the pairs of them with a shingle of ``hot`` (token, node, n, size) in common.

    A text goes with those that share its most frequent shingle; blocks of one
    shingle are drawn by hash, so that each holds about BLOCK_SHINGLES.
    """
    keyed = durable(hot.groupBy("node").agg(F.max(F.struct("n", "token")).alias("k"), F.first("size").alias("size")).select("node", F.col("k.token").alias("key"), "size"))
    load = keyed.groupBy("key").agg(F.ceil(F.sum(F.col("size") + BLOCK_SHINGLES // 512) / BLOCK_SHINGLES).alias("chunks"))
    placed = durable(keyed.join(load, "key").select("node", F.xxhash64("key", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("block")))
    by_token = durable(hot.join(placed, "node").select("token", "block").distinct())
    left, right = by_token.withColumnRenamed("block", "x"), by_token.withColumnRenamed("block", "y")
    return placed, durable(left.join(right, "token").filter("x <= y").select("x", "y").distinct())


def linked_nodes(rows: DataFrame, max_bits: int = MAX_BITS, m: int = SEGMENTS) -> DataFrame:
    """(a, b), a < b: pairs of nodes of ``rows`` (node, fp) to verify, from the links of their fingerprints.

    Each node goes with the least one of its fingerprint, and that with the least
    one of the nearest fingerprint it links to, so there are no more pairs than
    twice the nodes, however many links a group has.
    """
    held = rows.filter("node IS NOT NULL").select("fp", "node").distinct()
    least = durable(held.groupBy("fp").agg(F.min("node").alias("least")))
    found = durable(links(least.select("fp"), max_bits, m))
    both = found.unionAll(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nearest = both.groupBy("a").agg(F.min(F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"), "b")).alias("k")).select("a", "k.b")
    x, y = least.select(F.col("fp").alias("a"), F.col("least").alias("x")), least.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    pairs = nearest.join(x, "a").join(y, "b").select("x", "y").unionAll(held.join(least, "fp").select(F.col("node").alias("x"), F.col("least").alias("y")))
    return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_pairs(docs: DataFrame, rows: DataFrame, counts: np.ndarray, id_col: str, text_col: str, n: int, similarity: float) -> DataFrame:
    """(a, b): pairs of nodes of ``rows`` (id, h, node, fp) that connect all texts of similarity ``similarity`` or more.

    First come the links of fingerprints, found by chains of ring segments and
    verified.  A similarity may lie beyond what fingerprints of few differing bits
    show, so an exact join by prefixes follows, which passes over the pairs that
    these connect.  All shingles have one order, from the rare to the
    frequent as ``counts`` has them (which matters to the effort only); two similar
    sets share a shingle among the first ``(1 - similarity) * size + 1`` of each.
    Pairs that share one of up to PAIRWISE texts are counted, and verified if the
    number of common ones leaves the similarity possible.  Texts that share a more
    frequent one are compared in blocks, each pair of blocks in one piece; of
    their links a spanning forest is kept.  Every verification is on the whole sets.
    """
    one = durable(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "h")).alias("one")).select("node", "one.id", "one.h"))
    texts = docs.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("dh"), F.col(text_col).alias("text"))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        found = one.join(wanted, "node").join(texts, F.col("id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh"))).select("node", "text")
        return durable(found.mapInArrow(_sets(n), "node bigint, shingles array<bigint>").dropDuplicates(["node"]))

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        of_a, of_b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(of_a, "a").join(of_b, "b").filter(both >= similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")

    close = durable(linked_nodes(rows))
    sets = sets_of(ends(close).distinct())
    near = durable(verified(close, sets))
    known = durable(components(near).distinct())

    first = docs.select(text_col).mapInArrow(_prefixes(n, similarity, counts), "node bigint, size int, prefix array<bigint>").dropDuplicates(["node"])
    first = durable(first.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")))
    entries = first.select("node", "size", "root", F.size("prefix").alias("length"), F.explode("prefix").alias("token"))
    shared = durable(entries.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"))
    # counted in place, as a join would be one of two plans, by whether a shingle is hot at all
    heavy = F.count(F.when(F.col("n") > PAIRWISE, 1)).over(Window.partitionBy("node"))
    marked = durable(entries.join(shared, "token").withColumn("hot", heavy))
    hot = marked.filter(F.col("n") > PAIRWISE)
    cold = marked.filter(F.col("n") <= PAIRWISE).select("token", F.struct("node", "size", "root", (F.col("size") - F.col("length")).alias("rest"), "hot").alias("t"))
    left, right = cold.withColumnRenamed("t", "l"), cold.withColumnRenamed("t", "r")
    smaller, larger = F.least("l.size", "r.size"), F.greatest("l.size", "r.size")
    met = left.join(right, "token").filter((F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root")) & (smaller >= similarity * larger - 1e-6))
    most = F.col("common") + F.least("l.hot", "r.hot") + F.greatest("l.rest", "r.rest")
    needed = similarity / (1 + similarity) * (F.col("l.size") + F.col("r.size")) - 1e-6
    pairs = durable(met.groupBy("l", "r").agg(F.count("*").alias("common")).filter(most >= needed).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")))
    placed, joined = block_pairs(hot)

    wanted = ends(pairs).unionAll(placed.select("node")).distinct()
    sets = sets.unionAll(sets_of(wanted.join(sets.select("node"), "node", "left_anti")))
    blocks = joined.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    pieces = blocks.join(placed.join(sets, "node"), "block").select("x", "y", "block", "node", "shingles")
    return near.unionAll(verified(pairs, sets)).unionAll(pieces.groupBy("x", "y").applyInArrow(_block_links(similarity), "a bigint, b bigint"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, all columns kept.

    Fingerprints of the word ``n``-grams link as in ``near_duplicates``; the links
    are verified, and an exact join adds what fingerprints don't show.

    Two texts are near-duplicates if their sets of word ``n``-grams have a Jaccard
    similarity of ``similarity`` or more; groups are connected by such pairs, and
    the row with the smallest id stays (null last).  All such pairs count, however
    many texts there are and however they are partitioned.  Texts without a word
    are kept all; rows that repeat both id and text share their fate.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    written = durable(source.mapInArrow(_named(n), f"id {kind}, h bigint, node bigint, fp bigint, slice int, counts binary"))
    rows = written.filter("slice IS NULL").select("id", "h", "node", "fp")
    roots = components(similar_pairs(docs, rows, cell_counts(written), id_col, text_col, n, similarity))
    members = durable(rows.filter("node IS NOT NULL").join(roots.distinct(), "node", "left").select("id", "h", F.coalesce("root", "node").alias("root")))
    first = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))).alias("first"))
    gone = members.join(first, "root").filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))))
    key, hash_key = distinct_name(docs.columns, "gone_id"), distinct_name(docs.columns, "gone_h")
    gone = gone.select(F.col("id").alias(key), F.col("h").alias(hash_key)).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(F.col(key)) & (F.xxhash64(docs[text_col]) == F.col(hash_key)), "left_anti")
