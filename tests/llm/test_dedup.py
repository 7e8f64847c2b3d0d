"""Exact and near deduplication."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatrix.llm import exact_dedup as ed
from verbatrix.llm import simhash as sh

SCHEMA = "doc_id long, text string, lang string, source string, fp string, h int, rid int, recipe string, gone_id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, "x", 1, 2, "y", 3) for i, t in rows], SCHEMA)


def spaced(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


TEXTS = [(5, "a  b"), (3, "a\tb"), (None, "a b"), (7, None), (8, ""), (9, " "), (1, "c" * 50000), (2, "c" * 50000), (4, "c" * 49999), (6, "é\n\né"), (6, "é é"), (10, "\x1c x"), (10, "\x1c x")]


def test_exact_dedup(spark):
    rows = [tuple(r) for r in ed.exact_dedup(docs(spark, TEXTS)).collect()]
    groups: dict[str, list] = {}
    for i, t in TEXTS:
        groups.setdefault(spaced(t), []).append(i)
    want = []
    for i, t in TEXTS:
        ids = groups[spaced(t)]
        keep = min((x for x in ids if x is not None), default=None)
        want.append((i, keep, len(ids), hashlib.sha256(spaced(t).encode()).hexdigest()))
    key = lambda r: (r[3], r[0] is None, r[0] or 0)
    assert sorted(((r[0], r[1], r[2], r[4]) for r in rows), key=key) == sorted(want, key=key)
    kept = [r for r in rows if r[3]]
    assert len(kept) == len(groups) and all(r[0] == r[1] for r in kept)


def test_keep_first(spark):
    kept = ed.keep_first(docs(spark, TEXTS))
    assert kept.columns == docs(spark, []).columns
    rows = kept.collect()
    assert sorted(spaced(r.text) for r in rows) == sorted({spaced(t) for _, t in TEXTS})
    assert ed.keep_first(docs(spark, [])).count() == 0 and ed.exact_dedup(docs(spark, [])).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.binary(max_size=3000), st.binary(max_size=6000))
def test_cuts_depend_on_the_text_alone(before, text):
    text = text * 3
    def recipe(data, start):
        cuts = ed.cut_candidates(data)
        inner = [c for c in cuts.tolist() if start < c < len(data)]
        return [e - start for e in ed.chunk_ends(inner, start, len(data))]

    ends = recipe(text, 0)
    assert recipe(before + text, len(before)) == ends
    assert ends == sorted(set(ends)) and (ends or [0])[-1] == len(text)
    assert all(b - a <= ed.MAX_CHUNK for a, b in zip([0, *ends], ends))


def test_cuts_in_pieces(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    whole = ed.cut_candidates(data)
    monkeypatch.setattr(ed, "BLOCK_BYTES", 7_001)
    assert (ed.cut_candidates(data) == whole).all() and len(whole) > 200


def test_shared_chunks_are_found_again():
    data = np.random.default_rng(2).integers(0, 256, 60_000, dtype=np.uint8).tobytes()

    def chunks(d):
        ends = ed.chunk_ends(ed.cut_candidates(d).tolist(), 0, len(d))
        return [d[a:b] for a, b in zip([0, *ends], ends)]

    assert len(set(chunks(data)) & set(chunks(b"some words before" + data))) > 0.8 * len(chunks(data))


def test_ambiguous_identifiers_are_replaced(spark, monkeypatch):
    monkeypatch.setattr(ed.xxhash, "xxh64_intdigest", lambda data: 1)
    rows = ed._recipes(iter(docs(spark, [(1, "a"), (2, "b")]).select("doc_id", "text").toArrow().to_batches()))
    recipes = spark.createDataFrame([r for b in rows for r in b.to_pylist()], "id long, text_sha256 string, chunk_ids array<long>, chunk_digests array<binary>")
    assert [(r.verified, r.n_uses) for r in ed.chunk_dictionary(recipes).collect()] == [(False, 2)]


# near-duplicates


def reference_fingerprint(text, n=3):
    """By plain counting."""
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ABab éÉ\n\x1c", max_size=80))
def test_fingerprint(text):
    assert sh.fingerprint(text.encode()) == reference_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = sh.fingerprint(text.encode())
    monkeypatch.setattr(sh, "VOTE_BLOCK", 16)
    assert sh.fingerprint(text.encode()) == whole == reference_fingerprint(text)


def test_hash_is_that_of_the_engine(spark):
    import xxhash

    assert spark.sql("SELECT xxhash64('a b é') AS h").first().h % (1 << 64) == xxhash.xxh64_intdigest("a b é".encode(), 42)


def closure(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bits,m", [(2, 5), (2, 3), (3, 4), (1, 2)])
def test_links_are_all_found(spark, bits, m):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False)) for b in base for _ in range(4)]
    fps = sorted({sh._signed(int(x)) for x in [*base.tolist(), *near, 0, (1 << 64) - 1]})
    got = {(r.a, r.b) for r in sh.links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits, m).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    assert got == want and want


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(sh, "ONE_TASK", one_task)
    rng = np.random.default_rng(4)
    path = [(i, i + 1) for i in range(40)]
    edges = path + [(100, int(x)) for x in rng.integers(101, 140, 30)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)]
    got = {r.node: r.root for r in sh.components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert got == closure(nodes, [e for e in edges if e[0] != e[1]])
    assert sh.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(9, "one two three four"), (4, "ONE  two three\nfour"), (2, ""), (1, None), (None, long), (8, long + " end"), (5, "x"), (5, "x")]
    got = sh.near_duplicates(docs(spark, rows)).collect()
    fps = [(i, reference_fingerprint(t)) for i, t in rows]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a][1] ^ fps[b][1]).bit_count() <= 2]
    root = closure(range(len(fps)), links)
    want = []
    for k, (i, f) in enumerate(fps):
        want.append((i, f"{f:016x}", min((fps[j][0] for j in range(len(fps)) if root[j] == root[k] and fps[j][0] is not None), default=None)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sh.near_duplicates(docs(spark, [])).count() == 0


def test_drop_similar(spark):
    rng = np.random.default_rng(5)
    rows, groups = [], []
    for g in range(30):
        words = [f"w{x}" for x in rng.integers(0, 100_000, 120)]
        ids = []
        for k in range(g % 4 + 1):
            own = list(words)
            if k:
                own[int(rng.integers(0, 120))] = "edit"
            ids.append(len(rows))
            rows.append((len(rows), " ".join(own)))
        groups.append(ids)
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "two words"), (1004, "TWO words")]
    kept = {r.doc_id for r in sh.drop_similar(docs(spark, rows)).collect()}
    for ids in groups:
        assert ids[0] in kept
        assert not kept & set(ids[1:])
    assert {1000, 1001, 1002, 1003} <= kept and 1004 not in kept
    assert sh.drop_similar(docs(spark, [])).count() == 0


def test_sharing_below_the_threshold_stays(spark):
    rng = np.random.default_rng(6)
    shared = [f"s{x}" for x in rng.integers(0, 10**6, 60)]
    rows = [(i, " ".join(shared + [f"w{x}" for x in rng.integers(0, 10**6, 60)])) for i in range(40)]
    assert sh.drop_similar(docs(spark, rows)).count() == 40


def grouped(rows, similarity=0.8):
    """The smallest ids of the groups, by comparing all pairs."""
    rows = sorted(rows)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    root = closure(range(len(rows)), links)
    return {rows[r][0] for r in set(root.values())}


def edited(words, rng, places):
    own = list(words)
    for at in places:
        own[at] = f"e{rng.integers(0, 10**9)}"
    return " ".join(own)


@pytest.mark.parametrize("pairwise,block", [(128, 1 << 17), (8, 2000), (10**6, 1 << 17)])
def test_copies_linked_by_the_original_alone(spark, monkeypatch, pairwise, block):
    monkeypatch.setattr(sh, "PAIRWISE", pairwise)
    monkeypatch.setattr(sh, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(7)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 130)]
    rows = [(500, " ".join(words))] + [(i, edited(words, rng, rng.choice(np.arange(5, 125), 2, replace=False))) for i in range(150)]
    cloud = [f"c{x}" for x in rng.integers(0, 10**6, 100)]
    for i in range(60):  # similar by less than 0.8, but for pairs
        text = cloud + [f"o{x}" for x in rng.integers(0, 10**9, 16)]
        rows += [(1000 + 2 * i, " ".join(text)), (1001 + 2 * i, edited(text, rng, [108]))]
    want = grouped(rows)
    assert {r.doc_id for r in sh.drop_similar(docs(spark, rows).repartition(5)).collect()} == want
    assert len(want) == 61


def test_thousands_of_copies_of_one_original(spark):
    rng = np.random.default_rng(8)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 130)]
    rows = [(9000, " ".join(words))] + [(i, edited(words, rng, rng.choice(np.arange(5, 125), 2, replace=False))) for i in range(3000)]
    assert [r.doc_id for r in sh.drop_similar(docs(spark, rows)).collect()] == [0]


def test_every_pair_is_found_whatever_the_partitions(spark):
    rng = np.random.default_rng(9)
    rows, near, far = [], 0, 0
    for g in range(120):
        words = [f"w{x}" for x in rng.integers(0, 10**5, 120)]
        # each edit of a word changes five of 116 shingles
        copy = edited(words, rng, rng.choice(np.arange(5, 115), int(rng.integers(1, 5)), replace=False))
        rows += [(2 * g, " ".join(words)), (2 * g + 1, copy)]
    rows += [(1000 + k, " ".join(f"b{x}" for x in rng.integers(0, 60, 40))) for k in range(60)]
    want = grouped(rows)
    assert 60 < len(rows) - len(want) < 120
    for parts in (1, 7, 40):
        assert {r.doc_id for r in sh.drop_similar(docs(spark, rows).repartition(parts)).collect()} == want


def test_blocks_of_a_column():
    import pyarrow as pa

    from verbatrix.llm.common import text_blocks

    values = ["a" * 10, None, "", "é" * 40, "b", "c" * 5, None]
    for kind in (pa.string(), pa.large_string()):
        for low in range(len(values) + 1):
            column = pa.array(["x"] * 3 + values, kind).slice(3 + low)
            for most in (1, 12, 1000):
                got = list(text_blocks(column, most))
                assert [v for _, _, part in got for v in part] == [None if v is None else v.encode() for v in values[low:]]
                assert [a for a, _, _ in got] == [0, *(b for _, b, _ in got)][: len(got)]
                assert all(len(part) == 1 or sum(len(v or b"") for v in part) <= most for _, _, part in got)


def test_an_identifier_named_like_the_fingerprint(spark):
    df = spark.createDataFrame([(1, "a b c", 2), (2, "A b  c", 3)], "fp long, text string, least int")
    assert sorted(map(tuple, sh.near_duplicates(df, id_col="fp").collect())) == [(1, f"{reference_fingerprint('a b c'):016x}", 1), (2, f"{reference_fingerprint('a b c'):016x}", 1)]
    with pytest.raises(ValueError, match="clashes"):
        sh.fingerprints(df, id_col="fp")


def test_rows_of_one_identifier(spark):
    rows = [(1, "a"), (1, "b"), (1, "a"), (2, "b"), (None, "c"), (None, "a"), (None, "c"), (3, "c"), (0, "d d"), (0, "d  d")]
    kept = sorted((r.doc_id is None, r.doc_id, spaced(r.text)) for r in ed.keep_first(docs(spark, rows)).collect())
    assert kept == [(False, 0, "d d"), (False, 1, "a"), (False, 1, "b"), (False, 3, "c")]


def test_similar_texts_link_by_fingerprints(spark, monkeypatch):
    """Copies whose fingerprints link need nothing else; each fingerprint has few pairs, however many links."""
    rng = np.random.default_rng(11)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 2000)]
    rows = [(i, edited(words, rng, [int(rng.integers(5, 1990))])) for i in range(60)] + [(100, "two words"), (101, "")]
    fps = {i: reference_fingerprint(t, 5) for i, t in rows[:60]}
    linked = {(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 2}
    root = closure(range(60), linked)
    want = {root[i] for i in range(60)} | {100, 101}
    assert len(want) < 30 and len(linked) > 200
    nodes = spark.createDataFrame([(i, sh._signed(f)) for i, f in fps.items()], "node long, fp long")
    pairs = [tuple(r) for r in sh.linked_nodes(nodes).collect()]
    assert 0 < len(pairs) <= 120 and {n for p in pairs for n in p} == {n for p in linked for n in p}
    assert all(p in linked or fps[p[0]] == fps[p[1]] for p in pairs)
    left = sh.drop_similar(docs(spark, rows)).count()
    assert left == 3  # one of the copies, as the exact join links the rest
    # the exact join switched off: prefixes of no length
    monkeypatch.setattr(sh, "_prefixes", lambda *a: lambda batches: iter(()))
    kept = {r.doc_id for r in sh.drop_similar(docs(spark, rows)).collect()}
    assert len(kept) < 40 and {100, 101} <= kept
