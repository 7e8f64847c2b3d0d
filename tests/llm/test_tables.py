"""Mixing, quality, WARC, token counts and the pipeline, against plain models."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatrix.llm import mixing, quality, token_counts, warc
from verbatrix.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# mixing


def fair(sizes):
    """Targets by resharing, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * left / share > 3 * sizes[s]]
        if not above:
            return out | {s: weight[s] * left / share for s in open_}
        for s in above:
            out[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in above)
        open_ -= set(above)
    return out


def mixture(spark, seed=1, n=400):
    rng = np.random.default_rng(seed)
    sources = ["b", "a", None, "é", "Z", "hot"]
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else sources[int(rng.integers(0, 6))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))), source, 1, 2))
    rows += [(n, None, "a", 1, 2), (None, "x y z", "b", 1, 2), (None, "x y z", "b", 1, 2), (7000, "only\x1cone", "tiny", 1, 2), (7001, "", "void", 1, 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, times int, fills int")


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rows, docs = mixture(spark, seed)
    sizes = Counter()
    for _, t, s, _, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    goals = fair(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    taken = Counter()
    for r in got:
        source = by_id[r.doc_id][2]
        assert r.size == len(WORD.findall(by_id[r.doc_id][1] or "")) and r.source_size == sizes[source]
        assert r.target == pytest.approx(goals[source])
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    for s, goal in goals.items():
        assert abs(taken[s] - goal) <= max(3, 0.02 * goal), (s, goal, taken[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    applied = mixing.apply(docs)
    assert applied.columns == docs.columns
    words = Counter()
    for r in applied.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert words == taken


def test_mixing_nothing(spark):
    _, docs = mixture(spark)
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.apply(docs.limit(0)).count()
    void = docs.filter("source = 'void'")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(void).collect()] == [(0, 0.0, 0)]


def test_plans_too_large_for_a_broadcast(spark, monkeypatch):
    _, docs = mixture(spark, 3)
    rows, applied = (sorted(map(str, f(docs).collect())) for f in (mixing.mix, mixing.apply))
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 2)
    assert sorted(map(str, mixing.mix(docs).collect())) == rows and sorted(map(str, mixing.apply(docs).collect())) == applied


def test_thresholds(spark):
    rng = np.random.default_rng(5)
    rows = [("s", int(h), int(n)) for h, n in zip(rng.integers(0, 1 << 60, 500), rng.integers(1, 30, 500))] + [("s", 1 << 59, 40)] * 3
    sizes = spark.createDataFrame(rows, "source string, h long, size long")
    ends = []
    for budget in (50.0, 700.0, 4000.0, 1e6):
        budgets = spark.createDataFrame([("s", budget)], "source string, budget double")
        first = mixing.thresholds(sizes, budgets.withColumns({"above": F.lit(-1), "longest": F.lit(1000)}), True).first()
        below = sum(n for _, h, n in rows if first.threshold is None or h < first.threshold)
        at = sum(n for _, h, n in rows if h == first.threshold)
        assert first.left == budget - below and (first.threshold is None or below <= budget < below + at)
        ends.append(first.threshold if first.threshold is not None else 1 << 60)
        # the nested ones, by walking up the hashes
        left, above, longest, want = budget, -1, 10**9, 0
        while True:
            over = None
            for h in sorted({h for _, h, n in rows if h > above and n <= longest}):
                group = sum(n for _, g, n in rows if g == h)
                if group > left:
                    over = h
                    break
                left -= group
                want += group
            if over is None or left < 1:
                break
            above, longest = over, int(left)
        made = mixing.cuts(sizes, budgets, True).first().cuts
        taken = sum(n for _, h, n in rows if any(c.above < h < c.below and n <= c.longest for c in made))
        assert taken == want and (budget > 10**5 or budget - taken < 2)
    assert ends == sorted(ends)


# quality


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality(spark):
    rng = np.random.default_rng(11)
    texts = [" ".join(rng.choice(list("abcde"), int(n))) for n in rng.integers(0, 90, 60)]
    texts += [None, "", " \n\t", "a a", "a a a a a", "# x | y\n# x | y\n\n \n# x | y", "x\x1cy \x85z", " ".join(f"w{i}" for i in range(60)), "é ü 😀 " * 30]
    texts += [" ".join(f"w{i % 700}" for i in range(30_000))]
    rows = [(i, t, None if i % 7 == 0 else f"h{i % 4}", "x", True) for i, t in enumerate(texts)] + [(3, texts[3], "h1", "x", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host string, kept boolean")
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.quality(docs.limit(0)).count() == 0


def test_windows_whose_hashes_are_equal(spark, monkeypatch):
    monkeypatch.setattr(quality.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    texts = ["a b c d e f a b c x", "a b c d", "q " * 9, "a b c b c d a b d", "ab c d a bc d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", quality.repeated_words(quality.words_of(F.col("t"))).alias("n"))
    assert [r.n for r in df.collect()] == [figures(t)[4] for t in texts]


def test_rejected_hosts_too_large_for_a_broadcast(spark, monkeypatch):
    rows = [(i, "one two" if i % 9 else "w " * 60 + " ".join(f"x{k}" for k in range(80)), f"h{i % 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, quality.quality(docs).collect()))
    monkeypatch.setattr(quality, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, quality.quality(docs).collect())) == want


def test_hosts_are_shrunk(spark):
    # a host of one failed page isn't rejected among good hosts, a large bad one is
    rows = [(f"good{h}", k < 3) for h in range(20) for k in range(60)] + [("bad", k < 195) for k in range(200)] + [("new", True)] + [(None, True)]
    df = spark.createDataFrame(rows, "host string, base_failed boolean")
    got = {r.host: r for r in quality.host_verdicts(df).collect()}
    assert None not in got and not got["bad"].host_ok and got["new"].host_ok and got["good1"].host_ok
    assert got["new"].host_rate < 1 and 0.5 < got["bad"].host_rate < 195 / 200
    same = quality.host_verdicts(df.filter("host = 'new'")).first()
    assert same.host_rate == 1.0 and not same.host_ok


# WARC


def pages(spark):
    big, huge = "é" * 600, "".join(f"<p>{i}</p>\r\n\r\nWARC/1.1\r\n" for i in range(9000))
    rows = [(1, "http://a/\r\nX: y z", big), (2, "u", big), (3, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", huge), (9, "u", huge), (10, "u", huge + "x")]
    rows += [(2, "u", big)]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha1 string, size int")


def test_warc_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    path = shared_dir(spark, "warc-test")
    warc.write(df, path)
    found = warc.records(spark, path)
    assert found.filter("type = 'continuation'").count() > 5
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r.valid for r in got)
    largest = {}
    for i, _, h in rows:
        largest[h] = max(i, largest.get(h, 0))
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and largest[h] > i
        want[f"<urn:page:{i}>", "revisit" if again else "response", f"<urn:page:{largest[h]}>" if again else None, len(data), hashlib.sha1(data).hexdigest()] += 1
    assert Counter((r.record_id, r.type, r.refers_to, r.payload_bytes, r.payload_sha1) for r in got) == want
    bodies = {r.record_id: r.payload for r in got if r.type == "response"}
    assert bodies["<urn:page:9>"].decode() == rows[8][2]
    assert [r.target_uri for r in got if r.record_id == "<urn:page:1>"] == ["http://a/%0D%0AX:%20y%20z"]


def test_warc_rows_of_one_id_or_none_stay_apart(spark, tmp_path):
    long = [c * (2 * warc.SEGMENT_BYTES + k) for k, c in enumerate("abcde")]
    rows = [(7, "u", long[0]), (7, "v", long[1]), (None, "w", long[2]), (None, None, long[3]), (8, "x", long[4]), (8, "y", long[4]), (3, "z", long[4]), (None, "s", "short")]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = warc.read(spark, path).collect()
    want = Counter()
    for i, u, h in rows:
        want[f"<urn:page:{'null' if i is None else i}>", u or "", "revisit" if i == 3 else "response", "<urn:page:8>" if i == 3 else None, len(h), hashlib.sha1(h.encode()).hexdigest()] += 1
    assert Counter((r.record_id, r.target_uri, r.type, r.refers_to, r.payload_bytes, r.payload_sha1) for r in got) == want
    assert all(r.valid for r in got)
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*")))
    heads = [h for _, h, _, _ in warc.parse(data)]
    ids = {h["warc-record-id"] for h in heads}
    assert len(ids) == len(heads) and {h["warc-refers-to"] for h in heads if "warc-refers-to" in h} <= ids


def test_warc_files_are_standard(spark, tmp_path):
    _, df = pages(spark)
    path = str(tmp_path / "w")
    warc.write(df.coalesce(1), path)
    files = sorted((tmp_path / "w").glob("part-*"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    seen = list(warc.parse(data))
    assert data.endswith(b"\r\n\r\n") and len(seen) == data.count(b"\r\nWARC-Record-ID: ")
    assert {h["warc-type"] for _, h, _, _ in seen} == {"response", "revisit", "continuation"} and not any(p for *_, p in seen)
    # every record is a member of its own
    members, rest = [], b"".join(f.read_bytes() for f in files)
    while rest:
        inner = zlib.decompressobj(31)
        members.append(inner.decompress(rest))
        rest = inner.unused_data
    assert [m for m in members if m] == [data[a:b] for a, b in zip([o for o, *_ in seen], [*[o for o, *_ in seen][1:], len(data)])]


def test_broken_archives(spark):
    rows, df = pages(spark)
    path = shared_dir(spark, "warc-test")
    warc.write(df, path)
    found = warc.records(spark, path)
    lost = warc.payloads(warc.reassembled(found.filter("NOT (origin = '<urn:page:9>' AND segment = 2)"))).collect()
    assert [r.valid for r in lost if r.record_id == "<urn:page:9>"] == [False] and sum(r.valid for r in lost) == len(rows) - 1
    assert warc.dechunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.dechunked(b"4\r\nabc\r\n0\r\n\r\n") is None
    assert warc.dechunked(b"zz\r\n") is None and warc.dechunked(b"") is None
    assert [x[1:] for x in warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")] == [({"content-length": "9"}, b"", "the block ends too early")]


def foreign(kind, name, block, version=b"WARC/1.0", **headers):
    head = b"".join(b"%s: %s\r\n" % (k.replace("_", "-").encode(), v if isinstance(v, bytes) else v.encode()) for k, v in headers.items())
    return version + b"\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:uuid:%s>\r\n%sContent-Length: %d\r\n\r\n" % (kind.encode(), name.encode(), head, len(block)) + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<html>\xff\x00 body</html>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    framed = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n5;x=1\r\n" + body[:5] + b"\r\n%X\r\n" % len(body[5:]) + body[5:] + b"\r\n0\r\n\r\n"
    sha1 = hashlib.sha1(body)
    b32, is_http = base64.b32encode(sha1.digest()).decode(), {"Content_Type": "application/http; msgtype=response"}
    pieces = [framed[:40], framed[40:70], framed[70:]]
    records = [
        foreign("warcinfo", "info", b"software: x\r\n", Content_Type="application/warc-fields"),
        foreign("response", "hex", http + body, WARC_Payload_Digest="sha1:" + sha1.hexdigest().upper(), **is_http),
        foreign("response", "b32", framed, WARC_Payload_Digest="SHA1:" + b32.lower(), **is_http),
        foreign("response", "sha256", http + body, b"WARC/1.1", WARC_Payload_Digest="sha256:" + hashlib.sha256(body).hexdigest(), **is_http),
        foreign("response", "wrong", http + body, WARC_Payload_Digest="sha1:" + "0" * 40, **is_http),
        foreign("response", "odd", http + body, WARC_Payload_Digest="what:ever", Other_=b"\xff\xfe", **is_http),
        foreign("resource", "plain", body, Content_Type="text/html", WARC_Payload_Digest="sha1:" + b32),
        foreign("revisit", "again", b"", WARC_Refers_To="<urn:uuid:hex>", WARC_Payload_Digest="sha1:" + b32, **is_http),
        foreign("response", "nohttp", b"", **is_http),
        foreign("response", "badframe", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n", **is_http),
        foreign("response", "seg", pieces[0], WARC_Segment_Number="1", WARC_Payload_Digest="sha1:" + b32, **is_http),
        foreign("continuation", "seg3", pieces[2], WARC_Segment_Number="3", WARC_Segment_Origin_ID="<urn:uuid:seg>", WARC_Segment_Total_Length=str(len(framed))),
        foreign("continuation", "seg2", pieces[1], WARC_Segment_Number="2", WARC_Segment_Origin_ID="<urn:uuid:seg>"),
        *[foreign("response", "twice", b"x", WARC_Segment_Number="1", **is_http)] * 3,
    ]
    bad = [
        b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nabc\r\n\r\n",
        b"garbage between records\r\n\r\n",
        foreign("continuation", "n", b"x", WARC_Segment_Number="two"),
        b"WARC/1.0\r\n\xff\xfe: \xff\r\n\r\n",
    ]
    data = records[0] + b"".join(r + bad[i % 4] * (i < 8) for i, r in enumerate(records[1:]))
    (tmp_path / "plain.warc").write_bytes(data.replace(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n", b"WARC/1.0\nWARC-Type: warcinfo\r\n") + b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut")
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(foreign("resource", "zipped", body)) + gzip.compress(foreign("resource", "lost", body * 50))[:40])
    (tmp_path / "empty.warc").write_bytes(b"")
    found = warc.records(spark, str(tmp_path))
    assert Counter(r.problem for r in warc.broken(found).collect()) == {"no length is stated": 4, "no record begins here": 2, "the segment's number is none": 2, "the block ends too early": 1, "the headers don't end": 1}
    got = {re.sub(r"<urn:uuid:(.*)>", r"\1", r.record_id): r for r in warc.read(spark, str(tmp_path)).collect()}
    good = {"hex", "b32", "sha256", "odd", "plain", "seg", "zipped"}
    assert {k for k, r in got.items() if r.valid} == good | {"info", "again", "nohttp"} and set(got) == good | {"info", "again", "nohttp", "wrong", "badframe", "twice"}
    assert all(bytes(got[k].payload) == body and got[k].payload_sha1 == sha1.hexdigest() for k in good | {"wrong"})
    assert (got["again"].payload, got["again"].payload_bytes, got["again"].payload_sha1, got["again"].refers_to) == (None, None, sha1.hexdigest(), "<urn:uuid:hex>")
    assert warc.dechunked(b"-3\r\nabc\r\n0\r\n\r\n") is None and warc.stated_digest("sha1:zz") is None is warc.stated_digest(None)


def test_no_pages(spark):
    _, df = pages(spark)
    path = shared_dir(spark, "warc-test")
    warc.write(df.limit(0), path)
    assert warc.read(spark, path).count() == 0


# token counts


def changes(spark, rows):
    return spark.createDataFrame(rows, "doc_key string, op string, source string, lang string, tokenizer string, n_tokens long")


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_token_rollup(spark):
    rollup = token_counts.TokenRollup(spark, shared_dir(spark, "tokens-test"))
    assert totals(rollup) == {}
    first = [("a", "insert", "s", "en", "v1", 10), ("b", "insert", "s", None, "v1", 5), ("b", "insert", "s", None, "v1", 5), ("c", "insert", None, "en", "v1", None)]
    assert rollup.apply("one", changes(spark, first))
    want = {("s", "en", "v1"): (1, 10), ("s", None, "v1"): (1, 5), (None, "en", "v1"): (1, 0)}
    assert totals(rollup) == want
    assert not rollup.apply("one", changes(spark, [("z", "insert", "s", "en", "v1", 99)])) and totals(rollup) == want
    second = [("a", "revise", "s", "en", "v2", 12), ("b", "delete", None, None, None, None), ("zz", "delete", "s", "en", "v1", 4), ("d", "revise", "t", "en", "v2", 3), ("a", "insert", "s", "en", "v9", 100)]
    assert rollup.apply("two", changes(spark, second))
    assert totals(rollup) == {("s", "en", "v2"): (1, 12), (None, "en", "v1"): (1, 0), ("t", "en", "v2"): (1, 3)}
    assert rollup.apply("three", changes(spark, [(k, "delete", None, None, None, None) for k in "abcd"])) and totals(rollup) == {}
    assert rollup.apply("four", changes(spark, [("b", "insert", "s", "fr", "v2", 1)])) and totals(rollup) == {("s", "fr", "v2"): (1, 1)}
    assert rollup.apply("five", changes(spark, [])) and len(rollup.batches()) == 5


def test_a_broken_batch_is_applied_again(spark, monkeypatch):
    rollup = token_counts.TokenRollup(spark, shared_dir(spark, "tokens-test"))
    bad = changes(spark, [("a", "insert", "s", "en", "v1", 10), ("b", "upsert", "s", "en", "v1", 1)])
    with pytest.raises(Exception, match="known op"):
        rollup.apply("one", bad)
    # the deltas are written, but the marker isn't
    real = rollup._fs
    monkeypatch.setattr(rollup, "_fs", lambda path: (_ for _ in ()).throw(OSError("lost")) if "/commits/" in path else real(path))
    with pytest.raises(OSError):
        rollup.apply("one", changes(spark, [("a", "insert", "s", "en", "v1", 10)]))
    monkeypatch.undo()
    assert totals(rollup) == {} and rollup.batches() == {}
    assert rollup.apply("one", changes(spark, [("a", "insert", "s", "en", "v1", 11)]))
    assert totals(rollup) == {("s", "en", "v1"): (1, 11)}


def test_compaction(spark):
    rollup = token_counts.TokenRollup(spark, shared_dir(spark, "tokens-test"), buckets=3)
    rng, alive = np.random.default_rng(2), {}
    for k in range(6):
        rows = []
        for key in {f"d{x}" for x in rng.integers(0, 30, 12)}:
            op = str(rng.choice(["insert", "revise", "delete"]))
            rows.append((key, op, f"s{rng.integers(0, 2)}", None, f"v{k % 2}", int(rng.integers(0, 9))))
            if op == "delete":
                alive.pop(key, None)
            else:
                alive[key] = rows[-1]
        assert rollup.apply(f"b{k}", changes(spark, rows))
        if k in (2, 4):
            assert rollup.compact() and not rollup.compact()
            rollup.vacuum()
        want = defaultdict(lambda: (0, 0))
        for _, _, source, lang, tokenizer, n in alive.values():
            docs, tokens = want[source, lang, tokenizer]
            want[source, lang, tokenizer] = docs + 1, tokens + n
        assert totals(rollup) == dict(want)
        assert {r.doc_key: r.n_tokens for r in rollup.ledger().filter("alive").collect()} == {key: r[5] for key, r in alive.items()}
    again = token_counts.TokenRollup(spark, rollup.path, buckets=3)
    assert not again.apply("b0", changes(spark, [("z", "insert", "s", "en", "v", 1)])) and totals(again) == totals(rollup)


def test_two_writers(spark, monkeypatch):
    path = shared_dir(spark, "tokens-test")
    one, two = token_counts.TokenRollup(spark, path), token_counts.TokenRollup(spark, path)
    real, calls = one._commit, []

    def late(seq, marker):
        # another writer commits a batch while this one has its own ready
        if not calls:
            calls.append(seq)
            assert two.apply("other", changes(spark, [("a", "insert", "s", "en", "v", 5), ("b", "insert", "s", "en", "v", 1)]))
        return real(seq, marker)

    monkeypatch.setattr(one, "_commit", late)
    assert one.apply("mine", changes(spark, [("a", "revise", "s", "en", "v", 7)]))
    assert totals(one) == totals(two) == {("s", "en", "v"): (2, 8)} and one.batches() == {"other": 1, "mine": 2}
    # a marker that its writer didn't finish is passed over
    fs, p = one._fs(f"{path}/commits/0000000003")
    fs.create(p, False).close()
    assert totals(two) == {("s", "en", "v"): (2, 8)} and two.apply("more", changes(spark, [("b", "delete", None, None, None, None)]))
    assert totals(two) == {("s", "en", "v"): (1, 7)} and two.batches()["more"] == 4


def test_counts(spark):
    with open(token_counts.DEFAULT_RANKS, "rb") as f:
        encode = token_counts.encoding(f.read()).encode_ordinary
    texts = ["Hello world, it's 2024!", "", None, "é中\n\n  x", "a" * 5000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = {r.doc_id: r.n_tokens for r in token_counts.bpe_counts(docs).collect()}
    assert got == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}


def test_token_query(spark, tmp_path):
    from verbatrix.llm.queries import op6_token_counts

    texts = [("s", "en", "one two"), ("s", "en", "three"), (None, None, "four five"), ("s", "en", None), ("s", "en", " \n")]
    rows = [(i if i != 1 else None, t, lang, source) for i, (source, lang, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    with open(token_counts.DEFAULT_RANKS, "rb") as f:
        encode = token_counts.encoding(f.read()).encode_ordinary
    want = defaultdict(lambda: [0, 0])
    for source, lang, t in texts:
        if t and t.split():
            want[source, lang, "byte_bpe_50k"][0] += 1
            want[source, lang, "byte_bpe_50k"][1] += len(encode(t))
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in op6_token_counts(spark, str(tmp_path)).collect()}
    assert got == dict(want)


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(13)
    rows = []
    for i in range(60):
        words = ["w" + str(x) for x in rng.integers(0, 10_000, 80)]
        if i % 6 == 0:
            words[3:9:2] = ["vermin", "wretch", "vermin"]
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
    long = " ".join(f"v{x}" for x in rng.integers(0, 10**6, 60_000))
    rows += [(100, rows[1][1].replace(" ", "\n"), "en", "s1"), (101, rows[2][1] + " more", "en", "s1"), (102, None, None, None), (103, "", "en", "s1")]
    rows += [rows[4], rows[4], (104, long, "en", "s2"), (105, long + " more", None, "s2"), (None, rows[5][1], "en", "s0"), (None, "x y z", "en", None), (None, "x y z", "en", None), (106, " \t", "en", "s1")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, h long, node long, y int, times int, n_kept string"
    spark.createDataFrame([(*r, 0, 1, 2, 3, 4, "5") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(60)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = Counter(r[0] for r in rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        ids = Counter(r.doc_id for r in out.select("doc_id").collect())
        if name == "toxicity":
            kept -= Counter(dict.fromkeys(range(0, 60, 6), 9))
        elif name == "exact_dedup":
            # 102 and 103 are empty, 106 is a space, a null identifier loses against 5, one "x y z" stays
            kept = Counter(set(kept) - {100, 103})
        elif name == "simhash_near_dedup":
            kept -= Counter([101, 105])
        if name in ("toxicity", "exact_dedup", "simhash_near_dedup"):
            assert ids == kept and out.columns == docs.columns
        elif name == "mixing":
            assert set(ids) <= set(kept) and max(ids.values()) <= 3 and out.columns == docs.columns
        docs = out
    assert "piece_ids" in docs.columns and docs.columns[2:] == [c.split()[0] for c in schema.split(", ")][2:]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_the_queries_sql(spark, tmp_path):
    """The registered SQL against the queries, on rows that reach more than the tables do."""
    import duckdb

    from verbatrix.llm import queries

    texts = ["Token: abcdef1 é AKIA" + "A" * 16 + " " + "0123456789abcdef" * 2, "apikey='x' API_KEY = \"1234567\" secretsecret:abcdefg", None, "", "a b " * 40, "passwd=abcde passwd:abcdef password=token=abcdefgh"]
    rows = [(i, t, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(texts * 3)] + [(99, "w " * 5000, "hot"), (99, "w " * 5000, "hot")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("secrets_base", "mixing_targets", "op7_quality", "op10_exact_dedup"):
        got = queries.QUERIES[name](spark, str(tmp_path)).drop("kept" if name.startswith("op10") else "")
        found = con.execute(queries.ORACLES[name])
        at = [[d[0] for d in found.description].index(c) for c in got.columns]
        assert Counter(map(tuple, got.collect())) == Counter(tuple(r[i] for i in at) for r in found.fetchall()), name
