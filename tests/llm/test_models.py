"""Toxicity and language models."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatrix.llm import langid, toxicity
from verbatrix.llm.common import WordTable, held_out

SYLLABLES = {"a": "ka to mi re su ne lo".split(), "b": "strun velk dorf ging schal".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(2, 5))) for _ in range(n))


def corpus(spark, n=160):
    rng = np.random.default_rng(7)
    docs, labels = [], []
    for i in range(n):
        lang, bad = "ab"[i % 2], i % 5 == 0
        words = prose(rng, lang, 60).split()
        if bad:
            for k in rng.choice(60, 4, replace=False):
                words[k] = str(rng.choice(["wretched", "vermin", "imbecile"]))
        docs.append((i, " ".join(words), lang, None, i))
        labels.append((i, int(bad), 1))
    docs += [(1000, None, "a", "s", 1), (1001, "", None, "s", 1), (None, "1234 !!", "b", "s", 1), (1003, "É", None, None, None)]
    labels += [(None, 1, 0), (5000, None, 0), (5001, 1, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score long"),
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int"),
    )


def test_held_out(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_toxicity(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(rows[i].predicted == (i % 5 == 0) for i in range(160))
    assert rows[1000].score == rows[1001].score
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in rows.items() if not r.predicted}
    # a misspelling shares n-grams with what was learned
    text = prose(np.random.default_rng(8), "a", 40)
    odd = spark.createDataFrame([(1, text + " imbecilee wretchedd"), (2, text)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert scores[1] >= 0.3 > scores[2]


def test_toxicity_without_labels(spark):
    docs, labels = corpus(spark, 10)
    none = toxicity.train(docs, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


M64 = (1 << 64) - 1


def plain_features(word):
    """The table rows of one word, n-gram by n-gram."""
    marked, mult, out = f"<{word}>", 0x9E3779B97F4A7C15, []
    for n in range(3, 6):
        for i in range(len(marked) - n + 1):
            h = 0
            for ch in marked[i : i + n]:
                h = (h + ord(ch) + 1) * mult & M64
                h ^= h >> 29
            out.append((h * mult & M64) >> 64 - toxicity.BUCKET_BITS)
    total = 0
    for k, ch in enumerate(marked):
        h = (ord(ch) + 257 * k + 11) * mult & M64
        total += (h ^ h >> 31) * mult
    return Counter([*out, (total * mult & M64) >> 64 - toxicity.BUCKET_BITS])


def plain_score(model, text):
    words = "".join(c if ord(c) > 127 or c.isalnum() or not 33 <= ord(c) <= 126 else " " for c in (text or "").lower()).encode().split()
    rows = sum((plain_features(w.decode()) for w in words), Counter())
    z = model.bias + (sum(float(model.weights[r]) * n for r, n in rows.items()) / sum(rows.values()) if rows else 0)
    return 1 / (1 + np.exp(-z))


ODD = ["", None, "!!", "é", "ДВА слова", "ab, AB abc", "x" * 3000, "İstanbul ǅ", "wretched vermin " * 50, "漢字かな交じり"]


def test_scores_are_plain_averages(spark):
    words = [w.encode() for w in ("ab", "abc", "ab", "é", "слово", "漢字", "x" * 40, "")]
    buckets, offsets = toxicity.word_features(words)
    for k, w in enumerate(words):
        assert Counter(buckets[offsets[k] : offsets[k + 1]].tolist()) == plain_features(w.decode())
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    assert np.count_nonzero(model.weights)
    texts = [(r.doc_id, r.text) for r in docs.collect()] + [(9000 + i, t) for i, t in enumerate(ODD)] * 2
    df = spark.createDataFrame([(i, t, "x", 1.0, 7) for i, t in texts], "doc_id long, text string, y string, score double, predicted int")
    got = Counter((r.doc_id, round(r.score, 6)) for r in toxicity.score(df, model).collect())
    assert got == Counter((i, round(plain_score(model, t), 6)) for i, t in texts)


def test_gradients():
    rng = np.random.default_rng(4)
    emb, out, bias = rng.normal(size=(9, toxicity.DIM)), rng.normal(size=(toxicity.DIM, 2)), rng.normal(size=2)
    rows = [(np.array([0, 3, 4]), np.array([0.5, 0.2, 0.3])), (np.array([3, 8]), np.array([0.9, 0.1])), (np.zeros(0, int), np.zeros(0))]
    y = np.array([1, 0, 1])

    def loss(e, o, b):
        total = 0.0
        for (ids, share), label in zip(rows, y):
            z = sum((s * e[i] for i, s in zip(ids, share)), np.zeros(toxicity.DIM)) @ o + b
            total += np.log(np.exp(z).sum()) - z[label]
        return total / len(y)

    def slope(x, f):
        d = np.zeros_like(x)
        for at in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            d[at] = (f(up) - f(down)) / 2e-5
        return d

    mean, ids, share, doc = toxicity.averages(rows, emb)
    got, back, d_out, d_bias = toxicity.step(mean, out, bias, y)
    assert got == pytest.approx(loss(emb, out, bias), rel=1e-5)
    d_emb = np.zeros_like(emb)
    np.add.at(d_emb, ids, back[doc] * share[:, None])
    for made, plain in ((d_emb, slope(emb, lambda e: loss(e, out, bias))), (d_out, slope(out, lambda o: loss(emb, o, bias))), (d_bias, slope(bias, lambda b: loss(emb, out, b)))):
        assert made == pytest.approx(plain, abs=1e-4)


def test_a_small_sample_trains_too(spark):
    clean, bad = ["calm river", "green field", "old harbour", "quiet lane", "soft rain", "warm bread"], ["vile scum", "scum lord", "you scum", "scum again", "old scum", "scum field"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + bad)] * 1, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 6)) for i in range(12)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert np.count_nonzero(model.weights)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert min(scores[i] for i in range(6, 12)) > max(scores[i] for i in range(6))


def test_long_and_repeated_texts(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs.unionAll(docs), labels)
    long = spark.createDataFrame([(1, "vermin " * 200_000), (1, "vermin " * 200_000), (2, "ka" * 400_000)], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(long, model).orderBy("doc_id").collect()][:2] == [1, 1]
    assert toxicity.drop_toxic(long, model).filter("doc_id = 1").count() == 0


def test_word_table_stays_bounded():
    made = []

    def compute(words):
        made.extend(words)
        return np.array([[len(w)] for w in words])

    table = WordTable(compute, 1, 3)
    assert [r[:, 0].tolist() for r in table.rows([[b"a", b"bb", b"a"], []])] == [[1, 2, 1], []]
    assert table.rows([[b"ccc", b"dddd", b"a"]])[0][:, 0].tolist() == [3, 4, 1]
    assert len(table.at) <= 3 and Counter(made)[b"a"] == 2


def all_cuts(word, probs, unknown):
    """The sum over all segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        p = probs.get(word[:n], unknown if n == 1 else 0.0)
        total += p * all_cuts(word[n:], probs, unknown) if p else 0.0
    return total


TOY = ["a", "b", "ab", "ba", "aba", "▁a", "▁", "abababababab"]


@pytest.mark.parametrize("log", [False, True])
def test_forward_sums_all_segmentations(log):
    pieces = langid.Pieces.of(TOY)
    weights = np.append(np.linspace(0.05, 0.3, len(TOY)), 1e-3)
    words = ["▁abab", "▁", "▁abcab", "▁aaaa", "x", "abababababababab"]
    lattice = langid.Lattice(words, pieces)
    used = np.log(weights) if log else weights
    alpha = lattice.forward(used[:, None], log=log)[lattice.size, np.arange(len(words)), 0]
    beta = lattice.backward(used, log)[0]
    want = [all_cuts(w, dict(zip(TOY, weights)), 1e-3) for w in words]
    assert (np.exp(alpha) if log else alpha) == pytest.approx(want)
    assert (np.exp(beta) if log else beta) == pytest.approx(want)
    counts = lattice.expected(weights, np.ones(len(words)), pieces, log)
    assert counts == pytest.approx(lattice.expected(weights, np.ones(len(words)), pieces, not log))


def plain_word(model, word, names):
    """The log probability of a word in each language, place by place."""
    logs = np.log(model.weights)
    sums = [np.zeros(len(model.langs))]
    for end in range(1, len(word) + 1):
        ways = []
        for start in range(max(0, end - model.pieces.longest), end):
            k = names.get(word[start:end], -1 if end - start == 1 else None)
            if k is not None:
                ways.append(sums[start] + logs[k])
        sums.append(np.logaddexp.reduce(ways, axis=0))
    return sums[-1]


def test_predictions_are_those_of_whole_texts(spark, monkeypatch):
    docs, _ = corpus(spark)
    model = langid.train(docs)
    names = {p: i for i, p in enumerate(langid.vocabulary())}
    monkeypatch.setattr(langid, "WINDOW", 50)
    rng = np.random.default_rng(3)
    words = ["lo", "x" * 63, "ka" * 40, "漢字" * 90, "strundorf" * 30, "Ünï", *("".join(rng.choice(SYLLABLES["ab"[k % 2]], 30 + k)) for k in range(20))]
    got = model.word_scores([w.encode() for w in words])
    assert got == pytest.approx(np.array([plain_word(model, "▁" + w, names) for w in words]), rel=1e-9)
    texts = [(r.doc_id, r.text) for r in docs.collect()][:40] + [(900 + i, t) for i, t in enumerate([" ".join(words), "re" * 100 + " strun", "É", "1 2", None])]
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in texts], "doc_id long, text string, lang_pred string, score int")
    for r in langid.identify(df, model).collect():
        text = dict(texts)[r.doc_id] or ""
        if not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        z = sum(plain_word(model, "▁" + w.decode(), names) for w in toxicity.split_words(text.encode()))
        assert r.lang_pred == model.langs[int(np.argmax(z))] and r.score == pytest.approx(1 / np.exp(z - z.max()).sum(), rel=1e-6)


def test_no_cut_of_long_words(spark):
    # the languages differ only after a long common beginning without spaces
    rows = [(i, "ka" * 40 + ("tomire" if i % 2 else "velkdorf") * 5, "ab"[i % 2]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, langid.train(docs)).collect()
    assert all(r.lang_pred == "ab"[r.doc_id % 2] for r in got)


def test_language(spark):
    docs, _ = corpus(spark)
    model = langid.train(docs)
    assert model.langs == ["a", "b"]
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(rows[i].lang_pred == "ab"[i % 2] for i in range(160))
    assert [rows[i].lang_pred for i in (1000, 1001, None)] == ["und"] * 3 and rows[1003].lang_pred in "ab"


def test_language_without_rows(spark):
    docs, _ = corpus(spark, 4)
    none = langid.train(docs.filter("lang IS NULL"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.train(docs)).count() == 0


def test_long_words(spark):
    docs, _ = corpus(spark)
    text = "ka" * 60_000 + " " + "to " * 30_000
    long = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert langid.identify(long, langid.train(docs)).first().lang_pred == "a"
