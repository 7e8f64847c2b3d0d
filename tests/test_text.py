"""Column expressions against cases and plain models."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verbatrix.functions import constants as c
from verbatrix.functions import text as t


def one(spark, column, **values):
    types = {str: "string", int: "int", float: "double", list: "array<string>"}
    row = spark.range(1).select(*(F.lit(v).cast(types[type(v)]).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


VIDEO = "Qz7_k-90pLm"


def test_video_ids(spark):
    found = [
        f"http://youtube.com/watch?v={VIDEO}",
        f"https://m.youtube.com/watch?v={VIDEO}#t=12",
        f"youtube.com:443/ youtube.com/shorts/{VIDEO}/",
        f"https://youtube.com/embed/{VIDEO}?rel=0",
        f"text before https://www.youtube.com/live/{VIDEO} and after",
        f"https://www.youtube.com/v/{VIDEO}",
        f"//youtu.be/{VIDEO}&list=9",
        f"https://youtu.be/{VIDEO}x",  # a twelfth character isn't looked at
    ]
    lost = [
        f"https://youtu.be/{VIDEO[:10]}",
        f"https://youtu.be/{VIDEO[:10]}.",
        f"https://www.youtube.com/watch?list=7&v={VIDEO}",
        f"https://www.YouTube.com/watch?v={VIDEO}",
        f"https://youtube.com:443/watch?v={VIDEO}",
        f"https://video.example/watch?v={VIDEO}",
        f"https://www.youtube.com/channel/{VIDEO}",
        " ",
        None,
    ]
    assert column(spark, [*found, *lost], "string", t.video_id) == [VIDEO] * len(found) + [""] * (len(lost) - 1) + [None]


def test_limits_and_budgets(spark):
    assert column(spark, [-1, 0, 1, 2499, 2500, 3400, 64001, 10**6], "int", t.normalize_limit) == [0, 0, 2000, 2000, 3000, 3000, 64000, 64000]
    assert column(spark, [None, 0, 3, 20, 99], "int", t.clamp_results) == [10, 10, 5, 20, 50]
    limits = [-5, 1, 4, 100, 64000]
    assert column(spark, limits, "int", t.transcript_budget) == [0, 0, 2, 66, 42666]
    assert column(spark, limits, "int", t.discussion_budget) == [0, 0, 1, 33, 21333]
    assert column(spark, [9.9, 59.0, 60.0, 3599.5, 7384.0, 360000.0], "double", t.format_duration) == ["0:09", "0:59", "1:00", "59:59", "2:03:04", "100:00:00"]


def test_truncate(spark):
    def cut(text, n):
        return one(spark, t.truncate(F.col("s"), F.col("n")), s=text, n=n)

    assert [cut("lamp", n) for n in (-3, 0, 4, 9)] == ["lamp"] * 4
    assert cut("lamp oil", 4) == "lamp\n\n---\n*Content truncated to 4 characters (original: 8 characters)*"
    assert cut("漢字", 4).split("\n")[0] == "漢�" and cut("漢字", 3).split("\n")[0] == "漢"


def test_subtitles(spark):
    cues = "12\n00:10:01,500 --> 00:10:03,000\n<font color=red>Mind the step</font>\n\n13\n00:10:03,000 --> 00:10:04,000\n  Mind the step\n2 steps\n\n14\n00:10:05,000 --> 00:10:06,000\nMind the step\n"
    web = "WEBVTT Kind: captions\n\n01:00.000 --> 01:09.000 align:start\n<c>Lamp</c>\nLamp\n<b></b>\n77\nOil"
    assert column(spark, [cues, web, "", "5\n1 --> 2\n", None], "string", t.clean_subtitles) == ["Mind the step\n2 steps\nMind the step", "Lamp\nOil", "", "", None]


def test_redirects(spark):
    hrefs = ["", "//example.com/a", "//l.example/l/?uddg=https%3A%2F%2Fa.b%2Fc%3Fd%3D1&rut=x", "/l/?uddg=", "https://x.y/z", "//l.example/?uddg=%ZZ"]
    assert column(spark, hrefs, "string", t.resolve_redirect) == ["", "https://example.com/a", "https://a.b/c?d=1", "/l/?uddg=", "https://x.y/z", "https://l.example/?uddg=%ZZ"]


def test_tokens_and_stems(spark):
    assert one(spark, t.tokens(F.col("s")), s="The snake_case, (Words) and A._b　全角。 are") == ["snake", "case", "words", "a.", "b", "全角"]
    assert column(spark, ["nations", "running", "the", "cats", "national", "bed", "xment", "quickly"], "string", t.stem) == [
        "nat", "runn", "the", "cat", "nation", "bed", "xment", "quick",
    ]
    assert one(spark, t.bigrams(F.col("a")), a=["x", "y", "z"]) == ["x y", "y z"]
    assert one(spark, t.bigrams(F.col("a")), a=["x"]) == []


def test_token_estimate(spark):
    assert column(spark, ["", "a", "abcdefgh", "漢字漢字", "漢字abcd"], "string", t.token_estimate) == [0, 1, 2, 3, 3]


def test_noise_and_code(spark):
    assert column(spark, ["Click here to continue", "short", "A plain sentence of some length"], "string", t.is_noise) == [True, True, False]
    assert column(spark, ["```x```", "x"], "string", t.has_code) == [True, False]


def test_garbled(spark):
    latin = "这是一段中文内容".encode("gbk").decode("latin-1")
    values = ["", "plain text", "bad � text", "\x01\x02ab", latin, "\x85\x86\x87a"]
    expected = [t._garbled(v) for v in values]
    assert column(spark, values, "string", t.is_garbled) == expected == [False, False, True, True, False, True]
    out = column(spark, [["plain text", "\x85\x86\x87\x88", "has �"], ["nothing here"], []], "array<string>", lambda v: t.repair_sentences(v, F.array_join(v, " ")))
    assert out[0][0] == "plain text" and len(out[0]) <= 2 and "has �" not in out[0]
    assert out[1:] == [["nothing here"], []]


FENCES = [
    ("Intro sentence here. Another one.\n```py\nx = 1\ny = 2\n```\nClosing sentence here.", ["Intro sentence here.", "Another one.", "```py\nx = 1\ny = 2\n```", "Closing sentence here."]),
    ("Before the code.\n```\nnever closed code\nmore", ["Before the code.", "```\nnever closed code\nmore"]),
    ("```\na\n```\nshort", []),
    ("one line. Two lines here\r\nthird line here", ["Two lines here", "third line here"]),
    ("Ends here。Weiter geht es", ["Ends here。", "Weiter geht es"][1:]),
]


def test_fenced_sentences(spark):
    got = column(spark, [f[0] for f in FENCES], "string", t.sentences)
    assert got[0] == ["Intro sentence here.", "Another one.", "```py\nx = 1\ny = 2\n```", "Closing sentence here."]
    assert got[1:3] == [FENCES[1][1], FENCES[2][1]]
    assert got[3] == ["Two lines here", "third line here"]


def model_sentences(text):
    """The sentences of plain text, by a walk over its characters."""
    text, out, buf, i = text.replace("\r\n", "\n"), [], "", 0
    while i < len(text):
        ch = text[i]
        buf += ch
        if ch == "\n":
            out.append(buf)
            buf = ""
        elif ch in ".!?;。！？；":
            j = i + 1
            while j < len(text) and text[j] in " \t":
                j += 1
            if j >= len(text) or text[j] == "\n" or text[j].isupper():
                out.append(buf)
                buf, i = "", j - 1
        i += 1
    out.append(buf)
    return [s for s in (x.strip() for x in out) if len(s) >= 10]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="abcDE .!;\n\t。", max_size=60), min_size=1, max_size=30))
def test_sentences_follow_the_model(spark, texts):
    assert column(spark, texts, "string", t.sentences) == [model_sentences(x) for x in texts]


TIDE = "High water reaches the old harbour wall twice on most days"
DEDUPE = [
    ([TIDE + ".", TIDE + "."], [0]),
    ([TIDE + ".", TIDE.upper() + " ?!", "»" + TIDE.replace(" ", " - ") + "«"], [0]),
    ([TIDE + ".", TIDE.replace("twice", "once") + "."], [0, 1]),
    (["Gulls nest here.", TIDE, "Nets dry there.", "gulls nest HERE", TIDE], [0, 1, 2]),
    (["!!!!!!!!!!", "??????????", "words follow here"], [0, 2]),
    (["a" * 150, "a" * 149 + "b", "b" * 150], [0, 2]),
    (["a" * 99, "a" * 98 + "b"], [0, 1]),
    (["a" * 120 + "é", "a" * 120 + "e"], [0, 1]),
    (["x" * 300, "x" * 298 + "yy", "x" * 296 + "yyyy"], [0, 2]),
    ([], []),
]


def test_dedupe(spark):
    got = column(spark, [d[0] for d in DEDUPE], "array<string>", t.dedupe)
    assert got == [[items[i] for i in kept] for items, kept in DEDUPE]
    assert column(spark, got, "array<string>", t.dedupe) == got


def test_dedupe_of_many_repeats(spark):
    items = [f"line number {i % 700} of the list" for i in range(3000)]
    assert column(spark, [items], "array<string>", t.dedupe) == [items[:700]]


def test_tally(spark):
    got = column(spark, [["b", "a", "b"], []], "array<string>", t.tally)
    assert got == [{"b": 2, "a": 1}, {}]
    roots = [["c++", "a.b", "x\\Ey"], []]
    words = [["c++11", "acb", "a.bc", "x\\Eyz", "xc++"], ["a"]]
    df = spark.createDataFrame([(i, r, w) for i, (r, w) in enumerate(zip(roots, words))], "i int, r array<string>, w array<string>")
    found = df.select("i", F.filter("w", lambda w: F.regexp_instr(w, t.beginning(F.col("r"))) == 1).alias("f")).orderBy("i").collect()
    assert [r.f for r in found] == [["c++11", "a.bc", "x\\Eyz"], []]


def test_comments(spark):
    df = spark.createDataFrame([([("ann", "hi", 3.9), ("bob", "yo", 0.0)],)], "c array<struct<author:string,text:string,like_count:double>>")
    assert df.select(t.format_comments(F.col("c"))).first()[0] == "- ann: hi (likes: 3)\n- bob: yo (likes: 0)"


def test_fixed_values():
    assert len(c.STOP_WORDS) == 85 and len(set(c.STOP_WORDS)) == 85
    assert len(c.NOISE_PHRASES) == 35 and len(c.WHITE_SPACE) == 25 and not re.sub(r"\s", "", c.WHITE_SPACE)
