"""Scalar and array expressions over text.

All stay in the JVM but for ``repair_sentences``, whose Python side sees only
rows that have a garbled sentence.  Null text gives null, unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as c

_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
_BLANK = "[" + "".join(f"\\x{{{ord(x):x}}}" for x in c.WHITE_SPACE if x != "\n") + "]"
FENCE = rf"(?dms)^{_BLANK}*```[^\n]*(?:\n{_BLANK}*```[^\n]*|\n.*?\n{_BLANK}*```[^\n]*|\n.*\z|\z)"
SENTENCE_END = r"([.!?;。！？；])[ \t]*(\p{Lu})"
VIDEO_ID = r"(?:youtube\.com/(?:watch\?v=|shorts/|embed/|live/|v/)|youtu\.be/)([A-Za-z0-9_-]{11})"
#: A character that only garbled text has.
SUSPECT = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{80}-\x{9F}\x{FFFD}]"


def _by_first(phrases: list[str]) -> str:
    """A pattern for any of ``phrases`` that tells them apart by their first two characters."""
    groups: dict[str, list[str]] = {}
    for p in phrases:
        groups.setdefault(p[:2], []).append(re.escape(p[2:]).replace("\\ ", " "))
    return "|".join(f"{re.escape(k)}(?:{'|'.join(v)})" for k, v in groups.items())


NOISE = _by_first(c.NOISE_PHRASES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _strings() -> Column:
    return F.array().cast("array<string>")


def trimmed(text: Column) -> Column:
    """``text`` without white space at both ends, as Unicode has it."""
    return F.btrim(text, F.lit(c.WHITE_SPACE))


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


# limits and truncation


def normalize_limit(limit: Column) -> Column:
    """A fetch limit in bytes: 0 (none) for 0 and less, else 2,000 to 64,000 in steps of 1,000."""
    held = F.least(F.greatest(limit, F.lit(c.MIN_LIMIT)), F.lit(c.MAX_LIMIT))
    return F.when(limit <= 0, F.lit(0)).otherwise((F.floor((held + c.LIMIT_STEP // 2) / c.LIMIT_STEP) * c.LIMIT_STEP).cast("int"))


def clamp_results(n: Column) -> Column:
    """How many results a search gives: 10 for null, 0 and less, else 5 to 50."""
    return F.when(n.isNull() | (n <= 0), F.lit(c.DEFAULT_RESULTS)).otherwise(F.least(F.greatest(n, F.lit(c.MIN_RESULTS)), F.lit(c.MAX_RESULTS)))


def truncate(text: Column, limit: Column) -> Column:
    """The first ``limit`` bytes and a notice, or ``text`` if it isn't longer or the limit isn't positive.

    A code point that is cut becomes U+FFFD.
    """
    size = byte_length(text)
    head = F.make_valid_utf8(F.substring(text.cast("binary"), F.lit(1), limit).cast("string"))
    notice = F.concat(F.lit("\n\n---\n*Content truncated to "), limit.cast("string"), F.lit(" characters (original: "), size.cast("string"), F.lit(" characters)*"))
    return F.when((limit <= 0) | (size <= limit), text).otherwise(F.concat(head, notice))


# sentences


def plain_sentences(text: Column) -> Column:
    """Sentences of text without code: broken at new lines and where a sentence ends before an upper-case letter."""
    parts = F.split(F.regexp_replace(text, SENTENCE_END, "$1\n$2"), "\n")
    return F.filter(F.transform(parts, trimmed), lambda s: F.char_length(s) >= c.MIN_SENTENCE)


def sentences(text: Column) -> Column:
    """Sentences of ``text``; a fenced code block is one.  U+0001 in the text becomes U+FFFD."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\x01"), F.lit("�"))
    marked = F.split(F.regexp_replace(unix, FENCE, "\x01$0\x01"), "\x01")

    def of_part(part: Column, i: Column) -> Column:
        block = F.filter(F.array(trimmed(part)), lambda s: F.char_length(s) >= c.MIN_SENTENCE)
        return F.when(i % 2 == 1, block).otherwise(plain_sentences(part))

    return F.when(text.contains("```"), F.flatten(F.transform(marked, of_part))).otherwise(plain_sentences(unix))


def is_garbled(s: Column) -> Column:
    """Whether text looks mis-decoded: U+FFFD, many C1 controls without CJK, or many C0 controls."""
    size = F.char_length(s)
    high = F.regexp_count(s, F.lit(r"[\x{80}-\x{9F}]")) > 0.3 * size
    low = F.regexp_count(s, F.lit(r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}]")) > 0.1 * size
    return (size > 0) & (s.contains("�") | (high & ~s.rlike(_CJK)) | low)


def _garbled(s: str) -> bool:
    n = len(s)
    if not n:
        return False
    high, low = sum(0x80 <= ord(x) <= 0x9F for x in s), sum(ord(x) < 32 and x not in "\n\r\t" for x in s)
    cjk = any("⺀" <= x <= "鿿" or "぀" <= x <= "ヿ" or "가" <= x <= "힣" or "\U00020000" <= x <= "\U0003ffff" for x in s)
    return "�" in s or (high > 0.3 * n and not cjk) or low > 0.1 * n


def repair(s: str) -> str:
    """``s`` read again from its Latin-1 bytes in the first character set that gives clean text; else empty."""
    try:
        data = s.encode("latin-1")
    except UnicodeEncodeError:
        return ""
    for codec in c.REPAIR_CODECS:
        try:
            out = data.decode(codec, "replace")
        except LookupError:
            continue
        if out and not _garbled(out):
            return out
    return ""


@F.pandas_udf(T.ArrayType(T.StringType()))
def _repaired(rows: pd.Series) -> pd.Series:
    def one(items):
        return None if items is None else [x for x in (repair(s) if _garbled(s) else s for s in items) if x]

    return rows.map(one, na_action="ignore")


def repair_sentences(items: Column, text: Column) -> Column:
    """Garbled items repaired or dropped, others as they are; ``text`` is what they come from."""
    return F.coalesce(_repaired(F.when(text.rlike(SUSPECT), F.when(F.exists(items, is_garbled), items))), items)


def has_code(s: Column) -> Column:
    return s.contains("```")


def is_noise(s: Column) -> Column:
    """Whether a sentence is page furniture or shorter than 15 characters."""
    return F.lower(s).rlike(NOISE) | (F.char_length(trimmed(s)) < c.MIN_CLEAN)


def token_estimate(s: Column) -> Column:
    """About how many model tokens ``s`` has: CJK characters count 1/1.5, others 1/4; 1 at least if there is any."""
    cjk = F.regexp_count(s, F.lit(_CJK))
    return F.when(s == "", F.lit(0)).otherwise(F.ceil(F.greatest(F.lit(1.0), cjk / 1.5 + (F.char_length(s) - cjk) / 4.0)).cast("int"))


def measure(s: Column, by_tokens: bool) -> Column:
    return token_estimate(s) if by_tokens else F.char_length(s)


# near-duplicate sentences


def dedupe_key(s: Column) -> Column:
    """The letters and digits of ``s``, lower-cased."""
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{Nd}]", ""))


def _as_bytes(s: Column) -> Column:
    """A string with one character for each byte of ``s``."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def similar(a: Column, b: Column) -> Column:
    """Whether two keys' edit distance in bytes is under a hundredth of the longer; false if one is empty."""
    la, lb = byte_length(a), byte_length(b)
    most = F.greatest(la, lb)
    distance = F.call_function("levenshtein", _as_bytes(a), _as_bytes(b), F.floor((most - 1) / 100).cast("int"))
    return (la > 0) & (lb > 0) & ((a == b) | ((most > 100) & (F.abs(la - lb) * 100 < most) & (distance >= 0)))


def dedupe(items: Column) -> Column:
    """Items in order without those that equal or resemble an item kept before.

    Equal keys go first.  Only keys of 100 bytes or more can resemble another
    one, so the fold over what is kept runs over those alone.
    """

    def firsts(rows: Column) -> Column:
        def of_sorted(by_key: Column) -> Column:
            kept = F.filter(by_key, lambda r, j: (j == 0) | (r.k != F.get(by_key, j - 1).k))
            return F.sort_array(F.transform(kept, lambda r: F.struct(r.i.alias("i"), r.k.alias("k"), r.s.alias("s"))))

        repeats = F.size(F.array_distinct(F.transform(rows, lambda r: r.k))) < F.size(rows)
        sorted_rows = F.sort_array(F.transform(rows, lambda r: F.struct(r.k.alias("k"), r.i.alias("i"), r.s.alias("s"))))
        return F.when(repeats, let(sorted_rows, of_sorted)).otherwise(rows)

    def without_similar(rows: Column) -> Column:
        long = F.filter(rows, lambda r: byte_length(r.k) >= 100)
        none = F.filter(rows, lambda r: F.lit(False))
        kept = F.aggregate(long, none, lambda acc, x: F.when(F.exists(acc, lambda k: similar(k.k, x.k)), acc).otherwise(F.array_append(acc, x)))
        return let(kept, lambda ks: F.filter(rows, lambda r: (byte_length(r.k) < 100) | F.exists(ks, lambda k: k.k == r.k)))

    keyed = F.transform(items, lambda s, i: F.struct(i.alias("i"), dedupe_key(s).alias("k"), s.alias("s")))
    out = let(let(keyed, firsts), lambda rows: F.when(F.size(F.filter(rows, lambda r: byte_length(r.k) >= 100)) < 2, rows).otherwise(without_similar(rows)))
    return F.transform(out, lambda r: r.s)


# tokens


def token_parts(text: Column) -> Column:
    """Lower-case words without punctuation at their ends, cut at underscores; stop words and empty ones may be among them."""
    words = F.split(F.lower(text), r"(?U)\s+")
    return F.flatten(F.transform(words, lambda w: F.split(F.btrim(w, F.lit(c.TOKEN_TRIM)), "_")))


def is_token(part: Column) -> Column:
    return (part != "") & ~part.isin(c.STOP_WORDS)


def tokens(text: Column) -> Column:
    """``token_parts`` without stop words and empty ones."""
    return F.filter(token_parts(text), is_token)


def stem(word: Column) -> Column:
    """``word`` without the first listed suffix that leaves 3 bytes or more; words under 4 bytes stay."""
    size, out = byte_length(word), F.when(byte_length(word) < 4, word)
    for suffix in c.SUFFIXES:
        out = out.when(F.endswith(word, F.lit(suffix)) & (size - len(suffix) >= 3), F.left(word, F.char_length(word) - len(suffix)))
    return out.otherwise(word)


def stems(words: Column) -> Column:
    return F.transform(words, stem)


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a space."""
    return F.when(F.size(words) < 2, _strings()).otherwise(
        F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    )


def beginning(roots: Column) -> Column:
    """A pattern for what any of ``roots`` begins; one that never matches if there is none."""
    quoted = F.transform(roots, lambda r: F.concat(F.lit("\\Q"), F.replace(r, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.when(F.size(roots) == 0, F.lit("(?!)")).otherwise(F.concat(F.lit("^(?:"), F.array_join(quoted, "|"), F.lit(")")))


def tally(items: Column) -> Column:
    """How often each item is there, as a map."""
    return let(F.struct(items.alias("all"), F.array_distinct(items).alias("each")), lambda p: F.map_from_arrays(p.each, F.transform(p.each, lambda x: F.size(F.filter(p.all, lambda y: y == x)))))


def occurrences(items: Column, wanted: Column) -> Column:
    """The sum of what the map ``wanted`` has for each of ``items``."""
    return F.aggregate(items, F.lit(0), lambda acc, x: acc + F.coalesce(F.element_at(wanted, x), F.lit(0)))


# URLs and video pages


def resolve_redirect(href: Column) -> Column:
    """The target of a listing's link: its ``uddg`` parameter decoded twice, a scheme for ``//``, else itself."""
    once = F.try_url_decode(F.try_parse_url(F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href), F.lit("QUERY"), F.lit("uddg")))
    target = F.when(href.contains("uddg="), F.try_url_decode(once))
    plain = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    return F.when(target.isNotNull() & (target != ""), target).otherwise(plain)


def video_id(url: Column) -> Column:
    """The 11 characters that name a video; empty if ``url`` isn't of a known form."""
    return F.regexp_extract(url, VIDEO_ID, 1)


def transcript_budget(limit: Column) -> Column:
    return F.when(limit <= 0, F.lit(0)).otherwise((limit * 2 - F.pmod(limit * 2, F.lit(3))) / 3).cast("int")


def discussion_budget(limit: Column) -> Column:
    return F.when(limit <= 0, F.lit(0)).otherwise((limit - F.pmod(limit, F.lit(3))) / 3).cast("int")


def clean_subtitles(raw: Column) -> Column:
    """Subtitle text without cue numbers, times, tags, headers and lines that repeat the one before."""
    lines = F.transform(F.split(raw, "\n"), lambda line: trimmed(F.regexp_replace(line, "<[^>]+>", "")))
    kept = F.filter(lines, lambda s: (s != "") & ~s.rlike("^[0-9]+$") & ~s.contains("-->") & ~s.startswith("WEBVTT"))
    return let(kept, lambda ls: F.array_join(F.filter(ls, lambda s, i: (i == 0) | (s != F.get(ls, i - 1))), "\n"))


def format_comments(comments: Column) -> Column:
    """Comments (author, text, like_count) as lines."""
    line = lambda x: F.format_string("- %s: %s (likes: %d)", x.author, x.text, x.like_count.cast("bigint"))
    return F.array_join(F.transform(comments, line), "\n")


def format_duration(seconds: Column) -> Column:
    """Seconds as h:mm:ss, or m:ss under an hour."""
    s = seconds.cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def extractor_error(message: Column, stderr: Column) -> Column:
    """An error message with the first 300 bytes of what the extractor said."""
    said = F.make_valid_utf8(F.substring(trimmed(stderr).cast("binary"), 1, 300).cast("string"))
    return F.when(said == "", message).otherwise(F.concat(message, F.lit("\nstderr: "), said))
