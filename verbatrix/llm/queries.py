"""Registered queries over the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, mixing, quality, secrets, sentencepiece_fst, simhash, token_counts, toxicity, warc
from .common import durable, held_out, remove, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.round_trip(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op2_secrets, which SQL can express."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _either_case(name: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_KINDS_SQL = f"""(VALUES (0, 'assign', '(?:{_NAMES})["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+', '^(?:{_NAMES})["'']?\\x20*[:=]\\x20*["'']?', 6),
  (1, 'access', 'AKIA[A-Z0-9]+', '^', 20), (2, 'hex', '[0-9a-f]+', '^', 24)) AS v(place, kind, pattern, before, least)"""

#: Matches are marked, and what stands between the marks is counted.
SECRETS_BASE_SQL = f"""
WITH k AS (SELECT * FROM {_KINDS_SQL}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
marked AS (
  SELECT r, place, kind, before, least, string_split(regexp_replace(t, '(' || pattern || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts
  FROM d, k WHERE regexp_matches(t, pattern)),
each AS (SELECT r, place, kind, before, least, unnest(range(1, len(parts))) AS i, parts FROM marked),
found AS (
  SELECT r, place, kind, list_sum(list_transform(parts[1:i], lambda x: length(replace(x, chr(2), '')))) AS a, string_split(parts[i + 1], chr(2))[1] AS m, before, least FROM each),
spans AS (SELECT r, place, kind, CAST(a AS BIGINT) AS a, CAST(a AS BIGINT) + length(m) AS b FROM found WHERE length(regexp_replace(m, before, '')) >= least),
joined AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN joined USING (r)
"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_mixing that don't depend on hashes, which SQL can express."""
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


#: Sources that are full leave the sharing, a round at a time.
MIXING_TARGETS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, place FROM s),
rounds AS (
  SELECT 0 AS k, (SELECT CAST(sum(source_size) AS DOUBLE) FROM w) AS left_, (SELECT CAST(sum(weight) AS DOUBLE) FROM w) AS share
  UNION ALL
  SELECT k + 1,
    (SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (weight * left_ / share > 3 * source_size), 0) FROM w),
    (SELECT coalesce(sum(weight) FILTER (weight * left_ / share <= 3 * source_size), 0) FROM w)
  FROM rounds WHERE k < 50 AND share > 0),
last AS (SELECT left_, share FROM rounds WHERE share > 0 ORDER BY k DESC LIMIT 1)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(least(weight * left_ / share, 3.0 * source_size), 4) AS target
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source, last
"""


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with their word counts, then revised to a merge
    tokenizer's counts; that batch is delivered twice; documents without a word go."""
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select(token_counts.doc_key().alias("doc_key"), "source", "lang", "text")
    path = shared_dir(spark, "token-counts")
    rollup = token_counts.TokenRollup(spark, path)
    words = keyed.withColumn("n_tokens", mixing.word_count(F.col("text"))).drop("text")
    rollup.apply("load", words.withColumns({"op": F.lit("insert"), "tokenizer": F.lit("words_1")}))
    revised = token_counts.bpe_counts(keyed).withColumns({"op": F.lit("revise"), "tokenizer": F.lit("byte_bpe_50k")})
    rollup.apply("retokenise", revised)
    rollup.apply("retokenise", revised)
    rollup.apply("withdraw", words.filter("n_tokens = 0").withColumns({"op": F.lit("delete"), "tokenizer": F.lit("byte_bpe_50k")}))
    totals = durable(rollup.totals())
    remove(spark, path)
    return totals


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, source, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r),
f AS (
  SELECT w.r, doc_id, source, len(ws) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad
  FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT coalesce(avg(bad / n), 0) AS m, var_pop(bad / n) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 THEN least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM p),
verdict AS (SELECT source, (bad + m * k) / (n + k) <= 0.7 AS host_ok FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_ok, TRUE) AS kept
FROM b LEFT JOIN verdict USING (source)
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)

    def named(uri: str):
        return F.regexp_extract(uri, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")

    rows = durable(
        warc.read(spark, path).select(
            named("record_id").alias("page_id"),
            "payload_bytes",
            F.col("payload_sha1").alias("payload_digest"),
            F.col("type").alias("record_type"),
            named("refers_to").alias("refers_to"),
            "valid",
        )
    )
    remove(spark, path)
    return rows


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top > page_id THEN top END AS refers_to, TRUE AS valid
FROM m
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_secrets": op2_secrets,
    "op3_langid": op3_langid,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "secrets_base": secrets_base,
    "mixing_targets": mixing_targets,
}

ORACLES = {
    "op7_quality": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "secrets_base": SECRETS_BASE_SQL,
    "mixing_targets": MIXING_TARGETS_SQL,
}
