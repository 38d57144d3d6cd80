"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import castore, chat, clusters, codes, langid, media, mixing, packing, quality, rules, simhash, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_features(table(spark, sf_dir, "documents"))
    feature = F.lower(F.hex("hash")).alias("feature")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature, "hash", "height", "fault")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.select("page_id", "host", "declared", "text_lang", "lang", "probability")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl log that ``pages`` implies, resolved; headers as one text, bodies as digest and size."""
    records = warc.crawl_of(table(spark, sf_dir, "pages"))
    digested = records.withColumns({"body_md5": F.md5("html"), "body_chars": F.char_length("html").cast("bigint")})
    found = warc.resolve(digested, payload=("body_md5", "body_chars"))
    headers = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select("record_id", F.col("key").alias("canonical_url"), "status", "source", "verdict", headers.alias("headers"), "body_md5", "body_chars")


def op5_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return castore.verify(castore.build(table(spark, sf_dir, "documents"), end_id=2))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=2048, end_id=1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored once; the policy and its ablation read the stored bits."""
    found = rules.with_ablation(rules.stored_ledger(table(spark, sf_dir, "documents")), "v1")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "n_saved")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target shares of the output: every source the same, whatever it holds."""
    found = mixing.replicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "lang", "source", "n_chars", F.round("rate", 9).alias("rate"), "n_copies", "copy", "order_key")


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and one that says control strings; digests are of what is read back from the formatted texts."""
    return chat.round_trip(chat.with_probe(table(spark, sf_dir, "conversations")))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.with_inertia(*clusters.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dims=64, scale=1024.0))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.with_label_errors(*codes.encode(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, dims=64, scale=256.0))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_quality_classifier, op3_language_id, op4_warc_revisits, op5_content_store, op6_packing, op7_toxicity, op8_simhash, op9_quality_rules,
        op10_mixing, op11_chat_formatting, op12_centroid_clustering, op13_vector_codes,
    )
}

SQL: dict[str, str] = {}

SQL["op9_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM p) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, len(regexp_extract_all(t, '\p{Lu}')) AS n_upper
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END)
         + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 43) = 0 AS kept, fail_bits,
  CASE WHEN bit_count(fail_bits & 43) = 1 THEN (SELECT count(*) FROM b o WHERE (o.fail_bits & 43) = (b.fail_bits & 43)) END AS n_saved FROM b
"""

SQL["op10_mixing"] = f"""
WITH n AS (SELECT source, count(*) AS n, 1.0e0 AS weight FROM documents GROUP BY source),
r AS (SELECT source, CAST((SELECT sum(n) FROM n) AS DOUBLE) * weight / ((SELECT sum(weight) FROM n) * n) AS rate FROM n),
d AS (
  SELECT d.*, r.rate, (CAST(CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0 AS u
  FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
span AS (SELECT source, rate, CAST(greatest(0e0, floor(rate - 12 * sqrt(rate) - 20)) AS BIGINT) AS low, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) AS high FROM r),
terms AS (SELECT source, low, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM (SELECT *, unnest(range(low, high + 1)) AS k FROM span)),
c AS (SELECT source, low, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
draw AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.rate, (SELECT min(c.low) + count(*) FILTER (WHERE c.c < d.u) FROM c WHERE c.source IS NOT DISTINCT FROM d.source) AS n_copies
  FROM d)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, CAST(n_copies AS INTEGER) AS n_copies, CAST(copy AS INTEGER) AS copy,
       CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy), 1, 15) AS BIGINT) AS order_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM draw WHERE n_copies > 0)
"""

SQL["op4_warc_revisits"] = r"""
WITH p AS (SELECT page_id, url, html, '"' || md5(coalesce(html, '')) || '"' AS tag, strftime(make_timestamp((page_id * 60 - 86400) * 1000000), '%d %b %Y %H:%M:%S') AS day FROM pages),
k AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', 2), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/@?#]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '^\?', ''), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[a-z]+|gclid|fbclid|ref|sessionid)(=|$)'))) AS q
  FROM p),
c AS (SELECT *, CASE WHEN url IS NOT NULL AND host <> '' THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS key FROM k),
full_ AS (SELECT 2 * page_id AS record_id, page_id * 60 AS at, * FROM c),
back AS (SELECT 2 * page_id + 1 AS record_id, page_id * 60 + 86400 AS at, *, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 5 = 0 THEN '"0"' WHEN page_id % 2 = 0 THEN 'W/' || tag ELSE tag END AS sent FROM c),
found AS (
  SELECT b.record_id, max_by(f.page_id, f.at * 1000000000 + f.record_id) AS src FROM back b JOIN full_ f ON f.key = b.key AND f.at <= b.at GROUP BY b.record_id),
j AS (
  SELECT b.*, s.page_id AS src, s.tag AS stag, s.day AS sday, s.html AS shtml,
    CASE WHEN s.page_id IS NULL THEN 'no earlier response'
         WHEN b.sent IS NOT NULL AND regexp_replace(b.sent, '^W/', '') <> s.tag THEN 'validators differ'
         WHEN b.sent IS NULL AND b.page_id > s.page_id THEN 'validators differ' ELSE 'resolved' END AS verdict
  FROM back b LEFT JOIN found f ON f.record_id = b.record_id LEFT JOIN c s ON s.page_id = f.src)
SELECT record_id, key AS canonical_url, CAST(200 AS INTEGER) AS status, CAST(NULL AS BIGINT) AS source, 'response' AS verdict,
  'ETag: ' || tag || chr(10) || 'Last-Modified: ' || day || chr(10) || 'Content-Type: text/html' || chr(10) || 'Cache-Control: max-age=60' AS headers, md5(html) AS body_md5, CAST(length(html) AS BIGINT) AS body_chars
FROM full_
UNION ALL
SELECT record_id, key, CAST(304 AS INTEGER), CASE WHEN verdict = 'resolved' THEN 2 * src END, verdict,
  CASE WHEN verdict = 'resolved' AND sent IS NULL THEN 'cache-control: max-age=90' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || stag || chr(10) || 'last-modified: ' || day
       WHEN verdict = 'resolved' THEN 'cache-control: max-age=90' || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || sent || chr(10) || 'last-modified: ' || sday
       WHEN sent IS NULL THEN 'Last-Modified: ' || day || chr(10) || 'Cache-Control: max-age=90'
       ELSE 'ETag: ' || sent || chr(10) || 'Cache-Control: max-age=90' || chr(10) || 'Content-Type: text/plain' END,
  CASE WHEN verdict = 'resolved' THEN md5(shtml) END, CASE WHEN verdict = 'resolved' THEN CAST(length(shtml) AS BIGINT) END
FROM j
""".replace("\\\\", "\\")

# sizes of the blocks' marks: those of the role, of other roles with the role itself, and of the seam
SQL["op11_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT CAST(-7 AS BIGINT), 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, {escape})) AS n, length(regexp_replace(role, {escape})) AS role_n FROM t),
o AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, lead(role) OVER w AS after FROM e
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (
  SELECT *, before IS DISTINCT FROM role AS first, CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 3 ELSE 12 + role_n END AS opening,
    CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 7 WHEN 'assistant' THEN 4 ELSE 7 END AS closing FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN first THEN opening ELSE 6 END + CASE WHEN after IS DISTINCT FROM role THEN closing ELSE 0 END) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (WHERE first) AS INTEGER) AS n_blocks, CAST(count(*) FILTER (WHERE role = 'assistant') AS INTEGER) AS n_spans
FROM s GROUP BY conv_id
""".replace("{escape}", r"'([<\[])(\\*(?:s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|ROLE\]|/ROLE\]|TURN\]))', '\1\\\2', 'g'")

_ASSIGN = "a{r} AS MATERIALIZED (SELECT id, arg_min(j, d * 64 + j) AS j, min(d) AS d FROM (SELECT v.id, c.j, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{r} c USING (i) GROUP BY v.id, c.j) GROUP BY id)"
_UPDATE = "c{n} AS MATERIALIZED (SELECT c.j, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT a.j, v.i, CAST(floor(sum(v.x)::HUGEINT / count(*)) AS BIGINT) AS x FROM v JOIN a{r} a USING (id) GROUP BY a.j, v.i) m USING (j, i))"
_ROUNDS = ", ".join(f"{_ASSIGN}, {_UPDATE}".replace("{r}", str(r)).replace("{n}", str(r + 1)) for r in range(10)) + ", " + _ASSIGN.replace("{r}", "10")

SQL["op12_centroid_clustering"] = f"""
WITH e AS (
  SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT id, i, CAST(floor(1024e0 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT id, unnest(embedding) AS x, unnest(range(64)) AS i FROM e)),
f AS (SELECT id, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, embedding) - 1 AS j FROM e QUALIFY j < 8),
c0 AS MATERIALIZED (SELECT f.j, v.i, v.x FROM f JOIN v USING (id)),
{_ROUNDS},
h AS (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c10 GROUP BY j),
s AS (SELECT j, CAST(sum(d) AS BIGINT) AS s FROM a10 GROUP BY j)
SELECT e.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, s.s AS cluster_inertia, CAST((SELECT sum(s) FROM s) AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM e JOIN a10 a USING (id) JOIN s USING (j) JOIN h USING (j)
"""

_ASSIGN = "a{r} AS MATERIALIZED (SELECT id, p, arg_min(j, d * 64 + j) AS j, min(d) AS d FROM (SELECT v.id, v.p, c.j, (v.x0 - c.x0) * (v.x0 - c.x0) + (v.x1 - c.x1) * (v.x1 - c.x1) + (v.x2 - c.x2) * (v.x2 - c.x2) + (v.x3 - c.x3) * (v.x3 - c.x3) AS d FROM v JOIN c{r} c USING (p)) GROUP BY id, p)"
_UPDATE = "c{n} AS MATERIALIZED (SELECT c.j, c.p, " + ", ".join(f"coalesce(m.x{i}, c.x{i}) AS x{i}" for i in range(4)) + " FROM c{r} c LEFT JOIN (SELECT a.j, a.p, " + ", ".join(f"CAST(floor(sum(v.x{i})::HUGEINT / count(*)) AS BIGINT) AS x{i}" for i in range(4)) + " FROM v JOIN a{r} a USING (id, p) GROUP BY a.j, a.p) m USING (j, p))"
_ROUNDS = ", ".join(f"{_ASSIGN}, {_UPDATE}".replace("{r}", str(r)).replace("{n}", str(r + 1)) for r in range(2)) + ", " + _ASSIGN.replace("{r}", "2")

SQL["op13_vector_codes"] = f"""
WITH e AS (
  SELECT row_number() OVER () AS id, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT id, p, {", ".join(f"CAST(floor(256e0 * CAST(embedding[4 * p + {i + 1}] AS DOUBLE)) AS BIGINT) AS x{i}" for i in range(4))} FROM (SELECT id, embedding, unnest(range(16)) AS p FROM e)),
f AS (SELECT id, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS j FROM e QUALIFY j < 64),
c0 AS MATERIALIZED (SELECT f.j, v.p, v.x0, v.x1, v.x2, v.x3 FROM f JOIN v USING (id)),
{_ROUNDS},
k AS (SELECT id, string_agg(lpad(lower(to_hex(j)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY id),
h AS (SELECT sha256(string_agg(x0 || ',' || x1 || ',' || x2 || ',' || x3, ',' ORDER BY p, j)) AS h FROM c2),
l AS (SELECT e.label, CAST(sum(k.error) AS BIGINT) AS label_error FROM e JOIN k USING (id) GROUP BY e.label)
SELECT e.vec_id, k.code, k.error, l.label_error, (SELECT h FROM h) AS codebooks_sha256 FROM e JOIN k USING (id) JOIN l ON e.label IS NOT DISTINCT FROM l.label
"""
