"""One query per operator of this subpackage over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import byte_bpe, decontaminate, divergence, jaccard_join, langid, mixing, pii, sharding, topk, toxicity, url_filter, warc, whitening
from ferrule.llm.common import read

#: The rules of the URL query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op1_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.count_links(read(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"), k=10, scale=1024)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(langid.fold("doc_id", 5) != 0)
    scored = toxicity.classify(read(spark, sf_dir, "documents"), labels)
    held_out = F.coalesce(langid.fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is what the crawl has of spam hosts and of thin pages, since the tables hold none of their own; ``judge`` takes any list."""
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.entries(url_filter.spam(pages).unionByName(url_filter.thin(pages))), RULES)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(langid.fold("doc_id", 4) != 2))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents"), vocabulary), vocabulary)
    n = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_exact_topk,
        op3_sharding,
        op4_toxicity,
        op5_benchmark_decontamination,
        op6_warc,
        op7_pii,
        op8_url_filter,
        op9_language_id,
        op10_mixing,
        op11_whitening,
        op12_byte_bpe,
        op13_divergence,
        op1_jaccard_links,
    )
}

ORACLE_SQL = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.a = w.doc_id GROUP BY w.doc_id""",
    "op1_jaccard_links": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, count(*) AS c FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c) GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(e.c, 0) AS n_links FROM w LEFT JOIN n USING (doc_id) LEFT JOIN e ON e.a = w.doc_id""",
    "op2_exact_topk": r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""",
    "op8_url_filter": r"""
WITH u AS (
  SELECT page_id, url, len(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<[^>]*>', ' ', 'g'), '[^\x20\x09-\x0D]+')) AS words,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m|blog)\.', '') || rtrim(path, '/') END AS canon FROM u),
l AS (SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL AND (words < 60 OR regexp_matches(host, '(^|[.-])spam([.-]|$)'))),
f AS (SELECT page_id, host, path, canon, canon IN (SELECT canon FROM l) AS listed,
  CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, canon, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR coalesce(listed, false) THEN 'block' ELSE 'allow' END AS verdict
FROM f""",
    "op10_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    substr(md5('29:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
b AS (SELECT greatest(1, least({mixing.BLOCK_WORDS}, CAST(sum(source_size) AS BIGINT) // {mixing.LEAST_SLOTS})) AS words, CAST(sum(source_size) AS BIGINT) AS total FROM s),
w AS (SELECT *, (sid - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM w WINDOW f AS (ORDER BY source_size::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, 3 * source_size <= level * weight AS full_ FROM l),
t AS (SELECT sid, source, source_size, CASE WHEN full_ THEN (3 * source_size)::DOUBLE ELSE max(CASE WHEN NOT full_ THEN level END) OVER () * weight END AS target FROM g),
c AS (SELECT *, coalesce(sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
  sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM t),
spans AS (SELECT sid, floor(lo / max(hi) OVER () * {mixing.PERIOD}) AS lo, floor(hi / max(hi) OVER () * {mixing.PERIOD}) AS hi FROM c),
slots AS (SELECT slot, slot % {mixing.PERIOD} * {mixing.STEP} % {mixing.PERIOD} AS point FROM (SELECT unnest(range((total + words - 1) // words)) AS slot FROM b)),
sched AS (SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM slots JOIN spans ON point >= lo AND point < hi),
h AS (SELECT sid, count(*) AS drawn FROM sched GROUP BY sid),
o AS (SELECT d.*, t.sid, t.source_size, t.target, b.words, least(coalesce(h.drawn, 0) * b.words, 3 * t.source_size) AS most,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN h ON h.sid = t.sid, b),
r AS (SELECT *, greatest(0, least(start + size, most) - start) + greatest(0, least(source_size + start + size, most) - source_size - start)
    + greatest(0, least(2 * source_size + start + size, most) - 2 * source_size - start) AS taken FROM o)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken, CASE WHEN taken > 0 THEN slot END AS first_slot
FROM r LEFT JOIN sched ON sched.sid = r.sid AND rank = start // words""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT x.lang, x.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS n, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.n + 5 * g.v) AS BIGINT) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL SELECT p.lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50""",
}
