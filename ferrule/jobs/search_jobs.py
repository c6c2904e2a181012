"""Search over documents and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.text import tokens
from ferrule.jobs import sql
from ferrule.jobs.registry import query
from ferrule.operators import neighbours, search
from ferrule.sources.tables import shared_folder, table
from ferrule.streaming import postings

QUERY = "token version license public ertion thre"
LEG, TOP = 20, 10

_TOKENS = f"tok AS (SELECT doc_id, lang, {sql.tokens('text')} AS t FROM documents)"
_BM25 = f"""{_TOKENS}, q AS (SELECT DISTINCT unnest({sql.tokens(f"'{QUERY}'")}) AS term),
st AS (SELECT count(*) AS n, avg(len(t)) AS avg FROM tok),
tf AS (SELECT doc_id, lang, term, len(list_filter(t, lambda x: x = term)) AS tf, len(t) AS len FROM tok, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
sc AS (SELECT doc_id, lang, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avg))), 9) AS score
  FROM tf JOIN df USING (term), st WHERE tf > 0 GROUP BY doc_id, lang)"""
_HASH = f"""{_TOKENS}, ex AS (SELECT doc_id, unnest(t) AS term FROM tok),
hw AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 2))::INTEGER AS bucket,
  sum(CASE WHEN ('0x' || substr(md5(term), 9, 2))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END) AS weight FROM ex GROUP BY 1, 2)"""


@query(f"WITH {_TOKENS} SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM tok")
def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY term")
def term_document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return search.term_statistics(table(spark, folder, "documents"))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc QUALIFY rank <= {TOP}")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    scored = search.bm25(table(spark, folder, "documents"), QUERY)
    return search.ranked(scored, TOP).withColumn("score", F.round("score", 6))


@query(f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc WHERE lang = 'de' QUALIFY rank <= {TOP}")
def bm25_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The filter comes before the ranking; statistics stay those of all documents."""
    scored = search.bm25(table(spark, folder, "documents"), QUERY, keep=F.col("lang") == "de")
    return search.ranked(scored, TOP).withColumn("score", F.round("score", 6))


@query(f"WITH {_HASH} SELECT doc_id, bucket, weight::DOUBLE AS weight FROM hw")
def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    return search.hashed(table(spark, folder, "documents"))


@query(f"WITH {_HASH} SELECT doc_id, round(CASE WHEN sum(weight * weight) = 0 THEN 1.0 ELSE sqrt(sum(weight * weight)) END, 6) AS norm FROM hw GROUP BY doc_id")
def hash_embedding_norm(spark: SparkSession, folder: str) -> DataFrame:
    return search.norms(search.hashed(table(spark, folder, "documents"))).withColumn("norm", F.round("norm", 6))


_COSINE = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s {where} QUALIFY rank <= 10"""


def _nearest(vectors: DataFrame, query_: DataFrame) -> DataFrame:
    scored = search.cosine(vectors, query_).select("vec_id", F.round("score", 9).alias("score"))
    return search.ranked(scored, TOP, id_="vec_id").withColumn("score", F.round("score", 6))


@query(_COSINE.format(where=""))
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return _nearest(vectors, vectors.orderBy("vec_id").limit(1))


@query(_COSINE.format(where="WHERE label IN (1, 2, 3)"))
def cosine_filtered(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return _nearest(vectors.where(search.condition({"label": {"$in": [1, 2, 3]}})), vectors.orderBy("vec_id").limit(1))


@query(f"""WITH {_BM25}, ex AS (SELECT doc_id, unnest(t) AS term FROM tok),
hw AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 2))::INTEGER AS bucket, sum(CASE WHEN ('0x' || substr(md5(term), 9, 2))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w FROM ex GROUP BY 1, 2),
hq AS (SELECT ('0x' || substr(md5(term), 1, 2))::INTEGER AS bucket, sum(CASE WHEN ('0x' || substr(md5(term), 9, 2))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w
  FROM (SELECT unnest({sql.tokens(f"'{QUERY}'")}) AS term) GROUP BY 1),
hn AS (SELECT doc_id, CASE WHEN sum(w * w) = 0 THEN 1.0 ELSE sqrt(sum(w * w)) END AS norm FROM hw GROUP BY 1),
hc AS (SELECT doc_id, round(sum(hw.w * hq.w) / any_value(norm) / (SELECT sqrt(sum(w * w)) FROM hq), 9) AS score FROM hw JOIN hq USING (bucket) JOIN hn USING (doc_id) GROUP BY doc_id),
legs AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {LEG}
  UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM hc QUALIFY rank <= {LEG}),
f AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM legs GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM f QUALIFY rank <= {TOP}""")
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 and hashed-cosine legs, fused by reciprocal rank."""
    docs = table(spark, folder, "documents")
    fused = search.fuse([search.ranked(leg, LEG) for leg in search.legs(docs, QUERY)])
    fused = fused.withColumn("score", F.round("score", 9))
    return search.ranked(fused, TOP).withColumn("score", F.round("score", 6))


@query("""SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND (source = 'src3' OR source IS DISTINCT FROM 'src0' AND n_chars IS NOT DISTINCT FROM 250 OR lang = 'de')
  AND NOT (source IS NOT DISTINCT FROM 'src1')""")
def metadata_filter(spark: SparkSession, folder: str) -> DataFrame:
    where = {
        "lang": {"$in": ["en", "de"]},
        "$and": [
            {"$or": [{"source": "src3"}, {"$and": [{"source": {"$ne": "src0"}}, {"n_chars": {"$eq": 250}}]}, {"lang": "de"}]},
            {"source": {"$ne": "src1"}},
        ],
    }
    return table(spark, folder, "documents").where(search.condition(where)).select("doc_id", "lang", "source")


def _asked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, folder, "embeddings")
    return vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.label <> 3)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= 10""")
def nearest_all_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vectors, of other labels than 3, of every twentieth vector, all cells probed, which is exact."""
    vectors, asked = _asked(spark, folder)
    found = neighbours.search(neighbours.build(vectors), asked, probes=64, where=search.condition({"label": {"$ne": 3}}))
    return found.withColumn("score", F.round("score", 6))


@query()
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vectors of every twentieth vector in the cells that are near it; the tests measure recall."""
    vectors, asked = _asked(spark, folder)
    return neighbours.search(neighbours.build(vectors), asked)


_CHANGED = _BM25.replace("FROM documents)", "FROM (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN text || ' license version 2' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0))")


@query(f"WITH {_CHANGED} SELECT doc_id, round(score, 6) AS score FROM sc")
def bm25_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Scores in an index that was built in three batches: all documents, then changed ones, removals, and versions that come too late."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    at = lambda hour: F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp").alias("ts")
    changed = docs.where("id % 5 = 0").select("id", at(3), F.concat("text", F.lit(" license version 2")).alias("text"))
    removed = docs.where("id % 7 = 0").select("id", at(4), F.lit(None).cast("string").alias("text"))
    late = docs.where("id % 3 = 0").select("id", at(1), F.lit("token token").alias("text"))
    for number, batch in enumerate((docs.select("id", at(2), "text"), changed, removed.unionByName(late))):
        postings.apply(batch, number, root)
    return postings.search(spark, root, QUERY).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))
