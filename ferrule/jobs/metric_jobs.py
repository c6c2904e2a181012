"""Metrics, each with what it is out of; a ratio of nothing is null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.jobs.registry import query
from ferrule.sources.tables import table

_TOKENS = r"list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?'))"


@query(f"""WITH t AS (SELECT conv_id, turn, unnest({_TOKENS}) AS w, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations),
k AS (SELECT conv_id, w, bool_or(turn = first) AS expected, bool_or(turn > first) AS found FROM t WHERE length(w) > 3 GROUP BY 1, 2),
g AS (SELECT conv_id, count(*) FILTER (expected) AS expected, count(*) FILTER (expected AND found) AS found FROM k GROUP BY 1)
SELECT c.conv_id, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found, CASE WHEN expected > 0 THEN round(100.0 * found / expected, 6) END AS percent
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g USING (conv_id)""")
def coverage_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of a conversation's first turn come back in later ones."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", X.claim_tokens(F.col("text")).alias("t"))
    firsts = turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    words = turns.join(firsts, "conv_id").select("conv_id", (F.col("turn") == F.col("first")).alias("opens"), F.explode("t").alias("w")).where(F.length("w") > 3)
    kinds = words.groupBy("conv_id", "w").agg(F.bool_or("opens").alias("expected"), F.bool_or(~F.col("opens")).alias("found"))
    counts = kinds.groupBy("conv_id").agg(F.count_if("expected").alias("expected"), F.count_if(F.col("expected") & F.col("found")).alias("found"))
    whole = firsts.select("conv_id").join(counts, "conv_id", "left").fillna(0, ["expected", "found"])
    return whole.withColumn("percent", F.round(X.ratio(F.col("found"), F.col("expected")), 6))


@query("""WITH p AS (SELECT lang, toxic, CASE WHEN contains(text, '!!') THEN 1 ELSE 0 END AS predicted FROM documents JOIN labels USING (doc_id)),
g AS (SELECT lang, count(*) FILTER (toxic = 1 AND predicted = 1) AS tp, count(*) FILTER (toxic = 0 AND predicted = 1) AS fp, count(*) FILTER (toxic = 1 AND predicted = 0) AS fn, count(*) FILTER (toxic = 0 AND predicted = 0) AS tn FROM p GROUP BY 1)
SELECT *, CASE WHEN tp + fp > 0 THEN round(100.0 * tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(100.0 * tp / (tp + fn), 6) END AS recall FROM g""")
def metric_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How a fixed predictor, shouting means toxic, does in each language."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.col("text").contains("!!").cast("int").alias("p"))
    joined = docs.join(table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id")
    cells = {"tp": (1, 1), "fp": (0, 1), "fn": (1, 0), "tn": (0, 0)}
    counts = joined.groupBy("lang").agg(*[F.count_if((F.col("toxic") == t) & (F.col("p") == p)).alias(n) for n, (t, p) in cells.items()])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": F.round(X.ratio(tp, tp + fp), 6), "recall": F.round(X.ratio(tp, tp + fn), 6)})
