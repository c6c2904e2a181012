"""Overloads, call walks, mentions and metrics over what the tables hold in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.jobs.registry import query
from ferrule.operators import codemodel, graph, knowledge, metrics, unknowns
from ferrule.sources.tables import table


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS s, o_custkey % 2 = 0 AS own FROM orders)
SELECT o_orderkey, CASE WHEN s = 'P' THEN 'ambiguous' ELSE 'resolved' END AS status,
  CASE s WHEN 'O' THEN 'int' WHEN 'F' THEN CASE WHEN own THEN 'nation' ELSE 'object' END ELSE 'int,long,nation,object,other' END AS targets FROM o""")
def overload_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Calls with an int, the customer's class or a string, or something unknown, and five methods to choose from; a customer's class extends its nation's."""
    customers, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    nation = lambda shift: F.concat(F.lit("n.N"), ((F.col("c_nationkey") + shift) % 25).cast("string"))
    none = F.array().cast("array<string>")
    types = customers.select(F.concat(F.lit("c.C"), "c_custkey").alias("cls"), nation(0).alias("superclass"), none.alias("interfaces"))
    types = types.unionByName(table(spark, folder, "nation").select(F.concat(F.lit("n.N"), "n_nationkey").alias("cls"), F.lit(None).cast("string").alias("superclass"), none.alias("interfaces")))
    status = F.col("o_orderstatus")
    given = F.when(status == "O", "int").when((status == "F") & (F.col("o_custkey") % 2 == 0), F.concat(F.lit("c.C"), "o_custkey")).when(status == "F", "java.lang.String")
    calls = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("call_id"), F.array(given).alias("args"), nation(0).alias("own"), nation(1).alias("next"))
    params = {"int": F.lit("int"), "long": F.lit("long"), "object": F.lit("java.lang.Object"), "nation": F.col("own"), "other": F.col("next")}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("method_id"), F.array(v).alias("params")) for k, v in params.items()])).alias("m")
    candidates = calls.select("call_id", rows).select("call_id", "m.method_id", "m.params", F.lit(False).alias("var_args"))
    # A string fits what is of type Object only; a customer fits that and its nation, of which neither is exact.
    candidates = candidates.join(calls.where("args[0] like 'c.C%'").select("call_id", F.lit("object").alias("method_id")), ["call_id", "method_id"], "left_anti")
    found = codemodel.overloads(calls.select("call_id", "args"), candidates, codemodel.hierarchy(types))
    return found.select(F.col("call_id").alias("o_orderkey"), "status", F.array_join("targets", ",").alias("targets"))


@query("""WITH e AS (SELECT 'e' || l_orderkey || '.' || l_linenumber AS edge, 'S' || l_suppkey AS caller, l_linenumber AS ord, l_returnflag = 'N' AS amb,
  unnest(CASE WHEN l_returnflag = 'N' THEN ['S' || (l_partkey % 50), 'P' || l_partkey] ELSE ['S' || (l_partkey % 50)] END) AS target FROM lineitem),
a AS (SELECT DISTINCT caller AS start FROM e WHERE caller IN ('S1', 'S2', 'S3')),
x1 AS (SELECT start, target AS node, caller AS src, ord, edge, amb FROM a JOIN e ON caller = start WHERE target <> start),
l1 AS (SELECT * FROM x1 QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY src, ord, edge, amb) = 1),
x2 AS (SELECT start, target AS node, caller AS src, e.ord, e.edge, e.amb FROM l1 JOIN e ON caller = node WHERE target <> start AND NOT EXISTS (SELECT 1 FROM l1 k WHERE k.start = l1.start AND k.node = e.target)),
l2 AS (SELECT * FROM x2 QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY src, ord, edge, amb) = 1)
SELECT start, node, 1 AS depth, edge, amb AS ambiguous FROM l1 UNION ALL SELECT start, node, 2, edge, amb FROM l2""")
def call_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as methods, lines as calls, those not returned ambiguous ones: what three of them reach within two calls."""
    part = F.concat(F.lit("S"), (F.col("l_partkey") % 50).cast("string"))
    ambiguous = F.col("l_returnflag") == "N"
    targets = F.when(ambiguous, F.array(part, F.concat(F.lit("P"), "l_partkey"))).otherwise(F.array(part))
    edge = F.concat(F.lit("e"), "l_orderkey", F.lit("."), "l_linenumber")
    edges = table(spark, folder, "lineitem").select(edge.alias("edge"), F.concat(F.lit("S"), "l_suppkey").alias("caller"), F.col("l_linenumber").alias("ord"), F.when(ambiguous, "ambiguous").otherwise("resolved").alias("status"), targets.alias("targets"))
    starts = edges.where("caller in ('S1', 'S2', 'S3')").select(F.col("caller").alias("start")).distinct()
    return graph.reach_calls(edges, starts, 2).select("start", "node", "depth", "edge", "ambiguous")


_WORDS = "list_distinct(regexp_extract_all(text || ' ' || coalesce(source, ''), '[A-Za-z_][A-Za-z0-9_]*'))"


@query(f"""WITH s AS (SELECT DISTINCT regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*') AS name FROM benchmark),
w AS (SELECT doc_id, unnest({_WORDS}) AS name FROM documents)
SELECT name AS symbol_id, doc_id AS section_id FROM w JOIN s USING (name) WHERE length(name) >= 4""")
def section_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sections, headed by their source, and the classes named like the first words of the benchmark that they mention."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("section_id"), F.coalesce("source", F.lit("")).alias("heading"), "text")
    name = F.regexp_extract("text", "[A-Za-z_][A-Za-z0-9_]*", 0)
    symbols = table(spark, folder, "benchmark").select(name.alias("symbol_id"), F.lit("class").alias("kind"), F.lit("").alias("class_name"), name.alias("name"), F.lit(False).alias("qualified_only")).distinct()
    return knowledge.mentioned(docs, symbols)


@query("""WITH w AS (SELECT doc_id, text, unnest([coalesce(source, '?'), coalesce(lang, '?'), 'token', 'VERSION']) AS word FROM documents),
h AS (SELECT doc_id, word, contains(lower(text), lower(word)) AS hit FROM w)
SELECT doc_id, count(*) FILTER (hit) AS found, count(*) AS expected, round(100.0 * count(*) FILTER (hit) / count(*), 4) AS percent,
  coalesce(string_agg(word, ',' ORDER BY word) FILTER (NOT hit), '') AS missing FROM h GROUP BY doc_id""")
def expected_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """How many of four expected words each document has, in any case."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("method_id"), "text", F.array(F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?")), F.lit("token"), F.lit("VERSION")).alias("words"))
    found = metrics.mentions(docs.select("method_id", "text"), docs.select("method_id", F.explode("words").alias("word")))
    return found.select(F.col("method_id").alias("doc_id"), "found", "expected", F.round("percent", 4).alias("percent"), F.array_join("missing", ",").alias("missing"))


@query("""WITH e AS (SELECT l_orderkey AS k, lower(l_returnflag) AS part, count(*) AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT l_orderkey AS k, CASE l_linestatus WHEN 'O' THEN 'n' ELSE 'r' END AS part, count(*) AS n FROM lineitem GROUP BY 1, 2),
b AS (SELECT coalesce(e.k, a.k) AS k, coalesce(e.n, 0) AS e, coalesce(a.n, 0) AS a FROM e FULL JOIN a ON e.k = a.k AND e.part = a.part)
SELECT k AS l_orderkey, sum(least(e, a))::BIGINT AS found, sum(e)::BIGINT AS expected, sum(greatest(a - e, 0))::BIGINT AS extra, round(100.0 * sum(least(e, a)) / sum(e), 4) AS percent FROM b GROUP BY 1""")
def structure_match(spark: SparkSession, folder: str) -> DataFrame:
    """The flags of an order's lines against those that their status suggests, as multisets; white space and case do not count."""
    lines = table(spark, folder, "lineitem")
    expected = lines.select(F.col("l_orderkey").alias("method_id"), F.concat(F.lit(" "), "l_returnflag", F.lit("\t")).alias("part"))
    actual = lines.select(F.col("l_orderkey").alias("method_id"), F.when(F.col("l_linestatus") == "O", "n").otherwise("R").alias("part"))
    return metrics.structure(expected, actual).select(F.col("method_id").alias("l_orderkey"), "found", "expected", "extra", F.round("percent", 4).alias("percent"))


@query("""WITH w AS (SELECT lang, doc_id, text, unnest([coalesce(source, '?'), 'token', 'version']) AS word FROM documents),
m AS (SELECT 'mentions' AS metric, count(*) FILTER (contains(lower(text), lower(word))) AS found, count(*) AS expected FROM w),
e AS (SELECT l_orderkey AS k, lower(l_returnflag) AS part, count(*) AS n FROM lineitem GROUP BY 1, 2), a AS (SELECT l_orderkey AS k, CASE l_linestatus WHEN 'O' THEN 'n' ELSE 'r' END AS part, count(*) AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT 'structure' AS metric, coalesce(sum(least(e.n, coalesce(a.n, 0))), 0)::BIGINT AS found, sum(e.n)::BIGINT AS expected FROM e LEFT JOIN a ON a.k = e.k AND a.part = e.part)
SELECT metric, found, expected, round(100.0 * found / expected, 6) AS percent FROM (SELECT * FROM m UNION ALL SELECT * FROM s)""")
def evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    """What was found of what was expected over all documents and orders, by metric."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("method_id"), "text", F.array(F.coalesce("source", F.lit("?")), F.lit("token"), F.lit("version")).alias("words"))
    told = metrics.mentions(docs.select("method_id", "text"), docs.select("method_id", F.explode("words").alias("word")))
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "method_id")
    shape = metrics.structure(lines.select("method_id", F.col("l_returnflag").alias("part")), lines.select("method_id", F.when(F.col("l_linestatus") == "O", "n").otherwise("r").alias("part")))
    ratios = [df.select(F.lit(name).alias("metric"), "found", "expected") for name, df in (("mentions", told), ("structure", shape))]
    return metrics.summary(ratios[0].unionByName(ratios[1])).withColumn("percent", F.round("percent", 6))


@query("""WITH f AS (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY 1),
l AS (SELECT DISTINCT c.conv_id, unnest([substr(text, 5, 6), substr(text, 1, 2), 'zz', 'e', 'the ']) AS literal FROM conversations c JOIN f ON f.conv_id = c.conv_id AND turn = first)
SELECT conv_id, literal FROM l WHERE NOT EXISTS (SELECT 1 FROM conversations c JOIN f ON f.conv_id = c.conv_id AND turn > first WHERE c.conv_id = l.conv_id AND contains(c.text, l.literal))""")
def unexplained_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of a conversation's first turn, and some fixed ones, that no later turn of it holds."""
    turns = table(spark, folder, "conversations")
    firsts = turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    joined = turns.join(firsts, "conv_id")
    pieces = F.array(F.substring("text", 5, 6), F.substring("text", 1, 2), F.lit("zz"), F.lit("e"), F.lit("the "))
    literals = joined.where("turn = first").select("conv_id", F.explode(pieces).alias("literal")).distinct()
    return unknowns.unexplained(literals, joined.where("turn > first").select("conv_id", "text"), "conv_id")
