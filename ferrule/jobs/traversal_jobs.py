"""Graphs and trees derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.jobs.registry import query
from ferrule.operators import codemodel, graph
from ferrule.sources.tables import table, written

_TRADE = """v AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM v),
g AS (SELECT src, dst FROM r WHERE r <= 2)"""


def trade(spark: SparkSession, folder: str) -> DataFrame:
    """Each nation's two main suppliers among the nations: src, dst. All lines are counted; what is traversed has two edges a nation."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    supplier = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    counts = joined.groupBy("src", "dst").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return counts.withColumn("r", rank).where("r <= 2").select("src", "dst")


_REACH = """WITH RECURSIVE {trade}, e AS (SELECT DISTINCT {src} AS src, {dst} AS dst FROM g),
b AS (SELECT src AS start, dst AS node, 1 AS depth FROM e UNION SELECT b.start, e.dst, b.depth + 1 FROM b JOIN e ON b.node = e.src WHERE b.depth < 3)
SELECT start, node, min(depth)::INTEGER AS depth FROM b WHERE node <> start GROUP BY 1, 2"""


def _starts(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("start")).distinct()


@query(_REACH.format(trade=_TRADE, src="src", dst="dst"))
def bfs_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Whom a nation reaches in three steps along its main suppliers."""
    edges = trade(spark, folder)
    return graph.reach(edges, _starts(edges), 3)


@query(_REACH.format(trade=_TRADE, src="dst", dst="src"))
def reverse_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Who reaches a nation in three steps."""
    edges = trade(spark, folder).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(edges, _starts(edges), 3)


@query(f"WITH RECURSIVE {_TRADE}, c AS (SELECT src, dst FROM g UNION SELECT c.src, g.dst FROM c JOIN g ON c.dst = g.src) SELECT src AS node FROM c WHERE src = dst")
def self_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Nations on a cycle of main suppliers."""
    return graph.on_cycle(trade(spark, folder))


@query(f"""WITH RECURSIVE {_TRADE}, e AS (SELECT DISTINCT src, dst FROM g WHERE src <> dst),
p AS (SELECT DISTINCT src AS start, src AS node, 0 AS hops, [src] AS path FROM e UNION ALL SELECT p.start, e.dst, p.hops + 1, list_append(p.path, e.dst) FROM p JOIN e ON p.node = e.src WHERE p.hops < 5 AND NOT list_contains(p.path, e.dst)),
m AS (SELECT start, node, hops, path, row_number() OVER (PARTITION BY start, node ORDER BY hops, path) AS r FROM p WHERE hops > 0)
SELECT start, node, hops, array_to_string(path, '>') AS path FROM m WHERE r = 1""")
def shortest_path(spark: SparkSession, folder: str) -> DataFrame:
    """Fewest steps between nations, at most five, with the least of the shortest paths."""
    edges = trade(spark, folder)
    found = graph.shortest_paths(edges, _starts(edges.where("src <> dst")), 5)
    return found.select("start", "node", "hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("""SELECT c_custkey, 'nation' AS kind, n_name AS ancestor, 1 AS distance FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT c_custkey, 'region', r_name, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """The chain above each customer, nearest first."""
    chain = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, folder, "customer").select("c_custkey", "c_nationkey").join(chain, F.col("c_nationkey") == F.col("n_nationkey"))
    above = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("ancestor"), F.lit(d).alias("distance")) for k, c, d in (("nation", "n_name", 1), ("region", "r_name", 2))])
    return joined.select("c_custkey", F.explode(above).alias("x")).select("c_custkey", "x.*")


@query("""WITH t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id FROM lineitem),
d AS (SELECT *, CASE WHEN id < 2 THEN 0 WHEN id < 4 THEN 1 WHEN id < 8 THEN 2 WHEN id < 16 THEN 3 WHEN id < 32 THEN 4 ELSE 5 END AS depth FROM t)
SELECT l_orderkey, id::INTEGER AS id, CASE WHEN id > 1 THEN (id // 2)::INTEGER END AS parent, depth, row_number() OVER (PARTITION BY l_orderkey ORDER BY rpad(bin(id), 12, ' '))::INTEGER AS ord FROM d""")
def tree_preorder(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an order as a heap: parent, depth and place in preorder."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, folder, "lineitem").withColumn("id", F.row_number().over(order)).select("l_orderkey", "id")
    rows = rows.withColumn("parent", F.when(F.col("id") > 1, F.floor(F.col("id") / 2).cast("int")))
    return graph.preorder(rows, "l_orderkey", "id", "parent", "id")


@query("""WITH n AS (SELECT c_nationkey AS owner, c_mktsegment AS member, avg(c_acctbal) AS a FROM customer GROUP BY 1, 2 HAVING avg(c_acctbal) > 4500),
r AS (SELECT n_regionkey AS owner, c_mktsegment AS member FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2 HAVING avg(c_acctbal) > 4500)
SELECT n_name || '#' || n.member AS method_id, r_name || '#' || r.member AS overridden FROM n JOIN nation ON n.owner = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN r ON r.owner = r_regionkey AND r.member = n.member""")
def override_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as classes that extend their region; a segment that is well off on average is a method of both."""
    customer, nation, region = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rich = lambda cls: placed.groupBy(F.col(cls).alias("cls"), F.col("c_mktsegment").alias("name")).agg(F.avg("c_acctbal").alias("a")).where("a > 4500")
    none = F.array().cast("array<string>")
    methods = rich("n_name").unionByName(rich("r_name"))
    methods = methods.select("cls", F.concat_ws("#", "cls", "name").alias("method_id"), "name", none.alias("params"), F.lit(False).alias("is_static"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("cls"), F.col("r_name").alias("superclass"), none.alias("interfaces"))
    regions = region.select(F.col("r_name").alias("cls"), F.lit(None).cast("string").alias("superclass"), none.alias("interfaces"))
    return codemodel.overrides(methods, codemodel.hierarchy(nations.unionByName(regions)))


_SHARED = """l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'),
g AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)"""


@query(f"""WITH RECURSIVE {_SHARED},
b AS (SELECT DISTINCT src AS start, src AS node, 0 AS depth FROM g WHERE src % 20 = 0 UNION SELECT b.start, g.dst, b.depth + 1 FROM b JOIN g ON b.node = g.src WHERE b.depth < 3)
SELECT start, node, min(depth)::INTEGER AS depth FROM b WHERE node <> start GROUP BY 1, 2""")
def supplier_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Whom every twentieth supplier reaches in three steps, where a step is an order from which both had lines returned. No edge is left out."""
    sold = table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    # An order has few suppliers: its pairs come from one small array, not from a join of the lines with themselves.
    sets = sold.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s")).where("size(s) > 1")
    edges = written(sets.select(F.explode("s").alias("src"), "s").select("src", F.explode("s").alias("dst")).where("src <> dst"))
    return graph.reach(edges, edges.where("src % 20 = 0").select(F.col("src").alias("start")).distinct(), 3)
