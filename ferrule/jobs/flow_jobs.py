"""Flow within and between methods, conditions, and published models, over what the tables hold in their place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import conditions
from ferrule.jobs.registry import query
from ferrule.operators import flow, pipelines, trace
from ferrule.sources import versions
from ferrule.sources.tables import shared_folder, table

_HEAP = """h AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INTEGER AS id, l_returnflag AS flag FROM lineitem)"""


def _heap(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an order as a heap of spans: line k holds lines 2k and 2k + 1, each in a half of it."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, folder, "lineitem").withColumn("n", F.row_number().over(order))
    level = F.floor(F.log2("n")).cast("int")
    width = F.pow(F.lit(2), 6 - level).cast("int")
    start = (F.col("n") - F.pow(F.lit(2), level).cast("int")) * width
    kind = F.when(F.col("l_returnflag") == "R", "if").when(F.col("l_returnflag") == "A", "else").otherwise("for")
    return rows.select(F.col("l_orderkey").alias("method"), F.col("n").alias("id"), kind.alias("kind"), start.alias("start"), (start + width - 1).alias("end"))


@query(f"""WITH {_HEAP}, t AS (SELECT c.*, p.flag AS above, CASE WHEN c.id < 2 THEN 0 WHEN c.id < 4 THEN 1 WHEN c.id < 8 THEN 2 WHEN c.id < 16 THEN 3 ELSE 4 END AS depth FROM h c LEFT JOIN h p ON p.l_orderkey = c.l_orderkey AND p.id = c.id // 2)
SELECT l_orderkey AS method, id, CASE flag WHEN 'R' THEN 'if' WHEN 'A' THEN 'else' ELSE 'loop' END AS kind, CASE WHEN flag = 'N' THEN 'for' END AS loop_kind, CASE WHEN id > 1 THEN (id // 2)::INTEGER END AS parent,
  coalesce(flag = 'A' AND above = 'R', false) AS branch, depth, row_number() OVER (PARTITION BY l_orderkey ORDER BY rpad(bin(id), 12, ' '))::INTEGER AS ord FROM t""")
def control_flow(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an order as statements by their spans: what each is within, and which are other arms."""
    return flow.control_flow(_heap(spark, folder))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_orderstatus = 'O' AS reads, o_orderpriority IN ('1-URGENT', '2-HIGH') AS sure FROM orders),
l AS (SELECT *, max(CASE WHEN NOT reads AND sure THEN pos END) OVER (PARTITION BY o_custkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a)
SELECT r.o_custkey AS method, r.o_orderkey::VARCHAR AS read, w.o_orderkey::VARCHAR AS write FROM l r JOIN a w ON w.o_custkey = r.o_custkey AND NOT w.reads AND w.pos < r.pos AND w.pos >= coalesce(r.last, 0) WHERE r.reads""")
def reaching_writes(spark: SparkSession, folder: str) -> DataFrame:
    """Open orders read what closed orders of the customer wrote; a write of low priority stands in an if of its own, so earlier ones may be seen, too."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) * 10
    rows = table(spark, folder, "orders").withColumn("at", place)
    kind = F.when(F.col("o_orderstatus") == "O", "read").otherwise("write")
    accesses = rows.select(F.col("o_custkey").alias("method"), F.col("o_orderkey").alias("id"), F.lit("v").alias("symbol"), kind.alias("kind"), "at")
    maybe = rows.where("o_orderstatus <> 'O' and o_orderpriority not in ('1-URGENT', '2-HIGH')")
    ifs = maybe.select(F.col("o_custkey").alias("method"), F.col("o_orderkey").alias("id"), F.lit("if").alias("kind"), (F.col("at") - 1).alias("start"), (F.col("at") + 1).alias("end"))
    return flow.reaching_writes(ifs, accesses)


@query(f"""WITH {_HEAP}, s(slot, node) AS (VALUES ('whole', 1), ('left', 2), ('right', 3))
SELECT l_orderkey AS method, slot AS target, 'v' || id AS source, CASE WHEN slot = 'whole' THEN 'return' ELSE 'argument' END AS via FROM h JOIN s ON id = node WHERE NOT (slot = 'left' AND l_orderkey % 2 = 0)""")
def value_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as names by their spans: the outermost in the whole of an order and in each half, of which a lambda hides the left one in even orders."""
    heap = _heap(spark, folder)
    text = F.lit(None).cast("string")
    name = F.concat(F.lit("v"), F.col("id").cast("string"))
    exprs = heap.select("method", F.concat_ws(".", "method", "id").alias("expr"), F.lit("name_ref").alias("kind"), name.alias("name"), name.alias("text"), F.col("id").alias("line"), "start", "end", F.lit("local_variable").alias("ref_kind"), name.alias("symbol"), F.lit("resolved").alias("status"), text.alias("origin"), text.alias("type"), F.lit(1).alias("declared"))
    spans = [("whole", "return", 0, 63), ("left", "argument", 0, 31), ("right", "argument", 32, 63)]
    spans = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(v).alias("via"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, v, a, b in spans])).alias("s")
    orders = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("method")).distinct()
    target = F.struct(F.lit("slot").alias("kind"), F.col("s.n").alias("name"), text.alias("symbol"))
    slots = orders.select("method", spans).select(F.concat_ws(".", "method", "s.n").alias("slot"), "method", "s.via", F.col("s.a").alias("start"), F.col("s.b").alias("end"), target.alias("target"), text.alias("expr"), F.lit(1).alias("line"), text.alias("callee"), text.alias("param"), text.alias("detail"), text.alias("literal"))
    lambdas = orders.where("method % 2 = 0").select("method", F.lit(0).alias("start"), F.lit(31).alias("end"))
    # The lambda of an even order is its left half: what lies in it is hidden from that half, and from the whole but for line 1 around it.
    found = flow.value_edges(exprs, slots, lambdas)
    return found.select("method", F.col("target.name").alias("target"), F.col("source.name").alias("source"), "via")


@query("""WITH l AS (SELECT l_partkey, 'O' || l_orderkey AS caller, l_linenumber AS line FROM lineitem), p AS (SELECT 'P' || p_partkey AS method, p_partkey FROM part WHERE p_size = 1),
r AS (SELECT method, caller, line, row_number() OVER (PARTITION BY method ORDER BY caller, line) AS rank, count(*) OVER (PARTITION BY method) AS n FROM p JOIN l ON l_partkey = p_partkey)
SELECT method AS start, 'passed_in' AS what, 0 AS depth, caller AS at, line::VARCHAR AS other FROM r WHERE rank <= 5
UNION ALL SELECT DISTINCT method, 'created', 1, caller, 'declared' FROM r WHERE rank <= 5
UNION ALL SELECT DISTINCT method, 'stop more_sites', 0, method, (n - 5)::VARCHAR FROM r WHERE n > 5
UNION ALL SELECT method, 'stop entry_point', 0, method, NULL FROM p WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""")
def value_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as methods that orders pass a value to: where the value of each small part comes from, two levels up."""
    lines, text = table(spark, folder, "lineitem"), F.lit(None).cast("string")
    caller, callee = F.concat(F.lit("O"), "l_orderkey"), F.concat(F.lit("P"), "l_partkey")
    ref = lambda kind, name, symbol: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), symbol.alias("symbol"))
    source = ref("local", "v", F.concat(caller, F.lit("$v")))
    edges = lines.select(caller.alias("method"), F.lit("argument").alias("via"), source.alias("source"), ref("callee_parameter", "p", F.concat(callee, F.lit("$p"))).alias("target"), F.col("l_linenumber").alias("line"), callee.alias("callee"), F.lit("p").alias("param"))
    parts = table(spark, folder, "part").select(F.concat(F.lit("P"), "p_partkey").alias("method"), "p_size")
    orders = table(spark, folder, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("method"))
    variables = parts.select("method", F.concat("method", F.lit("$p")).alias("symbol"), F.lit("p").alias("name"), F.lit("parameter").alias("kind"), text.alias("created"), F.lit(0).alias("declared"))
    variables = variables.unionByName(orders.select("method", F.concat("method", F.lit("$v")).alias("symbol"), F.lit("v").alias("name"), F.lit("local").alias("kind"), F.lit("declared").alias("created"), F.lit(1).alias("declared")))
    events = spark.createDataFrame([], "method string, symbol string, kind string, detail string, line int, callee string, param string")
    starts = parts.where("p_size = 1").select(F.col("method").alias("start"), "method", F.concat("method", F.lit("$p")).alias("symbol"))
    steps, stops = trace.trace(starts, variables, edges, events)
    said = F.when(F.col("kind") == "passed_in", F.col("line").cast("string")).otherwise(F.col("other"))
    steps = steps.select("start", F.col("kind").alias("what"), "depth", "at", said.alias("other"))
    return steps.unionByName(stops.select("start", F.concat(F.lit("stop "), "reason").alias("what"), "depth", F.col("method").alias("at"), "other"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 90 AS n, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT o_orderkey, 0 AS k, '' AS op, 'threshold' AS kind, 'price(a, b) is greater than ' || n AS meaning FROM o
UNION ALL SELECT o_orderkey, 1, '&&', 'literal_match', 'not (status equals "' || s || ' || x")' FROM o
UNION ALL SELECT o_orderkey, 2, '||', CASE WHEN s = 'O' THEN 'null' ELSE 'test' END, CASE WHEN s = 'O' THEN 'note is missing' ELSE 'f(note == null && ok)' END FROM o
UNION ALL SELECT o_orderkey, 3, '&&', 'literal_match', 'rank equals "' || p || '"' FROM o""")
def condition_parts(spark: SparkSession, folder: str) -> DataFrame:
    """A condition for each order, with operators in brackets and quotes, and what its parts say."""
    status = F.col("o_orderstatus")
    third = F.when(status == "O", "(note == null)").otherwise("f(note == null && ok)")
    text = F.concat(F.lit("((price(a, b)  >  "), (F.col("o_orderkey") % 90).cast("string"), F.lit(')) && !status.equals("'), status, F.lit(' || x")||'), third, F.lit(' && "'), "o_orderpriority", F.lit('" == rank'))
    # Reading conditions is most of the work: it is dealt over all cores, however few files hold the orders.
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")
    parts = orders.select("o_orderkey", F.posexplode(conditions.split_condition(text)).alias("k", "p")).select("o_orderkey", "k", "p.op", conditions.atom(F.col("p.atom")).alias("a"))
    turned = F.regexp_replace("a.meaning", '^("[^"]*") equals rank$', "rank equals $1")
    return parts.select("o_orderkey", "k", "op", "a.kind", turned.alias("meaning"))


@query("""SELECT c_mktsegment AS segment, count(*) AS customers, round(sum(CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1000 ELSE c_acctbal END), 2) AS balance, (SELECT count(*) FROM orders WHERE o_custkey % 7 <> 0) AS orders
FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1""")
def published_model(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and orders published as a model, then some customers changed and others removed with their orders."""
    root = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    customers = table(spark, folder, "customer").withColumnRenamed("c_custkey", "owner")
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "owner")
    base = versions.replace_model(spark, root, {"customers": customers, "orders": orders, "nations": table(spark, folder, "nation")})
    gone = customers.where("owner % 7 = 0").select("owner")
    changed = base.read("customers").where("owner % 4 = 0 and owner % 7 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + 1000)
    versions.replace_parts(base, {"customers": changed}, "owner", gone)
    now = versions.current(spark, root)
    total = now.read("orders").agg(F.count("*").alias("orders"))
    sums = now.read("customers").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return sums.join(F.broadcast(total))  # one row


@query("""WITH l AS (SELECT l_orderkey, row_number() OVER w AS i, CASE l_returnflag WHEN 'R' THEN 'filter' WHEN 'A' THEN 'map' ELSE 'sorted' END AS name FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
SELECT l_orderkey AS method, count(*) + 2 AS n, 'stream > ' || string_agg(name, ' > ' ORDER BY i) || ' > collect' || CASE WHEN l_orderkey % 3 = 0 THEN ' > groupingBy' WHEN l_orderkey % 3 = 1 THEN ' > counting' ELSE '' END AS detail,
  'source,' || string_agg(CASE name WHEN 'sorted' THEN 'sort' ELSE name END, ',' ORDER BY i) || CASE WHEN l_orderkey % 3 = 0 THEN ',group' WHEN l_orderkey % 3 = 1 THEN ',aggregate' ELSE ',collect' END AS categories FROM l GROUP BY l_orderkey""")
def stream_pipelines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as streams of their lines, each an operation on the one before, that end in a collector or none."""
    whole = Window.partitionBy("l_orderkey")
    order = whole.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, folder, "lineitem").select("*", F.row_number().over(order).alias("i"), F.count("*").over(whole).cast("int").alias("n"))
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    flag, third, i, n = F.col("l_returnflag"), F.col("l_orderkey") % 3, F.col("i"), F.col("n")
    at = lambda k: F.concat_ws(".", "l_orderkey", k)

    def call(expr, name, receiver, start: int, end, kind: str):
        return F.struct(expr.alias("expr"), name.alias("name"), receiver.alias("receiver"), F.lit(start).alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))

    # A line is a call on the one before; the first one brings the source along, the last one what ends the stream.
    line = call(at(i), F.when(flag == "R", "filter").when(flag == "A", "map").otherwise("sorted"), at(i - 1), 0, i + 200, "stream")
    first = F.when(i == 1, call(at(F.lit(0)), F.lit("stream"), text, 0, F.lit(200), "stream"))
    last = F.when(i == n, call(at(n + 1), F.lit("collect"), at(n), 0, n + 201, "stream"))
    collector = F.when((i == n) & (third < 2), call(F.concat(at(n), F.lit("c")), F.when(third == 0, "groupingBy").otherwise("counting"), text, 180, F.lit(190), "collector"))
    rows = lines.select(F.col("l_orderkey").alias("method"), F.explode(F.array(line, first, last, collector)).alias("c")).where("c is not null")
    rows = rows.select("method", "c.*", none.alias("args"), F.lit(1).alias("line"), text.alias("scope"), F.col("c.name").alias("text"), text.alias("target"))
    found = pipelines.pipelines(rows)
    return found.select("method", F.size("ops").cast("long").alias("n"), "detail", F.array_join(F.transform("ops", lambda o: o["category"]), ",").alias("categories"))
