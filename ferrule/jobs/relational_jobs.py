"""Relational operators over the star schema and the labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.jobs.registry import query
from ferrule.operators import codemodel, relational
from ferrule.sources.tables import table

#: Snapshots are taken before and from this day on.
CUT = "1998-04-01"


def _customers(orders: DataFrame) -> DataFrame:
    """A snapshot: customers that ordered, with a digest of how often and of what priorities."""
    summary = F.concat_ws("|", F.count("*").cast("string"), F.min("o_orderpriority"), F.max("o_orderpriority"))
    return orders.groupBy("o_custkey").agg(F.md5(summary).alias("digest"))


def _periods(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders")
    before = F.col("o_orderdate") < F.lit(CUT).cast("timestamp")
    return _customers(orders.where(before)), _customers(orders.where(~before))


_SNAPSHOTS = f"""o AS (SELECT o_custkey, md5(count(*)::VARCHAR || '|' || min(o_orderpriority) || '|' || max(o_orderpriority)) AS digest FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1),
n AS (SELECT o_custkey, md5(count(*)::VARCHAR || '|' || min(o_orderpriority) || '|' || max(o_orderpriority)) AS digest FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}' GROUP BY 1),
d AS (SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN o.o_custkey IS NULL THEN 'added' WHEN n.o_custkey IS NULL THEN 'removed' WHEN o.digest = n.digest THEN 'unchanged' ELSE 'changed' END AS status
  FROM o FULL JOIN n ON o.o_custkey = n.o_custkey)"""


@query(f"WITH {_SNAPSHOTS} SELECT * FROM d")
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of two periods: added, removed, changed or unchanged."""
    old, new = _periods(spark, folder)
    return relational.snapshot_diff(old, new, "o_custkey", "digest")


@query(f"WITH {_SNAPSHOTS} SELECT o_custkey, coalesce(n.digest, o.digest) AS digest FROM o FULL JOIN n USING (o_custkey) WHERE n.o_custkey IS NOT NULL")
def snapshot_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The older snapshot brought up to date: removed keys dropped, changed ones replaced, added ones appended."""
    old, new = _periods(spark, folder)
    diff = relational.snapshot_diff(old, new, "o_custkey", "digest")
    touched = new.join(diff.where("status in ('added', 'changed')"), "o_custkey", "left_semi")
    return relational.upsert(old, touched, diff.where("status = 'removed'"), "o_custkey")


_STATE = """s AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.quality = l.toxic THEN 'changed' ELSE 'unchanged' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT l.doc_id, 'removed' FROM labels l ANTI JOIN documents d ON d.doc_id = l.doc_id)"""


def _state(spark: SparkSession, folder: str) -> DataFrame:
    """Documents against what is stored of them, their labels."""
    docs, labels = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("quality").isNull(), "new").when(F.col("quality") == F.col("toxic"), "changed").otherwise("unchanged")
    gone = labels.join(docs, "doc_id", "left_anti").select("doc_id", F.lit("removed").alias("status"))
    return docs.join(labels, "doc_id", "left").select("doc_id", status.alias("status")).unionByName(gone)


@query(f"WITH {_STATE} SELECT status, count(*) AS n FROM s GROUP BY status")
def index_report(spark: SparkSession, folder: str) -> DataFrame:
    return _state(spark, folder).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 0 THEN 'failed' ELSE 'stale' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.quality = 0 OR l.toxic = 1")
def pending_work(spark: SparkSession, folder: str) -> DataFrame:
    """What has to be done again: nothing stored, a failure, or another content."""
    docs, labels = table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels")
    todo = docs.join(labels, "doc_id", "left").where(F.col("quality").isNull() | (F.col("quality") == 0) | (F.col("toxic") == 1))
    return todo.select("doc_id", F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 0, "failed").otherwise("stale").alias("reason"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS keeper, count(*) AS n, max(doc_id) AS last FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    groups = table(spark, folder, "documents").groupBy(F.sha2("text", 256).alias("content_hash"))
    return groups.agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n"), F.max("doc_id").alias("last")).where("n > 1")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user, as a partial aggregate."""
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return table(spark, folder, "events").groupBy("user_id").agg(last.alias("e")).select("user_id", "e.*")


@query("SELECT n_name, count(s_suppkey) AS n_suppliers FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name")
def parent_child_count(spark: SparkSession, folder: str) -> DataFrame:
    nation, supplier = table(spark, folder, "nation"), table(spark, folder, "supplier")
    counts = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("s_suppkey").alias("n_suppliers"))
    return nation.join(counts, "n_nationkey", "left").select("n_name", F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


@query("SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def orphan_anti(spark: SparkSession, folder: str) -> DataFrame:
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    return customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45) ON o_orderkey = l_orderkey")
def child_semi(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45")
    return table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%bolt%' OR p_brand ILIKE '%bolt%'
ORDER BY (lower(p_name) = 'bolt') DESC, length(p_name), p_name, p_partkey LIMIT 20""")
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """Exact names first, then shorter ones."""
    found = table(spark, folder, "part").where(F.ilike("p_name", F.lit("%bolt%")) | F.ilike("p_brand", F.lit("%bolt%")))
    order = [(F.lower("p_name") == "bolt").desc(), F.length("p_name"), "p_name", "p_partkey"]
    return found.orderBy(*order).limit(20).select("p_partkey", "p_name", "p_brand")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 10 OFFSET 20")
def paged_list(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").offset(20).limit(10)


@query("SELECT o_custkey, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def latest_run(spark: SparkSession, folder: str) -> DataFrame:
    """The last finished order of each customer."""
    done = table(spark, folder, "orders").where("o_orderstatus = 'F'")
    return done.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"))


@query("""SELECT l_orderkey, l_suppkey % 5 AS shelf, min_by(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS first_part, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines
FROM lineitem GROUP BY 1, 2""")
def grouped_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one place together: what the first of them says, and where they are."""
    lines = F.array_join(F.array_sort(F.collect_set("l_linenumber")).cast("array<string>"), ",")
    groups = table(spark, folder, "lineitem").groupBy("l_orderkey", (F.col("l_suppkey") % 5).alias("shelf"))
    return groups.agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part"), lines.alias("lines"))


@query("SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS kept, bool_or(l_discount > 0.08) AS cheap, count(*) FILTER (l_quantity > 40) AS large FROM lineitem GROUP BY 1")
def all_flag(spark: SparkSession, folder: str) -> DataFrame:
    groups = table(spark, folder, "lineitem").groupBy("l_orderkey")
    return groups.agg(F.bool_and(F.col("l_returnflag") != "R").alias("kept"), F.bool_or(F.col("l_discount") > 0.08).alias("cheap"), F.count_if(F.col("l_quantity") > 40).alias("large"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def first_n_per_group(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return relational.pick(lines, ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o, count(*) AS total FROM lineitem GROUP BY 1")
def crosstab(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("l_linestatus")
    groups = table(spark, folder, "lineitem").groupBy("l_returnflag")
    return groups.agg(F.count_if(status == "F").alias("f"), F.count_if(status == "O").alias("o"), F.count("*").alias("total"))


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM d)
SELECT l_suppkey, array_to_string(list(l_partkey ORDER BY l_partkey), ', ') || CASE WHEN any_value(n) > 6 THEN ' (+' || (any_value(n) - 6) || ' more)' ELSE '' END AS parts FROM r WHERE r <= 6 GROUP BY 1""")
def capped_list_more(spark: SparkSession, folder: str) -> DataFrame:
    """The first six parts of each supplier and how many there are more; no group is gathered beyond six rows."""
    pairs = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    counts = pairs.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    first = relational.pick(pairs, ["l_suppkey"], [F.col("l_partkey")], 6).groupBy("l_suppkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("p"))
    more = F.when(F.col("n") > 6, F.concat(F.lit(" (+"), (F.col("n") - 6).cast("string"), F.lit(" more)"))).otherwise("")
    return first.join(counts, "l_suppkey").select("l_suppkey", F.concat(F.array_join(F.col("p").cast("array<string>"), ", "), more).alias("parts"))


@query("""WITH e AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 25 GROUP BY 1, 2), a AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1, 2)
SELECT coalesce(e.l_suppkey, a.l_suppkey) AS l_suppkey, coalesce(e.l_returnflag, a.l_returnflag) AS l_returnflag, coalesce(e.n, 0) AS expected, least(coalesce(e.n, 0), coalesce(a.n, 0)) AS found,
  greatest(coalesce(a.n, 0) - coalesce(e.n, 0), 0) AS extra FROM e FULL JOIN a ON e.l_suppkey = a.l_suppkey AND e.l_returnflag = a.l_returnflag""")
def multiset_match(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return relational.multiset_match(lines.where("l_quantity >= 25"), lines.where("l_discount >= 0.05"), ["l_suppkey", "l_returnflag"])


@query("""WITH m AS (SELECT l_orderkey AS id, 3 * count(*) AS c, count(*) FILTER (l_returnflag = 'R') AS n, sum(l_quantity)::BIGINT AS len FROM lineitem GROUP BY 1),
e AS (SELECT DISTINCT o_orderkey AS caller, min(o_orderkey) OVER (PARTITION BY o_custkey) AS callee, o_orderpriority FROM orders),
u AS (SELECT callee, count(*) AS callers FROM e WHERE NOT (o_orderpriority = '1-URGENT' AND caller IN (SELECT id FROM m)) GROUP BY 1),
g AS (SELECT m.*, coalesce(callers, 0) AS callers FROM m LEFT JOIN u ON id = callee)
SELECT id AS method_id, 'complexity' AS kind, CASE WHEN c >= 15 THEN 'high' ELSE 'medium' END AS level FROM g WHERE c >= 10
UNION ALL SELECT id, 'nesting', 'medium' FROM g WHERE n >= 4
UNION ALL SELECT id, 'length', 'medium' FROM g WHERE len > 80
UNION ALL SELECT id, 'wide_impact', CASE WHEN callers >= 15 THEN 'high' ELSE 'medium' END FROM g WHERE callers >= 5""")
def risk_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as methods: lines for complexity, returned ones for nesting, quantity for length, and a customer's orders as callers of the first."""
    orders = table(spark, folder, "orders")
    measures = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("method_id")).agg(
        (3 * F.count("*")).alias("complexity"), F.count_if(F.col("l_returnflag") == "R").alias("nesting"), F.lit(1).alias("start_line"), F.sum("l_quantity").cast("long").alias("end_line")
    )
    tests = orders.select(F.col("o_orderkey").alias("method_id"), (F.col("o_orderpriority") == "1-URGENT").alias("is_test"))
    firsts = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("callee"))
    edges = orders.join(firsts, "o_custkey").select(F.col("o_orderkey").alias("caller"), "callee")
    return codemodel.risks(measures.join(tests, "method_id", "left"), edges)


@query("""WITH c AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS t FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey, CASE WHEN t IS NULL THEN 'unresolved' WHEN len(t) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(len(t), 0)::INTEGER AS n_targets, coalesce(array_to_string(t, ','), '') AS targets
FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""")
def three_state_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Which supplier an order was returned to: one, several, or none; every order is kept."""
    returned = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("supplier"))
    known = returned.groupBy("key").agg(F.array_sort(F.collect_set("supplier")).alias("found"))
    found = relational.resolve(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", known.select("key", F.explode("found").alias("supplier")), "key", "supplier")
    return found.select("o_orderkey", "status", "n_targets", F.array_join(F.col("targets").cast("array<string>"), ",").alias("targets"))


@query("""WITH c AS (SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.09 THEN 0 WHEN l_quantity >= 49 THEN 1 ELSE 2 END AS priority FROM lineitem)
SELECT * FROM c QUALIFY priority = min(priority) OVER (PARTITION BY l_partkey)""")
def priority_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a part from the first branch that has any: cheap ones, large ones, the rest."""
    lines = table(spark, folder, "lineitem")
    cheap, large = F.col("l_discount") >= 0.09, F.col("l_quantity") >= 49
    columns = ["l_partkey", "l_orderkey", "l_linenumber"]
    branches = [lines.where(cheap), lines.where(~cheap & large), lines.where(~cheap & ~large)]
    return relational.ladder([b.select(*columns) for b in branches], "l_partkey").select(*columns, "priority")


@query("""WITH u AS (SELECT DISTINCT s_nationkey, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity >= 48)
SELECT p_brand, array_to_string(list(n_name ORDER BY n_name), ',') AS dependents FROM u JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def dependents(spark: SparkSession, folder: str) -> DataFrame:
    """The inverse of which brands a nation's suppliers had returned: the nations of each brand."""
    lines = table(spark, folder, "lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select("l_suppkey", "l_partkey")
    uses = lines.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = uses.select("s_nationkey", "p_brand").distinct().join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return pairs.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("dependents"))
