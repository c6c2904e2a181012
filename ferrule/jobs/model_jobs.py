"""Operators of the code model and of streams, over what the tables hold in their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.text import LITERALS, literal_type
from ferrule.jobs.registry import query
from ferrule.operators import codemodel, expressions
from ferrule.sources.tables import table
from ferrule.streaming import incremental

_VERBS = ", ".join(f"('{a}', '{b}')" for a, b in codemodel.VERBS.items())


@query(f"""WITH verbs(word, says) AS (VALUES {_VERBS}),
n AS (SELECT p_partkey, ['get', 'is', 'has', 'frob', 'find'][p_size % 5 + 1] || upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', '_') AS name FROM part),
w AS (SELECT p_partkey, name, list_transform(regexp_extract_all(regexp_replace(name, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) AS ws FROM n),
r AS (SELECT *, ws[1] AS first, array_to_string(ws[2:], ' ') AS rest FROM w)
SELECT p_partkey, name, CASE WHEN says IS NULL THEN 'performs ' || array_to_string(ws, ' ') WHEN rest = '' THEN says WHEN first = 'get' THEN 'returns the ' || rest
  WHEN first IN ('has', 'can', 'should') THEN 'checks whether it ' || first || ' ' || rest WHEN first = 'is' THEN 'checks whether ' || rest ELSE says || ' ' || rest END AS purpose
FROM r LEFT JOIN verbs ON first = word""")
def name_purpose(spark: SparkSession, folder: str) -> DataFrame:
    """What methods named after the parts would do, from their names."""
    verb = F.element_at(F.array(*map(F.lit, ["get", "is", "has", "frob", "find"])), F.col("p_size") % 5 + 1)
    name = F.concat(verb, F.upper(F.substring("p_name", 1, 1)), F.regexp_replace(F.expr("substring(p_name, 2)"), " ", "_"))
    parts = table(spark, folder, "part").select("p_partkey", name.alias("name"))
    return parts.withColumn("purpose", codemodel.purpose(F.col("name"), F.lit("method"), F.lit("Part")))


_LITERAL = " ".join(f"WHEN regexp_matches(t, '{form.replace(chr(39), chr(39) * 2)}') THEN '{kind}'" for kind, form in LITERALS.items())


@query(f"""WITH e AS (SELECT event_id, user_id, event_type AS y, props->>'$.k' AS k, value::VARCHAR AS v FROM events),
t AS (SELECT y, trim(unnest([k, y, '"' || y || '"', '"a' || chr(92) || '"' || y || '"', '"' || y || '" + "b"', chr(39) || 'c' || chr(39), chr(39) || chr(92) || 'n' || chr(39), chr(39) || chr(39),
  (event_id % 2 = 0)::VARCHAR, user_id::VARCHAR || 'L', '+' || k, '-' || k || '_0', v, v || 'f', v || 'D', k || '.', k || 'f', '.' || k, '  ' || k || ' '])) AS t FROM e)
SELECT CASE {_LITERAL} END AS type, y AS event_type, count(*) AS n FROM t GROUP BY 1, 2""")
def literal_types(spark: SparkSession, folder: str) -> DataFrame:
    """Types of the literals that events would be written with, and of what is none."""
    k, y, v = F.get_json_object("props", "$.k"), F.col("event_type"), F.col("value").cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    texts = F.array(
        k, y, c('"', y, '"'), c('"a\\"', y, '"'), c('"', y, '" + "b"'), F.lit("'c'"), F.lit("'\\n'"), F.lit("''"),
        (F.col("event_id") % 2 == 0).cast("string"), c(F.col("user_id").cast("string"), "L"), c("+", k), c("-", k, "_0"), v, c(v, "f"), c(v, "D"), c(k, "."), c(k, "f"), c(".", k), c("  ", k, " "),
    )
    rows = table(spark, folder, "events").select("event_type", F.explode(texts).alias("t"))
    return rows.groupBy(literal_type(F.col("t")).alias("type"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_window(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.counts_by_window(table(spark, folder, "events").select("ts", "event_type"))


@query("""WITH v AS (SELECT user_id AS id, ts, CASE WHEN event_type <> 'error' THEN md5(event_type || props) END AS hash FROM events)
SELECT id, ts, hash FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, hash DESC NULLS LAST) = 1 AND hash IS NOT NULL""")
def latest_versions(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of each user; an error removes it."""
    hash_ = F.when(F.col("event_type") != "error", F.md5(F.concat("event_type", "props")))
    return incremental.latest(table(spark, folder, "events").select(F.col("user_id").alias("id"), "ts", hash_.alias("hash")))


@query("""WITH c AS (SELECT c_name || '#' || c_custkey AS cls, n_name, r_name, c_mktsegment AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
n AS (SELECT n_name AS cls, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT cls, cls AS ancestor, 0 AS ord, true AS known FROM c UNION ALL SELECT cls, n_name, 1, true FROM c UNION ALL SELECT cls, r_name, 2, true FROM c UNION ALL SELECT cls, s, 3, false FROM c
UNION ALL SELECT cls, cls, 0, true FROM n UNION ALL SELECT cls, r_name, 1, true FROM n UNION ALL SELECT r_name, r_name, 0, true FROM region""")
def class_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as classes of their nation and region that implement a segment: the order in which members are looked up."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    none = F.array().cast("array<string>")
    customers = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    customers = customers.select(F.concat_ws("#", "c_name", F.col("c_custkey").cast("string")).alias("cls"), F.col("n_name").alias("superclass"), F.array("c_mktsegment").alias("interfaces"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("cls"), F.col("r_name").alias("superclass"), none.alias("interfaces"))
    regions = region.select(F.col("r_name").alias("cls"), F.lit(None).cast("string").alias("superclass"), none.alias("interfaces"))
    return codemodel.hierarchy(customers.unionByName(nations).unionByName(regions))


@query("""WITH c AS (SELECT c_custkey, n_nationkey AS n, n_regionkey AS r, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS f FROM nation JOIN customer ON c_nationkey = n_nationkey),
f AS (SELECT n_regionkey, min(n_nationkey) AS f FROM nation GROUP BY 1),
o AS (SELECT o_orderkey, o_orderstatus AS s, n, r, f.f FROM orders JOIN c ON o_custkey = c_custkey JOIN f ON n_regionkey = r)
SELECT o_orderkey, 'a' AS step, 'resolved' AS status, 'N' || n || '.home' AS symbol, NULL AS reason, 'r.R' || r AS type FROM o
UNION ALL SELECT o_orderkey, 'b', 'resolved', 'R' || r || '.first()', NULL, 'n.N' || f FROM o
UNION ALL SELECT o_orderkey, 'c', CASE WHEN s = 'P' THEN 'ambiguous' ELSE 'resolved' END, CASE s WHEN 'O' THEN 'N' || f || '.pick(int)' WHEN 'F' THEN 'N' || f || '.pick(String)' END, CASE WHEN s = 'P' THEN 'overload_not_disambiguated' END, 'r.R' || r FROM o
UNION ALL SELECT o_orderkey, 'd', 'unresolved', NULL, CASE WHEN r % 2 = 1 THEN 'possible_inherited_external_method' ELSE 'no_such_method' END, NULL FROM o""")
def receiver_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as methods of their customer's class, with a chain over four receivers: ``this.home.first().pick(status).gone()``.

    Customers inherit the field of their nation, which inherits nothing; regions of odd keys extend a class of a library.
    """
    orders, customers, nations = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    text, no, none = F.lit(None).cast("string"), F.lit(False), F.array().cast("array<string>")
    name = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    n, r, c = name("n.N", "n_nationkey"), name("r.R", "n_regionkey"), name("c.C", "c_custkey")
    root = F.when(F.col("n_regionkey") % 2 == 1, "lib.Root")
    regions = nations.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n_nationkey"))
    rest = [F.lit("class").alias("kind"), none.alias("interfaces"), text.alias("outer"), no.alias("generated")]
    types = regions.select(r.alias("cls"), root.alias("superclass"), *rest).unionByName(nations.select(n.alias("cls"), text.alias("superclass"), *rest))
    types = types.unionByName(customers.select(c.alias("cls"), name("n.N", "c_nationkey").alias("superclass"), *rest))
    fields = nations.select(n.alias("cls"), F.lit("home").alias("name"), F.concat(name("N", "n_nationkey"), F.lit(".home")).alias("field_id"), F.lit("R").alias("type"), no.alias("is_static"))

    def method(rows: DataFrame, cls: Column, id_: Column, call: str, param: str | None, returns: str) -> DataFrame:
        params = F.array(F.lit(param)) if param else none
        return rows.select(cls.alias("cls"), F.concat(id_, F.lit(f".{call}({param or ''})")).alias("method_id"), F.lit(call).alias("name"), params.alias("params"), no.alias("var_args"), F.lit(returns).alias("returns"), no.alias("is_static"), F.lit("method").alias("kind"))

    methods = method(regions, r, name("R", "n_regionkey"), "first", None, "N")
    for param in ("int", "String"):
        methods = methods.unionByName(method(nations, n, name("N", "n_nationkey"), "pick", param, "R"))

    def means(rows: DataFrame, cls: Column, said: str, kind: str, origin: str, fqn: Column) -> DataFrame:
        return rows.select(cls.alias("cls"), F.lit(said).alias("text"), F.lit("resolved").alias("status"), F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), fqn.alias("fqn"), F.lit(0).alias("dims"), text.alias("reason"), none.alias("candidates"))

    names = means(nations, n, "R", "class", "project", r).unionByName(means(regions, r, "N", "class", "project", n))
    names = names.unionByName(means(nations, n, "int", "primitive", "primitive", F.lit("int"))).unionByName(means(nations, n, "String", "class", "external", F.lit("java.lang.String")))
    status = F.col("o_orderstatus")
    given = F.struct(F.when(status == "P", "expr").otherwise("literal").alias("kind"), F.when(status == "O", "int").when(status == "F", "String").otherwise("nowhere").alias("value"))
    empty = F.array().cast("array<struct<kind:string,value:string>>")
    steps = [("a", "field_access", "home", "this", None, empty), ("b", "method_call", "first", "expr", "a", empty), ("c", "method_call", "pick", "expr", "b", F.array(given)), ("d", "method_call", "gone", "expr", "c", empty)]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("step", "kind", "name", "receiver_kind", "on"), s[:5], strict=True)], s[5].alias("args")) for s in steps])).alias("s")
    key = F.col("o_orderkey").cast("string")
    exprs = orders.withColumn("s", step).select(
        F.concat(key, "s.step").alias("expr"), key.alias("method"), name("c.C", "o_custkey").alias("cls"), "s.kind", "s.name", "s.receiver_kind", F.concat(key, "s.on").alias("receiver"), text.alias("type"), "s.args", F.lit(1).alias("line"), no.alias("in_local")
    )
    variables = spark.createDataFrame([], "method string, cls string, name string, kind string, type string, start int, end int, init struct<kind:string,value:string>")
    imports = spark.createDataFrame([], "cls string, name string, owner string")
    found = expressions.resolve_expressions(exprs, variables, types, fields, methods, names, imports)
    return found.select(F.expr("left(expr, length(expr) - 1)").cast("long").alias("o_orderkey"), F.right("expr", F.lit(1)).alias("step"), "status", "symbol", "reason", F.col("type.fqn").alias("type"))


@query("""WITH b AS (SELECT p_size % 6 AS k, replace(p_brand, '#', '_') AS b FROM part)
SELECT DISTINCT CASE k WHEN 0 THEN b || '[]' WHEN 1 THEN 'List<' || b || ', ? extends ' || b || '[]>' WHEN 2 THEN 'pkg.' || b || '.Size' WHEN 3 THEN 'int | ' || b WHEN 4 THEN 'pkg.' || b || '.None' ELSE b || '<' END AS text,
  CASE k WHEN 4 THEN 'unresolved' WHEN 5 THEN 'unresolved' ELSE 'resolved' END AS status, CASE k WHEN 3 THEN 'union' WHEN 4 THEN 'unknown' WHEN 5 THEN 'unknown' ELSE 'class' END AS kind,
  CASE k WHEN 0 THEN 'pkg.' || b WHEN 1 THEN 'java.util.List' WHEN 2 THEN 'pkg.' || b || '.Size' END AS fqn, CASE k WHEN 0 THEN 1 ELSE 0 END AS dims, CASE k WHEN 4 THEN 'unknown_nested_type' WHEN 5 THEN 'unparseable_type' END AS reason FROM b""")
def type_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Types that parts would be declared with, in six forms, where each brand is a class with a member type."""
    brand = F.regexp_replace("p_brand", "#", "_")
    forms = [F.concat("b", F.lit("[]")), F.concat(F.lit("List<"), "b", F.lit(", ? extends "), "b", F.lit("[]>")), F.concat(F.lit("pkg."), "b", F.lit(".Size")), F.concat(F.lit("int | "), "b"), F.concat(F.lit("pkg."), "b", F.lit(".None")), F.concat("b", F.lit("<"))]
    parts = table(spark, folder, "part").select("p_size", brand.alias("b"))
    texts = parts.select(F.lit("pkg.Part").alias("cls"), F.element_at(F.array(*forms), F.col("p_size") % 6 + 1).alias("text"))
    brands, text = parts.select("b").distinct(), F.lit(None).cast("string")
    own = F.concat(F.lit("pkg."), "b")
    types = brands.select(own.alias("fqn"), text.alias("outer")).unionByName(brands.select(F.concat(own, F.lit(".Size")).alias("fqn"), own.alias("outer")))
    none = F.array().cast("array<string>").alias("candidates")
    simple = brands.select(F.lit("pkg.Part").alias("cls"), F.col("b").alias("name"), F.lit("resolved").alias("status"), F.lit("project").alias("origin"), own.alias("fqn"), text.alias("reason"), none)
    simple = simple.unionByName(brands.select(F.lit("pkg.Part").alias("cls"), F.lit("List").alias("name"), F.lit("resolved").alias("status"), F.lit("external").alias("origin"), F.lit("java.util.List").alias("fqn"), text.alias("reason"), none).distinct())
    return codemodel.resolve_texts(texts, types, simple).select("text", "status", "kind", "fqn", "dims", "reason")


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 3 THEN 'ambiguous' WHEN 4 THEN 'ambiguous' WHEN 6 THEN 'unresolved' WHEN 7 THEN 'unresolved' ELSE 'resolved' END AS status,
  CASE p_size % 8 WHEN 0 THEN 'type_variable' WHEN 5 THEN 'external' WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE 'project' END AS origin,
  CASE p_size % 8 WHEN 3 THEN 'multiple_on_demand_imports' WHEN 4 THEN 'duplicate_class_definition' WHEN 6 THEN 'external_unverifiable' WHEN 7 THEN 'unknown_type' END AS reason,
  CASE p_size % 8 WHEN 0 THEN 'T' WHEN 1 THEN 'pkg.Own' || p_partkey WHEN 2 THEN 'pkg.Base.Member' WHEN 4 THEN 'pkg.Dup' WHEN 5 THEN 'java.util.List' END AS fqn,
  CASE p_size % 8 WHEN 3 THEN 'a.Twice,b.Twice' WHEN 4 THEN 'one,two' WHEN 6 THEN 'far.Gone' ELSE '' END AS candidates FROM part""")
def type_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as classes with one type name each, of eight kinds: a type variable, the class itself, a member type that it inherits, one of two
    imports on demand, a class defined twice, one of a known library, one of a package that nothing is known of, and one of nowhere."""
    parts = table(spark, folder, "part").select("p_partkey", (F.col("p_size") % 8).alias("k"), F.concat(F.lit("F"), "p_partkey").alias("file"), F.concat(F.lit("pkg.Own"), "p_partkey").alias("cls"))
    names = [F.lit("T"), F.concat(F.lit("Own"), "p_partkey"), *[F.lit(n) for n in ("Member", "Twice", "Dup", "List", "Gone", "Nope")]]
    refs = parts.select(F.col("p_partkey").alias("ref"), "file", F.element_at(F.array(*names), F.col("k").cast("int") + 1).alias("name"), F.array("cls").alias("scopes"), F.array(F.lit("T")).alias("type_vars"))
    stars = F.explode(F.when(F.col("k") == 3, F.array(F.lit("a"), F.lit("b"))).when(F.col("k") == 5, F.array(F.lit("java.util"))).when(F.col("k") == 6, F.array(F.lit("far"))).otherwise(F.array().cast("array<string>"))).alias("target")
    imports = parts.select("file", stars, F.lit(True).alias("on_demand"))
    fixed = spark.createDataFrame([("pkg.Base", "base"), ("pkg.Base.Member", "base"), ("a.Twice", "a"), ("b.Twice", "b"), ("pkg.Dup", "two"), ("pkg.Dup", "one")], "fqn string, location string")
    types = parts.select(F.col("cls").alias("fqn"), F.col("file").alias("location")).unionByName(fixed)
    hierarchy = codemodel.hierarchy(parts.select("cls", F.lit("pkg.Base").alias("superclass"), F.array().cast("array<string>").alias("interfaces")).unionByName(spark.createDataFrame([("pkg.Base", None, [])], "cls string, superclass string, interfaces array<string>")))
    known = spark.createDataFrame([("java.util", "List"), ("java.lang", "String")], "package string, name string")
    found = codemodel.resolve_types(refs, parts.select("file", F.lit("pkg").alias("package")), imports, types, hierarchy, known)
    return found.select(F.col("ref").alias("p_partkey"), "status", "origin", "reason", "fqn", F.array_join("candidates", ",").alias("candidates"))
