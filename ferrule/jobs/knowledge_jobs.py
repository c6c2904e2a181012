"""The code model's operators over what the tables hold in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.jobs.registry import query
from ferrule.operators import budget, codemodel, knowledge, ordered
from ferrule.sources.tables import table

TOKENS, ROOM = 200, 1_500


@query(f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
i AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
r AS (SELECT doc_id, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM i),
k AS (SELECT doc_id, count(*) FILTER (used <= {int(TOKENS * X.CHARS_PER_TOKEN) - 16}) AS kept FROM r GROUP BY 1)
SELECT doc_id, ceil(length(text) / {X.CHARS_PER_TOKEN}) > {TOKENS} AS cut, CASE WHEN ceil(length(text) / {X.CHARS_PER_TOKEN}) > {TOKENS}
  THEN array_to_string(list_append(ls[:kept], '[... truncated] (' || (len(ls) - kept) || ' more lines)'), chr(10)) ELSE text END AS text FROM l JOIN k USING (doc_id)""")
def cut_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cut between lines to a number of estimated tokens."""
    docs = table(spark, folder, "documents").select("doc_id", X.cut_to_tokens(F.col("text"), F.lit(TOKENS)).alias("x"))
    return docs.select("doc_id", "x.cut", "x.text")


@query("""WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
g AS (SELECT conv_id, CASE WHEN n > 4 AND r >= 4 THEN 4 ELSE r END AS ord, count(*) AS n, min_by(role, turn) AS role, min(turn) AS first, max(turn) AS last FROM r GROUP BY 1, 2)
SELECT conv_id, ord::INTEGER AS ord, CASE WHEN n > 1 THEN n || ' further steps' ELSE role END AS title, n, first, last FROM g""")
def step_tails(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as at most four steps, the rest folded into the last."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    return ordered.collapse_tail(turns, ["conv_id"], "turn", "role", 4)


@query("""WITH e AS (SELECT user_id, event_type AS kind, 'L' || (event_id % 50) || ' ' || (floor(value)::INTEGER % 3) AS entry, event_id % 50 AS line, event_id FROM events WHERE event_type <> 'read' AND event_type <> 'view'),
f AS (SELECT user_id, kind, entry, min(line) AS line, min(event_id) AS id FROM e GROUP BY 1, 2, 3),
k AS (SELECT user_id, kind, string_agg(entry, '; ' ORDER BY line, id) AS entries FROM f GROUP BY 1, 2)
SELECT user_id, string_agg(kind || ': ' || entries, ' | ' ORDER BY kind) AS lifecycle FROM k GROUP BY 1""")
def lifecycles(spark: SparkSession, folder: str) -> DataFrame:
    """Users as variables, and what happened to each but views: kinds of events with their entries in order."""
    events = table(spark, folder, "events")
    kind = F.when(F.col("event_type") == "view", "read").otherwise(F.col("event_type"))
    detail = (F.floor("value").cast("int") % 3).cast("string")
    rows = events.select(F.lit("m").alias("method_id"), F.col("user_id").alias("variable"), kind.alias("kind"), detail.alias("detail"), (F.col("event_id") % 50).alias("line"), F.col("event_id").alias("ord"))
    entries = F.transform(F.map_entries("lifecycle"), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], "; ")))
    return knowledge.lifecycles(rows).select(F.col("variable").alias("user_id"), F.array_join(entries, " | ").alias("lifecycle"))


@query("""SELECT o_orderkey AS id, first_value(o_orderkey) OVER w AS root, (row_number() OVER w - 1)::INTEGER AS steps FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def chain_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that each follow the customer's last one: where the chain starts, and how far back that is."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return knowledge.roots(table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), before.alias("receiver")))


_ALLOTTED = ", ".join(f"('{lang}', {k}, {int(ROOM * v / sum(budget.SHARES.values()))})" for k, (lang, v) in enumerate(zip(("en", "de", "fr", "es"), budget.SHARES.values(), strict=True)))


@query(f"""WITH RECURSIVE a(lang, cat, room) AS (VALUES {_ALLOTTED}),
i AS (SELECT source, doc_id, lang, cat, room, doc_id % 7 AS priority, CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 3.5)) END::BIGINT AS tokens FROM documents JOIN a USING (lang)),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY priority, doc_id) AS n FROM i),
f AS (SELECT source, lang, doc_id, n, tokens <= room AS taken, room - CASE WHEN tokens <= room THEN tokens ELSE 0 END AS room_left FROM p WHERE n = 1
  UNION ALL SELECT p.source, p.lang, p.doc_id, p.n, p.tokens <= f.room_left, f.room_left - CASE WHEN p.tokens <= f.room_left THEN p.tokens ELSE 0 END
  FROM f JOIN p ON p.source = f.source AND p.lang = f.lang AND p.n = f.n + 1),
o AS MATERIALIZED (SELECT p.source, p.doc_id, p.tokens, row_number() OVER (PARTITION BY p.source ORDER BY p.priority, p.cat, p.doc_id) AS n,
  (SELECT sum(room) FROM a) - coalesce((SELECT sum(q.tokens) FROM p q JOIN f g ON g.doc_id = q.doc_id AND g.taken WHERE q.source = p.source), 0) AS pool FROM p JOIN f ON f.doc_id = p.doc_id WHERE NOT f.taken),
s AS (SELECT source, doc_id, n, tokens <= pool AS taken, pool - CASE WHEN tokens <= pool THEN tokens ELSE 0 END AS pool FROM o WHERE n = 1
  UNION ALL SELECT o.source, o.doc_id, o.n, o.tokens <= s.pool, s.pool - CASE WHEN o.tokens <= s.pool THEN o.tokens ELSE 0 END FROM s JOIN o ON o.source = s.source AND o.n = s.n + 1)
SELECT p.source, p.doc_id, CASE WHEN f.taken THEN 'kept' WHEN s.taken THEN 'pooled' ELSE 'omitted' END AS state, CASE WHEN f.taken OR s.taken THEN p.tokens ELSE 0 END::BIGINT AS used
FROM p JOIN f ON f.doc_id = p.doc_id LEFT JOIN s ON s.doc_id = p.doc_id""")
def pooled_budget_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each source within a budget that the languages share; what a language leaves over goes to documents of any."""
    docs = table(spark, folder, "documents").select("source", "doc_id", "lang", (F.col("doc_id") % 7).alias("priority"), X.estimate_tokens(F.col("text")).alias("tokens"))
    shares = dict(zip(("en", "de", "fr", "es"), budget.SHARES.values(), strict=True))
    filled = budget.fill(docs.withColumnRenamed("lang", "category"), "source", "doc_id", ROOM, shares, partial=False)
    return filled.select("source", "doc_id", "state", "used")


@query("""WITH n AS (SELECT *, r_name || '.' || n_name AS fqn FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT DISTINCT c_nationkey % 5 AS own, c_mktsegment AS seg, c_nationkey % 5 || c_mktsegment AS file FROM customer),
r AS (SELECT c_custkey AS ref, c_nationkey % 5 || c_mktsegment AS file, x.n_name AS name, x.fqn, x.n_regionkey AS home, c_nationkey % 5 AS own, c_mktsegment AS seg
  FROM customer JOIN n x ON x.n_nationkey = c_custkey % 25),
k AS (SELECT *, CASE WHEN name < 'E' AND seg = 'AUTOMOBILE' THEN 'single' WHEN home = own THEN 'local' WHEN seg IN ('BUILDING', 'MACHINERY') AND home = (own + 1) % 5 THEN 'star'
  WHEN name > 'T' THEN 'lang' WHEN seg = 'FURNITURE' THEN 'dark' ELSE 'none' END AS how FROM r)
SELECT ref, CASE WHEN how IN ('dark', 'none') THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN how IN ('single', 'local', 'star') THEN 'project' WHEN how = 'lang' THEN 'external' END AS origin,
  CASE how WHEN 'dark' THEN 'external_unverifiable' WHEN 'none' THEN 'unknown_type' END AS reason,
  CASE WHEN how IN ('single', 'local', 'star') THEN fqn WHEN how = 'lang' THEN 'java.lang.' || name END AS fqn, CASE WHEN how = 'dark' THEN 'far.away.' || name ELSE '' END AS candidates FROM k""")
def type_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as types in the package of their region, and customers as files that name one: how each name is resolved."""
    nation, region, customer = (table(spark, folder, t) for t in ("nation", "region", "customer"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_regionkey", "r_name", F.concat_ws(".", "r_name", "n_name").alias("fqn"))
    own, file = F.col("c_nationkey") % 5, F.concat((F.col("c_nationkey") % 5).cast("string"), "c_mktsegment")
    homes = region.select(F.col("r_regionkey").alias("own"), F.col("r_name").alias("package"))
    every = customer.select(own.alias("own"), F.col("c_mktsegment").alias("seg"), file.alias("file")).distinct()
    next_ = homes.select(((F.col("own") + 4) % 5).alias("own"), "package")
    star = every.where("seg IN ('BUILDING', 'MACHINERY')").join(next_, "own").select("file", F.col("package").alias("target"), F.lit(True).alias("on_demand"))
    dark = every.where("seg = 'FURNITURE'").select("file", F.lit("far.away").alias("target"), F.lit(True).alias("on_demand"))
    none = F.array().cast("array<string>")
    refs = customer.withColumn("n_nationkey", F.col("c_custkey") % 25).join(named, "n_nationkey").select(F.col("c_custkey").alias("ref"), "c_mktsegment", "fqn", file.alias("file"), F.col("n_name").alias("name"), none.alias("scopes"), none.alias("type_vars"))
    single = refs.where("c_mktsegment = 'AUTOMOBILE' and name < 'E'").select("file", F.col("fqn").alias("target"), F.lit(False).alias("on_demand")).distinct()
    order = spark.createDataFrame([], "cls string, ancestor string, ord int, known boolean")
    types = named.select("fqn", F.col("n_nationkey").cast("string").alias("location"))
    known = named.where("n_name > 'T'").select(F.lit("java.lang").alias("package"), F.col("n_name").alias("name"))
    found = codemodel.resolve_types(refs.drop("c_mktsegment", "fqn"), every.join(homes, "own").select("file", "package"), single.unionByName(star).unionByName(dark), types, order, known)
    return found.select("ref", "status", "origin", "reason", "fqn", F.array_join("candidates", ",").alias("candidates"))
