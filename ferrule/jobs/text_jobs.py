"""Text functions and operators over lines and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.jobs import sql
from ferrule.jobs.registry import query
from ferrule.operators import ordered
from ferrule.sources.tables import table

MARKER, LIMIT = "[... truncated]", 200
TURN_BUDGET = 400


def lines(spark: SparkSession, folder: str) -> DataFrame:
    split = table(spark, folder, "documents").select("doc_id", F.split("text", "\n", -1).alias("ls"))
    exploded = split.select("doc_id", F.size("ls").alias("n"), F.posexplode("ls").alias("pos", "text"))
    return exploded.select("doc_id", (F.col("pos") + 1).alias("line"), "text", "n")


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace(text, '\{{@[A-Za-z0-9_]+[ \t\r\n]+([^}}]*)\}}', '\1', 'g') AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '(?s)\n[ \t\r\n]*@[A-Za-z0-9_].*$', '') AS t FROM a),
c AS (SELECT doc_id, {sql.squeeze("regexp_replace(t, '<[^>]+>', ' ', 'g')")} AS t FROM b)
SELECT doc_id, CASE WHEN regexp_extract(t, '^(.+?[.!?])( |$)', 1) <> '' THEN regexp_extract(t, '^(.+?[.!?])( |$)', 1) ELSE t END AS sentence FROM c""")
def first_sentence(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("sentence"))


@query(f"""WITH {sql.LINES}, h AS (SELECT *, length(text) <= 24 AS head, sum(CASE WHEN length(text) <= 24 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM lines),
g AS (SELECT doc_id, section::BIGINT AS section, min(line) AS start_line, any_value(n) AS n, coalesce(sum(length(text)) FILTER (NOT head), 0)::BIGINT AS n_chars FROM h GROUP BY 1, 2)
SELECT doc_id, section, start_line::BIGINT AS start_line, coalesce(lead(start_line) OVER (PARTITION BY doc_id ORDER BY section) - 1, n)::BIGINT AS end_line, n_chars FROM g""")
def section_carry_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Short lines are headings; each section runs to the line before the next one."""
    head = F.length("text") <= 24
    found = ordered.carry_sections(lines(spark, folder), ["doc_id"], "line", head)
    body = F.coalesce(F.sum(F.when(~head, F.length("text"))), F.lit(0)).cast("long")
    sections = found.groupBy("doc_id", "section").agg(F.min("line").alias("start"), F.first("n").alias("n"), body.alias("n_chars"))
    after = F.lead("start").over(Window.partitionBy("doc_id").orderBy("section")) - 1
    return sections.select("doc_id", "section", F.col("start").cast("long").alias("start_line"), F.coalesce(after, F.col("n")).cast("long").alias("end_line"), "n_chars")


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 3.5)) END::BIGINT AS tokens FROM documents")
def estimate_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"""WITH {sql.LINES}, r AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS used,
  sum(length(text) + 1) OVER (PARTITION BY doc_id) - 1 AS chars FROM lines),
k AS (SELECT *, ceil(chars / 3.5) > {LIMIT} AS cut FROM r)
SELECT doc_id, any_value(cut) AS truncated, count(*) FILTER (NOT cut OR used <= {int(LIMIT * 3.5) - len(MARKER) - 1}) AS kept_lines,
  count(*) FILTER (cut AND used > {int(LIMIT * 3.5) - len(MARKER) - 1}) AS omitted_lines FROM k GROUP BY doc_id""")
def truncate_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines kept when a text is cut at a line boundary to fit a number of estimated tokens, leaving room for a marker."""
    room = int(LIMIT * X.CHARS_PER_TOKEN) - len(MARKER) - 1
    whole = Window.partitionBy("doc_id")
    used = F.sum(F.length("text") + 1).over(whole.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chars = F.sum(F.length("text") + 1).over(whole) - 1
    rows = lines(spark, folder).withColumns({"used": used, "cut": F.ceil(chars / X.CHARS_PER_TOKEN) > LIMIT})
    over = F.col("cut") & (F.col("used") > room)
    return rows.groupBy("doc_id").agg(F.first("cut").alias("truncated"), F.count_if(~over).alias("kept_lines"), F.count_if(over).alias("omitted_lines"))


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(length(text) / 3.5)) END::BIGINT AS tokens,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, turn, tokens, i, tokens <= {TURN_BUDGET} AS taken, {TURN_BUDGET} - CASE WHEN tokens <= {TURN_BUDGET} THEN tokens ELSE 0 END AS room FROM t WHERE i = 1
  UNION ALL SELECT t.conv_id, t.turn, t.tokens, t.i, t.tokens <= f.room, f.room - CASE WHEN t.tokens <= f.room THEN t.tokens ELSE 0 END FROM t JOIN f ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id, turn, tokens, taken FROM f""")
def greedy_budget_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation that fit a token budget; one that does not fit is skipped, later ones may still."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", X.estimate_tokens(F.col("text")).alias("tokens"))
    return ordered.greedy_fill(turns, ["conv_id"], "turn", "tokens", ["turn"], F.lit(TURN_BUDGET))


@query(f"SELECT doc_id, CASE WHEN length({sql.squeeze('text')}) > 120 THEN substr({sql.squeeze('text')}, 1, 119) || '…' ELSE {sql.squeeze('text')} END AS clipped FROM documents")
def clip_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.clip(F.col("text"), 120).alias("clipped"))


_CODE = r"[;{}][ \t]*$|^[ \t]*(return|if|for|while)\b.*\(|=="


@query(f"""WITH {sql.LINES} SELECT doc_id, CASE WHEN regexp_matches(text, '{_CODE}') THEN 'low' WHEN line = 1 THEN 'high' ELSE 'medium' END AS confidence, count(*) AS n
FROM lines WHERE trim(text) <> '' GROUP BY 1, 2""")
def comment_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Lines like code tell little, the opening line much, others something."""
    confidence = F.when(F.col("text").rlike(_CODE), "low").when(F.col("line") == 1, "high").otherwise("medium")
    return lines(spark, folder).where(F.trim("text") != "").groupBy("doc_id", confidence.alias("confidence")).agg(F.count("*").alias("n"))


_PAIRS = r"""p AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?')) AS t,
  lag(list_distinct(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?'))) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations)"""


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", X.claim_tokens(F.col("text")).alias("t"))
    return turns.withColumn("prior", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn")))


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, len(list_filter(list_intersect(t, prior), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+')))::BIGINT AS shared,
  len(list_filter(list_intersect(t, prior), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+'))) >= 2 AS about FROM p WHERE prior IS NOT NULL""")
def word_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Words of three letters or more that a turn shares with the one before; two make it about the same."""
    shared = F.filter(F.array_intersect("t", "prior"), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))
    rows = _turns(spark, folder).where("prior is not null").select("conv_id", "turn", F.size(shared).cast("long").alias("shared"))
    return rows.withColumn("about", F.col("shared") >= 2)


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, len(t)::BIGINT AS checked, len(list_filter(t, lambda w: NOT list_contains(prior, w)))::BIGINT AS unsupported,
  len(list_filter(t, lambda w: NOT list_contains(prior, w))) = 0 AS supported FROM p WHERE prior IS NOT NULL""")
def unsupported_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of a turn that the turn before does not hold."""
    rows = _turns(spark, folder).where("prior is not null")
    rows = rows.select("conv_id", "turn", F.size("t").cast("long").alias("checked"), F.size(F.array_except("t", "prior")).cast("long").alias("unsupported"))
    return rows.withColumn("supported", F.col("unsupported") == 0)


@query("SELECT doc_id, substr(sha1(coalesce(source, 'None') || '|' || coalesce(lang, 'None') || '|' || text), 1, 16) AS row_id, sha256(text) AS content_hash FROM documents")
def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", X.content_id(F.col("source"), F.col("lang"), F.col("text")).alias("row_id"), F.sha2("text", 256).alias("content_hash"))


@query("""SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, round(avg((props->>'$.k')::BIGINT), 6) AS mean, count(DISTINCT props->>'$.k') AS n_distinct
FROM events GROUP BY event_type""")
def json_property(spark: SparkSession, folder: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    events = table(spark, folder, "events").select("event_type", k.alias("k"))
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.round(F.avg("k"), 6).alias("mean"), F.countDistinct("k").alias("n_distinct"))


@query("""WITH i AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, turn, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations),
s AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT conv_id, island::BIGINT AS island, any_value(role) AS role, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM s GROUP BY 1, 2""")
def stage_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of turns of one role."""
    found = ordered.islands(table(spark, folder, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role")
    return found.groupBy("conv_id", "island").agg(F.first("role").alias("role"), F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("""WITH f AS (SELECT user_id, event_type, min(struct_pack(ts := ts, id := event_id)) AS first FROM events GROUP BY 1, 2)
SELECT user_id, event_type, 'E' || dense_rank() OVER (PARTITION BY user_id ORDER BY first) AS label FROM f""")
def citation_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels E1, E2, ... for the event types of a user in order of first occurrence."""
    firsts = table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return ordered.labels(firsts, ["event_type"], ["user_id"], "first").select("user_id", "event_type", "label")
