"""What the evidence about methods does not establish."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Literals that need no reason, and sources of evidence that can give one.
TRIVIAL = ["0", "1", "-1", '""', "true", "false", "null", "0.0", "2"]
TELLING = ["comment", "test"]
#: Characters by which literals and texts meet before one is looked for in the other.
GRAM = 3
#: Literals of a key, up to which each text of the key looks for all of them.
FEW = 64


def unexplained(literals: DataFrame, texts: DataFrame, key: str = "method") -> DataFrame:
    """The rows of ``literals`` (key, literal) whose literal no text of ``texts`` (key, text) with the same key holds.

    A key of at most ``FEW`` literals hands all of them to each of its texts, which looks for them: texts are dealt once. For keys of more,
    a literal and a text meet by key and the literal's first ``GRAM`` characters, all of it if it is shorter, of which a text lists each
    that it has once; only then is the one looked for in the other. So a key with many literals and many texts makes no pairs of all
    of them. Empty literals are in every text of their key, or unexplained without one; null texts hold nothing.
    """
    asked = literals.select(key, "literal").distinct()
    sizes = asked.groupBy(key).agg(F.count("*").alias("_n"))
    told = texts.where("text is not null").select(key, "text")
    few = asked.join(sizes.where(F.col("_n") <= FEW), key).groupBy(key).agg(F.collect_set("literal").alias("_literals"))
    held = told.join(few, key).select(key, F.explode(F.filter("_literals", lambda x: F.col("text").contains(x))).alias("literal"))
    many = sizes.where(F.col("_n") > FEW).select(key)
    asked = asked.join(many, key, "left_semi").withColumn("_gram", F.substring("literal", 1, GRAM))
    told = told.join(many, key, "left_semi").distinct().withColumn("_text", F.xxhash64("text"))
    # All stretches of one, two and three characters, by a look ahead from each place; the empty one is in every text.
    grams = [F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, GRAM + 1)]
    index = told.select(key, "_text", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *grams))).alias("_gram"))
    # Texts stay behind: what meets by its gram is a hash, and only texts that meet a literal are looked at. Texts of one hash are all looked at.
    met = index.join(asked, [key, "_gram"]).select(key, "_text", "literal").distinct()
    met = met.join(told, [key, "_text"]).where(F.col("text").contains(F.col("literal"))).select(key, "literal")
    return literals.join(held.unionByName(met).distinct(), [key, "literal"], "left_anti").select(*literals.columns)


def unknowns(methods: DataFrame, calls: DataFrame, rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """What cannot be said of methods: method, line, kind, message.

    ``methods`` has method, line and basis (of the purpose, null if there is none), ``calls`` method, name, status, reason, candidates,
    dispatch (methods that override what a call is declared to mean) and line; ``rules`` method, line and literals; ``evidence``
    method, source_type and snippet. Kinds: unresolved_call, ambiguous_call, dynamic_dispatch, unestablished_constant (a literal
    of a rule, once for each method, at its first line, that no comment or test mentions), purpose_not_documented.
    """

    def told(rows: DataFrame, kind: str, *words: Column | str) -> DataFrame:
        return rows.select("method", F.col("line").cast("int").alias("line"), F.lit(kind).alias("kind"), F.concat(*[F.lit(w) if isinstance(w, str) else w for w in words]).alias("message"))

    status, name = F.col("status"), F.col("name")
    reason = F.coalesce("reason", F.lit("None"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    literals = rules.select("method", "line", F.explode("literals").alias("literal")).where(~F.col("literal").isin(TRIVIAL))
    first = literals.groupBy("method", "literal").agg(F.min("line").alias("line"))
    snippets = evidence.where(F.col("source_type").isin(TELLING)).select("method", F.col("snippet").alias("text"))
    parts = [
        told(calls.where(status == "unresolved"), "unresolved_call", "cannot determine what ", name, "() refers to (", reason, ")"),
        told(calls.where(status == "ambiguous"), "ambiguous_call", name, "() could be any of ", count("candidates"), " methods (", reason, ")"),
        told(calls.where(~status.isin("unresolved", "ambiguous") & (F.size("dispatch") > 0)), "dynamic_dispatch", name, "() is resolved on its declared type; at runtime one of ", count("dispatch"), " overriding methods may run"),
        told(unexplained(first, snippets), "unestablished_constant", "the repository does not establish why ", F.col("literal"), " was chosen (no comment or test mentions it)"),
        told(methods.where("basis is not null and basis <> 'comment'"), "purpose_not_documented", "no comment states the purpose; it is inferred from the name and the code's structure"),
    ]
    return reduce(DataFrame.unionByName, parts)


def ordered(found: DataFrame) -> DataFrame:
    """Add ``ord``, the place of each among those of its method, by line, those without one first, then kind and message."""
    return found.withColumn("ord", F.row_number().over(Window.partitionBy("method").orderBy(F.coalesce("line", F.lit(0)), "kind", "message")))
