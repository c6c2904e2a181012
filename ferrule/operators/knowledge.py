"""The model of a code base as tables: search documents, callers and tests, mentions in documentation, uses of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.relational import pick
from ferrule.sources.tables import durable

# Characters of a document, methods, fields and dependencies that a class lists, and names of methods that change their object.
MOST_TEXT, MOST_METHODS, MOST_FIELDS, MOST_USES = 3000, 40, 30, 20
MUTATORS = [
    "add", "addAll", "addFirst", "addLast", "put", "putAll", "putIfAbsent", "remove", "removeAll", "removeIf", "removeFirst", "removeLast",
    "retainAll", "clear", "push", "pop", "poll", "offer", "offerFirst", "offerLast", "append", "insert", "delete", "deleteCharAt",
    "set", "sort", "replaceAll", "merge", "compute", "computeIfAbsent", "computeIfPresent", "setLength", "reverse", "shuffle", "fill",
]
SHORTEST_NAME = 4

_DOCUMENT = ["id", "type", "text", "repository_id", "file_path", "class_name", "method_name", "line_start", "line_end", "symbol_ids"]


def is_mutator(name: Column) -> Column:
    """Does a method of this name change its object?"""
    return F.coalesce(name.isin(MUTATORS) | name.rlike(r"^set\p{Lu}"), F.lit(False))


def of_owner(class_fqn: Column, owner: str) -> Column:
    """Is a class the one named, in full or by its last parts, in any case?"""
    return (class_fqn == owner) | F.lower(class_fqn).endswith(f".{owner.lower()}")


def mentions_symbol(symbol_ids: Column, symbol: str) -> Column:
    return F.array_contains(symbol_ids, symbol)


def changed(variables: DataFrame) -> DataFrame:
    """Variables whose lifecycle, a map of event kinds, has one that modifies them."""
    return variables.where(F.map_contains_key("lifecycle", "modified"))


def prefer_code(rows: DataFrame, by: list[str], is_test: str = "is_test") -> DataFrame:
    """Rows of each group that are no tests, or its tests where it has nothing else."""
    has = rows.groupBy(*by).agg(F.bool_or(~F.col(is_test)).alias("_code"))
    return rows.join(has, by).where(~F.col(is_test) | ~F.col("_code")).drop("_code")


def _document(df: DataFrame, **columns: Column) -> DataFrame:
    text = F.substring(columns.pop("text"), 1, MOST_TEXT)
    named = {"text": text, "repository_id": F.col("repository_id"), "file_path": F.col("file"), "method_name": F.lit(""), "line_start": F.col("start_line"), "line_end": F.col("end_line"), **columns}
    return df.select(*[named[c].alias(c) for c in _DOCUMENT])


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def method_documents(methods: DataFrame) -> DataFrame:
    """One document for each method: its name, purpose and source, of a test if it is one."""
    head = F.concat("class_fqn", F.lit("."), "name", F.lit(" "), "signature", F.lit("\npurpose: "), _or_empty("purpose"), F.lit("\n"))
    prefix = F.when(F.col("is_test"), "ts:").otherwise("ms:")
    kind = F.when(F.col("is_test"), "test").otherwise("method_source")
    return _document(methods, id=F.concat(prefix, "id"), type=kind, text=F.concat(head, _or_empty("source")), class_name=F.col("class_fqn"), method_name=F.col("name"), symbol_ids=F.array("method_id"))


def rule_documents(rules: DataFrame, methods: DataFrame) -> DataFrame:
    """One document for each rule of a method; ``rules`` has rule_id, method (an id), summary, condition, scope, calculation, action, start_line and end_line."""
    owner = methods.select(F.col("id").alias("method"), "repository_id", "file", "class_fqn", "name", "method_id")
    head = F.concat("class_fqn", F.lit("."), "name", F.lit(": "), _or_empty("summary"), F.lit("\ncondition: "), _or_empty("condition"))
    tail = F.concat(F.lit("\nscope: "), _or_empty("scope"), F.lit(" calculation: "), _or_empty("calculation"), F.lit(" action: "), _or_empty("action"))
    return _document(rules.join(owner, "method"), id=F.concat(F.lit("rc:"), "rule_id", F.lit(":"), "method"), type=F.lit("rule_candidate"), text=F.concat(head, tail), class_name=F.col("class_fqn"), method_name=F.col("name"), symbol_ids=F.array("method_id"))


def class_documents(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """One document for each class: its purpose, fields, dependencies and the signatures of its first methods, of which only those are gathered."""
    first = pick(methods.select("class_id", "signature", "start_line", "id"), ["class_id"], [F.col("start_line"), F.col("id")], MOST_METHODS)
    signatures = first.groupBy(F.col("class_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "signature"))).alias("_m"))
    fields = F.array_join(F.transform(F.slice("fields", 1, MOST_FIELDS), lambda f: F.concat(f["type"], F.lit(" "), f["name"])), ", ")
    listed = F.array_join(F.transform(F.coalesce("_m", F.array().cast("array<struct<start_line:int,id:string,signature:string>>")), lambda m: m["signature"]), ", ")
    text = F.concat(
        F.concat_ws("\n", F.concat("kind", F.lit(" "), "fqn"), F.concat(F.lit("purpose: "), _or_empty("purpose")), _or_empty("structure")),
        F.concat(F.lit("\nfields: "), F.coalesce(fields, F.lit("")), F.lit("\nmethods: "), listed, F.lit("\nuses: ")),
        F.coalesce(F.array_join(F.slice("dependencies", 1, MOST_USES), ", "), F.lit("")),
    )
    return _document(classes.join(signatures, "id", "left"), id=F.concat(F.lit("cs:"), "id"), type=F.lit("class_source"), text=text, class_name=F.col("fqn"), symbol_ids=F.array("fqn"))


def evidence_documents(evidence: DataFrame) -> DataFrame:
    """One document for each piece of evidence from comments and documentation, however many symbols it is about, with all of them in order.

    ``evidence`` has a row for each piece and symbol: repository_id, evidence_id, ord, source_type, snippet, file, class_name,
    owner, method, start_line, end_line, symbol; the row of the least ``ord`` describes the piece.
    """
    told = evidence.where(F.col("source_type").isin("comment", "readme", "documentation"))
    about = F.struct("repository_id", "source_type", "snippet", "file", F.coalesce("class_name", "owner").alias("class_fqn"), F.coalesce("method", F.lit("")).alias("name"), "start_line", "end_line")
    merged = told.groupBy("evidence_id").agg(F.min_by(about, "ord").alias("e"), F.array_sort(F.collect_set("symbol")).alias("symbols")).select("evidence_id", "e.*", "symbols")
    kind = F.when(F.col("source_type") == "comment", "evidence").otherwise("documentation")
    return _document(merged, id=F.concat(F.lit("ev:"), "evidence_id"), type=kind, text=F.col("snippet"), class_name=F.col("class_fqn"), method_name=F.col("name"), symbol_ids=F.col("symbols"))


def documents(methods: DataFrame, classes: DataFrame, rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """All that search looks through, one row each: id, type, text, repository_id, file_path, class_name, method_name, line_start, line_end, symbol_ids."""
    return method_documents(methods).unionByName(rule_documents(rules, methods)).unionByName(class_documents(classes, methods)).unionByName(evidence_documents(evidence))


def document_hash(docs: DataFrame) -> DataFrame:
    """Add ``hash``, which tells whether a document changed: of all its columns but the id, null told from empty."""
    return docs.withColumn("hash", F.substring(F.sha1(F.to_json(F.struct(*_DOCUMENT[1:]), {"ignoreNullFields": "false"})), 1, 16))


def metadata(docs: DataFrame) -> DataFrame:
    """The scalar columns that filters of search look at; symbols as one text."""
    return docs.select("id", *[c for c in _DOCUMENT[1:-1] if c != "text"], F.array_join("symbol_ids", ",").alias("symbol_ids"))


def call_rows(edges: DataFrame) -> DataFrame:
    """One row for each call and target, and one of a null target for a call that leads to none known."""
    return edges.withColumn("callee_id", F.explode_outer("targets")).drop("targets")


def tested_by(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Tests and the methods that they call, which are no tests: (method_id, test_id, lines)."""
    kinds = methods.select("method_id", "is_test")
    tests = kinds.where("is_test").select(F.col("method_id").alias("caller"))
    subjects = kinds.where("not is_test").select(F.col("method_id").alias("callee_id"))
    pairs = calls.join(tests, "caller").join(subjects, "callee_id")
    return pairs.groupBy(F.col("callee_id").alias("method_id"), F.col("caller").alias("test_id")).agg(F.array_sort(F.collect_set("line")).alias("lines"))


def with_summaries(reached: DataFrame, methods: DataFrame, id_: str = "method_id") -> DataFrame:
    """Rows with the summary of their method, of several the first by file; null for one outside the project."""
    return reached.join(pick(methods, [id_], [F.col("file")]), id_, "left")


def value_uses(edges: DataFrame, methods: DataFrame, via: str, name: Column) -> DataFrame:
    """Value edges of one kind that meet ``name``, with the class and name of the method they are in: arguments of a call, uses of a result."""
    own = methods.select("repository_id", "method_id", "class_fqn", F.col("name").alias("method_name"))
    return edges.where((F.col("via") == via) & name).join(own, ["repository_id", "method_id"])


def writers(variables: DataFrame, methods: DataFrame) -> DataFrame:
    """Variables that are modified, with the methods that do so."""
    return changed(variables).join(methods.select("repository_id", "method_id", "class_fqn", F.col("name").alias("method_name")), ["repository_id", "method_id"])


def lifecycles(events: DataFrame) -> DataFrame:
    """What happens to each variable, reads aside: a map from the kind of event to its entries, once each, in order.

    ``events`` has method_id, variable, kind, detail, line, ord.
    """
    told = events.where("kind <> 'read'").withColumn("entry", F.concat(F.lit("L"), F.col("line").cast("string"), F.lit(" "), F.coalesce("detail", F.lit(""))))
    first = told.groupBy("method_id", "variable", "kind", "entry").agg(F.min(F.struct("line", "ord")).alias("at"))
    kinds = first.groupBy("method_id", "variable", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"]).alias("entries"))
    return kinds.groupBy("method_id", "variable").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "entries")))).alias("lifecycle"))


def mentioned(sections: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sections of documentation (section_id, heading, text) that mention symbols (symbol_id, kind, class_name, name, qualified_only).

    A class is mentioned by its simple name, unless that is too short to mean it; a method where it is called, with its class
    before it if ``qualified_only``. Words are the equi key; the pattern is tried on what they join. Sections have one row each.
    """
    words = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "text", "heading"), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    met = sections.select("section_id", F.explode(words).alias("name")).join(symbols, "name")
    classes = met.where((F.col("kind") == "class") & (F.length("name") >= SHORTEST_NAME)).select("symbol_id", "section_id")
    # Words travel alone; texts are fetched only for the sections that name a method.
    methods = met.where("kind <> 'class'").join(sections.select("section_id", "text"), "section_id")
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.col(c), F.lit(r"\E"))
    owner = F.concat(quoted("class_name"), F.lit(r"\."))
    called = F.concat(F.lit(r"(?s).*\b"), F.when(F.col("qualified_only"), owner).otherwise(F.concat(F.lit("(?:"), owner, F.lit(")?"))), quoted("name"), F.lit(r"\s*\(.*"))
    return classes.unionByName(methods.where(F.regexp_like("text", called)).select("symbol_id", "section_id"))


def outlined(statements: DataFrame) -> DataFrame:
    """Measures of methods from their statements (method_id, kind, depth): complexity, nesting, decisions, loops."""
    kind = F.col("kind")
    branches = kind.isin("if", "for", "foreach", "while", "do", "case", "catch", "ternary", "and", "or")
    return statements.groupBy("method_id").agg((1 + F.count_if(branches)).alias("complexity"), (F.max("depth") + 1).alias("nesting"), F.count_if(kind == "if").alias("decisions"), F.count_if(kind.isin("for", "foreach", "while", "do")).alias("loops"))


def roots(links: DataFrame, id_: str = "id", to: str = "receiver") -> DataFrame:
    """Each expression with the one its chain of receivers starts from: (id, root, steps), by doubling the links until none moves."""
    state = durable(links.select(id_, F.coalesce(to, id_).alias("root"), F.when(F.col(to).isNull(), 0).otherwise(1).alias("steps")))
    while True:
        further = state.select(F.col(id_).alias("root"), F.col("root").alias("_next"), F.col("steps").alias("_more"))
        moved = durable(state.join(further, "root", "left").select(id_, F.coalesce("_next", "root").alias("root"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), (F.coalesce("_more", F.lit(0)) > 0).alias("_moved")))
        state = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return state


def ordered_calls(calls: DataFrame) -> DataFrame:
    """Add ``ord``: the place of a call in its caller, by line and then expression."""
    return calls.withColumn("ord", F.row_number().over(Window.partitionBy("caller").orderBy("line", "expr_id")))
