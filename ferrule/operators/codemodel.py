"""What can be derived from tables of types, methods and calls: hierarchies, call edges, overrides, risks and purposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import words_of
from ferrule.functions.types import type_tree
from ferrule.operators.relational import ladder
from ferrule.sources.tables import durable, written

# What the first word of a method's name says that it does.
VERBS = {
    "get": "returns", "is": "checks whether", "has": "checks whether", "can": "checks whether", "should": "checks whether", "set": "sets",
    "create": "creates", "build": "builds", "make": "creates", "new": "creates", "validate": "validates", "check": "checks",
    "verify": "verifies", "calculate": "calculates", "compute": "computes", "find": "finds", "fetch": "fetches", "load": "loads",
    "read": "reads", "save": "saves", "store": "stores", "write": "writes", "delete": "deletes", "remove": "removes",
    "update": "updates", "process": "processes", "handle": "handles", "convert": "converts", "to": "converts to", "add": "adds",
    "parse": "parses", "format": "formats", "apply": "applies", "init": "initializes", "initialize": "initializes", "generate": "generates",
    "map": "maps", "filter": "filters", "group": "groups", "sort": "sorts", "merge": "merges", "send": "sends",
    "execute": "executes", "run": "runs", "resolve": "resolves", "normalize": "normalizes", "extract": "extracts", "register": "registers",
    "match": "matches", "count": "counts", "select": "selects", "collect": "collects", "assign": "assigns", "reset": "resets",
    "clear": "clears", "close": "closes", "open": "opens", "start": "starts", "stop": "stops",
    "classify": "classifies", "determine": "determines", "evaluate": "evaluates", "compare": "compares", "combine": "combines", "join": "joins",
    "split": "splits", "transform": "transforms", "translate": "translates", "rank": "ranks", "notify": "notifies", "publish": "publishes",
    "schedule": "schedules", "authorize": "authorizes", "lookup": "looks up", "populate": "populates", "enrich": "enriches",
    "with": "returns a copy with", "of": "creates from", "from": "creates from",
}
# Boxes of primitive types and what those widen to; types that nothing extends.
PRIMITIVES = ["boolean", "byte", "short", "int", "long", "char", "float", "double"]
BOXES = {"java.lang.Boolean": "boolean", "java.lang.Byte": "byte", "java.lang.Short": "short", "java.lang.Integer": "int", "java.lang.Long": "long", "java.lang.Character": "char", "java.lang.Float": "float", "java.lang.Double": "double"}
WIDENING = {"byte": ["short", "int", "long", "float", "double"], "short": ["int", "long", "float", "double"], "char": ["int", "long", "float", "double"], "int": ["long", "float", "double"], "long": ["float", "double"], "float": ["double"]}
FINAL_TYPES = ["java.lang.String", *BOXES]
#: What a name says if more words follow the first, in place of ``{}``.
PHRASES = {word: f"{says} {{}}" for word, says in VERBS.items()} | {"get": "returns the {}"} | {word: f"checks whether it {word} {{}}" for word in ("has", "can", "should")}


def _table(texts: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])


def purpose(name: Column, kind: Column, class_name: Column) -> Column:
    """What a method's name promises, as a phrase from a table; a guess, to be marked as one.

    The first word picks the phrase that the others complete; a word that the table lacks is something the method performs.
    What is not a method builds its class. A name without words says itself.
    """
    words = words_of(name)
    lone = F.size(words) == 1
    phrase = F.try_element_at(F.when(lone, _table(VERBS)).otherwise(_table(PHRASES)), F.get(words, F.lit(0)))
    said = F.replace(phrase, F.lit("{}"), F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " "))
    guess = F.when(F.size(words) == 0, name).otherwise(F.coalesce(said, F.concat(F.lit("performs "), F.array_join(words, " "))))
    return F.when(kind == "method", guess).otherwise(F.concat(F.lit("constructs a "), F.array_join(words_of(class_name), " ")))


def hierarchy(types: DataFrame) -> DataFrame:
    """Each type with itself and its ancestors in the order of lookup: (cls, ancestor, ord, known).

    ``types`` has cls, superclass and interfaces. The order is depth first, superclass before interfaces, each ancestor at its
    first place; ``known`` says whether the table has it. One join per level, until none has ancestors left. A path is the list
    of places from the class up; of several to one ancestor the least is kept at every level, since whatever follows has the same
    rest on each, and only a path less than the one before is followed again: diamonds do not multiply, and cycles end.
    """
    parents = types.select("cls", F.array_compact(F.concat(F.array("superclass"), F.coalesce("interfaces", F.array().cast("array<string>")))).alias("up"))
    edges = written(parents.select("cls", F.posexplode("up").alias("pos", "parent")))
    front = types.select("cls", F.col("cls").alias("ancestor"), F.array().cast("array<int>").alias("path")).distinct()
    found = front
    while True:
        step = front.join(edges.select(F.col("cls").alias("ancestor"), "pos", "parent"), "ancestor")
        step = step.select("cls", F.col("parent").alias("ancestor"), F.concat("path", F.array("pos")).alias("path")).groupBy("cls", "ancestor").agg(F.min("path").alias("path"))
        before = found.withColumnRenamed("path", "_before")
        front = written(step.join(before, ["cls", "ancestor"], "left").where("_before is null or path < _before").drop("_before"))
        if front.isEmpty():
            break
        found = written(found.unionByName(front).groupBy("cls", "ancestor").agg(F.min("path").alias("path")))
    ranked = found.withColumn("ord", F.row_number().over(Window.partitionBy("cls").orderBy("path")) - 1)
    known = types.select(F.col("cls").alias("ancestor"), F.lit(True).alias("known")).distinct()
    return ranked.join(known, "ancestor", "left").select("cls", "ancestor", "ord", F.coalesce("known", F.lit(False)).alias("known"))


def members(methods: DataFrame, order: DataFrame) -> DataFrame:
    """The methods that each class has, its own and inherited: of one signature, the nearest. ``methods`` has cls, method_id, name, params."""
    owned = methods.select(F.col("cls").alias("ancestor"), "method_id", "name", "params")
    joined = order.join(owned, "ancestor")
    nearest = F.row_number().over(Window.partitionBy("cls", "name", "params").orderBy("ord", "method_id"))
    return joined.withColumn("_r", nearest).where("_r = 1").select("cls", "method_id", "name", "params", "ord")


def call_edges(calls: DataFrame, methods: DataFrame, order: DataFrame) -> DataFrame:
    """Every call with what it leads to: call_id, caller, name, status, targets.

    ``calls`` has call_id, caller, receiver, name, args (types, null where unknown). Candidates have the name and as many
    parameters, and no argument type that is known and differs, unless only that leaves none. One is resolved, several are
    ambiguous, none is external if an ancestor of the receiver is not in the tables, or else unresolved. No call is dropped.
    """
    candidates = members(methods, order).select(F.col("cls").alias("receiver"), "name", "method_id", "params")
    joined = calls.join(candidates, ["receiver", "name"], "left")
    fits = F.size("params") == F.size("args")
    same = F.forall(F.zip_with("params", "args", lambda p, a: a.isNull() | (p == a)), lambda x: x)
    joined = joined.withColumns({"_fits": F.coalesce(fits, F.lit(False)), "_exact": F.coalesce(fits & same, F.lit(False))})
    all_ids = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("method_id"))))
    grouped = joined.groupBy("call_id", "caller", "receiver", "name").agg(all_ids("_exact").alias("exact"), all_ids("_fits").alias("fits"))
    targets = F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("fits"))
    outside = order.groupBy(F.col("cls").alias("receiver")).agg(F.bool_or(~F.col("known")).alias("outside"))
    grouped = grouped.withColumn("targets", targets).join(outside, "receiver", "left")
    n = F.size("targets")
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").when(F.coalesce("outside", F.lit(True)), "external").otherwise("unresolved")
    return grouped.select("call_id", "caller", "name", status.alias("status"), "targets")


def overrides(methods: DataFrame, order: DataFrame) -> DataFrame:
    """Pairs (method_id, overridden): the same name and parameters in an ancestor; static methods override nothing."""
    own = methods.where("not coalesce(is_static, false)")
    above = own.select(F.col("cls").alias("ancestor"), F.col("method_id").alias("overridden"), "name", "params")
    return own.join(order.where("ord > 0"), "cls").join(above, ["ancestor", "name", "params"]).select("method_id", "overridden")


def implicit_members(types: DataFrame, methods: DataFrame) -> DataFrame:
    """Members that a compiler adds: default constructors of classes, values and valueOf of enums, accessors and the constructor of records.

    ``types`` has cls, kind and components (name, type); returns cls, method_id, name, params.
    """
    simple = F.element_at(F.split("cls", r"\."), -1)
    none = F.array().cast("array<string>")
    declared = methods.select("cls", "name", "params")
    rows = [
        types.where("kind = 'class'").join(methods.where("kind = 'constructor'").select("cls").distinct(), "cls", "left_anti").select("cls", simple.alias("name"), none.alias("params")),
        types.where("kind = 'enum'").select("cls", F.lit("values").alias("name"), none.alias("params")),
        types.where("kind = 'enum'").select("cls", F.lit("valueOf").alias("name"), F.array(F.lit("String")).alias("params")),
        types.where("kind = 'record'").select("cls", simple.alias("name"), F.transform("components", lambda c: c["type"]).alias("params")),
        types.where("kind = 'record'").select("cls", F.explode("components").alias("c")).select("cls", F.col("c.name").alias("name"), none.alias("params")),
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    new = every.join(declared, ["cls", "name", "params"], "left_anti")
    return new.select("cls", F.concat("cls", F.lit("#"), "name", F.lit("("), F.array_join("params", ","), F.lit(")")).alias("method_id"), "name", "params")


def risks(methods: DataFrame, edges: DataFrame) -> DataFrame:
    """Risks of methods by their measures and callers: method_id, kind, level.

    ``methods`` has method_id, complexity, nesting, start_line, end_line and is_test; ``edges`` caller and callee.
    """
    tests = methods.select(F.col("method_id").alias("caller"), "is_test")
    used = edges.select("caller", "callee").distinct().join(tests, "caller", "left").where("not coalesce(is_test, false)")
    counted = methods.join(used.groupBy(F.col("callee").alias("method_id")).agg(F.count("*").alias("callers")), "method_id", "left").fillna(0, ["callers"])

    def risk(kind: str, holds: Column, high: Column) -> Column:
        return F.when(holds, F.struct(F.lit(kind).alias("kind"), F.when(high, "high").otherwise("medium").alias("level")))

    complexity, nesting, callers = F.col("complexity"), F.col("nesting"), F.col("callers")
    length, never = F.col("end_line") - F.col("start_line") + 1, F.lit(False)
    found = F.array(risk("complexity", complexity >= 10, complexity >= 15), risk("nesting", nesting >= 4, never), risk("length", length > 80, never), risk("wide_impact", callers >= 5, callers >= 15))
    return counted.select("method_id", F.explode(F.array_compact(found)).alias("r")).select("method_id", "r.kind", "r.level")


def resolve_types(refs: DataFrame, files: DataFrame, imports: DataFrame, types: DataFrame, order: DataFrame, known: DataFrame) -> DataFrame:
    """What the simple type names of ``refs`` mean: ref, status, origin, reason, fqn, candidates. Every reference is kept.

    ``refs`` has ref, file, name, scopes (the enclosing classes, innermost first) and type_vars; ``files`` file and package;
    ``imports`` file, target and on_demand; ``types`` fqn and location; ``order`` the hierarchy of the enclosing classes;
    ``known`` package and name of types outside the project.

    Each rule of the language is a branch of candidates, and the first branch that has any for a reference decides: a type
    variable; an enclosing class of that name or a member type that it has or inherits; a single import; the package of the
    file; imports on demand, of the project; those of known types, with java.lang; those that nothing is known of. Several
    candidates of one branch, or several definitions of one class, make the reference ambiguous.
    """
    simple = lambda c: F.element_at(F.split(c, r"\."), -1)
    refs = refs.join(files.select("file", "package"), "file", "left")
    sites = durable(types.groupBy(F.col("fqn").alias("target")).agg(F.array_sort(F.collect_list("location")).alias("sites")))
    defined = sites.select("target")

    variables = refs.where(F.array_contains("type_vars", F.col("name"))).select("ref", F.col("name").alias("target"), F.lit("type_variable").alias("origin"))
    scopes = refs.select("ref", "name", F.posexplode("scopes").alias("pos", "cls"))
    own = scopes.where(simple("cls") == F.col("name")).select("ref", "pos", F.lit(-1).alias("ord"), F.col("cls").alias("target"))
    inherited = scopes.join(order.select("cls", "ancestor", "ord"), "cls").select("ref", "pos", "ord", F.concat_ws(".", "ancestor", "name").alias("target")).join(defined, "target", "left_semi")
    nearest = own.unionByName(inherited).groupBy("ref").agg(F.min_by("target", F.struct("pos", "ord")).alias("target"))

    named = imports.where("not on_demand").select("file", "target", simple("target").alias("name"))
    single = refs.join(named, ["file", "name"]).groupBy("ref").agg(F.min("target").alias("target"))
    local = refs.select("ref", F.concat_ws(".", F.nullif("package", F.lit("")), "name").alias("target")).join(defined, "target", "left_semi")
    stars = refs.select("ref", "file", "name").join(imports.where("on_demand").select("file", F.col("target").alias("package")), "file")
    spread = stars.select("ref", "package", "name", F.concat_ws(".", "package", "name").alias("target")).distinct()
    ours = spread.join(defined, "target", "left_semi").select("ref", "target")
    everywhere = refs.select("ref", F.lit("java.lang").alias("package"), "name", F.concat(F.lit("java.lang."), "name").alias("target"))
    theirs = spread.unionByName(everywhere).distinct().join(known.select("package", "name").distinct(), ["package", "name"], "left_semi").select("ref", "target")
    packages = types.select(F.expr("slice(split(fqn, '[.]'), 1, size(split(fqn, '[.]')) - 1)").alias("p")).where("size(p) > 0")
    prefixes = packages.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", F.lit(1), k), "."))).alias("package")).distinct()
    dark = spread.join(prefixes, "package", "left_anti").select("ref", "target")

    external = lambda df: df.join(defined.withColumn("_in", F.lit(True)), "target", "left").select("ref", "target", F.when(F.col("_in"), "project").otherwise("external").alias("origin"))
    branches = [variables, *[b.select("ref", "target").withColumn("origin", F.lit("project")) for b in (nearest,)], external(single), *[b.select("ref", "target").withColumn("origin", F.lit(o)) for b, o in ((local, "project"), (ours, "project"), (theirs, "external"), (dark, "unverifiable"))]]
    best = ladder(branches, "ref").join(sites, "target", "left")
    grouped = best.groupBy("ref").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.first("origin").alias("origin"), F.first("sites").alias("sites"))
    joined = refs.select("ref").join(grouped, "ref", "left")
    n, twice = F.coalesce(F.size("targets"), F.lit(0)), (F.col("origin") == "project") & (F.size("sites") > 1)
    dark_, one = F.col("origin") == "unverifiable", n == 1
    reason = F.when(n == 0, "unknown_type").when(dark_, "external_unverifiable").when(n > 1, "multiple_on_demand_imports").when(twice, "duplicate_class_definition")
    status = F.when((n == 0) | dark_, "unresolved").when((n > 1) | twice, "ambiguous").otherwise("resolved")
    none = F.array().cast("array<string>")
    candidates = F.when(one & twice, F.col("sites")).when((n > 1) | dark_, F.col("targets")).otherwise(none)
    return joined.select("ref", status.alias("status"), F.when(~dark_, F.col("origin")).alias("origin"), reason.alias("reason"), F.when(one & ~dark_, F.col("targets")[0]).alias("fqn"), F.coalesce(candidates, none).alias("candidates"))


def resolve_texts(texts: DataFrame, types: DataFrame, simple: DataFrame) -> DataFrame:
    """What types as they are written mean within a class, as ``expressions.resolve_expressions`` takes them: cls, text, status, kind, origin, fqn, dims, reason, candidates.

    ``texts`` has cls and text; ``types`` fqn and outer (null for a class of its own); ``simple`` what the simple names and the first
    parts of qualified ones mean within a class, as of ``resolve_types``: cls, name, status, origin, fqn, reason, candidates.
    A union is resolved if all its members are; wildcards, primitives and type variables are kinds of their own. Of a qualified name,
    a first part that means a class leads on to its member types; else the longest prefix that is a class of the project does, found by one
    join of all prefixes; else a capital in a later part says that it is a class outside. Texts that are no types are told so.
    """
    rows = texts.select("cls", "text").distinct().withColumn("tree", type_tree(F.col("text")))
    heads = F.filter("tree", lambda n: n["parent"] == -1)
    nodes = durable(rows.select("cls", "text", F.size(heads).alias("members"), F.explode_outer(heads).alias("n")).select("cls", "text", "members", "n.pos", "n.name", "n.dims"))
    parts = F.split("name", r"\.")
    heads = nodes.withColumn("head", parts[0]).join(simple.withColumnRenamed("name", "head"), ["cls", "head"], "left")
    heads = heads.withColumn("rest", F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "."))
    # Candidates for where a qualified name starts: the class that its first part means, then prefixes, the longest first.
    led = F.when((F.col("status") == "resolved") & (F.col("origin") == "project") & (F.col("rest") != ""), F.col("fqn"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    asked = heads.where("rest <> '' and (status is null or status = 'unresolved' or (status = 'resolved' and origin = 'project'))").select("cls", "text", "pos", "name", led.alias("led"), F.explode(prefixes).alias("prefix"))
    own = F.when(F.col("led").isNotNull(), F.concat("led", F.expr("substring(prefix, length(split(name, '[.]')[0]) + 1)"))).otherwise(F.col("prefix"))
    known = asked.withColumn("fqn", own).join(types.select("fqn", "outer").distinct(), "fqn")
    best = known.groupBy("cls", "text", "pos", "name").agg(F.max_by(F.struct("fqn", "prefix"), F.length("prefix")).alias("best"), F.max(F.length("prefix")).alias("reach"))
    joined = heads.join(best.select("cls", "text", "pos", "best"), ["cls", "text", "pos"], "left")
    whole, none = F.col("best.prefix") == F.col("name"), F.array().cast("array<string>")
    outside = F.exists(F.slice(parts, F.lit(2), F.size(parts)), lambda p: p.rlike(r"^\p{Lu}"))

    def said(status: Column | str, kind: Column | str, origin: Column | str | None = None, fqn: Column | None = None, reason: Column | str | None = None, candidates: Column = none) -> Column:
        given = {"status": status, "kind": kind, "origin": origin, "fqn": fqn, "reason": reason}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(k) for k, v in given.items()], candidates.alias("candidates"))

    one = F.col("rest") == ""
    variable = F.when(F.col("origin") == "type_variable", "type_variable").when(F.col("status") == "resolved", "class").otherwise("unknown")
    meant = (
        F.when(F.col("members").isNull() | F.col("name").isNull(), said("unresolved", "unknown", reason="unparseable_type"))
        .when(F.col("name") == "?", said("resolved", "wildcard"))
        .when(F.col("name").isin(PRIMITIVES), said("resolved", "primitive", "primitive", F.col("name")))
        .when(one & F.col("status").isNull(), said("unresolved", "unknown", reason="unknown_type"))
        .when(one | (F.col("status") == "ambiguous"), said(F.col("status"), variable, F.col("origin"), F.col("fqn"), F.col("reason"), F.coalesce("candidates", none)))
        .when((F.col("status") == "resolved") & (F.col("origin") == "external"), said("resolved", "class", "external", F.concat_ws(".", "fqn", "rest")))
        .when(whole, said("resolved", "class", "project", F.col("best.fqn")))
        .when(F.col("best").isNotNull() | led.isNotNull(), said("unresolved", "unknown", reason="unknown_nested_type"))
        .when(outside, said("resolved", "class", "external", F.col("name")))
        .otherwise(said("unresolved", "unknown", reason="unknown_qualified_name"))
    )
    members = joined.select("cls", "text", "members", "pos", "dims", meant.alias("m"))
    grouped = members.groupBy("cls", "text").agg(F.max("members").alias("members"), F.min_by(F.struct("dims", "m"), F.coalesce("pos", F.lit(0))).alias("x"), F.bool_and(F.col("m.status") == "resolved").alias("all"))
    union = said(F.when(F.col("all"), "resolved").otherwise("unresolved"), "union", reason=F.when(~F.col("all"), "union_member_unresolved"))
    final = F.when(F.col("members") > 1, union).otherwise(F.col("x.m"))
    return grouped.select("cls", "text", final.alias("m"), F.when(F.col("members") == 1, F.col("x.dims")).otherwise(0).alias("dims")).select("cls", "text", "m.status", "m.kind", "m.origin", "m.fqn", "dims", "m.reason", "m.candidates")


#: Pairs of realms between which no value passes but by a conversion: numbers are primitives and boxes, closed classes have all
#: their ancestors in the project, open ones do not, library is any type outside. Other pairs leave the question open.
_MISFITS = {
    "number": ["number", "final", "closed", "open"],
    "final": ["number", "final", "closed", "open"],
    "library": ["closed", "open"],
    "open": ["number"],
    "closed": ["number", "final", "library", "closed", "open"],
}


def _realms(order: DataFrame) -> DataFrame:
    """(type, realm) of all types but those of libraries."""
    fixed = [(t, "number") for t in [*PRIMITIVES, *BOXES]] + [(t, "final") for t in FINAL_TYPES if t not in BOXES]
    classes = order.groupBy(F.col("cls").alias("type")).agg(F.when(F.bool_and("known"), "closed").otherwise("open").alias("realm"))
    return order.sparkSession.createDataFrame(fixed, "type string, realm string").unionByName(classes)


def _conversions(order: DataFrame) -> DataFrame:
    """(arg, param) for which a value of one type passes as another: to an ancestor, unboxed, or widened; nothing is boxed on the way."""
    forms = {p: [p, *[box for box, of in BOXES.items() if of == p]] for p in PRIMITIVES}
    numbers = [(a, b) for p in PRIMITIVES for q in [p, *WIDENING.get(p, [])] for a in forms[p] for b in forms[q] if a != p or b == q]
    return order.sparkSession.createDataFrame(numbers, "arg string, param string").unionByName(order.select(F.col("cls").alias("arg"), F.col("ancestor").alias("param")))


#: Pairs of types that have more than one row of so many are frequent.
FREQUENT = 1000


def assignable(places: DataFrame, order: DataFrame) -> DataFrame:
    """Add ``fits`` to rows with arg and param: can a value of the one type be passed as the other? False only if that is sure not to be.

    Types are names with a pair of brackets for each dimension; null is an unknown type and ``null`` the null literal. The
    pairs that convert and the realms are tables, joined; ``order`` is the hierarchy of the project's classes.

    Each pair of types is judged once, whatever the number of rows that have it, since few pairs may have most rows. Those that
    have more than one row of ``FREQUENT`` are sent to all tasks, fewer than ``FREQUENT`` of them; only rows of the others are dealt by pair.
    """
    places = written(places)
    counted = places.where("arg is not null and param is not null").groupBy("arg", "param").agg(F.count("*").alias("_rows"))
    pairs = written(_judged(counted, order).select("arg", "param", "_rows", "fits"))
    total = pairs.agg(F.sum("_rows")).first()[0] or 0
    often = F.col("_rows") > total / FREQUENT
    frequent, others = F.broadcast(pairs.where(often).drop("_rows")), pairs.where(~often).drop("_rows").hint("merge")
    found = places.join(frequent, ["arg", "param"]).unionByName(places.join(frequent, ["arg", "param"], "left_anti").join(others, ["arg", "param"]))
    return found.unionByName(places.where("arg is null or param is null").withColumn("fits", F.lit(True)))


def _judged(places: DataFrame, order: DataFrame) -> DataFrame:
    base = lambda c: F.regexp_replace(c, r"(\[\])+$", "")
    rows = places.withColumns({"_arg": base(F.col("arg")), "_param": base(F.col("param"))})
    converts = _conversions(order).select(F.col("arg").alias("_arg"), F.col("param").alias("_param"), F.lit(True).alias("_converts")).distinct()
    realms = _realms(order)
    rows = rows.join(converts, ["_arg", "_param"], "left")
    for side in ("arg", "param"):
        rows = rows.join(realms.select(F.col("type").alias(f"_{side}"), F.col("realm").alias(f"_{side}_realm")), f"_{side}", "left")
    closed = F.create_map(*[x for realm, others in _MISFITS.items() for x in (F.lit(realm), F.array(*map(F.lit, others)))])
    never = F.array_contains(F.try_element_at(closed, F.coalesce("_arg_realm", F.lit("library"))), F.coalesce("_param_realm", F.lit("library")))
    level = F.length("arg") - F.length("_arg") == F.length("param") - F.length("_param")
    passes = F.when(F.col("arg") == "null", ~F.col("param").isin(PRIMITIVES)).otherwise((F.col("param") == "java.lang.Object") | (level & ((F.col("_arg") == F.col("_param")) | F.col("_converts").isNotNull() | ~never)))
    return rows.withColumn("fits", passes | F.col("arg").isNull() | F.col("param").isNull()).withColumn("fits", F.coalesce("fits", F.lit(True))).drop("_arg", "_param", "_converts", "_arg_realm", "_param_realm")


def overloads(calls: DataFrame, candidates: DataFrame, order: DataFrame) -> DataFrame:
    """Which of its candidate methods each call means: call_id, status, reason, targets.

    ``calls`` has call_id and args, types with null for unknown ones; ``candidates`` call_id, method_id, params and var_args.
    Candidates of a wrong number of parameters drop out; then those that an argument is sure not to fit, unless that leaves
    none; then those of a variable number, if others are left; and if all arguments are known and just one of several has
    just those types, it is meant. A trailing variable parameter stands for any number of its elements, or for the array.
    """
    n = F.size("args")
    joined = calls.select("call_id", "args").join(candidates, "call_id", "left").withColumn("_fixed", F.size("params") == n)
    able = F.coalesce(F.col("_fixed") | (F.col("var_args") & (n >= F.size("params") - 1)), F.lit(False))
    last = F.element_at("params", -1)
    element = F.regexp_replace(last, r"\[\]$", "")
    filled = F.concat(F.slice("params", F.lit(1), F.size("params") - 1), F.array_repeat(F.when(~F.col("_fixed"), element), n - F.size("params") + 1))
    joined = joined.withColumns({"able": able, "_params": F.when(able & F.col("var_args"), filled).otherwise(F.col("params"))})
    places = joined.where("able").select("call_id", "method_id", F.explode(F.arrays_zip(F.col("args").alias("arg"), F.col("_params").alias("param"))).alias("x")).select("call_id", "method_id", "x.arg", "x.param")
    fits = assignable(places, order).groupBy("call_id", "method_id").agg(F.bool_and("fits").alias("fits"))
    exact = F.forall("args", lambda a: a.isNotNull() & (a != "null")) & (n > 0) & (F.col("args") == F.col("params"))
    plain = ~F.coalesce("var_args", F.lit(False)) | F.coalesce("_fixed", F.lit(False))
    judged = joined.join(fits, ["call_id", "method_id"], "left")
    # What fits outranks what does not, then a fixed number of parameters a variable one; the best rank is what is left.
    rank = F.when(F.col("able"), F.coalesce(F.col("fits"), F.lit(True)).cast("int") * 2 + plain.cast("int"))
    ranked = judged.select("call_id", "method_id", F.col("able").alias("able"), rank.alias("rank"), F.coalesce(exact, F.lit(False)).alias("exact"))
    best = ranked.groupBy("call_id").agg(F.max("rank").alias("best"), F.count("method_id").alias("n"))
    top = ranked.join(best, "call_id")
    kept = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("method_id"))))
    meant = F.coalesce(F.col("rank") == F.col("best"), F.lit(False))
    sets = top.groupBy("call_id", "n").agg(kept(meant).alias("left"), kept(meant & F.col("exact")).alias("same"))
    sets = sets.withColumn("targets", F.when(F.size("same") == 1, F.col("same")).otherwise(F.col("left")))
    found = F.size("targets")
    status = F.when(found == 1, "resolved").when(found > 1, "ambiguous").otherwise("unresolved")
    reason = F.when(found > 1, "overload_not_disambiguated").when((found == 0) & (F.col("n") > 0), "no_matching_arity").when(found == 0, "unknown_method")
    return sets.select("call_id", status.alias("status"), reason.alias("reason"), "targets")
