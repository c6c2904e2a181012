"""Resolution of expressions, a layer of receivers at a time: names, fields, calls, constructors and method references."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators import codemodel
from ferrule.operators.relational import ladder
from ferrule.sources.tables import measured_joins, written

# What every class inherits from the language, and types of well-known static fields outside the project.
OBJECT_METHODS = ["equals", "hashCode", "toString", "getClass", "notify", "notifyAll", "wait", "clone", "finalize"]
STATIC_FIELDS = {"java.lang.System.out": "java.io.PrintStream", "java.lang.System.err": "java.io.PrintStream", "java.lang.System.in": "java.io.InputStream"}

#: What is known of a type: status is resolved, ambiguous or unresolved; kind is class, primitive, null, type_variable, wildcard or union.
_TYPE = {"status": "string", "kind": "string", "origin": "string", "fqn": "string", "dims": "int", "reason": "string", "candidates": "array<string>"}
TYPE = f"struct<{','.join(f'{k}:{v}' for k, v in _TYPE.items())}>"
#: What becomes of an expression.
_OUTCOME = {"kind": "string", "status": "string", "origin": "string", "owner": "string", "symbol": "string", "reason": "string", "candidates": "array<string>", "type": TYPE}
OUTCOME = f"struct<{','.join(f'{k}:{v}' for k, v in _OUTCOME.items())}>"
_RESULT = ["expr", "outcome", "name", "chain"]
#: Rows up to which answers are broadcast.
FEW = 20_000


def _packed(schema: dict[str, str], **parts: Column | str | None) -> Column:
    """A struct of ``schema``, null in the fields that ``parts`` lacks; strings are literals."""
    column = {k: F.lit(v) if isinstance(v, str) else v for k, v in parts.items()}
    return F.struct(*[(column[k] if column.get(k) is not None else F.lit(None).cast(kind)).alias(k) for k, kind in schema.items()])


def _none() -> Column:
    return F.array().cast("array<string>")


def _known(fqn: Column, origin: str, kind: str = "class") -> Column:
    return _packed(_TYPE, status="resolved", kind=kind, origin=origin, fqn=fqn, dims=F.lit(0), candidates=_none())


def _literal(name: Column) -> Column:
    """The type of a literal by its name: primitive, the null literal, or a class of the language."""
    null = _packed(_TYPE, status="resolved", kind="null", candidates=_none(), dims=F.lit(0))
    return F.when(name == "null", null).when(name.isin(codemodel.PRIMITIVES), _known(name, "primitive", "primitive")).when(name.isNotNull(), _known(F.concat(F.lit("java.lang."), name), "external"))


def _text(t: Column) -> Column:
    """A type as overloads compare them, null if it is not known."""
    sure = (t["status"] == "resolved") & t["kind"].isin("class", "primitive")
    return F.when(t["kind"] == "null", "null").when(sure, F.concat(t["fqn"], F.repeat(F.lit("[]"), F.coalesce(t["dims"], F.lit(0)))))


def _outcome(kind: Column | str, status: Column | str, **parts: Column | str | None) -> Column:
    return _packed(_OUTCOME, kind=kind, status=status, **({"candidates": _none()} | parts))


def enclosing(types: DataFrame) -> DataFrame:
    """Each class with the classes around it: (cls, scope, depth), itself at depth 0. ``types`` has cls and outer."""
    up = written(types.where("outer is not null").select(F.col("cls").alias("scope"), "outer"))
    front = types.select("cls", F.col("cls").alias("scope"), F.lit(0).alias("depth"))
    found = front
    while True:
        front = front.join(up, "scope").where("outer <> cls").select("cls", F.col("outer").alias("scope"), (F.col("depth") + 1).alias("depth"))
        front = written(front)
        if front.isEmpty():
            return found
        found = found.unionByName(front)


class Model:
    """What is known of the classes of a project, each table joined with the types that its texts mean, once for all layers."""

    def __init__(self, types: DataFrame, fields: DataFrame, methods: DataFrame, names: DataFrame, imports: DataFrame) -> None:
        self.order = written(codemodel.hierarchy(types))
        self.scopes = written(enclosing(types))
        self.imports = imports
        self.names = written(names.select("cls", "text", F.struct("status", "kind", "origin", "fqn", "dims", "reason", "candidates").cast(TYPE).alias("type")).dropDuplicates(["cls", "text"]))
        self.types = types.select("cls", "outer", F.col("kind").alias("class_kind"), F.coalesce("generated", F.lit(False)).alias("generated"))
        marks = self.order.join(self.types.select(F.col("cls").alias("ancestor"), "generated"), "ancestor", "left")
        outside = F.transform(F.array_sort(F.collect_list(F.when(~F.col("known"), F.struct("ord", "ancestor")))), lambda x: x["ancestor"])
        self.flags = written(marks.groupBy("cls").agg(outside.alias("outside"), F.coalesce(F.bool_or("generated"), F.lit(False)).alias("generated")))
        typed = self.means(fields.select("cls", "name", "field_id", "type", "is_static", F.lit("field").alias("kind") if "kind" not in fields.columns else "kind"), "cls", "type")
        self.fields = written(typed.withColumn("declared", F.coalesce("meant", _packed(_TYPE, status="unresolved", kind="class", reason="unknown_type", candidates=_none()))).drop("meant", "type"))
        owned = self.fields.withColumnRenamed("cls", "ancestor")
        self.inherited = written(self.order.join(owned, "ancestor").select("cls", "name", "ord", F.col("ancestor").alias("owner"), "field_id", "kind", "is_static", "declared"))
        returned = self.means(methods.where("returns is not null and returns <> 'void'").select("method_id", "cls", "returns"), "cls", "returns").select("method_id", F.col("meant").alias("returned"))
        places = self.means(methods.select("method_id", "cls", F.posexplode("params").alias("pos", "param")), "cls", "param")
        params = F.transform(F.array_sort(F.collect_list(F.struct("pos", _text(F.col("meant")).alias("t")))), lambda x: x["t"])
        fitted = methods.join(places.groupBy("method_id").agg(params.alias("fitted")), "method_id", "left").join(returned, "method_id", "left")
        facts = fitted.select("method_id", F.col("cls").alias("owner"), F.coalesce("fitted", _none()).alias("fitted"), F.coalesce("var_args", F.lit(False)).alias("var_args"), F.coalesce("is_static", F.lit(False)).alias("is_static"), "returned")
        self.methods = written(facts)
        erased = F.transform("params", lambda p: F.regexp_replace(p, "<.*>", ""))
        plain = methods.where("kind <> 'constructor'").withColumn("params", erased)
        self.members = written(codemodel.members(plain, self.order).select("cls", "name", "method_id", "ord"))
        self.constructors = methods.where("kind = 'constructor'").select("cls", "method_id")
        packages = types.where("outer is null").select(F.expr("slice(split(cls, '[.]'), 1, size(split(cls, '[.]')) - 1)").alias("p")).where("size(p) > 0")
        self.packages = written(packages.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", F.lit(1), k), "."))).alias("package")).distinct())

    def means(self, df: DataFrame, cls: str, text: str) -> DataFrame:
        """``df`` with ``meant``, the type that the text in column ``text`` means within the class in column ``cls``; null if nothing is known."""
        names = self.names.select(F.col("cls").alias("_cls"), F.col("text").alias("_text"), F.col("type").alias("meant"))
        return df.join(names, (F.col(cls) == F.col("_cls")) & (F.col(text) == F.col("_text")), "left").drop("_cls", "_text")


def bindings(uses: DataFrame, variables: DataFrame, model: Model) -> DataFrame:
    """The variables that names mean: expr, outcome, init (the expression that an inferred type comes from).

    ``uses`` has expr, method, cls, name, line and in_local; names that mean no variable are left out. Branches by priority:
    the innermost local whose lines hold the use; a parameter; the nearest field of the nearest enclosing class that has one;
    a static import of that name; static imports on demand; a field that an ancestor outside the project may have.
    """
    declared = model.means(variables, "cls", "type")
    literal, given = _literal(F.when(F.col("init.kind") == "literal", F.col("init.value"))), F.col("init.kind") == "type"
    declared = model.means(declared.withColumnRenamed("meant", "declared").withColumn("_made", F.when(given, F.col("init.value"))), "cls", "_made")
    inferred = F.col("type").isNull() | (F.col("type") == "var")
    own = F.when(~inferred, F.coalesce("declared", _packed(_TYPE, status="unresolved", kind="class", reason="unknown_type", candidates=_none())))
    declared = declared.select("method", F.col("name").alias("_name"), F.col("kind").alias("_kind"), "start", "end", F.coalesce(own, literal, F.col("meant")).alias("type"), F.when(inferred & (F.col("init.kind") == "expr"), F.col("init.value")).alias("init"))
    local = uses.join(declared.withColumnRenamed("method", "_method"), (F.col("method") == F.col("_method")) & (F.col("name") == F.col("_name")))
    param = F.col("_kind") == "parameter"
    local = local.where(param | F.col("line").between(F.col("start"), F.col("end")))
    symbol = F.concat("method", F.lit("$"), "name", F.when(param, "").otherwise(F.concat(F.lit("@"), F.col("start").cast("string"))))
    first = F.struct(param.cast("int"), -F.col("start"), "symbol")
    local = local.withColumn("symbol", symbol).groupBy("expr").agg(F.min_by(F.struct("_kind", "symbol", "type", "init"), first).alias("v"))
    local = local.select("expr", _outcome(F.col("v._kind"), "resolved", origin="local", symbol=F.col("v.symbol"), type=F.col("v.type")).alias("outcome"), "v.init")

    def field(v: str, status: Column | str = "resolved", **parts: Column | str) -> Column:
        return _outcome(F.col(f"{v}.kind"), status, **({"origin": "project", "owner": F.col(f"{v}.owner"), "symbol": F.col(f"{v}.field_id"), "type": F.col(f"{v}.declared")} | parts))

    facts = F.struct("kind", "owner", "field_id", "declared")
    scoped = uses.select("expr", F.col("cls").alias("_cls"), "name", "in_local").join(model.scopes.select(F.col("cls").alias("_cls"), F.col("scope").alias("cls"), "depth"), "_cls")
    held = scoped.join(model.inherited, ["cls", "name"]).groupBy("expr", "in_local").agg(F.min_by(facts, F.struct("depth", "ord", "field_id")).alias("v"))
    doubt = F.col("in_local")
    held = held.select("expr", F.when(doubt, field("v", "ambiguous", reason="possible_local_class_member", candidates=F.array("v.field_id"))).otherwise(field("v")).alias("outcome"))

    imports = uses.select("expr", "cls", "name").join(model.imports.select("cls", F.col("name").alias("_import"), "owner"), "cls")
    at = model.fields.select(F.col("cls").alias("owner"), "name", F.struct("kind", F.col("cls").alias("owner"), "field_id", "declared").alias("v"), "is_static")
    ours = model.types.select(F.col("cls").alias("owner"), F.lit(True).alias("ours"))
    single = imports.where("_import = name").join(at.drop("is_static"), ["owner", "name"], "left").join(ours, "owner", "left")
    elsewhere = _outcome("static_import", "resolved", origin=F.when(F.col("ours"), "project").otherwise("external"), owner=F.col("owner"))
    single = single.select("expr", "owner", F.when(F.col("v").isNotNull(), field("v")).otherwise(elsewhere).alias("outcome"))
    single = single.groupBy("expr").agg(F.min_by("outcome", "owner").alias("outcome"))
    wide = imports.where("_import is null").join(at.where("is_static"), ["owner", "name"]).groupBy("expr").agg(F.min_by("v", "v.field_id").alias("v"), F.array_sort(F.collect_set("v.field_id")).alias("ids"))
    several = _outcome("static_import", "ambiguous", origin="project", candidates=F.col("ids"), reason="multiple_static_imports")
    wide = wide.select("expr", F.when(F.size("ids") > 1, several).otherwise(field("v")).alias("outcome"))
    dark = scoped.join(model.flags, "cls").groupBy("expr").agg(F.bool_or(F.size("outside") > 0).alias("open"), F.bool_or("generated").alias("generated")).where("open")
    reason = F.when(F.col("generated"), "possible_lombok_generated").otherwise("possible_inherited_external_field")
    dark = dark.select("expr", _outcome("field", "unresolved", reason=reason).alias("outcome"))
    others = [b.withColumn("init", F.lit(None).cast("string")) for b in (held, single, wide, dark)]
    return ladder([local, *others], "expr").select("expr", "outcome", "init")


class Found:
    """What has been found out: results that each have their outcome, and those that share ``answers``, which many of them have."""

    def __init__(self) -> None:
        self.own: list[DataFrame] = []
        self.shared: list[tuple[DataFrame, DataFrame]] = []

    def results(self, like: DataFrame) -> DataFrame:
        """Every result with its outcome: expr, outcome, name, chain; ``like`` has an expr and a name."""
        each = [shared.join(_few(answers), "answer").select("expr", "outcome", "name", _none().alias("chain")) for shared, answers in self.shared]
        empty = like.where("false").select("expr", F.lit(None).cast(OUTCOME).alias("outcome"), "name", _none().alias("chain"))
        return reduce(DataFrame.unionByName, [*self.own, *each] or [empty])

    def receivers(self, like: DataFrame) -> DataFrame:
        """What expressions on a receiver need of it: receiver, r or answer, base, links."""
        r = F.struct(*[F.col(f"outcome.{k}").alias(k) for k in ("kind", "reason", "type")])
        no = F.lit(None).cast("string")
        own = [df.select(F.col("expr").alias("receiver"), r.alias("r"), no.alias("answer"), F.col("name").alias("base"), F.col("chain").alias("links")) for df in self.own or [Found().results(like)]]
        none = F.lit(None).cast(f"struct<kind:string,reason:string,type:{TYPE}>")
        return reduce(DataFrame.unionByName, [*own, *[df.select(F.col("expr").alias("receiver"), none.alias("r"), "answer", F.col("name").alias("base"), _none().alias("links")) for df, _ in self.shared]])

    def answered(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``r`` filled from ``answer``."""
        if not self.shared:
            return rows
        all_ = reduce(DataFrame.unionByName, [answers.select("answer", F.struct("outcome.kind", "outcome.reason", "outcome.type").alias("_r")) for _, answers in self.shared])
        return rows.join(all_, "answer", "left").withColumn("r", F.coalesce("r", "_r")).drop("_r")


def _few(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def _with_receivers(ready: DataFrame, found: Found, model: Model) -> DataFrame:
    """Add what is needed of receivers: ``r`` or ``answer``, ``base``, ``links``, and ``meant``, the type of a cast."""
    casts = ready.where("receiver_kind = 'cast'")
    meant = F.lit(None).cast(TYPE)
    ready = ready.withColumn("meant", meant) if casts.isEmpty() else model.means(ready, "cls", "type")
    held = ready.where("receiver_kind = 'expr'").join(found.receivers(ready), "receiver", "left")
    return ready.where("receiver_kind <> 'expr'").unionByName(held, allowMissingColumns=True)


def _judged(joined: DataFrame, found: Found) -> DataFrame:
    """Add what receivers are: ``on``, the type that a member is looked up in, ``typed`` (on is a type's name), ``package``, and ``why``."""
    joined = found.answered(joined)
    by = F.col("receiver_kind")
    on = F.when(by.isin("this", "super"), _known(F.col("cls"), "project")).when(by == "literal", _literal(F.col("type"))).when(by == "cast", F.col("meant")).when(by == "expr", F.col("r.type"))
    package = (by == "expr") & F.col("r.kind").isin("package", "package_candidate")
    unknown = F.when(by.isin("expr"), F.concat_ws(":", F.lit("receiver_type_unknown"), F.when(~F.col("r.reason").startswith("receiver_type_unknown"), F.col("r.reason")))).otherwise("receiver_not_analyzed")
    cast = F.when(by == "cast", _packed(_TYPE, status="unresolved", kind="class", reason="unknown_type", candidates=_none()))
    joined = joined.withColumns({"on": F.coalesce(on, cast), "typed": (by == "expr") & F.coalesce(F.col("r.kind") == "type", F.lit(False)), "package": F.coalesce(package, F.lit(False)), "why": unknown})
    return joined.drop("r", "meant")


def _question(*more: Column | str) -> Column:
    """All that the outcome of an expression on a receiver hangs on; what the receiver does not ask for is null."""
    by = F.col("receiver_kind")
    cls = F.when(by.isin("this", "super", "none"), F.col("cls")).alias("cls")
    return F.struct("name", "receiver_kind", cls, F.when(by == "literal", F.col("type")).alias("type"), F.when(by == "cast", F.col("meant")).alias("meant"), "r", "answer", *more)


def _literal_text(name: Column) -> Column:
    """The type of a literal, or of a class literal, as overloads compare it."""
    return F.when(name.isin("null", *codemodel.PRIMITIVES), name).when(name.isNotNull(), F.concat(F.lit("java.lang."), name))


def _plain(args: Column) -> Column:
    """The types of arguments that are literals or ``this``, as texts: nothing is joined for them."""
    return F.transform(args, lambda a: F.when(a["kind"] == "literal", _literal_text(a["value"])).when(a["kind"] == "this", F.col("cls")))


def _arguments(calls: DataFrame, results: DataFrame, model: Model) -> DataFrame:
    """(expr, given): the types of a call's arguments as texts, null where unknown."""
    places = calls.select("expr", "cls", F.posexplode("args").alias("pos", "arg")).select("expr", "cls", "pos", "arg.kind", F.col("arg.value").alias("value"), F.when(F.col("arg.kind") == "type", F.col("arg.value")).alias("_made"))
    asked = written(places.where("kind = 'expr'").select(F.col("value").alias("_value")).distinct())
    found = written(results.select(F.col("expr").alias("_value"), F.col("outcome.type").alias("r")).join(_few(asked), "_value", "left_semi"))
    places = model.means(places, "cls", "_made").join(_few(found), (F.col("value") == F.col("_value")) & (F.col("kind") == "expr"), "left")
    kind = F.col("kind")
    t = F.when(kind == "literal", _literal_text(F.col("value"))).when(kind == "type", _text(F.col("meant"))).when(kind == "this", F.col("cls")).when(kind == "expr", _text(F.col("r")))
    return places.withColumn("t", t).groupBy("expr").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("given"))


def _chosen(calls: DataFrame, candidates: DataFrame, model: Model) -> DataFrame:
    """What overloads leave: expr, status, reason, targets, every (all candidates), and the owner and type of what is meant."""
    facts = candidates.join(model.methods, "method_id")
    rows = facts.select(F.col("expr").alias("call_id"), "method_id", F.col("fitted").alias("params"), "var_args")
    asked = calls.join(candidates.select("expr").distinct(), "expr", "left_semi").select(F.col("expr").alias("call_id"), F.col("given").alias("args"))
    left = codemodel.overloads(asked, rows, model.order).withColumnRenamed("call_id", "expr")
    every = candidates.groupBy("expr").agg(F.array_sort(F.collect_set("method_id")).alias("every"))
    meant = left.select("expr", F.explode("targets").alias("method_id")).join(model.methods, "method_id").groupBy("expr")
    one = F.size(F.collect_set(F.coalesce("returned.fqn", F.lit("")))) == 1
    meant = meant.agg(F.min("owner").alias("owner"), F.when(one, F.first("returned", ignorenulls=True)).alias("returned"))
    return left.join(every, "expr").join(meant, "expr", "left")


def _verdict(kind: str, field: bool) -> Column:
    """The outcome on a receiver type in which nothing can be looked up, or that is outside the project; null if its class is to be asked."""
    on = F.col("on")
    missing = F.when(F.col("package"), "package_not_callable").otherwise("receiver_type_unknown" if field else F.col("why"))
    missing = F.when(F.col("receiver_kind").isin("this", "super", "literal", "cast", "expr"), missing).otherwise("receiver_not_analyzed")
    unresolved = F.lit("receiver_type_unresolved") if field else F.concat_ws(":", F.lit("receiver_type_unresolved"), on["reason"])
    doubt = F.when((on["status"] == "ambiguous") & F.lit(not field), "receiver_type_ambiguous").otherwise(unresolved)
    array = on["dims"] > 0
    away = _outcome("external_member" if field else kind, "resolved", origin="external", owner=on["fqn"])
    if field:
        static = F.try_element_at(F.create_map(*[F.lit(x) for pair in STATIC_FIELDS.items() for x in pair]), F.concat_ws(".", on["fqn"], "name"))
        away = _outcome("external_member", "resolved", origin="external", owner=on["fqn"], type=F.when(static.isNotNull(), _known(static, "external")))
    has_length = F.lit(not field) | (F.col("name") == "length")
    held = F.when(array & has_length, _outcome("external_member" if field else kind, "resolved", origin="external", owner="array"))
    plain = on["kind"].isin("type_variable", "union", "wildcard", "primitive", "null") | array
    return (
        F.when(on.isNull(), _outcome(kind, "unresolved", reason=missing))
        .when(on["status"] != "resolved", _outcome(kind, on["status"], reason=doubt, candidates=on["candidates"]))
        .otherwise(F.coalesce(held, F.when(plain, _outcome(kind, "unresolved", reason=F.concat(on["kind"], F.lit("_receiver")))).when(on["origin"] == "external", away)))
    )


def _fallback(kind: str, generated: Column, outside: Column, member: str) -> Column:
    """What a member may be that no class of the project has."""
    inherited = _outcome("method" if member == "method" else kind, "resolved", origin="external", owner="java.lang.Object")
    return (
        F.when(F.lit(member == "method") & F.col("name").isin(OBJECT_METHODS), inherited)
        .when((F.size(outside) > 0) & F.lit(member == "field"), _outcome(kind, "unresolved", reason="possible_inherited_external_field", candidates=outside))
        .when(generated, _outcome(kind, "unresolved", reason="possible_lombok_generated"))
        .when(F.size(outside) > 0, _outcome(kind, "unresolved", reason=f"possible_inherited_external_{member}", candidates=outside))
        .otherwise(_outcome(kind, "unresolved", reason=f"no_such_{member}"))
    )


def _result(df: DataFrame, outcome: Column, name: Column | None = None, chain: Column | None = None) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.select("expr", outcome.alias("outcome"), (F.col("name") if name is None else name).alias("name"), (empty if chain is None else chain).alias("chain"))


def _once(rows: DataFrame, question: Column, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What ``ask`` finds out for ``rows``, whose outcome hangs on the fields of ``question`` alone: (expr, name, answer), and (answer, outcome).

    Each question is asked for one of its rows, and all take the answer. Of a project's many expressions most ask the same as others.
    """
    rows = written(rows.select("expr", "name", question.alias("question")))
    asked = written(rows.groupBy("question").agg(F.min("expr").alias("expr")))
    found = written(ask(asked.select("expr", "question.*")).select("expr", "outcome"))
    number = F.concat(F.lit(f"{uuid.uuid4().hex[:8]}."), F.monotonically_increasing_id().cast("string"))
    answers = written(found.select("outcome").distinct().select("outcome", number.alias("answer")))
    taken = written(asked.join(found, "expr").join(_few(answers), "outcome").select("question", "answer"))
    return written(rows.join(_few(taken), "question").select("expr", "name", "answer")), answers


def _names(ready: DataFrame, bound: DataFrame, results: DataFrame, model: Model, prefixes: DataFrame) -> DataFrame:
    """Names: variables, then types, then what a longer name may start with."""
    inits = results.select(F.col("expr").alias("init"), F.col("outcome.type").alias("inferred"))
    rows = model.means(ready.drop("type").join(bound, "expr", "left").join(inits, "init", "left"), "cls", "name").join(prefixes, "expr", "left")
    variable = F.col("outcome").withField("type", F.coalesce("outcome.type", "inferred"))
    t = F.col("meant")
    named = t.isNotNull() & ((t["status"] != "unresolved") | (F.col("name").rlike("^[A-Z]") & (F.size(t["candidates"]) > 0)))
    type_ = _outcome("type", t["status"], origin=t["origin"], owner=t["fqn"], reason=t["reason"], candidates=t["candidates"], type=t)
    first = F.coalesce("prefix", F.lit(False))
    other = F.when(first, _outcome("package_candidate", "unresolved", reason="possible_package_prefix")).otherwise(_outcome("name", "unresolved", reason="unknown_name"))
    outcome = F.when(F.col("outcome").isNotNull(), variable).when(named, type_).otherwise(other)
    return _result(rows, outcome, chain=F.array("expr"))


def _segments(ready: DataFrame, model: Model) -> DataFrame:
    """Segments of qualified names: accesses of what may be a package."""
    dotted = F.concat_ws(".", "base", "name")
    whole = model.types.select(F.col("cls").alias("dotted"), F.lit(True).alias("ours"))
    segment = ready.withColumn("dotted", dotted).join(whole, "dotted", "left").join(model.packages.select(F.col("package").alias("dotted"), F.lit(True).alias("prefix")), "dotted", "left")
    t = F.when(F.col("ours"), _known(F.col("dotted"), "project")).when(F.col("name").rlike(r"^\p{Lu}"), _known(F.col("dotted"), "external"))
    step = F.when(F.col("prefix"), _outcome("package", "resolved", origin="project")).otherwise(_outcome("package_candidate", "unresolved", reason="possible_package_prefix"))
    outcome = F.when(t.isNotNull(), _outcome("type", "resolved", origin=t["origin"], owner=t["fqn"], type=t)).otherwise(step)
    return _result(segment, outcome, name=F.col("dotted"), chain=F.concat("links", F.array("expr")))


def _fields(ready: DataFrame, model: Model) -> DataFrame:
    """Fields and member types of what receivers are."""
    rows = ready.withColumn("outcome", _verdict("field", True))
    asked = rows.where("outcome is null").drop("outcome").withColumn("at", F.col("on.fqn"))
    facts = model.inherited.select(F.col("cls").alias("at"), "name", "ord", F.struct("kind", "owner", "field_id", "declared").alias("v"))
    found = asked.select("expr", "name", "at", "receiver_kind").join(facts, ["at", "name"]).where("receiver_kind <> 'super' or ord > 0")
    found = found.groupBy("expr").agg(F.min_by("v", F.struct("ord", "v.field_id")).alias("v"))
    nested = model.types.where("outer is not null").select(F.col("outer").alias("at"), F.element_at(F.split("cls", r"\."), -1).alias("name"), F.col("cls").alias("member"))
    asked = asked.join(found, "expr", "left").join(nested, ["at", "name"], "left").join(model.flags.select(F.col("cls").alias("at"), "outside", "generated"), "at", "left")
    field = _outcome(F.col("v.kind"), "resolved", origin="project", owner=F.col("v.owner"), symbol=F.col("v.field_id"), type=F.col("v.declared"))
    member = _known(F.col("member"), "project")
    outcome = (
        F.when(F.col("v").isNotNull(), field)
        .when(F.col("typed") & F.col("member").isNotNull(), _outcome("type", "resolved", origin="project", owner=F.col("member"), type=member))
        .when(F.col("generated").isNull(), _outcome("field", "unresolved", reason="receiver_class_unavailable"))
        .otherwise(_fallback("field", F.col("generated"), F.col("outside"), "field"))
    )
    return _result(rows.where("outcome is not null"), F.col("outcome")).unionByName(_result(asked, outcome))


def _calls(ready: DataFrame, model: Model) -> DataFrame:
    """Calls: on the enclosing classes from within, or in the class of the receiver; then static imports; then what may be outside."""
    alone = F.col("receiver_kind") == "none"
    rows = ready.withColumn("outcome", F.when(~alone, _verdict("method", False)))
    asked = rows.where("outcome is null").drop("outcome").withColumn("at", F.col("on.fqn"))
    around = asked.where(alone).select("expr", "name", "receiver_kind", "cls").join(model.scopes, "cls").select("expr", "name", "receiver_kind", F.col("scope").alias("at"), "depth")
    starts = around.unionByName(asked.where(~alone).select("expr", "name", "receiver_kind", "at", F.lit(0).alias("depth")))
    members = model.members.select(F.col("cls").alias("at"), "name", "method_id", "ord")
    inside = starts.join(members, ["at", "name"]).where("receiver_kind <> 'super' or ord > 0").select("expr", "depth", "method_id")
    imported = asked.where(alone).select("expr", "cls", "name").join(model.imports.select("cls", F.col("name").alias("_import"), F.col("owner").alias("at")), "cls")
    static = imported.where("_import is null or _import = name").join(members.drop("ord"), ["at", "name"]).join(model.methods.select("method_id", "is_static"), "method_id")
    # Beyond any depth of classes: imports of the name, then those on demand.
    static = static.where("_import is null or is_static").select("expr", F.when(F.col("_import").isNotNull(), 1 << 20).otherwise(1 << 21).alias("depth"), "method_id")
    candidates = inside.unionByName(static).withColumn("_least", F.min("depth").over(Window.partitionBy("expr"))).where("depth = _least").select("expr", "depth", "method_id")
    # A single import, whatever becomes of it, stands before imports on demand.
    owners = imported.where("_import = name").join(model.types.select(F.col("cls").alias("at"), F.lit(True).alias("ours")), "at", "left").groupBy("expr").agg(F.array_sort(F.collect_set("at")).alias("owners"), F.bool_or("ours").alias("ours"))
    far = imported.where("_import is null").join(model.types.select(F.col("cls").alias("at")), "at", "left_anti").groupBy("expr").agg(F.array_sort(F.collect_set("at")).alias("far"))
    candidates = written(candidates.join(owners.select("expr", F.lit(True).alias("named")), "expr", "left").where(f"depth <= {1 << 20} or named is null").select("expr", "method_id", "depth"))
    chosen = _chosen(asked, candidates.select("expr", "method_id"), model).withColumnRenamed("status", "ended").withColumnRenamed("reason", "because")
    layer = candidates.groupBy("expr").agg(F.min("depth").alias("layer"))
    marks = starts.join(model.flags.select(F.col("cls").alias("at"), "outside", "generated"), "at").groupBy("expr").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("depth", "outside"))), lambda x: x["outside"]))).alias("outside"), F.bool_or("generated").alias("generated"))
    asked = asked.join(chosen, "expr", "left").join(layer, "expr", "left").join(marks, "expr", "left").join(owners, "expr", "left").join(far, "expr", "left")
    local = F.col("in_local") & alone
    doubt = local & (F.col("layer") < 1 << 20)
    symbol = F.col("targets")[0]
    one = F.when(doubt, _outcome("method", "ambiguous", origin="project", owner=F.col("owner"), symbol=symbol, reason="possible_local_class_member", candidates=F.array(symbol), type=F.col("returned")))
    one = one.otherwise(_outcome("method", "resolved", origin="project", owner=F.col("owner"), symbol=symbol, type=F.col("returned")))
    several = _outcome("method", "ambiguous", origin="project", reason=F.col("because"), candidates=F.col("targets"), type=F.col("returned"))
    named = F.when((F.size("owners") == 1) & F.col("ours").isNull(), _outcome("method", "resolved", origin="external", owner=F.col("owners")[0])).otherwise(_outcome("method", "ambiguous", reason="multiple_static_imports", candidates=F.col("owners")))
    known = F.col("name").isin(OBJECT_METHODS)
    open_ = F.when(local & ~known, _outcome("method", "unresolved", reason="possible_local_class_member")).when(F.col("far").isNotNull() & ~known, _outcome("method", "unresolved", reason="static_wildcard_external", candidates=F.col("far")))
    outcome = (
        F.when(F.col("ended") == "resolved", one)
        .when(F.col("ended") == "ambiguous", several)
        .when(F.col("ended").isNotNull(), _outcome("method", "unresolved", reason="no_matching_arity", candidates=F.col("every")))
        .when(F.col("owners").isNotNull(), named)
        .when(F.col("generated").isNull(), _outcome("method", "unresolved", reason="receiver_class_unavailable"))
        .otherwise(F.coalesce(open_, _fallback("method", F.col("generated"), F.col("outside"), "method")))
    )
    return _result(rows.where("outcome is not null"), F.col("outcome")).unionByName(_result(asked, outcome))


def _creations(ready: DataFrame, model: Model) -> DataFrame:
    """Objects that are made: of a class outside, of an interface in place, or by one of the class's constructors."""
    rows = model.means(ready, "cls", "type")
    t = F.coalesce("meant", _packed(_TYPE, status="unresolved", kind="class", reason="unknown_type", candidates=_none()))
    rows = rows.withColumn("meant", t).join(model.types.select(F.col("cls").alias("at"), "class_kind"), F.col("meant.fqn") == F.col("at"), "left")
    candidates = rows.select("expr", F.col("at").alias("cls")).join(model.constructors, "cls").select("expr", "method_id")
    chosen = _chosen(rows, candidates, model).withColumnRenamed("status", "ended").withColumnRenamed("reason", "because")
    rows = rows.join(chosen, "expr", "left").join(model.flags.select(F.col("cls").alias("at"), "generated"), "at", "left")
    t, every = F.col("meant"), F.coalesce("every", _none())
    made = lambda status, **parts: _outcome("constructor", status, **({"type": t} | parts))
    outcome = (
        F.when(t["status"] != "resolved", _outcome("constructor", t["status"], reason=t["reason"], candidates=t["candidates"]))
        .when(t["origin"] == "external", made("resolved", origin="external", owner=t["fqn"]))
        .when(F.col("class_kind").isNull(), made("unresolved", reason="class_unavailable"))
        .when(F.col("class_kind").isin("interface", "annotation"), made("resolved", origin="project", owner=t["fqn"], reason="anonymous_implementation"))
        .when(F.col("ended") == "resolved", made("resolved", origin="project", owner=F.col("owner"), symbol=F.col("targets")[0]))
        .when(F.col("ended") == "ambiguous", made("ambiguous", origin="project", reason=F.col("because"), candidates=F.col("targets")))
        .otherwise(made("unresolved", reason=F.when(F.col("generated"), "possible_lombok_generated").otherwise("no_matching_constructor"), candidates=every))
    )
    return _result(rows, outcome)


def _references(ready: DataFrame, bound: DataFrame, results: DataFrame, model: Model) -> DataFrame:
    """Method references: on this, on a variable, or on a type; ``new`` means the constructors."""
    inits = results.select(F.col("expr").alias("init"), F.col("outcome.type").alias("inferred"))
    rows = model.means(ready.join(bound, "expr", "left").join(inits, "init", "left"), "cls", "type")
    variable = F.col("outcome").isNotNull()
    value = F.when(F.col("outcome.status") == "resolved", F.coalesce("outcome.type", "inferred"))
    unknown = _packed(_TYPE, status="unresolved", kind="class", reason="unknown_type", candidates=_none())
    on = F.when(F.col("type") == "this", _known(F.col("cls"), "project")).when(variable, value).otherwise(F.coalesce("meant", unknown))
    rows = rows.withColumn("on", on).drop("outcome", "meant").withColumn("at", F.col("on.fqn"))
    members = model.members.select(F.col("cls").alias("at"), "name", "method_id").unionByName(model.constructors.select(F.col("cls").alias("at"), F.lit("new").alias("name"), "method_id"))
    found = rows.select("expr", "at", "name").join(members, ["at", "name"]).join(model.methods, "method_id").groupBy("expr")
    found = found.agg(F.array_sort(F.collect_set("method_id")).alias("ids"), F.min("owner").alias("owner"), F.first("returned", ignorenulls=True).alias("returned"))
    rows = rows.join(found, "expr", "left").join(model.flags.select(F.col("cls").alias("at"), "outside", "generated"), "at", "left")
    t, kind = F.col("on"), "method_ref"
    outcome = (
        F.when(t.isNull(), _outcome(kind, "unresolved", reason="receiver_type_unknown"))
        .when(t["status"] != "resolved", _outcome(kind, t["status"], reason="receiver_type_unresolved", candidates=t["candidates"]))
        .when(t["kind"].isin("type_variable", "union", "wildcard"), _outcome(kind, "unresolved", reason=F.concat(t["kind"], F.lit("_receiver"))))
        .when((t["dims"] > 0) | (t["origin"] == "external") | (t["kind"] != "class"), _outcome(kind, "resolved", origin="external", owner=F.coalesce(t["fqn"], F.lit("array"))))
        .when(F.col("generated").isNull(), _outcome(kind, "unresolved", reason="receiver_class_unavailable"))
        .when(F.size("ids") == 1, _outcome(kind, "resolved", origin="project", owner=F.col("owner"), symbol=F.col("ids")[0], type=F.col("returned")))
        .when(F.size("ids") > 1, _outcome(kind, "ambiguous", origin="project", reason="overloaded_method_reference", candidates=F.col("ids")))
        .otherwise(_fallback("method", F.col("generated") & (F.col("name") != "new"), F.when(F.col("name") == "new", _none()).otherwise(F.col("outside")), "method"))
    )
    return _result(rows, outcome)


def _layer(ready: DataFrame, found: Found, bound: DataFrame, prefixes: DataFrame, model: Model) -> None:
    """Add to ``found`` the outcomes of expressions whose receivers and arguments are in it; kinds that no expression has cost nothing."""
    kinds = {r.kind for r in ready.select("kind").distinct().collect()}  # five at most
    of = lambda kind: ready.where(F.col("kind") == kind)
    results = lambda: found.results(ready)
    own, shared = [], []

    def argued(calls: DataFrame) -> DataFrame:
        joined = F.coalesce(F.arrays_overlap("args.kind", F.array(F.lit("type"), F.lit("expr"))), F.lit(False))
        plain, rest = calls.where(~joined).withColumn("given", F.coalesce(_plain(F.col("args")), _none())), calls.where(joined)
        if rest.isEmpty():
            return plain
        return plain.unionByName(rest.join(_arguments(rest, results(), model), "expr", "left").withColumn("given", F.coalesce("given", _none())))

    if "name_ref" in kinds:
        own.append(_names(of("name_ref"), bound, results(), model, prefixes))
    if "method_ref" in kinds:
        own.append(_references(of("method_ref"), bound, results(), model))
    if "object_creation" in kinds:
        # What the next steps ask again and again is written down first.
        own.append(_creations(written(argued(of("object_creation"))), model))
    if "field_access" in kinds:
        rows = _with_receivers(of("field_access"), found, model)
        package = F.coalesce((F.col("receiver_kind") == "expr") & F.col("r.kind").isin("package", "package_candidate"), F.lit(False))
        if found.own and not (segments := written(rows.where(package))).isEmpty():
            own.append(_segments(segments, model))
        shared.append(_once(rows.where(~package), _question(), lambda asked: _fields(written(_judged(asked, found)), model)))
    if "method_call" in kinds:
        rows = _with_receivers(argued(of("method_call")), found, model)
        around = ((F.col("receiver_kind") == "none") & F.col("in_local")).alias("in_local")
        shared.append(_once(rows, _question("given", around), lambda asked: _calls(written(_judged(asked, found)), model)))
    if own:
        found.own.append(written(reduce(DataFrame.unionByName, own).select(*_RESULT)))
    found.shared += shared


def resolve_expressions(exprs: DataFrame, variables: DataFrame, types: DataFrame, fields: DataFrame, methods: DataFrame, names: DataFrame, imports: DataFrame) -> DataFrame:
    """What every expression means: expr, kind, status, origin, owner, symbol, reason, candidates, type. No expression is dropped.

    * ``exprs``: expr, method, cls, kind (name_ref, field_access, method_call, object_creation, method_ref), name, receiver_kind
      (none, this, super, literal, cast, expr), receiver (an expr), type (of a literal, cast or new, or a reference's scope),
      args (kind literal, type, this or expr, and value), line, in_local (within a local or anonymous class).
    * ``variables``: method, cls, name, kind, type (null or ``var`` if inferred), start, end, init (as an argument).
    * ``types``: cls, kind, superclass, interfaces, outer, generated (members may be made by annotations). ``fields``: cls, name,
      field_id, type, is_static. ``methods``: cls, method_id, name, params, var_args, returns, is_static, kind, with those that
      ``codemodel.implicit_members`` adds.
    * ``names``: what type texts mean within a class, as of ``codemodel.resolve_types``: cls, text, status, kind, origin, fqn,
      dims, reason, candidates. ``imports``: static imports, cls, name (null on demand), owner.

    The type of a receiver comes from the expression inside it, as does that of an argument, or of a variable whose type is
    inferred. So expressions are resolved in layers: each round takes those that wait for nothing, joins them with what the
    rounds before found, and strikes them off the waiting list; as many rounds as receivers are nested. What waits for itself
    is resolved last, with nothing known of what it waits for. A qualified name starts as a chain of possible packages; where
    one ends in a type, all segments before it were packages.
    """
    with measured_joins(exprs.sparkSession):
        # Written, since what is left to be planned would be planned outside.
        return written(_resolved(exprs, variables, types, fields, methods, names, imports))


def _resolved(exprs: DataFrame, variables: DataFrame, types: DataFrame, fields: DataFrame, methods: DataFrame, names: DataFrame, imports: DataFrame) -> DataFrame:
    model = Model(types, fields, methods, names, imports)
    exprs = written(exprs.withColumn("in_local", F.coalesce("in_local", F.lit(False))).withColumn("receiver_kind", F.coalesce("receiver_kind", F.lit("none"))))
    scoped = exprs.where("kind = 'method_ref'").withColumn("name", F.col("type"))
    bound = written(bindings(exprs.where("kind = 'name_ref'").unionByName(scoped).select("expr", "method", "cls", "name", "line", "in_local"), variables, model))
    prefixes = written(exprs.where("kind = 'field_access' and receiver_kind = 'expr'").select(F.col("receiver").alias("expr"), F.lit(True).alias("prefix")).distinct())
    needs = [
        exprs.where("receiver_kind = 'expr'").select("expr", F.col("receiver").alias("on")),
        exprs.select("expr", F.explode("args").alias("a")).where("a.kind = 'expr'").select("expr", F.col("a.value").alias("on")),
        bound.where("init is not null").select("expr", F.col("init").alias("on")),
    ]
    waits = written(reduce(DataFrame.unionByName, needs).join(exprs.select(F.col("expr").alias("on")), "on", "left_semi").select("expr", "on").distinct())
    # Which layer an expression is of is found out by keys alone; the expressions are dealt by it once.
    left, layers = exprs.select("expr").distinct(), []
    while not left.isEmpty():
        split = written(left.join(waits.select("expr").distinct().withColumn("_waits", F.lit(True)), "expr", "left"))
        ready, left = split.where("_waits is null").select("expr"), split.where("_waits").select("expr")
        if ready.isEmpty():
            ready, left, waits = left, ready, waits.where("false")
        layers.append(ready.withColumn("layer", F.lit(len(layers))))
        waits = written(waits.join(ready.select(F.col("expr").alias("on")), "on", "left_anti").select("expr", "on"))
    found = Found()
    if layers:
        dealt = written(exprs.join(reduce(DataFrame.unionByName, layers), "expr").sortWithinPartitions("layer"))
    for k in range(len(layers)):
        _layer(dealt.where(F.col("layer") == k).drop("layer"), found, bound, prefixes, model)
    results = found.results(exprs)
    # Chains are of names and segments, which have their own outcomes.
    chains = reduce(DataFrame.unionByName, found.own) if found.own else results.where("false")
    whole = written(chains.where("outcome.kind = 'type' and size(chain) > 1").select(F.explode("chain").alias("expr")).distinct().withColumn("upgraded", F.lit(True)))
    if whole.isEmpty():
        return results.select("expr", F.col("outcome").alias("o")).select("expr", "o.*")
    inner = results.where("outcome.kind in ('package', 'package_candidate')").join(whole, "expr").join(model.packages.select(F.col("package").alias("name"), F.lit(True).alias("ours")), "name", "left")
    package = _outcome("package", "resolved", origin=F.when(F.col("ours"), "project").otherwise("external"))
    mended = results.join(inner.select("expr", package.alias("package")), "expr", "left")
    return mended.select("expr", F.coalesce("package", "outcome").alias("o")).select("expr", "o.*")


def call_targets(resolved: DataFrame, exprs: DataFrame, kinds: Sequence[str] = ("method_call", "object_creation", "method_ref")) -> DataFrame:
    """Call edges of resolved expressions: edge, caller, ord, status, targets, as ``graph.reach_calls`` takes them; calls that leave the project have no targets."""
    calls = exprs.where(F.col("kind").isin(*kinds)).select("expr", F.col("method").alias("caller"), F.col("line").alias("ord"))
    ours = F.coalesce(F.col("origin") == "project", F.lit(False))
    targets = F.when(F.col("symbol").isNotNull() & (F.col("status") == "resolved"), F.array("symbol")).when(ours & (F.col("status") == "ambiguous"), F.col("candidates")).otherwise(_none())
    status = F.when((F.col("status") == "resolved") & ~ours, "external").otherwise(F.col("status"))
    return calls.join(resolved, "expr").select(F.col("expr").alias("edge"), "caller", "ord", status.alias("status"), targets.alias("targets"))
