"""Resolution of expressions on a small project, layer by layer."""

from __future__ import annotations

import random

from ferrule.operators import codemodel as C
from ferrule.operators import expressions as E

TYPES = "cls string, kind string, superclass string, interfaces array<string>, outer string, generated boolean, components array<struct<name:string,type:string>>"
FIELDS = "cls string, name string, field_id string, type string, is_static boolean, kind string"
METHODS = "cls string, method_id string, name string, params array<string>, var_args boolean, returns string, is_static boolean, kind string"
VARIABLES = "method string, cls string, name string, kind string, type string, start int, end int, init struct<kind:string,value:string>"
EXPRS = "expr string, method string, cls string, kind string, name string, receiver_kind string, receiver string, type string, args array<struct<kind:string,value:string>>, line int, in_local boolean"
NAMES = "cls string, text string, status string, kind string, origin string, fqn string, dims int, reason string, candidates array<string>"
IMPORTS = "cls string, name string, owner string"

PROJECT = {"Shop": "p.Shop", "Base": "p.Base", "Item": "p.Item", "Util": "p.Util", "Inner": "p.Shop.Inner", "Data": "p.Data", "Port": "p.Port"}


def project(spark):
    types = [
        ("p.Shop", "class", "p.Base", [], None, False, None), ("p.Base", "class", None, [], None, False, None), ("p.Item", "class", "lib.Thing", [], None, False, None),
        ("p.Util", "class", None, [], None, False, None), ("p.Shop.Inner", "class", None, [], "p.Shop", False, None), ("p.Data", "class", None, [], None, True, None), ("p.Port", "interface", None, [], None, False, None),
    ]
    fields = [
        ("p.Shop", "item", "Shop.item", "Item", False, "field"), ("p.Base", "name", "Base.name", "String", False, "field"), ("p.Item", "shop", "Item.shop", "Shop", False, "field"),
        ("p.Shop", "items", "Shop.items", "Item[]", False, "field"), ("p.Util", "MAX", "Util.MAX", "int", True, "field"), ("p.Shop", "odd", "Shop.odd", "Nowhere", False, "field"), ("p.Shop", "any", "Shop.any", "T", False, "field"),
    ]
    methods = [
        ("p.Shop", "Shop.item(int)", "item", ["int"], False, "Item", False, "method"), ("p.Shop", "Shop.item(String)", "item", ["String"], False, "Item", False, "method"),
        ("p.Base", "Base.self()", "self", [], False, "Shop", False, "method"), ("p.Base", "Base.only()", "only", [], False, "void", False, "method"), ("p.Shop", "Shop.only()", "only", [], False, "void", False, "method"),
        ("p.Item", "Item.shop()", "shop", [], False, "Shop", False, "method"), ("p.Util", "Util.help(Object)", "help", ["Object"], False, "String", True, "method"), ("p.Util", "Util.many(int...)", "many", ["int[]"], True, "int", True, "method"),
        ("p.Item", "Item.new(Shop)", "Item", ["Shop"], False, None, False, "constructor"), ("p.Shop.Inner", "Inner.go()", "go", [], False, "Inner", False, "method"),
    ]
    texts = [(c, t, "resolved", "class", "project", f, 0, None, []) for c in PROJECT.values() for t, f in PROJECT.items()]
    for c in PROJECT.values():
        texts += [(c, t, "resolved", "class", "external", f"java.lang.{t}", 0, None, []) for t in ("String", "Object", "System")]
        texts += [(c, "int", "resolved", "primitive", "primitive", "int", 0, None, []), (c, "int[]", "resolved", "primitive", "primitive", "int", 1, None, []), (c, "Item[]", "resolved", "class", "project", "p.Item", 1, None, []), (c, "Twice", "ambiguous", "class", "project", None, 0, "multiple_on_demand_imports", ["a.Twice", "b.Twice"]), (c, "T", "resolved", "type_variable", "type_variable", "T", 0, None, [])]
    imports = [("p.Base", "MAX", "p.Util"), ("p.Base", None, "p.Util"), ("p.Base", "far", "lib.Far"), ("p.Util", None, "lib.Wide")]
    make = spark.createDataFrame
    types_df, methods_df = make(types, TYPES), make(methods, METHODS)
    added = C.implicit_members(types_df, methods_df)
    extra = added.where("name <> 'Item'").selectExpr("cls", "method_id", "name", "params", "false as var_args", "cast(null as string) as returns", "false as is_static", "'constructor' as kind")
    return types_df, make(fields, FIELDS), methods_df.unionByName(extra), make(texts, NAMES), make(imports, IMPORTS)


def resolve(spark, exprs, variables=()):
    rows = [(e["expr"], "m", e.get("cls", "p.Shop"), e["kind"], e.get("name"), e.get("by", "none"), e.get("on"), e.get("type"), e.get("args", []), e.get("line", 5), e.get("in_local")) for e in exprs]
    types, fields, methods, names, imports = project(spark)
    found = E.resolve_expressions(spark.createDataFrame(rows, EXPRS), spark.createDataFrame(list(variables), VARIABLES), types, fields, methods, names, imports).collect()
    assert len(found) == len(rows)
    return {r.expr: r for r in found}


def short(r):
    return (r.kind, r.status, r.symbol or r.owner, r.reason, r.type.fqn if r.type else None)


def test_chains_fields_calls_and_references(spark):
    var = [("m", "p.Shop", "x", "local_variable", "Item", 1, 9, None), ("m", "p.Shop", "x", "local_variable", "Shop", 4, 6, None), ("m", "p.Shop", "arg", "parameter", "Shop", 1, 1, None),
           ("m", "p.Shop", "v", "local_variable", "var", 2, 9, ("expr", "c2")), ("m", "p.Shop", "loop", "local_variable", "var", 2, 9, ("expr", "l2")), ("m", "p.Shop", "n", "local_variable", "var", 2, 9, ("literal", "int"))]
    call = lambda expr, name, **k: {"expr": expr, "kind": "method_call", "name": name, **k}
    field = lambda expr, name, **k: {"expr": expr, "kind": "field_access", "name": name, **k}
    ref = lambda expr, name, **k: {"expr": expr, "kind": "name_ref", "name": name, **k}
    exprs = [
        ref("x", "x"), ref("x9", "x", line=9), ref("arg", "arg"), ref("name", "name"), ref("T", "Util"), ref("no", "nothing"), ref("amb", "Twice"), ref("v", "v"), ref("n", "n"),
        field("c1", "item", by="this"), call("c2", "shop", by="expr", on="c1"), field("c3", "item", by="expr", on="c2"), call("c4", "shop", by="expr", on="c3"), call("c5", "self", by="expr", on="c2"), call("c6", "item", by="expr", on="c5", args=[("literal", "int")]),
        call("c7", "fly", by="expr", on="c1"), call("c8", "fly", by="expr", on="c7"), call("v1", "self", by="expr", on="v"),
        call("o1", "item", args=[("expr", "n")]), call("o2", "item", args=[("expr", "no")]), call("o3", "item"), call("o4", "toString"), call("o5", "missing"),
        call("s1", "only", by="super"), field("s2", "name", by="super"), call("s3", "only", by="this"), field("s4", "item", by="super"),
        call("lit", "length", by="literal", type="String"), call("cast", "shop", by="cast", type="Item"), call("cast2", "shop", by="cast", type="Nope"), call("st", "help", by="expr", on="T", args=[("this", None)]), call("st2", "many", by="expr", on="T", args=[("literal", "int")] * 3),
        field("arr", "items", by="this"), field("len", "length", by="expr", on="arr"), call("arrc", "clone", by="expr", on="arr"), field("odd", "odd", by="this"), call("oddc", "go", by="expr", on="odd"), field("any", "any", by="this"), call("anyc", "go", by="expr", on="any"),
        call("num", "go", by="expr", on="n"), call("prim", "go", by="other"), field("nf", "absent", by="expr", on="arg"), field("ext", "absent", by="expr", on="c1"), field("in", "Inner", by="expr", on="S"), ref("S", "Shop"), call("in2", "go", by="expr", on="in"),
        ref("j", "java"), field("ju", "util", by="expr", on="j"), field("jul", "List", by="expr", on="ju"), call("of", "of", by="expr", on="jul"), ref("p", "p"), field("pI", "Item", by="expr", on="p"), field("pIs", "shop", by="expr", on="pI"), ref("q", "zz"), field("qz", "yy", by="expr", on="q"), call("qc", "go", by="expr", on="qz"),
        ref("Sys", "System"), field("out", "out", by="expr", on="Sys"), call("print", "println", by="expr", on="out"),
        {"expr": "new1", "kind": "object_creation", "type": "Item", "args": [("this", None)]}, {"expr": "new2", "kind": "object_creation", "type": "Item"}, {"expr": "new3", "kind": "object_creation", "type": "Port"}, {"expr": "new4", "kind": "object_creation", "type": "String"}, {"expr": "new5", "kind": "object_creation", "type": "Nope"}, {"expr": "new6", "kind": "object_creation", "type": "Shop"}, call("new7", "shop", by="expr", on="new1"),
        {"expr": "r1", "kind": "method_ref", "type": "x", "name": "self"}, {"expr": "r2", "kind": "method_ref", "type": "Shop", "name": "item"}, {"expr": "r3", "kind": "method_ref", "type": "Item", "name": "new"}, {"expr": "r4", "kind": "method_ref", "type": "String", "name": "trim"}, {"expr": "r5", "kind": "method_ref", "type": "this", "name": "none"}, {"expr": "r6", "kind": "method_ref", "type": "Nope", "name": "x"},
        ref("l1", "loop"), call("l2", "go", by="expr", on="l1"), call("loc", "only", in_local=True), ref("locf", "name", in_local=True),
        call("im", "many", cls="p.Base", args=[("literal", "int")]), ref("imf", "MAX", cls="p.Base"), call("far", "far", cls="p.Base"), call("wide", "dunno", cls="p.Util"), call("gen", "getX", cls="p.Data"), call("dark", "getX", cls="p.Item"), call("inner", "only", cls="p.Shop.Inner"), ref("darkf", "zip", cls="p.Item"),
    ]
    got = {k: short(r) for k, r in resolve(spark, exprs, var).items()}
    # s1: what a class overrides itself is not found above it.
    S, I, J = "p.Shop", "p.Item", "java.lang.String"  # noqa: E741
    expected = {
        "x": ("local_variable", "resolved", "m$x@4", None, S), "x9": ("local_variable", "resolved", "m$x@1", None, I), "arg": ("parameter", "resolved", "m$arg", None, S), "name": ("field", "resolved", "Base.name", None, J),
        "T": ("type", "resolved", "p.Util", None, "p.Util"), "no": ("name", "unresolved", None, "unknown_name", None), "amb": ("type", "ambiguous", None, "multiple_on_demand_imports", None), "v": ("local_variable", "resolved", "m$v@2", None, S), "n": ("local_variable", "resolved", "m$n@2", None, "int"),
        "c1": ("field", "resolved", "Shop.item", None, I), "c2": ("method", "resolved", "Item.shop()", None, S), "c3": ("field", "resolved", "Shop.item", None, I), "c4": ("method", "resolved", "Item.shop()", None, S), "c5": ("method", "resolved", "Base.self()", None, S), "c6": ("method", "resolved", "Shop.item(int)", None, I),
        "c7": ("method", "unresolved", None, "possible_inherited_external_method", None), "c8": ("method", "unresolved", None, "receiver_type_unknown:possible_inherited_external_method", None), "v1": ("method", "resolved", "Base.self()", None, S),
        "o1": ("method", "resolved", "Shop.item(int)", None, I), "o2": ("method", "ambiguous", None, "overload_not_disambiguated", I), "o3": ("method", "unresolved", None, "no_matching_arity", None), "o4": ("method", "resolved", "java.lang.Object", None, None), "o5": ("method", "unresolved", None, "no_such_method", None),
        "s1": ("method", "unresolved", None, "no_such_method", None), "s2": ("field", "resolved", "Base.name", None, J), "s3": ("method", "resolved", "Shop.only()", None, None), "s4": ("field", "unresolved", None, "no_such_field", None),
        "lit": ("method", "resolved", J, None, None), "cast": ("method", "resolved", "Item.shop()", None, S), "cast2": ("method", "unresolved", None, "receiver_type_unresolved:unknown_type", None), "st": ("method", "resolved", "Util.help(Object)", None, J), "st2": ("method", "resolved", "Util.many(int...)", None, "int"),
        "arr": ("field", "resolved", "Shop.items", None, I), "len": ("external_member", "resolved", "array", None, None), "arrc": ("method", "resolved", "array", None, None), "odd": ("field", "resolved", "Shop.odd", None, None), "oddc": ("method", "unresolved", None, "receiver_type_unresolved:unknown_type", None), "any": ("field", "resolved", "Shop.any", None, "T"), "anyc": ("method", "unresolved", None, "type_variable_receiver", None),
        "num": ("method", "unresolved", None, "primitive_receiver", None), "prim": ("method", "unresolved", None, "receiver_not_analyzed", None), "nf": ("field", "unresolved", None, "no_such_field", None), "ext": ("field", "unresolved", None, "possible_inherited_external_field", None), "in": ("type", "resolved", "p.Shop.Inner", None, "p.Shop.Inner"), "S": ("type", "resolved", S, None, S), "in2": ("method", "resolved", "Inner.go()", None, "p.Shop.Inner"),
        "j": ("package", "resolved", None, None, None), "ju": ("package", "resolved", None, None, None), "jul": ("type", "resolved", "java.util.List", None, "java.util.List"), "of": ("method", "resolved", "java.util.List", None, None), "p": ("package", "resolved", None, None, None), "pI": ("type", "resolved", I, None, I), "pIs": ("field", "resolved", "Item.shop", None, S),
        "q": ("package_candidate", "unresolved", None, "possible_package_prefix", None), "qz": ("package_candidate", "unresolved", None, "possible_package_prefix", None), "qc": ("method", "unresolved", None, "package_not_callable", None),
        "Sys": ("type", "resolved", "java.lang.System", None, "java.lang.System"), "out": ("external_member", "resolved", "java.lang.System", None, "java.io.PrintStream"), "print": ("method", "resolved", "java.io.PrintStream", None, None),
        "new1": ("constructor", "resolved", "Item.new(Shop)", None, I), "new2": ("constructor", "unresolved", None, "no_matching_constructor", I), "new3": ("constructor", "resolved", "p.Port", "anonymous_implementation", "p.Port"), "new4": ("constructor", "resolved", J, None, J), "new5": ("constructor", "unresolved", None, "unknown_type", None), "new6": ("constructor", "resolved", "p.Shop#Shop()", None, S), "new7": ("method", "resolved", "Item.shop()", None, S),
        "r1": ("method_ref", "resolved", "Base.self()", None, S), "r2": ("method_ref", "ambiguous", None, "overloaded_method_reference", None), "r3": ("method_ref", "resolved", "Item.new(Shop)", None, None), "r4": ("method_ref", "resolved", J, None, None), "r5": ("method", "unresolved", None, "no_such_method", None), "r6": ("method_ref", "unresolved", None, "receiver_type_unresolved", None),
        "l1": ("local_variable", "resolved", "m$loop@2", None, None), "l2": ("method", "unresolved", None, "receiver_type_unknown", None), "loc": ("method", "ambiguous", "Shop.only()", "possible_local_class_member", None), "locf": ("field", "ambiguous", "Base.name", "possible_local_class_member", J),
        "im": ("method", "resolved", "Util.many(int...)", None, "int"), "imf": ("field", "resolved", "Util.MAX", None, "int"), "far": ("method", "resolved", "lib.Far", None, None), "wide": ("method", "unresolved", None, "static_wildcard_external", None), "gen": ("method", "unresolved", None, "possible_lombok_generated", None), "dark": ("method", "unresolved", None, "possible_inherited_external_method", None), "inner": ("method", "resolved", "Shop.only()", None, None), "darkf": ("field", "unresolved", None, "possible_inherited_external_field", None),
    }
    assert [(k, v, expected[k]) for k, v in got.items() if v != expected[k]] == [] and set(got) == set(expected)


def test_deep_chains_are_those_of_a_walk(spark):
    rng = random.Random(1)
    steps = {"p.Shop": [("field_access", "item", "p.Item"), ("method_call", "self", "p.Shop"), ("field_access", "none", None)], "p.Item": [("method_call", "shop", "p.Shop"), ("field_access", "shop", "p.Shop"), ("method_call", "none", None)]}
    exprs, expected = [], {}
    for chain in range(20):
        at, on, by = "p.Shop", None, "this"
        for depth in range(rng.randrange(1, 5)):
            kind, name, to = rng.choice(steps.get(at, [("method_call", "go", None)]))
            expr = f"{chain}.{depth}"
            exprs.append({"expr": expr, "kind": kind, "name": name, "by": by, "on": on})
            expected[expr], at, on, by = to, to, expr, "expr"
    rng.shuffle(exprs)
    got = resolve(spark, exprs)
    assert {k: r.type.fqn if r.type else None for k, r in got.items()} == expected


def test_no_expressions_and_call_targets(spark):
    assert resolve(spark, []) == {}
    exprs = [{"expr": "a", "kind": "method_call", "name": "only"}, {"expr": "b", "kind": "method_call", "name": "item", "args": [("expr", "zz")]}, {"expr": "c", "kind": "method_call", "name": "trim", "by": "literal", "type": "String"}, {"expr": "d", "kind": "method_call", "name": "gone"}]
    rows = [(e["expr"], "m", "p.Shop", e["kind"], e.get("name"), e.get("by", "none"), None, e.get("type"), e.get("args", []), 5, None) for e in exprs]
    table = spark.createDataFrame(rows, EXPRS)
    types, fields, methods, names, imports = project(spark)
    found = E.resolve_expressions(table, spark.createDataFrame([], VARIABLES), types, fields, methods, names, imports)
    got = {r.edge: (r.caller, r.status, r.targets) for r in E.call_targets(found, table).collect()}
    assert got == {"a": ("m", "resolved", ["Shop.only()"]), "b": ("m", "ambiguous", ["Shop.item(String)", "Shop.item(int)"]), "c": ("m", "external", []), "d": ("m", "unresolved", [])}


def test_what_many_expressions_ask_is_asked_once(spark, monkeypatch):
    asked, calls = [], E._calls
    monkeypatch.setattr(E, "_calls", lambda rows, model: asked.append(rows.count()) or calls(rows, model))
    exprs = [{"expr": f"c{k}", "kind": "method_call", "name": "item", "by": "this"} for k in range(30)] + [{"expr": f"g{k}", "kind": "method_call", "name": "gone", "line": k} for k in range(30)]
    got = resolve(spark, exprs)
    assert len(got) == 60 and len({(r.status, r.symbol, r.reason) for k, r in got.items() if k[0] == "c"}) == 1
    assert asked == [2]
