"""Types of C-like languages written as text: their trees, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A node of a type's tree: its number, its parent's (-1 for an alternative of the whole), its place there, name, dimensions.
NODE = "struct<id:int,parent:int,pos:int,name:string,dims:int>"
_TOKEN = r"(?U)@[\w.]+(?:\([^)]*\))?|\.\.\.|\[\s*\]|[\w$]+(?:\s*\.\s*[\w$]+)*|[<>,&|?.]"
_PLAIN = r"(?U)^(?:@[\w.]+(?:\([^)]*\))?|\.\.\.|\[\s*\]|[\w$]+(?:\s*\.\s*[\w$]+)*|[<>,&|?.]|\s)*$"


def type_tree(text: Column) -> Column:
    """The nodes of a type: an array of ``NODE`` in the order they are written, or null if the text is no type.

    ``Map<String, List<?>>[]`` has a root of one dimension with two arguments, the second with one. ``A | B`` has two roots. A bound
    of a wildcard, or of a variable, is its argument; a type within a parametrised one (``A<B>.C``) continues its name. Annotations are
    passed over. One fold over the tokens keeps the stack of nodes whose arguments are open; what does not add up, such as
    brackets that do not close or a name where none can be, gives null.
    """
    tokens = F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda t: ~t.startswith("@"))
    tokens = F.transform(tokens, lambda t: F.regexp_replace(t, r"\s+", ""))
    none = F.array().cast("array<struct<id:int,bound:boolean>>")
    # last: the node that what comes next belongs to, -1 where a name is due. rows: names as they come; more: dimensions and longer names.
    start = F.struct(
        F.lit(0).alias("n"), F.lit(-1).alias("last"), none.alias("stack"), F.lit(True).alias("fine"), F.lit(False).alias("dot"),
        F.array().cast("array<struct<id:int,parent:int,name:string>>").alias("rows"), F.array().cast("array<struct<id:int,name:string>>").alias("more"),
    )

    def step(acc: Column, t: Column) -> Column:
        stack, last, n = acc["stack"], acc["last"], acc["n"]
        bound, word = t.isin("extends", "super"), t.rlike(r"(?U)^[\w$?]")
        name = word & ~bound
        # Bounds end with the argument that they are part of.
        closes = t.isin(",", ">", "|") | (t == "&")
        trimmed = F.filter(stack, lambda s, i: ~s["bound"] | (i < F.size(stack) - 1))
        open_ = F.when(closes & (t != "&"), trimmed).otherwise(stack)
        above = F.when(F.size(stack) > 0, F.element_at(stack, -1)["id"]).otherwise(-1)
        push = lambda is_bound: F.array_append(open_, F.struct(last.alias("id"), F.lit(is_bound).alias("bound")))
        new_stack = (
            F.when((t == "<"), push(False)).when(bound, push(True)).when((t == ">") & (F.size(open_) > 0), F.slice(open_, 1, F.greatest(F.size(open_) - 1, F.lit(0)))).otherwise(open_)
        )
        inner = F.when(F.size(open_) > 0, F.element_at(open_, -1)["id"]).otherwise(-1)
        fresh = name & ~acc["dot"]
        new_last = F.when(fresh, n).when(name, last).when(t == ">", inner).when(t.isin("<", ",", "|", "&") | bound, -1).otherwise(last)
        ready = last >= 0
        fine = (
            F.when(name, F.when(acc["dot"], ready & (t != "?")).otherwise(~ready))
            .when(bound | (t == "<") | (t == "[]") | (t == "...") | (t == "."), ready & ~acc["dot"])
            .when(t == ">", ready & (F.size(open_) > 0) & ~acc["dot"])
            .when(t == ",", ready & (F.size(open_) > 0) & ~acc["dot"])
            .when(t == "&", ready & (F.size(stack) > 0) & ~acc["dot"])
            .otherwise(ready & (F.size(open_) == 0) & ~acc["dot"])
        )
        rows = F.when(fresh, F.array_append(acc["rows"], F.struct(n.alias("id"), above.alias("parent"), t.alias("name")))).otherwise(acc["rows"])
        longer = F.when(name & acc["dot"], F.concat(F.lit("."), t)).when(t.isin("[]", "..."), "[]")
        more = F.when(longer.isNotNull(), F.array_append(acc["more"], F.struct(last.alias("id"), longer.alias("name")))).otherwise(acc["more"])
        return F.struct(
            (n + fresh.cast("int")).alias("n"), new_last.alias("last"), new_stack.alias("stack"), (acc["fine"] & fine).alias("fine"), (t == ".").alias("dot"), rows.alias("rows"), more.alias("more")
        )

    def finish(acc: Column) -> Column:
        open_ = F.filter(acc["stack"], lambda s: ~s["bound"])
        whole = acc["fine"] & (acc["last"] >= 0) & (F.size(open_) == 0) & ~acc["dot"]

        def node(r: Column) -> Column:
            own = F.filter(acc["more"], lambda m: m["id"] == r["id"])
            before = F.filter(acc["rows"], lambda o: (o["parent"] == r["parent"]) & (o["id"] < r["id"]))
            rest = F.array_join(F.transform(F.filter(own, lambda m: m["name"] != "[]"), lambda m: m["name"]), "")
            return F.struct(r["id"].alias("id"), r["parent"].alias("parent"), F.size(before).alias("pos"), F.concat(r["name"], rest).alias("name"), F.size(F.filter(own, lambda m: m["name"] == "[]")).alias("dims")).cast(NODE)

        return F.when(whole, F.transform(acc["rows"], node))

    return F.when(text.rlike(_PLAIN), F.aggregate(tokens, start, step, finish))
