"""Control and data flow within methods: nesting, branches, values on their way, and the writes that reach a read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.operators.knowledge import is_mutator
from ferrule.sources.tables import gathered

# What resolved names count as, and which statements are arms of which.
VARIABLE_KINDS = {"local_variable": "local", "lambda_parameter": "local", "catch_parameter": "local", "pattern_variable": "local", "parameter": "parameter", "field": "field", "record_component": "field"}
ARMS = {"if": ["else_if", "else"], "else_if": ["else_if", "else"], "try": ["catch", "finally"], "switch": ["case", "default"]}
LOOPS = ["for", "foreach", "while", "do"]

Batches = Iterator[pa.RecordBatch]
Row = dict


def _swept(rows: DataFrame, order: list[Column | str], step: Callable[[], Callable[[Row], Iterator[tuple]]], schema: T.StructType) -> DataFrame:
    """Run ``step`` over the rows of each ``method`` in order: one shuffle by method, one sort within it, one pass with its own state.

    ``step()`` begins a method and gives a function of a row, which yields rows of ``schema``; None as a row ends the method.
    Rows are not gathered: what a task holds is the state of one method, such as the statements open at a place.
    """
    names, kinds = schema.names, [f.dataType for f in schema]

    def run(batches: Batches) -> Batches:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(k) for k in kinds]
        method, advance, out = None, None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            return made

        for block in batches:
            for row in block.to_pylist():
                if advance is None or row["method"] != method:
                    if advance is not None:
                        out.extend(advance(None))
                    method, advance = row["method"], step()
                out.extend(advance(row))
            yield batch()
        if advance is not None:
            out.extend(advance(None))
        yield batch()

    return gathered(rows.where("method is not null"), "method", order=["method", *order]).mapInArrow(run, schema)


def _schema(df: DataFrame, *columns: str, **more: T.DataType) -> T.StructType:
    return T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in columns], *[T.StructField(k, v) for k, v in more.items()]])


def nested(spans: DataFrame) -> DataFrame:
    """The tree that spans make by what they contain: method, id, parent, parent_kind, depth, ord (the place in preorder, from 1).

    ``spans`` has method, id, kind, start and end. Of equal spans the one of the least id is outside; spans that overlap
    without containing one another are siblings. A row's parent is the innermost span still open where it starts.
    """
    source = spans.select("method", "id", "kind", "start", "end")

    def step() -> Callable[[Row], Iterator[tuple]]:
        open_: list[Row] = []
        n = 0

        def advance(row: Row | None) -> Iterator[tuple]:
            nonlocal n
            if row is None:
                return
            while open_ and open_[-1]["end"] < row["end"]:
                open_.pop()
            n += 1
            above = open_[-1] if open_ else {"id": None, "kind": None}
            yield row["method"], row["id"], above["id"], above["kind"], len(open_), n
            open_.append(row)

        return advance

    schema = _schema(source, "method", "id")
    for name, kind in (("parent", source.schema["id"].dataType), ("parent_kind", T.StringType()), ("depth", T.IntegerType()), ("ord", T.IntegerType())):
        schema = schema.add(name, kind)
    return _swept(source, ["start", F.desc("end"), "id"], step, schema)


def control_flow(statements: DataFrame) -> DataFrame:
    """Each statement's place in the control flow of its method: method, id, kind, loop_kind, parent, branch, depth, ord.

    Loops are of one kind, with what they were beside it. ``branch`` says whether a statement is another arm of its parent (an
    else of an if, a catch of a try, a case of a switch) rather than within it. ``statements`` has method, id, kind, start, end,
    where the span of an if holds its else.
    """
    placed = nested(statements).join(statements.select("method", "id", "kind"), ["method", "id"])
    arms = F.create_map(*[x for k, v in ARMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    branch = F.coalesce(F.array_contains(F.try_element_at(arms, F.col("parent_kind")), F.col("kind")), F.lit(False))
    loop = F.col("kind").isin(LOOPS)
    return placed.select("method", "id", F.when(loop, "loop").otherwise(F.col("kind")).alias("kind"), F.when(loop, F.col("kind")).alias("loop_kind"), "parent", branch.alias("branch"), "depth", "ord")


def summary(flow: DataFrame) -> DataFrame:
    """By method: statements, decisions, loops, exits, handlers, and how deep they nest, arms not counted as deeper than what they are arms of."""
    kind = F.col("kind")
    levels = F.sum(F.when(F.col("branch"), 0).otherwise(1))  # of the statement itself
    counted = [("decisions", kind.isin("if", "else_if", "switch")), ("loops", kind == "loop"), ("exits", kind.isin("return", "throw")), ("handlers", kind == "catch")]
    return flow.groupBy("method").agg(F.count("*").alias("statements"), *[F.count_if(c).alias(n) for n, c in counted], levels.alias("own"), F.max("depth").alias("depth"))


# --- values ------------------------------------------------------------------------


def value_refs(exprs: DataFrame) -> DataFrame:
    """Add ``ref``, what an expression stands for as a value, null if for none: kind, name, symbol, type, text, line, declared.

    ``exprs`` has method, expr, kind, name, text, line, start, end, ref_kind, symbol, status, origin, type and declared. Names and fields
    are parameters, locals, fields or constants; calls are their results, with a symbol if the project has the callee.
    """
    kind, ref = F.col("kind"), F.col("ref_kind")
    variable = F.try_element_at(F.create_map(*[F.lit(x) for pair in VARIABLE_KINDS.items() for x in pair]), ref)
    variable = F.when(F.col("symbol").isNotNull(), variable)
    ours = (F.col("status") == "resolved") & (F.col("origin") == "project")

    def made(kind: Column | str, name: str, symbol: Column, declared: bool = False) -> Column:
        parts = [(F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.col(name).alias("name"), symbol.alias("symbol"), F.col("type").alias("type"), F.col("text").alias("text"), F.col("line").alias("line")]
        return F.struct(*parts, (F.col("declared") if declared else F.lit(None).cast("int")).alias("declared"))

    symbol = F.col("symbol")
    return exprs.withColumn(
        "ref",
        F.when((kind == "field_access") & (ref == "enum_constant") & symbol.isNotNull(), made("constant", "text", symbol))
        .when((kind == "name_ref") & variable.isNotNull(), made(variable, "name", symbol, True))
        .when((kind == "field_access") & variable.isNotNull(), made(variable, "text", symbol, True))
        .when(kind == "method_call", made("call_result", "name", F.when(ours, symbol)))
        .when(kind == "object_creation", made("new", "name", symbol)),
    )


def held_values(slots: DataFrame, exprs: DataFrame, lambdas: DataFrame) -> DataFrame:
    """The outermost expressions of each slot's span, ignoring what lies in a lambda within it: method, slot, expr.

    ``slots`` has method, slot, start and end, ``exprs`` method, expr, start and end, ``lambdas`` method, start and end. All spans of a
    method pass once, sorted by where they start, with a stack of those still open: an expression belongs to the slots down the
    stack until an expression or a lambda around it comes between. Nothing is joined by ranges.
    """
    none = F.lit(None).cast("string")
    rows = slots.select("method", F.lit(0).alias("rank"), F.col("slot").alias("id"), "start", "end")
    rows = rows.unionByName(lambdas.select("method", F.lit(1).alias("rank"), none.alias("id"), "start", "end")).unionByName(exprs.select("method", F.lit(2).alias("rank"), F.col("expr").alias("id"), "start", "end"))

    def step() -> Callable[[Row], Iterator[tuple]]:
        open_: list[Row] = []

        def advance(row: Row | None) -> Iterator[tuple]:
            if row is None:
                return
            while open_ and open_[-1]["end"] < row["end"]:
                open_.pop()
            if row["rank"] == 2:
                for above in reversed(open_):
                    if above["rank"] == 0:
                        yield row["method"], above["id"], row["id"]
                    elif above["rank"] == 1 or (above["start"], above["end"]) != (row["start"], row["end"]):
                        break
            open_.append(row)

        return advance

    schema = _schema(rows, "method").add("slot", T.StringType()).add("expr", T.StringType())
    return _swept(rows, ["start", F.desc("end"), "rank", "id"], step, schema)


def value_edges(exprs: DataFrame, slots: DataFrame, lambdas: DataFrame) -> DataFrame:
    """Where values flow within methods: method, via, source, source_expr, target, expr, line, callee, param, detail.

    A slot is a place that takes what its span holds: slot, method, via (declare, iterate, assign, compound_assign, argument, mutation,
    receiver, lambda_param, return), start, end, target (kind, name, symbol), expr, line, callee, param, detail, and literal, the type
    of the literal that the span is, if any. A literal is a source by itself; a compound assignment also reads its target.
    """
    refs = value_refs(exprs)
    held = held_values(slots, exprs, lambdas)
    sources = refs.where("ref is not null").select("method", F.col("expr").alias("source_expr"), "ref")
    taken = held.withColumnRenamed("expr", "source_expr").join(sources, ["method", "source_expr"])
    kept = ["method", "slot", "via", "target", "expr", "line", "callee", "param", "detail"]
    found = slots.select(*kept).join(taken, ["method", "slot"])
    ref_type = refs.schema["ref"].dataType.simpleString()
    lit = F.struct(F.lit("literal").alias("kind"), F.col("literal").alias("name"), F.lit(None).cast("string").alias("symbol"), F.col("literal").alias("type"), F.concat("literal", F.lit(" literal")).alias("text"), F.col("line").cast("int").alias("line"), F.lit(None).cast("int").alias("declared")).cast(ref_type)
    literals = slots.where("literal is not null and literal <> 'null'").withColumn("ref", lit)
    t = F.col("target")
    own = F.struct(t["kind"].alias("kind"), t["name"].alias("name"), t["symbol"].alias("symbol"), F.lit(None).cast("string").alias("type"), t["name"].alias("text"), F.col("line").cast("int").alias("line"), F.lit(None).cast("int").alias("declared")).cast(ref_type)
    selves = slots.where("via = 'compound_assign' and target.symbol is not null").withColumn("ref", own)
    nobody = F.lit(None).cast(exprs.schema["expr"].dataType).alias("source_expr")
    parts = [found.select(*kept, "source_expr", "ref"), literals.select(*kept, nobody, "ref"), selves.select(*kept, nobody, "ref")]
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("ref", "source").drop("slot")


def value_slots(calls: DataFrame) -> DataFrame:
    """The slots of calls' arguments and of receivers that a call changes or reads: see ``value_edges``.

    ``calls`` has method, expr, kind, name, line, callee (null outside the project), owner, receiver (kind, name, symbol, start, end),
    params (names, of the callee) and args (start, end, literal). An argument of a callee in the project flows into its parameter,
    the last one taking the rest; one of another call into that call's place; what a mutator outside the project takes flows into
    its receiver.
    """
    name, changes = F.col("name"), (F.col("kind") == "method_call") & is_mutator(F.col("name"))
    variable = F.coalesce(F.col("receiver.kind").isin("parameter", "local", "field"), F.lit(False))
    args = calls.withColumns({"changes": changes, "variable": variable}).select("*", F.posexplode("args").alias("pos", "a"))
    param = F.coalesce(F.get("params", F.col("pos")), F.get("params", F.size("params") - 1))
    label = F.when(F.col("kind") == "method_call", F.concat(F.coalesce("owner", F.lit("?")), F.lit("."), name)).otherwise(F.concat(F.lit("new "), name))
    inner = F.struct(F.lit("callee_parameter").alias("kind"), param.alias("name"), F.concat("callee", F.lit("$"), param).alias("symbol"))
    outer = F.struct(F.lit("external_argument").alias("kind"), F.concat(label, F.lit("#"), F.col("pos").cast("string")).alias("name"), F.lit(None).cast("string").alias("symbol"))
    known = F.col("callee").isNotNull() & (F.size("params") > 0)
    slot = lambda via: F.concat(F.col("expr").cast("string"), F.lit(f":{via}:"), F.col("pos").cast("string")).alias("slot")
    span = [F.col("a.start").alias("start"), F.col("a.end").alias("end")]
    common = ["expr", "line", "callee"]
    passed = args.where(~(F.col("changes") & F.col("callee").isNull())).select("method", slot("argument"), F.lit("argument").alias("via"), *span, F.when(known, inner).otherwise(outer).alias("target"), *common, F.when(known, param).alias("param"), name.alias("detail"), F.col("a.literal").alias("literal"))
    into = F.struct("receiver.kind", "receiver.name", "receiver.symbol")
    changed = args.where("changes and variable").select("method", slot("mutation"), F.lit("mutation").alias("via"), *span, into.alias("target"), *common, F.lit(None).cast("string").alias("param"), name.alias("detail"), F.col("a.literal").alias("literal"))
    result = F.struct(F.lit("call_result").alias("kind"), name.alias("name"), F.col("callee").alias("symbol"))
    read = calls.where((F.col("kind") == "method_call") & F.col("receiver.kind").isNotNull() & ~(changes & variable)).withColumn("pos", F.lit(0))
    read = read.select("method", slot("receiver"), F.lit("receiver").alias("via"), F.col("receiver.start").alias("start"), F.col("receiver.end").alias("end"), result.alias("target"), *common, F.lit(None).cast("string").alias("param"), name.alias("detail"), F.lit(None).cast("string").alias("literal"))
    return passed.unionByName(changed).unionByName(read)


def flow_events(edges: DataFrame, exprs: DataFrame, others: DataFrame) -> DataFrame:
    """What happens to each variable: method, symbol, name, var_kind, kind, line, detail, expr, callee, param, ord (by line, then kind, from 1).

    Edges tell what a variable is derived into, iterated into, passed to, or returned; reads are its names that are not written
    to (``exprs`` with target, and in_field for the receiver of a field); ``others`` are events as they stand, such as created
    and modified, of method, symbol, name, var_kind, kind, line, detail, expr.
    """
    s, t = F.col("source"), F.col("target")
    via = F.col("via")
    kind = F.when(via.isin("declare", "assign", "compound_assign"), "derived").when(via == "iterate", "iterated").when(via == "argument", "passed").when(via == "return", "returned")
    to = F.when(F.col("param").isNotNull(), F.concat(F.lit("to "), "detail", F.lit("("), "param", F.lit(")"))).otherwise(F.concat(F.lit("to "), F.regexp_replace(t["name"], r"#\d+$", "")))
    detail = F.when(via == "argument", to).when(via == "return", "returned").otherwise(F.concat(F.lit("into "), t["name"]))
    variable = s["kind"].isin("parameter", "local", "field") & s["symbol"].isNotNull()
    moved = edges.where(variable & kind.isNotNull() & F.col("source_expr").isNotNull())
    callee = F.when(via == "argument", F.col("callee"))
    moved = moved.select("method", s["symbol"].alias("symbol"), s["name"].alias("name"), s["kind"].alias("var_kind"), kind.alias("kind"), s["line"].alias("line"), detail.alias("detail"), F.col("source_expr").alias("expr"), callee.alias("callee"), F.when(via == "argument", F.col("param")).alias("param"))
    r = F.col("ref")
    named = value_refs(exprs).where(r["kind"].isin("parameter", "local", "field") & r["symbol"].isNotNull() & F.col("kind").isin("name_ref", "field_access"))
    reads = named.where("not coalesce(target, false) and not coalesce(in_field, false)")
    none = F.lit(None).cast("string")
    reads = reads.select("method", r["symbol"].alias("symbol"), r["name"].alias("name"), r["kind"].alias("var_kind"), F.lit("read").alias("kind"), "line", F.lit("").alias("detail"), "expr", none.alias("callee"), none.alias("param"))
    told = others.select("method", "symbol", "name", "var_kind", "kind", "line", "detail", "expr", none.alias("callee"), none.alias("param"))
    every = moved.unionByName(reads).unionByName(told)
    turn = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in {"created": 0, "read": 1, "passed": 2, "derived": 3, "iterated": 3}.items() for x in pair]), F.col("kind")), F.lit(5))
    order = Window.partitionBy("method", "symbol").orderBy("line", turn, "expr", "detail")
    return every.withColumn("ord", F.row_number().over(order))


def created_from(edges: DataFrame) -> DataFrame:
    """How each variable that is declared from values came to be: method, symbol, created, which names its first three sources."""
    s = F.col("source")
    said = F.when(s["kind"] == "call_result", F.concat(F.lit("call "), s["name"], F.lit("()"))).when(s["kind"] == "literal", s["text"]).otherwise(F.concat_ws(" ", s["kind"], s["name"]))
    first = Window.partitionBy("method", "target.symbol").orderBy(F.col("source_expr").isNotNull(), s["line"], "source_expr")
    rows = edges.where("via = 'declare' and target.symbol is not null").withColumns({"said": said, "n": F.row_number().over(first)}).where("n <= 3")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda x: x["said"]), ", ")
    return rows.groupBy("method", F.col("target.symbol").alias("symbol")).agg(F.concat(F.lit("initialized from "), text).alias("created"))


def reaching_writes(statements: DataFrame, accesses: DataFrame) -> DataFrame:
    """The writes of a variable that may be what a read sees: method, read, write.

    ``statements`` has method, id, kind, start and end; those of branches hold arms: the body of an if or a loop, an else, a case.
    ``accesses`` has method, id, symbol, kind (read or write) and at. An if, switch or try splits what is known of each
    variable among its arms, and joins it where it ends; without an else or default the way past all arms counts, too. A catch
    may start after any write of its try, a finally after any of its arms. A loop may run no time or many: what its body writes last
    is what reads at its start may see, unless they follow a write of the same round.

    One sorted pass per method, with the arms that are open on a stack, each holding only the variables that it wrote; so a task
    holds what one method knows at a place. Jumps out of blocks are not followed.
    """
    shape = nested(statements.where(F.col("kind").isin("if", "else_if", "else", "try", "catch", "finally", "switch", "case", "default", *LOOPS)))
    spans = statements.select("method", "id", "kind", "start", "end").join(shape.select("method", "id", "depth", "parent_kind"), ["method", "id"])
    none, zero = F.lit(None).cast("string"), F.lit(0)
    parts = ["method", "at", "turn", "depth", "kind", "id", "symbol"]
    opens = spans.select("method", F.col("start").alias("at"), F.lit(0).alias("turn"), "depth", F.concat(F.lit("open "), "kind").alias("kind"), F.col("id").cast("string").alias("id"), none.alias("symbol"))
    closes = spans.select("method", F.col("end").alias("at"), F.lit(2).alias("turn"), (-F.col("depth")).alias("depth"), F.lit("close").alias("kind"), F.col("id").cast("string").alias("id"), none.alias("symbol"))
    uses = accesses.select("method", "at", F.lit(1).alias("turn"), F.when(F.col("kind") == "read", zero).otherwise(1).alias("depth"), "kind", F.col("id").cast("string").alias("id"), "symbol")
    rows = opens.select(*parts).unionByName(closes.select(*parts)).unionByName(uses.select(*parts))
    schema = _schema(rows, "method").add("read", T.StringType()).add("write", T.StringType())
    return _swept(rows, ["at", "turn", "depth", "id"], _reaching, schema)


class _Frame:
    """An open statement: the variables that its current arm wrote, with the writes that may be the last, and how its closed arms ended."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self.now: dict[str, frozenset] = {}
        self.ends: list[dict[str, frozenset]] = []
        self.split = False  # an arm beside the body has begun
        self.whole = False  # one of the arms is always taken
        self.any: dict[str, set] = {}  # of a try: all that its body wrote
        self.waiting: dict[str, set] = {}  # of a loop: reads that its next round may feed


def _reaching() -> Callable[[Row], Iterator[tuple]]:
    """Reads and writes of one method in order. A frame in a set of writes stands for what the loop's round began with."""
    stack = [_Frame("method")]

    def known(symbol: str) -> frozenset:
        rounds = []
        for frame in reversed(stack):
            if symbol in frame.now:
                return frame.now[symbol].union(rounds)
            if frame.kind in LOOPS:
                rounds.append(frame)
        return frozenset(rounds)

    def joined(ends: list[dict[str, frozenset]]) -> dict[str, frozenset]:
        """What holds after any of ``ends``; one that did not write a variable leaves it as the stack knows it."""
        return {s: frozenset().union(*[end.get(s, known(s)) for end in ends]) for s in set().union(*ends)}

    def begin(kind: str) -> None:
        above, frame = stack[-1], _Frame(kind)
        if kind in ARMS.get(above.kind, []):
            if not above.split:
                above.split = True
                if above.kind != "switch":
                    above.ends.append(above.now)
                above.now = {}
            if kind == "finally":  # after whichever arm ran
                above.now, above.ends = joined(above.ends), []
            elif kind == "catch":  # after any part of the body
                frame.now = {s: known(s).union(writes) for s, writes in above.any.items()}
            above.whole = above.whole or kind in ("else", "default")
        stack.append(frame)

    def end(method: str) -> Iterator[tuple]:
        frame = stack.pop()
        above, arm = stack[-1], frame.kind != "finally" and frame.kind in ARMS.get(stack[-1].kind, [])
        if frame.kind in LOOPS:
            for symbol, reads in frame.waiting.items():
                for write in frame.now.get(symbol, ()):
                    if isinstance(write, str):
                        yield from ((method, read, write) for read in sorted(reads))
            # Only a do runs at least once; and a round that did not write leaves what was before.
            last = {s: known(s).union(w) if frame in w or frame.kind != "do" else w for s, w in frame.now.items()}
            above.now.update({s: w - {frame} for s, w in last.items()})
            return
        ends = frame.ends if frame.split and frame.kind in ARMS and frame.ends else [frame.now]
        if frame.kind in ("if", "switch") and not frame.whole:
            ends = [*ends, {}]  # past all arms
        result = joined(ends)
        if arm:
            above.ends.append(result)
            above.whole = above.whole or (frame.kind == "else_if" and frame.whole)
        else:
            above.now.update(result)

    def advance(row: Row | None) -> Iterator[tuple]:
        if row is None:
            return
        kind, symbol, id_ = row["kind"], row["symbol"], row["id"]
        if kind == "close":
            yield from end(row["method"])
        elif kind == "read":
            for write in known(symbol):
                if isinstance(write, str):
                    yield row["method"], id_, write
                else:
                    write.waiting.setdefault(symbol, set()).add(id_)
        elif kind == "write":
            stack[-1].now[symbol] = frozenset([id_])
            for frame in stack:
                if frame.kind == "try" and not frame.split:
                    frame.any.setdefault(symbol, set()).add(id_)
        else:
            begin(kind.removeprefix("open "))

    return advance
