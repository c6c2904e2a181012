"""Chains of calls on streams, each as one pipeline of operations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.sources.tables import gathered

# What operations of a stream do, by name, and collectors that make a group or one value of it.
CATEGORIES = {
    "source": ["stream", "parallelStream", "of", "range", "rangeClosed", "iterate", "generate"],
    "filter": ["filter", "takeWhile", "dropWhile", "distinct", "limit", "skip"],
    "map": ["map", "mapToInt", "mapToLong", "mapToDouble", "mapToObj", "flatMap", "boxed", "peek"],
    "sort": ["sorted"],
    "collect": ["collect", "toList", "toArray"],
    "aggregate": ["count", "sum", "min", "max", "average", "reduce", "summaryStatistics"],
    "match": ["anyMatch", "allMatch", "noneMatch"],
    "find": ["findFirst", "findAny"],
    "consume": ["forEach", "forEachOrdered"],
}
GROUPING = ["groupingBy", "groupingByConcurrent", "partitioningBy"]
AGGREGATING = ["counting", "summingInt", "summingLong", "summingDouble", "averagingInt", "averagingLong", "averagingDouble", "minBy", "maxBy", "reducing", "summarizingInt", "summarizingLong", "summarizingDouble"]


def category(name: Column) -> Column:
    """What an operation of this name does; ``other`` for one that is not known."""
    says = F.create_map(*[x for kind, names in CATEGORIES.items() for n in names for x in (F.lit(n), F.lit(kind))])
    return F.coalesce(F.try_element_at(says, name), F.lit("other"))


def _whole_methods(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of whole methods of rows sorted by method, with the number of each row's method within its block."""
    held: list[pa.Table] = []

    def numbered(block: pa.Table) -> np.ndarray:
        m = block["method"].combine_chunks()
        a, b = m.slice(1), m.slice(0, len(m) - 1)
        new = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        return np.concatenate([[0], np.cumsum(new.to_numpy(zero_copy_only=False))])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        # Whether a method ends within the batch is read off the last row held, and the batch.
        edge = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        number = numbered(pa.concat_tables([*edge, rows]))[len(edge) :]
        cut = int(np.searchsorted(number, number[-1])) if number[-1] > 0 else None
        if cut is None:
            held.append(rows)
            continue
        block = pa.concat_tables([*held, rows.slice(0, cut)]).combine_chunks()
        yield block, numbered(block)
        held = [rows.slice(cut)]
    if held:
        block = pa.concat_tables(held).combine_chunks()
        yield block, numbered(block)


def _steps(method: np.ndarray, expr: pa.Array, receiver: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each call the row that its chain of receivers starts from, and how many links away that is, by doubling the links."""
    n = len(expr)
    names = pa.concat_arrays([expr, receiver]).dictionary_encode().indices
    code = pc.fill_null(names, -1).to_numpy().astype(np.int64)
    span = int(code.max(initial=0)) + 2
    own, to = method * span + code[:n] + 1, method * span + code[n:] + 1
    order = np.argsort(own, kind="stable")
    place = np.minimum(np.searchsorted(own, to, sorter=order), n - 1)
    found = order[place]
    linked = (code[n:] >= 0) & (own[found] == to)
    root, steps = np.where(linked, found, np.arange(n)), linked.astype(np.int64)
    for _ in range(n.bit_length() + 1):  # receivers run in no circle
        further = steps[root]
        if not further.any():
            break
        root, steps = root[root], steps + further
    return root, steps


def _within(method: np.ndarray, start: list, end: list, outer: np.ndarray, inner: np.ndarray) -> dict[int, list[int]]:
    """The inner rows that each outer row of their method properly contains, for rows sorted by method, start and falling end."""
    found: dict[int, list[int]] = {}
    if not inner.any():
        return found
    open_: list[int] = []
    at = None
    for i in np.flatnonzero(outer | inner).tolist():
        if start[i] is None or end[i] is None:
            continue
        if method[i] != at:
            open_, at = [], method[i]
        open_ = [o for o in open_ if end[o] >= start[i]]
        if inner[i]:
            for o in open_:
                if end[i] <= end[o] and (start[o], end[o]) != (start[i], end[i]):
                    found.setdefault(o, []).append(i)
        if outer[i]:
            open_.append(i)
    return found


def _chains(calls: DataFrame, each: Sequence[str], first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """One row for each chain: method, pipeline, ops (``each`` and collectors, in order), within, and ``first`` and ``last`` of those calls.

    ``collectors`` are names of the collectors within a ``collect``, ``within`` targets of other calls within the chain; null if none. Calls
    are dealt once, by method, and sorted; a task holds whole methods in Arrow batches. What it holds at a time has a bound: a
    method has at most 65,535 bytes of code, so some 20,000 calls.
    """
    kind = F.col("kind")
    target = F.col("target") if "target" in calls.columns else F.lit(None).cast("string")
    role = F.when(kind == "stream", 0).when(kind == "collector", 1).when(kind.isNotNull() & target.isNotNull(), 2)
    told = F.when(role == 1, F.col("name")).when(role == 2, target)
    carried = list(dict.fromkeys(["expr", "receiver", *each, *first, *last]))
    rows = calls.select("method", role.alias("_role"), ((role == 0) & F.coalesce(F.col("name") == "collect", F.lit(False))).alias("_collects"), told.alias("_told"), "start", "end", *carried).where("_role is not null")
    types = {f.name: f.dataType for f in rows.schema}
    texts = T.ArrayType(T.StringType())
    op = T.StructType([*[T.StructField(c, types[c]) for c in each], T.StructField("collectors", texts)])
    schema = T.StructType([T.StructField("method", types["method"]), T.StructField("pipeline", types["expr"]), T.StructField("ops", T.ArrayType(op)), T.StructField("within", texts)])
    for c in (*first, *last):
        schema = schema.add(c, types[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, method in _whole_methods(batches):
            role = block["_role"].to_numpy()
            at = np.flatnonzero(role == 0)
            if not len(at):
                continue
            start, end, told = block["start"].to_pylist(), block["end"].to_pylist(), block["_told"].to_pylist()
            by_place = lambda i: (start[i], end[i], told[i] is None, told[i] or "")
            names = lambda found, rows: pa.array([[told[i] for i in sorted(found[r], key=by_place)] if r in found else None for r in rows.tolist()], pa.list_(pa.string()))
            stream = block.take(at)
            root, steps = _steps(method[at], stream["expr"].combine_chunks(), stream["receiver"].combine_chunks())
            order = np.lexsort((steps, root))
            begins = np.flatnonzero(np.diff(root[order], prepend=-1))
            ends = np.append(begins[1:], len(order)) - 1
            heads, tails = at[order[begins]], at[order[ends]]
            held = _within(method, start, end, block["_collects"].to_numpy(), role == 1)
            outer = np.zeros(len(role), bool)
            outer[tails] = True
            within = _within(method, start, end, outer, role == 2)
            ops = block.select(list(each)).take(at[order])
            made = pa.StructArray.from_arrays([*[ops[c].combine_chunks() for c in each], names(held, at[order])], [*each, "collectors"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)), pa.int32()), made)
            columns = [block["method"].take(tails), block["expr"].take(tails), lists, names(within, tails), *[block[c].take(heads) for c in first], *[block[c].take(tails) for c in last]]
            yield from pa.table(columns, names=schema.names).to_batches()

    return gathered(rows, "method", order=["method", "start", F.desc("end"), "expr"]).mapInArrow(run, schema)


def _done(o: Column) -> Column:
    """What an operation does, which a ``collect`` whose collectors group or aggregate does itself."""
    some = lambda kinds: F.exists(o["collectors"], lambda c: c.isin(kinds))
    return F.when(o["collectors"].isNull(), o["category"]).when(some(GROUPING), "group").when(some(AGGREGATING), "aggregate").otherwise(o["category"])


def _collectors(o: Column) -> Column:
    return F.coalesce(o["collectors"], F.array().cast("array<string>"))


def operations(calls: DataFrame) -> DataFrame:
    """The operations of each pipeline: method, pipeline (the call that ends it), ord (from 1), expr, name, category, args, collectors, line.

    ``calls`` has method, expr, name, receiver (the expr of the method that it is called on), args, line, start, end, and kind: stream for
    a call on or of a stream, collector for one that makes a collector, anything else otherwise. The last call of a chain names it. A
    ``collect`` whose collectors, however deep, group or aggregate does so itself.
    """
    found = _chains(calls.withColumn("category", category(F.col("name"))), ["expr", "name", "category", "args", "line"])
    rows = found.select("method", "pipeline", F.posexplode("ops").alias("k", "o"))
    o = F.col("o")
    return rows.select("method", "pipeline", (F.col("k") + 1).alias("ord"), "o.expr", "o.name", _done(o).alias("category"), "o.args", _collectors(o).alias("collectors"), "o.line")


def pipelines(calls: DataFrame) -> DataFrame:
    """One row for each pipeline: method, pipeline, source, ops (name and category, in order), detail, text, calls.

    ``calls`` also has scope (the text it is called on), text, and target (the method of the project that it means, if any).
    The source is what the stream is made of, or the call that makes it; ``detail`` names operations and then collectors; ``calls``
    are the methods of the project that are called within, as in lambdas, in order.
    """
    source = F.when(F.col("name").isin("stream", "parallelStream") & F.col("scope").isNotNull(), F.col("scope")).otherwise(F.col("text"))
    found = _chains(calls.withColumns({"category": category(F.col("name")), "source": source}), ["name", "category"], ["source"], ["text"])
    told = F.concat(F.transform("ops", lambda o: o["name"]), F.flatten(F.transform("ops", _collectors)))
    shown = F.transform("ops", lambda o: F.struct(o["name"].alias("name"), _done(o).alias("category")))
    return found.select("method", "pipeline", "source", shown.alias("ops"), F.array_join(told, " > ").alias("detail"), "text", F.coalesce("within", F.array().cast("array<string>")).alias("calls"))
