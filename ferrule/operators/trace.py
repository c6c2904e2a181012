"""Where a value comes from and where it goes, across methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.sources.tables import written

_KEY = ["start", "method", "symbol"]
_STEP = "start string, direction string, kind string, depth int, method string, symbol string, at string, other string, line int"
_STOP = "start string, direction string, reason string, depth int, method string, symbol string, other string"


class _Found:
    """Steps and stops of a search, by direction, as tables that are united at the end."""

    def __init__(self, direction: str) -> None:
        self.direction = direction
        self.steps: list[DataFrame] = []
        self.stops: list[DataFrame] = []

    def step(self, rows: DataFrame, kind: Column | str, at: str = "method", other: Column | str | None = None, line: str | None = "line", more: int = 0) -> None:
        said = F.lit(other).cast("string") if other is None or isinstance(other, str) else other
        kind = F.lit(kind) if isinstance(kind, str) else kind
        self.steps.append(rows.select("start", F.lit(self.direction).alias("direction"), kind.alias("kind"), (F.col("depth") + more).alias("depth"), "method", "symbol", F.col(at).alias("at"), said.alias("other"), (F.col(line) if line else F.lit(None)).cast("int").alias("line")))

    def stop(self, rows: DataFrame, reason: str, other: Column | None = None) -> None:
        said = F.lit(None).cast("string") if other is None else other.cast("string")
        self.stops.append(rows.select("start", F.lit(self.direction).alias("direction"), F.lit(reason).alias("reason"), "depth", "method", "symbol", said.alias("other")).distinct())


def _first(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` and ``n`` within what one variable of the frontier leads to."""
    whole = Window.partitionBy(*_KEY)
    return rows.withColumns({"rank": F.row_number().over(whole.orderBy(*order)), "n": F.count("*").over(whole)})


def _new(rows: DataFrame, seen: DataFrame, variables: DataFrame) -> DataFrame:
    """Variables that exist and were not met before, once for each start."""
    known = variables.select("method", "symbol").distinct()
    return rows.select(*_KEY, "depth").groupBy(*_KEY).agg(F.min("depth").alias("depth")).join(known, ["method", "symbol"], "left_semi").join(seen, _KEY, "left_anti")


def _upstream(front: DataFrame, variables: DataFrame, edges: DataFrame, events: DataFrame, depth: int, breadth: int, found: _Found) -> None:
    s, t = F.col("source"), F.col("target")
    arguments = edges.where("via = 'argument' and callee is not null").select(F.col("callee").alias("method"), F.col("param").alias("name"), F.col("method").alias("caller"), "line", s["kind"].alias("kind_from"), s["name"].alias("name_from"), s["symbol"].alias("symbol_from"))
    incoming = edges.where("via <> 'return'").select("method", t["symbol"].alias("symbol"), "via", "line", s["kind"].alias("kind_from"), s["name"].alias("name_from"), s["symbol"].alias("symbol_from"))
    writers = events.where("kind = 'modified'").select("symbol", F.col("method").alias("writer")).distinct()
    returned = edges.where("via = 'return'").select(F.col("method").alias("callee"), s["symbol"].alias("symbol_from")).distinct()
    returned = returned.join(variables.select(F.col("method").alias("callee"), F.col("symbol").alias("symbol_from"), "declared", "name"), ["callee", "symbol_from"])
    seen, last = front.select(*_KEY), depth - 1
    for level in range(depth):
        at = written(front.join(variables, ["method", "symbol"]))
        parameters, fields, locals_ = at.where("kind = 'parameter'"), at.where("kind = 'field'"), at.where("kind not in ('parameter', 'field')")
        sites = written(_first(parameters.join(arguments, ["method", "name"]), ["caller", "line", "symbol_from", "name_from"]))
        shown = sites.where(F.col("rank") <= breadth)
        found.step(shown, "passed_in", "caller", F.concat_ws(" ", "kind_from", "name_from"))
        found.stop(parameters.join(sites, _KEY, "left_anti"), "entry_point")
        found.stop(sites.where(F.col("n") > breadth), "more_sites", F.col("n") - breadth)
        written_in = written(_first(fields.join(writers, "symbol"), ["writer"]))
        found.step(written_in.where(F.col("rank") <= breadth), "written_in", "writer", line=None)
        found.stop(fields.join(written_in, _KEY, "left_anti"), "never_written")
        taken = written(_first(locals_.join(incoming, ["method", "symbol"]), ["line", "via", "kind_from", "name_from", "symbol_from"]).where(F.col("rank") <= 2 * breadth))
        found.step(taken, F.col("via"), other=F.concat_ws(" ", "kind_from", "name_from"))
        found.step(locals_.join(taken, _KEY, "left_anti").where("created is not null"), "created", other=F.col("created"), line="declared")
        calls = taken.where("kind_from = 'call_result'")
        found.stop(calls.where("symbol_from is null"), "library", F.col("name_from"))
        if level == last:
            found.stop(sites, "depth_limit")
            found.stop(taken.where("kind_from = 'parameter' or (kind_from = 'call_result' and symbol_from is not null)"), "depth_limit", F.col("name_from"))
            return
        entered = calls.where("symbol_from is not null").withColumnRenamed("symbol_from", "callee")
        found.step(entered, "callee_returns", "callee", line=None, more=1)
        ways = entered.select("start", "method", "symbol", "depth", "callee").distinct().join(returned, "callee")
        given = ways.withColumn("rank", F.row_number().over(Window.partitionBy(*_KEY, "callee").orderBy("declared", "name", "symbol_from"))).where(F.col("rank") <= breadth)
        deeper = (F.col("depth") + 1).alias("depth")
        reached = [
            shown.where("symbol_from is not null").select("start", F.col("caller").alias("method"), F.col("symbol_from").alias("symbol"), deeper),
            taken.where("kind_from in ('parameter', 'local', 'field')").select("start", "method", F.col("symbol_from").alias("symbol"), deeper),
            given.select("start", F.col("callee").alias("method"), F.col("symbol_from").alias("symbol"), deeper),
        ]
        front = written(_new(reduce(DataFrame.unionByName, reached), seen, variables))
        if front.isEmpty():
            return
        seen = written(seen.unionByName(front.select(*_KEY)))


def _downstream(front: DataFrame, variables: DataFrame, edges: DataFrame, events: DataFrame, depth: int, breadth: int, found: _Found) -> None:
    s, t = F.col("source"), F.col("target")
    derived = edges.where("via in ('declare', 'assign', 'compound_assign') and source.symbol <> target.symbol").select("method", s["symbol"].alias("symbol"), t["symbol"].alias("into"), t["name"].alias("into_name"), "line")
    passed = events.where("kind = 'passed'").select("method", "symbol", "detail", "line", "callee", "param")
    returns = events.where("kind = 'returned'").select("method", "symbol").distinct()
    uses = edges.where("source.kind = 'call_result' and source.symbol is not null").select(s["symbol"].alias("method"), F.col("method").alias("caller"), "via", t["name"].alias("name_to"), t["symbol"].alias("symbol_to"), "line")
    inside = events.where("kind not in ('read', 'created')").select(F.col("method").alias("callee"), F.col("symbol").alias("inner"), F.col("kind").alias("does"), F.col("detail").alias("how"), F.col("line").alias("there"))
    params = variables.where("kind = 'parameter'").select(F.col("method").alias("callee"), F.col("name").alias("param"), F.col("symbol").alias("inner"))
    seen, last = front.select(*_KEY), depth - 1
    for level in range(depth):
        # What a value is derived into is as deep as the value: the level is closed first.
        at = front
        while True:
            more = at.join(derived, ["method", "symbol"]).select("start", "method", F.col("into").alias("symbol"), "depth")
            at = written(_new(more, seen, variables))
            if at.isEmpty():
                break
            seen = written(seen.unionByName(at.select(*_KEY)))
            front = written(front.unionByName(at.select(*front.columns)))
        found.step(front.join(derived, ["method", "symbol"]), "derived", other=F.col("into_name"))
        sent = front.join(passed, ["method", "symbol"])
        outside = sent.where("callee is null")
        found.step(outside, "passed_external", other=F.col("detail"))
        found.stop(outside, "library", F.col("detail"))
        found.step(sent.where("callee is not null"), "passed", "callee", F.col("param"))
        back = front.join(returns, ["method", "symbol"])
        found.step(back, "returned", line=None)
        if level == last:
            found.stop(sent.where("callee is not null"), "depth_limit", F.col("callee"))
            found.stop(back, "depth_limit")
            return
        into = written(sent.where("callee is not null").join(params, ["callee", "param"]).select(*_KEY, "depth", "callee", "inner").distinct())
        found.step(into.join(inside, ["callee", "inner"]), F.col("does"), "callee", F.col("how"), "there", more=1)
        used = written(_first(back.join(uses, "method"), ["caller", "line", "via", "name_to", "symbol_to"]))
        found.stop(back.join(used, _KEY, "left_anti"), "no_user")
        used = used.where(F.col("rank") <= breadth)
        found.step(used, "used_by_caller", "caller", F.concat_ws(" ", "via", "name_to"), more=1)
        deeper = (F.col("depth") + 1).alias("depth")
        reached = into.select("start", F.col("callee").alias("method"), F.col("inner").alias("symbol"), deeper)
        reached = reached.unionByName(used.where("via in ('declare', 'assign')").select("start", F.col("caller").alias("method"), F.col("symbol_to").alias("symbol"), deeper))
        front = written(_new(reached, seen, variables))
        if front.isEmpty():
            return
        seen = written(seen.unionByName(front.select(*_KEY)))


def trace(starts: DataFrame, variables: DataFrame, edges: DataFrame, events: DataFrame, depth: int = 2, breadth: int = 5) -> tuple[DataFrame, DataFrame]:
    """The steps that a value takes before and after it is in a variable, and why each way ends.

    ``starts`` has start, method and symbol; ``variables`` method, symbol, name, kind, created and declared; ``edges`` and
    ``events`` are those of ``flow``. A search goes over two kinds of edges: within a method, from value to value, and between
    methods, from an argument to its parameter or from a result to what the caller does with it. Levels count changes of
    method, and upstream also steps back to another value; what a value is derived into is as deep as the value. A frontier is
    joined with the edges once a level for all starts; a variable is met once for each start, so cycles end. Of the ways from one variable
    ``breadth`` are followed, in order of caller and line (twice as many within a method), and the number of others is told.

    Returns steps (start, direction, kind, depth, method, symbol: where the value was; at, other, line: where it is seen next) and
    stops (start, direction, reason, depth, method, symbol, other). Reasons: entry_point (no caller of the project passes it),
    library (no source), never_written, more_sites, no_user, depth_limit.
    """
    spark = starts.sparkSession
    front = starts.select("start", "method", "symbol", F.lit(0).alias("depth")).join(variables.select("method", "symbol"), ["method", "symbol"], "left_semi").distinct()
    front, edges, events = written(front.select(*_KEY, "depth")), written(edges), written(events)
    up, down = _Found("upstream"), _Found("downstream")
    _upstream(front, variables, edges, events, depth, breadth, up)
    _downstream(front, variables, edges, events, depth, breadth, down)
    steps = reduce(DataFrame.unionByName, [*up.steps, *down.steps], spark.createDataFrame([], _STEP))
    stops = reduce(DataFrame.unionByName, [*up.stops, *down.stops], spark.createDataFrame([], _STOP))
    return steps, stops.distinct()
