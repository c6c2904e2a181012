"""Traversals of edge tables, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.sources.tables import durable, written

#: About the most neighbours of a node that travel as one list.
NEIGHBOURS = 1000
#: Starts that are followed together, one to a bit of a long.
STARTS = 64
#: Blocks of starts that one task numbers, and up to which their lists are broadcast.
BLOCKS = 4000


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps of each start: (start, node, depth), each once at its least depth, the start itself left out.

    ``edges`` (src, dst) and ``starts`` (start). One join per level; visited nodes are struck off, so cycles end. Starts are
    numbered in their order, and those of a block of ``STARTS`` are bits of one long: what is joined, dealt and written is a row
    for each node and block, whose bits say which starts reach it. In a dense graph most steps lead to nodes that other steps
    reach, too; their bits are put together before they are dealt. Only the result has a row for each start and node.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    part = F.pmod(F.xxhash64(F.lit(1), "dst"), F.ceil(F.count("*").over(Window.partitionBy("src")) / NEIGHBOURS)).alias("part")
    lists = written(edges.select("src", "dst", part).groupBy("src", "part").agg(F.collect_list("dst").alias("dsts")).select("src", "dsts"))
    starts = written(starts.where("start is not null").select("start").distinct())
    dealt = starts.repartitionByRange(1 + starts.count() // (STARTS * BLOCKS), "start").sortWithinPartitions("start")
    starts = written(dealt.select("start", F.monotonically_increasing_id().alias("n")))
    starts = starts.select("start", F.floor(F.col("n") / STARTS).alias("block"), F.pmod("n", F.lit(STARTS)).cast("int").alias("bit"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    frontier = starts.select(F.col("start").alias("node"), "block", bit.alias("bits"))
    seen = frontier.withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        step = frontier.join(lists, frontier.node == lists.src).select(F.explode("dsts").alias("node"), "block", "bits", F.lit(0).cast("long").alias("old"))
        step = step.unionByName(seen.select("node", "block", "bits", F.col("bits").alias("old")))
        step = step.groupBy("node", "block").agg(F.bit_or("bits").bitwiseAND(F.bitwise_not(F.bit_or("old"))).alias("bits"))
        frontier = written(step.where("bits <> 0"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(level)))
    blocks = written(starts.groupBy("block").agg(F.collect_list(F.struct("bit", "start")).alias("starts")))
    found = seen.where("depth > 0").join(F.broadcast(blocks) if blocks.count() <= BLOCKS else blocks, "block")
    one = F.filter("starts", lambda s: F.call_function("shiftrightunsigned", F.col("bits"), s["bit"]).bitwiseAND(1) != 0)
    return found.select(F.explode(one).alias("s"), "node", "depth").select("s.start", "node", "depth")


def _peeled(edges: DataFrame) -> DataFrame:
    """``edges`` without those that lead from or to a node which no edge, or none but such, enters or leaves."""
    n = edges.count()
    while n:
        enters, leaves = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = durable(edges.join(enters, "src", "left_semi").join(leaves, "dst", "left_semi").select("src", "dst"))
        if (now := edges.count()) == n:
            break
        n = now
    return edges


def on_cycle(edges: DataFrame) -> DataFrame:
    """Nodes that a path leads back to.

    Edges that are on no cycle, for nothing leads to or from them, are peeled off. In what is left every node takes the
    greatest node that reaches it for its color; the nodes that, within a color, lead back to the node it is named after are
    one component of mutual reach. Components of two nodes or more, and nodes with an edge to themselves, are on cycles;
    they are taken out and the rest is done again. Only nodes and edges are ever held, never pairs of nodes that reach each other.
    """
    edges = durable(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    found = edges.where("src = dst").select(F.col("src").alias("node"))
    edges = _peeled(edges.where("src <> dst"))
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        colors, before = durable(nodes.withColumn("color", F.col("node"))), None
        while before != (before := colors.agg(F.sum(F.xxhash64("node", "color").cast("decimal(38,0)"))).first()[0]):
            given = edges.join(colors, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "color")
            colors = durable(colors.unionByName(given).groupBy("node").agg(F.max("color").alias("color")))
        ends = [colors.select(F.col("node").alias(e), F.col("color").alias(f"{e}_color")) for e in ("src", "dst")]
        within = durable(edges.join(ends[0], "src").join(ends[1], "dst").where("src_color = dst_color").select("src", "dst"))
        back = durable(colors.where("node = color").select("node"))
        front = back
        while not front.isEmpty():
            step = within.join(front, F.col("dst") == F.col("node")).select(F.col("src").alias("node")).distinct()
            front = durable(step.join(back, "node", "left_anti"))
            back = durable(back.unionByName(front))
        sizes = colors.join(back, "node").groupBy("color").agg(F.count("*").alias("n")).where("n > 1")
        found = durable(found.unionByName(colors.join(back, "node").join(sizes, "color", "left_semi").select("node")).distinct())
        rest = edges.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti")
        edges = _peeled(durable(rest.select("src", "dst")))
    return found


def preorder(nodes: DataFrame, tree: str, id_: str, parent: str, order: str) -> DataFrame:
    """Add ``depth`` and ``ord``, the place in preorder from 1, to the rows of trees; siblings come by ``order`` and then id.

    The path from the root, a list of (order, id), is handed down a level at a time, one join each. Rows whose parents lead
    to no root, around a cycle or out of the table, are left out.
    """
    step = F.struct(F.col(order).alias("o"), F.col(id_).alias("i"))
    rows = durable(nodes.withColumn("_step", step))
    front = rows.where(F.col(parent).isNull()).withColumn("_path", F.array("_step"))
    found = front
    while True:
        above = front.select(F.col(tree).alias("_tree"), F.col(id_).alias("_above"), F.col("_path").alias("_up"))
        below = rows.where(F.col(parent).isNotNull()).join(above, (F.col(tree) == F.col("_tree")) & (F.col(parent) == F.col("_above")))
        front = durable(below.withColumn("_path", F.concat("_up", F.array("_step"))).drop("_tree", "_above", "_up"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    place = F.row_number().over(Window.partitionBy(tree).orderBy("_path"))
    return found.withColumns({"depth": F.size("_path") - 1, "ord": place}).drop("_step", "_path")


def shortest_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops, path) within ``depth`` hops; of equally short paths the least, as text of nodes."""
    edges = durable(edges.where("src <> dst").select("src", "dst").distinct())
    frontier = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct()
    seen = frontier.withColumn("hops", F.lit(0))
    for level in range(1, depth + 1):
        step = frontier.join(edges, frontier.node == edges.src).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        best = step.groupBy("start", "node").agg(F.min("path").alias("path"))
        frontier = durable(best.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(level)))
    return seen.where("hops > 0")


def reach_calls(edges: DataFrame, starts: DataFrame, depth: int, overrides: DataFrame | None = None, candidates: bool = True, forward: bool = True) -> DataFrame:
    """Methods within ``depth`` calls of each start, with how they were first met: start, node, depth, edge, ambiguous, via_override.

    ``edges`` has edge, caller, ord, status and targets; ``overrides`` (method, implementation). Ambiguous calls lead to all
    their targets, or to none unless ``candidates``. Forward, a target leads to its implementations, too, if ``overrides``
    are given. Of several ways to a method on one level the one from the least caller counts, then the first edge, then a call
    before an override; the start itself is never met.
    """
    ambiguous = F.col("status") == "ambiguous"
    usable = edges if candidates else edges.where(~ambiguous)
    rows = usable.select("edge", "caller", "ord", ambiguous.alias("ambiguous"), F.explode("targets").alias("target"))
    src, dst = ("caller", "target") if forward else ("target", "caller")
    steps = rows.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "edge", "ord", "ambiguous", F.lit(False).alias("via_override"))
    if overrides is not None and forward:
        through = rows.join(overrides.select(F.col("method").alias("target"), "implementation"), "target")
        steps = steps.unionByName(through.select(F.col("caller").alias("src"), F.col("implementation").alias("dst"), "edge", "ord", "ambiguous", F.lit(True).alias("via_override")))
    steps = durable(steps)
    way = F.struct("src", "ord", "via_override", "edge", "ambiguous")
    frontier = starts.select("start", F.col("start").alias("node")).distinct()
    seen, found = frontier, None
    for level in range(1, depth + 1):
        met = frontier.join(steps, frontier.node == steps.src).groupBy("start", F.col("dst").alias("node")).agg(F.min(way).alias("way"))
        new = durable(met.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if new.isEmpty():
            break
        frontier = new.select("start", "node")
        seen = seen.unionByName(frontier)
        found = new if found is None else found.unionByName(new)
    if found is None:
        found = steps.where("false").select(F.col("src").alias("start"), F.col("dst").alias("node"), way.alias("way"), F.lit(0).alias("depth"))
    return found.select("start", "node", "depth", "way.edge", "way.ambiguous", "way.via_override")
