"""Fixpoints over edge tables: closures, minimum depths and strongly connected components.

Rounds of joins; each stores what it finds as a table (compressed, unlike a checkpoint), and only counts come back to the driver.
Nothing is collected. Nulls are no nodes. Chains and rings of any length take a logarithm of rounds: a node with a single way on
is jumped over, by tables of its 1st, 2nd, 4th, 8th ... follower. What is left then needs as many rounds as it is deep.
The whole closure of a graph of few edges is the one thing whose sources some tasks share, each with all edges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import sketch
from ledgerline.shipping import shipped
from ledgerline.storage import stored as checkpointed  # what a round finds is kept as a compressed table

MOST_ROUNDS = 1000
#: Edges of a graph that tasks are given whole for its closure.
CLOSURE_IN_ONE_TASK = 5_000
#: Edges of a graph from which on those that lead no further, or are on no cycle, are told apart before the rounds.
SPLIT_OVER = 5_000
#: Rounds of a search after which nodes with a single way on are jumped over.
PATIENCE = 8
#: A pass over the nodes with a single way on goes on while it takes away one edge in so many.
WORTH = 10
#: Tasks that share the sources of such a closure.
SHARES = 16
#: Frontiers that are kept apart before they are written as one.
PARTS = 16
#: Rounds of taking out nodes that have no edge in or out, before chains are contracted.
TRIMS = 2


class _Parts:
    """A growing table as a list of written parts, so that a round writes only what is new."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > PARTS:
            self.parts = [checkpointed(self.whole())]

    def whole(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


class _Graph:
    """Nodes as numbers and their successors, from two Arrow columns."""

    def __init__(self, source: pa.ChunkedArray, target: pa.ChunkedArray):
        both = pa.chunked_array([*source.chunks, *target.chunks], source.type).combine_chunks()
        coded = both.dictionary_encode()
        self.names = coded.dictionary
        ids = coded.indices.to_numpy().astype(np.int64)
        self.source, self.target = ids[: len(source)], ids[len(source) :]
        order = np.argsort(self.source, kind="stable")
        self.next = self.target[order]
        self.first = np.searchsorted(self.source[order], np.arange(len(self.names) + 1))

    def after(self, nodes: np.ndarray) -> np.ndarray:
        """The successors of all of these nodes."""
        lengths = self.first[nodes + 1] - self.first[nodes]
        at = np.repeat(self.first[nodes] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        return self.next[at]

    def depths(self, start: np.ndarray) -> np.ndarray:
        """The least number of steps to each node from any of ``start`` (0 for these); -1 where there is no way."""
        depth = np.full(len(self.names), -1, dtype=np.int32)
        depth[start] = 0
        frontier, n = np.unique(start), 0
        while len(frontier):
            n += 1
            frontier = np.unique(self.after(frontier))
            frontier = frontier[depth[frontier] < 0]
            depth[frontier] = n
        return depth


def _in_one_task(edges: DataFrame, by: tuple[str, ...], solve: Callable[[pa.Table, _Graph], dict], columns: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """``solve`` on each group's edges; it returns the result's columns beside ``by``."""
    kinds = dict(edges.dtypes)
    rows = edges if by or keys else edges.withColumn("_all", F.lit(0))
    groups = (*by, *keys) or ("_all",)

    def run(table: pa.Table) -> pa.Table:
        real = table.filter(pc.is_valid(table.column("source")))
        out = solve(table, _Graph(real.column("source"), real.column("target")))
        n = len(next(iter(out.values())))
        return pa.table({**{c: pa.repeat(table.column(c)[0], n) for c in by}, **out})

    schema = ", ".join(f"`{c}` {k}" for c, k in {**{c: kinds[c] for c in by}, **columns}.items())
    return shipped(rows).groupBy(*groups).applyInArrow(run, schema)


def _plain(edges: DataFrame, by: tuple[str, ...], unique: bool = False) -> DataFrame:
    rows = edges.select(*by, "source", "target").where("source is not null and target is not null")
    return rows if unique else checkpointed(rows.distinct())


def _through(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The cells of the nodes with an edge in and an edge out: no way leads through the others, and no cycle."""
    ins, outs = (edges.select(*by, F.col(end).alias("node")).distinct() for end in ("target", "source"))
    return checkpointed(sketch.cells(ins.join(outs, [*by, "node"], "left_semi")))


def _jumps(edges: DataFrame, by: tuple[str, ...]) -> tuple[list[DataFrame], list[DataFrame], DataFrame] | None:
    """Followers of the nodes with a single edge out (``single``): None where there is no such node.

    Tables (``by``, node, to) of the 1st, 2nd, 4th ... follower, or the end of the way where it comes
    sooner; the same of the rows alone that lead to a single node again; and (``by``, node) of those on rings. They are
    as many as the logarithm of the longest way: once the set of followers stays the same, it is the rings.
    """
    single = checkpointed(edges.groupBy(*by, F.col("source").alias("node")).agg(F.count("*").alias("n"), F.min("target").alias("to")).where("n = 1").drop("n"))
    if single.isEmpty():
        return None
    domain = single.select(*by, F.col("node").alias("to"))
    tables, inside, before = [single], [], None
    while True:
        inside.append(checkpointed(tables[-1].join(domain, [*by, "to"], "left_semi").select(*by, "node", "to")))
        image = checkpointed(inside[-1].select(*by, F.col("to").alias("node")).distinct())
        n = image.count()
        if n in (0, before):
            return tables, inside, image
        before = n
        further = tables[-1].select(*by, F.col("node").alias("to"), F.col("to").alias("further"))
        tables.append(checkpointed(tables[-1].join(further, [*by, "to"], "left").select(*by, "node", F.coalesce("further", "to").alias("to"))))


def _along(marks: DataFrame, tables: list[DataFrame], by: tuple[str, ...]) -> DataFrame:
    """``marks`` (``by``, node and more) with all that follow their nodes by the tables."""
    more = [c for c in marks.columns if c not in (*by, "node")]
    for table in tables:
        marks = checkpointed(marks.unionByName(marks.join(table, [*by, "node"]).select(*by, F.col("to").alias("node"), *more)).distinct())
    return marks


def reachable(seeds: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes (``by`` columns and ``node``) reached from ``seeds`` along ``edges`` (``by``, source, target), seeds included.

    Semi-naive: a round follows the edges of the nodes new in the round before; in a long search also all of the way
    that a node with a single edge begins.
    """
    key = [*by, "node"]
    start = checkpointed(seeds.select(*key).where("node is not null").distinct())
    # Edges back into the seeds lead to nothing new: a sketch of the targets outside leaves out most of them.
    outside = edges.select(*by, F.col("target").alias("node")).distinct().join(start, key, "left_anti")
    plain = _plain(sketch.maybe(edges, sketch.cells(outside), *by, "target"), by)
    steps = plain.select(*by, F.col("source").alias("node"), F.col("target").alias("next"))
    seen, frontier, jumps = _Parts(start), start, None
    for turn in range(MOST_ROUNDS):
        if turn == PATIENCE:
            jumps = _jumps(plain, by)
        new = frontier.join(steps, key).select(*by, F.col("next").alias("node")).distinct()
        if jumps:
            new = _along(checkpointed(new), jumps[0], by)
        frontier = checkpointed(new.join(seen.whole(), key, "left_anti"))
        if frontier.isEmpty():
            return seen.whole()
        seen.add(frontier)
    raise RuntimeError(f"the closure has not settled after {MOST_ROUNDS} rounds")


def depths(edges: DataFrame, by: tuple[str, ...] = (), most: int | None = None, in_one_task: int = CLOSURE_IN_ONE_TASK, unique: bool = False, split_over: int = SPLIT_OVER) -> DataFrame:
    """(``by``, source, target, depth): the least number of edges from source to target, at least one.

    Breadth-first from all sources, so the result is the whole closure: for sparse graphs, or with
    ``most`` rounds. A graph of few edges is copied to some tasks, which share its sources. ``unique`` says that the
    edges are a stored table without repeats.
    """
    key = [*by, "source", "target"]
    plain = _plain(edges, by, unique)
    n = plain.count()
    if n > max(in_one_task, split_over):
        # Sources all of whose edges end where no way goes on have these edges alone. The others, and what ways lead through, keep all of theirs.
        through = _through(plain, by)
        starts = sketch.cells(sketch.maybe(plain, through, *by, "target").select(*by, "source"))
        cells = checkpointed(through.unionByName(starts).distinct())
        core = checkpointed(sketch.maybe(plain, cells, *by, "source"))
        if core.count() < n:
            far = sketch.never(plain, cells, *by, "source").select(*key, F.lit(1).alias("depth"))
            return depths(core, by, most, in_one_task, unique=True, split_over=n).unionByName(far)
    if n <= in_one_task:
        kind = dict(plain.dtypes)["source"]
        shares = plain.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))

        def walk(table: pa.Table, graph: _Graph) -> dict:
            share = table.column("_share")[0].as_py()
            found = []
            for node in np.unique(graph.source)[share::SHARES].tolist():
                depth = graph.depths(np.unique(graph.after(np.array([node])))) + 1
                there = np.flatnonzero((depth > 0) & (depth <= (most or len(depth))))
                found.append((np.full(len(there), node), there, depth[there]))
            one, two, depth = (np.concatenate([f[i] for f in found] or [np.zeros(0, dtype=np.int64)]) for i in range(3))
            return {"source": graph.names.take(pa.array(one)), "target": graph.names.take(pa.array(two)), "depth": pa.array(depth, pa.int32())}

        return checkpointed(_in_one_task(shares, by, walk, {"source": kind, "target": kind, "depth": "int"}, ("_share",)))
    frontier = plain.withColumn("depth", F.lit(1))
    seen, depth = _Parts(frontier), 1
    step = plain.select(*by, F.col("source").alias("target"), F.col("target").alias("next"))
    while most is None or depth < most:
        depth += 1
        frontier = checkpointed(frontier.join(step, [*by, "target"]).select(*by, "source", F.col("next").alias("target")).distinct().join(seen.whole(), key, "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.whole()


def depths_by_doubling(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`depths` in a logarithm of the rounds, for small closures: joins the closure with itself."""
    key = [*by, "source", "target"]
    paths = checkpointed(edges.select(*key).distinct().withColumn("depth", F.lit(1)))
    before = None
    while True:
        now = paths.agg(F.count("*"), F.sum("depth")).first()
        if now == before:
            return paths
        before = now
        one = paths.select(*by, "source", F.col("target").alias("middle"), F.col("depth").alias("first"))
        two = paths.select(*by, F.col("source").alias("middle"), "target", F.col("depth").alias("second"))
        longer = one.join(two, [*by, "middle"]).select(*key, (F.col("first") + F.col("second")).alias("depth"))
        paths = checkpointed(paths.unionByName(longer).groupBy(*key).agg(F.min("depth").alias("depth")))


def _trimmed(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Edges without some that are on no cycle: those of nodes with no edge in or out, taken out again and again.

    A few rounds take most of them; what they leave of long tails is told apart by colour.
    """
    key = [*by, "node"]
    before = None
    for _ in range(TRIMS):
        n = edges.count()
        if n == before or not n:
            break
        before = n
        ins = edges.select(*by, F.col("target").alias("node")).distinct()
        outs = edges.select(*by, F.col("source").alias("node")).distinct()
        alive = ins.join(outs, key, "left_semi")
        edges = edges.join(alive.withColumnRenamed("node", "source"), [*by, "source"], "left_semi").join(alive.withColumnRenamed("node", "target"), [*by, "target"], "left_semi")
        edges = checkpointed(edges)
    return edges


def _rings(image: DataFrame, steps: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(``by``, node, label) of the nodes on rings of single ways, each named by its least node."""
    key = [*by, "node"]
    own = checkpointed(steps.join(image, key, "left_semi").select(*key, "to", F.col("node").alias("label")))
    while not own.isEmpty():
        further = own.select(*by, F.col("node").alias("to"), F.col("to").alias("further"), F.col("label").alias("other"))
        new = checkpointed(own.join(further, [*by, "to"]).select(*key, F.col("further").alias("to"), F.least("label", "other").alias("label"), (F.col("other") < F.col("label")).alias("moved")))
        own = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    return own.select(*key, "label")


def _contracted(rest: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, tuple] | None:
    """``rest`` without the nodes that have a single way on, edges to them leading to the end of that way; and what is needed to name them later.

    Such a node is on a cycle with the end of its way if it is on a way from it, so once the others are named, by where
    the ways are entered.
    """
    found = _jumps(rest, by)
    if found is None:
        return None
    tables, inside, image = found
    ends = tables[-1].join(image.withColumnRenamed("node", "to"), [*by, "to"], "left_anti")
    single = tables[0].select(*by, F.col("node").alias("source"))
    others = rest.join(single, [*by, "source"], "left_anti")
    entries = checkpointed(others.join(ends.select(*by, F.col("node").alias("target"), F.col("to").alias("end")), [*by, "target"]).select(*by, "source", F.col("target").alias("node"), "end"))
    kept = others.join(tables[0].select(*by, F.col("node").alias("target")), [*by, "target"], "left_anti").select(*by, "source", "target")
    new = checkpointed(kept.unionByName(entries.where("source != end").select(*by, "source", F.col("end").alias("target"))).distinct())
    return new, (entries, inside, _rings(image, tables[0], by))


def _named(labels: DataFrame, event: tuple, by: tuple[str, ...]) -> DataFrame:
    """``labels`` (``by``, node, label) of the others with those of the nodes that a contraction took away."""
    entries, inside, rings = event
    at = labels.select(*by, F.col("node").alias("source"), F.col("label").alias("from_label"))
    to = labels.select(*by, F.col("node").alias("end"), "label")
    hit = entries.join(at, [*by, "source"], "left").join(to, [*by, "end"], "left").where((F.col("source") == F.col("end")) | (F.col("from_label") == F.col("label")))
    hit = checkpointed(hit.select(*by, "node", "end", F.coalesce("label", "end").alias("label"), F.col("label").isNull().alias("alone")))
    out = labels.unionByName(rings)
    if not hit.isEmpty():
        marks = _along(checkpointed(hit.select(*by, "node", "label").distinct()), inside, by)
        out = out.unionByName(marks).unionByName(hit.where("alone").select(*by, F.col("end").alias("node"), "label").distinct())
    return checkpointed(out)


def _turned(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return edges.select(*by, F.col("target").alias("source"), F.col("source").alias("target"))


def _shrunk(rest: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, list[tuple]]:
    """``rest`` trimmed and contracted, by single ways on and single ways in, as long as that takes a good part of it."""
    events, idle = [], 0
    n = rest.count()
    while n and idle < 2:
        before = n
        rest = _trimmed(rest, by)
        if found := _contracted(rest, by):
            rest = found[0]
            events.append(found[1])
        # A component is one of the turned edges as well, so the other direction is next.
        rest = _turned(rest, by)
        n = rest.count()
        idle = idle + 1 if (before - n) * WORTH < before else 0
    return rest, events


def _coloured(rest: DataFrame, by: tuple[str, ...], turn: int) -> tuple[DataFrame, DataFrame]:
    """Some components (``by``, node, label) of ``rest``, and the edges that are left without them and between colours."""
    key = [*by, "node"]
    kind = dict(rest.dtypes)["source"]
    nodes = rest.select(*by, F.col("source").alias("node")).unionByName(rest.select(*by, F.col("target").alias("node"))).distinct()
    priority = F.concat(F.lpad(F.hex(F.xxhash64("node", F.lit(turn))), 16, "0"), F.lit(":"), F.col("node").cast("string"))
    first = checkpointed(nodes.withColumn("colour", priority))
    colours = first
    for _ in range(MOST_ROUNDS):
        spread = rest.join(colours.withColumnRenamed("node", "source"), [*by, "source"]).select(*by, F.col("target").alias("node"), "colour", F.lit(None).cast("string").alias("own"))
        both = colours.withColumn("own", F.col("colour")).unionByName(spread)
        new = checkpointed(both.groupBy(*key).agg(F.min("colour").alias("colour"), F.max("own").alias("own")))
        colours = new.select(*key, "colour")
        if new.where("colour != own").isEmpty():
            break
    else:
        raise RuntimeError(f"colours have not settled after {MOST_ROUNDS} rounds")
    coloured = rest.join(colours.select(*by, F.col("node").alias("source"), F.col("colour").alias("from")), [*by, "source"]).join(colours.select(*by, F.col("node").alias("target"), F.col("colour").alias("to")), [*by, "target"])
    # Within one colour only: no component has two.
    inner = checkpointed(coloured.where(F.col("from") == F.col("to")).select(*by, "source", "target"))
    roots = first.join(colours, [*key, "colour"], "left_semi").select(*key)
    own = reachable(roots, _turned(inner, by), by).join(colours, key)
    named = own.groupBy(*by, "colour").agg(F.min("node").alias("label"), F.count("*").alias("n"))
    own = checkpointed(own.join(named, [*by, "colour"]).select(*key, "label", "n"))
    left = inner.join(own.select(*by, F.col("node").alias("source")), [*by, "source"], "left_anti").join(own.select(*by, F.col("node").alias("target")), [*by, "target"], "left_anti")
    return own.where("n > 1").select(*key, F.col("label").cast(kind).alias("label")), checkpointed(left)


def strong_components(edges: DataFrame, by: tuple[str, ...] = (), unique: bool = False, split_over: int = SPLIT_OVER) -> DataFrame:
    """(``by``, node, component): nodes of cycles, the component named by its least node; a lone node only with a loop.

    Contraction first: nodes with a single way on, or in, are taken away with all of their chain or ring, in a logarithm
    of rounds, and named when the others are. What is left is coloured: every node has a random priority; the first one that
    reaches a node spreads forward to it as its colour, and the nodes of a colour that reach that one
    backward are its component. Found components are taken out, edges between colours with them, and the rest is
    contracted again. An error where it doesn't settle.
    """
    key = [*by, "node"]
    plain = _plain(edges, by, unique)
    rest, events = plain.where("source != target"), []
    if plain.count() > split_over:
        through = _through(plain, by)
        rest = checkpointed(sketch.maybe(sketch.maybe(rest, through, *by, "source"), through, *by, "target"))
    labels = plain.limit(0).select(*by, F.col("source").alias("node"), F.col("source").alias("label"))
    for turn in range(MOST_ROUNDS):
        rest, new = _shrunk(rest, by)
        events += new
        if rest.isEmpty():
            break
        found, rest = _coloured(rest, by, turn)
        labels = labels.unionByName(found)
    else:
        raise RuntimeError(f"components have not settled after {MOST_ROUNDS} rounds")
    for event in reversed(events):
        labels = _named(labels, event, by)
    least = labels.groupBy(*by, "label").agg(F.min("node").alias("component"))
    found = labels.join(least, [*by, "label"]).select(*key, "component")
    loops = plain.where("source = target").select(*by, F.col("source").alias("node"), F.col("source").alias("component"))
    return checkpointed(found.unionByName(loops.join(found.select(*key), key, "left_anti")))
