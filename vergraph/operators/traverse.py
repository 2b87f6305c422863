"""Graph traversal, level by level.

A level is one step from the frontier and a difference with the ids already
seen.  As long as a walk has found few ids (``FEW``), a step names the frontier
in its filter and the ids come back to the driver: one job a level, which reads
what the graph's index finds by these ids.  Larger levels are joins (broadcast
while the counted frontier is small) and end in a checkpoint, so plans stay short and a lost executor repeats one level at most.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vergraph.plans.graph import FEW, Graph, Steps, at_ends, cut, small
from vergraph.schema import CHILD_TO_PARENT

from .versions import numbered

Visit = Callable[[DataFrame], Column]


def _is_node(graph: Graph, id_: str) -> bool:
    return not graph.entities.where(F.col("id") == id_).limit(1).isEmpty()


def few_rows(df: DataFrame, most: int = FEW) -> list | None:
    """The rows, if there are at most so many."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def _levels(graph: Graph, steps: Steps | _BothWays, start: str, max_depth: int | None, known: bool = True) -> DataFrame:
    """id, depth of all ids reached from ``start``, which must be a node if ``known``."""
    spark, schema = graph.relationships.sparkSession, "id string, depth int"
    found = {start: 0} if not known or _is_node(graph, start) else {}
    frontier, depth = list(found), 0
    while frontier and (max_depth is None or depth < max_depth):
        rows = few_rows(steps.from_few(frontier).select("dst").distinct()) if len(found) <= FEW else None
        if rows is None:
            return _many_levels(steps, spark.createDataFrame(list(found.items()), schema), spark.createDataFrame([(i, depth) for i in frontier], schema), len(found), len(frontier), depth, max_depth)
        depth += 1
        frontier = sorted({r["dst"] for r in rows} - found.keys())
        found |= dict.fromkeys(frontier, depth)
    steps.done()
    return spark.createDataFrame(list(found.items()), schema)


def _many_levels(steps: Steps | _BothWays, found: DataFrame, frontier: DataFrame, total: int, size: int, depth: int, max_depth: int | None) -> DataFrame:
    while size and (max_depth is None or depth < max_depth):
        depth += 1
        reached = steps.from_many(frontier.select(F.col("id").alias("src")), size).select(F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(small(found.select("id"), total), "id", "left_anti").withColumn("depth", F.lit(depth)))
        size = frontier.count()
        total += size
        if size:
            found = found.union(frontier)
    steps.done()
    return found


def bfs(graph: Graph, start: str, max_depth: int | None = None, rel_types: list[str] | None = None, visit: Visit | None = None) -> DataFrame:
    """id, depth of everything reached over outgoing edges, the start at 0 (TRV1).
    ``visit`` (UDF1) as in ``bfs_ranked``."""
    if visit is not None:
        return bfs_ranked(graph, start, max_depth, rel_types, visit).select("id", "depth")
    return _levels(graph, graph.steps(rel_types), start, max_depth)


def _refused(graph: Graph, rows: DataFrame, rank: str, visit: Visit) -> int | None:
    """The first rank at which ``visit`` is not true.  It is given the current
    entities of the rows, with depth and rank."""
    seen = graph.latest().join(rows, "id")
    return seen.where(~F.coalesce(visit(seen), F.lit(False))).agg(F.min(rank)).first()[0]


def bfs_ranked(graph: Graph, start: str, max_depth: int | None = None, rel_types: list[str] | None = None, visit: Visit | None = None) -> DataFrame:
    """bfs with the order of visits: first by the rank of the parent, then by the
    edge's id.  Where ``visit`` is not true of an entity, the walk ends with it (UDF1).
    Large levels are numbered by range parts, never in one task."""
    spark, schema = graph.relationships.sparkSession, "id string, depth int, bfs_rank long"
    steps = graph.steps(rel_types)
    rank, frontier, depth = {}, [start] if _is_node(graph, start) else [], 0
    done: list[tuple[str, int, int]] = []
    while frontier:
        own = [(i, depth, len(rank) + k) for k, i in enumerate(frontier)]
        stop = _refused(graph, spark.createDataFrame(own, schema), "bfs_rank", visit) if visit is not None else None
        done += own if stop is None else own[: stop - len(rank) + 1]
        rank |= {i: n for i, _, n in own}
        if stop is not None or depth == max_depth:
            break
        rows = few_rows(steps.from_few(frontier).select("src", "dst", "rel")) if len(rank) <= FEW else None
        if rows is None:
            return _many_ranked(graph, steps, spark.createDataFrame(done, schema), spark.createDataFrame(own, schema), len(rank), len(own), depth, max_depth, visit)
        depth += 1
        frontier = list(dict.fromkeys(r["dst"] for r in sorted(rows, key=lambda r: (rank[r["src"]], r["rel"])) if r["dst"] not in rank))
    steps.done()
    return spark.createDataFrame(done, schema)


def _many_ranked(graph: Graph, steps: Steps, found: DataFrame, frontier: DataFrame, total: int, size: int, depth: int, max_depth: int | None, visit: Visit | None) -> DataFrame:
    while size and (max_depth is None or depth < max_depth):
        depth += 1
        ahead = frontier.select(F.col("id").alias("src"), "bfs_rank")
        step = steps.from_many(ahead, size).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("bfs_rank", "rel")).alias("by"))
        step = step.join(small(found.select("id"), total), "id", "left_anti").select("id", F.col("by.bfs_rank").alias("parent"), F.col("by.rel").alias("rel"))
        frontier = cut(numbered(step, ["parent", "rel", "id"], "n").select("id", F.lit(depth).alias("depth"), (F.lit(total - 1).cast("long") + F.col("n")).alias("bfs_rank")))
        stop = _refused(graph, frontier, "bfs_rank", visit) if visit is not None else None
        if stop is not None:
            found = found.union(frontier.where(F.col("bfs_rank") <= stop))
            break
        size = frontier.count()
        total += size
        found = found.union(frontier)
    steps.done()
    return found


#: Most edges that an order-dependent walk may be given.
WALK_EDGES = 200_000


def _reachable(graph: Graph, start: str, rel_types: list[str] | None) -> DataFrame:
    """The edges an order-dependent walk can use; raises when they are more than one task should hold."""
    ids = cut(bfs(graph, start, None, rel_types).select(F.col("id").alias("src")))
    steps = graph.steps(rel_types)
    edges = cut(steps.from_many(ids, ids.count()).select("src", "dst", "rel"))
    steps.done()
    if edges.limit(WALK_EDGES + 1).count() > WALK_EDGES:
        raise ValueError(f"an order-dependent walk is limited to {WALK_EDGES} reachable edges")
    return edges


def dfs(graph: Graph, start: str, max_depth: int | None = None, rel_types: list[str] | None = None, visit: Visit | None = None) -> DataFrame:
    """id, depth, dfs_rank in pre-order, edges in the order of their ids (TRV2).
    The order depends on every visit before, so one task walks the (bounded)
    reachable edges.  Where ``visit`` is not true of an entity, the walk ends with it."""
    edges = _reachable(graph, start, rel_types)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[str]] = {}
        for s, d in pdf[pdf.dst != ""].sort_values("rel")[["src", "dst"]].itertuples(index=False):
            after.setdefault(s, []).append(d)
        out, seen, stack = [], set(), [(start, 0)]
        while stack:
            node, depth = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            out.append((node, depth, len(out)))
            if max_depth is None or depth < max_depth:
                stack += [(d, depth + 1) for d in reversed(after.get(node, []))]
        return pd.DataFrame(out, columns=["id", "depth", "dfs_rank"])

    alone = graph.relationships.sparkSession.createDataFrame([(start, "", "")] if _is_node(graph, start) else [], "src string, dst string, rel string")
    found = edges.select("src", "dst", "rel").union(alone).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(walk, "id string, depth int, dfs_rank int")
    if visit is None:
        return found
    found = cut(found)
    stop = _refused(graph, found, "dfs_rank", visit)
    return found if stop is None else found.where(F.col("dfs_rank") <= stop)


def _hops(graph: Graph, to: str, most: int, rel_types: list[str] | None) -> DataFrame:
    """dst, hops: the least number of hops from a node to ``to``, up to ``most``."""
    return _levels(graph, graph.steps(rel_types, backwards=True, known=False), to, most, known=False).select(F.col("id").alias("dst"), F.col("depth").alias("hops"))


def _near_ends(graph: Graph, start: str, end: str, max_hops: int, rel_types: list[str] | None) -> DataFrame | None:
    """Edges (as relationships) among which every path of at most ``max_hops`` lies: those
    that leave the first levels from the start, and those that enter the last ones to the
    end.  Of both sides the smaller grows, unless it is found to be large; None if both are.
    Of k edges of a path, the i-th leaves a node at most i - 1 from the start, and enters
    one at most k - i from the end."""
    spark = graph.relationships.sparkSession
    sides = [{"steps": graph.steps(rel_types, backwards, known=False), "seen": {i}, "now": [i], "depth": 0, "edges": set()} for backwards, i in ((False, start), (True, end))]
    able = list(sides)
    while able and sum(s["depth"] for s in sides) < max_hops and all(s["now"] for s in sides):
        side = min(able, key=lambda s: len(s["now"]))
        rows = few_rows(side["steps"].from_few(side["now"]).where("dst is not null").select("src", "dst").distinct()) if len(side["seen"]) <= FEW else None
        if rows is None:
            able.remove(side)
            continue
        side["edges"] |= {(r["src"], r["dst"]) for r in rows}
        side["now"] = sorted({r["dst"] for r in rows} - side["seen"])
        side["seen"] |= set(side["now"])
        side["depth"] += 1
    for s in sides:
        s["steps"].done()
    if sum(s["depth"] for s in sides) < max_hops and all(s["now"] for s in sides):
        return None
    ended = [s for s in sides if not s["now"]]  # all that a side reaches holds every path
    pairs = set().union(*({(a, b) if s is sides[0] else (b, a) for a, b in s["edges"]} for s in ended[:1] or sides))
    schema = "id string, from_entity_id string, to_entity_id string, relationship_type string"
    return spark.createDataFrame([(f"{a}|{b}", a, b, "") for a, b in sorted(pairs)], schema)


def _prefixes(graph: Graph, start: str, end: str, max_hops: int, rel_types: list[str] | None, closed: bool) -> DataFrame:
    """path, last: every path from ``start`` to ``end`` over at most ``max_hops``
    edges, simple but for an end that is the start (``closed``).  Levels around both
    ends come first, while they are few: they hold every edge of every path if their
    depths add up to ``max_hops``.  Otherwise levels back from the end do: a path is
    extended only by a node from which the rest suffices."""
    near = _near_ends(graph, start, end, max_hops, rel_types)
    graph = graph if near is None else Graph(graph.entities, near)
    hops = cut(_hops(graph, end, max_hops, None if near is not None else rel_types))
    n, steps = hops.count(), graph.steps(None if near is not None else rel_types, known=False)
    inside = steps.from_many(hops.select(F.col("dst").alias("src")), n).join(small(hops, n), "dst").select("src", "dst", "hops").distinct()
    inside = cut(inside)
    paths = cut(hops.where(F.col("dst") == start).select(F.array("dst").alias("path"), F.col("dst").alias("last")))
    done = paths.where(F.lit(False)) if closed else paths.where(F.col("last") == end)
    paths = paths if closed else paths.where(F.col("last") != end)
    for used in range(1, max_hops + 1):
        step = inside.where(F.col("hops") <= max_hops - used).join(paths, F.col("src") == F.col("last"))
        ends = F.col("dst") == end
        step = cut(step.where(ends | ~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("last")))
        if step.isEmpty():
            break
        done = done.union(step.where(F.col("last") == end))
        paths = step.where(F.col("last") != end)
    steps.done()
    return done


def all_paths(graph: Graph, start: str, end: str, max_length: int = 5, rel_types: list[str] | None = None) -> DataFrame:
    """path (ids), length (nodes): simple paths of at most ``max_length`` nodes (TRV3)."""
    return _prefixes(graph, start, end, max_length - 1, rel_types, closed=False).select("path", F.size("path").alias("length"))


def hierarchy(graph: Graph, rel_type: str, upwards: bool) -> DataFrame:
    """src, dst of one step up or down, by the direction that the type has (TRV4)."""
    e = graph.edges([rel_type]).select("src", "dst")
    return e if (rel_type in CHILD_TO_PARENT) == upwards else e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _walk_hierarchy(graph: Graph, id_: str, rel_type: str, max_depth: int | None, upwards: bool) -> DataFrame:
    steps = graph.steps([rel_type], backwards=(rel_type in CHILD_TO_PARENT) != upwards)
    return _levels(graph, steps, id_, max_depth).where("depth > 0")


def ancestors(graph: Graph, id_: str, rel_type: str, max_depth: int | None = None) -> DataFrame:
    """id, depth of all above, the start left out (TRV5, TRV6)."""
    return _walk_hierarchy(graph, id_, rel_type, max_depth, True)


def descendants(graph: Graph, id_: str, rel_type: str, max_depth: int | None = None) -> DataFrame:
    """id, depth of all below (TRV5, TRV7)."""
    return _walk_hierarchy(graph, id_, rel_type, max_depth, False)


def cycles_through(graph: Graph, start: str, max_length: int = 5, rel_types: list[str] | None = None) -> DataFrame:
    """cycle: closed simple paths through ``start`` over three to ``max_length`` nodes (TRV9)."""
    return _prefixes(graph, start, start, max_length, rel_types, closed=True).where(F.size("path") > 3).select(F.col("path").alias("cycle"))


def degrees(graph: Graph) -> DataFrame:
    """id, out_degree, in_degree, degree of all nodes (TRV10, TRV11)."""
    e = graph.edges()
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counts = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = F.lit(0).cast("long")
    return graph.nodes().join(counts, "id", "left").select("id", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree"), (F.coalesce("out_degree", zero) + F.coalesce("in_degree", zero)).alias("degree"))


def find_path(graph: Graph, start: str, end: str, max_depth: int = 10, rel_types: list[str] | None = None) -> DataFrame:
    """path, length (hops) of a shortest directed path; of several the one whose
    ids come first (TRV12, TRV13; TRV14 counts nodes: pass one hop less).

    Levels grow from both ends, the smaller one first.  Where they meet for the
    first time the hops add up to the length, and every shortest path passes there
    once; the least path to each meeting id and the least one on from it give the
    least of all."""
    return _two_sided(graph, start, end, max_depth, rel_types)[0]


def _two_sided(graph: Graph, start: str, end: str, max_depth: int, rel_types: list[str] | None) -> tuple[DataFrame, int]:
    """The path, and how many ids were reached for it."""
    spark, schema = graph.relationships.sparkSession, "path array<string>, length int"
    if not _is_node(graph, start) or not _is_node(graph, end):
        return spark.createDataFrame([], schema), 0
    sides = [{"steps": graph.steps(rel_types, backwards=b), "seen": {i}, "now": {i: (i,)}} for b, i in ((False, start), (True, end))]
    hops = 0
    while True:
        here, there = (s["now"] for s in sides)
        met = [here[i] + there[i][1:] for i in here.keys() & there.keys()]
        reached = sum(len(s["seen"]) for s in sides)
        if met or hops == max_depth or not here or not there:
            for s in sides:
                s["steps"].done()
            return spark.createDataFrame([(list(p), hops) for p in sorted(met)[:1]], schema), reached
        k = 0 if (len(here), len(sides[0]["seen"])) <= (len(there), len(sides[1]["seen"])) else 1
        side = sides[k]
        rows = few_rows(side["steps"].from_few(list(side["now"])).select("src", "dst").distinct()) if len(side["seen"]) <= FEW else None
        if rows is None:
            return _many_sided(spark, sides, hops, max_depth)
        ahead: dict[str, tuple] = {}
        for r in rows:
            if r["dst"] not in side["seen"]:
                path = side["now"][r["src"]]
                path = (*path, r["dst"]) if k == 0 else (r["dst"], *path)
                ahead[r["dst"]] = min(path, ahead.get(r["dst"], path))
        side["now"] = ahead
        side["seen"] |= ahead.keys()
        hops += 1


def _many_sided(spark, sides: list[dict], hops: int, max_depth: int) -> tuple[DataFrame, int]:
    """The same with tables, from where the levels became large."""
    for s in sides:
        s["size"], s["total"] = len(s["now"]), len(s["seen"])
        s["now"] = cut(spark.createDataFrame([(i, list(p)) for i, p in s["now"].items()], "id string, path array<string>"))
        s["seen"] = spark.createDataFrame([(i,) for i in s["seen"]], "id string")
    while True:
        here, there = (s["now"] for s in sides)
        met = here.join(there.select("id", F.slice("path", 2, 1 << 30).alias("rest")), "id").agg(F.min(F.concat("path", "rest")).alias("path")).where("path is not null")
        met = cut(met.select("path", F.lit(hops).alias("length")))
        if hops == max_depth or not all(s["size"] for s in sides) or not met.isEmpty():
            for s in sides:
                s["steps"].done()
            return met, sum(s["total"] for s in sides)
        k = 0 if (sides[0]["size"], sides[0]["total"]) <= (sides[1]["size"], sides[1]["total"]) else 1
        side = sides[k]
        path = F.array_append("path", F.col("id")) if k == 0 else F.array_prepend("path", F.col("id"))
        step = side["steps"].from_many(side["now"].withColumnRenamed("id", "src"), side["size"]).groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("path"))
        side["now"] = cut(step.join(small(side["seen"], side["total"]), "id", "left_anti").select("id", path.alias("path")))
        side["size"] = side["now"].count()
        side["total"] += side["size"]
        side["seen"] = side["seen"].union(side["now"].select("id"))
        hops += 1


def connected(graph: Graph, id_: str, rel_type: str | None = None, direction: str = "both", max_depth: int = 1) -> DataFrame:
    """id, rel, direction, distance: one row per edge and direction walked; an id
    may come back (bag semantics), but is left only once (TRV16)."""
    spark, types = graph.relationships.sparkSession, [rel_type] if rel_type else None
    ways = [(graph.steps(types, backwards), name) for backwards, name in ((False, "outgoing"), (True, "incoming")) if direction in (name, "both")]
    seen = frontier = cut(spark.createDataFrame([(id_,)] if _is_node(graph, id_) else [], "id string"))
    size, found = frontier.count(), None
    total = size
    for distance in range(1, max_depth + 1):
        ids = frontier.select(F.col("id").alias("src"))
        levels = [steps.from_many(ids, size).select(F.col("dst").alias("id"), "rel", F.lit(name).alias("direction"), F.lit(distance).alias("distance")) for steps, name in ways]
        level = levels[0] if len(levels) == 1 else levels[0].union(levels[1])
        found = level if found is None else found.union(level)
        if distance < max_depth:
            # rows of a level are made again when they are asked for: only its ids are kept
            frontier = cut(level.select("id").distinct().join(small(seen, total), "id", "left_anti"))
            size = frontier.count()
            seen, total = seen.union(frontier), total + size
    for steps, _ in ways:
        steps.done()
    return found


class _BothWays:
    """Steps along edges and against them."""

    def __init__(self, graph: Graph, rel_types: list[str] | None, known: bool = True):
        self.ways = [graph.steps(rel_types, backwards, known) for backwards in (False, True)]

    def from_few(self, ids: list[str]) -> DataFrame:
        return self.ways[0].from_few(ids).union(self.ways[1].from_few(ids))

    def from_many(self, ids: DataFrame, rows: int) -> DataFrame:
        return self.ways[0].from_many(ids, rows).union(self.ways[1].from_many(ids, rows))

    def done(self) -> None:
        for w in self.ways:
            w.done()


def subgraph(graph: Graph, id_: str, depth: int = 1, rel_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) within ``depth`` hops in any direction, and the edges of
    the nodes that were left, each once (TRV18)."""
    nodes = cut(_levels(graph, _BothWays(graph, rel_types), id_, depth))
    left = nodes.where(F.col("depth") < depth).select(F.col("id").alias("src"))
    n, (out, into) = left.count(), _BothWays(graph, rel_types, known=False).ways
    columns = ["src", "dst", "relationship_type", "rel"]
    back = into.from_many(left, n).select(F.col("dst").alias("src"), F.col("src").alias("dst"), *columns[2:])
    edges = out.from_many(left, n).select(*columns).union(back)
    return nodes, edges.dropDuplicates(["rel"])


def induced(graph: Graph, ids: DataFrame) -> DataFrame:
    """Edges with both endpoints among the ids (TRV19)."""
    ids = ids.select("id")
    return Graph(graph.entities, at_ends(graph.edge_source(), {"from": ids, "to": ids}, "left_semi")).edges()
