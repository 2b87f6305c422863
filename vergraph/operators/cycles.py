"""Cycles by strongly connected components, without a walk in one task.

Edges that cannot lie on a cycle are trimmed away, whole kinds of them before any is
read or made.  Of what is left every id takes the smallest id that reaches it as its
colour; what also reaches its own colour's id backwards is that id's component; the
rest goes round again.  Inside a component every edge lies on a cycle, and a tree out
of the component's smallest id and one into it give each edge a closed simple path.
Every step is a join over all components at once; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vergraph.plans.graph import Graph, cut

from .traverse import bfs


def _edges(graph: Graph, rel_types: list[str] | None) -> DataFrame:
    steps = graph.steps(rel_types, known=False).on_cycles()
    edges = cut(steps.edges.select("src", "dst").distinct())
    steps.done()
    return edges


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Without edges from ids that none leads to, and to ids that none leaves,
    again and again; and how many are left."""
    before = edges.count()
    while before:
        ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        now = edges.count()
        if now == before:
            break
        before = now
    return edges, before


def cyclic_nodes(graph: Graph, rel_types: list[str] | None = None) -> DataFrame:
    """Ids that lie on a cycle or between cycles (TRV8: there is a cycle exactly if
    there is any)."""
    return _trimmed(_edges(graph, rel_types))[0].select(F.col("src").alias("id")).distinct()


def _coloured(edges: DataFrame) -> DataFrame:
    """id, colour: the smallest id among those that reach it, itself included."""
    colours = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("colour", F.col("id")))
    while True:
        ahead = edges.join(colours.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("least"))
        after = cut(colours.join(ahead, "id", "left").select("id", F.least("colour", "least").alias("colour"), (F.col("least") < F.col("colour")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("id", "colour")
        colours = after.select("id", "colour")


def strong_components(graph: Graph, rel_types: list[str] | None = None) -> DataFrame:
    """id, component (its smallest id) of all ids that lie on a cycle."""
    return _components(_edges(graph, rel_types))


def _components(edges: DataFrame) -> DataFrame:
    loops = edges.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    found = loops.where(F.lit(False))
    left, n = _trimmed(edges.where("src <> dst"))
    while n:
        colours = _coloured(left)
        same = left.join(colours.select(F.col("id").alias("src"), "colour"), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other").select("src", "dst", "colour")
        same = cut(same)
        inside = frontier = cut(colours.where("id = colour"))
        while not frontier.isEmpty():
            back = same.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), "colour").distinct()
            frontier = cut(back.join(inside.select("id"), "id", "left_anti"))
            inside = inside.union(frontier)
        inside = cut(inside.select("id", F.col("colour").alias("component")))
        found = found.union(inside)
        rest = same.join(inside.select(F.col("id").alias("src")), "src", "left_anti").join(inside.select(F.col("id").alias("dst")), "dst", "left_anti")
        left, n = _trimmed(rest.select("src", "dst"))
    found = cut(found)
    large = found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    found = found.join(large, "component", "left_semi").select("id", "component")
    return found.union(loops.join(found.select("id"), "id", "left_anti"))


def _trees(edges: DataFrame, backwards: bool) -> DataFrame:
    """id, path: from the component's first id to each id, or from each id to it.
    ``edges``: src, dst, component."""
    src, dst = ("dst", "src") if backwards else ("src", "dst")
    tree = frontier = cut(edges.select("component").distinct().select(F.col("component").alias("id"), F.array("component").alias("path")))
    path = F.array_prepend("path", F.col(dst)) if backwards else F.array_append("path", F.col(dst))
    while not frontier.isEmpty():
        step = edges.join(frontier.withColumnRenamed("id", src), src).join(tree.select(F.col("id").alias(dst)), dst, "left_anti")
        frontier = cut(step.groupBy(F.col(dst).alias("id")).agg(F.min(path).alias("path")))
        tree = tree.union(frontier)
    return cut(tree)


def detect_cycles(graph: Graph, start: str | None = None, rel_types: list[str] | None = None) -> DataFrame:
    """cycle (closed id list, its smallest id first): closed simple paths that
    together hold every edge that lies on a cycle (TRV8).  With ``start``, over
    the edges that it reaches."""
    edges = _edges(graph, rel_types)
    if start is not None:
        edges = cut(edges.join(bfs(graph, start, None, rel_types).select(F.col("id").alias("src")), "src", "left_semi"))
    of = cut(_components(edges))
    ends = [of.select(F.col("id").alias(c), F.col("component").alias(n)) for c, n in (("src", "component"), ("dst", "other"))]
    inside = cut(edges.join(ends[0], "src").join(ends[1], "dst").where("component = other").select("src", "dst", "component"))
    out, back = _trees(inside, False), _trees(inside, True)
    # from the end of an edge back to where its way meets the way out to the edge's start
    both = inside.join(out.select(F.col("id").alias("src"), F.col("path").alias("way")), "src").join(back.select(F.col("id").alias("dst"), F.col("path").alias("home")), "dst")
    place = F.array_position(F.transform("home", lambda x: F.array_contains("way", x)), True)
    met = F.element_at("home", place.cast("int"))
    closed = F.concat(F.slice("home", F.lit(1), place.cast("int")), F.slice("way", F.array_position("way", met).cast("int") + 1, F.size("way")))
    least = F.array_position(closed, F.array_min(closed)).cast("int")
    turned = F.concat(F.slice(closed, least, F.size(closed)), F.slice(closed, F.lit(1), least - 1))
    return both.select(F.array_append(turned, F.array_min(closed)).alias("cycle")).distinct()
