"""Traversals as iterated joins. Frontiers carry a seed, so any number of seeds runs in the same joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CodeGraph, current_confidence, impact_edges, priority, settled


def reach(seeds: DataFrame, steps: DataFrame, depth: int, scanned: bool = False) -> DataFrame:
    """Breadth-first: ``seeds(seed, id)`` and ``steps(src, dst)`` -> ``(seed, id, depth)``, the seed itself at depth 0.

    Steps are settled once, so a round scans them instead of deriving them anew, unless they are a stored table's rows
    already (``scanned``); repeated ones do no harm. A small frontier is broadcast by Spark's own check of its size.
    """
    steps = settled(steps) if depth > 1 and not scanned else steps
    seen = settled(seeds.select("seed", "id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        found = front.join(steps, front["id"] == steps["src"]).select("seed", F.col("dst").alias("id")).distinct()
        front = settled(found.join(seen, ["seed", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def incoming(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    return out.union(out.select("dst", "src"))


def impact_cone(graph: CodeGraph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Nodes that a change of the seed can reach: incoming edges that carry impact, the seed itself left out."""
    return reach(seeds, incoming(impact_edges(graph)), depth, graph.impact is not None).where("depth > 0")


def impact_tree(graph: CodeGraph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """One edge into the cone for each of its nodes: from a node at the depth before, by priority, target and kind."""
    cone = reach(seeds, incoming(impact_edges(graph)), depth, graph.impact is not None)
    e = impact_edges(graph)
    child = cone.where("depth > 0").select("seed", F.col("id").alias("from_id"), "depth")
    parent = cone.select(F.col("seed").alias("s"), F.col("id").alias("p"), F.col("depth").alias("pd"))
    found = child.join(e, "from_id").join(parent, (F.col("seed") == F.col("s")) & (F.col("to_id") == F.col("p")) & (F.col("pd") == F.col("depth") - 1))
    first = Window.partitionBy("seed", "from_id").orderBy(priority(), "to_id", "kind")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").select("seed", "from_id", "to_id", "kind", "depth", current_confidence().alias("live"))


def risk_cone(graph: CodeGraph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Best product of live confidences over walks of at most ``depth`` hops, and the hop count at which it was reached.

    Only nodes improved in a round are expanded in the next; of equal products the shorter walk counts.
    """
    e = impact_edges(graph).select("to_id", "from_id", current_confidence().alias("c"))
    e = e if graph.impact is not None else settled(e)
    best = settled(seeds.select("seed", "id").distinct().withColumn("conf", F.lit(1.0)).withColumn("dist", F.lit(0)))
    front = best
    for d in range(1, depth + 1):
        step = front.join(e, front["id"] == e["to_id"]).groupBy("seed", F.col("from_id").alias("id")).agg(F.max(F.col("conf") * F.col("c")).alias("new"))
        front = settled(
            step.join(best, ["seed", "id"], "left").where("conf IS NULL OR new > conf").select("seed", "id", F.col("new").alias("conf"), F.lit(d).alias("dist")))
        if front.isEmpty():
            break
        best = settled(best.join(front.select("seed", "id"), ["seed", "id"], "left_anti").unionByName(front))
    return best.join(seeds.select("seed", "id"), ["seed", "id"], "left_anti")


def neighborhood(graph: CodeGraph, seeds: DataFrame, depth: int = 3, min_confidence: float = 0.0, direction: str = "both") -> DataFrame:
    """Every edge of every frontier node with its depth, also edges into nodes seen before; direction is in/out/both."""
    e = graph.edges.where(F.col("confidence") >= F.lit(min_confidence).cast("float"))
    parts = []
    for way, src, dst in (("incoming", "to_id", "from_id"), ("outgoing", "from_id", "to_id")):
        if direction in ("both", way):
            at = reach(seeds, e.select(F.col(src).alias("src"), F.col(dst).alias("dst")), depth - 1)
            parts.append(at.join(e, F.col("id") == F.col(src)).select("seed", F.lit(way).alias("direction"), (F.col("depth") + 1).alias("depth"), "from_id", "to_id", "kind", "origin", "confidence"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def shortest_path(edges: DataFrame, pairs: DataFrame, most: int | None = None) -> DataFrame:
    """Hop-minimal undirected paths: ``pairs(a, b)`` -> ``(a, b, hops, path)``; null without one, [a] if a = b.

    Both ends are searched in turn, a hop at a time, until they meet or an end has nowhere to go; ``most`` ends the
    search earlier, with null for longer paths. Of equally short paths the one through the least node halfway is taken,
    and from there the least node before each.
    """
    steps = settled(both_ways(edges).distinct())
    want = settled(pairs.select("a", "b").distinct())
    seen = [settled(want.select("a", "b", F.col(c).alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"))) for c in ("a", "b")]
    front, still = list(seen), want.where("a <> b")
    met = [want.where("a = b").select("a", "b", F.col("a").alias("id"), F.lit(0).alias("hops"))]
    hop = 0
    while (most is None or hop < most) and not still.isEmpty():
        side, hop = hop % 2, hop + 1
        found = front[side].join(still, ["a", "b"], "left_semi").join(steps, F.col("id") == F.col("src"))
        found = found.groupBy("a", "b", F.col("dst").alias("id")).agg(F.min("src").alias("parent")).join(seen[side], ["a", "b", "id"], "left_anti")
        front[side] = settled(found.select("a", "b", "id", F.lit((hop + 1) // 2 if side == 0 else hop // 2).alias("depth"), "parent"))
        seen[side] = seen[side].unionByName(front[side])
        other = seen[1 - side].select("a", "b", "id", F.col("depth").alias("far"))
        both = settled(front[side].join(other, ["a", "b", "id"]).groupBy("a", "b").agg(F.min(F.struct((F.col("depth") + F.col("far")).alias("hops"), "id")).alias("m")).select("a", "b", "m.id", "m.hops"))
        met.append(both)
        still = settled(still.join(both, ["a", "b"], "left_anti").join(front[side], ["a", "b"], "left_semi"))
    out = met[0]
    for more in met[1:]:
        out = out.unionByName(more)
    out = settled(out.select("a", "b", "hops", F.col("id").alias("low"), F.col("id").alias("high"), F.array("id").alias("path")))
    for _ in range((hop + 1) // 2):
        for end, rows, add in (("low", seen[0], F.array_prepend), ("high", seen[1], F.array_append)):
            up = rows.where("parent IS NOT NULL").select("a", "b", F.col("id").alias(end), "parent")
            out = out.join(up, ["a", "b", end], "left").withColumn("path", F.when(F.col("parent").isNotNull(), add("path", F.col("parent"))).otherwise(F.col("path")))
            out = out.withColumn(end, F.coalesce("parent", end)).drop("parent")
        out = settled(out)
    return pairs.join(out.select("a", "b", "hops", "path"), ["a", "b"], "left").select("a", "b", "hops", "path")


def seed_by_degree(graph: CodeGraph, names: DataFrame) -> DataFrame:
    """For each ``names(name)`` the node of exactly that name with most incoming impact edges, the least id on ties."""
    deg = impact_edges(graph).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("degree"))
    hits = graph.nodes.select("id", "name").join(names, "name").join(deg, "id", "left").fillna(0, ["degree"])
    best = Window.partitionBy("name").orderBy(F.desc("degree"), "id")
    return hits.withColumn("n", F.row_number().over(best)).where("n = 1").select("name", "id", "degree")


def batch_impact(graph: CodeGraph, names: DataFrame, depth: int = 3, most_seeds: int | None = 16, most_names: int | None = 64) -> DataFrame:
    """Impact of the nodes of each of ``names(name)``, summed over nodes: seeds, seeds_used, truncated, nodes, edges and
    confidence_weighted (live confidence of the cones' edges). Null where no node has the name.

    Of a name's nodes the first ``most_seeds`` by id are used, as ``truncated`` tells (None: all). More than
    ``most_names`` names are refused.
    """
    names = names.select("name").distinct()
    if most_names is not None and names.count() > most_names:
        raise ValueError(f"at most {most_names} names at once")
    found = graph.nodes.select("name", "id").join(names, "name").withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy("id")))
    found = settled(found)
    seeds = found if most_seeds is None else found.where(F.col("n") <= most_seeds)
    tree = impact_tree(graph, seeds.select(F.col("id").alias("seed"), "id"), depth).groupBy("seed").agg(F.count("*").alias("size"), F.sum("live").alias("live"))
    sums = seeds.join(tree, F.col("id") == F.col("seed"), "left").groupBy("name").agg(
        F.count("*").alias("seeds_used"), F.sum(F.coalesce("size", F.lit(0))).alias("nodes"), F.sum(F.coalesce("live", F.lit(0.0))).alias("confidence_weighted"))
    all_ = found.groupBy("name").agg(F.count("*").alias("seeds"))
    out = names.join(all_, "name", "left").join(sums, "name", "left")
    return out.select("name", "seeds", "seeds_used", (F.col("seeds_used") < F.col("seeds")).alias("truncated"), "nodes", F.col("nodes").alias("edges"), "confidence_weighted")


def hops_within(edges: DataFrame, seeds: DataFrame, members: DataFrame, depth: int) -> DataFrame:
    """Undirected hops from ``seeds(seed, id)`` along edges between ``members(id)`` alone: seed, id, depth."""
    e = edges
    for end in ("from_id", "to_id"):
        e = e.join(members.select(F.col("id").alias(end)), end, "left_semi")
    return reach(seeds.join(members.select("id"), "id", "left_semi"), both_ways(e), depth)


def impact_of_first(graph: CodeGraph, name: str, depth: int = 3) -> DataFrame:
    """The impact cone of the first node of exactly that name; none where there is no such node."""
    first = graph.nodes.where(F.col("name") == name).agg(F.min("id").alias("id")).where("id IS NOT NULL")
    return impact_cone(graph, first.select(F.col("id").alias("seed"), "id"), depth)


def seed_of(graph: CodeGraph, name: str) -> DataFrame:
    """The node that an impact query of a name starts from: of those of exactly that name, else of those that hold it, the
    one with most incoming impact edges, the least id on ties."""
    exact = graph.nodes.where(F.col("name") == name)
    hits = graph.nodes.where(F.contains(F.col("name"), F.lit(name))) if exact.isEmpty() else exact
    deg = impact_edges(graph).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("degree"))
    return hits.select("id", "name").join(deg, "id", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), "id").limit(1)
