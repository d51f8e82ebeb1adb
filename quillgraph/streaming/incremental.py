"""Graphs that follow changes: files reindexed in place, marks, tombstones, and the difference each batch makes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CodeGraph, settled
from ..operators import linking
from ..sources import git
from . import changes

GONE_SECONDS = 5 * 60  #: Fixed value: how long a node that is gone is kept.


def reindex(graph: CodeGraph, files: DataFrame, rebuilt: CodeGraph) -> CodeGraph:
    """The graph with the symbols and edges of ``files(file)`` taken from ``rebuilt``, which holds these files alone.

    Edges from other files into them are linked again by the old symbol's qualified name, else by its bare name in the
    same file, and count one more stale evidence; where neither is there any more, the edge goes. The epoch of what is
    new follows on the last one.
    """
    files = files.select("file").distinct()
    old = graph.nodes.join(files, "file", "left_semi")
    kept_nodes = graph.nodes.join(files, "file", "left_anti")
    top = graph.nodes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    epoch = graph.edges.agg(F.coalesce(F.max("created_at_epoch"), F.lit(0)).alias("m")).first()["m"] + 1
    new_nodes = settled(rebuilt.nodes.join(files, "file", "left_semi").withColumn("id", F.col("id") + top))
    ids = new_nodes.select("id")
    new_edges = rebuilt.edges.withColumns({"from_id": F.col("from_id") + top, "to_id": F.col("to_id") + top, "created_at_epoch": F.lit(epoch).cast("long")})
    new_edges = linking.drop_dangling(new_edges, ids)
    gone = old.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("qualified"), "name", "file")
    outside = graph.edges.join(old.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(files.withColumnRenamed("file", "evidence_file"), "evidence_file", "left_anti")
    lost = settled(outside.join(gone, "to_id").withColumn("edge_id", F.monotonically_increasing_id()))
    to = linking.relink(lost.select("edge_id", "qualified", "name", "file"), new_nodes).where("id IS NOT NULL")
    moved = lost.join(to, "edge_id").withColumn("to_id", F.col("id")).withColumn("stale_evidence_count", (F.col("stale_evidence_count") + 1).cast("int"))
    whole = linking.drop_dangling(outside, kept_nodes)
    edges = whole.unionByName(moved.select(*graph.edges.columns)).unionByName(new_edges.select(*graph.edges.columns))
    return CodeGraph(settled(kept_nodes.unionByName(new_nodes.select(*kept_nodes.columns))), settled(edges.dropDuplicates(["from_id", "to_id", "kind"])))


def bump_stale(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """One more stale evidence for the edges in ``touched(from_id, to_id, kind)``; those that aren't there don't matter."""
    mark = touched.select("from_id", "to_id", "kind").distinct().withColumn("__one", F.lit(1))
    out = edges.join(mark, ["from_id", "to_id", "kind"], "left")
    return out.withColumn("stale_evidence_count", (F.col("stale_evidence_count") + F.coalesce("__one", F.lit(0))).cast("int")).select(*edges.columns)


def remove_nodes(graph: CodeGraph, ids: DataFrame) -> CodeGraph:
    """The graph without ``ids(id)`` and the edges at them; ids that aren't there don't matter."""
    nodes = graph.nodes.join(ids.select("id"), "id", "left_anti")
    return CodeGraph(nodes, linking.drop_dangling(graph.edges, nodes))


def buried(nodes: DataFrame, tombs: DataFrame, at) -> DataFrame:
    """Tombs ``(id, gone_at)`` of all nodes that are gone: those known keep their time, new ones have ``at``."""
    gone = nodes.where("status = 'Gone'").select("id")
    return gone.join(tombs, "id", "left").select("id", F.coalesce("gone_at", F.lit(at).cast("timestamp")).alias("gone_at"))


def collected(graph: CodeGraph, tombs: DataFrame, at, seconds: int = GONE_SECONDS) -> tuple[CodeGraph, DataFrame]:
    """The graph without nodes that have been gone for ``seconds``, and the tombs that are left."""
    ripe = F.unix_timestamp(F.lit(at).cast("timestamp")) - F.unix_timestamp("gone_at") >= seconds
    return remove_nodes(graph, tombs.where(ripe)), tombs.where(~ripe)


def debounced(batch: DataFrame, pattern: str | None = None) -> DataFrame:
    """The last event of each path of a batch ``(path, at, removed)``, paths by an optional pattern."""
    rows = batch if pattern is None else batch.where(F.col("path").rlike(pattern))
    return rows.groupBy("path").agg(F.max(F.struct("at", "removed")).alias("e")).select("path", "e.removed")


def follow(spark, folder: str, schema: str, state: str, checkpoint: str, graph: Callable[[], CodeGraph], rebuild: Callable[[DataFrame], CodeGraph],
           emit: Callable[[DataFrame, CodeGraph, int], None], root: str | None = None):
    """Follow a stream of files: each batch's changed ones are rebuilt and put into the graph, and ``emit`` gets the symbols
    added and removed. While git is in the middle of an operation in ``root``, batches only update the hashes."""

    def on_changes(found: DataFrame, epoch: int) -> None:
        if root and git.operation_in_progress(root):
            return
        before = graph()
        files = found.select(F.col("path").alias("file"))
        after = reindex(before, files, rebuild(found.where("change <> 'removed'").select(F.col("path").alias("file"))))
        emit(linking.snapshot_diff(before.nodes, after.nodes), after, epoch)

    return changes.watch(spark, folder, schema, state, on_changes, checkpoint)
