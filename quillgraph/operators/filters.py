"""Filters of nodes and edges: kinds, staleness, direction, language, library files, and what a viewer hides."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..model import CodeGraph
from . import traverse
from .analysis import degrees, file_packages

#: Kinds that may be asked for as the center of a query, and kinds of edges that may be kept.
CENTER_KINDS = [
    "Function", "Method", "Class", "Struct", "Interface", "Trait", "Enum", "EnumVariant", "Constant", "Variable", "Field", "TypeAlias", "Module", "Namespace",
    "ConfigKey", "StringLiteral", "Package", "ExternalPackage",
]
KEPT_EDGE_KINDS = ["Resolves", "Calls", "Implements", "Extends", "Overrides", "References", "Imports", "StringMatch", "Configures", "DependsOn"]


def _known(names: list[str], allowed: list[str]) -> list[str]:
    by_key = {a.lower(): a for a in allowed}
    try:
        return [by_key[n.replace("-", "").replace("_", "").lower()] for n in names]
    except KeyError as e:
        raise ValueError(f"unknown kind {e}; known: {', '.join(allowed)}") from None


def of_kinds(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Nodes of the kinds named, in any spelling (``enum-variant``); none named: all."""
    return nodes.where(F.col("kind").isin(_known(kinds, CENTER_KINDS))) if kinds else nodes


def edges_of_kinds(edges: DataFrame, kinds: list[str]) -> DataFrame:
    return edges.where(F.col("kind").isin(_known(kinds, KEPT_EDGE_KINDS))) if kinds else edges


def directed(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Edges with a column ``direction`` of incoming and outgoing, of which one or both are kept."""
    if direction not in ("incoming", "outgoing", "both"):
        raise ValueError(f"direction {direction}")
    return edges if direction == "both" else edges.where(F.col("direction") == direction)


def fresh(edges: DataFrame, include_stale: bool = False) -> DataFrame:
    """Edges of the latest epoch; all where no edge has one, or if stale ones are wanted."""
    if include_stale:
        return edges
    last = edges.agg(F.coalesce(F.max("created_at_epoch"), F.lit(0)).alias("__last"))
    return edges.join(F.broadcast(last)).where("__last <= 0 OR created_at_epoch >= __last").drop("__last")  # one row


def in_languages(nodes: DataFrame, languages: list[str]) -> DataFrame:
    """Nodes whose file is of one of the languages, in any case; none named: all; a name that isn't known matches none."""
    wanted = [x.lower() for x in languages if x.lower() in set(T.LANGUAGES.values())]
    return nodes.where(T.language("file").isin(wanted) if wanted else F.lit(False)) if languages else nodes


def kept_ids(graph: CodeGraph, kept: DataFrame, languages: list[str]) -> DataFrame:
    """Ids of ``kept(id)`` whose file is of the languages."""
    return kept.select("id").intersect(in_languages(graph.nodes, languages).select("id"))


def not_ignored(files: DataFrame, patterns: list[str], defaults: bool = True) -> DataFrame:
    """``files(file, ...)`` that ignore patterns leave in; each path is looked at once, however many rows it has."""
    rules = [*(P.DEFAULT_IGNORES if defaults else []), *patterns]
    out = files.select("file").distinct().where(P.ignored("file", rules)).select("file")
    return files.join(out, "file", "left_anti")


def library_files(files: DataFrame, packages: DataFrame, kind: str | None = None) -> DataFrame:
    """``files(file)`` with ``library``: whether the deepest of ``packages(path, kind)`` above it is a library.

    ``kind`` overrides them all. A package of path "." or "" has what no other has; without any it isn't a library.
    """
    if kind is not None:
        return files.withColumn("library", F.lit(kind.lower() in ("library", "lib")))
    deep = file_packages(files.select("file").distinct(), packages.where("path NOT IN ('', '.')").select(F.col("kind").alias("package"), "path"))
    root = packages.where("path IN ('', '.')").agg(F.min("kind").alias("__root"))
    out = files.join(deep, "file", "left").join(F.broadcast(root))  # one row
    return out.withColumn("library", F.coalesce(F.coalesce("package", "__root") == "Library", F.lit(False))).drop("package", "__root")


def annotated(nodes: DataFrame) -> DataFrame:
    """Nodes with the package that their path tells of, whether it is generated and by what."""
    return nodes.withColumns({"package": P.package_label("file"), "generated": P.is_generated("file"), "generator": P.generator("file")})


@dataclass
class View:
    """What a viewer shows; empty lists mean all. ``hub_cap`` hides nodes of a higher degree (0: none), ``folders`` are
    the files' own folders."""

    node_kinds: list[str] = field(default_factory=list)
    edge_kinds: list[str] = field(default_factory=list)
    origins: list[str] = field(default_factory=list)
    min_confidence: float = 0.0
    min_degree: int = 0
    hub_cap: int = 0
    folders: list[str] = field(default_factory=list)
    hide_isolated: bool = False


def viewed(graph: CodeGraph, view: View, focus: int | None = None, depth: int = 2) -> CodeGraph:
    """The part of a graph that a view leaves: edges by kind, origin and confidence between nodes by kind, folder and their
    degree in the whole graph. With ``focus``, which is always shown, only nodes within ``depth`` steps of it along such
    edges, either way; else, if wanted, only nodes with an edge."""
    e = graph.edges.where(F.col("confidence") >= F.lit(view.min_confidence).cast("float"))
    e = e.where(F.col("kind").isin(view.edge_kinds)) if view.edge_kinds else e
    e = e.where(F.col("origin").isin(view.origins)) if view.origins else e
    shown = F.col("kind").isin(view.node_kinds) if view.node_kinds else F.lit(True)
    if view.folders:
        shown = shown & T.folder_of("file").isin(view.folders)
    n = graph.nodes
    if view.min_degree or view.hub_cap:
        degree = degrees(graph).select("id", (F.col("in_degree") + F.col("out_degree")).alias("__degree"))
        n = n.join(degree, "id", "left").fillna(0, ["__degree"])
        shown = shown & (F.col("__degree") >= view.min_degree)
        shown = shown & (F.col("__degree") <= view.hub_cap) if view.hub_cap else shown
    n = n.where(shown if focus is None else shown | (F.col("id") == focus)).drop("__degree")
    for end in ("from_id", "to_id"):
        e = e.join(n.select(F.col("id").alias(end)), end, "left_semi")
    if focus is not None:
        seed = e.sparkSession.createDataFrame([(focus, focus)], "seed long, id long")
        near = traverse.reach(seed, traverse.both_ways(e), depth).select("id")
        n = n.join(near, "id", "left_semi")
        for end in ("from_id", "to_id"):
            e = e.join(near.select(F.col("id").alias(end)), end, "left_semi")
    elif view.hide_isolated:
        n = n.join(e.select(F.col("from_id").alias("id")).union(e.select("to_id")).distinct(), "id", "left_semi")
    return CodeGraph(n, e)
