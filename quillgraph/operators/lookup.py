"""What stands at a place of a file, and where definitions are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans
from . import linking


def enclosing_half_open(refs: DataFrame, nodes: DataFrame, width: int = 1024, narrowest: bool = True) -> DataFrame:
    """Symbols whose span, without its end, holds an offset: ``refs(ref_id, file, offset)``, ``nodes(id, file, span_start, span_end)``.

    The narrowest (the least id on ties), or all of them; by an equi-join on file, level and bin, as ``linking.enclosing``.
    """
    held = linking.leveled(nodes.where("span_end > span_start").withColumn("__last", F.col("span_end") - 1), "span_start", "__last", width)
    hit = linking.at_levels(refs, "offset", held, width).join(held, ["file", "level", "bin"]).where("span_start <= offset AND offset < span_end")
    if not narrowest:
        return hit.select("ref_id", "id")
    return hit.groupBy("ref_id").agg(F.min(F.struct((F.col("span_end") - F.col("span_start")).alias("w"), "id"))["id"].alias("id"))


def at_lines(spots: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """All symbols around the start of a line: ``spots(ref_id, file, line)``, lines from 0, ``sources(file, content)``."""
    offset = spots.join(sources, "file").select("ref_id", "file", spans.line_offset("content", "line").alias("offset")).where("offset IS NOT NULL")
    return enclosing_half_open(offset, nodes, narrowest=False)


def inspect(nodes: DataFrame, file: str, offset: int, k: int = 5) -> DataFrame:
    """Symbols of files that end in ``file`` whose span holds the offset, ends included; without any, those that start
    nearest to it: at most ``k``."""
    here = nodes.where(F.col("file").endswith(file))
    hits = here.where((F.col("span_start") <= offset) & (F.col("span_end") >= offset))
    if not hits.isEmpty():
        return hits.orderBy("id").limit(k)
    return here.orderBy(F.abs(F.col("span_start") - offset), "id").limit(k)


def starting_at(spots: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """The symbol that starts on a line: ``spots(ref_id, file, line)``, lines from 0; files last, then the narrowest."""
    there = nodes.join(spots, "file").join(sources, "file").where(spans.line_column("content", "span_start")["line"] == F.col("line"))
    return there.groupBy("ref_id").agg(F.min(F.struct((F.col("kind") == "File").alias("f"), (F.col("span_end") - F.col("span_start")).alias("w"), "id"))["id"].alias("id"))


def definitions(nodes: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """Where each of ``names(name)`` is defined: name, id, file, and its range as lines and columns from 0."""
    found = nodes.join(names.distinct(), "name").join(sources.select("file", "content"), "file")
    ends = [spans.line_column("content", c).alias(n) for c, n in (("span_start", "start"), ("span_end", "end"))]
    return found.select("name", "id", "file", *ends)


def first_of_kind(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """The first declaration of each name among nodes of some kinds, by id: name, id."""
    return nodes.where(F.col("kind").isin(kinds)).groupBy("name").agg(F.min("id").alias("id"))


def spans_to_endpoints(spots: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node that a resolved span means: ``spots(ref_id, file, start, end)``.

    Span (0, 0) is the file itself: its File node, else its Module, else the widest node. Any other: the narrowest node
    that holds it or that it holds; the least id on ties.
    """
    n = nodes.select("id", "kind", "file", F.col("span_start").alias("s"), F.col("span_end").alias("e"))
    rank = F.when(F.col("kind") == "File", 0).when(F.col("kind") == "Module", 1).otherwise(2)
    whole = n.groupBy("file").agg(F.min(F.struct(rank.alias("r"), (F.col("s") - F.col("e")).alias("w"), "id"))["id"].alias("id"))
    zero = spots.where("start = 0 AND end = 0").join(whole, "file").select("ref_id", "id")
    some = spots.where("NOT (start = 0 AND end = 0)").join(n, "file").where("(s <= start AND e >= end) OR (start <= s AND end >= e)")
    near = some.groupBy("ref_id").agg(F.min(F.struct((F.col("e") - F.col("s")).alias("w"), "id"))["id"].alias("id"))
    return zero.unionByName(near)


def by_exact_span(spots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Spots ``(ref_id, file, start, end)`` with the last node of exactly that span."""
    last = nodes.groupBy("file", F.col("span_start").alias("start"), F.col("span_end").alias("end")).agg(F.max("id").alias("id"))
    return spots.join(last, ["file", "start", "end"]).select("ref_id", "id")


def representatives(files: DataFrame, name, score) -> DataFrame:
    """For each module name of ``files(file)`` the file that stands for it: the best score, the first path on ties."""
    best = Window.partitionBy("module").orderBy(F.desc("score"), "file")
    out = files.select("file", name.alias("module"), score.alias("score")).withColumn("n", F.row_number().over(best))
    return out.where("n = 1").select("module", "file")
