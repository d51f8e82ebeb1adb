"""Recommendations, trust of a page, and what a change touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans
from ..functions import text as T
from ..model import CodeGraph, settled
from . import analysis, traverse

#: Caps that are tried, shares of all edges (percent), markers of generated files.
CAPS = [2, 3, 4, 6, 8]
TRIGGER_PERCENT, TARGET_PERCENT = 15, 10
GENERATED_MARKERS = ["@generated", "DO NOT EDIT", "Code generated by"]
HEAD_BYTES = 2048
NOT_REFERENCES = ["Resolves", "Contains", "BelongsTo"]
#: Files of one family of languages, by extension.
FAMILIES = {"ts": "js", "tsx": "js", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "java": "jvm", "kt": "jvm", "py": "python", "pyi": "python", "go": "go", "rs": "rust"}


def cap_advice(values: DataFrame, edges: int, current: int = 8) -> DataFrame:
    """One row ``(current_cap, current_edges, recommended_cap, projected_edges)`` if literals' pairs make up too many edges.

    The largest cap below the present one that brings the share down to the target, else the smallest cap. ``values`` as
    for ``pair_projection``. No row if ``edges`` is 0, if the share is small, or if no smaller cap is left.
    """
    share = F.floor(F.col("pairs") * 100 / F.lit(max(edges, 1)))
    steps = analysis.pair_projection(values, sorted({*CAPS, current})).withColumn("share", share)
    now = F.max(F.when(F.col("cap") == current, F.struct("pairs", "share")))
    fits = F.max(F.when(F.col("cap").isin(CAPS) & ((F.col("cap") < current) | F.lit(current == 0)) & (F.col("share") <= TARGET_PERCENT), F.struct("cap", "pairs")))
    least = F.min(F.when(F.col("cap") == CAPS[0], F.struct("cap", "pairs")))
    row = steps.agg(now.alias("now"), F.coalesce(fits, least).alias("to")).where(F.lit(edges > 0) & (F.col("now.share") > TRIGGER_PERCENT))
    out = row.select(F.lit(current).alias("current_cap"), F.col("now.pairs").alias("current_edges"), F.col("to.cap").alias("recommended_cap"), F.col("to.pairs").alias("projected_edges"))
    return out if current == 0 else out.where(F.col("recommended_cap") < current)


def language_family(file) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for ext, name in FAMILIES.items():
        out = out.when(T.extension(file) == ext, name)
    return out.otherwise(T.extension(file))


def path_category_advice(pairs: DataFrame, least: int = 3) -> DataFrame:
    """``pairs(file, other_file)`` of near-miss paths -> one row ``(reports)`` if none of them crosses language families."""
    same = language_family("file") == language_family("other_file")
    return pairs.agg(F.count("*").alias("reports"), F.bool_and(same).alias("same")).where((F.col("reports") >= least) & F.col("same")).select("reports")


def generated_files(nodes: DataFrame, sources: DataFrame, k: int = 10) -> DataFrame:
    """Files whose head has a marker of generated code and that hold a symbol other than data: ``sources(file, content)``."""
    head = F.substring(F.encode("content", "UTF-8"), 1, HEAD_BYTES)
    marker = F.coalesce(*[F.when(F.position(F.lit(m.encode()), head) > 0, m) for m in GENERATED_MARKERS])
    per = nodes.where("file <> ''").groupBy("file").agg(F.count("*").alias("symbols"), F.bool_or(~F.col("kind").isin("ConfigKey", "StringLiteral", "DocSection")).alias("code"))
    marked = sources.select("file", marker.alias("marker")).where("marker IS NOT NULL")
    return per.where("code").join(marked, "file").select("file", "marker", "symbols").orderBy(F.desc("symbols"), "file").limit(k)


def verified(least: float = 0.7) -> Column:
    """Whether an edge is sure: by stored confidence, and not a guess."""
    return (F.col("confidence") >= F.lit(least).cast("float")) & F.col("origin").isin("CompilerDerived", "NameResolved", "SyntaxMatched")


def path_trust(edges: DataFrame, verified: Column) -> DataFrame:
    """One row ``(trust, verified, broken)`` for a page of edges: Verified (also if empty), Broken or Partial."""
    sums = edges.agg(F.coalesce(F.sum(verified.cast("long")), F.lit(0)).alias("verified"), F.count("*").alias("n"))
    broken = F.col("n") - F.col("verified")
    return sums.select(F.when(broken == 0, "Verified").when(F.col("verified") == 0, "Broken").otherwise("Partial").alias("trust"), "verified", broken.alias("broken"))


def references_to(graph: CodeGraph, name: str) -> DataFrame:
    """Edges with a symbol of that name at either end, structural and resolved ones aside."""
    named = graph.nodes.where(F.col("name") == name).select("id")
    e = graph.edges.where(~F.col("kind").isin(NOT_REFERENCES)).select("from_id", "to_id", "kind")
    hit = [e.join(named.withColumnRenamed("id", end), end, "left_semi").select("from_id", "to_id", "kind") for end in ("from_id", "to_id")]
    return hit[0].union(hit[1]).distinct()


def changed_symbols(nodes: DataFrame, files: DataFrame) -> DataFrame:
    return nodes.join(files.select("file").distinct(), "file", "left_semi")


def file_impact(graph: CodeGraph, files: DataFrame, depth: int = 3, k: int = 5) -> DataFrame:
    """For each changed file: symbols, what they reach, the sum of best path confidences, the ``k`` surest ids.

    Cones of all symbols of all files run at once, keyed by the file; symbols of the file itself don't count as reached.
    """
    touched = changed_symbols(graph.nodes, files).select("file", "id")
    seeds = touched.select(F.col("id").alias("seed"), "id")
    cone = traverse.risk_cone(graph, seeds, depth)
    cone = cone.join(touched.select(F.col("id").alias("seed"), "file"), "seed").groupBy("file", "id").agg(F.max("conf").alias("confidence"))
    outside = cone.join(touched, ["file", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("confidence"), "id"))
    ranked = outside.withColumn("rank", rank)
    surest = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "id")))), lambda x: x["id"])
    sums = ranked.groupBy("file").agg(F.count("*").alias("reached"), F.sum("confidence").alias("confidence"), surest.alias("surest"))
    counted = touched.groupBy("file").agg(F.count("*").alias("symbols"))
    return counted.join(sums, "file", "left").select("file", "symbols", F.coalesce("reached", F.lit(0)).alias("reached"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("surest", F.array().cast("array<long>")).alias("surest"))


def within_budget(rows: DataFrame, text: str, group: list[str], order: list, budget: int, part: float = 0.7) -> DataFrame:
    """The first rows of each group, in order, whose estimated tokens together stay within ``part`` of the budget."""
    spent = F.sum(T.estimated_tokens(text)).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("tokens", spent).where(F.col("tokens") <= int(budget * part))


def rich_diff(graph: CodeGraph, files: DataFrame, sources: DataFrame | None = None, depth: int = 3, k: int = 5) -> DataFrame:
    """What a change of files reaches, a row a file: file, seeds (names), reached, confidence, top (struct of id and
    confidence) and lines (struct of line, symbols, confidence).

    Cones of all symbols of all files run at once. A node reached from several seeds counts once; confidence sums the live
    confidence of every cone's edges; top are the surest nodes outside of the file by the best edge at them. Lines are
    those on which seeds start, from 0; without ``sources(file, content)`` they are null. Files without symbols stay.
    """
    touched = settled(changed_symbols(graph.nodes, files).select("file", "id", "name", "span_start"))
    tree = traverse.impact_tree(graph, touched.select(F.col("id").alias("seed"), "id"), depth)
    tree = settled(tree.join(touched.select(F.col("id").alias("seed"), "file"), "seed"))
    sums = tree.groupBy("file").agg(F.countDistinct("from_id").alias("reached"), F.sum("live").alias("confidence"))
    ends = tree.select("file", F.col("from_id").alias("id"), "live").union(tree.select("file", "to_id", "live")).groupBy("file", "id").agg(F.max("live").alias("confidence"))
    outside = ends.join(touched.select("file", "id"), ["file", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("confidence"), "id"))
    best = outside.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "confidence"))).alias("t"))
    best = best.select("file", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["confidence"].alias("confidence"))).alias("top"))
    per = touched.join(tree.groupBy(F.col("seed").alias("id")).agg(F.sum("live").alias("own")), "id", "left")
    line = F.lit(None).cast("int")
    if sources is not None:
        per, line = per.join(sources.select("file", "content"), "file", "left"), spans.line_column("content", "span_start")["line"]
    lines = per.groupBy("file", line.alias("line")).agg(F.array_sort(F.collect_list("name")).alias("symbols"), F.sum(F.coalesce("own", F.lit(0.0))).alias("confidence"))
    lines = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "symbols", "confidence"))).alias("lines"))
    seeds = touched.groupBy("file").agg(F.array_sort(F.collect_list("name")).alias("seeds"))
    out = files.select("file").distinct().join(seeds, "file", "left").join(sums, "file", "left").join(best, "file", "left").join(lines, "file", "left")
    return out.fillna(0, ["reached"]).fillna(0.0, ["confidence"])
