"""Edge producers and lookups: pairs by value, candidates, ranges, tokens, mediators, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def string_pairs(values: DataFrame, cap: int = 8) -> DataFrame:
    """``values(id, value, file)``: pairs of one value in different files; values in more than ``cap`` files are skipped (0: none)."""
    if cap:
        few = values.groupBy("value").agg(F.countDistinct("file").alias("n")).where(F.col("n") <= cap)
        values = values.join(few.select("value"), "value", "left_semi")
    b = values.select(F.col("id").alias("b_id"), F.col("value").alias("v2"), F.col("file").alias("f2"))
    return values.join(b, F.col("value") == F.col("v2")).where("id < b_id AND file <> f2").select(F.col("id").alias("a_id"), "b_id", "value")


def candidates(refs: DataFrame, defs: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """Definitions a reference means: ``refs(ref_id, name, file)``, ``defs(id, name, file[, qualified_name])``.

    All of the same file; else the only one of the same directory; else the only one with a qualified name; else all of
    the file that ``imports(file, name, target)`` names; else the only one at all. ``rule`` tells which it was.

    But for the first and the fourth, rules need only counts and least and greatest ids of definitions, so a name that
    many share costs a row for each reference, not one for each pair. ``ref_id`` and ``id`` are unique; a reference
    never means itself.
    """
    qualified = F.col("qualified_name") if "qualified_name" in defs.columns else F.col("name")
    refs = refs.select("ref_id", "name", "file", T.folder_of("file").alias("folder"))
    defs = defs.select("id", "name", "file", T.folder_of("file").alias("folder"), (F.coalesce(qualified, F.lit("")) != "").alias("qualified"))
    known = refs
    for level, keys, some in (("file_", ["name", "file"], F.lit(True)), ("dir", ["name", "folder"], F.lit(True)), ("full", ["name"], F.col("qualified")), ("all", ["name"], F.lit(True))):
        known = known.join(defs.where(some).groupBy(*keys).agg(F.struct(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).alias(level)), keys, "left")

    def one(level: str):
        n, lo, hi = (F.col(level)[c] for c in ("n", "lo", "hi"))
        mine_lo, mine_hi = lo == F.col("ref_id"), hi == F.col("ref_id")
        return F.when((n == 1) & ~mine_lo, lo).when((n == 2) & mine_lo & ~mine_hi, hi).when((n == 2) & mine_hi & ~mine_lo, lo)

    in_file = F.coalesce((F.col("file_")["lo"] != F.col("ref_id")) | (F.col("file_")["hi"] != F.col("ref_id")), F.lit(False))
    far = known.where(~in_file).select("ref_id", "name", "file", *[one(x).alias(f"in_{x}") for x in ("dir", "full", "all")])
    near = refs.join(defs.select("id", "name", "file"), ["name", "file"]).where("ref_id <> id").select("ref_id", "id", F.lit("same_file").alias("rule"))
    found = F.when(F.col("in_dir").isNotNull(), "same_dir").otherwise("qualified")
    sure = far.where("coalesce(in_dir, in_full) IS NOT NULL").select("ref_id", F.coalesce("in_dir", "in_full").alias("id"), found.alias("rule"))
    rest = far.where("coalesce(in_dir, in_full) IS NULL")
    only = rest.where("in_all IS NOT NULL").select("ref_id", F.col("in_all").alias("id"), F.lit("only").alias("rule"))
    out = near.unionByName(sure)
    if imports is not None:
        there = defs.select("id", "name", F.col("file").alias("target"))
        named = rest.join(imports.select("file", "name", "target").distinct(), ["file", "name"]).join(there, ["name", "target"]).where("ref_id <> id").select("ref_id", "id", F.lit("import").alias("rule"))
        out, only = out.unionByName(named), only.join(named.select("ref_id"), "ref_id", "left_anti")
    return out.unionByName(only)


def leveled(spans: DataFrame, start: str, last: str, width: int) -> DataFrame:
    """Spans ``[start, last]`` filed under bins of their own size's level, two at most: adds ``level`` and ``bin``."""
    size = F.greatest(F.col(last) - F.col(start) + 1, F.lit(1))
    out = spans.withColumn("level", F.greatest(F.ceil(F.log2(size / width)), F.lit(0)).cast("int"))
    wide = F.lit(width) * F.pow(F.lit(2), F.col("level")).cast("long")
    return out.withColumn("bin", F.explode(F.array_distinct(F.array(F.floor(F.col(start) / wide), F.floor(F.greatest(start, last) / wide)))))


def at_levels(points: DataFrame, offset: str, spans: DataFrame, width: int) -> DataFrame:
    """Points with the bin that each level of their file's ``leveled`` spans has for them: a row for each doubling of span
    sizes that the file has."""
    levels = spans.select("file", "level").distinct()
    return points.join(levels, "file").withColumn("bin", F.floor(F.col(offset) / (F.lit(width) * F.pow(F.lit(2), F.col("level")).cast("long"))))


def enclosing(refs: DataFrame, nodes: DataFrame, width: int = 1024) -> DataFrame:
    """The narrowest symbol around each offset, else the last that starts at or before it.

    ``refs(ref_id, file, offset)``, ``nodes(id, file, span_start, span_end)``. Spans stand under two bins at most, so the
    range join is an equi-join on file, level and bin; the fallback is one pass in order of offsets.
    """
    spans = leveled(nodes.select("id", "file", "span_start", "span_end"), "span_start", "span_end", width)
    hit = at_levels(refs, "offset", spans, width).join(spans, ["file", "level", "bin"]).where("offset BETWEEN span_start AND span_end")
    near = hit.groupBy("ref_id").agg(F.min(F.struct((F.col("span_end") - F.col("span_start")).alias("w"), "span_start", "id")).getField("id").alias("inner"))
    last = F.last("node", True).over(Window.partitionBy("file").orderBy("at", "is_ref", "node").rowsBetween(Window.unboundedPreceding, 0))
    line = refs.select("file", F.col("offset").alias("at"), F.lit(1).alias("is_ref"), F.lit(None).cast("long").alias("node"), "ref_id").union(
        nodes.select("file", "span_start", F.lit(0), "id", F.lit(None).cast("long")))
    before = line.withColumn("before", last).where("is_ref = 1").select("ref_id", "before")
    return before.join(near, "ref_id", "left").select("ref_id", F.coalesce("inner", "before").alias("id"), F.col("inner").isNotNull().alias("contained"))


def unique_mentions(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """``words(source, word)`` that name exactly one node, not the source itself."""
    only = nodes.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    return words.join(only, F.col("word") == F.col("name")).where("source <> id").select("source", "id").distinct()


def token_links(files: DataFrame, defs: DataFrame) -> DataFrame:
    """Tokens of ``files(file, content)`` that definitions ``defs(id, name, file)`` of other files have, adjacent repeats dropped."""
    t = files.select(F.col("file").alias("from_file"), F.explode(T.tokens("content")).alias("token"))
    hit = t.join(defs, F.col("token") == F.col("name")).where("from_file <> file")
    before = F.lag("file").over(Window.partitionBy("from_file").orderBy("token", "id"))
    return hit.withColumn("before", before).where("before IS NULL OR before <> file").select("from_file", F.col("file").alias("to_file"), "id", "token")


def injections(fields: DataFrame, classes: DataFrame) -> DataFrame:
    """Fields named like the end of a class in another file: ``fields(id, name, file)``, ``classes(id, name, file)``.

    A class's ends of four characters or more become rows, so the join is by equality.
    """
    c = classes.select(F.col("id").alias("class_id"), F.lower("name").alias("c"), F.col("file").alias("class_file")).where("length(c) >= 4")
    ends = c.select("class_id", "class_file", F.explode(F.transform(F.sequence(F.lit(1), F.length("c") - 3), lambda i: F.substring(F.col("c"), i, F.length("c")))).alias("end"))
    return fields.where(F.octet_length("name") >= 4).join(ends, F.lower("name") == F.col("end")).where("file <> class_file").select("id", "class_id").distinct()


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge per (from, to, kind), the earliest pass wins: ``edges`` has ``pass``."""
    w = Window.partitionBy("from_id", "to_id", "kind").orderBy("pass", "origin", F.desc("confidence"))
    return edges.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def cross_language(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    lang = nodes.select("id", T.language("file").alias("lang"))
    a, b = (lang.select(F.col("id").alias(f"{s}_id"), F.col("lang").alias(f"{s}_lang")) for s in ("from", "to"))
    return edges.join(a, "from_id").join(b, "to_id").where("from_lang <> to_lang")


def relink(lost: DataFrame, nodes: DataFrame) -> DataFrame:
    """New ids for edges into a reindexed file: ``lost(edge_id, qualified, name, file)`` by qualified name, else bare name."""
    by_q = nodes.groupBy(F.col("qualified_name").alias("qualified"), "file").agg(F.min("id").alias("q_id"))
    by_n = nodes.groupBy("name", "file").agg(F.min("id").alias("n_id"))
    return lost.join(by_q, ["qualified", "file"], "left").join(by_n, ["name", "file"], "left").select("edge_id", F.coalesce("q_id", "n_id").alias("id"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols added and removed, as sets of (name, file, kind)."""
    cols = ["name", "file", "kind"]
    gone, come = old.select(*cols).subtract(new.select(*cols)), new.select(*cols).subtract(old.select(*cols))
    return come.withColumn("change", F.lit("added")).union(gone.withColumn("change", F.lit("removed")))


def fuzzy(nodes: DataFrame, query: str, limit: int = 1024) -> DataFrame:
    """Names that hold the query, ASCII case aside: equal ones (0), those that start with it (1), others (2), shorter
    names and smaller ids first. Without any, names whose beginning is within an edit (queries of three bytes or less)
    or two of it, over bytes, as 3 plus the distance."""
    q = "".join(c.lower() if c.isascii() else c for c in query)
    name, size = T.ascii_lower("name"), len(q.encode())
    rank = F.when(name == q, 0).when(name.startswith(q), 1).otherwise(2)
    inside = nodes.where(F.contains(name, F.lit(q))).withColumn("score", rank)
    most = 1 if size < 4 else 2
    begin = F.substring(T.utf8_bytes(name), 1, size + most)
    near = nodes.withColumn("score", F.levenshtein(begin, T.utf8_bytes(F.lit(q)), most)).where("score >= 0").withColumn("score", F.col("score") + 3)
    out = near if inside.isEmpty() else inside
    return out.orderBy("score", F.octet_length("name"), "id").limit(limit).select("id", "name", F.col("score").cast("int").alias("score"))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def invalidate(graph_nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of changed files and the edges that these files evidence or end in."""
    nodes = graph_nodes.join(changed.select("file"), "file", "left_anti")
    kept = edges.join(changed.select(F.col("file").alias("evidence_file")), "evidence_file", "left_anti")
    return nodes, drop_dangling(kept, nodes)


def mark_stale(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Evidence-preserving: ``changed(file, removed)`` makes nodes Stale or Gone."""
    return nodes.join(changed, "file", "left").withColumn("status", F.when(F.col("removed"), "Gone").when(F.col("removed").isNotNull(), "Stale").otherwise(F.col("status"))).drop("removed")
