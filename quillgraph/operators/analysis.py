"""Statistics, risk, dead code, inconsistencies and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import CODE_KINDS, STRUCTURAL_KINDS, CodeGraph, current_confidence, impact_edges, trust_model
from .traverse import risk_cone

#: Kinds that count as types, and kinds that are data.
TYPE_KINDS = ["Class", "Interface", "Trait", "Enum", "Struct", "TypeAlias", "Module", "Namespace"]
DATA_KINDS = ["ConfigKey", "StringLiteral", "DocSection"]


def stats(graph: CodeGraph) -> DataFrame:
    n = graph.nodes.agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"))
    return n.join(F.broadcast(graph.edges.agg(F.count("*").alias("edges"))))  # one row each


def histogram(df: DataFrame, of: str | Column) -> DataFrame:
    return df.groupBy((F.col(of) if isinstance(of, str) else of).alias("value")).agg(F.count("*").alias("n"))


def trust_histogram(graph: CodeGraph) -> DataFrame:
    return histogram(graph.edges, trust_model())


def in_degree_top(graph: CodeGraph, k: int) -> DataFrame:
    return impact_edges(graph).groupBy("to_id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "to_id").limit(k)


def degrees(graph: CodeGraph) -> DataFrame:
    e = graph.edges
    ends = e.select(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(e.select("from_id", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def top_files(graph: CodeGraph, k: int) -> DataFrame:
    return graph.nodes.groupBy("file").agg(F.count("*").alias("symbols")).orderBy(F.desc("symbols"), "file").limit(k)


def language_census(files: DataFrame) -> DataFrame:
    """Files of each language; ``files(file)``."""
    return files.groupBy(T.language("file").alias("lang")).agg(F.count("*").alias("n"))


def primary_language(files: DataFrame) -> DataFrame:
    """The language of most files, the least name on ties; no row without files of a known one."""
    return language_census(files).where("lang NOT IN ('unknown', 'config')").orderBy(F.desc("n"), "lang").limit(1)


def file_packages(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Each file's deepest package: ``files(file)``, ``packages(package, path)``; by all prefixes of its path, an equi-join."""
    parts = F.split("file", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("deep"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path")))
    rows = files.select("file", F.explode(prefixes).alias("x")).select("file", "x.deep", "x.path").join(packages, "path")
    return rows.groupBy("file").agg(F.max_by("package", "deep").alias("package"))


def package_stats(graph: CodeGraph, packages: DataFrame) -> DataFrame:
    """Symbols by their file and edges by their evidence's file for every package, which may have only one of them.

    A package of path "." takes what no other has; without it that is "(no package)". An empty file is "(external)".
    """
    root = packages.where("path = '.'").select(F.col("package").alias("root"))
    counts = graph.nodes.groupBy("file").agg(F.count("*").alias("symbols"), F.lit(0).cast("long").alias("edges")).union(
        graph.edges.groupBy("evidence_file").agg(F.lit(0).cast("long"), F.count("*")))
    counts = counts.groupBy("file").agg(F.sum("symbols").alias("symbols"), F.sum("edges").alias("edges"))
    of = file_packages(counts.select("file"), packages.where("path <> '.'"))
    rest = F.broadcast(root.agg(F.min("root").alias("root")))  # one row
    named = counts.join(of, "file", "left").join(rest)
    package = F.when(F.col("file") == "", "(external)").otherwise(F.coalesce("package", "root", F.lit("(no package)")))
    return named.groupBy(package.alias("package")).agg(F.sum("symbols").alias("symbols"), F.sum("edges").alias("edges"))


def orphans(graph: CodeGraph) -> DataFrame:
    """Code symbols that no meaningful edge touches, with their bucket: tests, library API, likely dead."""
    e = graph.edges.where(~F.col("kind").isin(STRUCTURAL_KINDS))
    ends = e.select(F.col("from_id").alias("id")).union(e.select("to_id")).distinct()
    out = graph.nodes.where(F.col("kind").isin(CODE_KINDS)).join(ends, "id", "left_anti")
    bucket = F.when(T.is_test_path("file") | F.coalesce("is_test", F.lit(False)), "test").when(T.is_public("name", "visibility"), "library_api").otherwise("likely_dead")
    return out.withColumn("bucket", bucket)


def visibility_score() -> Column:
    """By declared visibility; where it is unknown by name and ``node_kind``."""
    private = F.col("name").startswith("_") | F.contains("name", F.lit("::impl#"))
    guess = F.when(private, 0.4).when(F.col("node_kind").isin(TYPE_KINDS), 1.0).otherwise(0.75)
    return F.when(F.col("visibility") == "Public", 1.0).when(F.col("visibility") == "Private", 0.4).otherwise(guess)


def risk(graph: CodeGraph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Risk of changing each seed: callers, confidence-weighted impact, module spread, share of breaking edges, score, band."""
    cone = risk_cone(graph, seeds, depth).join(graph.nodes.select("id", "file"), "id").withColumn("module", T.module_of("file"))
    modules = cone.groupBy("seed", "module").agg(F.count("*").alias("n"), F.sum("conf").alias("cwi"), F.max("conf").alias("best"))
    per = modules.groupBy("seed").agg(F.sum("n").alias("callers"), F.sum("cwi").alias("cwi"), F.count("*").alias("modules"), F.sum("best").alias("spread"))
    breaking = F.col("kind").isin("Calls", "Extends", "Implements", "Overrides", "References", "Resolves", "DependsOn")
    live = graph.edges.withColumn("c", current_confidence()).groupBy(F.col("to_id").alias("id")).agg((F.sum(F.when(breaking, F.col("c")).otherwise(0.0)) / F.sum("c")).alias("kind_factor"))
    base = seeds.join(graph.nodes.select("id", "visibility", "name", F.col("kind").alias("node_kind")), "id").join(per, "seed", "left").join(live, "id", "left")
    base = base.fillna(0, ["callers", "cwi", "modules", "spread", "kind_factor"])
    vis = visibility_score()
    cap = lambda c, m: F.least(F.col(c) / m, F.lit(1.0))
    score = 0.20 * vis + 0.45 * cap("cwi", 20.0) + 0.25 * F.least(F.greatest("spread", F.lit(1.0)) / 10.0, F.lit(1.0)) + 0.10 * F.col("kind_factor")
    band = F.when(F.col("score") >= 0.8, "critical").when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.4, "medium").otherwise("low")
    radius = (
        F.when((F.col("modules") > 10) | (F.col("callers") > 50), "critical").when((F.col("modules") > 5) | (F.col("callers") > 20), "high")
        .when((F.col("modules") >= 3) | (F.col("callers") >= 6), "medium").otherwise("low"))
    return base.withColumn("score", score).withColumn("band", band).withColumn("radius", radius).select("seed", "callers", "cwi", "modules", "spread", "kind_factor", "score", "band", "radius")


def affected_tests(graph: CodeGraph, seeds: DataFrame, depth: int = 3) -> DataFrame:
    n = graph.nodes.where(F.col("kind").isin("Function", "Method") & (F.col("is_test") | T.is_test_path("file")))
    return risk_cone(graph, seeds, depth).join(n.select("id", "name", "file"), "id").select("seed", "id", "name", "dist", "conf")


def enum_variants(variants: DataFrame) -> DataFrame:
    """``variants(id, parent, literal)`` that can mismatch, with ``norm``, the normalised literal."""
    return variants.withColumn("norm", T.enum_literal("literal")).where("parent <> '' AND norm <> '' AND norm NOT IN ('none', 'default', 'unknown')")


def enum_mismatches(variants: DataFrame) -> DataFrame:
    """``variants(id, parent, literal)``: equal literals (normalised) under different, non-empty parents, each pair once."""
    n = enum_variants(variants)
    a, b = (n.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "parent")], F.col("norm").alias("norm" if s == "a" else "norm_b")) for s in "ab")
    return a.join(b, F.col("norm") == F.col("norm_b")).where("a_parent <> b_parent AND a_id < b_id").select("a_id", "b_id", "norm")


def enum_mismatch_counts(variants: DataFrame) -> DataFrame:
    """Pairs that ``enum_mismatches`` has of each norm, without making them: all pairs but those of one parent or one id.

    Pairs of one parent and one id would be taken off twice.
    """
    each = enum_variants(variants).where("id IS NOT NULL").groupBy("norm", "parent", "id").agg(F.count("*").alias("n"))
    pairs = lambda n: F.expr(f"sum({n} * ({n} - 1) div 2)")
    both = each.groupBy("norm").agg(F.sum("n").alias("n"), pairs("n").alias("both"))
    parents = each.groupBy("norm", "parent").agg(F.sum("n").alias("n")).groupBy("norm").agg(pairs("n").alias("parents"))
    ids = each.groupBy("norm", "id").agg(F.sum("n").alias("n")).groupBy("norm").agg(pairs("n").alias("ids"))
    count = F.expr("n * (n - 1) div 2") - F.col("parents") - F.col("ids") + F.col("both")
    return both.join(parents, "norm").join(ids, "norm").select("norm", count.alias("pairs")).where("pairs > 0")


def _forks(one: DataFrame, parts: int = 16) -> DataFrame:
    """``one(id, b)`` with the positions of bytes that another ``b`` goes on differently at, read forwards (``fore``) and backwards (``back``)."""
    i, end = F.col("i"), F.lit(1 << 30)
    at = one.select("id", "b", F.explode(F.sequence(F.lit(0), F.length("b") + 1)).alias("i"))
    ways = F.array(F.struct(F.lit(True).alias("fore"), F.xxhash64(F.substring("b", F.lit(1), i - 1), F.lit(1)).alias("key")), F.struct(F.lit(False).alias("fore"), F.xxhash64(F.substring("b", i + 1, end), F.lit(2)).alias("key")))
    at = at.select("id", "i", F.when((i > 0) & (i <= F.length("b")), F.substring("b", i, F.lit(1))).otherwise("").alias("c"), F.length("b").alias("n"), F.explode(ways).alias("x")).select("id", "i", "c", "n", "x.*")
    at = at.where(F.when(F.col("fore"), i > 0).otherwise(i <= F.col("n")))
    # frequent beginnings are dealt to several tasks
    forks = at.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key", F.explode(F.array(*map(F.lit, range(parts)))).alias("part"))
    here = at.where("i BETWEEN 1 AND n").withColumn("part", F.pmod("id", F.lit(parts)).cast("int")).join(forks, ["key", "part"], "left_semi")
    spots = here.groupBy("id").agg(*[F.collect_set(F.when(F.col("fore") == w, i)).alias(c) for w, c in ((True, "fore"), (False, "back"))])
    none = F.array().cast("array<int>")
    return one.select("id", "b").join(spots, "id", "left").select("id", "b", F.coalesce("fore", none).alias("fore"), F.coalesce("back", none).alias("back"))


def _edited(one: DataFrame, most: int) -> DataFrame:
    """``one(id, b)`` with up to ``most`` bytes replaced by a mark (``subs``) or deleted (``cuts``), from left to right, as ``w``.

    Two texts without what they begin and end with alike differ at once at both ends. So of ``most`` edits in one text
    the first is where texts fork forwards and the last where they fork backwards, or all are deletions side by side; of
    one edit less, one of both holds, as the other text may have an edit at one end.
    """
    mark, rest = "\u0100", F.substring("b", F.col("at") + 1, F.lit(1 << 30))  # no byte
    step = _forks(one).select("id", "b", "fore", "back", F.lit("").alias("head"), *[F.lit(0).alias(c) for c in ("at", "subs", "cuts", "start")])
    out = step.select("id", "b", "subs", "cuts")
    for done in range(1, most + 1):
        i, cut = F.col("i"), F.col("cut")
        step = step.where(F.col("at") < F.length("b")).select("*", F.explode(F.sequence(F.col("at") + 1, F.length("b"))).alias("i"))
        step = step.withColumn("start", F.when(F.col("at") == 0, i).otherwise(F.col("start")))
        fore, back = F.array_contains("fore", F.col("start")), F.array_contains("back", i)
        if done == most:
            step = step.where(fore & (back | (i == F.col("start") + most - 1)))
        elif done == most - 1:
            step = step.where(fore | back)
        step = step.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("cut"))
        if done == most:
            step = step.where(back | (F.col("cuts") + cut == most))
        head = F.concat("head", F.substring("b", F.col("at") + 1, i - F.col("at") - 1), F.when(cut == 0, mark).otherwise(""))
        step = step.select("id", "b", "fore", "back", head.alias("head"), i.alias("at"), (F.col("subs") + 1 - cut).alias("subs"), (F.col("cuts") + cut).alias("cuts"), "start")
        out = out.union(step.select("id", F.concat("head", rest).alias("w"), "subs", "cuts"))
        if done == most - 1:
            step = step.where(F.array_contains("fore", F.col("start")))
    return out.toDF("id", "w", "subs", "cuts")


def near_paths(paths: DataFrame, most: int = 2) -> DataFrame:
    """``paths(path, file)``: pairs of paths at an edit distance of 1 to ``most`` bytes, each unordered pair once.

    Both have two segments or more, lengths differ by at most 20 %, and they are in different files. Strings within
    ``most`` edits are equal once the bytes that differ are marked in both and what only one has is deleted from it; they
    meet by a hash of that, so only pairs within ``most`` edits meet, however much of a path many others begin with.
    Paths go by 64-bit hashes until pairs are found; these are verified.
    """
    one = paths.where(T.segment_count("path") >= 2).groupBy("path").agg(F.min("file").alias("lo"), F.max("file").alias("hi")).withColumn("b", T.utf8_bytes("path")).withColumn("id", F.xxhash64("path"))
    forms = _edited(one, most)
    # the longer path has as many deletions or more: it looks for each number that the other may have
    room = F.lit(most) - F.col("subs") - F.col("cuts")
    asks = forms.where("cuts > 0 OR subs > 0").select(F.col("id").alias("x"), "w", "cuts", F.explode(F.sequence(F.lit(0), F.least("cuts", room))).alias("k"))
    asks = asks.select("x", F.xxhash64("w", "k").alias("key"), (F.col("cuts") == F.col("k")).alias("even"))
    has = forms.where(F.col("cuts") <= room).select(F.col("id").alias("y"), F.xxhash64("w", "cuts").alias("key"))
    # forms are many times the paths, which sizes that Spark estimates don't show: they are never broadcast
    pairs = asks.join(has.hint("merge"), "key").where("x < y OR NOT even").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    side = lambda n: one.select(F.col("id").alias(n), F.struct("path", "b", "lo", "hi").alias(f"{n}_"))
    near = pairs.join(side("x"), "x").join(side("y"), "y").where("x_.path <> y_.path")
    near = near.select(F.least("x_", "y_").alias("p"), F.greatest("x_", "y_").alias("q"))
    b, b2 = F.col("p.b"), F.col("q.b")
    close = F.abs(F.length(b) - F.length(b2)) * 5 <= F.greatest(F.length(b), F.length(b2))
    files = ~((F.col("p.lo") == F.col("p.hi")) & (F.col("q.lo") == F.col("q.hi")) & (F.col("p.lo") == F.col("q.lo")))
    found = near.where(close & files).select(F.col("p.path").alias("path"), F.col("q.path").alias("other"), F.levenshtein(b, b2, most).alias("distance"))
    return found.where(f"distance BETWEEN 1 AND {most}").where(~T.version_only("path", "other"))


def missing_keys(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References ``refs(key)`` without a definition ``defs(key)``, by canonical key."""
    return refs.withColumn("canon", T.config_key("key")).join(defs.select(T.config_key("key").alias("canon")).distinct(), "canon", "left_anti")


def unused_keys(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """Definitions ``defs(id, key, file)`` never referenced, in files of which another key is; the last of a key counts."""
    canon = refs.select(T.config_key("key").alias("canon")).distinct()
    all_ = defs.withColumn("canon", T.config_key("key"))
    live = all_.join(canon, "canon", "left_semi").select("file").distinct()
    last = all_.groupBy("canon").agg(F.max_by(F.struct("id", "key", "file"), "id").alias("d")).select("canon", "d.*")
    return last.join(canon, "canon", "left_anti").join(live, "file", "left_semi").select("id", "key", "file")


def noise_files(nodes: DataFrame, total: int | None = None, least: int = 200, graph_percent: int = 5, file_percent: int = 90, k: int = 5) -> DataFrame:
    """Files that hold mostly data symbols and a good part of the graph; symbols without a file count for the graph alone."""
    total = nodes.count() if total is None else total
    data = F.col("kind").isin(DATA_KINDS)
    per = nodes.where("file <> ''").groupBy("file").agg(F.count("*").alias("n"), F.sum(data.cast("long")).alias("data"))
    ok = (F.col("data") >= least) & (F.floor(F.col("data") * 100 / total) >= graph_percent) & (F.floor(F.col("data") * 100 / F.col("n")) >= file_percent)
    return per.where(ok).orderBy(F.desc("data"), "file").limit(k).withColumn("share", F.floor(F.col("data") * 100 / total))


def pair_projection(values: DataFrame, caps: list[int]) -> DataFrame:
    """``values(value, file)``: pairs across files that each cap on a value's files would leave (cap 0: all)."""
    per = values.groupBy("value", "file").agg(F.count("*").alias("n")).groupBy("value").agg(
        F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("own"), F.count("*").alias("files"))
    per = per.withColumn("pairs", F.col("m") * (F.col("m") - 1) / 2 - F.col("own"))
    kept = [F.sum(F.when(F.lit(c == 0) | (F.col("files") <= c), F.col("pairs")).otherwise(0)).cast("long").alias(str(c)) for c in caps]
    sums = per.agg(*kept)
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("cap"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("pairs")) for c in caps])).alias("x")).select("x.*")


def units(nodes: DataFrame, least: int = 40, percent: int = 12) -> DataFrame:
    """Top directories, expanded to their children where they have two or more and are large; "(root)" for files in none."""
    p = nodes.select(F.split("file", "/").alias("p"))
    p = p.select(F.when(F.size("p") > 1, F.element_at("p", 1)).otherwise("(root)").alias("top"), F.when(F.size("p") > 2, F.element_at("p", 2)).alias("sub"))
    rows = p.groupBy("top", "sub").agg(F.count("*").alias("n"))
    tops = rows.groupBy("top").agg(F.sum("n").alias("t"), F.count("sub").alias("children"))
    whole = rows.agg(F.sum("n").alias("all"))
    wide = tops.join(F.broadcast(whole)).withColumn("wide", (F.col("children") >= 2) & ((F.col("t") >= least) | (F.col("t") * 100 >= percent * F.col("all")))).select("top", "wide")
    named = rows.join(wide, "top").withColumn("unit", F.when(F.col("wide") & F.col("sub").isNotNull(), F.concat_ws("/", "top", "sub")).otherwise(F.col("top")))
    return named.groupBy("unit").agg(F.sum("n").alias("n"))
