"""From source texts to a graph: symbols with ids, and the link passes in their order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..model import CodeGraph, settled, stored_confidence
from ..sources import extract
from . import imports, inconsistencies, linking, lookup, mediators

EDGE = ["from_id", "to_id", "kind", "origin", "evidence_file"]
#: The kind of edge that a reference of each kind becomes.
REFERENCE_EDGES = {"Call": "Calls", "TypeUse": "References", "ValueRef": "References", "Import": "Imports", "Extends": "Extends", "Implements": "Implements"}
TYPE_LIKE = ["Class", "Struct", "Trait", "Interface", "Enum", "TypeAlias"]
DOC_KINDS = ["DocComment", "DocSection"]
NOT_NAMED = [*DOC_KINDS, "File", "Module"]
#: Patterns of type annotations by language, of links in doc comments, and of type arguments.
TYPE_PATTERNS = {
    "rust": [r"let\s+(?:mut\s+)?[A-Za-z_][A-Za-z0-9_]*\s*:\s*([A-Z][A-Za-z0-9_]*)", r"(?:->|:)\s*(?:&(?:mut\s+)?)?([A-Z][A-Za-z0-9_]*)"],
    "typescript": [r"(?:let|const|var)\s+[A-Za-z_][A-Za-z0-9_]*\s*:\s*([A-Z][A-Za-z0-9_]*)", r"[A-Za-z_][A-Za-z0-9_]*\s*:\s*([A-Z][A-Za-z0-9_]*)"],
    "java": [r"(?m)^\s*(?:private|protected|public)?\s*(?:final\s+)?([A-Z][A-Za-z0-9_]+)\s+[a-z][A-Za-z0-9_]*\s*[=;]", r"\(([A-Z][A-Za-z0-9_]+)\s+[a-z][A-Za-z0-9_]*"],
}
TYPE_EXTENSIONS = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "java"}
DOC_LINKS = [r"\[`([^`]+)`\]", r"\{@link(?:code|plain)?\s+([^}|]+)"]
TYPE_ARGUMENT = r"[A-Z][A-Za-z0-9_]*\s*<\s*([A-Z][A-Za-z0-9_]+)(?:\s*,\s*[A-Z][A-Za-z0-9_]+)*\s*>"


def numbered(rows: DataFrame, order: list, first: int = 1, name: str = "id") -> DataFrame:
    """``rows`` with consecutive numbers in an order: sorted by ranges, counted by range, numbered in each."""
    placed = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", (before + first - 1).alias("__start"))  # a row for each partition
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.withColumn("__at", at).join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__at")).cast("long")).drop("__part", "__at", "__start")


def symbol_nodes(facts: DataFrame) -> DataFrame:
    """Nodes of all files' symbols; ids in order of file, place, kind and name."""
    rows = facts.where("what = 'symbol' AND kind <> 'DocSection'").select("file", "kind", "name", "span_start", "span_end", "visibility", "is_test").distinct()
    out = numbered(rows, ["file", "span_start", "span_end", "kind", "name"])
    return out.select("id", "kind", "name", F.col("name").alias("qualified_name"), "file", "span_start", "span_end", F.lit("Verified").alias("status"), "visibility", F.coalesce("is_test", F.lit(False)).alias("is_test"))


def _made(rows: DataFrame, kind: str, first: int, order: list) -> DataFrame:
    """Further nodes ``(name, file, span_start, span_end, ...)`` with ids from ``first`` on."""
    out = numbered(rows, order, first)
    extra = [c for c in rows.columns if c not in ("name", "file", "span_start", "span_end")]
    return out.select(
        "id", F.lit(kind).alias("kind"), "name", F.col("name").alias("qualified_name"), "file", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"),
        F.lit("Verified").alias("status"), F.lit("Unknown").alias("visibility"), F.lit(False).alias("is_test"), *extra)


def _edges(rows: DataFrame, kind: str | Column, origin: str | Column) -> DataFrame:
    """Edges of ``rows(from_id, to_id, evidence_file)``, none from a node to itself."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.where("from_id <> to_id").select("from_id", "to_id", as_column(kind).alias("kind"), as_column(origin).alias("origin"), "evidence_file")


def structure(nodes: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """File and Module nodes, with Contains edges from a file to its symbols and BelongsTo edges to their module.

    Files that have no module of their own share one by name, which stands in the file that represents it best.
    Modules and namespaces are no children, nor are doc comments and sections.
    """
    here = nodes.where("file <> ''")
    children = here.where(~F.col("kind").isin("File", "Module", "Namespace", *DOC_KINDS)).select("id", "file")
    files = children.select("file").distinct()
    lacking = files.join(here.where("kind = 'File'").select("file"), "file", "left_anti")
    new_files = settled(_made(lacking.select(P.file_name("file").alias("name"), "file", F.lit(0).alias("span_start"), F.lit(0).alias("span_end")), "File", first, ["file"]))
    file_ids = here.where("kind = 'File'").groupBy("file").agg(F.max("id").alias("file_id")).unionByName(new_files.select("file", F.col("id").alias("file_id")))
    contains = _edges(children.join(file_ids, "file").select(F.col("file_id").alias("from_id"), F.col("id").alias("to_id"), F.col("file").alias("evidence_file")), "Contains", "CompilerDerived")
    own = here.where(F.col("kind").isin("Module", "Namespace")).groupBy("file").agg(F.max("id").alias("module_id"))
    without = files.join(own.select("file"), "file", "left_anti")
    known = nodes.where("kind = 'Module'").groupBy("name").agg(F.min("id").alias("module_id"))
    shared = without.select("file", P.synthetic_module("file").alias("name"))
    wanted = shared.select("name").distinct().join(known.select("name"), "name", "left_anti")
    stands = lookup.representatives(without, P.synthetic_module("file"), P.module_score("file")).withColumnRenamed("module", "name")
    rows = wanted.join(stands, "name").select("name", "file", F.lit(0).alias("span_start"), F.lit(0).alias("span_end"))
    new_modules = settled(_made(rows, "Module", first + new_files.count(), ["name"]))
    by_name = known.unionByName(new_modules.select("name", F.col("id").alias("module_id")))
    module_of = own.unionByName(shared.join(by_name, "name").select("file", "module_id"))
    belongs = _edges(children.join(module_of, "file").select(F.col("id").alias("from_id"), F.col("module_id").alias("to_id"), F.col("file").alias("evidence_file")), "BelongsTo", "CompilerDerived")
    return new_files.unionByName(new_modules), contains.unionByName(belongs)


def documents(facts: DataFrame, nodes: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """Doc comments as nodes, each with an edge to the symbol of exactly the span it is attached to."""
    spots = facts.where("what = 'doc'").select("file", F.col("span_start").alias("start"), F.col("span_end").alias("end"), "doc_start", "doc_end").distinct()
    last = nodes.where(~F.col("kind").isin(NOT_NAMED)).groupBy("file", F.col("span_start").alias("start"), F.col("span_end").alias("end")).agg(F.max_by(F.struct("id", "name"), "id").alias("s"))
    rows = spots.join(last, ["file", "start", "end"]).select(F.concat(F.lit("doc::"), "s.name").alias("name"), "file", F.col("doc_start").alias("span_start"), F.col("doc_end").alias("span_end"), F.col("s.id").alias("of"))
    made = settled(_made(rows, "DocComment", first, ["file", "span_start", "of"]))
    origin = F.when(T.language("evidence_file") == "go", "PatternMatched").otherwise("SyntaxMatched")
    edges = _edges(made.select(F.col("id").alias("from_id"), F.col("of").alias("to_id"), F.col("file").alias("evidence_file")), "Documents", origin)
    return made.drop("of"), edges


def link_targets(text) -> Column:
    """Last identifiers of the link targets in a doc comment: backticks in brackets, and link tags."""
    shown = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in DOC_LINKS])
    first = F.transform(shown, lambda s: F.regexp_replace(F.regexp_extract(s, r"^\s*([^\s|]+)", 1), r"[()]+$", ""))
    last = F.transform(first, lambda s: F.regexp_extract(s, r"([^.#:]*)$", 1))
    return F.filter(last, lambda s: s.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"))


def mentions(docs: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from doc comments to symbols that their links name, where the name is one symbol's alone.

    A comment doesn't mention the symbol that it documents.
    """
    body = F.substring(T.utf8_bytes("content"), (F.col("span_start") + 1).cast("int"), (F.col("span_end") - F.col("span_start")).cast("int"))
    text = docs.join(sources.select("file", "content"), "file").select("id", "name", "file", F.decode(F.encode(body, "ISO-8859-1"), "UTF-8").alias("text"))
    words = text.select(F.col("id").alias("source"), "name", "file", F.explode(F.array_distinct(link_targets(F.col("text")))).alias("word")).where("concat('doc::', word) <> name")
    found = linking.unique_mentions(words.select("source", "word"), nodes.where(~F.col("kind").isin(NOT_NAMED)))
    rows = found.join(docs.select(F.col("id").alias("source"), F.col("file").alias("evidence_file")), "source").select(F.col("source").alias("from_id"), F.col("id").alias("to_id"), "evidence_file")
    return _edges(rows, "Mentions", "PatternMatched")


def sections(facts: DataFrame, nodes: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """Sections of Markdown files that name a symbol in a code span, where the name is one symbol's alone, with edges from
    these symbols."""
    heads = facts.where("what = 'symbol' AND kind = 'DocSection'").select("file", "name", "span_start", "span_end")
    words = facts.where("what = 'ref' AND kind = 'Mention'").select("file", "span_start", F.col("name").alias("word"))
    only = nodes.where(~F.col("kind").isin(NOT_NAMED)).groupBy(F.col("name").alias("word")).agg(F.min("id").alias("symbol"), F.count("*").alias("n")).where("n = 1").drop("n")
    hits = words.join(only, "word").select("file", "span_start", "symbol").distinct()
    rows = heads.join(hits.select("file", "span_start").distinct(), ["file", "span_start"], "left_semi").withColumn("name", F.concat(F.lit("docsection::"), "name"))
    made = settled(_made(rows, "DocSection", first, ["file", "span_start"]))
    edges = made.join(hits, ["file", "span_start"]).select(F.col("symbol").alias("from_id"), F.col("id").alias("to_id"), F.col("file").alias("evidence_file"))
    return made, _edges(edges, "DescribedIn", "PatternMatched")


def references(facts: DataFrame, sources: DataFrame, nodes: DataFrame, first: int, packages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges that references mean, with nodes for external packages.

    A reference comes from the symbol around it (else the last one before it) and goes to the best candidates of its
    name. Names of imports and implemented types that no symbol or path of the project has become external packages.
    Named imports and re-exported stars of scripts go to the symbols of the file that their specifier means.
    """
    places = nodes.where(~F.col("kind").isin(*NOT_NAMED, "StringLiteral", "ConfigKey")).select("id", "file", "span_start", "span_end", "name", "qualified_name")
    rows = facts.where("what = 'ref' AND kind <> 'Mention'").select("file", "kind", "name", F.col("span_start").alias("offset"))
    rows = settled(rows.withColumn("ref", F.monotonically_increasing_id()))
    around = lookup_enclosing(rows.select(F.col("ref").alias("ref_id"), "file", "offset"), places)
    refs = settled(rows.join(around, F.col("ref") == F.col("ref_id")).select("ref", "file", "kind", "name", F.col("id").alias("from_id")))
    names = settled(imports.bindings(sources))
    targets = settled(imports.resolve(names, sources.select("file"), packages))
    # candidates are of a name and a file, so many references of one symbol ask once; the symbol itself is never meant
    asked = refs.select(F.col("from_id"), "file", "name").distinct().withColumn("ask", F.monotonically_increasing_id())
    asked = settled(asked)
    found = _picked(asked, places, imports.import_targets(names, targets))
    met = refs.join(found, ["from_id", "file", "name"]).withColumn("edge", _case("kind", REFERENCE_EDGES))
    origin = F.when(F.col("rule") == "only", "SyntaxMatched").otherwise("NameResolved")
    edges = _edges(met.select("from_id", F.col("id").alias("to_id"), F.col("file").alias("evidence_file"), "edge", "rule"), F.col("edge"), origin)
    inside = sources.select(F.explode(F.split("file", "/")).alias("p")).select(F.regexp_replace("p", r"(?<=.)\.[^.]*$", "").alias("name")).distinct()
    lost = refs.where(F.col("kind").isin("Import", "Implements")).join(places.select("name").distinct(), "name", "left_anti").join(inside, "name", "left_anti")
    external = settled(_made(lost.select("name", F.lit("").alias("file"), F.lit(0).alias("span_start"), F.lit(0).alias("span_end")).distinct(), "ExternalPackage", first, ["name"]))
    out = lost.join(external.select("name", F.col("id").alias("to_id")), "name").withColumn("edge", _case("kind", REFERENCE_EDGES))
    edges = edges.unionByName(_edges(out.select("from_id", "to_id", F.col("file").alias("evidence_file"), "edge"), F.col("edge"), "SyntaxMatched"))
    brought = imports.imported(names.where("what = 'import'"), targets, places).select("file", "id")
    handed = imports.reexported(names.where("what = 'export' AND imported = '*'"), targets, nodes).select("file", "id")
    top = nodes.where("kind = 'File'").groupBy("file").agg(F.min("id").alias("from_id"))
    both = brought.unionByName(handed).distinct().join(top, "file").select("from_id", F.col("id").alias("to_id"), F.col("file").alias("evidence_file"))
    return external, edges.unionByName(_edges(both, "Imports", "NameResolved"))


def lookup_enclosing(refs: DataFrame, places: DataFrame) -> DataFrame:
    return linking.enclosing(refs, places.select("id", "file", "span_start", "span_end")).where("id IS NOT NULL").select("ref_id", "id")


def _picked(asked: DataFrame, places: DataFrame, named: DataFrame) -> DataFrame:
    """Candidates for symbols that ask for a name: ``ref_id`` of the ranking must be unique and tell the asker, so each
    name is ranked with the asker's id where it asks for its own name, and else with an id that no symbol has."""
    own = asked.join(places.select(F.col("id").alias("from_id"), F.col("name").alias("own")), "from_id", "left")
    ref_id = F.when(F.col("own") == F.col("name"), F.col("from_id")).otherwise(-1 - F.col("ask"))
    keyed = own.withColumn("ref_id", ref_id)
    found = linking.candidates(keyed.select("ref_id", "name", "file"), places, named)
    return keyed.join(found, "ref_id").select("from_id", "file", "name", "id", "rule").distinct()


def _case(of: str, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), F.col(of))


def inherits(edges: DataFrame) -> DataFrame:
    """An Inherits edge for each Extends edge of Java and Kotlin files."""
    rows = edges.where((F.col("kind") == "Extends") & F.lower(T.extension("evidence_file")).isin("java", "kt"))
    return _edges(rows.select("from_id", "to_id", "evidence_file"), "Inherits", "NameResolved")


def types(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from a file to the types that its annotations and type arguments name; of a name the first declaration counts."""
    first = lookup.first_of_kind(nodes, TYPE_LIKE)
    files = nodes.where("kind = 'File'").groupBy("file").agg(F.min("id").alias("from_id"))
    language = F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPE_EXTENSIONS.items() for x in pair]), F.lower(T.extension("file")))
    found = F.array().cast("array<string>")
    for name, patterns in TYPE_PATTERNS.items():
        found = F.when(language == name, F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns])).otherwise(found)
    out = []
    for names, kind in ((found, "TypeOf"), (F.regexp_extract_all("content", F.lit(TYPE_ARGUMENT), F.lit(1)), "GenericParam")):
        rows = sources.select("file", F.explode(F.array_distinct(names)).alias("name")).join(first, "name").join(files, "file")
        out.append(_edges(rows.select("from_id", F.col("id").alias("to_id"), F.col("file").alias("evidence_file")), kind, "PatternMatched"))
    return out[0].unionByName(out[1])


def resolved_tokens(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """Resolves edges by words alone: from a file to the definitions that its words name in other files."""
    defs = nodes.where("kind <> 'ExternalPackage' AND file <> ''").select("id", "name", "file")
    files = nodes.where("kind = 'File'").groupBy("file").agg(F.min("id").alias("from_id"))
    found = linking.token_links(sources, defs).join(files, F.col("from_file") == F.col("file"))
    return _edges(found.select("from_id", F.col("id").alias("to_id"), F.col("from_file").alias("evidence_file")), "Resolves", "SyntaxMatched")


#: Passes over finished nodes, by name; further ones can be added. Each gives edges without confidence.
RESOLVERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"tokens": resolved_tokens}


def build(sources: DataFrame, packages: DataFrame | None = None, cap: int = 8) -> CodeGraph:
    """The graph of ``sources(file, content)``, Markdown files among them. Of edges between two nodes of one kind the
    earliest pass's stays. Ids of what passes add follow on those of the symbols."""
    sources = settled(sources.select("file", "content").where("file IS NOT NULL"))
    facts = settled(extract.facts(sources))
    nodes = settled(symbol_nodes(facts))
    passes = [inconsistencies.value_edges(nodes, cap), mediators.mediated(nodes).withColumn("origin", F.lit("ConventionInferred"))]

    def with_more(now: DataFrame, more: DataFrame) -> tuple[DataFrame, int]:
        now = now.unionByName(more)
        return now, (now.agg(F.max("id")).first()[0] or 0) + 1

    nodes, after = with_more(nodes, nodes.limit(0))
    made, edges = structure(nodes, after)
    passes.append(edges)
    nodes, after = with_more(nodes, made)
    docs, edges = documents(facts, nodes, after)
    passes += [edges, mentions(docs, sources, nodes)]
    nodes, after = with_more(nodes, docs)
    made, edges = sections(facts, nodes, after)
    passes.append(edges)
    nodes, after = with_more(nodes, made)
    made, edges = references(facts, sources, nodes, after, packages)
    edges = settled(edges)
    passes += [edges, inherits(edges)]
    nodes = settled(nodes.unionByName(made))
    passes += [resolver(sources, nodes) for resolver in RESOLVERS.values()]
    passes.append(types(sources, nodes))
    all_ = None
    for rank, rows in enumerate(passes):
        rows = rows.select(*EDGE, F.lit(rank).alias("pass"), F.lit(0).cast("long").alias("created_at_epoch"), F.lit(0).alias("stale_evidence_count")).withColumn("confidence", stored_confidence())
        all_ = rows if all_ is None else all_.unionByName(rows)
    return CodeGraph(nodes, settled(linking.dedup_edges(all_).drop("pass")))
