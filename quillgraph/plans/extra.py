"""Further named queries with their DuckDB SQL: filters, pages, places, pairs, imports, link passes, changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import spans
from ..functions import text as T
from ..model import CodeGraph, current_confidence
from ..operators import advice as R
from ..operators import build as B
from ..operators import drift, filters, imports, inconsistencies, lookup, pages
from ..operators import traverse as G
from ..sources import files as S
from ..sources import git
from ..streaming import incremental
from .registry import CUSTOMER, SUPPLIER, query, seeds, table
from .testgraph import WITH, graph

_PRIO = "CASE kind WHEN 'Calls' THEN 0 WHEN 'Implements' THEN 1 WHEN 'Extends' THEN 2 WHEN 'Imports' THEN 5 WHEN 'References' THEN 6 WHEN 'DependsOn' THEN 7 ELSE 19 END"


def _view(spark, d, *names):
    for name in names:
        table(spark, d, name).createOrReplaceTempView(name)


# --- filters -----------------------------------------------------------------------------------------------------------


@query(WITH + ", x AS (SELECT *, from_id % 3 AS epoch FROM e) SELECT kind, count(*) AS n FROM x WHERE epoch >= (SELECT max(epoch) FROM x) GROUP BY 1")
def fresh_edges(spark, d):
    e = graph(spark, d).edges.withColumn("created_at_epoch", F.col("from_id") % 3)
    return filters.fresh(e).groupBy("kind").agg(F.count("*").alias("n"))


@query(WITH + "SELECT kind, count(*) AS n FROM e WHERE kind IN ('Calls', 'Imports', 'DependsOn') GROUP BY 1 UNION ALL SELECT kind, count(*) FROM n WHERE kind IN ('Class', 'Constant') GROUP BY 1")
def kind_filters(spark, d):
    g = graph(spark, d)
    e = filters.edges_of_kinds(g.edges, ["calls", "imports", "depends-on"]).groupBy("kind").agg(F.count("*").alias("n"))
    return e.union(filters.of_kinds(g.nodes, ["class", "Constant", "enum-variant"]).groupBy("kind").agg(F.count("*").alias("n")))


@query(WITH + "SELECT id FROM n WHERE file LIKE '%.rs' OR file LIKE '%.py'")
def language_filter(spark, d):
    return filters.in_languages(graph(spark, d).nodes, ["Rust", "python", "cobol"]).select("id")


@query(WITH + f", k AS (SELECT id FROM n WHERE file LIKE '%.go') SELECT id FROM k WHERE id % 7 = 0 AND id <> {CUSTOMER}")
def kept_and_language(spark, d):
    g = graph(spark, d)
    return filters.kept_ids(g, g.nodes.where(f"id % 7 = 0 AND id <> {CUSTOMER}"), ["go"])


_PATTERNS = ["# names", "orders/", "*.go", "!/crates/part/src/part_1.go", "/crates/region", "**/supplier_[0-4]*.rs"]


@query(WITH + """SELECT DISTINCT file FROM n WHERE NOT (CASE WHEN regexp_matches(file, '/supplier_[0-4][^/]*[.]rs$') THEN true WHEN file LIKE '%.go' THEN file <> 'crates/part/src/part_1.go'
ELSE file LIKE 'crates/orders/%' OR file LIKE 'crates/region/%' END)""")
def path_exclusion(spark, d):
    return filters.not_ignored(graph(spark, d).nodes.select("file").distinct(), _PATTERNS)


@query(WITH + "SELECT DISTINCT file, CASE WHEN file LIKE 'crates/part/src/%' THEN false WHEN file LIKE 'crates/part/%' OR file LIKE 'crates/nation/%' THEN true WHEN file LIKE 'crates/region/%' THEN false ELSE true END AS library FROM n")
def library_files(spark, d):
    packages = spark.createDataFrame([("crates/part", "Library"), ("crates/part/src", "Application"), ("crates/nation", "Library"), ("crates/region", "Unknown"), (".", "Library")], "path string, kind string")
    return filters.library_files(graph(spark, d).nodes.select("file").distinct(), packages)


_LABELS = [("/w/crates/a/src/x.rs", "a (cargo)", False, None), ("/w/packages/ui/__generated__/openapi.ts", "ui (npm)", True, "openapi-codegen"), ("/w/app/src/main/java/X.java", "app (gradle)", False, None),
           ("/w/svc/a.pb.go", "svc (go)", True, "protoc"), ("x.py", "unknown", False, None), ("/w/build/x.g.dart", "unknown", True, "build_runner"), ("/w/target/y.rs", "unknown", False, "build")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{p}', {str(g).lower()}, {repr(t) if t else 'NULL'})" for f, p, g, t in _LABELS) + ") v(file, package, generated, generator)")
def path_annotations(spark, d):
    return filters.annotated(spark.createDataFrame([(f,) for f, *_ in _LABELS], "file string"))


@query(WITH + """, g AS (SELECT id, sum(c) AS degree FROM (SELECT from_id AS id, count(*) AS c FROM e GROUP BY 1 UNION ALL SELECT to_id, count(*) FROM e GROUP BY 1) GROUP BY 1),
v AS (SELECT n.id FROM n JOIN g USING (id) WHERE kind IN ('Class', 'Namespace', 'Function') AND degree BETWEEN 2 AND 60),
f AS (SELECT * FROM e WHERE conf >= CAST(0.5 AS FLOAT) AND origin IN ('NameResolved', 'SyntaxMatched') AND from_id IN (FROM v) AND to_id IN (FROM v))
SELECT id FROM v WHERE id IN (SELECT from_id FROM f) OR id IN (SELECT to_id FROM f)""")
def viewer_filter(spark, d):
    view = filters.View(node_kinds=["Class", "Namespace", "Function"], origins=["NameResolved", "SyntaxMatched"], min_confidence=0.5, min_degree=2, hub_cap=60, hide_isolated=True)
    return filters.viewed(graph(spark, d), view).nodes.select("id")


@query(WITH + f""", v AS (SELECT id FROM n WHERE kind IN ('Function', 'Method') OR id = {CUSTOMER}), f AS (SELECT * FROM e WHERE from_id IN (FROM v) AND to_id IN (FROM v)),
b AS (SELECT from_id AS s, to_id AS t FROM f UNION SELECT to_id, from_id FROM f), r(id, depth) AS (SELECT {CUSTOMER}::BIGINT, 0 UNION SELECT b.t, r.depth + 1 FROM r JOIN b ON b.s = r.id WHERE r.depth < 2)
SELECT DISTINCT id FROM r""")
def ego_focus(spark, d):
    return filters.viewed(graph(spark, d), filters.View(node_kinds=["Function", "Method"]), focus=CUSTOMER, depth=2).nodes.select("id")


# --- pages and places --------------------------------------------------------------------------------------------------


@query(WITH + """, f AS (SELECT * FROM e WHERE conf >= CAST(0.7 AS FLOAT)), c AS (SELECT * FROM (VALUES (1, 20000000001::BIGINT), (2, 20000000002::BIGINT)) c(rank, id)),
i(rank, id, depth) AS (SELECT rank, id, 1 FROM c UNION SELECT i.rank, f.from_id, i.depth + 1 FROM i JOIN f ON f.to_id = i.id WHERE i.depth < 2),
o(rank, id, depth) AS (SELECT rank, id, 1 FROM c UNION SELECT o.rank, f.to_id, o.depth + 1 FROM o JOIN f ON f.from_id = o.id WHERE o.depth < 2),
x AS (SELECT 'incoming' AS direction, m.rank, m.depth, f.from_id, f.to_id, f.kind FROM (SELECT rank, id, min(depth) AS depth FROM i GROUP BY 1, 2) m JOIN f ON f.to_id = m.id
  UNION ALL SELECT 'outgoing', m.rank, m.depth, f.from_id, f.to_id, f.kind FROM (SELECT rank, id, min(depth) AS depth FROM o GROUP BY 1, 2) m JOIN f ON f.from_id = m.id)
SELECT direction, depth, from_id, to_id, kind FROM x QUALIFY row_number() OVER (PARTITION BY direction, from_id, to_id, kind ORDER BY rank, depth) = 1""")
def aggregated_neighborhood(spark, d):
    centers = spark.createDataFrame([(1, 20000000001), (2, 20000000002)], "rank long, id long")
    return pages.around(graph(spark, d), centers, pages.Options(depth=2)).select("direction", "depth", "from_id", "to_id", "kind")


@query(WITH + f"SELECT direction, depth, from_id, to_id, kind FROM (SELECT 'outgoing' AS direction, 1 AS depth, * FROM e WHERE from_id = {CUSTOMER} UNION ALL SELECT 'incoming', 1, * FROM e WHERE to_id = {CUSTOMER}) ORDER BY direction = 'incoming', depth, {_PRIO}, from_id, to_id, kind LIMIT 5 OFFSET 5")
def neighborhood_page(spark, d):
    found = G.neighborhood(graph(spark, d), seeds(spark, CUSTOMER), 1)
    return pages.page(found, 2, 5).select("direction", "depth", "from_id", "to_id", "kind")


@query(WITH + f"SELECT 'incoming' AS direction, from_id, to_id FROM e WHERE to_id = {CUSTOMER} AND kind = 'Calls'")
def directed_edges(spark, d):
    found = G.neighborhood(graph(spark, d), seeds(spark, CUSTOMER), 1)
    return filters.directed(filters.edges_of_kinds(found, ["calls"]), "incoming").select("direction", "from_id", "to_id")


@query(WITH + ", b AS (SELECT from_id AS s, to_id AS t FROM e UNION SELECT to_id, from_id FROM e), m AS (SELECT id FROM n WHERE kind IN ('Class', 'Namespace', 'Struct')), " + f"r(id, depth) AS (SELECT {SUPPLIER}::BIGINT, 0 UNION SELECT b.t, r.depth + 1 FROM r JOIN b ON b.s = r.id WHERE r.depth < 3 AND b.t IN (FROM m)) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def hops_within_set(spark, d):
    g = graph(spark, d)
    return G.hops_within(g.edges, seeds(spark, SUPPLIER), g.nodes.where("kind IN ('Class', 'Namespace', 'Struct')"), 3).select("id", "depth")


@query(WITH + ", x AS (SELECT id FROM n WHERE contains(name, 'Customer#00000000')), g AS (SELECT to_id AS id, count(*) AS degree FROM e GROUP BY 1) SELECT x.id, coalesce(degree, 0) AS degree FROM x LEFT JOIN g USING (id) ORDER BY 2 DESC, 1 LIMIT 1")
def seed_by_substring(spark, d):
    return G.seed_of(graph(spark, d), "Customer#00000000").select("id", "degree")


_SPOTS = "SELECT event_id AS ref_id, 'f' || user_id AS file, event_id * 13 % 5200 AS off FROM events"


@query(f"""WITH s AS (SELECT event_id AS id, 'f' || user_id AS file, event_id * 7 % 5000 AS a, event_id * 7 % 5000 + event_id % 900 AS b FROM events), r AS ({_SPOTS})
SELECT r.ref_id, first(s.id ORDER BY s.b - s.a, s.id) AS id FROM r JOIN s ON s.file = r.file AND s.a <= r.off AND r.off < s.b GROUP BY 1""")
def enclosing_half_open(spark, d):
    e, f = table(spark, d, "events"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file")
    start = F.col("event_id") * 7 % 5000
    nodes = e.select(F.col("event_id").alias("id"), f, start.alias("span_start"), (start + F.col("event_id") % 900).alias("span_end"))
    return lookup.enclosing_half_open(e.select(F.col("event_id").alias("ref_id"), f, (F.col("event_id") * 13 % 5200).alias("offset")), nodes, 64)


@query("""SELECT doc_id, (length(p) - length(replace(p, chr(10), '')))::INT AS line, (length(split_part(p, chr(10), -1)) + length(regexp_replace(split_part(p, chr(10), -1), '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::INT AS col
FROM (SELECT doc_id, left(text, (doc_id * 37 % 400)::INT) AS p FROM documents WHERE text IS NOT NULL)""")
def line_columns(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    at = spans.line_column("text", F.octet_length(F.substring(F.col("text"), F.lit(1), (F.col("doc_id") * 37 % 400).cast("int"))))
    return t.select("doc_id", at.alias("at")).select("doc_id", "at.line", "at.col")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 < len(l) THEN coalesce(list_sum([strlen(x) + 1 FOR x IN l[1:(doc_id % 5)::INT]]), 0)::BIGINT END AS at FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)""")
def line_offsets(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", spans.line_offset("text", (F.col("doc_id") % 5).cast("int")).alias("at"))


@query("""WITH l AS (SELECT doc_id, doc_id % 4 + 1 AS line, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line, number::INT AS number, md5(text) AS text FROM l WHERE abs(number - line) <= 1""")
def source_snippets(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    found = spans.snippets(t.select(F.col("doc_id").alias("file"), F.col("text").alias("content")), t.select(F.col("doc_id").alias("file"), (F.col("doc_id") % 4 + 1).alias("line")), 1)
    return found.select(F.col("file").alias("doc_id"), "line", "number", F.md5(F.col("text").cast("binary")).alias("text"))


@query(WITH + "SELECT id FROM n WHERE file = 'crates/orders/src/orders_7.py' AND 2001070 BETWEEN span_start AND span_end UNION ALL SELECT id FROM (SELECT id FROM n WHERE file = 'crates/orders/src/orders_7.py' AND NOT EXISTS (SELECT 1 FROM n WHERE file = 'crates/orders/src/orders_7.py' AND 2001070 BETWEEN span_start AND span_end) ORDER BY abs(span_start - 2001070), id LIMIT 5)")
def inspect_place(spark, d):
    return lookup.inspect(graph(spark, d).nodes, "orders/src/orders_7.py", 2001070).select("id")


@query("""WITH s AS (SELECT event_id AS id, 'f' || user_id AS file, event_id * 7 % 5000 AS a, event_id * 7 % 5000 + event_id % 90 AS b FROM events),
r AS (SELECT event_id AS ref_id, 'f' || user_id AS file, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id * 13 % 5000 END AS a, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id * 13 % 5000 + 40 END AS b FROM events)
SELECT r.ref_id, first(s.id ORDER BY s.b - s.a, s.id) AS id FROM r JOIN s ON s.file = r.file AND ((s.a <= r.a AND s.b >= r.b) OR (r.a <= s.a AND r.b >= s.b)) WHERE NOT (r.a = 0 AND r.b = 0) GROUP BY 1
UNION ALL SELECT r.ref_id, first(s.id ORDER BY s.a - s.b, s.id) FROM r JOIN s ON s.file = r.file WHERE r.a = 0 AND r.b = 0 GROUP BY 1""")
def span_endpoints(spark, d):
    e, f = table(spark, d, "events"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file")
    start, at = F.col("event_id") * 7 % 5000, F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id") * 13 % 5000)
    nodes = e.select(F.col("event_id").alias("id"), F.lit("Function").alias("kind"), f, start.alias("span_start"), (start + F.col("event_id") % 90).alias("span_end"))
    spots = e.select(F.col("event_id").alias("ref_id"), f, at.alias("start"), F.when(F.col("event_id") % 5 == 0, 0).otherwise(F.col("event_id") * 13 % 5000 + 40).alias("end"))
    return lookup.spans_to_endpoints(spots, nodes)


@query("WITH x AS (SELECT max(p_partkey) AS id, p_brand AS file, p_size AS a, p_size + 5 AS b FROM part GROUP BY 2, 3) SELECT p_partkey AS ref_id, x.id FROM part JOIN x ON x.file = p_brand AND x.a = (p_size * 2) % 50")
def exact_spans(spark, d):
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), F.col("p_size").alias("span_start"), (F.col("p_size") + 5).alias("span_end"))
    start = F.col("p_size") * 2 % 50
    return lookup.by_exact_span(p.select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("file"), start.alias("start"), (start + 5).alias("end")), nodes)


@query(WITH + "SELECT name, min(id) AS id FROM n WHERE kind IN ('Class', 'Struct') GROUP BY 1")
def first_declarations(spark, d):
    return lookup.first_of_kind(graph(spark, d).nodes, ["Class", "Struct"])


# --- pairs and inconsistencies -----------------------------------------------------------------------------------------

_VARIANTS = "SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN concat(p_mfgr, '.', p_type) ELSE concat(p_mfgr, '::', p_type) END AS name, concat('src/', p_brand, '.rs') AS file, p_mfgr, p_brand, p_size FROM (SELECT *, concat('M', CAST(p_partkey % 5 AS STRING)) AS p_mfgr FROM part) x WHERE p_size < 12"


@query(f"""WITH v AS ({_VARIANTS}), o AS (SELECT id, name, file, CASE p_size % 3 WHEN 0 THEN p_brand ELSE p_mfgr END AS owner FROM v)
SELECT a.id AS a_id, b.id AS b_id, a.name AS value FROM o a JOIN o b ON a.name = b.name AND a.id < b.id AND a.file <> b.file AND a.owner <> b.owner""")
def enum_variant_pairs(spark, d):
    _view(spark, d, "part")
    return inconsistencies.enum_pairs(spark.sql(_VARIANTS))


@query("WITH v AS (SELECT p_partkey % 5 AS enum, p_type AS variant FROM part WHERE p_size < 12) SELECT variant, count(DISTINCT enum) AS enums FROM v GROUP BY 1 HAVING count(DISTINCT enum) > 1")
def mismatched_variant_names(spark, d):
    return inconsistencies.mismatched_names(table(spark, d, "part").where("p_size < 12").select(F.concat(F.lit("M"), (F.col("p_partkey") % 5).cast("string"), F.lit("::"), "p_type").alias("name")))


_MIXED = """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'EnumVariant' WHEN 1 THEN 'StringLiteral' ELSE 'ConfigKey' END AS kind,
  CASE p_size % 4 WHEN 0 THEN concat(p_mfgr, '.', p_container) WHEN 1 THEN concat('api_path::/api/', lower(replace(p_container, ' ', '/')), CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END)
    WHEN 2 THEN concat('config_ref::', lower(replace(p_type, ' ', '.')), '.', p_size) ELSE concat(lower(replace(p_type, ' ', '.')), '.', p_size - 1) END AS name,
  concat('src/', p_brand, '.rs') AS file FROM (SELECT *, concat('M', CAST(p_partkey % 5 AS STRING)) AS p_mfgr, p_type AS p_container FROM part) x WHERE p_size < 16"""
_CANON = "lower(translate({}, '._-', ''))"


@query(f"""WITH n AS ({_MIXED}), v AS (SELECT id, split_part(name, '.', 1) AS parent, lower(regexp_replace(split_part(name, '.', 2), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS norm FROM n WHERE kind = 'EnumVariant'),
k AS (SELECT id, file, starts_with(name, 'config_ref::') AS is_ref, {_CANON.format("replace(name, 'config_ref::', '')")} AS canon FROM n WHERE kind = 'ConfigKey'),
p AS (SELECT DISTINCT substr(name, 11) AS path, min(id) OVER (PARTITION BY name) AS id FROM n WHERE kind = 'StringLiteral'), live AS (SELECT DISTINCT file FROM k WHERE NOT is_ref AND canon IN (SELECT canon FROM k WHERE is_ref))
SELECT 'EnumMismatch' AS category, a.id AS a_id, b.id AS b_id FROM v a JOIN v b ON a.norm = b.norm AND a.parent <> b.parent AND a.id < b.id
UNION ALL SELECT 'ApiPath', a.id, b.id FROM p a JOIN p b ON a.path < b.path AND levenshtein(a.path, b.path) BETWEEN 1 AND 2
UNION ALL SELECT 'ConfigKey', id, NULL FROM k WHERE is_ref AND canon NOT IN (SELECT canon FROM k WHERE NOT is_ref)
UNION ALL SELECT 'ConfigKey', NULL, id FROM (SELECT * FROM k WHERE NOT is_ref QUALIFY row_number() OVER (PARTITION BY canon ORDER BY id DESC) = 1) WHERE canon NOT IN (SELECT canon FROM k WHERE is_ref) AND file IN (FROM live)""")
def all_inconsistencies(spark, d):
    _view(spark, d, "part")
    return inconsistencies.found(spark.sql(_MIXED)).select("category", "a_id", "b_id")


@query(f"""WITH n AS ({_MIXED}), s AS (SELECT name FROM n WHERE kind = 'StringLiteral' GROUP BY 1 HAVING count(DISTINCT file) <= 8)
SELECT a.id AS from_id, b.id AS to_id, CASE a.kind WHEN 'EnumVariant' THEN 'EnumValueMatch' ELSE 'ApiPathMatch' END AS kind FROM n a JOIN n b ON a.name = b.name AND a.kind = b.kind AND a.id < b.id AND a.file <> b.file
WHERE a.kind = 'StringLiteral' AND a.name IN (FROM s)""")
def value_match_edges(spark, d):
    _view(spark, d, "part")
    return inconsistencies.value_edges(spark.sql(_MIXED)).select("from_id", "to_id", "kind")


# --- imports and link passes -------------------------------------------------------------------------------------------

_TS = """SELECT concat('web/r', CAST(n_regionkey AS STRING), '/n', CAST(n_nationkey AS STRING), CASE WHEN n_nationkey % 2 = 0 THEN '.ts' ELSE '.tsx' END) AS file,
  concat('import { F', CAST((n_nationkey + 5) % 25 AS STRING), ' as other } from "../r', CAST(o AS STRING), '/n', CAST((n_nationkey + 5) % 25 AS STRING), CASE WHEN n_nationkey % 3 = 0 THEN '.js' ELSE '' END, '";\n',
    'import {x} from "./none";\nexport function F', CAST(n_nationkey AS STRING), '() { return other(); }\n') AS content
FROM (SELECT a.n_nationkey, a.n_regionkey, b.n_regionkey AS o FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5) % 25) x
UNION ALL SELECT concat('web/r', CAST(r_regionkey AS STRING), '/index.ts'), concat('export * from "./n', CAST(n AS STRING), '";\n') FROM (SELECT r_regionkey, min(n_nationkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey) y
UNION ALL SELECT 'app/main.ts', 'import { F1 } from "@w/r0/n1";\nimport { all } from "@w/r0";\n'"""
_TS_FILE = "'web/r' || {r} || '/n' || {n} || CASE WHEN {n} % 2 = 0 THEN '.ts' ELSE '.tsx' END"


def _web(spark, d):
    _view(spark, d, "nation", "region")
    sources = spark.sql(_TS)
    packages = spark.createDataFrame([("@w/r0", "web/r0", ["./missing.js"]), ("@w", "web", None)], "name string, path string, entries array<string>")
    names = imports.bindings(sources)
    return sources, names, imports.resolve(names, sources.select("file"), packages)


@query(f"""WITH p AS (SELECT a.n_nationkey AS a, a.n_regionkey AS ar, b.n_nationkey AS b, b.n_regionkey AS br FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5) % 25)
SELECT {_TS_FILE.format(r='ar', n='a')} AS file, {_TS_FILE.format(r='br', n='b')} AS target FROM p
UNION ALL SELECT 'web/r' || r || '/index.ts', {_TS_FILE.format(r='r', n='n')} FROM (SELECT n_regionkey AS r, min(n_nationkey) AS n FROM nation GROUP BY 1)
UNION ALL SELECT 'app/main.ts', 'web/r0/index.ts' UNION ALL SELECT 'app/main.ts', 'web/r0/n1.tsx' WHERE (SELECT n_regionkey FROM nation WHERE n_nationkey = 1) = 0""")
def import_resolution(spark, d):
    return _web(spark, d)[2].select("file", "target")


@query(f"""WITH p AS (SELECT a.n_nationkey AS a, a.n_regionkey AS ar, b.n_nationkey AS b FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 5) % 25)
SELECT {_TS_FILE.format(r='ar', n='a')} AS file, 'F' || b AS symbol, 'import' AS how FROM p UNION ALL SELECT 'web/r' || r || '/index.ts', 'F' || n, 'export' FROM (SELECT n_regionkey AS r, min(n_nationkey) AS n FROM nation GROUP BY 1)
UNION ALL SELECT 'app/main.ts', 'F1', 'import' WHERE (SELECT n_regionkey FROM nation WHERE n_nationkey = 1) = 0""")
def imported_symbols(spark, d):
    sources, names, targets = _web(spark, d)
    nodes = B.symbol_nodes(B.extract.facts(sources))
    a = imports.imported(names.where("what = 'import'"), targets, nodes).select("file", "id", F.lit("import").alias("how"))
    b = imports.reexported(names.where("what = 'export' AND imported = '*'"), targets, nodes).select("file", "id", F.lit("export").alias("how"))
    return a.union(b).join(nodes.select("id", F.col("name").alias("symbol")), "id").select("file", "symbol", "how")


@query(WITH + """, m AS (SELECT split_part(file, '/', 2) AS module, file, 10 AS score FROM n WHERE kind <> 'Namespace' GROUP BY 1, 2)
SELECT 'File' AS kind, split_part(file, '/', 4) AS name, file FROM (SELECT DISTINCT file FROM n WHERE kind <> 'Namespace')
UNION ALL SELECT 'Module', module, min(file) FROM m GROUP BY 2""")
def structural_nodes(spark, d):
    nodes = graph(spark, d).nodes
    return B.structure(nodes, 10**15)[0].select("kind", "name", "file")


@query(WITH + """SELECT 'Contains' AS kind, split_part(file, '/', 4) AS via, count(*) AS n FROM n WHERE kind <> 'Namespace' GROUP BY 2 UNION ALL SELECT 'BelongsTo', split_part(file, '/', 2), count(*) FROM n WHERE kind <> 'Namespace' GROUP BY 2""")
def structural_edges(spark, d):
    nodes = graph(spark, d).nodes
    made, edges = B.structure(nodes, 10**15)
    via = made.select("id", F.col("name").alias("via"))
    end = F.when(F.col("kind") == "Contains", F.col("from_id")).otherwise(F.col("to_id"))
    return edges.withColumn("id", end).join(via, "id").groupBy("kind", "via").agg(F.count("*").alias("n"))


@query(WITH + "SELECT from_id, to_id, 'Inherits' AS kind FROM e WHERE kind = 'Extends' AND to_id % 2 = 0")
def inherited_edges(spark, d):
    e = graph(spark, d).edges.withColumn("evidence_file", F.when(F.col("to_id") % 2 == 0, "a/B.Java").otherwise("a/b.ts"))
    return B.inherits(e).select("from_id", "to_id", "kind")


_TYPED = "SELECT concat('src/n', CAST(n_nationkey AS STRING), '.rs') AS file, concat('fn f(x: &T', CAST((n_nationkey + 1) % 25 AS STRING), ') -> Vec<T', CAST((n_nationkey + 2) % 25 AS STRING), '> { let mut y: T', CAST((n_nationkey + 1) % 25 AS STRING), ' = 1; }') AS content FROM nation"
_TYPES = "SELECT 1000 + n_nationkey AS id, 'Struct' AS kind, concat('T', CAST(n_nationkey AS STRING)) AS name, concat('src/n', CAST(n_nationkey AS STRING), '.rs') AS file FROM nation UNION ALL SELECT n_nationkey, 'File', concat('n', CAST(n_nationkey AS STRING), '.rs'), concat('src/n', CAST(n_nationkey AS STRING), '.rs') FROM nation"


@query("SELECT n_nationkey::BIGINT AS from_id, 1000 + (n_nationkey + 1) % 25 AS to_id, 'TypeOf' AS kind FROM nation UNION ALL SELECT n_nationkey, 1000 + (n_nationkey + 2) % 25, 'GenericParam' FROM nation")
def type_edges(spark, d):
    _view(spark, d, "nation")
    return B.types(spark.sql(_TYPED), spark.sql(_TYPES)).select(F.col("from_id").cast("long").alias("from_id"), F.col("to_id").cast("long").alias("to_id"), "kind")


_CODE = """SELECT concat('src/K', CAST(n_nationkey AS STRING), '.kt') AS file, concat('/** See [`Base`]. */\nclass K', CAST(n_nationkey AS STRING), ' : Base() {\n  fun run', CAST(n_nationkey AS STRING), '() { run', CAST((n_nationkey + 1) % 25 AS STRING), '() }\n}\n') AS content FROM nation
UNION ALL SELECT 'src/Base.kt', 'open class Base\n' UNION ALL SELECT 'docs/a.md', '# Top\nuse `Base` here\n# Empty\nnothing\n'"""


@query("""SELECT 'Class' AS kind, 'K' || n_nationkey AS name, 'src/K' || n_nationkey || '.kt' AS file FROM nation UNION ALL SELECT 'Method', 'run' || n_nationkey, 'src/K' || n_nationkey || '.kt' FROM nation
UNION ALL SELECT 'File', 'K' || n_nationkey || '.kt', 'src/K' || n_nationkey || '.kt' FROM nation UNION ALL SELECT 'DocComment', 'doc::K' || n_nationkey, 'src/K' || n_nationkey || '.kt' FROM nation
UNION ALL SELECT * FROM (VALUES ('Class', 'Base', 'src/Base.kt'), ('File', 'Base.kt', 'src/Base.kt'), ('Module', 'src', 'src/Base.kt'), ('DocSection', 'docsection::Top', 'docs/a.md'))""")
def built_graph_nodes(spark, d):
    _view(spark, d, "nation")
    return B.build(spark.sql(_CODE)).nodes.select("kind", "name", "file")


@query("""SELECT * FROM (VALUES ('Contains', 51), ('BelongsTo', 51), ('Documents', 25), ('Mentions', 25), ('DescribedIn', 1), ('Calls', 25), ('References', 25), ('Resolves', 50)) v(kind, n)""")
def built_graph_edges(spark, d):
    _view(spark, d, "nation")
    return B.build(spark.sql(_CODE)).edges.groupBy("kind").agg(F.count("*").cast("int").alias("n"))


# --- texts -------------------------------------------------------------------------------------------------------------

_PATHS = [("a/./b/../c.ts", "a/c.ts", "a/./b/../c.js"), ("/x//y/../../z", "/z", "/x//y/../../z.js"), ("../q/r.tsx", "q/r.tsx", "../q/r.js"), ("s.d.ts", "s.d.ts", "s.d.js")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{n}', '{x}')" for p, n, x in _PATHS) + ") v(path, normal, swapped)")
def path_forms(spark, d):
    p = spark.createDataFrame([(p,) for p, *_ in _PATHS], "path string")
    return p.select("path", P.normal("path").alias("normal"), P.with_extension("path", "js").alias("swapped"))


@query(WITH + "SELECT kind, CASE WHEN count(DISTINCT split_part(file, '/', 2)) > 1 THEN 'crates' ELSE 'crates/' || min(split_part(file, '/', 2)) || '/src' END AS folder FROM n GROUP BY 1")
def common_folders(spark, d):
    ends = graph(spark, d).nodes.groupBy("kind").agg(F.min("file").alias("lo"), F.max("file").alias("hi"))
    return ends.select("kind", P.common_folder("lo", "hi").alias("folder"))


@query(WITH + "SELECT DISTINCT file, split_part(file, '/', 2) AS module, 10 AS score FROM n")
def module_representatives(spark, d):
    f = graph(spark, d).nodes.select("file").distinct()
    return f.select("file", P.synthetic_module("file").alias("module"), P.module_score("file").alias("score"))


_TAGS = "SELECT p_partkey AS id, concat('/** @param {X} size', p_size % 4, ' the [`mod::Size', p_size % 3, '`] of {@link Foo#bar', p_size % 2, '|x}. @param opts.a @param [_flag=1] */') AS doc FROM part"


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'size' || p_size % 4 END AS missing, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'size0' END AS near, 'Size' || p_size % 3 || ' bar' || p_size % 2 AS links FROM part")
def documented_parameters(spark, d):
    _view(spark, d, "part")
    lacks = drift.missing(drift.documented(F.col("doc"), F.lit(False)), F.array(F.lit("size0"), F.lit("flag"), F.lit("far")))
    one = F.get(lacks, F.lit(0))
    return spark.sql(_TAGS).select("id", one["name"].alias("missing"), F.get(one["candidates"], F.lit(0)).alias("near"), F.array_join(B.link_targets(F.col("doc")), " ").alias("links"))


@query("SELECT user_id::VARCHAR AS file, event_type AS author, count(*) AS commits, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 4) AS share FROM events GROUP BY 1, 2, user_id")
def ownership_shares(spark, d):
    found = git.ownership(table(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("author")))
    return found.withColumn("share", F.round(F.col("commits") / (F.col("commits") / F.col("share").cast("double")), 4)).select("file", "author", "commits", "share")


# --- changes and exports -----------------------------------------------------------------------------------------------

_CHANGED = [("crates/nation/src/nation_3.rs",), ("crates/nation/src/nation_4.py",), ("none.rs",)]


@query(WITH + f""", w AS (SELECT * FROM (VALUES {', '.join(f"('{f[0]}')" for f in _CHANGED)}) w(file)), s AS (SELECT id, file FROM n JOIN w USING (file)), r(seed, id, depth) AS (SELECT id, id, 0 FROM s UNION SELECT r.seed, e.from_id, r.depth + 1 FROM r JOIN e ON e.to_id = r.id WHERE r.depth < 2),
c AS (SELECT seed, id, min(depth) AS depth FROM r GROUP BY 1, 2), t AS (SELECT c.seed, e.from_id, e.to_id, e.cur, row_number() OVER (PARTITION BY c.seed, c.id ORDER BY {_PRIO.replace('kind', 'e.kind')}, e.to_id, e.kind) AS rn
  FROM c JOIN e ON e.from_id = c.id JOIN c p ON p.seed = c.seed AND p.id = e.to_id AND p.depth = c.depth - 1 WHERE c.depth > 0), u AS (SELECT s.file, t.* FROM t JOIN s ON s.id = t.seed WHERE rn = 1),
z AS (SELECT file, id, max(cur) AS cur FROM (SELECT file, from_id AS id, cur FROM u UNION ALL SELECT file, to_id, cur FROM u) GROUP BY 1, 2), b AS (SELECT file, id FROM z WHERE id NOT IN (SELECT id FROM s WHERE s.file = z.file) QUALIFY row_number() OVER (PARTITION BY file ORDER BY cur DESC, id) <= 5)
SELECT w.file, (SELECT count(*) FROM s WHERE s.file = w.file) AS seeds, coalesce(x.reached, 0) AS reached, round(coalesce(x.confidence, 0), 6) AS confidence, coalesce(y.top, 0)::BIGINT AS top
FROM w LEFT JOIN (SELECT file, count(DISTINCT from_id) AS reached, sum(cur) AS confidence FROM u GROUP BY 1) x USING (file) LEFT JOIN (SELECT file, sum(id) AS top FROM b GROUP BY 1) y USING (file)""")
def rich_diff(spark, d):
    found = R.rich_diff(graph(spark, d), spark.createDataFrame(_CHANGED, "file string"), depth=2)
    top = F.aggregate(F.coalesce("top", F.array().cast("array<struct<id:bigint,confidence:double>>")), F.lit(0).cast("long"), lambda a, x: a + x["id"])
    return found.select("file", F.coalesce(F.size("seeds"), F.lit(0)).cast("long").alias("seeds"), "reached", F.round("confidence", 6).alias("confidence"), top.alias("top"))


_STATES = "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'Gone' ELSE 'Verified' END AS status FROM part"


@query("SELECT p_partkey AS id FROM part WHERE NOT (p_size % 5 = 0 AND p_size % 2 = 0)")
def collected_tombs(spark, d):
    _view(spark, d, "part")
    nodes = spark.sql(_STATES)
    known = table(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("gone_at"))
    tombs = incremental.buried(nodes, known, "2026-01-01 00:04:00")
    edges = spark.createDataFrame([], "from_id long, to_id long, kind string")
    return incremental.collected(CodeGraph(nodes, edges), tombs, "2026-01-01 00:05:00")[0].nodes.select("id")


@query(WITH + "SELECT kind, stale + (from_id % 2 = 0)::INT AS stale, count(*) AS n FROM e GROUP BY 1, 2")
def bumped_evidence(spark, d):
    e = graph(spark, d).edges
    out = incremental.bump_stale(e, e.where("from_id % 2 = 0"))
    return out.groupBy("kind", F.col("stale_evidence_count").alias("stale")).agg(F.count("*").alias("n"))


@query(WITH + "SELECT kind, count(*) AS n FROM e WHERE from_id % 5 > 0 AND to_id % 5 > 0 GROUP BY 1")
def removed_nodes(spark, d):
    g = graph(spark, d)
    return incremental.remove_nodes(g, g.nodes.where("id % 5 = 0")).edges.groupBy("kind").agg(F.count("*").alias("n"))


_AGAIN = "crates/customer/src/customer_3.rs"


@query(WITH + f""", old AS (SELECT id, name FROM n WHERE file = '{_AGAIN}'), kept AS (SELECT * FROM e WHERE from_id NOT IN (SELECT id FROM old)),
x AS (SELECT kind, stale, from_id, to_id FROM kept WHERE to_id NOT IN (SELECT id FROM old) UNION ALL SELECT kind, stale + 1, from_id, to_id FROM kept JOIN old ON old.id = to_id WHERE to_id % 4 <> 0)
SELECT kind, stale, count(*) AS n FROM x GROUP BY 1, 2""")
def reindexed_file(spark, d):
    g = graph(spark, d)
    again = g.nodes.where((F.col("file") == _AGAIN) & (F.col("id") % 4 != 0))
    e = g.edges.withColumn("evidence_file", F.lit("elsewhere"))
    out = incremental.reindex(CodeGraph(g.nodes, e), spark.createDataFrame([(_AGAIN,)], "file string"), CodeGraph(again, e.where("false")))
    return out.edges.groupBy("kind", F.col("stale_evidence_count").alias("stale")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Gone' WHEN c_custkey % 3 = 1 THEN 'Stale' ELSE 'Verified' END AS status FROM customer")
def marked_nodes(spark, d):
    from ..operators.linking import mark_stale

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("file"), F.lit("Verified").alias("status"))
    return mark_stale(c, c.where("id % 3 < 2").select("file", (F.col("id") % 3 == 0).alias("removed"))).select("id", "status")


@query("SELECT user_id, event_id % 2 = 0 AS removed FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def debounced_changes(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.struct("ts", "event_id").alias("at"), (F.col("event_id") % 2 == 0).alias("removed"))
    return incremental.debounced(e, "^[0-9]+$").select(F.col("path").cast("long").alias("user_id"), "removed")


@query(WITH + ", k AS (SELECT id FROM n WHERE kind IN ('Class', 'Namespace')), f AS (SELECT * FROM e WHERE conf >= CAST(0.5 AS FLOAT) AND kind <> 'Calls' AND from_id IN (FROM k) AND to_id IN (FROM k)) SELECT 'meta' AS type, 1::BIGINT AS n UNION ALL SELECT 'node', count(*) FROM k UNION ALL SELECT 'edge', count(*) FROM f")
def json_graph_export(spark, d):
    g = graph(spark, d)
    lines = S.json_graph(g, g.nodes.where("kind IN ('Class', 'Namespace')"), 0.5, ["Calls"])
    return lines.select(F.get_json_object("line", "$.type").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query(WITH + "SELECT '  n' || id || ' [label=\"' || name || '\"];' AS line FROM n WHERE kind = 'Class' UNION ALL SELECT 'CREATE (n' || id || ':' || kind || ' {id: ' || id || ', name: \"' || name || '\"});' FROM n WHERE kind = 'Class'")
def node_exports(spark, d):
    n = graph(spark, d).nodes.where("kind = 'Class'")
    return S.dot_nodes(n).union(S.cypher_nodes(n))


@query("SELECT 'd' || doc_id AS file FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0 AND NOT regexp_matches(lower(left(text, 2048)), 'do not edit|code generated|generated by|auto-generated|autogenerated|this file is generated|@generated')")
def built_files(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "web/dist/").otherwise("src/"), F.lit("d"), "doc_id", F.lit(".rs"))
    return t.where(~P.is_built(path, "text")).select(F.concat(F.lit("d"), "doc_id").alias("file"))


@query(WITH + "SELECT lang, n FROM (SELECT 'rust' AS lang, count(DISTINCT file) AS n FROM n WHERE file LIKE '%.rs' UNION ALL SELECT 'python', count(DISTINCT file) FROM n WHERE file LIKE '%.py' UNION ALL SELECT 'go', count(DISTINCT file) FROM n WHERE file LIKE '%.go') ORDER BY n DESC, lang LIMIT 1")
def primary_language(spark, d):
    from ..operators.analysis import primary_language as found

    return found(graph(spark, d).nodes.select("file").distinct())


@query(WITH + "SELECT id, cur FROM (SELECT to_id AS id, round(max(cur), 6) AS cur FROM e GROUP BY 1) WHERE cur < 0.9")
def decayed_targets(spark, d):
    return graph(spark, d).edges.groupBy(F.col("to_id").alias("id")).agg(F.round(F.max(current_confidence()), 6).alias("cur")).where("cur < 0.9")
