"""Named queries over the driver's tables and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import CodeGraph, current_confidence, priority, trust_model
from ..operators import advice as R
from ..operators import analysis as A
from ..operators import linking as L
from ..operators import mediators as M
from ..operators import traverse as G
from ..sources import files as S
from ..streaming import changes
from .testgraph import WITH, graph

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
REGION, SUPPLIER, CUSTOMER = 10000000000, 40000000001, 30000000005


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeds(spark: SparkSession, *ids: int) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "seed long, id long")


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_cone_by_depth(spark, sf_dir)


# --- statistics ---------------------------------------------------------------------------------------------------


@query(WITH + "SELECT (SELECT count(*) FROM n) AS symbols, (SELECT count(DISTINCT file) FROM n) AS files, (SELECT count(*) FROM e) AS edges")
def graph_stats(spark, d):
    return A.stats(graph(spark, d))


@query(WITH + "SELECT kind AS value, count(*) AS n FROM n GROUP BY 1")
def symbol_kind_histogram(spark, d):
    return A.histogram(graph(spark, d).nodes, "kind")


@query(WITH + "SELECT kind AS value, count(*) AS n FROM e GROUP BY 1")
def edge_kind_histogram(spark, d):
    return A.histogram(graph(spark, d).edges, "kind")


@query(WITH + "SELECT origin AS value, count(*) AS n FROM e GROUP BY 1")
def origin_histogram(spark, d):
    return A.histogram(graph(spark, d).edges, "origin")


@query(WITH + "SELECT CASE WHEN kind IN ('Extends', 'Implements') THEN 'ContractDependent' ELSE 'SourceEvidenced' END AS value, count(*) AS n FROM e GROUP BY 1")
def trust_model_histogram(spark, d):
    return A.trust_histogram(graph(spark, d))


@query(WITH + "SELECT kind, origin, stale, count(*) AS n, round(sum(CAST(conf AS DOUBLE)), 4) AS stored, round(sum(cur), 4) AS live FROM e GROUP BY ALL")
def edge_confidence(spark, d):
    e = graph(spark, d).edges.withColumn("cur", current_confidence())
    return e.groupBy("kind", "origin", F.col("stale_evidence_count").alias("stale")).agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("confidence").cast("double")), 4).alias("stored"), F.round(F.sum("cur"), 4).alias("live"))


@query(WITH + "SELECT to_id, count(*) AS degree FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def impact_in_degree_top(spark, d):
    return A.in_degree_top(graph(spark, d), 20)


@query(WITH + "SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT to_id AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT from_id, 0, 1 FROM e) GROUP BY 1")
def degrees(spark, d):
    return A.degrees(graph(spark, d))


@query(WITH + "SELECT file, count(*) AS symbols FROM n GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_files(spark, d):
    return A.top_files(graph(spark, d), 10)


@query(WITH + """, c AS (SELECT split_part(file, '/', 2) AS package, 1 AS s, 0 AS e FROM n UNION ALL SELECT CASE WHEN to_id % 4 < 2 THEN 'e' || to_id % 4 ELSE 'root' END, 0, 1 FROM e)
SELECT package, sum(s)::BIGINT AS symbols, sum(e)::BIGINT AS edges FROM c GROUP BY 1""")
def package_stats(spark, d):
    g = graph(spark, d)
    packages = g.nodes.select(F.element_at(F.split("file", "/"), 2).alias("package")).distinct().withColumn("path", F.concat(F.lit("crates/"), "package"))
    return A.package_stats(g, packages.union(spark.createDataFrame([("e0", "crates/e0"), ("e1", "crates/e1"), ("root", ".")], "package string, path string")))


_UNITS = """SELECT CASE p_size % 4 WHEN 0 THEN concat('big/', CAST(p_size % 3 AS STRING), '/f.rs') WHEN 1 THEN concat('top', CAST(p_size AS STRING), '.rs')
  WHEN 2 THEN concat('flat/f', CAST(p_size AS STRING), '.rs') ELSE concat('few', CAST(p_partkey % 97 AS STRING), '/', CAST(p_partkey % 2 AS STRING), '/x.rs') END AS file FROM part"""


@query(f"""WITH f AS ({_UNITS}), p AS (SELECT string_split(file, '/') AS p FROM f), s AS (SELECT CASE WHEN len(p) = 1 THEN '(root)' ELSE p[1] END AS top, CASE WHEN len(p) > 2 THEN p[2] END AS sub FROM p),
t AS (SELECT top, count(*) AS n, count(DISTINCT sub) AS children FROM s GROUP BY 1), w AS (SELECT top FROM t WHERE children >= 2 AND (n >= 40 OR n >= 0.12 * (SELECT count(*) FROM s)))
SELECT CASE WHEN sub IS NOT NULL AND top IN (FROM w) THEN top || '/' || sub ELSE top END AS unit, count(*) AS n FROM s GROUP BY 1""")
def unit_derivation(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    return A.units(spark.sql(_UNITS))


# --- traversal ----------------------------------------------------------------------------------------------------

_CONE = ", r(id, depth) AS (SELECT {seed}::BIGINT, 0 UNION SELECT e.from_id, r.depth + 1 FROM r JOIN e ON e.to_id = r.id WHERE r.depth < {depth}), cone AS (SELECT id, min(depth) AS depth FROM r GROUP BY 1) "


@query(WITH + _CONE.format(seed=REGION, depth=3) + "SELECT depth, count(*) AS n FROM cone WHERE depth > 0 GROUP BY 1")
def impact_cone_by_depth(spark, d):
    return G.impact_cone(graph(spark, d), seeds(spark, REGION), 3).groupBy("depth").agg(F.count("*").alias("n"))


@query(WITH + _CONE.format(seed=SUPPLIER, depth=3) + "SELECT id, depth FROM cone WHERE depth > 0")
def impact_cone(spark, d):
    return G.impact_cone(graph(spark, d), seeds(spark, SUPPLIER), 3).select("id", "depth")


@query(WITH + _CONE.format(seed=SUPPLIER, depth=2) + """, t AS (SELECT e.from_id, e.to_id, e.kind, c.depth, row_number() OVER (PARTITION BY e.from_id ORDER BY
  CASE e.kind WHEN 'Calls' THEN 0 WHEN 'Implements' THEN 1 WHEN 'Extends' THEN 2 WHEN 'Imports' THEN 5 WHEN 'References' THEN 6 WHEN 'DependsOn' THEN 7 ELSE 19 END, e.to_id, e.kind) AS rn
  FROM cone c JOIN e ON e.from_id = c.id JOIN cone p ON p.id = e.to_id AND p.depth = c.depth - 1 WHERE c.depth > 0) SELECT from_id, to_id, kind, depth FROM t WHERE rn = 1""")
def impact_tree_edges(spark, d):
    return G.impact_tree(graph(spark, d), seeds(spark, SUPPLIER), 2).select("from_id", "to_id", "kind", "depth")


_RISK = ", r(id, conf, dist) AS (SELECT {seed}::BIGINT, 1.0::DOUBLE, 0 UNION SELECT e.from_id, r.conf * e.cur, r.dist + 1 FROM r JOIN e ON e.to_id = r.id WHERE r.dist < {depth}), best AS (SELECT id, conf, min(dist) AS dist FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY conf DESC) = 1) "


@query(WITH + _RISK.format(seed=CUSTOMER, depth=3) + f"SELECT id, round(conf, 6) AS conf, dist FROM best WHERE id <> {CUSTOMER}")
def risk_cone(spark, d):
    return G.risk_cone(graph(spark, d), seeds(spark, CUSTOMER), 3).select("id", F.round("conf", 6).alias("conf"), "dist")


@query(WITH + _RISK.format(seed=CUSTOMER, depth=3) + f""", c AS (SELECT b.*, split_part(n.file, '/', 2) AS module FROM best b JOIN n USING (id) WHERE id <> {CUSTOMER}),
m AS (SELECT module, count(*) AS n, sum(conf) AS cwi, max(conf) AS top FROM c GROUP BY 1),
p AS (SELECT sum(n)::BIGINT AS callers, sum(cwi) AS cwi, count(*) AS modules, sum(top) AS spread FROM m),
k AS (SELECT sum(CASE WHEN kind IN ('Calls', 'Extends', 'Implements', 'References', 'Resolves', 'DependsOn') THEN cur ELSE 0 END) / sum(cur) AS kf FROM e WHERE to_id = {CUSTOMER}),
s AS (SELECT *, 0.20 * 1.0 + 0.45 * least(cwi / 20, 1) + 0.25 * least(greatest(spread, 1) / 10, 1) + 0.10 * kf AS score FROM p, k)
SELECT {CUSTOMER}::BIGINT AS seed, callers, round(cwi, 6) AS cwi, modules, round(spread, 6) AS spread, round(kf, 6) AS kind_factor, round(score, 6) AS score,
CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS band,
CASE WHEN modules > 10 OR callers > 50 THEN 'critical' WHEN modules > 5 OR callers > 20 THEN 'high' WHEN modules >= 3 OR callers >= 6 THEN 'medium' ELSE 'low' END AS radius FROM s""")
def risk_score(spark, d):
    out = A.risk(graph(spark, d), seeds(spark, CUSTOMER), 3)
    return out.select("seed", "callers", F.round("cwi", 6).alias("cwi"), "modules", F.round("spread", 6).alias("spread"), F.round("kind_factor", 6).alias("kind_factor"), F.round("score", 6).alias("score"), "band", "radius")


@query(WITH + _RISK.format(seed=CUSTOMER, depth=3) + "SELECT b.id, n.name, b.dist, round(b.conf, 6) AS conf FROM best b JOIN n USING (id) WHERE n.kind IN ('Function', 'Method') AND n.is_test")
def affected_tests(spark, d):
    return A.affected_tests(graph(spark, d), seeds(spark, CUSTOMER), 3).select("id", "name", "dist", F.round("conf", 6).alias("conf"))


@query(WITH + ", f AS (SELECT * FROM e WHERE conf >= CAST(0.7 AS FLOAT)), " + "i(id, depth) AS (SELECT 20000000001::BIGINT, 0 UNION SELECT f.from_id, i.depth + 1 FROM i JOIN f ON f.to_id = i.id WHERE i.depth < 1), o(id, depth) AS (SELECT 20000000001::BIGINT, 0 UNION SELECT f.to_id, o.depth + 1 FROM o JOIN f ON f.from_id = o.id WHERE o.depth < 1) "
  "SELECT 'incoming' AS direction, m.depth + 1 AS depth, f.from_id, f.to_id, f.kind FROM (SELECT id, min(depth) AS depth FROM i GROUP BY 1) m JOIN f ON f.to_id = m.id UNION ALL "
  "SELECT 'outgoing', m.depth + 1, f.from_id, f.to_id, f.kind FROM (SELECT id, min(depth) AS depth FROM o GROUP BY 1) m JOIN f ON f.from_id = m.id")
def neighborhood(spark, d):
    return G.neighborhood(graph(spark, d), seeds(spark, 20000000001), 2, 0.7).select("direction", "depth", "from_id", "to_id", "kind")


@query(WITH + f"SELECT from_id, to_id, kind FROM e WHERE from_id = {CUSTOMER} OR to_id = {CUSTOMER}")
def incident_edges(spark, d):
    return graph(spark, d).edges.where((F.col("from_id") == CUSTOMER) | (F.col("to_id") == CUSTOMER)).select("from_id", "to_id", "kind")


@query(WITH + f", b AS (SELECT from_id AS s, to_id AS t FROM e UNION SELECT to_id, from_id FROM e), r(id, depth) AS (SELECT {CUSTOMER}::BIGINT, 0 UNION SELECT b.t, r.depth + 1 FROM r JOIN b ON b.s = r.id WHERE r.depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY 1")
def subgraph(spark, d):
    return G.reach(seeds(spark, CUSTOMER), G.both_ways(graph(spark, d).edges), 2).select("id", "depth")


_PAIRS = [(40000000001, 10000000000), (40000000001, 20000000003), (40000000002, 40000000002), (40000000003, 99)]


@query(WITH + ", b AS (SELECT from_id AS s, to_id AS t FROM e UNION SELECT to_id, from_id FROM e), r(id, depth) AS (SELECT 40000000001::BIGINT, 0 UNION SELECT b.t, r.depth + 1 FROM r JOIN b ON b.s = r.id WHERE r.depth < 4) SELECT 40000000001::BIGINT AS a, 10000000000::BIGINT AS b, (SELECT min(depth) FROM r WHERE id = 10000000000)::INT AS hops UNION ALL SELECT 40000000001, 20000000003, (SELECT min(depth) FROM r WHERE id = 20000000003) UNION ALL SELECT 40000000002, 40000000002, 0 UNION ALL SELECT 40000000003, 99, NULL")
def shortest_path_hops(spark, d):
    return G.shortest_path(graph(spark, d).edges, spark.createDataFrame(_PAIRS, "a long, b long")).select("a", "b", "hops")


@query(WITH + ", g AS (SELECT to_id AS id, count(*) AS degree FROM e GROUP BY 1) SELECT name, id, degree FROM (SELECT n.name, n.id, coalesce(g.degree, 0) AS degree, row_number() OVER (PARTITION BY n.name ORDER BY coalesce(g.degree, 0) DESC, n.id) AS rn FROM n LEFT JOIN g USING (id) WHERE n.kind = 'Constant') WHERE rn = 1")
def seed_by_degree(spark, d):
    g = graph(spark, d)
    names = g.nodes.where("kind = 'Constant'").select("name").distinct()
    g.nodes = g.nodes.where("kind = 'Constant'")
    return G.seed_by_degree(type(g)(graph(spark, d).nodes, g.edges), names).join(g.nodes.select("id"), "id", "left_semi").select("name", "id", "degree")


@query(WITH + """, w AS (SELECT n_name AS name FROM nation UNION SELECT 'NOWHERE'), s AS (SELECT id, name FROM n JOIN w USING (name)), r(seed, id, depth) AS (SELECT id, id, 0 FROM s UNION SELECT r.seed, e.from_id, r.depth + 1 FROM r JOIN e ON e.to_id = r.id WHERE r.depth < 2),
c AS (SELECT seed, id, min(depth) AS depth FROM r GROUP BY 1, 2), t AS (SELECT c.seed, e.cur, row_number() OVER (PARTITION BY c.seed, c.id ORDER BY CASE e.kind WHEN 'Calls' THEN 0 WHEN 'Implements' THEN 1 WHEN 'Extends' THEN 2 WHEN 'Imports' THEN 5 WHEN 'References' THEN 6 WHEN 'DependsOn' THEN 7 ELSE 19 END, e.to_id, e.kind) AS rn
  FROM c JOIN e ON e.from_id = c.id JOIN c p ON p.seed = c.seed AND p.id = e.to_id AND p.depth = c.depth - 1 WHERE c.depth > 0),
z AS (SELECT seed, count(*) AS n, sum(cur) AS live FROM t WHERE rn = 1 GROUP BY 1)
SELECT name, count(s.id) AS seeds, count(s.id) AS seeds_used, false AS truncated, coalesce(sum(z.n), 0)::BIGINT AS nodes, coalesce(sum(z.n), 0)::BIGINT AS edges, round(coalesce(sum(z.live), 0), 6) AS confidence_weighted FROM s LEFT JOIN z ON z.seed = s.id GROUP BY 1
UNION ALL SELECT 'NOWHERE', NULL, NULL, NULL, NULL, NULL, NULL""")
def impact_batch(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("name")).union(spark.createDataFrame([("NOWHERE",)], "name string"))
    out = G.batch_impact(graph(spark, d), names, 2)
    return out.withColumn("confidence_weighted", F.round("confidence_weighted", 6))


@query(WITH + ", s AS (SELECT id FROM n WHERE file = 'crates/nation/src/nation_1.py'), r(id, depth) AS (SELECT id, 0 FROM s UNION SELECT e.from_id, r.depth + 1 FROM r JOIN e ON e.to_id = r.id WHERE r.depth < 2) SELECT DISTINCT id FROM r WHERE id NOT IN (SELECT id FROM s)")
def diff_cone(spark, d):
    g = graph(spark, d)
    touched = g.nodes.join(spark.createDataFrame([("crates/nation/src/nation_1.py",)], "file string"), "file", "left_semi").select("id")
    cone = G.impact_cone(g, touched.select(F.lit(0).cast("long").alias("seed"), "id"), 2)
    return cone.select("id").join(touched, "id", "left_anti")


# --- filters, lookup, order ----------------------------------------------------------------------------------------


@query(WITH + "SELECT id, name FROM n WHERE name = 'FRANCE' OR name = 'Customer#000000005'")
def exact_lookup(spark, d):
    wanted = spark.createDataFrame([("FRANCE",), ("Customer#000000005",)], "name string")
    return graph(spark, d).nodes.join(F.broadcast(wanted), "name").select("id", "name")


@query(WITH + "SELECT id, name, CASE WHEN lower(name) = 'an' THEN 0 WHEN starts_with(lower(name), 'an') THEN 1 ELSE 2 END::INT AS score FROM n WHERE contains(lower(name), 'an') ORDER BY 3, strlen(name), id LIMIT 100")
def fuzzy_lookup(spark, d):
    return L.fuzzy(graph(spark, d).nodes, "AN", 100)


@query(WITH + ", x AS (SELECT id, name, levenshtein(lower(name[1:14]), 'custmer#0000') AS d FROM n) SELECT id, name, (3 + d)::INT AS score FROM x WHERE d <= 2 ORDER BY d, strlen(name), id LIMIT 100")
def fuzzy_lookup_typo(spark, d):
    return L.fuzzy(graph(spark, d).nodes, "Custmer#0000", 100)


@query(WITH + "SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY (visibility = 'Public') DESC, id) AS rn FROM n) WHERE rn = 1")
def center_pick(spark, d):
    key = F.struct((F.col("visibility") != "Public").alias("p"), "id")
    return graph(spark, d).nodes.groupBy("name").agg(F.min(key).getField("id").alias("id"))


@query(WITH + "SELECT from_id, to_id, kind FROM e WHERE conf >= CAST(0.7 AS FLOAT) ORDER BY CASE kind WHEN 'Calls' THEN 0 WHEN 'Implements' THEN 1 WHEN 'Extends' THEN 2 WHEN 'Imports' THEN 5 WHEN 'References' THEN 6 WHEN 'DependsOn' THEN 7 ELSE 19 END, from_id, to_id, kind LIMIT 50 OFFSET 100")
def edge_page(spark, d):
    e = graph(spark, d).edges.where(F.col("confidence") >= F.lit(0.7).cast("float"))
    return L.page(e, [priority(), "from_id", "to_id", "kind"], 3, 50).select("from_id", "to_id", "kind")


@query(WITH + "SELECT kind, count(*) AS n, sum((conf >= CAST(0.7 AS FLOAT) AND origin IN ('CompilerDerived', 'NameResolved', 'SyntaxMatched'))::INT)::BIGINT AS verified FROM e GROUP BY 1")
def verified_edges(spark, d):
    return graph(spark, d).edges.groupBy("kind").agg(F.count("*").alias("n"), F.sum(R.verified().cast("long")).alias("verified"))


@query(WITH + ", l AS (SELECT DISTINCT file, CASE regexp_extract(file, '[.]([^./]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' ELSE 'go' END AS lang FROM n) SELECT lang, count(*) AS n FROM l GROUP BY 1")
def language_census(spark, d):
    return A.language_census(graph(spark, d).nodes.select("file").distinct())


@query(WITH + ", l AS (SELECT id, regexp_extract(file, '[.]([^./]+)$', 1) AS lang FROM n) SELECT e.kind, count(*) AS n FROM e JOIN l a ON a.id = e.from_id JOIN l b ON b.id = e.to_id WHERE a.lang <> b.lang GROUP BY 1")
def cross_language_edges(spark, d):
    g = graph(spark, d)
    return L.cross_language(g.edges, g.nodes).groupBy("kind").agg(F.count("*").alias("n"))


@query(WITH + "SELECT DISTINCT n.id, n.name, n.file FROM n JOIN e ON e.from_id = n.id WHERE e.stale > 0")
def stale_symbols(spark, d):
    g = graph(spark, d)
    return g.nodes.join(g.edges.where("stale_evidence_count > 0").select(F.col("from_id").alias("id")), "id", "left_semi").select("id", "name", "file")


@query("SELECT 'doc_' || doc_id AS name, strlen(coalesce(text, ''))::BIGINT AS bytes, (strlen(text) >= 4096 AND strlen(text) // greatest(length(text) - length(replace(text, chr(10), '')) + (NOT text LIKE '%' || chr(10))::INT, 1) > 1000) AS minified FROM documents WHERE text IS NOT NULL")
def minified_filter(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select(F.concat(F.lit("doc_"), "doc_id").alias("name"), F.octet_length("text").cast("long").alias("bytes"), T.minified("text").alias("minified"))


# --- dead code and inconsistencies ----------------------------------------------------------------------------------


@query("""SELECT doc_id AS id, CASE WHEN lang = 'de' THEN 'test' WHEN lang = 'fr' THEN 'likely_dead' ELSE 'library_api' END AS bucket
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def orphans(spark, d):
    docs = table(spark, d, "documents")
    nodes = docs.select(
        F.col("doc_id").alias("id"), F.lit("Function").alias("kind"), F.concat(F.when(F.col("lang") == "fr", "_").otherwise("doc"), "doc_id").alias("name"),
        F.concat(F.lit("src/"), "source", F.lit(".rs")).alias("file"), F.lit("Unknown").alias("visibility"), (F.col("lang") == "de").alias("is_test"))
    edges = table(spark, d, "labels").select(F.lit(-1).cast("long").alias("from_id"), F.col("doc_id").alias("to_id"), F.lit("Calls").alias("kind"))
    return A.orphans(CodeGraph(nodes, edges)).select("id", "bucket")


@query("""WITH v AS (SELECT p_partkey AS id, p_brand AS parent, translate(regexp_replace(p_type, '[^\\p{L}\\p{N}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM part)
SELECT a.norm, count(*) AS pairs FROM v a JOIN v b ON a.norm = b.norm AND a.parent <> b.parent AND a.id < b.id WHERE a.norm <> '' GROUP BY 1""")
def enum_mismatches(spark, d):
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("parent"), F.col("p_type").alias("literal"))
    return A.enum_mismatch_counts(v)


_PATHS = "regexp_extract(url, '^[a-z]+://[^/]+(/.*)$', 1)"


@query(f"""WITH p AS (SELECT {_PATHS} AS path, url AS file FROM pages), u AS (SELECT path, min(file) AS lo, max(file) AS hi FROM p WHERE len([x FOR x IN string_split(path, '/') IF x <> '']) >= 2 GROUP BY 1)
SELECT a.path, b.path AS other, levenshtein(a.path, b.path)::INT AS distance FROM u a JOIN u b ON a.path < b.path AND abs(length(a.path) - length(b.path)) <= 2
WHERE levenshtein(a.path, b.path) BETWEEN 1 AND 2 AND abs(length(a.path) - length(b.path)) * 5 <= greatest(length(a.path), length(b.path)) AND NOT (a.lo = a.hi AND b.lo = b.hi AND a.lo = b.lo)
AND NOT (len(string_split(a.path, '/')) = len(string_split(b.path, '/')) AND len([x FOR x IN list_zip(string_split(a.path, '/'), string_split(b.path, '/')) IF x[1] <> x[2] AND NOT (regexp_matches(x[1], '^v[0-9]+$') AND regexp_matches(x[2], '^v[0-9]+$'))]) = 0 AND len([x FOR x IN list_zip(string_split(a.path, '/'), string_split(b.path, '/')) IF x[1] <> x[2]]) = 1)""")
def near_miss_paths(spark, d):
    p = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+(/.*)$", 1).alias("path"), F.col("url").alias("file"))
    return A.near_paths(p)


@query("SELECT DISTINCT lower(translate(concat('db.key_', regexp_replace(c_name, '[^0-9]', '', 'g')), '._-', '')) AS canon FROM customer WHERE regexp_replace(c_name, '[^0-9]', '', 'g') NOT IN (SELECT regexp_replace(s_name, '[^0-9]', '', 'g') FROM supplier)")
def missing_config_keys(spark, d):
    key = lambda c, p: F.concat(F.lit(p), F.regexp_replace(c, "[^0-9]", "")).alias("key")
    refs, defs = table(spark, d, "customer").select(key("c_name", "db.key_")), table(spark, d, "supplier").select(key("s_name", "DB.Key-"))
    return A.missing_keys(refs, defs).select("canon").distinct()


@query("""WITH defs AS (SELECT p_partkey AS id, concat(p_name, '.', p_size) AS key, p_brand AS file, lower(translate(concat(p_name, '.', p_size), '._-', '')) AS canon, p_size FROM part), refs AS (SELECT DISTINCT canon FROM defs WHERE p_size > 25),
live AS (SELECT DISTINCT file FROM defs WHERE canon IN (SELECT canon FROM refs)), last AS (SELECT * FROM defs QUALIFY row_number() OVER (PARTITION BY canon ORDER BY id DESC) = 1)
SELECT id, key, file FROM last WHERE canon NOT IN (SELECT canon FROM refs) AND file IN (SELECT file FROM live)""")
def unused_config_keys(spark, d):
    key = F.concat("p_name", F.lit("."), F.col("p_size").cast("string")).alias("key")
    defs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), key, F.col("p_brand").alias("file"), "p_size")
    return A.unused_keys(defs.where("p_size > 25").select("key"), defs)


_NOISE = "SELECT CASE WHEN p_size <= 30 OR p_brand LIKE '%1' THEN CASE p_size % 3 WHEN 0 THEN 'ConfigKey' WHEN 1 THEN 'StringLiteral' ELSE 'DocSection' END ELSE 'Constant' END AS kind, CASE WHEN p_size = 7 THEN '' ELSE p_brand END AS file FROM part"


@query(f"""WITH p AS ({_NOISE}), f AS (SELECT file, count(*) AS n, sum((kind <> 'Constant')::INT)::BIGINT AS data FROM p WHERE file <> '' GROUP BY 1)
SELECT file, n, data, data * 100 // (SELECT count(*) FROM p) AS share FROM f WHERE data >= 10 AND data * 100 // (SELECT count(*) FROM p) >= 3 AND data * 100 // n >= 90 ORDER BY data DESC, file LIMIT 5""")
def noise_files(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    return A.noise_files(spark.sql(_NOISE), least=10, graph_percent=3)


_LINES = "SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


def _lines(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("value")).distinct().withColumn("file", F.col("id"))


@query(f"WITH l AS ({_LINES}), f AS (SELECT line, count(*) AS n FROM l GROUP BY 1) SELECT c.cap::INT AS cap, coalesce(sum(CASE WHEN c.cap = 0 OR n <= c.cap THEN n * (n - 1) // 2 ELSE 0 END), 0)::BIGINT AS pairs FROM (VALUES (0), (2), (3), (4), (6), (8)) c(cap), f GROUP BY 1")
def string_pair_projection(spark, d):
    return A.pair_projection(_lines(spark, d).select("value", "file"), [0, 2, 3, 4, 6, 8])


@query(f"WITH l AS ({_LINES}), f AS (SELECT line FROM l GROUP BY 1 HAVING count(*) <= 8) SELECT a.doc_id AS a_id, b.doc_id AS b_id, md5(a.line) AS line FROM l a JOIN l b ON a.line = b.line AND a.doc_id < b.doc_id WHERE a.line IN (SELECT line FROM f)")
def string_pairs(spark, d):
    return L.string_pairs(_lines(spark, d), 8).select("a_id", "b_id", F.md5(F.col("value").cast("binary")).alias("line"))


# --- linking ------------------------------------------------------------------------------------------------------

_REFS = "SELECT p_partkey AS ref_id, concat(p_type, CAST(p_size % 4 AS STRING)) AS name, CASE WHEN p_partkey % 11 = 0 THEN concat('f', CAST(p_partkey % 3 AS STRING), '.rs') ELSE concat('src/', p_brand, '/', CAST(p_partkey % 5 AS STRING), '.rs') END AS file, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS qualified_name FROM part"


@query(f"""WITH r AS ({_REFS}), i AS (SELECT DISTINCT file, name, min(file) OVER (PARTITION BY name) AS target, ref_id % 2 = 0 AS ok FROM r), i2 AS (SELECT DISTINCT file, name, target FROM i WHERE ok),
j AS (SELECT a.ref_id, b.ref_id AS id, a.file = b.file AS sf, regexp_extract(a.file, '^(.*)/[^/]*$', 1) = regexp_extract(b.file, '^(.*)/[^/]*$', 1) AS sd, b.qualified_name <> '' AS sq, coalesce(b.file = i2.target, false) AS si
  FROM r a JOIN r b ON a.name = b.name AND a.ref_id <> b.ref_id LEFT JOIN i2 ON i2.file = a.file AND i2.name = a.name),
k AS (SELECT *, sum(sf::INT) OVER w AS nf, sum(sd::INT) OVER w AS nd, sum(sq::INT) OVER w AS nq, sum(si::INT) OVER w AS ni, count(*) OVER w AS n FROM j WINDOW w AS (PARTITION BY ref_id)),
v AS (SELECT *, CASE WHEN nf > 0 THEN 'same_file' WHEN nd = 1 THEN 'same_dir' WHEN nq = 1 THEN 'qualified' WHEN ni > 0 THEN 'import' WHEN n = 1 THEN 'only' END AS rule FROM k)
SELECT ref_id, id, rule FROM v WHERE CASE rule WHEN 'same_file' THEN sf WHEN 'same_dir' THEN sd WHEN 'qualified' THEN sq WHEN 'import' THEN si WHEN 'only' THEN true ELSE false END""")
def reference_candidates(spark, d):
    table(spark, d, "part").createOrReplaceTempView("part")
    p = spark.sql(_REFS)
    first = p.groupBy("name").agg(F.min("file").alias("target"))
    imports = p.where("ref_id % 2 = 0").select("file", "name").join(first, "name")
    return L.candidates(p, p.withColumnRenamed("ref_id", "id"), imports)


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_SPANS = "SELECT event_id AS id, 'f' || user_id AS file, event_id * 7 % 5000 AS span_start, event_id * 7 % 5000 + event_id % 90 AS span_end FROM events"


@query(f"""WITH s AS ({_SPANS}), r AS (SELECT event_id AS ref_id, 'f' || user_id AS file, event_id * 13 % 5200 AS off FROM events),
i AS (SELECT r.ref_id, first(s.id ORDER BY s.span_end - s.span_start, s.span_start, s.id) AS id FROM r JOIN s ON s.file = r.file AND r.off BETWEEN s.span_start AND s.span_end GROUP BY 1),
b AS (SELECT r.ref_id, last(s.id ORDER BY s.span_start, s.id) AS id FROM r JOIN s ON s.file = r.file AND s.span_start <= r.off GROUP BY 1)
SELECT r.ref_id, coalesce(i.id, b.id) AS id, i.id IS NOT NULL AS contained FROM r LEFT JOIN i USING (ref_id) LEFT JOIN b USING (ref_id)""")
def enclosing_symbols(spark, d):
    e = table(spark, d, "events")
    f = F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("file")
    start = (F.col("event_id") * 7 % 5000).alias("span_start")
    spans = e.select(F.col("event_id").alias("id"), f, start, (F.col("event_id") * 7 % 5000 + F.col("event_id") % 90).alias("span_end"))
    return L.enclosing(e.select(F.col("event_id").alias("ref_id"), f, (F.col("event_id") * 13 % 5200).alias("offset")), spans, 256)


@query("""WITH b AS (SELECT item_id AS id, string_split(regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g'), ' ')[1] AS name FROM benchmark), u AS (SELECT name, min(id) AS id FROM b GROUP BY 1 HAVING count(*) = 1),
t AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+')) AS token FROM documents)
SELECT DISTINCT doc_id AS source, id FROM t JOIN u ON t.token = u.name WHERE strlen(token) >= 4 AND token NOT IN (""" + _STOP + ") AND doc_id <> id")
def unique_mentions(spark, d):
    names = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.get(F.split(F.regexp_replace("text", "[^A-Za-z0-9_]+", " "), " "), F.lit(0)).alias("name"))
    words = table(spark, d, "documents").select(F.col("doc_id").alias("source"), F.explode(T.tokens("text")).alias("word"))
    return L.unique_mentions(words, names)


@query("""WITH b AS (SELECT item_id AS id, string_split(regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g'), ' ')[2] AS name, 'b' || item_id % 9 AS file FROM benchmark),
t AS (SELECT DISTINCT 'd' || doc_id AS from_file, unnest(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+')) AS token FROM documents),
h AS (SELECT from_file, file AS to_file, id, token, lag(file) OVER (PARTITION BY from_file ORDER BY token, id) AS prev FROM t JOIN b ON token = name WHERE strlen(token) >= 4 AND token NOT IN (""" + _STOP + """))
SELECT from_file, to_file, id, token FROM h WHERE prev IS NULL OR prev <> to_file""")
def token_links(spark, d):
    second = F.get(F.split(F.regexp_replace("text", "[^A-Za-z0-9_]+", " "), " "), F.lit(1))
    defs = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), second.alias("name"), F.concat(F.lit("b"), (F.col("item_id") % 9).cast("string")).alias("file"))
    return L.token_links(table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("file"), F.col("text").alias("content")), defs)


@query("""WITH f AS (SELECT n_nationkey AS id, substr(n_name, 3) AS name, 'a' AS file FROM nation), c AS (SELECT n_nationkey AS id, n_name AS name, 'b' AS file FROM nation)
SELECT DISTINCT f.id::BIGINT AS id, c.id::BIGINT AS class_id FROM f JOIN c ON ends_with(lower(c.name), lower(f.name)) AND f.file <> c.file WHERE strlen(f.name) >= 4 AND length(c.name) >= 4""")
def field_injections(spark, d):
    n = table(spark, d, "nation")
    fields = n.select(F.col("n_nationkey").cast("long").alias("id"), F.substring("n_name", 3, 100).alias("name"), F.lit("a").alias("file"))
    return L.injections(fields, n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("b").alias("file")))


@query("SELECT l_orderkey AS from_id, l_partkey AS to_id, 'Calls' AS kind, min(l_linenumber) AS pass FROM lineitem GROUP BY 1, 2")
def edge_dedup(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.lit("Calls").alias("kind"), F.col("l_linenumber").alias("pass"), F.lit("NameResolved").alias("origin"), F.lit(0.9).alias("confidence"))
    return L.dedup_edges(e).select("from_id", "to_id", "kind", "pass")


@query("""WITH o AS (SELECT DISTINCT p_type || p_size AS name, p_brand AS file, 'Constant' AS kind FROM part WHERE p_size < 30), w AS (SELECT DISTINCT p_type || p_size AS name, p_brand AS file, 'Constant' AS kind FROM part WHERE p_size > 20)
SELECT *, 'added' AS change FROM (SELECT * FROM w EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM w)""")
def snapshot_diff(spark, d):
    p = table(spark, d, "part").select("p_size", F.concat("p_type", "p_size").alias("name"), F.col("p_brand").alias("file"), F.lit("Constant").alias("kind"))
    return L.snapshot_diff(p.where("p_size < 30"), p.where("p_size > 20"))


@query("""WITH q AS (SELECT p_type AS qualified, p_brand AS file, min(p_partkey) AS q FROM part GROUP BY 1, 2), m AS (SELECT p_name AS name, p_brand AS file, min(p_partkey) AS m FROM part GROUP BY 1, 2)
SELECT p_partkey AS edge_id, coalesce(q.q, m.m) AS id FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN 'gone' ELSE p_type END AS qualified FROM part) p LEFT JOIN q ON q.qualified = p.qualified AND q.file = p.p_brand LEFT JOIN m ON m.name = p.p_name AND m.file = p.p_brand""")
def relink_edges(spark, d):
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("qualified_name"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"))
    lost = p.select(F.col("p_partkey").alias("edge_id"), F.when(F.col("p_partkey") % 4 == 0, "gone").otherwise(F.col("p_type")).alias("qualified"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"))
    return L.relink(lost, nodes)


@query(WITH + "SELECT kind, count(*) AS n FROM e WHERE from_id IN (SELECT id FROM n WHERE file <> 'crates/orders/src/orders_0.rs') AND to_id IN (SELECT id FROM n WHERE file <> 'crates/orders/src/orders_0.rs') GROUP BY 1")
def invalidated_edges(spark, d):
    g = graph(spark, d)
    _, e = L.invalidate(g.nodes, g.edges, spark.createDataFrame([("crates/orders/src/orders_0.rs",)], "file string"))
    return e.groupBy("kind").agg(F.count("*").alias("n"))


# --- mediators, recommendations, changes ------------------------------------------------------------------------------


@query("""WITH k AS (SELECT p_partkey AS id, p_type AS file, CASE WHEN p_partkey % 3 = 0 THEN 'config_ref::' || upper(p_name) ELSE p_name END AS name FROM part),
d AS (SELECT lower(name) AS canon, max(id) AS to_id FROM k WHERE NOT starts_with(name, 'config_ref::') GROUP BY 1)
SELECT id AS from_id, to_id, file AS evidence_file FROM k JOIN d ON canon = lower(substr(name, 13)) WHERE starts_with(name, 'config_ref::')""")
def config_reference_edges(spark, d):
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("config_ref::"), F.upper("p_name"))).otherwise(F.col("p_name"))
    return M.config_references(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("ConfigKey").alias("kind"), name.alias("name"), F.col("p_type").alias("file")))


_ROUTES = "SELECT event_id AS id, event_type AS file, event_id * 30 AS span_start, CASE event_id % 3 WHEN 0 THEN 'StringLiteral' ELSE 'Function' END AS kind, CASE event_id % 3 WHEN 0 THEN '/r' WHEN 1 THEN 'View' ELSE 'view' END AS name FROM events"


@query(f"WITH x AS ({_ROUTES}) SELECT a.id AS from_id, b.id AS to_id, a.file AS evidence_file FROM x a JOIN x b ON a.file = b.file AND b.span_start BETWEEN a.span_start - 200 AND a.span_start + 200 WHERE a.name = '/r' AND b.name = 'View'")
def route_edges(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events")
    return M.route_components(spark.sql(_ROUTES))


_SERVICES = """SELECT n_nationkey * 2 AS id, 'ConfigKey' AS kind, concat('services.', n_name) AS name, concat('a', n_regionkey, '/docker-compose.yml') AS file FROM nation
UNION ALL SELECT n_nationkey * 2 + 1, 'ConfigKey', concat('services.', n_name, '.depends_on.0'), concat('a', n_regionkey, '/docker-compose.yml') FROM nation WHERE n_nationkey % 2 = 0"""


@query("SELECT a.n_nationkey * 2 AS from_id, b.n_nationkey * 2 AS to_id, concat('a', a.n_regionkey, '/docker-compose.yml') AS evidence_file FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey % 2 = 0 AND a.n_nationkey <> b.n_nationkey")
def compose_siblings(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation")
    return M.service_siblings(spark.sql(_SERVICES))


_GO = """SELECT n_nationkey AS id, 'Function' AS kind, concat('New', n_name) AS name, concat('d', n_regionkey, '/main.go') AS file FROM nation
UNION ALL SELECT 1000 + r_regionkey, 'Function', 'wire.Build', concat('d', r_regionkey, '/main.go') FROM region WHERE r_regionkey < 3"""


@query("SELECT a.n_nationkey AS from_id, b.n_nationkey AS to_id, concat('d', a.n_regionkey, '/main.go') AS evidence_file FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE a.n_regionkey < 3")
def provider_pairs(spark, d):
    for name in ("nation", "region"):
        table(spark, d, name).createOrReplaceTempView(name)
    return M.provider_pairs(spark.sql(_GO))


@query("""WITH p AS (SELECT v, sum(n) AS m, sum(n * (n - 1) / 2) AS own, count(*) AS files FROM (SELECT concat(p_brand, '#', p_size) AS v, p_type AS f, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT files, m * (m - 1) / 2 - own AS pairs FROM p), t AS (SELECT count(*) AS n FROM customer),
s AS (SELECT c.cap, coalesce((SELECT sum(pairs) FROM q WHERE files <= c.cap), 0)::BIGINT AS pairs FROM (VALUES (2), (3), (4), (6), (8)) c(cap)),
o AS (SELECT coalesce((SELECT max(cap) FROM s WHERE cap < 8 AND floor(pairs * 100 / (SELECT n FROM t)) <= 10), 2) AS cap)
SELECT 8 AS current_cap, x.pairs AS current_edges, y.cap AS recommended_cap, y.pairs AS projected_edges FROM s x, s y, o WHERE x.cap = 8 AND y.cap = o.cap AND floor(x.pairs * 100 / (SELECT n FROM t)) > 15""")
def cap_recommendation(spark, d):
    values = table(spark, d, "part").select(F.concat("p_brand", F.lit("#"), "p_size").alias("value"), F.col("p_type").alias("file"))
    return R.cap_advice(values, table(spark, d, "customer").count())


@query("""SELECT 'd' || doc_id AS file, 'DO NOT EDIT' AS marker, 1::BIGINT AS symbols FROM documents WHERE doc_id % 6 = 0 AND text IS NOT NULL ORDER BY 1 LIMIT 10""")
def generated_files(spark, d):
    docs = table(spark, d, "documents").withColumn("file", F.concat(F.lit("d"), "doc_id"))
    nodes = docs.select("file", F.when(F.col("doc_id") % 2 == 0, "Function").otherwise("StringLiteral").alias("kind"))
    return R.generated_files(nodes, docs.select("file", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("// DO NOT EDIT\n"), "text")).alias("content")))


_SURE = "conf >= CAST(0.7 AS FLOAT) AND origin IN ('CompilerDerived', 'NameResolved', 'SyntaxMatched')"


@query(WITH + f""", p AS (SELECT 'all' AS page, * FROM e UNION ALL SELECT 'sure', * FROM e WHERE {_SURE} UNION ALL SELECT 'unsure', * FROM e WHERE NOT ({_SURE})),
s AS (SELECT g.page, count(p.kind) FILTER (WHERE {_SURE}) AS verified, count(p.kind) FILTER (WHERE NOT ({_SURE})) AS broken FROM (VALUES ('all'), ('sure'), ('unsure'), ('none')) g(page) LEFT JOIN p USING (page) GROUP BY 1)
SELECT page, CASE WHEN broken = 0 THEN 'Verified' WHEN verified = 0 THEN 'Broken' ELSE 'Partial' END AS trust, verified, broken FROM s""")
def path_trust(spark, d):
    e, ok = graph(spark, d).edges, R.verified()
    pages = {"all": e, "sure": e.where(ok), "unsure": e.where(~ok), "none": e.where("false")}
    found = [R.path_trust(rows, ok).select(F.lit(page).alias("page"), "trust", "verified", "broken") for page, rows in pages.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query(WITH + f", x AS (SELECT id FROM n WHERE name = (SELECT min(c_name) FROM customer)) SELECT DISTINCT from_id, to_id, kind FROM e WHERE kind NOT IN ('Resolves', 'Contains', 'BelongsTo') AND (from_id IN (FROM x) OR to_id IN (FROM x))")
def references_by_name(spark, d):
    return R.references_to(graph(spark, d), table(spark, d, "customer").agg(F.min("c_name")).first()[0])


_FILES = [("crates/region/src/region_0.rs",), ("crates/supplier/src/supplier_3.rs",), ("crates/orders/src/orders_7.py",)]


@query(WITH + f""", x AS (SELECT id, file FROM n WHERE file IN ({', '.join(repr(f[0]) for f in _FILES)})), c AS (SELECT x.file, e.from_id, max(e.cur) AS c FROM x JOIN e ON e.to_id = x.id WHERE e.from_id NOT IN (SELECT id FROM x y WHERE y.file = x.file) GROUP BY 1, 2)
SELECT file, symbols, coalesce(reached, 0) AS reached, round(coalesce(total, 0), 6) AS confidence FROM (SELECT file, count(*) AS symbols FROM x GROUP BY 1) LEFT JOIN (SELECT file, count(*) AS reached, sum(c) AS total FROM c GROUP BY 1) USING (file)""")
def changed_file_impact(spark, d):
    found = R.file_impact(graph(spark, d), spark.createDataFrame(_FILES, "file string"), depth=1)
    return found.select("file", "symbols", "reached", F.round("confidence", 6).alias("confidence"))


@query("""WITH t AS (SELECT doc_id, source, sum(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) // 4 + (length(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g'))) // 2 + 1) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS tokens FROM documents)
SELECT * FROM t WHERE tokens <= 5600""")
def budget_page(spark, d):
    return R.within_budget(table(spark, d, "documents").select("doc_id", "source", "text"), "text", ["source"], ["doc_id"], 8000).select("doc_id", "source", F.col("tokens").cast("long").alias("tokens"))


# --- exports, functions, streaming ----------------------------------------------------------------------------------


@query(WITH + "SELECT '  n' || from_id || ' -> n' || to_id || ' [label=\"' || kind || '\"];' AS line FROM e WHERE conf >= CAST(0.8 AS FLOAT)")
def dot_export(spark, d):
    return S.dot_edges(graph(spark, d).edges, 0.8)


@query(WITH + "SELECT 'MATCH (a {id: ' || from_id || '}), (b {id: ' || to_id || '}) CREATE (a)-[:' || kind || ' {confidence: ' || printf('%.3f', conf::DOUBLE) || '}]->(b);' AS line FROM e WHERE conf >= CAST(0.8 AS FLOAT)")
def cypher_export(spark, d):
    return S.cypher_edges(graph(spark, d).edges, 0.8)


@query("""SELECT event_id, lower(translate(event_type, '._-', '')) AS canon, CASE WHEN event_id % 2 = 0 THEN 'crates' ELSE event_type END AS module FROM events""")
def text_functions(spark, d):
    path = F.when(F.col("event_id") % 2 == 0, F.lit("a/crates/src/x.rs")).otherwise(F.concat("event_type", F.lit("/src/lib.rs")))
    return table(spark, d, "events").select("event_id", T.config_key("event_type").alias("canon"), F.when(F.col("event_id") % 2 == 0, F.lit("crates")).otherwise(T.module_of(path)).alias("module"))


@query("SELECT 'd' || doc_id AS path, CASE WHEN text IS NULL THEN 'removed' WHEN doc_id % 3 = 0 THEN 'unchanged' ELSE 'changed' END AS change FROM documents WHERE doc_id % 3 = 0 OR text <> 'old' OR text IS NULL")
def change_detection(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("d"), "doc_id"))
    old = docs.select("path", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("old").alias("content"))
    return changes.classify(changes.hashed(old), changes.hashed(docs.where("text IS NOT NULL").select("path", F.col("text").alias("content")))).select("path", "change")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def streamed_histogram(spark, d):
    return changes.drained(spark, d, "events.parquet", lambda s: s.groupBy("event_type").agg(F.count("*").alias("n")), "complete")


from . import extra  # noqa: E402, F401  (registers its queries)
