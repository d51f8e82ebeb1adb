"""A code graph made of the driver's tables; the same SQL builds it for the engine and for the oracle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import CodeGraph, by_target, impact_edges, register, settled, stored_confidence
from ..operators.linking import drop_dangling

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

NODES = """
SELECT 10000000000 + r_regionkey AS id, 'Namespace' AS kind, r_name AS name, 'region' AS tab, CAST(r_regionkey AS BIGINT) AS k, 'Unknown' AS visibility, false AS is_test FROM region
UNION ALL SELECT 20000000000 + n_nationkey, 'Class', n_name, 'nation', CAST(n_nationkey AS BIGINT), 'Unknown', false FROM nation
UNION ALL SELECT 30000000000 + c_custkey, 'Class', c_name, 'customer', c_custkey, 'Unknown', false FROM customer
UNION ALL SELECT 40000000000 + s_suppkey, 'Struct', s_name, 'supplier', s_suppkey, 'Unknown', false FROM supplier
UNION ALL SELECT 50000000000 + p_partkey, 'Constant', p_name, 'part', p_partkey, 'Unknown', false FROM part
UNION ALL SELECT 60000000000 + o_orderkey, 'Function', concat('order_', CAST(o_orderkey AS STRING)), 'orders', o_orderkey,
  CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'Public' WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'Private' ELSE 'Unknown' END, o_orderstatus = 'P' FROM orders
UNION ALL SELECT 70000000000 + event_id, 'Method', concat(event_type, '_', CAST(event_id AS STRING)), 'events', event_id, 'Unknown', false FROM events
"""

FILED = """
SELECT id, kind, name, name AS qualified_name,
  concat('crates/', tab, '/src/', tab, '_', CAST(k % 50 AS STRING), CASE k % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' ELSE '.go' END) AS file,
  k * 10 AS span_start, k * 10 + 9 AS span_end, 'Verified' AS status, visibility, is_test FROM raw_nodes
"""

EDGES = """
SELECT 20000000000 + n_nationkey AS from_id, 10000000000 + n_regionkey AS to_id, 'DependsOn' AS kind, 'SyntaxMatched' AS origin, 0 AS stale FROM nation
UNION ALL SELECT 30000000000 + c_custkey, 20000000000 + c_nationkey, 'Extends', 'NameResolved', 0 FROM customer
UNION ALL SELECT 40000000000 + s_suppkey, 20000000000 + s_nationkey, 'Implements', 'NameResolved', 0 FROM supplier
UNION ALL SELECT 60000000000 + o_orderkey, 30000000000 + o_custkey, 'Calls', 'NameResolved', CAST(o_orderkey % 3 AS INT) FROM orders
UNION ALL SELECT DISTINCT 60000000000 + l_orderkey, 50000000000 + l_partkey, 'References', 'SyntaxMatched', 0 FROM lineitem
UNION ALL SELECT DISTINCT 50000000000 + l_partkey, 40000000000 + l_suppkey, 'Imports', 'PatternMatched', 0 FROM lineitem
UNION ALL SELECT 70000000000 + event_id, 30000000000 + user_id, 'Resolves', 'SyntaxMatched', 0 FROM events
UNION ALL SELECT a, b, 'Calls', 'Dynamic', 0 FROM (
  SELECT 70000000000 + event_id AS a, 70000000000 + lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) x WHERE b IS NOT NULL
"""

_KIND = "CASE e.kind WHEN 'DependsOn' THEN 0.6 WHEN 'Extends' THEN 0.9 WHEN 'Implements' THEN 0.9 WHEN 'Calls' THEN 0.9 WHEN 'References' THEN 0.8 WHEN 'Imports' THEN 0.85 WHEN 'Resolves' THEN 1.0 END"
_ORIGIN = "CASE e.origin WHEN 'SyntaxMatched' THEN 0.85 WHEN 'NameResolved' THEN 0.95 WHEN 'PatternMatched' THEN 0.6 WHEN 'Dynamic' THEN 0.2 END"

#: For DuckDB: tables n (nodes) and e (edges that join nodes at both ends), with stored (conf) and live (cur) confidence.
WITH = f"""
WITH RECURSIVE raw_nodes AS ({NODES}), n AS ({FILED}), raw_edges AS ({EDGES}),
e AS (SELECT e.*, CAST({_KIND} AS FLOAT) * CAST({_ORIGIN} AS FLOAT) AS conf, CAST({_ORIGIN} AS DOUBLE) * power(CAST(0.7 AS DOUBLE), e.stale) AS cur
      FROM raw_edges e WHERE e.from_id IN (SELECT id FROM n) AND e.to_id IN (SELECT id FROM n))
"""


_SNAPSHOTS: dict[tuple[str, str], tuple[list, CodeGraph]] = {}


def file_states(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """Length and last change of each table's files."""
    context, out = spark.sparkContext, []
    for name in TABLES:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(path)
        out.append((sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)))
    return out


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The graph of a folder's tables, built once a session as a snapshot and again when a table's files change."""
    key, now = (spark.sparkContext.applicationId, sf_dir), file_states(spark, sf_dir)
    if key not in _SNAPSHOTS or _SNAPSHOTS[key][0] != now:
        built = build(spark, sf_dir)
        nodes = settled(built.nodes)
        edges = settled(drop_dangling(built.edges, nodes))
        _SNAPSHOTS[key] = now, CodeGraph(nodes, edges, by_target(impact_edges(CodeGraph(nodes, edges))))
    return replace(_SNAPSHOTS[key][1])


def build(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Nodes and edges as derived from the tables, edges without a node at either end included."""
    register(spark, sf_dir, TABLES)
    spark.sql(NODES).createOrReplaceTempView("raw_nodes")
    edges = spark.sql(EDGES).withColumnRenamed("stale", "stale_evidence_count").withColumn("confidence", stored_confidence())
    edges = edges.withColumn("evidence_file", F.concat(F.lit("crates/e"), (F.col("to_id") % 4).cast("string"), F.lit("/src/x.rs"))).withColumn("created_at_epoch", F.lit(0).cast("long"))
    return CodeGraph(spark.sql(FILED), edges)
