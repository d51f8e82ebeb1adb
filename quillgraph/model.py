"""Data model: nodes and edges as two DataFrames, with the tables that give edges their confidence and trust."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_SCHEMA = "id long, kind string, name string, qualified_name string, file string, span_start long, span_end long, status string, visibility string, is_test boolean"
EDGE_SCHEMA = "from_id long, to_id long, kind string, origin string, confidence float, evidence_file string, created_at_epoch long, stale_evidence_count int"

#: Edge kind, base confidence, page priority, whether impact follows it, trust model.
EDGE_KINDS = [
    ("Calls", 0.90, 0, True, "SourceEvidenced"),
    ("Implements", 0.90, 1, True, "ContractDependent"),
    ("Extends", 0.90, 2, True, "ContractDependent"),
    ("Inherits", 0.90, 3, True, "ContractDependent"),
    ("Overrides", 0.85, 4, True, "ContractDependent"),
    ("Imports", 0.85, 5, True, "SourceEvidenced"),
    ("References", 0.80, 6, True, "SourceEvidenced"),
    ("DependsOn", 0.60, 7, True, "SourceEvidenced"),
    ("TypeOf", 0.85, 8, False, "ContractDependent"),
    ("GenericParam", 0.80, 9, False, "ContractDependent"),
    ("Configures", 0.70, 10, False, "ExternallyMediated"),
    ("EnumValueMatch", 0.75, 11, False, "Bidirectional"),
    ("ApiPathMatch", 0.75, 12, False, "Bidirectional"),
    ("StringMatch", 0.70, 13, False, "Bidirectional"),
    ("Contains", 1.0, 14, False, "SourceEvidenced"),
    ("BelongsTo", 1.0, 15, False, "SourceEvidenced"),
    ("Documents", 1.0, 16, False, "SourceEvidenced"),
    ("Mentions", 1.0, 17, False, "SourceEvidenced"),
    ("DescribedIn", 1.0, 18, False, "Bidirectional"),
    ("Resolves", 1.0, 19, True, "SourceEvidenced"),
]
#: Base confidence of where an edge comes from.
ORIGINS = {"CompilerDerived": 0.99, "NameResolved": 0.95, "SyntaxMatched": 0.85, "PatternMatched": 0.60, "ConventionInferred": 0.40, "Dynamic": 0.20}
IMPACT_KINDS = [k for k, _, _, impact, _ in EDGE_KINDS if impact]
NOT_IMPACT_NODES = ["File", "DocComment", "DocSection"]
CODE_KINDS = ["Function", "Method", "Class", "Struct", "Interface", "Trait", "Enum", "Constant", "Variable", "Field", "TypeAlias", "Namespace"]
STRUCTURAL_KINDS = ["Contains", "BelongsTo", "Documents", "DescribedIn"]
STALE_DECAY = 0.7


@dataclass
class CodeGraph:
    """``impact`` is what ``impact_edges`` derives, where a snapshot keeps it."""

    nodes: DataFrame
    edges: DataFrame
    impact: DataFrame | None = None


def _case(of: str, pairs) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for key, value in pairs:
        out = out.when(F.col(of) == key, F.lit(value))
    return out


def kind_base() -> Column:
    return _case("kind", [(k, b) for k, b, *_ in EDGE_KINDS])


def origin_base() -> Column:
    return _case("origin", ORIGINS.items())


def priority() -> Column:
    return F.coalesce(_case("kind", [(k, p) for k, _, p, *_ in EDGE_KINDS]), F.lit(99))


def trust_model() -> Column:
    return _case("kind", [(k, t) for k, *_, t in EDGE_KINDS])


def stored_confidence() -> Column:
    """Single precision product of kind and origin, as filters use it."""
    return (kind_base().cast("float") * origin_base().cast("float")).cast("float")


def current_confidence() -> Column:
    """Origin's confidence after decay by stale evidence, as risk uses it."""
    return origin_base() * F.pow(F.lit(STALE_DECAY), F.col("stale_evidence_count"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for the driver and all executors; a temporary one only if it names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder. Unlike a checkpoint its size is known, so a small frontier is
    broadcast by Spark's own check and the edges aren't shuffled for it."""
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def impact_edges(graph: CodeGraph) -> DataFrame:
    """Edges that impact follows, between nodes that it counts."""
    if graph.impact is not None:
        return graph.impact
    ok = graph.nodes.where(~F.col("kind").isin(NOT_IMPACT_NODES)).select("id")
    e = graph.edges.where(F.col("kind").isin(IMPACT_KINDS))
    return e.join(ok.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ok.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def by_target(edges: DataFrame) -> DataFrame:
    """Edges as a table in order of ``to_id``, so that a scan for a few targets skips most of it."""
    return settled(edges.repartitionByRange("to_id").sortWithinPartitions("to_id"))


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
