"""Mediators: edges of kind Configures that no reference in the source shows. Each takes nodes and gives
``(from_id, to_id, evidence_file)``; ``MEDIATORS`` names them and takes further ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import linking

CONFIG_REF = "config_ref::"
MEDIATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def mediator(name: str):
    def add(f):
        MEDIATORS[name] = f
        return f

    return add


@mediator("spring-config")
def config_references(nodes: DataFrame) -> DataFrame:
    """References to configuration keys with the last definition of the key, case aside."""
    keys = nodes.where(F.col("kind") == "ConfigKey")
    is_ref = F.col("name").startswith(CONFIG_REF)
    last = keys.where(~is_ref).groupBy(T.ascii_lower("name").alias("canon")).agg(F.max("id").alias("to_id"))
    refs = keys.where(is_ref).select(F.col("id").alias("from_id"), F.col("file").alias("evidence_file"), T.ascii_lower(F.substring("name", len(CONFIG_REF) + 1, 1 << 20)).alias("canon"))
    return refs.join(last, "canon").where("from_id <> to_id").select("from_id", "to_id", "evidence_file")


@mediator("routes")
def route_components(nodes: DataFrame, within: int = 200) -> DataFrame:
    """Route literals with the capitalised functions and classes that start at most ``within`` bytes away in the file.

    A band join: components are filed under the bins next to theirs, so it is an equi-join on file and bin.
    """
    at = F.floor(F.col("span_start") / within)
    routes = nodes.where((F.col("kind") == "StringLiteral") & F.col("name").startswith("/"))
    routes = routes.select("file", F.col("id").alias("from_id"), F.col("span_start").alias("r"), at.alias("bin"))
    parts = nodes.where(F.col("kind").isin("Function", "Class") & F.col("name").rlike(r"^\p{Lu}"))
    parts = parts.select("file", F.col("id").alias("to_id"), F.col("span_start").alias("c"), F.explode(F.array(at - 1, at, at + 1)).alias("bin"))
    return routes.join(parts, ["file", "bin"]).where(F.abs(F.col("r") - F.col("c")) <= within).select("from_id", "to_id", F.col("file").alias("evidence_file"))


@mediator("compose")
def service_siblings(nodes: DataFrame) -> DataFrame:
    """Services that depend on something, with every other service declared in the same compose file."""
    file = F.element_at(F.split("file", "/"), -1)
    keys = nodes.where((F.col("kind") == "ConfigKey") & file.rlike(r"^(docker-compose(\.override)?|compose)\.ya?ml$") & F.col("name").startswith("services."))
    parts = keys.select("file", "id", F.split("name", r"\.").alias("p"))
    declared = parts.where(F.size("p") == 2).groupBy("file", F.get("p", F.lit(1)).alias("service")).agg(F.min("id").alias("id"))
    needing = parts.where((F.size("p") > 2) & F.get("p", F.lit(2)).isin("depends_on", "depends-on")).select("file", F.get("p", F.lit(1)).alias("service")).distinct()
    a = declared.join(needing, ["file", "service"], "left_semi").select("file", F.col("id").alias("from_id"))
    return a.join(declared.select("file", F.col("id").alias("to_id")), "file").where("from_id <> to_id").select("from_id", "to_id", F.col("file").alias("evidence_file"))


@mediator("go-di")
def provider_pairs(nodes: DataFrame, wire_up: str = r"(?i)^(go_di_marker::)?(wire\.build|fx\.provide)$") -> DataFrame:
    """Constructors (``New...``) of a Go file that also wires them up, in pairs by id. ``wire_up`` tells such names."""
    go = nodes.where(F.lower(T.extension("file")).eqNullSafe("go") & F.col("kind").isin("Function", "Method"))
    made = go.where(F.col("name").startswith("New") & (F.octet_length("name") > 3)).join(go.where(F.col("name").rlike(wire_up)).select("file").distinct(), "file", "left_semi")
    return made.select("file", F.col("id").alias("from_id")).join(made.select("file", F.col("id").alias("to_id")), "file").where("from_id < to_id").select("from_id", "to_id", F.col("file").alias("evidence_file"))


@mediator("spring-di")
def field_classes(nodes: DataFrame) -> DataFrame:
    """Fields and variables with the classes of other files whose names end in theirs."""
    fields = nodes.where(F.col("kind").isin("Field", "Variable")).select("id", "name", "file")
    classes = nodes.where(F.col("kind").isin("Class", "Interface")).select("id", "name", "file")
    found = linking.injections(fields, classes).join(fields.select("id", "file"), "id")
    return found.select(F.col("id").alias("from_id"), F.col("class_id").alias("to_id"), F.col("file").alias("evidence_file"))


def mediated(nodes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Edges of all mediators named (all that are known), each pair once."""
    found = [MEDIATORS[n](nodes) for n in (names or sorted(MEDIATORS))]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("from_id", "to_id").agg(F.min("evidence_file").alias("evidence_file")).withColumn("kind", F.lit("Configures"))
