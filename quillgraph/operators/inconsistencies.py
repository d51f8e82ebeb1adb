"""Pairs of symbols that contradict each other, and the edges between symbols of one value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import analysis, linking

CATEGORIES = ["EnumMismatch", "ApiPath", "ConfigKey"]
REPORT = ["category", "a_id", "b_id", "shared"]
API_PATH, CONFIG_REF = "api_path::", "config_ref::"


def owner(name, file):
    """The enum that a variant belongs to: what stands before its last dot, else its last ``::``; else the file's stem."""
    dot = F.regexp_extract(name, r"^(?s:(.*))\.[^.]*$", 1)
    colons = F.regexp_extract(name, r"^(?s:(.*))::(?:(?!::).)*$", 1)
    return F.when(F.contains(name, F.lit(".")), dot).when(F.contains(name, F.lit("::")), colons).otherwise(T.file_stem(file))


def enum_pairs(variants: DataFrame) -> DataFrame:
    """``variants(id, name, file)`` of one full name in different files and of different owners, each pair once."""
    v = variants.select("id", "name", "file", owner(F.col("name"), "file").alias("owner"))
    b = v.select(F.col("id").alias("b_id"), "name", F.col("file").alias("f2"), F.col("owner").alias("o2"))
    return v.join(b, "name").where("id < b_id AND file <> f2 AND owner <> o2").select(F.col("id").alias("a_id"), "b_id", F.col("name").alias("value"))


def mismatched_names(variants: DataFrame) -> DataFrame:
    """Local variant names that stand under more than one enum; ``variants(name)`` as ``Enum::Variant``."""
    v = variants.select(F.substring_index("name", "::", 1).alias("enum"), F.element_at(F.split("name", "::"), -1).alias("variant"))
    return v.groupBy("variant").agg(F.countDistinct("enum").alias("enums")).where("enums > 1")


def value_edges(nodes: DataFrame, cap: int = 8) -> DataFrame:
    """Edges between symbols of one value: string literals (values in at most ``cap`` files) and enum variants.

    Pairs of variants are EnumValueMatch, pairs of API paths ApiPathMatch, any other StringMatch.
    """
    strings = linking.string_pairs(nodes.where("kind = 'StringLiteral'").select("id", F.col("name").alias("value"), "file"), cap)
    variants = enum_pairs(nodes.where("kind = 'EnumVariant'").select("id", "name", "file"))
    kind = F.when(F.col("value").startswith(API_PATH), "ApiPathMatch").otherwise("StringMatch")
    out = strings.select("a_id", "b_id", kind.alias("kind")).unionByName(variants.select("a_id", "b_id", F.lit("EnumValueMatch").alias("kind")))
    file = nodes.select(F.col("id").alias("a_id"), F.col("file").alias("evidence_file"))
    return out.join(file, "a_id").select(F.col("a_id").alias("from_id"), F.col("b_id").alias("to_id"), "kind", F.lit("SyntaxMatched").alias("origin"), "evidence_file")


def found(nodes: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """Reports of all detectors that aren't ``disabled``: category, a_id, b_id, shared.

    Enum variants of one meaning under different enums, API paths a letter or two apart, configuration keys referred to
    but never defined (b_id is null) or defined but never referred to (a_id is null).
    """
    unknown = set(disabled or []) - set(CATEGORIES)
    if unknown:
        raise ValueError(f"unknown categories {sorted(unknown)}")
    parts = []
    if "EnumMismatch" not in (disabled or []):
        v = nodes.where("kind = 'EnumVariant'").select("id", T.parent_name("name").alias("parent"), T.local_name("name").alias("literal"))
        parts.append(analysis.enum_mismatches(v).select(F.lit("EnumMismatch").alias("category"), "a_id", "b_id", F.col("norm").alias("shared")))
    if "ApiPath" not in (disabled or []):
        p = nodes.where((F.col("kind") == "StringLiteral") & F.col("name").startswith(API_PATH)).select("id", F.substring("name", len(API_PATH) + 1, 1 << 20).alias("path"), "file")
        first = p.groupBy("path").agg(F.min("id").alias("id"))
        near = analysis.near_paths(p.select("path", "file"))
        a, b = first.withColumnRenamed("id", "a_id"), first.select(F.col("path").alias("other"), F.col("id").alias("b_id"))
        parts.append(near.join(a, "path").join(b, "other").select(F.lit("ApiPath").alias("category"), "a_id", "b_id", F.concat("path", F.lit(" ~ "), "other").alias("shared")))
    if "ConfigKey" not in (disabled or []):
        keys = nodes.where("kind = 'ConfigKey'")
        refs = keys.where(F.col("name").startswith(CONFIG_REF)).select("id", F.substring("name", len(CONFIG_REF) + 1, 1 << 20).alias("key"))
        defs = keys.where(~F.contains("name", F.lit("_ref::"))).select("id", F.col("name").alias("key"), "file")
        none = F.lit(None).cast("long")
        parts.append(analysis.missing_keys(refs, defs).select(F.lit("ConfigKey").alias("category"), F.col("id").alias("a_id"), none.alias("b_id"), F.col("key").alias("shared")))
        parts.append(analysis.unused_keys(refs, defs).select(F.lit("ConfigKey").alias("category"), none.alias("a_id"), F.col("id").alias("b_id"), F.col("key").alias("shared")))
    if not parts:
        return nodes.sparkSession.createDataFrame([], "category string, a_id long, b_id long, shared string")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
