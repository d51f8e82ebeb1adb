"""Doc comments that no longer fit their function: documented parameters that the signature doesn't have."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.extract import blanked

#: Tags of documented parameters, the languages looked at, and how far a renamed parameter may be off.
SCRIPT_TAG = r"@param\b\s*(?:\{[^}]*\})?\s*(\[?[\w$.]+)"
PYTHON_TAG = r":param\s+([^:]+):"
COVERED = ["java", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "pyi"]
MOST_APART = 2
NAME = re.compile(r"[A-Za-z_$][\w$]*")


def documented(text, python: Column) -> Column:
    """Names of the parameters that a doc comment describes; nested ones (``a.b``) and rest parameters aside."""
    script = F.transform(F.regexp_extract_all(text, F.lit(SCRIPT_TAG), F.lit(1)), lambda s: F.regexp_replace(s, r"^\[|\]$|=.*$", ""))
    plain = F.transform(F.regexp_extract_all(text, F.lit(PYTHON_TAG), F.lit(1)), lambda s: F.regexp_extract(s, r"(\S+)\s*$", 1))
    return F.filter(F.when(python, plain).otherwise(script), lambda s: s.rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*$"))


def _bare(name: Column) -> Column:
    return F.regexp_replace(name, "^_", "")


def missing(documented: Column, actual: Column) -> Column:
    """Documented names that the signature lacks, each with the actual names close to it; a leading underscore more or less
    is the same name."""
    lacks = F.filter(documented, lambda p: ~F.exists(actual, lambda a: _bare(a) == _bare(p)))
    near = lambda p: F.array_sort(F.filter(F.transform(actual, lambda a: F.struct(F.levenshtein(a, p).alias("d"), a.alias("name"))), lambda v: v["d"] <= MOST_APART))
    return F.transform(lacks, lambda p: F.struct(p.alias("name"), F.transform(near(p), lambda v: v["name"]).alias("candidates")))


def parameters(source: str, start: int, end: int, extension: str) -> list[str]:
    """Identifiers of a function's parameter list, types and defaults included: a name too many hides no drift of another."""
    raw = source.encode("utf-8", "surrogatepass")[start:end].decode("utf-8", "replace")
    if extension in ("py", "pyi"):
        try:
            first = re.match(r"[ \t]*", raw)[0]
            node = ast.parse(re.sub(rf"(?m)^{first}", "", raw)).body[0]
            return sorted({a.arg for a in ast.walk(node.args) if isinstance(a, ast.arg)})
        except (SyntaxError, ValueError, IndexError, AttributeError):
            pass
    plain = blanked(raw, r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`')
    at = plain.find("(")
    depth, stop = 0, len(plain)
    for m in re.compile(r"[()]").finditer(plain, max(at, 0)):
        depth += 1 if m[0] == "(" else -1
        if depth == 0:
            stop = m.start()
            break
    return sorted(set(NAME.findall(plain[at + 1 : stop]))) if at >= 0 else []


def parameter_drift(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each documented parameter that its function or method doesn't have: id, symbol, file, parameter, candidates.

    ``nodes`` and ``edges`` hold the doc comments and what they document; ``sources(file, content)`` the texts. Functions
    without parameters, and languages that aren't covered, have no drift.
    """
    docs = nodes.where("kind = 'DocComment'").select(F.col("id").alias("from_id"), F.col("span_start").alias("ds"), F.col("span_end").alias("de"))
    functions = nodes.where("kind IN ('Function', 'Method')").select(F.col("id").alias("to_id"), "name", "file", F.col("span_start").alias("fs"), F.col("span_end").alias("fe"))
    extension = F.lower(T.extension("file"))
    pairs = edges.where("kind = 'Documents'").select("from_id", "to_id").join(docs, "from_id").join(functions, "to_id").where(extension.isin(COVERED))
    body = F.substring(T.utf8_bytes("content"), (F.col("ds") + 1).cast("int"), (F.col("de") - F.col("ds")).cast("int"))
    known = pairs.join(sources.select("file", "content"), "file").withColumn("said", documented(F.decode(F.encode(body, "ISO-8859-1"), "UTF-8"), extension.isin("py", "pyi")))
    known = known.where(F.size("said") > 0)

    @F.pandas_udf("array<string>")
    def signature(content: pd.Series, start: pd.Series, end: pd.Series, ending: pd.Series) -> pd.Series:
        return pd.Series([parameters(c, int(s), int(e), x) for c, s, e, x in zip(content, start, end, ending, strict=True)], dtype=object)

    held = known.withColumn("actual", signature("content", "fs", "fe", extension)).where(F.size("actual") > 0)
    out = held.select(F.col("to_id").alias("id"), F.col("name").alias("symbol"), "file", F.explode(missing(F.col("said"), F.col("actual"))).alias("m"))
    return out.select("id", "symbol", "file", F.col("m.name").alias("parameter"), "m.candidates")


