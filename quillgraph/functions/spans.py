"""Byte offsets, lines and columns of UTF-8 texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _c, utf8_bytes


def line_column(content, offset) -> Column:
    """(line, col) of a byte offset, from 0; col in UTF-16 units. Offsets beyond the end or inside a character move back."""
    b = utf8_bytes(content)
    at = F.least(_c(offset).cast("int"), F.length(b))
    inside = lambda x: F.substring(b, x + 1, F.lit(1)).rlike("[\\x80-\\xBF]")
    for _ in range(3):
        at = F.when((at > 0) & (at < F.length(b)) & inside(at), at - 1).otherwise(at)
    before = F.substring(b, F.lit(1), at)
    last = F.decode(F.encode(F.substring_index(before, "\n", -1), "ISO-8859-1"), "UTF-8")
    wide = F.regexp_count(last, F.lit("[\\x{10000}-\\x{10FFFF}]"))
    return F.struct(F.regexp_count(before, F.lit("\n")).alias("line"), (F.length(last) + wide).alias("col"))


def line_offset(content, line) -> Column:
    """Byte offset of a line's first byte, lines from 0; null beyond the last."""
    lines = F.split(_c(content), "\n", -1)
    sizes = F.transform(F.slice(lines, F.lit(1), _c(line)), lambda x: F.octet_length(x).cast("long") + 1)
    return F.when(_c(line) < F.size(lines), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b))


def snippets(sources: DataFrame, spots: DataFrame, around: int = 3) -> DataFrame:
    """Lines around each of ``spots(file, line)`` (from 1) of ``sources(file, content)``: file, line, number, text."""
    lines = sources.join(spots, "file").select("file", "line", F.posexplode(F.split("content", "\n", -1)).alias("number", "text"))
    return lines.withColumn("number", F.col("number") + 1).where(F.abs(F.col("number") - F.col("line")) <= around)
