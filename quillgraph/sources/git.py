"""Git as a source: changed files, shares of authors, whether an operation is under way. Runs ``git`` on the driver."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

IN_PROGRESS = ["MERGE_HEAD", "REBASE_HEAD", "CHERRY_PICK_HEAD"]


def _lines(root: str, *arguments: str) -> list[str] | None:
    """Lines that a git command prints; None if it fails."""
    done = subprocess.run(["git", "-c", "core.quotePath=false", *arguments], cwd=root, capture_output=True, text=True, errors="replace", check=False)
    return [x for x in done.stdout.splitlines() if x] if done.returncode == 0 else None


def changed_files(spark: SparkSession, root: str, base: str, to: str = "HEAD") -> DataFrame:
    """``(file)``, relative to the root: what differs between two revisions, with the working tree's changes if ``to`` is HEAD.

    Sorted, each once. Without a repository or with an unknown revision nothing has changed.
    """
    found = _lines(root, "diff", "--name-only", f"{base}..{to}")
    if found is not None and to == "HEAD":
        found += _lines(root, "diff", "--name-only", "HEAD") or []
    return spark.createDataFrame([(f,) for f in sorted(set(found or []))], "file string")


def operation_in_progress(root: str) -> bool:
    return any(os.path.exists(os.path.join(root, ".git", name)) for name in IN_PROGRESS)


def blame(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    """``(file, author)``: the author of each commit that the blame of a file names, once a commit."""
    rows = [(f, line[12:].strip()) for f in files for line in _lines(root, "blame", "--porcelain", "--", f) or [] if line.startswith("author-mail ")]
    return spark.createDataFrame(rows, "file string, author string")


def ownership(blamed: DataFrame) -> DataFrame:
    """Each author's share of a file's commits: file, author, commits, share."""
    counts = blamed.groupBy("file", "author").agg(F.count("*").alias("commits"))
    return counts.withColumn("share", (F.col("commits") / F.sum("commits").over(Window.partitionBy("file"))).cast("float"))
