"""Import specifiers to files, and what imports and re-exports bring along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T

#: Endings that a specifier may be written with, and those that files are tried with, in order.
WRITTEN = r"\.(?:js|jsx|ts|tsx|mjs|cjs)$"
TRIED = ["ts", "tsx", "js", "jsx", "mts", "cts"]
INDEXES = ["index.ts", "index.tsx", "index.js", "index.jsx"]
FALLBACKS = ["src/index", "index"]

#: Statements of scripts that import or hand on names: ``what`` is import or export, ``names`` a list in braces or a star.
STATEMENT = r"""(?m)^[ \t]*(import|export)\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?(\{[^}]*\}|\*(?:\s+as\s+[\w$]+)?)\s*from\s*["']([^"'\n]+)["']"""


def bindings(sources: DataFrame) -> DataFrame:
    """Names that scripts import or re-export by braces: ``sources(file, content)`` -> file, what, imported, local, specifier;
    a re-exported star has imported "*"."""
    pick = lambda k: F.regexp_extract_all("content", F.lit(STATEMENT), F.lit(k))
    rows = sources.where(T.language("file").isin("typescript", "javascript")).select(
        "file", F.explode(F.arrays_zip(pick(1).alias("what"), pick(2).alias("names"), pick(3).alias("specifier"))).alias("s"))
    rows = rows.select("file", "s.what", "s.names", "s.specifier")
    parts = F.filter(F.transform(F.split(F.regexp_replace("names", r"[{}]", ""), ","), lambda x: F.regexp_replace(F.trim(F.translate(x, "\n\r\t", "   ")), "^type +", "")), lambda x: x != "")
    named = rows.where(F.col("names").startswith("{")).select("file", "what", "specifier", F.explode(parts).alias("p"))
    both = F.split("p", r"\s+as\s+")
    named = named.select("file", "what", F.get(both, F.lit(0)).alias("imported"), F.element_at(both, -1).alias("local"), "specifier")
    stars = rows.where((F.col("what") == "export") & (F.col("names") == "*")).select("file", "what", F.lit("*").alias("imported"), F.lit("*").alias("local"), "specifier")
    return named.unionByName(stars)


def _tries(base: Column) -> Column:
    """Paths that may be meant, best first: as written, with other endings, as a folder's index."""
    return F.array(base, *[P.with_extension(base, e) for e in TRIED], *[F.concat(base, F.lit("/" + i)) for i in INDEXES])


def resolve(specifiers: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Files that specifiers mean: ``specifiers(file, specifier)``, ``files(file)`` -> file, specifier, target.

    A relative specifier stands below the importing file's folder. Any other names one of ``packages(name, path, entries)``
    of the workspace, the longest name counting: what follows it stands below the package, and without it the entries
    are tried in order, then the usual index files. Candidates are tried in order; without a known file there is no row.
    """
    spec = F.regexp_replace("specifier", WRITTEN, "")
    asked = specifiers.select("file", "specifier").distinct()
    near = asked.where(F.col("specifier").startswith(".")).select("file", "specifier", F.posexplode(_tries(P.normal(F.concat(T.folder_of("file"), F.when(T.folder_of("file") != "", "/").otherwise(""), spec)))).alias("rank", "try"))
    tries = near
    if packages is not None:
        far = asked.where(~F.col("specifier").startswith("."))
        heads = F.transform(F.sequence(F.lit(1), F.size(F.split("specifier", "/"))), lambda n: F.array_join(F.slice(F.split("specifier", "/"), F.lit(1), n), "/"))
        met = far.withColumn("name", F.explode(heads)).join(packages.where("path NOT IN ('', '.')").select("name", "path", "entries"), "name")
        met = met.groupBy("file", "specifier").agg(F.max_by(F.struct("name", "path", "entries"), F.length("name")).alias("p")).select("file", "specifier", "p.*")
        rest = F.regexp_replace(F.substring(F.col("specifier"), F.length("name") + 1, F.length("specifier")), "^/+", "")
        below = lambda x: P.normal(F.concat("path", F.lit("/"), F.regexp_replace(F.regexp_replace(x, r"^(?:\./)+", ""), WRITTEN, "")))
        entries = F.concat(F.coalesce("entries", F.array().cast("array<string>")), F.array(*[F.lit(f) for f in FALLBACKS]))
        every = F.when(rest != "", _tries(below(rest))).otherwise(F.flatten(F.transform(entries, lambda e: _tries(below(e)))))
        tries = near.unionByName(met.select("file", "specifier", F.posexplode(every).alias("rank", "try")))
    known = files.select(F.col("file").alias("target")).distinct()
    return tries.join(known, F.col("try") == F.col("target")).groupBy("file", "specifier").agg(F.min_by("target", "rank").alias("target"))


def imported(names: DataFrame, targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Symbols that named imports mean: ``names(file, imported, specifier)`` with ``resolve``'s targets -> file, imported, id."""
    there = names.join(targets, ["file", "specifier"]).select("file", "imported", "target")
    return there.join(nodes.select("id", F.col("name").alias("imported"), F.col("file").alias("target")), ["imported", "target"]).select("file", "imported", "id").distinct()


def reexported(stars: DataFrame, targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Public symbols of the files that stars hand on: ``stars(file, specifier)`` -> file, id."""
    public = nodes.where(T.is_public("name", "visibility")).select("id", F.col("file").alias("target"))
    return stars.join(targets, ["file", "specifier"]).join(public, "target").select("file", "id").distinct()


def import_targets(names: DataFrame, targets: DataFrame) -> DataFrame:
    """``(file, name, target)`` by a file's own names for what it imports, as the ranking of candidates takes them."""
    return names.where("what = 'import'").join(targets, ["file", "specifier"]).select("file", F.col("local").alias("name"), "target").distinct()
