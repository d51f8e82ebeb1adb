"""Path functions as columns: normal forms, modules, packages, ignore rules, generated files."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, file_stem, folder_of

#: Folders that are left out by default, as ignore patterns.
DEFAULT_IGNORES = [
    ".git/", ".idea/", ".vscode/", "target/", "**/target/", "build/", "**/build/", "dist/", "**/dist/", "out/", "**/out/", "node_modules/", "**/node_modules/",
    ".gradle/", "**/.gradle/", "vendor/", "**/vendor/", "__pycache__/", "**/__pycache__/", ".venv/", "**/.venv/", "venv/", "**/venv/",
]
#: What tells of generated files, by part of the path or by ending, with the tool where it is known.
GENERATED_PARTS = ["/__generated__/", "/.gen/", "/generated/", "/gen/"]
GENERATED_ENDINGS = [".pb.go", ".g.dart", ".generated.ts", ".generated.js", "_pb.py", ".pb.cc", ".pb.h"]
GENERATORS = [("protoc", [".pb.go", ".pb.cc", ".pb.h", "_pb.py"]), ("build_runner", [".g.dart"]), ("codegen", [".generated.ts", ".generated.js"])]
#: Fixed values of the vendored and generated file filter.
VENDORED_FOLDERS = ["node_modules", "vendor", "target", "dist", "build", "out", ".next", ".nuxt", "coverage"]
BUILT_ENDINGS = ["pb.rs", "pb.go", "pb.cc", "pb.h", "grpc.pb.go", "min.js", "min.css", "map"]
BUILT_MARKS = [".generated.", ".gen.", "_generated.", "_gen.", ".mock.", "_mock."]
BUILT_HEADS = ["do not edit", "code generated", "generated by", "auto-generated", "autogenerated", "this file is generated", "@generated"]
HEAD_EXTENSIONS = ["rs", "go", "ts", "js", "java", "kt", "py"]
#: What makes a file stand for its module.
ASIDE_FOLDERS = ["tests", "test", "__tests__", "fixtures", "testdata", "benches", "examples"]
ENTRY_FILES = ["lib.rs", "main.rs", "mod.rs", "index.ts", "index.js", "__init__.py"]


def file_name(file) -> Column:
    return F.element_at(F.split(_c(file), "/"), -1)


def normal(path) -> Column:
    """Without ``.`` and empty segments; ``..`` takes the segment before it away, and nothing where there is none."""
    parts = F.filter(F.split(_c(path), "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s)))
    return F.concat(F.when(_c(path).startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def with_extension(path, extension: str) -> Column:
    """The path with the last extension of its file name replaced, or added where it has none."""
    whole = F.when(folder_of(path) != "", F.concat(folder_of(path), F.lit("/"))).when(_c(path).startswith("/"), "/").otherwise("")
    return F.concat(whole, file_stem(path), F.lit("." + extension))


def top_segment(path) -> Column:
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("(root)")


def common_folder(low, high) -> Column:
    """The deepest folder that two paths share; of a set of paths, the one of its least and its greatest."""
    a, b = F.split(folder_of(low), "/"), F.split(folder_of(high), "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    n = F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b)))
    return F.array_join(F.slice(a, F.lit(1), n.cast("int")), "/")


def synthetic_module(file) -> Column:
    """The segment after ``crates``, else the file's folder, else root."""
    parts = F.filter(F.split(_c(file), "/"), lambda s: s != "")
    at = F.array_position(parts, "crates").cast("int")
    folder = F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 2))
    return F.coalesce(F.when(at > 0, F.get(parts, at)), folder, F.lit("root"))


def module_score(file) -> Column:
    """How well a file stands for its module: sources and entry files well, tests and examples badly."""
    parts = F.split(_c(file), "/")
    aside = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ASIDE_FOLDERS]))
    return F.when(aside, -20).otherwise(0) + F.when(F.array_contains(parts, "src"), 10).otherwise(0) + F.when(file_name(file).isin(ENTRY_FILES), 5).otherwise(0)


def package_label(file) -> Column:
    """A guess of the package by the layout of common workspaces, with its kind in brackets."""
    def found(pattern: str, kind: str) -> Column:
        name = F.regexp_extract(_c(file), pattern, 1)
        return F.when(_c(file).rlike(pattern), F.concat(name, F.lit(f" ({kind})")))

    return F.coalesce(
        found(r"^(?s:.*?)/crates/([^/]*)/", "cargo"), found(r"^(?s:.*?)/packages/([^/]*)/", "npm"), found(r"^(?=(?s:.*?)/([^/]*)/src/main/)", "gradle"),
        found(r"/([^/]*)/[^/]*\.go$", "go"), F.lit("unknown"))


def is_generated(file) -> Column:
    low = F.lower(_c(file))
    tests = [F.contains(low, F.lit(p)) for p in GENERATED_PARTS] + [low.endswith(e) for e in GENERATED_ENDINGS]
    return functools.reduce(lambda a, b: a | b, tests)


def generator(file) -> Column:
    """The tool that made a file, where its path tells; else null."""
    low = F.lower(_c(file))
    by_end = [F.when(functools.reduce(lambda a, b: a | b, [low.endswith(e) for e in ends]), name) for name, ends in GENERATORS]
    api = F.when(F.contains(low, F.lit("/__generated__/")) & F.contains(low, F.lit("openapi")), "openapi-codegen")
    built = F.when(F.contains(low, F.lit("/target/")) | F.contains(low, F.lit("/build/")), "build")
    return F.coalesce(by_end[0], api, by_end[1], by_end[2], built)


def is_built(file, content) -> Column:
    """Vendored or generated: by folder, by ending, by a mark in the name, or by the first 2048 characters of a source."""
    name = F.lower(file_name(file))
    folder = F.arrays_overlap(F.split(_c(file), "/"), F.array(*[F.lit(x) for x in VENDORED_FOLDERS]))
    marks = [name.endswith(e) for e in BUILT_ENDINGS] + [F.contains(name, F.lit(m)) for m in BUILT_MARKS]
    head = F.lower(F.substring(_c(content), 1, 2048))
    says = functools.reduce(lambda a, b: a | b, [F.contains(head, F.lit(m)) for m in BUILT_HEADS])
    source = F.regexp_extract(_c(file), r"\.([^./]+)$", 1).isin(HEAD_EXTENSIONS)
    return folder | functools.reduce(lambda a, b: a | b, marks) | (source & F.coalesce(says, F.lit(False)))


def ignore_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """An ignore line as (regex over a path without leading slash, is it a negation, does it mean folders alone); None for none."""
    line = pattern.rstrip("\n")
    line = line if line.endswith("\\ ") else line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith(("\\!", "\\#")) else line
    folders = line.endswith("/")
    line = line.rstrip("/") if folders else line
    anchored = "/" in line
    line = line.lstrip("/")
    if not line:
        return None
    out, i = [], 0
    while i < len(line):
        rest = line[i:]
        if rest.startswith("**/") and (i == 0 or line[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif rest == "**" and i and line[i - 1] == "/":
            out.append(".+")
            i += 2
        elif rest[0] == "*":
            out.append("[^/]*")
            i += len(rest) - len(rest.lstrip("*"))
        elif rest[0] == "?":
            out.append("[^/]")
            i += 1
        elif rest[0] == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("[", "\\[") + "]")
            i = end + 1
        else:
            i += rest[0] == "\\" and len(rest) > 1
            out.append(re.escape(line[i]))
            i += 1
    return ("^" if anchored else "^(?:.*/)?") + "".join(out) + "$", negated, folders


def ignored(file, patterns: list[str]) -> Column:
    """Whether ignore patterns leave a path out: for the path and then each folder above it, the last pattern that
    matches decides, and the nearest of them that any matches counts."""
    rules = [r for r in map(ignore_regex, patterns) if r]
    if not rules:
        return F.lit(False)
    parts = F.filter(F.split(_c(file), "/"), lambda s: s != "")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"), (n < F.size(parts)).alias("folder")))
    verdict = lambda x: F.coalesce(*[F.when(x["p"].rlike(regex) & (x["folder"] | F.lit(not folders)), F.lit(not negated)) for regex, negated, folders in reversed(rules)])
    return F.when(F.size(parts) > 0, F.coalesce(F.get(F.array_compact(F.transform(above, verdict)), F.lit(0)), F.lit(False))).otherwise(False)
