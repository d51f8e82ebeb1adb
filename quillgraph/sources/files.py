"""Sources and sinks: source trees, configuration and manifest files, snapshots, exports."""

from __future__ import annotations

import json
import re
import time
import tomllib
import uuid
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..model import CodeGraph

SNAPSHOT_VERSION = 1


def scan(spark: SparkSession, root: str, extensions: list[str], ignores: list[str] | None = None, relative: bool = False, built: bool = True) -> DataFrame:
    """``(file, content)`` of a tree, in order of paths; minified files and those that ignore patterns name are left out.

    Extensions count in any case. ``ignores`` (None: none at all) follow on the patterns that hold by default, paths being
    taken from the root; ``relative`` gives such paths, and without ``built`` generated and vendored files go, too.
    """
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    df = df.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    below = F.regexp_replace(F.url_decode(F.replace(F.regexp_replace("file", "^[a-z0-9]+:(//[^/]*)?(?=/)", ""), F.lit("+"), F.lit("%2B"))), "^" + re.escape(base) + "/+", "")
    rules = [] if ignores is None else [*P.DEFAULT_IGNORES, *ignores]
    df = df.withColumn("below", below).where(~P.ignored("below", rules))
    df = df if built else df.where(~P.is_built("below", "content"))
    out = df.select(F.col("below" if relative else "file").alias("file"), "content").where(~T.minified("content"))
    return out.orderBy("file")


#: Files of build tools, whose keys are no configuration that code refers to.
BUILD_FILES = [
    "Cargo.toml", "package.json", "package-lock.json", "pnpm-lock.yaml", "pnpm-workspace.yaml", "lerna.json", "tsconfig.json", "jsconfig.json", "babel.config.json", ".babelrc.json",
    ".eslintrc.json", ".eslintrc.yaml", ".eslintrc.yml", ".prettierrc.json", ".prettierrc.yaml", ".prettierrc.yml", "tslint.json", "deno.json", "pyproject.toml", "composer.json",
]
CONFIG_EXTENSIONS = ["yaml", "yml", "toml", "json", "properties"]
_ENTRY = re.compile(r"""^( *)("[^"]*"|'[^']*'|[^\s#'"\[\]{},&*!|>%@-][^#]*?|-[^\s#][^#]*?) *:(?:\s+(.*))?$""")


def _leaves(value, prefix: str = ""):
    """Dotted paths of values that aren't mappings; an empty mapping has none."""
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{prefix}.{k}" if prefix else str(k)
            if isinstance(v, dict):
                yield from _leaves(v, path)
            else:
                yield path


def _flow(text: str) -> dict | None:
    """A mapping in braces on one line, lists and scalars in it as None; None for anything else."""
    parts = re.findall(r"""[{}\[\],:]|"[^"]*"|'[^']*'|[^{}\[\],:"']+""", text)
    parts, at = [x for x in parts if x.strip()], 0

    def value():
        nonlocal at
        if at < len(parts) and parts[at] == "{":
            at += 1
            out = {}
            while at < len(parts) and parts[at] != "}":
                key = parts[at].strip().strip("'\"")
                at += 1
                if at < len(parts) and parts[at] == ":":
                    at += 1
                    out[key] = value()
                elif key and key != ",":
                    out[key] = None
            at += 1
            return out
        depth = 0
        while at < len(parts) and (depth or parts[at] not in ",}"):
            depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(parts[at], 0)
            at += 1
        return None

    return value() if text.startswith("{") else None


def _yaml_leaves(text: str):
    """Leaf keys of block mappings by indentation, of mappings in braces, and of keys with lists or texts of several lines,
    which are leaves. Anchors, tags and keys over several lines aren't read."""
    stack: list[tuple[int, str]] = []
    waiting: tuple[int, str] | None = None  # a key without a value so far: its indentation and path
    skip: int | None = None  # lines farther in than this belong to a list or to a text of several lines
    for line in text.splitlines():
        body = line.strip()
        if not body or body[0] in "#%" or body in ("---", "..."):
            continue
        deep = len(line) - len(line.lstrip(" "))
        if skip is not None and deep > skip:
            continue
        skip = None
        if body == "-" or body.startswith("- "):
            if waiting:
                yield waiting[1]
                waiting = None
            skip = deep
            continue
        m = _ENTRY.match(line)
        if not m:
            continue
        if waiting and deep <= waiting[0]:
            yield waiting[1]
        waiting = None
        key, value = m[2].strip("'\""), re.sub(r"\s+#.*$", "", m[3] or "").strip()
        value = "" if value.startswith("#") else value
        while stack and stack[-1][0] >= deep:
            stack.pop()
        path = ".".join([k for _, k in stack] + [key])
        stack.append((deep, key))
        if not value:
            waiting = (deep, path)
        elif value[0] in "|>":
            yield path
            skip = deep
        else:
            inner = _flow(value)
            yield from [path] if inner is None else _leaves(inner, path)
    if waiting:
        yield waiting[1]


def config_symbols(file: str, text: str):
    """(key, start, end) of each key of a configuration file: where the key's last segment first stands in the text, as
    UTF-8 bytes (0 where it doesn't). Files of build tools have none."""
    name = file.rpartition("/")[2]
    extension = name.rpartition(".")[2].lower()
    if extension not in CONFIG_EXTENSIONS or name in BUILD_FILES or (name.startswith("tsconfig.") and name.endswith(".json")):
        return
    raw = text.encode("utf-8", "surrogatepass")
    for key in config_keys(text, extension):
        last = key.rpartition(".")[2].encode("utf-8", "surrogatepass")
        start = max(raw.find(last), 0)
        yield key, start, start + len(last)


def config_keys(text: str, extension: str) -> list[str]:
    """Dotted leaf keys of a YAML, TOML, JSON or properties text; none if it can't be read."""
    try:
        if extension == "json":
            return list(_leaves(json.loads(text)))
        if extension == "toml":
            return list(_leaves(tomllib.loads(text)))
        if extension in ("yaml", "yml"):
            return list(_yaml_leaves(text))
        if extension == "properties":
            return [m[1] for m in re.finditer(r"^\s*([^#!\s=:][^=:\s]*)\s*[=:]", text, re.M)]
    except (ValueError, tomllib.TOMLDecodeError):
        pass
    return []


def read_config(sources: DataFrame) -> DataFrame:
    def work(batches):
        for pdf in batches:
            rows = [(f, k) for f, c in zip(pdf["file"], pdf["content"], strict=True) for k in config_keys(c or "", f.rpartition(".")[2])]
            yield pd.DataFrame(rows, columns=["file", "key"])

    return sources.select("file", "content").mapInPandas(work, "file string, key string")


MANIFESTS: dict[str, Callable[[str, str], list[tuple[str, str, str]]]] = {}


def manifest(*names: str):
    """Register a reader of manifest files by their names: (file, text) -> rows as of ``manifest_packages``."""

    def add(f):
        for n in names:
            MANIFESTS[n] = f
        return f

    return add


@manifest("package.json", "Cargo.toml", "pyproject.toml", "go.mod")
def manifest_packages(file: str, text: str) -> list[tuple[str, str, str]]:
    """(package, dependency, kind) of a Cargo, npm, Go or Python manifest; a row without dependency names the package."""
    name, out = file.rpartition("/")[2], []
    try:
        if name == "package.json":
            d = json.loads(text)
            p = d.get("name", "")
            out = [(p, "", "application" if d.get("private") else "library")] + [(p, k, s) for s in ("dependencies", "devDependencies") for k in d.get(s, {})]
        elif name == "Cargo.toml":
            d = tomllib.loads(text)
            p = d.get("package", {}).get("name", "")
            out = [(p, "", "application" if "bin" in d else "library")] + [(p, k, s) for s in ("dependencies", "dev-dependencies") for k in d.get(s, {})]
        elif name == "pyproject.toml":
            d = tomllib.loads(text).get("project", {})
            p = d.get("name", "")
            out = [(p, "", "application" if d.get("scripts") else "library")] + [(p, re.split(r"[\s<>=!~\[;]", x)[0], "dependencies") for x in d.get("dependencies", [])]
        elif name == "go.mod":
            m = re.search(r"^module\s+(\S+)", text, re.M)
            p = m[1] if m else ""
            out = [(p, "", "library")] + [(p, x, "dependencies") for x in re.findall(r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+v\S+", text, re.M)]
    except (ValueError, tomllib.TOMLDecodeError):
        pass
    return out


#: What tells of an application or a library in a Gradle script, and what declares a dependency.
GRADLE_APPLICATION = ['id("application")', "id('application')", 'apply plugin: "application"', "apply plugin: 'application'", "org.springframework.boot", "com.android.application"]
GRADLE_LIBRARY = ["java-library", "maven-publish", 'kotlin("jvm")', "kotlin('jvm')", "org.jetbrains.kotlin.jvm", 'id("java")', "id('java')", 'apply plugin: "java"', "apply plugin: 'java'"]
GRADLE_DEPENDS = ["implementation", "api", "compile", "testImplementation", "testCompile", "runtimeOnly", "compileOnly", "annotationProcessor", "kapt"]


@manifest("pom.xml")
def maven(file: str, text: str) -> list[tuple[str, str, str]]:
    """The artifact with its dependencies (group:artifact). A war or a Spring Boot build is an application, a jar a library."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return []
    tag = lambda e: e.tag.rpartition("}")[2]
    own = {tag(e): e for e in root}
    said = lambda e, name: next((c.text.strip() for c in e if tag(c) == name and c.text), "")
    name, packaging = said(root, "artifactId") or "unnamed", said(root, "packaging") or "jar"
    kind = "application" if "spring-boot-maven-plugin" in text or packaging == "war" else "library" if packaging == "jar" else "unknown"
    needs = [d for d in own.get("dependencies", []) if tag(d) == "dependency"]
    return [(name, "", kind)] + [(name, f"{said(d, 'groupId')}:{said(d, 'artifactId')}", said(d, "scope") or "dependencies") for d in needs]


@manifest("build.gradle", "build.gradle.kts")
def gradle(file: str, text: str) -> list[tuple[str, str, str]]:
    """The module by its folder, with what its configurations name; the kind by its plugins."""
    name = file.split("/")[-2] if "/" in file else "root"
    kind = "application" if any(x in text for x in GRADLE_APPLICATION) else "library" if any(x in text for x in GRADLE_LIBRARY) else "unknown"
    pattern = rf"(?m)^\s*({'|'.join(GRADLE_DEPENDS)})\s*\(?\s*[\"']([^\"']+)[\"']"
    modules = re.findall(rf"(?m)^\s*({'|'.join(GRADLE_DEPENDS)})\s*\(?\s*project\(\s*[\"']:?([^\"']+)[\"']", text)
    return [(name, "", kind)] + [(name, d.rpartition(":")[0] if d.count(":") > 1 else d, c) for c, d in [*re.findall(pattern, text), *modules]]


@manifest("vite.config.ts", "vite.config.js", "vite.config.mjs", "webpack.config.js", "webpack.config.ts")
def bundler(file: str, text: str) -> list[tuple[str, str, str]]:
    """A package for the bundler itself, named after its folder; whether it is a library can't be told."""
    folder = file.split("/")[-2] if "/" in file else "root"
    return [(f"{folder} ({file.rpartition('/')[2].partition('.')[0]})", "", "unknown")]


def read_manifests(sources: DataFrame) -> DataFrame:
    def work(batches):
        for pdf in batches:
            rows = [(f, *r) for f, c in zip(pdf["file"], pdf["content"], strict=True) for r in (MANIFESTS[f.rpartition("/")[2]](f, c or "") if f.rpartition("/")[2] in MANIFESTS else [])]
            yield pd.DataFrame(rows, columns=["file", "package", "dependency", "kind"])

    return sources.select("file", "content").mapInPandas(work, "file string, package string, dependency string, kind string")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_snapshot(graph: CodeGraph, path: str, dirty: bool = True) -> bool:
    """Write a snapshot beside ``path`` and rename it, so that a reader finds the old one or the new one whole.

    Nothing is written if the graph isn't ``dirty`` and there is a snapshot; returns whether it was.
    """
    spark = graph.nodes.sparkSession
    system, to = _folder(spark, path)
    if not dirty and system.exists(to):
        return False
    made, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    graph.nodes.write.parquet(f"{made}/nodes")
    graph.edges.write.parquet(f"{made}/edges")
    spark.createDataFrame([(SNAPSHOT_VERSION, int(time.time()))], "version int, built_at long").write.parquet(f"{made}/meta")
    if system.exists(to):
        system.rename(to, _folder(spark, old)[1])
    if not system.rename(_folder(spark, made)[1], to):
        raise OSError(f"{made} can't be renamed to {path}")
    system.delete(_folder(spark, old)[1], True)
    return True


def read_snapshot(spark: SparkSession, path: str, accept: Callable[[int], bool] = lambda built_at: True) -> CodeGraph | None:
    """A snapshot of this version; None if ``accept`` doesn't take the second at which it was built."""
    version, built_at = spark.read.parquet(f"{path}/meta").select("version", "built_at").first()
    if version != SNAPSHOT_VERSION:
        raise ValueError(f"snapshot version {version}, not {SNAPSHOT_VERSION}")
    if not accept(built_at):
        return None
    return CodeGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def newer_sources(spark: SparkSession, root: str, extensions: list[str], built_at: int) -> bool:
    """Whether a source changed after a snapshot was built."""
    glob = "*.{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("modificationTime")
    return not files.where(F.unix_timestamp("modificationTime") > built_at).isEmpty()


def json_graph(graph: CodeGraph, kept: DataFrame | None = None, least: float = 0.0, without: list[str] | None = None) -> DataFrame:
    """Lines of a JSON graph: a meta line with the whole graph's totals, then nodes and edges.

    Edges below ``least``, of the kinds in ``without``, or that leave ``kept(id)`` are left out, as are nodes outside of it.
    """
    n, e = graph.nodes, _sure(graph.edges, least).where(~F.col("kind").isin(without or []))
    if kept is not None:
        n = n.join(kept.select("id"), "id", "left_semi")
        for end in ("from_id", "to_id"):
            e = e.join(kept.select(F.col("id").alias(end)), end, "left_semi")
    totals = graph.nodes.agg(F.count("*").alias("nodes")).join(graph.edges.agg(F.count("*").alias("edges")))  # one row each
    line = lambda kind, *columns: F.to_json(F.struct(F.lit(kind).alias("type"), *columns)).alias("line")
    edge = ["from_id", "to_id", "kind", "origin", F.round(F.col("confidence").cast("double"), 3).alias("confidence")]
    return totals.select(line("meta", "nodes", "edges")).union(n.select(line("node", "id", "kind", "name", "file"))).union(e.select(line("edge", *edge)))


def dot_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.format_string('  n%d [label="%s"];', "id", T.quoted("name")).alias("line"))


def cypher_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.format_string('CREATE (n%d:%s {id: %d, name: "%s"});', "id", "kind", "id", T.quoted("name")).alias("line"))


def batch_names(spark: SparkSession, path: str) -> DataFrame:
    """``(name)`` of a JSON file that holds an array of names."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias("name")).where("name IS NOT NULL")


def _sure(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.col("confidence") >= F.lit(least).cast("float"))


def dot_edges(edges: DataFrame, least: float = 0.0) -> DataFrame:
    return _sure(edges, least).select(F.format_string('  n%d -> n%d [label="%s"];', "from_id", "to_id", T.quoted("kind")).alias("line"))


def cypher_edges(edges: DataFrame, least: float = 0.0) -> DataFrame:
    text = "MATCH (a {id: %d}), (b {id: %d}) CREATE (a)-[:%s {confidence: %.3f}]->(b);"
    return _sure(edges, least).select(F.format_string(text, "from_id", "to_id", "kind", F.col("confidence").cast("double")).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
