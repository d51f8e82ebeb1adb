"""Sources, extractors, the build from texts, hooks, and changes on small inputs."""

import json
import re
import subprocess

import pytest

from quillgraph import hooks
from quillgraph.functions import paths as P
from quillgraph.functions import spans
from quillgraph.functions import text as T
from quillgraph.model import CodeGraph
from quillgraph.operators import advice, analysis, build, drift, filters, imports, linking, mediators, pages, traverse
from quillgraph.sources import extract, files, git
from quillgraph.streaming import changes, incremental

from .test_engine import make, seeds

SOURCES = {
    "a.kt": 'package x\nimport a.b.Repo\n/** Doc of Svc */\nclass Svc(val repo: Repo) : Base() {\n  private fun load(x: Int): List<Item> {\n    return repo.find(x) // class Ghost\n  }\n  enum class Color { RED, GREEN(2); fun f() {} }\n}\ninterface Api { fun go() }\nobject Holder\nfun top(s: String) = s.length\n',
    "B.java": 'package p;\nimport java.util.List;\n/** A doc. */\npublic class B extends Base implements Api {\n  private final Repo repo;\n  @Value("${app.port:80}") int port;\n  public B(Repo r) { this.repo = r; }\n  @Test\n  public void runs(int a) throws Exception { repo.find(a); new Item(); }\n  enum State { ON, OFF }\n}\n',
    "c.ts": 'import { x } from "./x";\n/** Does it. @param a first @param gone */\nexport function run(a: Foo): Bar { return call(a); }\nexport const go = (b: string) => run(b);\nexport class K extends L implements Mix {\n  public act(z: number): void { this.go(`class Q {}`); }\n}\nexport enum E { A = 1, B }\nconst url = "/api/v1/users";\nconst p = process.env.APP_PORT;\n',
    "d.go": "package d\n// Run runs it.\nfunc Run(ctx Context) error { return helper(ctx) }\nfunc (s *Server) Close() {}\ntype Server struct { A int }\nvar wired = wire.Build(NewA)\n",
    "e.rs": '/// Docs.\npub fn open(p: &Path) -> Result<File> { inner(p) }\nstruct S { a: i32 }\nimpl Drop for S {\n    fn drop(&mut self) { let x = "fn ghost()"; }\n}\npub enum Kind { A, B(u8), C { x: i32 } }\nmod tests {\n    #[test]\n    fn works() { open(x); std::env::var("APP_HOME"); }\n}\n',
    "f.py": 'import os\nclass A(Base):\n    """Doc é.\n\n    :param int m: no\n    """\n    def m(self, size):\n        """:param siz: s"""\n        return os.getenv("APP_X") + call("/api/é/v1")\n',
    "g.md": "# One\ntext `run` and ``a ` b``\n````\n# not\n```\n````\n## Two ##\n`bar`\n####### seven\n",
}


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([*SOURCES.items(), ("bad.py", "def ("), ("n.rs", None), ("x.txt", "fn x() {}")], "file string, content string")


def test_symbols_of_each_language():
    found = {f: extract.EXTRACTORS[f.rpartition(".")[2]](c) for f, c in SOURCES.items()}
    names = {f: {(k, n) for k, n, *_ in x.symbols} for f, x in found.items()}
    assert names["a.kt"] == {("Class", "Svc"), ("Method", "load"), ("Class", "Color"), ("EnumVariant", "Color.RED"), ("EnumVariant", "Color.GREEN"), ("Interface", "Api"), ("Module", "Holder"), ("Function", "top")}
    assert names["B.java"] >= {("Class", "B"), ("Field", "repo"), ("Method", "runs"), ("Enum", "State"), ("EnumVariant", "ON"), ("EnumVariant", "OFF")}
    assert names["c.ts"] == {("Function", "run"), ("Function", "go"), ("Class", "K"), ("Method", "act"), ("Enum", "E"), ("EnumVariant", "E.A"), ("EnumVariant", "E.B"), ("Constant", "url"), ("Constant", "p")}
    assert names["d.go"] == {("Function", "Run"), ("Method", "Close"), ("Struct", "Server"), ("Variable", "wired")}
    assert names["e.rs"] == {("Function", "open"), ("Struct", "S"), ("Method", "drop"), ("Enum", "Kind"), ("EnumVariant", "Kind::A"), ("EnumVariant", "Kind::B"), ("EnumVariant", "Kind::C"), ("Module", "tests"), ("Function", "works")}
    assert names["g.md"] == {("DocSection", "One"), ("DocSection", "Two")}
    tests = {n for x in found.values() for _, n, _, _, _, t in x.symbols if t}
    assert tests == {"runs", "works"}
    for f, x in found.items():
        raw = SOURCES[f].encode()
        for _, n, s, e, *_ in x.symbols:
            local = re.split(r"\.|::", n)[-1]
            assert local.encode() in raw[s:e], (f, n)
        for s, e, ds, de in x.docs:
            assert de <= s or s <= ds < de <= e
    assert raw and [n for _, n, *_ in extract.literals(SOURCES["c.ts"], "ts")] == ["api_path::/api/v1/users", "env_ref::app.port"]
    assert [n for _, n, *_ in extract.literals(SOURCES["B.java"], "java")] == ["config_ref::app.port"]
    assert {("Call", "find"), ("Extends", "Base"), ("Implements", "Api")} <= {(k, n) for k, n, _ in found["B.java"].refs}


def test_code_spans_and_fences():
    assert list(extract.code_spans("`a` ``b ` c`` `open")) == ["a", "b ` c"]
    assert extract.markdown_file("~~~\n# no\n~~~~\n# Yes #\n#no\n").symbols[0][1] == "Yes"


def test_build_from_texts(spark, sources):
    g = build.build(sources)
    nodes = {r.id: r for r in g.nodes.collect()}
    assert len(nodes) == g.nodes.count() and min(nodes) == 1
    got = {(nodes[e.from_id].name, e.kind, nodes[e.to_id].name) for e in g.edges.collect()}
    assert {("c.ts", "Contains", "run"), ("run", "BelongsTo", "root"), ("doc::run", "Documents", "run"), ("run", "DescribedIn", "docsection::One"), ("go", "Calls", "run"), ("works", "Calls", "open")} <= got
    assert {("B", "Implements", "Api"), ("K", "Implements", "Mix")} <= got and {n.kind for n in nodes.values() if n.name == "Mix"} == {"ExternalPackage"}
    assert not any(k == "Imports" for _, k, _ in got)  # imports before the first symbol have nothing that they come from
    assert all(e.confidence is not None for e in g.edges.collect())
    assert g.edges.count() == g.edges.select("from_id", "to_id", "kind").distinct().count()
    first = [(r.file, r.span_start) for r in sorted(nodes.values(), key=lambda r: r.id) if r.kind not in ("File", "Module", "DocComment", "DocSection", "ExternalPackage")]
    assert first == sorted(first)
    drifted = {(r.symbol, r.parameter, tuple(r.candidates)) for r in drift.parameter_drift(g.nodes, g.edges, sources).collect()}
    assert drifted == {("run", "gone", ()), ("m", "siz", ("size",))}
    assert build.build(sources.limit(0)).nodes.count() == 0


def test_imports_resolve_in_order(spark):
    rows = [("a/b.ts", 'import d, { One as Two, type T } from "./c.js";\nexport * from "../lib";\nimport { z } from "@p/ui/sub";'), ("a/c.ts", ""), ("a/c.tsx", ""), ("lib/index.ts", ""), ("pk/ui/sub.ts", ""), ("pk/ui-icons/sub.ts", "")]
    src = spark.createDataFrame(rows, "file string, content string")
    names = imports.bindings(src)
    assert {(r.imported, r.local, r.what) for r in names.collect()} == {("One", "Two", "import"), ("T", "T", "import"), ("*", "*", "export"), ("z", "z", "import")}
    packages = spark.createDataFrame([("@p/ui", "pk/ui", None), ("@p/ui-icons", "pk/ui-icons", None)], "name string, path string, entries array<string>")
    got = {(r.specifier, r.target) for r in imports.resolve(names, src.select("file"), packages).collect()}
    assert got == {("./c.js", "a/c.ts"), ("../lib", "lib/index.ts"), ("@p/ui/sub", "pk/ui/sub.ts")}


def test_candidates_by_each_rule(spark):
    defs = spark.createDataFrame([(1, "f", "a.rs", ""), (2, "f", "x/b.rs", ""), (3, "g", "m.rs", "q.g"), (4, "g", "n/m.rs", ""), (5, "h", "p/a.rs", ""), (6, "h", "q/a.rs", ""), (7, "k", "p/a.rs", "")], "id long, name string, file string, qualified_name string")
    refs = spark.createDataFrame([(10, "f", "z.rs"), (11, "g", "w/w.rs"), (12, "h", "w/w.rs"), (13, "k", "w/w.rs"), (14, "h", "p/a.rs")], "ref_id long, name string, file string")
    named = spark.createDataFrame([("w/w.rs", "h", "q/a.rs")], "file string, name string, target string")
    got = {r.ref_id: (r.id, r.rule) for r in linking.candidates(refs, defs, named).collect()}
    assert got == {10: (1, "same_dir"), 11: (3, "qualified"), 12: (6, "import"), 13: (7, "only"), 14: (5, "same_file")}


def test_text_rules(spark):
    d = spark.createDataFrame([("src/crates/x.rs",), ("a/src/crates/b/c.rs",), ("crates/q/src/x.rs",), ("x.tar.gz",), ("a_tests.rs",), ("test/x.c",), ("test_x.pyi",), ("XTest.kt",), ("a/x_test.py",), ("Y.KTS",), ("c.yml",)], "f string")
    got = {r.f: (r.m, r.t, r.l) for r in d.select("f", T.module_of("f").alias("m"), T.is_test_path("f").alias("t"), T.language("f").alias("l")).collect()}
    assert {f: x[0] for f, x in got.items() if f.count("/") > 1 or f == "x.tar.gz"} == {"src/crates/x.rs": "x.rs", "a/src/crates/b/c.rs": "a", "crates/q/src/x.rs": "q", "x.tar.gz": "x.tar"}
    assert {f for f, x in got.items() if x[1]} == {"a_tests.rs", "test/x.c", "test_x.pyi"}
    assert got["Y.KTS"][2] == "kotlin" and got["c.yml"][2] == "config" and got["x.tar.gz"][2] == "unknown"
    words = spark.createDataFrame([("self widget path größe x1 12345 élan widget",)], "c string").select(T.tokens("c").alias("t")).first().t
    assert words == ["12345", "größe", "widget", "élan"]


def test_fuzzy_ranks(spark):
    n = spark.createDataFrame([(1, "xxUser"), (2, "aUserServiceRegistry"), (3, "user"), (4, "UserX"), (5, "other"), (6, "uzer")], "id long, name string")
    assert [r.id for r in linking.fuzzy(n, "USER").collect()] == [3, 4, 1, 2]
    assert [r.id for r in linking.fuzzy(n.where("id > 4"), "usér").collect()] == []
    assert [r.id for r in linking.fuzzy(n.where("id > 4"), "usher").collect()] == [6, 5]


def test_risk_parts(spark):
    g = make(spark, [(1, 2, "Calls", 0)], {2: "_hidden"})
    assert {r.radius for r in analysis.risk(g, seeds(spark, 2)).collect()} == {"low"}
    rows = [("Class", "A", "Unknown", 1.0), ("Class", "_A", "Unknown", 0.4), ("Function", "x::impl#1", "Unknown", 0.4), ("Function", "f", "Unknown", 0.75), ("Function", "_f", "Public", 1.0)]
    d = spark.createDataFrame(rows, "node_kind string, name string, visibility string, want double")
    assert d.where(analysis.visibility_score() != d.want).count() == 0


def test_near_paths_by_brute_force(spark):
    import itertools
    import random

    rng = random.Random(2)
    rows = sorted({"/" + "/".join("".join(rng.choices("abcé", k=rng.randint(1, 4))) for _ in range(rng.randint(2, 3))) for _ in range(250)})

    def distance(a, b):
        p, q = a.encode(), b.encode()
        row = list(range(len(q) + 1))
        for i, c in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(q, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    want = {(a, b, d) for a, b in itertools.combinations(rows, 2) if abs(len(a.encode()) - len(b.encode())) * 5 <= max(len(a.encode()), len(b.encode())) and 1 <= (d := distance(a, b)) <= 2}
    got = {tuple(r) for r in analysis.near_paths(spark.createDataFrame([(p, f"f{i}") for i, p in enumerate(rows)], "path string, file string")).collect()}
    assert got == want and len(want) > 20


def test_long_paths_and_batches(spark):
    g = make(spark, [(i, i + 1, "Calls", 0) for i in range(14)], {20: "dup", 21: "dup"})
    pairs = spark.createDataFrame([(0, 14), (3, 3), (0, 20)], "a long, b long")
    got = {(r.a, r.b): (r.hops, r.path) for r in traverse.shortest_path(g.edges, pairs).collect()}
    assert got == {(0, 14): (14, list(range(15))), (3, 3): (0, [3]), (0, 20): (None, None)}
    assert {(r.a, r.b): r.hops for r in traverse.shortest_path(g.edges, pairs, 3).collect()}[0, 14] is None
    names = spark.createDataFrame([("dup",), ("f3",), ("none",)], "name string")
    out = {r.name: (r.seeds, r.seeds_used, r.truncated, r.nodes) for r in traverse.batch_impact(g, names, 3, most_seeds=1).collect()}
    assert out == {"dup": (2, 1, True, 0), "f3": (1, 1, False, 3), "none": (None, None, None, None)}
    with pytest.raises(ValueError):
        traverse.batch_impact(g, names, most_names=2)


def test_ignore_patterns(spark):
    cases = [
        ("a/node_modules/x.js", ["node_modules/"], True), ("node_modules", ["node_modules/"], False), ("src/gen/x.rs", ["src/gen"], True), ("y/src/gen/x.rs", ["src/gen"], False),
        ("y/src/gen/x.rs", ["**/src/gen"], True), ("a/b.min.js", ["*.min.js"], True), ("a/b.min.js", ["*.min.js", "!a/b.min.js"], False), ("t/fix/a/b.rs", ["t/fix/", "!t/fix/a/b.rs"], False),
        ("a/x/c", ["a/**/c"], True), ("a/c", ["a/**/c"], True), ("abc", ["a?c"], True), ("a/c", ["a?c"], False), ("f1", ["f[0-3]"], True), ("f9", ["f[!0-3]"], True), ("#x", ["#x"], False), ("#x", ["\\#x"], True), ("d/e", ["d/**"], True),
    ]
    for file, patterns, want in cases:
        d = spark.createDataFrame([(file,)], "file string")
        assert d.select(P.ignored("file", patterns).alias("i")).first().i == want, (file, patterns)


def test_lines_and_columns(spark):
    text = "é\n😀x\n"
    d = spark.createDataFrame([(text, i) for i in range(len(text.encode()) + 3)], "c string, o int")
    got = [(r.p.line, r.p.col) for r in d.orderBy("o").select(spans.line_column("c", "o").alias("p")).collect()]
    want = []
    raw = text.encode()
    for o in range(len(raw) + 3):
        o = min(o, len(raw))
        while o < len(raw) and o and raw[o] & 0xC0 == 0x80:
            o -= 1
        before = raw[:o].decode()
        want.append((before.count("\n"), len(before.rpartition("\n")[2].encode("utf-16-le")) // 2))
    assert got == want
    lines = spark.createDataFrame([(text, i) for i in range(5)], "c string, l int").orderBy("l").select(spans.line_offset("c", "l").alias("o")).collect()
    assert [r.o for r in lines] == [0, 3, 9, None, None]


def test_scan_and_snapshot(spark, tmp_path):
    root = tmp_path / "w"
    for f in ("a b+c.RS", "src/b.rs", "target/c.rs", "gen/d.rs", "src/e.pb.rs", "x.py"):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text("fn x() {}")
    got = [r.file for r in files.scan(spark, str(root), ["rs"], ["gen/"], relative=True, built=False).collect()]
    assert got == ["a b+c.RS", "src/b.rs"]
    g = make(spark, [(1, 2, "Calls", 0)])
    path = str(tmp_path / "snap")
    assert files.write_snapshot(g, path) and not files.write_snapshot(g, path, dirty=False) and files.write_snapshot(g, path)
    assert files.read_snapshot(spark, path).edges.count() == 1 and files.read_snapshot(spark, path, lambda t: t > 2**40) is None
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("snap")] == ["snap"]
    assert not files.newer_sources(spark, str(root), ["rs"], 2**40) and files.newer_sources(spark, str(root), ["rs"], 0)
    (tmp_path / "q.json").write_text('["a", "b", null]')
    assert {r.name for r in files.batch_names(spark, str(tmp_path / "q.json")).collect()} == {"a", "b"}


def test_manifests(spark):
    pom = "<project xmlns='m'><artifactId>app</artifactId><packaging>war</packaging><dependencies><dependency><groupId>g</groupId><artifactId>d</artifactId><scope>test</scope></dependency></dependencies></project>"
    gradle = "plugins { id(\"java-library\") }\ndependencies {\n  implementation(\"g:d:1\")\n  api project(':core')\n}\n"
    rows = [("m/pom.xml", pom), ("lib/build.gradle.kts", gradle), ("web/vite.config.ts", ""), ("pom.xml", "<bad"), ("z/package.json", '{"name": "z", "dependencies": {"y": "1"}}'), ("readme", "x")]
    got = {(r.file, r.package, r.dependency, r.kind) for r in files.read_manifests(spark.createDataFrame(rows, "file string, content string")).collect()}
    assert got == {("m/pom.xml", "app", "", "application"), ("m/pom.xml", "app", "g:d", "test"), ("lib/build.gradle.kts", "lib", "", "library"), ("lib/build.gradle.kts", "lib", "g:d", "implementation"),
                   ("lib/build.gradle.kts", "lib", "core", "api"), ("web/vite.config.ts", "web (vite)", "", "unknown"), ("z/package.json", "z", "", "library"), ("z/package.json", "z", "y", "dependencies")}


def test_git(spark, tmp_path):
    def run(*a):
        subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=n@x", *a], cwd=tmp_path, check=True, capture_output=True)

    assert git.changed_files(spark, str(tmp_path), "HEAD").count() == 0
    run("init", "-q")
    for i, name in enumerate(["a.rs", "b c.rs"]):
        (tmp_path / name).write_text("x\n")
        run("add", "-A")
        run("commit", "-qm", str(i))
    (tmp_path / "a.rs").write_text("y\nz\n")
    assert [r.file for r in git.changed_files(spark, str(tmp_path), "HEAD~1").collect()] == ["a.rs", "b c.rs"]
    assert [r.file for r in git.changed_files(spark, str(tmp_path), "HEAD~1", "HEAD~0").collect()] == ["b c.rs"]
    assert git.changed_files(spark, str(tmp_path), "nowhere").count() == 0
    shares = git.ownership(git.blame(spark, str(tmp_path), ["a.rs", "none"])).collect()
    assert {(r.file, r.author) for r in shares} >= {("a.rs", "<not.committed.yet>")} or shares[0].share == 1.0
    assert not git.operation_in_progress(str(tmp_path))
    (tmp_path / ".git" / "MERGE_HEAD").write_text("")
    assert git.operation_in_progress(str(tmp_path))


def test_hooks_and_settings(spark):
    seen, h = [], hooks.Hooks()
    h.register("b", "pre", lambda root: seen.append(("b", root)))
    h.register("a", "pre", lambda root: seen.append(("a", root)))
    h.register("z", "post", hooks.not_empty)
    g = make(spark, [(1, 2, "Calls", 0)])
    assert h.around("r", lambda root: g) is g and seen == [("a", "r"), ("b", "r")] and h.names("post") == ["z"]
    with pytest.raises(RuntimeError, match="post hook z"):
        h.fire("post", CodeGraph(g.nodes.limit(0), g.edges))
    assert h.unregister("z") and not h.unregister("z")
    assert hooks.settings("[query]\ndepth = 2\nmin_confidence = 1\n[index]\nexclude = ['x']")["query"]["depth"] == 2
    for bad in ("[what]\nx = 1", "[query]\nwhat = 1", "[query]\ndepth = 'x'", "[query]\ndepth = true"):
        with pytest.raises(ValueError):
            hooks.settings(bad)


def test_query_verb(spark):
    g = make(spark, [(1, 2, "Calls", 0), (2, 3, "Imports", 0), (4, 2, "Mentions", 0)] + [(i, 2, "Calls", 0) for i in range(10, 16)], {2: "hub"})
    shown = pages.query(g, "hub", pages.Options(page_size=5))
    assert shown["centers"] == [2] and shown["total"] == 9 and shown["trust"] == "Verified"
    assert pages.read_cursor(shown["next"]) == ("hub", 2, 5)
    lines = list(pages.rendered(shown, g.nodes))
    assert lines[0].startswith("hub: 1 definitions") and lines[1] == "-> 1 Imports hub f3 0.81" and len(lines) == 7
    assert json.loads(next(pages.rendered(shown, g.nodes, "json")))["total"] == 9
    assert list(pages.rendered(shown, g.nodes, "llm", 90))[-1] == "truncated"
    assert pages.query(g, "hub", edge_kinds=["imports"], direction="outgoing")["total"] == 1
    assert pages.preset("fast").depth == 1 and pages.preset("fast", pages.Options(depth=7)).depth == 7 and pages.preset("full").include_stale
    assert pages.zones(8000) == {"header": 140, "hop1": 1680, "hop_rest": 2450, "warnings": 350}
    assert pages.within_zones(shown["edges"], 300).count() == 2
    with pytest.raises(ValueError):
        pages.read_cursor("nothing")
    with pytest.raises(ValueError):
        filters.of_kinds(g.nodes, ["planet"])


def test_mediators_are_all_registered(spark):
    rows = [(1, "Field", "userService", "A.java", 0), (2, "Class", "UserService", "B.java", 0), (3, "Variable", "svc", "A.java", 0)]
    assert set(mediators.MEDIATORS) == {"spring-config", "spring-di", "routes", "compose", "go-di"}
    got = mediators.mediated(spark.createDataFrame(rows, "id long, kind string, name string, file string, span_start long")).collect()
    assert {(r.from_id, r.to_id) for r in got} == {(1, 2)}


def test_reindex_and_rich_diff(spark):
    g = make(spark, [(1, 2, "Calls", 0), (3, 2, "Calls", 1), (2, 3, "Calls", 0)])
    e = g.edges.withColumn("evidence_file", linking.F.concat(linking.F.lit("crates/m"), "from_id", linking.F.lit("/src/a.rs")))
    g = CodeGraph(g.nodes, e)
    file = spark.createDataFrame([("crates/m2/src/a.rs",)], "file string")
    out = incremental.reindex(g, file, CodeGraph(g.nodes.where("id = 2"), e.where("false")))
    new = {r.name: r.id for r in out.nodes.collect()}
    assert {(r.from_id, r.to_id, r.stale_evidence_count) for r in out.edges.collect()} == {(1, new["f2"], 1), (3, new["f2"], 2)} and new["f2"] > 3
    found = advice.rich_diff(g, file, spark.createDataFrame([("crates/m2/src/a.rs", "x\ny")], "file string, content string")).first()
    assert found.reached == 2 and found.seeds == ["f2"] and [t.id for t in found.top] == [1, 3] and found.lines[0].line == 0


def test_changes_with_removals(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    schema = "path string, content string"

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        q = changes.watch(spark, str(folder), schema, str(tmp_path / "state"), lambda df, n: seen.append({(r.path, r.change) for r in df.collect()}), str(tmp_path / "check"))
        q.awaitTermination()

    put([("a", "1"), ("b", "1")])
    put([("a", "2"), ("b", "1"), ("c", "1")])
    put([("a", None), ("z", None)])
    assert seen == [{("a", "added"), ("b", "added")}, {("a", "changed"), ("c", "added")}, {("a", "removed")}]
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["1", "2"]
    assert [r.path for r in spark.read.parquet(str(tmp_path / "state" / "2")).orderBy("path").collect()] == ["b", "c"]


def test_subsequence_search(spark):
    def score(q, t):
        same = lambda a, b: a == b or (a in "_/.:- " and b in "_/.:- ")
        low, q = t.lower(), q.lower()
        begins = lambda i: i == 0 or low[i - 1] in "_/.:-" or (len(low) == len(t) and "A" <= t[i] <= "Z" and "a" <= t[i - 1] <= "z")
        for i in range(len(low) - len(q) + 1):
            if all(same(a, b) for a, b in zip(q, low[i:], strict=False)):
                return 100 + 4 * len(q) - i * 0.5 + (20 if i == 0 else 10 if begins(i) else 0) + (30 if len(low) == len(q) else 0)
        s, ti, prev = 0.0, 0, -2
        for c in q:
            i = next((j for j in range(ti, len(low)) if same(c, low[j])), None)
            if i is None:
                return None
            s += (4 if i == prev + 1 else -min(i - ti, 12) * 0.25) + (3 if begins(i) else 0)
            prev, ti = i, i + 1
        return s

    texts = ["userService", "user_service", "UserService", "src/user.service.ts", "aUser", "unrelated", "us", "u-s-e-r", "xuxsxexr" * 3, "", "Straße user"]
    for q in ("user", "us", "uS", "user service", "usv", "zz"):
        d = spark.createDataFrame([(t,) for t in texts], "t string")
        got = {r.t: r.s for r in d.select("t", T.subsequence_score(q, "t").alias("s")).collect()}
        assert got == {t: pytest.approx(score(q, t)) if score(q, t) is not None else None for t in texts}, q
    nodes = spark.createDataFrame([(1, "x", "src/user.rs", 0), (2, "User", "a", 3), (3, "other", "b", 99)], "id long, name string, file string, degree long")
    assert [r.id for r in T.search(nodes, " user ").collect()] == [2, 1]


def test_configuration_keys():
    yaml = "# c\nserver:\n  port: 80 # x\n  \"a b\": {c: 1, d: {e: [1, 2], f: 'x'}}\n  hosts:\n    - name: n\n      x: 1\n  text: |\n    not: key\n  empty:\nlist:\n- a: 1\n- b\nurl: http://x:80/y\n---\nlast:\n"
    assert files.config_keys(yaml, "yml") == ["server.port", "server.a b.c", "server.a b.d.e", "server.a b.d.f", "server.hosts", "server.text", "server.empty", "list", "url", "last"]
    assert files.config_keys('{"a": {"b": [1], "c": {}}, "d": null}', "json") == ["a.b", "d"]
    assert files.config_keys("x = 1\n[t.u]\ny = [1]\n", "toml") == ["x", "t.u.y"]
    assert list(files.config_symbols("é/app.toml", "# é port\n[server]\nport = 1\n")) == [("server.port", 5, 9)]
    assert not list(files.config_symbols("w/tsconfig.build.json", '{"a": 1}')) and not list(files.config_symbols("package.json", '{"a": 1}')) and not list(files.config_symbols("b.json", "{bad"))


def test_verbs(spark, sources):
    from quillgraph import verbs

    e = verbs.Engine.index(sources)
    assert e.query("run", "full")["total"] > 0 and next(e.show("run")).startswith("run: ")
    assert e.stats().first().symbols == e.graph.nodes.count()
    assert {r.name for r in e.definitions("open").collect()} == {"open"} and e.symbols("RUN").first().name == "run"
    assert e.impact("run").count() == 1 and e.risk("run").first().callers == 1
    assert {r.parameter for r in e.drift().collect()} == {"gone", "siz"}
    assert {r.name: r.definitions for r in e.batch(spark.createDataFrame([("run",), ("none",)], "name string")).collect()} == {"run": 1, "none": None}
    totals = e.diff_totals(spark.createDataFrame([("c.ts",)], "file string")).first()
    assert totals.reached >= 1 and totals.orphans >= 0
    assert e.export("dot", 0.0).count() == e.graph.nodes.count() + e.graph.edges.count() and e.export("json", 0.0).count() == e.export("cypher", 0.0).count() + 1
    assert e.orphans().count() >= verbs.Engine(e.graph, ignored=["*.rs"]).orphans().count()
    assert e.search("svc").first().name == "Svc" and set(e.recommend()) == {"cap", "noise", "generated"}
    assert {"query", "impact", "diff", "index"} <= set(verbs.VERBS)
    with pytest.raises(ValueError):
        verbs.Engine(e.graph).drift()
