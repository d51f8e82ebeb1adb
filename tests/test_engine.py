"""The graph engine on hand-built graphs and source texts."""

import pytest

from quillgraph.functions import text as T
from quillgraph.model import CodeGraph, current_confidence, stored_confidence
from quillgraph.operators import analysis, linking, traverse
from quillgraph.sources import files
from quillgraph.streaming import changes


def make(spark, edges, names=None):
    ids = sorted({i for e in edges for i in e[:2]} | set(names or {}))
    nodes = spark.createDataFrame(
        [(i, "Function", (names or {}).get(i, f"f{i}"), f"f{i}", f"crates/m{i}/src/a.rs", 0, 9, "Verified", "Unknown", False) for i in ids],
        "id long, kind string, name string, qualified_name string, file string, span_start long, span_end long, status string, visibility string, is_test boolean")
    rows = [(a, b, k, "NameResolved", "", 0, s) for a, b, k, s in edges]
    e = spark.createDataFrame(rows, "from_id long, to_id long, kind string, origin string, evidence_file string, created_at_epoch long, stale_evidence_count int")
    return CodeGraph(nodes, e.withColumn("confidence", stored_confidence()))


def seeds(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "seed long, id long")


def test_impact_follows_incoming_edges(spark):
    g = make(spark, [(1, 2, "Calls", 0), (2, 3, "Calls", 0), (4, 3, "Mentions", 0), (3, 1, "Calls", 0)])
    got = {(r.id, r.depth) for r in traverse.impact_cone(g, seeds(spark, 3), 5).collect()}
    assert got == {(2, 1), (1, 2)}
    assert traverse.impact_tree(g, seeds(spark, 3), 5).count() == 2


def test_shortest_paths(spark):
    g = make(spark, [(0, 1, "Calls", 0), (1, 2, "Calls", 0), (3, 0, "Imports", 0)], {4: "dup", 5: "dup"})
    pairs = spark.createDataFrame([(3, 2), (2, 3), (1, 1), (0, 4)], "a long, b long")
    got = {(r.a, r.b): r.path for r in traverse.shortest_path(g.edges, pairs).collect()}
    assert got == {(3, 2): [3, 0, 1, 2], (2, 3): [2, 1, 0, 3], (1, 1): [1], (0, 4): None}
    calls = traverse.shortest_path(g.edges.where("kind = 'Calls'"), pairs.limit(1)).first()
    assert calls.path is None


def test_risk_takes_best_product(spark):
    g = make(spark, [(1, 2, "Calls", 5), (1, 3, "Calls", 0), (3, 2, "Calls", 0)])
    got = {r.id: (round(r.conf, 6), r.dist) for r in traverse.risk_cone(g, seeds(spark, 2), 3).collect()}
    assert got == {3: (0.95, 1), 1: (round(0.95**2, 6), 2)}
    assert g.edges.select(current_confidence().alias("c")).agg({"c": "max"}).first()[0] == 0.95


def test_stored_confidence_is_single_precision(spark):
    assert make(spark, [(1, 2, "Calls", 0)]).edges.first().confidence == pytest.approx(0.8549999594688416, abs=1e-12)


def test_orphans(spark):
    g = make(spark, [(1, 2, "Contains", 0), (3, 4, "Mentions", 0)], {1: "divide", 2: "_x"})
    assert {(r.id, r.bucket) for r in analysis.orphans(g).collect()} == {(1, "library_api"), (2, "likely_dead")}


def test_near_paths(spark):
    rows = [("/api/v1/user", "a"), ("/api/v1/users", "b"), ("/api/v1/card", "a"), ("/api/v2/card", "c"), ("/x", "a"), ("/y", "b")]
    got = {(r.path, r.other, r.distance) for r in analysis.near_paths(spark.createDataFrame(rows, "path string, file string")).collect()}
    assert got == {("/api/v1/user", "/api/v1/users", 1)}


def test_enclosing(spark):
    nodes = spark.createDataFrame([(1, "f", 0, 100), (2, "f", 10, 20), (3, "f", 300, 310)], "id long, file string, span_start long, span_end long")
    refs = spark.createDataFrame([(1, "f", 15), (2, "f", 20), (3, "f", 200), (4, "f", 305), (5, "g", 1)], "ref_id long, file string, offset long")
    got = {r.ref_id: (r.id, r.contained) for r in linking.enclosing(refs, nodes, 16).collect()}
    assert got == {1: (2, True), 2: (2, True), 3: (2, False), 4: (3, True), 5: (None, False)}


def test_injections(spark):
    fields = spark.createDataFrame([(1, "userService", "a"), (2, "svc", "a")], "id long, name string, file string")
    classes = spark.createDataFrame([(7, "UserService", "b"), (8, "BaseUserService", "b"), (9, "UserService", "a")], "id long, name string, file string")
    assert {tuple(r) for r in linking.injections(fields, classes).collect()} == {(1, 7), (1, 8)}


def test_byte_distance(spark):
    d = spark.createDataFrame([("é", "e"), ("abc", "abd"), (None, "x")], "a string, b string")
    assert [r[0] for r in d.select(T.byte_levenshtein("a", "b")).collect()] == [2, 1, None]


def test_config_and_manifests(spark, tmp_path):
    assert files.config_keys("a:\n  b: 1\n  c:\n    d: x\n# e: 1\nf: 2\n", "yaml") == ["a.b", "a.c.d", "f"]
    assert files.config_keys('{"a": {"b": 1}, "c": [1]}', "json") == ["a.b", "c"]
    assert files.config_keys("[a]\nb = 1\n", "toml") == ["a.b"]
    assert files.config_keys("# x\na.b=1\nc: 2\n", "properties") == ["a.b", "c"]
    assert files.config_keys("{", "json") == []
    src = spark.createDataFrame([("p/package.json", '{"name": "p", "dependencies": {"q": "1"}}'), ("g/go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n")], "file string, content string")
    got = {(r.package, r.dependency) for r in files.read_manifests(src).collect()}
    assert got == {("p", ""), ("p", "q"), ("m", ""), ("m", "github.com/a/b")}


def test_scan_and_snapshot(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.rs").write_text("fn a() {}\n")
    (tmp_path / "t/b.rs").write_text("x" * 5000)
    assert [r.file.rpartition("/")[2] for r in files.scan(spark, str(tmp_path / "t"), ["rs"]).collect()] == ["a.rs"]
    g = make(spark, [(1, 2, "Calls", 0)])
    files.write_snapshot(g, str(tmp_path / "s"))
    back = files.read_snapshot(spark, str(tmp_path / "s"))
    assert back.nodes.count() == 2 and back.edges.count() == 1


def test_changes(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "path string, content string")
    got = {tuple(r) for r in changes.classify(changes.hashed(frame([("a", "1"), ("b", "1"), ("c", "1")])), changes.hashed(frame([("a", "1"), ("b", "2"), ("d", "1")]))).select("path", "change").collect()}
    assert got == {("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")}
    frame([("a", "1"), ("b", "1")]).write.parquet(str(tmp_path / "in"))
    seen = []
    q = changes.watch(spark, str(tmp_path / "in"), "path string, content string", str(tmp_path / "state"), lambda df, i: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_edges_first_insert_wins(spark):
    e = spark.createDataFrame([(1, 2, "Calls", "X", 0.1, 2), (1, 2, "Calls", "Y", 0.9, 1), (1, 3, "Calls", "X", 0.1, 1)], "from_id long, to_id long, kind string, origin string, confidence double, pass int")
    kept = linking.dedup_edges(e)
    assert {(r.to_id, r.origin) for r in kept.collect()} == {(2, "Y"), (3, "X")}
    assert linking.drop_dangling(kept, spark.createDataFrame([(1,), (2,)], "id long")).count() == 1
