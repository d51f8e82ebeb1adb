"""Mediators, recommendations and extractors on small inputs."""

from quillgraph.operators import advice, mediators
from quillgraph.sources import extract

SOURCE = '''import os

LIMIT = 3


class Box:
    def open(self):
        return helper(LIMIT)


def _hidden():
    return "é"


def helper(x):
    return os.path.join(x)
'''


def test_python_and_markdown_symbols(spark):
    text = "# One\n\nSee `helper` and `a + b`.\n```\n# not a heading\n```\n## Two\n"
    rows = [("a.py", SOURCE), ("b.md", text), ("bad.py", "def ("), ("c.rs", "fn x() {}"), ("n.py", None)]
    got = {(r.file, r.kind, r.name): r for r in extract.symbols(spark.createDataFrame(rows, "file string, content string")).collect()}
    assert set(got) == {("a.py", "Constant", "LIMIT"), ("a.py", "Class", "Box"), ("a.py", "Method", "open"), ("a.py", "Function", "_hidden"), ("a.py", "Function", "helper"),
                        ("b.md", "DocSection", "One"), ("b.md", "DocSection", "Two"), ("c.rs", "Function", "x")}
    raw = SOURCE.encode()
    helper = got["a.py", "Function", "helper"]
    assert raw[helper.span_start : helper.span_end].startswith(b"def helper") and got["a.py", "Function", "_hidden"].visibility == "Private"
    assert got["a.py", "Method", "open"].refs == ["LIMIT", "helper"]
    assert got["b.md", "DocSection", "One"].refs == ["helper"]


def test_mediators_join(spark):
    rows = [
        (1, "ConfigKey", "db.url", "app.yml", 0), (2, "ConfigKey", "config_ref::DB.URL", "A.java", 0), (3, "ConfigKey", "config_ref::none", "A.java", 0),
        (4, "StringLiteral", "/home", "r.tsx", 500), (5, "Function", "Home", "r.tsx", 700), (6, "Function", "Far", "r.tsx", 701), (7, "Function", "home", "r.tsx", 510),
        (8, "ConfigKey", "services.web", "compose.yml", 0), (9, "ConfigKey", "services.db", "compose.yml", 9), (10, "ConfigKey", "services.web.depends_on.0", "compose.yml", 20),
        (11, "Function", "NewA", "m.go", 0), (12, "Function", "NewB", "m.go", 9), (13, "Function", "wire.Build", "m.go", 20), (14, "Function", "NewC", "other.go", 0),
    ]
    nodes = spark.createDataFrame(rows, "id long, kind string, name string, file string, span_start long")
    got = {(r.from_id, r.to_id) for r in mediators.mediated(nodes).collect()}
    assert got == {(2, 1), (4, 5), (8, 9), (11, 12)}
    assert mediators.mediated(nodes.limit(0)).count() == 0


def test_advice(spark):
    pairs = spark.createDataFrame([("a.ts", "b.js")] * 3, "file string, other_file string")
    assert advice.path_category_advice(pairs).first().reports == 3
    assert advice.path_category_advice(pairs.union(spark.createDataFrame([("a.ts", "b.java")], pairs.schema))).isEmpty()
    values = spark.createDataFrame([("x", f"f{i}") for i in range(6)] + [("y", "f1"), ("y", "f2")], "value string, file string")
    row = advice.cap_advice(values, 40).first()
    assert (row.current_cap, row.current_edges, row.recommended_cap, row.projected_edges) == (8, 16, 4, 1)
    assert advice.cap_advice(values, 0).isEmpty() and advice.cap_advice(values, 4000).isEmpty()
