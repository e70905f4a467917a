"""Graphs from Python source and documents."""

from graphloom.sources import documents
from graphloom.sources.python_source import graph, is_interface, module_id, relative_import  # noqa: F401

FILES = [
    ("example.py", "import os\n\ndef helper():\n    return os.getcwd()\n\nclass A:\n    def run(self):\n        return helper()\n\n    def again(self):\n        self.run()\n        nowhere()\n"),
    ("animals.py", "class Animal:\n    def setup(self):\n        pass\n\nclass Dog(Animal):\n    def setup(self):\n        super().setup()\n"),
    ("src/pkg/__init__.py", ""),
    ("src/pkg/core.py", "from .util import tool as t\nfrom abc import ABC\n\nclass Base(ABC):\n    pass\n\ndef go():\n    t()\n"),
    ("src/pkg/util.py", "def tool():\n    tool()\n"),
    ("broken.py", "def ("),
]


def test_python_source(spark):
    nodes, edges = graph(spark.createDataFrame(FILES, "file string, text string"))
    kinds = {r.id: r.kind for r in nodes.collect()}
    found = {(r.kind, r.source, r.target) for r in edges.collect()}
    assert kinds["example.A"] == "class" and kinds["pkg.core.Base"] == "interface" and "pkg" not in kinds and "broken" not in kinds
    assert {("calls", "example.A.run", "example.helper"), ("calls", "example.A.again", "example.A.run"), ("inherits", "animals.Dog", "animals.Animal"), ("calls", "animals.Dog.setup", "animals.Animal.setup"), ("imports", "example", "os"), ("imports", "pkg.core", "pkg.util.tool"), ("calls", "pkg.core.go", "pkg.util.tool"), ("calls", "pkg.util.tool", "pkg.util.tool"), ("defines", "example.A", "example.A.run")} <= found
    assert not any("nowhere" in t for _, _, t in found)


def test_names():
    assert module_id("src/a/b/__init__.py") == "a.b" and module_id("a/b.py") == "a.b"
    assert relative_import("p.q.m", False, 1, "x") == "p.q.x" and relative_import("p.q.m", False, 2, None) == "p" and relative_import("p", False, 3, "x") is None


def test_documents(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "b", "kind": "class"}, {"id": "a", "kind": "module", "line": 1}], "edges": [{"source": "a", "target": "b", "kind": "defines"}]}')
    nodes, edges = documents.scan_graph_json(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and edges.first().target == "b"
    assert documents.to_graph_json(nodes.select("id", "kind"), edges).first().json.startswith('{"nodes":[{"id":"a"')
    files = spark.createDataFrame([("k", "b", "2"), ("k", "a", "1")], "key string, path string, content string")
    same = spark.createDataFrame([("k", "a", "1"), ("k", "b", "2")], "key string, path string, content string")
    assert documents.content_manifest(files).first().hash == documents.content_manifest(same).first().hash
    text = spark.createDataFrame([("f", "one\ntwo\nthree")], "file string, text string")
    node = spark.createDataFrame([("x", "function", "f", 2, 3), ("y", "function", "f", 9, None)], "id string, kind string, file string, line int, line_end int")
    assert [r.text for r in documents.source_windows(node, text).collect()] == ["# function x\ntwo\nthree"]
