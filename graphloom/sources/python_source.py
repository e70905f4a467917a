"""Nodes and edges from Python source text: one file at a time in Arrow tasks, names resolved by joins."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RAW = "kind string, source string, raw string, owner string, file string, line int, line_end int, what string"


def module_id(file: str) -> str:
    """A relative path as a dotted id; a package is named without its __init__."""
    parts = file.removesuffix(".py").split("/")
    if parts and parts[0] == "src":
        parts = parts[1:]
    return ".".join(parts[:-1] if parts[-1] == "__init__" else parts)


def relative_import(module: str, is_package: bool, level: int, name: str | None) -> str | None:
    """The absolute name of an import with leading dots, or None above the root."""
    parts = module.split(".") if is_package else module.split(".")[:-1]
    parts = parts[: len(parts) - (level - 1)] if level - 1 <= len(parts) else None
    if parts is None:
        return None
    return ".".join([*parts, *([name] if name else [])]) or None


def dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (left := dotted(node.value)):
        return f"{left}.{node.attr}"
    return None


def is_interface(node: ast.ClassDef) -> bool:
    """An abstract base, the abstract metaclass, or only abstract methods."""
    bases = {(dotted(b.value if isinstance(b, ast.Subscript) else b) or "").split(".")[-1] for b in node.bases}
    meta = {(dotted(k.value) or "").split(".")[-1] for k in node.keywords if k.arg == "metaclass"}
    methods = [m for m in node.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
    abstract = [m for m in methods if any((dotted(d) or "").split(".")[-1] == "abstractmethod" for d in m.decorator_list)]
    return bool(bases & {"ABC", "Protocol"} or "ABCMeta" in meta or methods and len(abstract) == len(methods))


def facts(file: str, text: str) -> list[tuple]:
    """What one file says: nodes (with their owner), and imports, bases and calls by the names written. Unreadable files say nothing."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    module, package = module_id(file), file.endswith("__init__.py")
    if not module:
        return []
    out: list[tuple] = []

    def node(kind: str, id: str, owner: str | None, at: ast.AST | None) -> None:
        out.append(("node", id, kind, owner, file, getattr(at, "lineno", 1), getattr(at, "end_lineno", None), None))

    def calls(id: str, owner: str | None, body: ast.AST) -> None:
        seen = set()
        for x in ast.walk(body):
            name = dotted(x.func) if isinstance(x, ast.Call) else None
            if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Call) and dotted(x.func.value.func) == "super":
                name = f"super.{x.func.attr}"
            if name and name not in seen:
                seen.add(name)
                out.append(("calls", id, name, owner, file, x.lineno, None, module))

    def function(f: ast.FunctionDef | ast.AsyncFunctionDef, owner: str, cls: str | None) -> None:
        id = f"{owner}.{f.name}"
        node("function", id, owner, f)
        calls(id, cls, f)

    for x in tree.body:
        if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
            function(x, module, None)
        elif isinstance(x, ast.ClassDef):
            id = f"{module}.{x.name}"
            node("interface" if is_interface(x) else "class", id, module, x)
            for b in x.bases:
                if name := dotted(b.value if isinstance(b, ast.Subscript) else b):
                    out.append(("inherits", id, name, None, file, x.lineno, None, module))
            for m in x.body:
                if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                    function(m, id, id)
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            for a in x.names:
                out.append(("imports", module, a.name, a.asname or a.name.split(".")[0], file, x.lineno, None, module))
        elif isinstance(x, ast.ImportFrom):
            name = relative_import(module, package, x.level, x.module) if x.level else x.module
            for a in x.names if name else ():
                out.append(("imports", module, f"{name}.{a.name}" if a.name != "*" else name, a.asname or a.name, file, x.lineno, None, name))
    if out:
        out.insert(0, ("node", module, "module", module.rpartition(".")[0] or None, file, 1, None, None))
    return out


def scan(files: DataFrame) -> DataFrame:
    """files: file (relative path) and text, as from binaryFile or wholetext readers."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [f for file, text in zip(part["file"], part["text"], strict=True) if text is not None for f in facts(file, text)]
            yield pd.DataFrame(rows, columns=["kind", "source", "raw", "owner", "file", "line", "line_end", "what"]).astype({"line": "Int32", "line_end": "Int32"})

    return files.select("file", "text").mapInPandas(run, RAW)


def graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, kind, file, line, line_end) and edges. A written name is tried as it is, under each enclosing name, then by its import; the first known node wins, a name that none has is dropped."""
    said = scan(files)
    nodes = said.where("kind = 'node'").select(F.col("source").alias("id"), F.col("raw").alias("kind"), "file", "line", "line_end", "owner")
    known = nodes.select(F.col("id").alias("target")).distinct()
    defines = nodes.where("owner IS NOT NULL").select(F.col("owner").alias("source"), F.col("id").alias("target"), F.lit("defines").alias("kind"))
    imports = said.where("kind = 'imports'").select("source", F.col("raw").alias("target"), F.lit("imports").alias("kind"), F.col("owner").alias("alias"))
    # imported names that are no nodes point to the longest prefix that is one, or stay as written
    written = said.where("kind IN ('calls', 'inherits')").select("kind", "source", "raw", F.col("owner").alias("cls"), F.col("what").alias("module"), F.monotonically_increasing_id().alias("n"))
    head, rest = F.substring_index("raw", ".", 1), F.expr("substring(raw, length(substring_index(raw, '.', 1)) + 1)")
    own = F.when(head.isin("self", "cls") & F.col("cls").isNotNull(), F.concat("cls", rest))
    prefixes = F.split("source", r"\.")
    under = F.transform(F.sequence(F.lit(1), F.size(prefixes)), lambda k: F.concat(F.array_join(F.slice(prefixes, F.lit(1), F.size(prefixes) - k + 1), "."), F.lit("."), F.col("raw")))
    tried = written.select("n", "kind", "source", F.posexplode(F.filter(F.concat(F.array(own, F.col("raw")), under), lambda x: x.isNotNull())).alias("order", "target"))
    by_alias = written.withColumn("head", head).withColumn("rest", rest).join(imports.select(F.col("source").alias("module"), F.col("alias").alias("head"), F.col("target").alias("imported")), ["module", "head"])
    tried = tried.unionByName(by_alias.select("n", "kind", "source", F.lit(1000).alias("order"), F.concat("imported", "rest").alias("target")))
    # super: the method of the first base that has it
    bases = by_alias.where("kind = 'inherits'").select(F.col("source").alias("cls"), F.concat("imported", "rest").alias("base")).unionByName(
        written.where("kind = 'inherits'").select(F.col("source").alias("cls"), F.concat("module", F.lit("."), "raw").alias("base")))
    above = written.where("startswith(raw, 'super.')").withColumn("rest", rest).join(bases, "cls").select("n", "kind", "source", F.lit(0).alias("order"), F.concat("base", "rest").alias("target"))
    tried = tried.unionByName(above).join(known, "target")
    first = tried.withColumn("k", F.row_number().over(Window.partitionBy("n").orderBy("order", "target"))).where("k = 1")
    edges = defines.unionByName(imports.drop("alias")).unionByName(first.select("source", "target", "kind").distinct())
    return nodes.drop("owner"), edges
