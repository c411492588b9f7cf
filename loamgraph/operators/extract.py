"""Entities and relations of source files: Python by its syntax tree, other languages by declarations.

One pass over (path, content) rows in batches gives rows of three kinds: nodes, edges and raw calls. Calls across files are
resolved afterwards by joins (analyze.resolve_calls). Without grammars at hand, languages other than Python are read
by the patterns of their declarations and by indentation or braces; that is an approximation, and strings or comments that look
like declarations are taken for such.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "kind string, id string, label string, source string, target string, relation string, confidence string, source_file string, source_location string, weight double, callee string, receiver string"
#: Comment prefixes that give a reason, least length of a docstring, most of a label.
REASONS, LEAST_DOC, MOST_LABEL = ("NOTE:", "TODO:", "FIXME:", "HACK:", "WHY:", "IMPORTANT:", "RATIONALE:"), 20, 80


@dataclass(frozen=True)
class Language:
    """Patterns of declarations; the group is the name, and for imports the module."""

    classes: str
    functions: str
    imports: str
    import_relation: str
    calls: str = r"(?:(\w+)(?:\.|::|->))?(\w+)\s*\("
    extends: str = r"(?!)"


_BRACES = dict(extends=r"\b(?:class|interface|trait|struct)\s+\w+[^{]*?(?:extends|:|<)\s*(?:public\s+)?([\w.]+)")
#: Declarations by language; names of the keys are those of functions.text.LANGUAGES.
LANGUAGES = {
    "javascript": Language(r"\bclass\s+(\w+)", r"(?:\bfunction\s+(\w+)|^\s*(?:async\s+)?(?!if|for|while|switch|return|catch)(\w+)\s*\([^)]*\)\s*\{)", r"""import\s[^'"]*['"]([^'"]+)['"]""", "imports_from", extends=r"\bclass\s+\w+\s+extends\s+([\w.]+)"),
    "rust": Language(r"\b(?:struct|enum|trait|impl(?:<[^>]*>)?(?:\s+\w+\s+for)?)\s+(\w+)", r"\bfn\s+(\w+)", r"^\s*(?:pub\s+)?use\s+([\w:]+)", "imports"),
    "go": Language(r"\btype\s+(\w+)\s+(?:struct|interface)", r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)", r'^\s*(?:import\s+)?"([\w./\-]+)"\s*$', "imports"),
    "java": Language(r"\b(?:class|interface|enum)\s+(\w+)", r"(?:public|private|protected|static|final|\s)+[\w<>\[\],.]+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,. ]+)?\{", r"^\s*import\s+(?:static\s+)?([\w.]+)", "imports", **_BRACES),
    "c": Language(r"\b(?:struct|enum|union)\s+(\w+)\s*\{", r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;{]*\)\s*\{", r'^\s*#include\s*[<"]([^>"]+)', "imports"),
    "cpp": Language(r"\b(?:class|struct|enum)\s+(\w+)[^;{]*\{", r"^[A-Za-z_][\w\s*&:<>]*?\b(\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{", r'^\s*#include\s*[<"]([^>"]+)', "imports", **_BRACES),
    "csharp": Language(r"\b(?:class|interface|struct|enum)\s+(\w+)", r"(?:public|private|protected|internal|static|\s)+[\w<>\[\],.]+\s+(\w+)\s*\([^)]*\)\s*\{", r"^\s*using\s+([\w.]+)\s*;", "imports", **_BRACES),
    "scala": Language(r"\b(?:class|object|trait)\s+(\w+)", r"\bdef\s+(\w+)", r"^\s*import\s+([\w.]+)", "imports", extends=r"\b(?:class|object|trait)\s+\w+[^{]*?extends\s+([\w.]+)"),
    "php": Language(r"\b(?:class|interface|trait)\s+(\w+)", r"\bfunction\s+(\w+)", r"^\s*use\s+([\w\\]+)", "imports", extends=r"\bclass\s+\w+\s+extends\s+(\w+)"),
    "ruby": Language(r"^\s*(?:class|module)\s+(\w+)", r"^\s*def\s+(?:self\.)?(\w+)", r"""^\s*require(?:_relative)?\s+['"]([^'"]+)""", "imports", extends=r"^\s*class\s+\w+\s*<\s*(\w+)"),
    "swift": Language(r"\b(?:class|struct|protocol|enum)\s+(\w+)", r"\bfunc\s+(\w+)", r"^\s*import\s+(\w+)", "imports", **_BRACES),
    "lua": Language(r"(?!)", r"\bfunction\s+(?:[\w.]+[.:])?(\w+)", r"""require\s*\(?\s*['"]([^'"]+)""", "imports"),
}
LANGUAGES["typescript"] = LANGUAGES["javascript"]
_NOT_CALLED = frozenset("if for while switch catch return function def fn func sizeof match elif except with and or not print assert new await typeof super".split())


def make_id(*parts: str) -> str:
    own = [p.strip("_.") for p in parts if p]
    return re.sub(r"[^A-Za-z0-9]+", "_", "_".join(p for p in own if p)).strip("_").lower()


class _Rows:
    def __init__(self, path: str) -> None:
        self.path, self.stem = path, re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1]) or path
        self.out: list[dict] = []
        self.seen: set[str] = set()
        self.root = self.node(make_id(self.stem), self.stem, 1)

    def node(self, id_: str, label: str, line: int, parent: str | None = None, relation: str = "contains") -> str:
        if id_ not in self.seen:
            self.seen.add(id_)
            self.out.append({"kind": "node", "id": id_, "label": label, "source_file": self.path, "source_location": f"L{line}", "confidence": "EXTRACTED"})
        if parent is not None:
            self.edge(parent, id_, relation, line)
        return id_

    def edge(self, a: str, b: str, relation: str, line: int, confidence: str = "EXTRACTED", weight: float = 1.0) -> None:
        if a and b and (a != b or relation in ("contains", "imports")):
            self.out.append({"kind": "edge", "source": a, "target": b, "relation": relation, "confidence": confidence, "source_file": self.path, "source_location": f"L{line}", "weight": weight})

    def call(self, caller: str, callee: str, receiver: str | None, line: int) -> None:
        self.out.append({"kind": "call", "source": caller, "callee": callee, "receiver": receiver, "source_file": self.path, "source_location": f"L{line}"})

    def reason(self, of: str, text: str, line: int) -> None:
        label = " ".join(text.split())[:MOST_LABEL]
        self.edge(self.node(make_id(self.stem, "rationale", str(line)), label, line), of, "rationale_for", line)


def _python(rows: _Rows, text: str) -> None:
    tree = ast.parse(text)
    todo: list[tuple[ast.AST, str, str | None]] = [(c, rows.root, None) for c in reversed(tree.body)]
    doc = ast.get_docstring(tree)
    if doc and len(doc.encode()) > LEAST_DOC:
        rows.reason(rows.root, doc, 1)
    while todo:
        x, parent, owner = todo.pop()
        if isinstance(x, ast.ClassDef):
            own = rows.node(make_id(rows.stem, x.name), x.name, x.lineno, parent)
            for b in x.bases:
                name = b.attr if isinstance(b, ast.Attribute) else getattr(b, "id", "")
                rows.edge(own, make_id(rows.stem, name) if name else "", "extends", x.lineno)
            inner, owner_ = own, x.name
        elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
            own = rows.node(make_id(rows.stem, owner or "", x.name), f".{x.name}()" if owner else f"{x.name}()", x.lineno, parent, "method" if owner else "contains")
            inner, owner_ = own, owner
        elif isinstance(x, ast.Import):
            for a in x.names:
                rows.edge(rows.root, make_id(a.name), "imports", x.lineno)
            continue
        elif isinstance(x, ast.ImportFrom):
            module = (x.module or "").rsplit(".", 1)[-1]
            rows.edge(rows.root, make_id(module), "imports_from", x.lineno)
            for a in x.names:
                rows.edge(rows.root, make_id(module, a.name), "uses", x.lineno, "INFERRED", 0.8)
            continue
        else:
            if isinstance(x, ast.Call):
                f = x.func
                if isinstance(f, ast.Name):
                    rows.call(parent, f.id, None, x.lineno)
                elif isinstance(f, ast.Attribute):
                    rows.call(parent, f.attr, f.value.id if isinstance(f.value, ast.Name) else None, x.lineno)
            todo += [(c, parent, owner) for c in reversed(list(ast.iter_child_nodes(x)))]
            continue
        doc = ast.get_docstring(x)
        if doc and len(doc.encode()) > LEAST_DOC:
            rows.reason(own, doc, x.lineno)
        todo += [(c, inner, owner_) for c in reversed(x.body)]


def _declared(rows: _Rows, text: str, language: Language) -> None:
    """Declarations line by line; what is deeper than a class belongs to it, until the indentation returns."""
    classes, functions, imports, extends, calls = (re.compile(p) for p in (language.classes, language.functions, language.imports, language.extends, language.calls))
    scopes: list[tuple[int, str, str, bool]] = []  # indentation, id, name, whether a class
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        depth = len(line) - len(line.lstrip())
        while scopes and depth <= scopes[-1][0] and line.strip() not in ("}", "};", "end", ")", "{"):
            scopes.pop()
        owner = next((s for s in reversed(scopes) if s[3]), None)
        at = scopes[-1][1] if scopes else rows.root
        if m := imports.search(line):
            rows.edge(rows.root, make_id(re.split(r"[./:\\]+", m[1].strip("./"))[-1]), language.import_relation, n)
        elif m := classes.search(line):
            own = rows.node(make_id(rows.stem, m[1]), m[1], n, at)
            if e := extends.search(line):
                rows.edge(own, make_id(rows.stem, e[1].split(".")[-1]), "extends", n)
            scopes.append((depth, own, m[1], True))
        elif (m := functions.search(line)) and (name := next(g for g in m.groups() if g)) not in _NOT_CALLED:
            own = rows.node(make_id(rows.stem, owner[2] if owner else "", name), f".{name}()" if owner else f"{name}()", n, owner[1] if owner else rows.root, "method" if owner else "contains")
            scopes.append((depth, own, name, False))
        elif scopes and not scopes[-1][3]:
            for c in calls.finditer(line):
                if c[2] not in _NOT_CALLED:
                    rows.call(scopes[-1][1], c[2], c[1], n)


def extract_file(path: str, text: str, language: str | None) -> list[dict]:
    """Rows of one file; a file that does not parse has its own node only."""
    rows = _Rows(path)
    try:
        if language == "python":
            _python(rows, text)
        elif language in LANGUAGES:
            _declared(rows, text, LANGUAGES[language])
    except (SyntaxError, ValueError, RecursionError):
        pass
    for n, line in enumerate(text.splitlines(), 1):
        if (m := re.search(r"(?:#|//|--)\s*(.*)", line)) and m[1].startswith(REASONS):
            rows.reason(rows.root, m[1], n)
    return rows.out


def extract(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA of all (path, content, language)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.float64() if c.endswith("double") else pa.string() for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, t, l in zip(b["path"].to_pylist(), b["content"].to_pylist(), b["language"].to_pylist(), strict=True) for r in extract_file(p, t, l)]  # noqa: E741
            yield pa.record_batch([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    return files.where("path IS NOT NULL AND content IS NOT NULL").select("path", "content", "language").mapInArrow(run, SCHEMA)


def tables(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (the last of an id wins), edges between them, and raw calls (caller, callee, receiver)."""
    nodes = rows.where("kind = 'node'").groupBy("id").agg(F.max_by(F.struct("label", "source_file", "source_location", "confidence"), F.struct("source_file", "source_location")).alias("x")).select("id", "x.*", F.lit("code").alias("file_type"))
    ids = nodes.select("id")
    edges = rows.where("kind = 'edge'").select("source", "target", "relation", "confidence", "source_file", "source_location", "weight").distinct()
    edges = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return nodes, edges, rows.where("kind = 'call'").select(F.col("source").alias("caller"), F.lower("callee").alias("callee"), "receiver", "source_file", "source_location")
