"""Symbols, references and doc comments of source files.

Python goes through the standard parser. Other languages go through patterns over a text in which comments and literals
are blanked, bodies being found by matching braces; what each covers is said at its rules. ``EXTRACTORS`` takes further
languages. Offsets are UTF-8 bytes.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import config_symbols

SYMBOLS = "file string, kind string, name string, span_start long, span_end long, visibility string, refs array<string>"
FACTS = "file string, what string, kind string, name string, span_start long, span_end long, visibility string, is_test boolean, doc_start long, doc_end long"


@dataclass
class Found:
    """What a file holds: symbols (kind, name, start, end, visibility, is_test), references (kind, name, offset), and doc
    comments (start and end of the symbol, start and end of the comment)."""

    symbols: list[tuple] = field(default_factory=list)
    refs: list[tuple] = field(default_factory=list)
    docs: list[tuple] = field(default_factory=list)


EXTRACTORS: dict[str, Callable[[str], Found]] = {}


def extractor(*extensions: str):
    def add(f):
        for e in extensions:
            EXTRACTORS[e] = f
        return f

    return add


class Offsets:
    """UTF-8 offsets of a text's characters."""

    def __init__(self, text: str):
        self.plain = text.isascii()
        self.at, n = [], 0
        if not self.plain:
            for c in text:
                self.at.append(n)
                n += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
            self.at.append(n)

    def __call__(self, i: int) -> int:
        return i if self.plain else self.at[i]


# --- Python ------------------------------------------------------------------------------------------------------------


@extractor("py", "pyi")
def python_file(content: str) -> Found:
    """Classes, functions, methods, module constants and variables; names used, with calls, bases and imports apart;
    docstrings. Visibility by a leading underscore."""
    out = Found()
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return out
    starts = [0]
    for line in content.encode("utf-8", "surrogatepass").splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    begin = lambda n: starts[n.lineno - 1] + n.col_offset
    end = lambda n: starts[n.end_lineno - 1] + n.end_col_offset
    todo: list[tuple[ast.AST, bool]] = [(tree, False)]
    while todo:
        parent, in_class = todo.pop()
        for n in ast.iter_child_nodes(parent):
            named = None
            if isinstance(n, ast.ClassDef):
                named = ("Class", n.name)
                out.refs += [("Extends", b.id if isinstance(b, ast.Name) else b.attr, begin(b)) for b in n.bases if isinstance(b, (ast.Name, ast.Attribute))]
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                named = ("Method" if in_class else "Function", n.name)
            elif isinstance(n, ast.Assign) and isinstance(parent, ast.Module) and isinstance(n.targets[0], ast.Name):
                named = ("Constant" if n.targets[0].id.isupper() else "Variable", n.targets[0].id)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                out.refs += [("Import", (a.name if isinstance(n, ast.Import) else a.name).rpartition(".")[2], begin(n)) for a in n.names if a.name != "*"]
            elif isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
                out.refs.append(("Call", n.func.id if isinstance(n.func, ast.Name) else n.func.attr, begin(n.func)))
            elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load):
                out.refs.append(("ValueRef", n.id, begin(n)))
            if named:
                out.symbols.append((*named, begin(n), end(n), "Private" if named[1].startswith("_") else "Public", named[1].startswith("test_")))
            if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(n, clean=False) is not None:
                out.docs.append((begin(n), end(n), begin(n.body[0]), end(n.body[0])))
            todo.append((n, isinstance(n, ast.ClassDef)))
    return out


# --- languages with braces ---------------------------------------------------------------------------------------------


@dataclass
class Rules:
    """How a language is read. ``declarations`` are (kind, pattern with groups ``name`` and maybe ``mods``); ``members`` hold
    inside of a class's body alone, where a Function is a Method."""

    declarations: list[tuple[str, str]]
    members: list[tuple[str, str]] = field(default_factory=list)
    containers: tuple[str, ...] = ("Class", "Interface", "Enum", "Module", "Trait", "Impl")
    variants: str = "{enum}.{name}"
    keywords: frozenset[str] = frozenset()
    references: list[tuple[str, str]] = field(default_factory=list)
    strings: str = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
    public: Callable[[str, str], str] = lambda mods, name: "Public"
    test: Callable[[str], bool] = lambda before: False
    doc: str = r"/\*\*(?!/).*?\*/"


def blanked(text: str, strings: str) -> str:
    """The text with comments and literals as spaces, line breaks kept; every character stays where it is."""
    tokens = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|" + strings, re.S)
    return tokens.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def body_end(text: str, at: int) -> int:
    """End of what is declared at ``at``: behind the brace that closes the first one opened, or at the end of a statement
    or of the line where none opens before it."""
    depth = 0
    for m in re.compile(r"[{}();\n]").finditer(text, at):
        c = m[0]
        if c in "{(":
            depth += 1
        elif c in "})":
            depth -= 1
            if depth <= 0 and c == "}":
                return m.end() if depth == 0 else m.start()
        elif depth == 0 and (c == ";" or not re.compile(r"\s*(?:\{|throws|where|:|,|extends|implements|=|->)").match(text, m.end())):
            return m.start()
    return len(text)


def enum_entries(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Names at the first level of an enum's body, up to a semicolon: those after its brace or a comma."""
    at = text.find("{", start, end)
    if at < 0:
        return
    depth, wanted = 0, False
    for m in re.compile(r"[{}()\[\];,]|[A-Za-z_]\w*|@\w+").finditer(text, at, end):
        c = m[0]
        if c in "{([":
            depth += 1
            wanted = depth == 1
        elif c in "})]":
            depth -= 1
        elif depth == 1:
            if c == ";":
                return
            if c == ",":
                wanted = True
            elif wanted and c[0] != "@":
                yield c, m.start(), m.end()
                wanted = False


def brace_file(content: str, rules: Rules) -> Found:
    out, to = Found(), Offsets(content)
    plain = blanked(content, rules.strings)
    taken: dict[int, tuple] = {}
    for kind, pattern in rules.declarations:
        for m in re.compile(pattern, re.M).finditer(plain):
            if m.start("name") not in taken and m["name"] not in rules.keywords:
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                taken[m.start("name")] = (kind, m["name"], start, body_end(plain, m.end("name")), m.groupdict().get("mods") or "")
    holders = [(s, e, n) for k, n, s, e, _ in taken.values() if k in rules.containers]
    for kind, pattern in rules.members:
        for m in re.compile(pattern, re.M).finditer(plain):
            at = m.start("name")
            if at not in taken and m["name"] not in rules.keywords and any(s < at < e for s, e, _ in holders):
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                taken[at] = (kind, m["name"], start, body_end(plain, m.end("name")), m.groupdict().get("mods") or "")
    lines = [0, *(m.end() for m in re.finditer("\n", content))]
    for kind, name, start, end, mods in sorted(taken.values(), key=lambda x: (x[2], -x[3])):
        if kind == "Impl":
            continue
        inside = any(s < start < e for s, e, _ in holders)
        shown = "Method" if kind == "Function" and inside else kind
        before = content[lines[max(0, bisect.bisect_right(lines, start) - 4)] : start]
        seen = rules.public(mods, name)
        out.symbols.append((shown, name, to(start), to(end), seen, bool(rules.test(before))))
        if kind == "Enum" or (kind == "Class" and re.search(r"\benum\b", mods)):
            out.symbols += [("EnumVariant", rules.variants.format(enum=name, name=n), to(s), to(e), seen, False) for n, s, e in enum_entries(plain, start, end)]
        for d in re.compile(rules.doc, re.S | re.M).finditer(content, max(0, start - 4000), start):
            gap = re.sub(r"@\w+(\([^)]*\))?|#\[[^\]]*\]", "", content[d.end() : start])
            if not gap.strip() and gap.count("\n") <= 1 + content[d.end() : start].count("\n@"):
                out.docs.append((to(start), to(end), to(d.start()), to(d.end())))
                break
    declared = set(taken)
    for kind, pattern in [*rules.references, ("Call", r"(?<![\w@])(?P<name>[A-Za-z_]\w*)\s*\(")]:
        for m in re.compile(pattern, re.M).finditer(plain):
            if m.start("name") not in declared and m["name"] not in rules.keywords and len(m["name"]) > 2:
                out.refs.append((kind, m["name"], to(m.start("name"))))
    out.refs = list({(name, at): (kind, name, at) for kind, name, at in reversed(out.refs)}.values())[::-1]
    return out


def _words(*names: str) -> str:
    return r"(?P<mods>(?:(?:" + "|".join(names) + r")\s+)*)"


NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
KOTLIN = _words("public", "private", "protected", "internal", "open", "abstract", "final", "sealed", "data", "enum", "annotation", "inner", "value", "inline", "override", "suspend",
                "operator", "infix", "tailrec", "external", "companion", "fun", "actual", "expect")
JAVA = _words("public", "private", "protected", "static", "final", "abstract", "default", "synchronized", "native", "strictfp", "sealed")
SCRIPT = _words("export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override")
RUST = r"(?P<mods>(?:(?:pub(?:\([^)]*\))?|async|unsafe|const|default|extern(?:\s+\"[^\"]*\")?)\s+)*)"
FLOW = frozenset("if for while switch catch return when else do try throw new super this function typeof instanceof await yield match loop fn func fun constructor sizeof assert".split())
TYPE_USE = r"[:<,]\s*(?P<name>[A-Z]\w*)"

#: Top-level and nested classes, enum classes with entries (``Enum.ENTRY``), interfaces, objects, functions; calls and types.
KOTLIN_RULES = Rules(
    [("Class", rf"^[ \t]*{KOTLIN}class\s+{NAME}"), ("Interface", rf"^[ \t]*{KOTLIN}interface\s+{NAME}"), ("Module", rf"^[ \t]*{KOTLIN}object\s+{NAME}"),
     ("Function", rf"^[ \t]*{KOTLIN.replace('|fun', '')}fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?{NAME}\s*\(")],
    keywords=FLOW, references=[("TypeUse", TYPE_USE), ("Import", r"^import\s+[\w.]*?\b(?P<name>\w+)\s*(?:as\s+\w+)?$")],
    strings=r'"""(?:.*?)"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    public=lambda mods, name: "Private" if re.search(r"\b(private|protected|internal)\b", mods) else "Public")
#: Classes, records, interfaces, enums (bare variants), methods and fields of their bodies; calls, types, bases, imports.
JAVA_RULES = Rules(
    [("Class", rf"^[ \t]*{JAVA}(?:class|record)\s+{NAME}"), ("Interface", rf"^[ \t]*{JAVA}@?interface\s+{NAME}"), ("Enum", rf"^[ \t]*{JAVA}enum\s+{NAME}")],
    [("Method", rf"^[ \t]*{JAVA}(?:<[^>]*>\s*)?[\w.<>\[\]?, ]*?[\w>\]]\s+{NAME}\s*\([^;{{]*\)\s*(?:throws\s+[\w., ]+)?\s*(?=[{{;])"),
     ("Field", rf"^[ \t]*{JAVA}[A-Za-z][\w.<>\[\], ]*\s+{NAME}\s*(?==|;)")],
    variants="{name}", keywords=FLOW | {"package", "import", "return"},
    references=[("Extends", r"\bextends\s+(?P<name>[A-Z]\w*)"), ("Implements", r"\bimplements\s+(?P<name>[A-Z]\w*)"), ("Import", r"^import\s+(?:static\s+)?[\w.]*?\b(?P<name>\w+)\s*;"),
                ("Call", r"\bnew\s+(?P<name>[A-Z]\w*)"), ("TypeUse", r"[(,<]\s*(?:final\s+)?(?P<name>[A-Z]\w*)")],
    public=lambda mods, name: "Public" if "public" in mods else "Private" if re.search(r"\b(private|protected)\b", mods) else "Unknown",
    test=lambda before: bool(re.search(r"@(?:\w+\.)*(?:Test|ParameterizedTest|RepeatedTest)\b[^;{}]*$", before)))
#: Classes, interfaces, enums (``Enum.Variant``), type aliases, functions and functions in constants, constants, methods.
SCRIPT_RULES = Rules(
    [("Class", rf"^[ \t]*{SCRIPT}class\s+{NAME}"), ("Interface", rf"^[ \t]*{SCRIPT}interface\s+{NAME}"), ("Enum", rf"^[ \t]*{SCRIPT.replace('(?:export', '(?:const|export')}enum\s+{NAME}"),
     ("TypeAlias", rf"^[ \t]*{SCRIPT}type\s+{NAME}\s*(?:<[^=]*>)?\s*="), ("Function", rf"^[ \t]*{SCRIPT}function\s*\*?\s*{NAME}"),
     ("Function", rf"^{SCRIPT}(?:const|let|var)\s+{NAME}\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>|\w+\s*=>)"),
     ("Constant", rf"^{SCRIPT}const\s+{NAME}"), ("Variable", rf"^{SCRIPT}(?:let|var)\s+{NAME}")],
    [("Method", rf"^[ \t]+{SCRIPT}(?:get\s+|set\s+)?{NAME}\s*(?:<[^>]*>)?\([^;{{]*\)\s*(?::[^{{;=]+)?(?=\{{)")],
    keywords=FLOW, strings=r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`',
    references=[("Extends", r"\bextends\s+(?P<name>[A-Z]\w*)"), ("Implements", r"\bimplements\s+(?P<name>[A-Z]\w*)"), ("Call", r"\bnew\s+(?P<name>[A-Z]\w*)"), ("TypeUse", TYPE_USE)],
    public=lambda mods, name: "Public" if re.search(r"\b(export|public)\b", mods) else "Private" if re.search(r"\b(private|protected)\b", mods) else "Unknown")
#: Functions, methods by receiver, structs, interfaces, other types, constants and variables at the top. Public by case.
GO_RULES = Rules(
    [("Function", rf"^func\s+{NAME}\s*[\[(]"), ("Method", rf"^func\s*\([^)]*\)\s*{NAME}\s*\("), ("Struct", rf"^type\s+{NAME}\s*(?:\[[^\]]*\]\s*)?struct\b"),
     ("Interface", rf"^type\s+{NAME}\s*(?:\[[^\]]*\]\s*)?interface\b"), ("TypeAlias", rf"^type\s+{NAME}\s+"), ("Constant", rf"^const\s+{NAME}"), ("Variable", rf"^var\s+{NAME}")],
    containers=(), keywords=FLOW | {"make", "len", "cap", "append", "panic", "recover", "print", "println", "copy", "delete", "close", "range", "select", "defer", "go"},
    strings=r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`[^`]*`', references=[("TypeUse", r"[*\]\s(](?P<name>[A-Z]\w*)\s*[{,)]")],
    public=lambda mods, name: "Public" if name[:1].isupper() else "Private", doc=r"(?:^[ \t]*//[^\n]*\n)+(?=\S)|/\*(?!/).*?\*/")
#: Functions (methods inside of impl and trait), structs, enums (``Enum::Variant``), traits, types, modules, constants, macros.
RUST_RULES = Rules(
    [("Struct", rf"^[ \t]*{RUST}(?:struct|union)\s+{NAME}"), ("Enum", rf"^[ \t]*{RUST}enum\s+{NAME}"), ("Trait", rf"^[ \t]*{RUST}trait\s+{NAME}"), ("TypeAlias", rf"^[ \t]*{RUST}type\s+{NAME}"),
     ("Module", rf"^[ \t]*{RUST}mod\s+{NAME}\s*\{{"), ("Constant", rf"^[ \t]*{RUST.replace('|const', '')}(?:const|static)\s+(?:mut\s+)?{NAME}\s*:"),
     ("Function", rf"^[ \t]*{RUST}fn\s+{NAME}"), ("Impl", rf"^[ \t]*(?:unsafe\s+)?impl\b[^{{;]*?(?P<name>[A-Za-z_]\w*)(?:<[^{{]*)?\s*(?=\{{)")],
    containers=("Trait", "Impl"), variants="{enum}::{name}", keywords=FLOW | {"Some", "None", "Ok", "Err", "Self", "self", "mod", "use"},
    strings=r'r(#*)".*?"\1|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\'',
    references=[("Implements", r"\bimpl(?:<[^>]*>)?\s+(?:\w+::)*(?P<name>[A-Z]\w*)[^{;]*?\s+for\s"), ("Import", r"^[ \t]*(?:pub\s+)?use\s+[\w:]*?\b(?P<name>\w+)\s*;"),
                ("TypeUse", r"(?:->|[:<&,])\s*(?:mut\s+)?(?P<name>[A-Z]\w*)")],
    public=lambda mods, name: "Public" if re.match(r"pub(?!\()", mods) else "Private", test=lambda before: bool(re.search(r"#\[(?:\w+::)*test\b[^\n]*\]\s*(?:#\[[^\n]*\]\s*)*$", before)),
    doc=r"(?:^[ \t]*///[^\n]*\n)+(?=[ \t]*\S)|/\*\*(?!/).*?\*/")

for _extensions, _rules in ((("kt", "kts"), KOTLIN_RULES), (("java",), JAVA_RULES), (("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"), SCRIPT_RULES), (("go",), GO_RULES), (("rs",), RUST_RULES)):
    for _extension in _extensions:
        EXTRACTORS[_extension] = lambda content, rules=_rules: brace_file(content, rules)


# --- Markdown ----------------------------------------------------------------------------------------------------------


def _fence(line: str) -> tuple[str, int, str] | None:
    """A line that may open or close a fence: its character, the run's length and what follows."""
    body = line.lstrip(" ")
    if len(line) - len(body) > 3 or body[:1] not in ("`", "~"):
        return None
    run = len(body) - len(body.lstrip(body[0]))
    rest = body[run:].strip()
    return (body[0], run, rest) if run >= 3 and not (body[0] == "`" and "`" in rest) else None


def code_spans(text: str) -> Iterator[str]:
    """Contents of code spans: a run of backticks up to the next run of the same length."""
    runs = [(m.start(), m.end()) for m in re.finditer("`+", text)]
    i = 0
    while i < len(runs):
        close = next((j for j in range(i + 1, len(runs)) if runs[j][1] - runs[j][0] == runs[i][1] - runs[i][0]), None)
        if close is None:
            i += 1
            continue
        yield text[runs[i][1] : runs[close][0]]
        i = close + 1


@extractor("md", "markdown")
def markdown_file(content: str) -> Found:
    """Sections by ATX headings outside of fenced code; identifiers in their code spans are references."""
    out, to = Found(), Offsets(content)
    at, fence, heads = 0, None, []
    for line in content.splitlines(keepends=True):
        body = line.rstrip("\r\n")
        marks = _fence(body)
        if fence:
            if marks and marks[0] == fence[0] and marks[1] >= fence[1] and not marks[2]:
                fence = None
        elif marks:
            fence = marks
        else:
            text = body.strip(" \t")
            level = len(text) - len(text.lstrip("#"))
            if 1 <= level <= 6 and len(body) - len(body.lstrip(" ")) <= 3 and (text[level:] == "" or text[level] in " \t"):
                title = text[level:].strip()
                bare = title.rstrip("#")
                heads.append((at, bare.rstrip() if bare == "" or bare[-1] in " \t" else title))
        at += len(line)
    for (start, name), end in zip(heads, [h[0] for h in heads[1:]] + [len(content)], strict=True):
        out.symbols.append(("DocSection", name, to(start), to(end), "Unknown", False))
        names = {x for x in code_spans(content[start:end]) if x.isascii() and x.isidentifier()}
        out.refs += [("Mention", x, to(start)) for x in sorted(names)]
    return out


# --- literals ----------------------------------------------------------------------------------------------------------

#: What is taken for an API path, a configuration reference, an environment variable, or a wiring call.
API_PATH, CONFIG_REF, ENV_REF, GO_DI = "api_path::", "config_ref::", "env_ref::", "go_di_marker::"
LITERALS = [
    ("java kt ts tsx js jsx mjs cjs py pyi go", API_PATH, "StringLiteral", r'"(/[A-Za-z0-9_\-/{}\.\:]*[A-Za-z0-9_\-}\)])"'),
    ("java kt", CONFIG_REF, "ConfigKey", r'@Value\(\s*"\$\{([A-Za-z0-9_.\-]+)(?::[^}]*)?\}"\s*\)'),
    ("ts tsx js jsx mjs cjs", ENV_REF, "ConfigKey", r'(?:process\.env\.|import\.meta\.env\.)([A-Z][A-Z0-9_]*)|(?:process\.env|import\.meta\.env)\[\s*"([A-Za-z][A-Za-z0-9_.-]*)"\s*\]'),
    ("py pyi", ENV_REF, "ConfigKey", r'os\.environ\[\s*"([A-Z][A-Z0-9_]*)"\s*\]|os\.getenv\(\s*"([A-Z][A-Z0-9_]*)"(?:\s*,[^)]*)?\s*\)'),
    ("rs", ENV_REF, "ConfigKey", r'(?:std::env::var|env::var|env!)\(\s*"([A-Z][A-Z0-9_]*)"(?:\s*,[^)]*)?\s*\)'),
    ("go", GO_DI, "Function", r"\b(wire\.Build|fx\.Provide)\s*\("),
]


def plausible_path(path: str) -> bool:
    return len(path) >= 4 and ("//" not in path or path.startswith("//")) and sum(c in "0123456789" for c in path) <= len(path) // 2


def literals(content: str, extension: str) -> Iterator[tuple]:
    """Symbols that stand for literals of a file: the path itself, or the whole expression that names a key."""
    to = Offsets(content)
    for extensions, prefix, kind, pattern in LITERALS:
        if extension not in extensions.split():
            continue
        for m in re.finditer(pattern, content):
            group = next(i for i in range(1, m.re.groups + 1) if m[i] is not None)
            name, at = m[group], group if prefix == API_PATH else 0
            if prefix == API_PATH and not plausible_path(name):
                continue
            name = "".join(c.lower() if c.isascii() else c for c in name).replace("_", ".") if prefix == ENV_REF else name
            yield kind, prefix + name, to(m.start(at)), to(m.end(at)), "Unknown", False


# --- tables ------------------------------------------------------------------------------------------------------------


def facts(sources: DataFrame) -> DataFrame:
    """``sources(file, content)`` -> a row for each symbol (literals and configuration keys included), reference and doc comment.

    ``what`` tells which; references stand at ``span_start``, doc comments name their symbol's span and their own. Null
    contents and files without an extractor have none.
    """
    names = [c.split()[0] for c in FACTS.split(", ")]

    def work(batches):
        for pdf in batches:
            rows: list[tuple] = []
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                extension = file.rpartition(".")[2].lower() if file else ""
                found = EXTRACTORS[extension](content) if content and extension in EXTRACTORS else Found()
                more = list(literals(content, extension)) if content else []
                more += [("ConfigKey", key, s, e, "Unknown", False) for key, s, e in config_symbols(file, content)] if file and content else []
                rows += [(file, "symbol", k, n, s, e, v, t, None, None) for k, n, s, e, v, t in [*found.symbols, *more]]
                rows += [(file, "ref", k, n, at, at, None, None, None, None) for k, n, at in found.refs]
                rows += [(file, "doc", None, None, s, e, None, None, ds, de) for s, e, ds, de in found.docs]
            yield pd.DataFrame(rows, columns=names).astype({"doc_start": "Int64", "doc_end": "Int64", "is_test": "boolean"})

    return sources.select("file", "content").mapInPandas(work, FACTS)


def symbols(sources: DataFrame) -> DataFrame:
    """Symbols with the names used inside of their spans (longer than two characters, not their own)."""
    all_ = facts(sources)
    own = all_.where("what = 'symbol'").select("file", "kind", "name", "span_start", "span_end", "visibility")
    used = all_.where("what = 'ref'").select(F.col("file").alias("f"), F.col("name").alias("used"), F.col("span_start").alias("at"))
    inside = (F.col("file") == F.col("f")) & (F.col("at") >= F.col("span_start")) & (F.col("at") < F.col("span_end")) & (F.col("used") != F.col("name")) & (F.length("used") > 2)
    return own.join(used, inside, "left").groupBy(*own.columns).agg(F.array_sort(F.collect_set("used")).alias("refs"))
