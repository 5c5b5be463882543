"""Extraction: source files to symbols and edges, one pass a file, in executors.

An extractor turns (file_path, text) into symbols and edges. Python goes through its own parser. The other languages share a
scanner: comments and strings are blanked out, declarations found by their heads, blocks by their braces (or "end"), and scopes by
containment. An ordinal keeps the order of extraction, so that the first of equal edges wins.
"""

from __future__ import annotations

import ast
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.functions.names import MODULE
from grove.operators.graph import first_wins
from grove.schema import CLASS_LIKE

Symbol = dict
Edge = tuple[str | None, str, str, int]  # scope's id, target, kind, line


@dataclass
class Found:
    symbols: list[Symbol] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)


Extractor = Callable[[str, str], Found]
REGISTRY: dict[str, Extractor] = {}


def register(language: str, extractor: Extractor) -> None:
    REGISTRY[language] = extractor


def symbol(path: str, language: str, name: str, kind: str, start: int, end: int, signature: str | None, doc: str | None, parent: str | None, metadata: dict) -> Symbol:
    name = name.lstrip(":$")
    return {"id": f"{path}::{name}::{kind}::{start}", "name": name, "kind": kind, "file_path": path, "line_start": start, "line_end": end, "signature": signature, "docstring": doc, "parent_id": parent, "language": language, "metadata": json.dumps(metadata)}


def signature(head: str) -> str | None:
    """The text up to the first brace or newline."""
    return re.match(r"[^{\n]*", head)[0].strip() or None


# Python


def python_access(name: str) -> str:
    return "name_mangled" if name.startswith("__") and not name.endswith("__") else "private" if name.startswith("_") and not name.startswith("__") else "public"


class _PythonVisitor(ast.NodeVisitor):
    def __init__(self, path: str, lines: list[str]) -> None:
        self.path, self.lines, self.out, self.scopes = path, lines, Found(), []

    def scope(self) -> str | None:
        return self.scopes[-1] if self.scopes else None

    def declare(self, node: ast.AST, kind: str, metadata: dict) -> None:
        for d in node.decorator_list:
            self.visit(d)
        s = symbol(self.path, "python", node.name, kind, node.lineno, node.end_lineno, signature(self.lines[node.lineno - 1].strip().rstrip(":")), ast.get_docstring(node), None, metadata)
        self.out.symbols.append(s)
        self.scopes.append(s["id"])
        for child in ast.iter_child_nodes(node):
            if child not in node.decorator_list:
                self.visit(child)
        self.scopes.pop()

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        marks = [ast.unparse(d).split("(")[0] for d in node.decorator_list]
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        required = len(plain) - len(a.defaults)
        params = [{"name": p.arg, "type": ast.unparse(p.annotation) if p.annotation else None, "has_default": i >= required} for i, p in enumerate(plain)]
        params += [{"name": p.arg, "type": ast.unparse(p.annotation) if p.annotation else None, "has_default": d is not None} for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        self.declare(node, "function", {
            "access": python_access(node.name), "is_async": isinstance(node, ast.AsyncFunctionDef), "is_static": "staticmethod" in marks, "is_classmethod": "classmethod" in marks,
            "is_abstract": any(m.endswith("abstractmethod") for m in marks), "is_property": "property" in marks, "decorators": marks, "return_type": ast.unparse(node.returns) if node.returns else None,
            "parameters": [p for p in params if p["name"] not in ("self", "cls")],
        })

    visit_FunctionDef = visit_AsyncFunctionDef = function

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        at = len(self.out.edges)
        self.declare(node, "class", {"access": python_access(node.name), "decorators": [ast.unparse(d).split("(")[0] for d in node.decorator_list]})
        own = f"{self.path}::{node.name}::class::{node.lineno}"
        self.out.edges[at:at] = [(own, b.id if isinstance(b, ast.Name) else ast.unparse(b), "extends", b.lineno) for b in node.bases if isinstance(b, ast.Name | ast.Attribute)]

    def visit_Import(self, node: ast.Import) -> None:
        self.out.edges += [(self.scope(), a.name, "imports", node.lineno) for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.out.edges += [(self.scope(), f"{module}::{a.name}", "imports", node.lineno) for a in node.names]

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            self.out.edges.append((self.scope(), f.id, "calls", node.lineno))
        elif isinstance(f, ast.Attribute):
            owner = f.value.id if isinstance(f.value, ast.Name) else f.value.attr if isinstance(f.value, ast.Attribute) else None
            if owner:
                self.out.edges.append((self.scope(), f"{owner}.{f.attr}", "calls", node.lineno))
        self.generic_visit(node)


def extract_python(path: str, text: str) -> Found:
    """A file that doesn't parse has no symbols and no edges."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return Found()
    v = _PythonVisitor(path, text.split("\n"))
    v.visit(tree)
    return v.out


# The other languages

_C_COMMENT, _HASH_COMMENT, _DASH_COMMENT = r"//[^\n]*|/\*.*?\*/", r"#[^\n]*", r"--\[\[.*?\]\]|--[^\n]*"
_STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
_CHARS = r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])\''
_NOT_CALLS = frozenset(
    "if for while switch catch return function else do try with new typeof sizeof await yield throw case in of not and or elseif elif unless until when match fn func def sub let var const val assert defined super lock using foreach "
    "constructor init guard where loop unsafe impl".split()
)


_NOT_NAMES = _NOT_CALLS - {"constructor", "init", "match", "guard"}


@dataclass
class Rules:
    """heads: (kind, pattern with a group name), tried on blanked text. members: kinds that become methods inside containers."""

    heads: list[tuple[str, str]]
    comments: str = _C_COMMENT
    strings: str = _STRINGS
    imports: list[tuple[str, str]] = field(default_factory=list)  # pattern on text with strings, and a format of its groups
    methods: bool = False
    end_words: str | None = None
    heritage: list[tuple[str, str]] = field(default_factory=list)  # kind, pattern with group names: a list of types
    new: str | None = r"\bnew\s+([A-Za-z_]\w*)"
    types: list[str] = field(default_factory=list)
    joins: str = r"\.|\?\."
    show_owner: bool = True
    skip_owners: tuple[str, ...] = ("this", "super")
    call: str = r"\("
    macros: bool = False
    builtins: frozenset[str] = frozenset()
    flags: int = re.M
    edges: list[tuple[str, str]] = field(default_factory=list)  # kind, pattern with one group
    calls: bool = True
    calls_in: tuple[str, ...] | None = None
    fields_of: tuple[str, ...] = ("class", "struct", "enum", "interface")
    scopes: tuple[str, ...] = ("function", "method", "class", "struct", "interface", "enum", "module")


def blank(text: str, pattern: str) -> str:
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def block_end(code: str, at: int) -> int:
    """The end of a declaration: of its block if a brace opens before a semicolon, else the semicolon, else the line."""
    depth = 0
    for i in range(at, len(code)):
        ch = code[i]
        if ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif depth <= 0 and ch == ";":
            return i
        elif depth <= 0 and ch == "{":
            level = 0
            for m in re.finditer(r"[{}]", code[i:]):
                level += 1 if m[0] == "{" else -1
                if not level:
                    return i + m.start()
            return len(code) - 1
        elif depth <= 0 and ch == "\n" and not re.match(r"\s*[{:>]|\s*(?:where|extends|implements|throws)\b", code[i:]):
            return i
    return len(code) - 1


def word_end(code: str, at: int, openers: str) -> int:
    """The end of a block that an "end" closes."""
    level = 1
    for m in re.finditer(rf"^[ \t]*(?:local\s+)?(?:{openers})\b|\b(?:do|function|then)\b|\bend\b", code[at:], re.M):
        word = m[0].strip()
        if word == "end":
            level -= 1
            if not level:
                return at + m.start()
        elif word not in ("do", "then") or (word == "do" and not re.search(r"\b(?:while|for|until)\b[^\n]*$", code[at : at + m.start()].rpartition("\n")[2])):
            level += 1
    return len(code) - 1


def doc_before(text: str, at: int, comments: dict[int, int]) -> str | None:
    """The comment, of any length, that ends on the line before; comments: where each begins, by its end."""
    end = text.rfind("\n", 0, at) + 1
    while end and text[end - 1].isspace():  # only the blank before the declaration is walked over
        end -= 1
    return text[comments[end] : end].strip() if end in comments else None


def scan(language: str, r: Rules) -> Extractor:
    heads = [(kind, re.compile(p, r.flags)) for kind, p in r.heads]
    blanks = f"{r.comments}|(?P<s>{r.strings})"
    owner = rf"(?:([A-Za-z_$][\w$]*)\s*(?:{r.joins})\s*)?" if r.joins else "()"
    calls = re.compile(rf"(?<![\w$]){owner}([A-Za-z_$][\w$]*{'!?' if r.macros else ''})\s*{r.call}", re.M)

    def extract(path: str, text: str) -> Found:
        plain = re.sub(blanks, lambda m: m[0] if m["s"] else re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
        code = re.sub(blanks, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        comments = {m.start() + len(m[0].rstrip()): m.start() for m in re.finditer(blanks, text, re.S) if not m["s"]}
        line = lambda i: bisect_right(starts, i)
        spans, names = [], set()
        for kind, pattern in heads:
            for m in pattern.finditer(code):
                at = m.start() + len(m[0]) - len(m[0].lstrip())
                if m["name"] in _NOT_NAMES or m.start("name") in names:
                    continue
                names.add(m.start("name"))
                end = word_end(code, m.end(), r.end_words) if r.end_words and kind != "property" else block_end(code, m.end("name"))
                spans.append((at, end, kind, m["name"]))
        spans.sort(key=lambda s: (s[0], -s[1]))
        out, stack, scopes = Found(), [], []
        for at, end, kind, name in spans:
            while stack and stack[-1][1] < at:
                stack.pop()
            inside = next((s for s in reversed(stack) if s[2] in (*CLASS_LIKE, "enum", "module", "type")), None)
            if kind == "function" and r.methods and inside and inside[2] in (*CLASS_LIKE, "enum") and inside is stack[-1]:
                kind = "method"
            if kind == "property" and (not inside or inside is not stack[-1] or inside[2] not in r.fields_of):
                continue
            head = text[at : end + 1]
            words = set(re.findall(r"\w+", code[starts[line(at) - 1] : code.find(name, at)]))
            access = next((w for w in ("public", "private", "protected", "internal", "pub", "fileprivate", "open") if w in words), None)
            metadata = {"access": access, **{f"is_{w}": True for w in ("async", "static", "abstract", "final", "override", "virtual", "readonly", "sealed") if w in words}}
            if m := re.match(rf"[^({{;\n]*\b{re.escape(name)}\s*(?:<[^>]*>)?\(([^)]*)\)\s*(?:(?::|->)\s*([^\n{{;]+))?", head, re.S):
                metadata["parameters"] = [{"name": p.split(":")[0].split("=")[0].strip()} for p in m[1].split(",") if p.strip()]
                metadata["return_type"] = m[2].strip() if m[2] else None
            s = symbol(path, language, name, kind, line(at), line(end), signature(head), doc_before(text, at, comments), inside[3] if inside and kind in ("method", "property") else None, metadata)
            out.symbols.append(s)
            entry = (at, end, kind, s["id"])
            stack.append(entry)
            if kind in r.scopes:
                scopes.append(entry)
        found: list[tuple[int, str, str]] = []
        for pattern, form in r.imports:
            for m in re.finditer(pattern, plain, re.M):
                groups = [g for g in m.groups() if g is not None]
                if "{names}" in form:
                    found += [(m.start(), form.format(*groups[1:], names=n), "imports") for n in re.findall(r"[\w$]+(?=\s*(?:as\s+\w+\s*)?(?:,|$))", groups[0].strip().rstrip(","))]
                else:
                    found.append((m.start(), form.format(*groups), "imports"))
        for kind, pattern in r.heritage:
            for m in re.finditer(pattern, code, re.M):
                found += [(m.start(1), n, kind) for n in re.findall(r"[A-Za-z_][\w.:]*(?=\s*(?:<[^,]*>)?\s*(?:\([^)]*\))?\s*(?:,|$))", re.sub(r"<[^<>]*>", "", m[1]).strip())]
        news = set()
        if r.new:
            for m in re.finditer(r.new, code):
                news.add(m.start(1))
                found.append((m.start(1), m[1], "instantiates"))
        for pattern in r.types:
            found += [(m.start(1), m[1], "references_type") for m in re.finditer(pattern, code, re.M)]
        for kind, pattern in r.edges:
            found += [(m.start(1), m[1], kind) for m in re.finditer(pattern, code, re.M | re.I)]
        for m in calls.finditer(code) if r.calls else ():
            who, name = m[1] or "", m[2]
            if name.rstrip("!") in _NOT_CALLS or m.start(2) in names or m.start(2) in news or who in r.skip_owners or (not who and (name.lower() if r.flags & re.I else name) in r.builtins):
                continue
            if r.flags & re.I and re.search(r"\b(?:references|into|table|view|function|exists)\s+$", code[max(0, m.start() - 20) : m.start()], re.I):
                continue
            found.append((m.start(2), f"{who}.{name}" if who and r.show_owner else name, "calls"))
        for at, to, kind in sorted(found, key=lambda f: f[0]):
            scope = max((s for s in scopes if s[0] <= at <= s[1]), key=lambda s: s[0], default=None)
            if kind == "calls" and r.calls_in and (not scope or scope[2] not in r.calls_in):
                continue
            out.edges.append((scope[3] if scope else None, to, kind, line(at)))
        return out

    return extract


_MODS = r"(?:(?:public|private|protected|internal|static|abstract|final|sealed|partial|async|override|virtual|readonly|synchronized|native|default|export|declare|open|data|inner|inline|suspend|lateinit|extern|unsafe|strictfp|fileprivate|mutating|convenience|required|weak)\s+)*"
_TYPE = r"[A-Za-z_][\w.:]*(?:<[^;{}()=]*>)?(?:\[\])*[?*&]*"

RULES: dict[str, Rules] = {
    "typescript": Rules(
        heads=[
            ("class", rf"^[ \t]*{_MODS}class\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_MODS}interface\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_MODS}(?:const\s+)?enum\s+(?P<name>\w+)"), ("type", rf"^[ \t]*{_MODS}type\s+(?P<name>\w+)[^=\n]*="),
            ("function", rf"^[ \t]*{_MODS}function\s*\*?\s*(?P<name>\w+)"), ("function", rf"^[ \t]*{_MODS}(?:const|let|var)\s+(?P<name>\w+)[^=\n]*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>|\w+\s*=>)"),
            ("function", rf"^[ \t]+{_MODS}(?:get\s+|set\s+)?(?P<name>[\w$]+)\s*(?:<[^>\n]*>)?\([^;]*?\)\s*(?::\s*[^{{;=]+)?\{{"), ("property", rf"^[ \t]+{_MODS}(?P<name>[\w$]+)[?!]?\s*(?::\s*[^;(){{}}=\n]+)?(?:=[^;\n]+)?;"),
        ],
        imports=[(r"^\s*import\s+(?:type\s+)?(?:\w+\s*,\s*)?\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]", "{}::{names}")], methods=True,
        heritage=[("extends", r"\bclass\s+\w+[^{\n]*?\bextends\s+([\w.]+)"), ("implements", r"\bclass\s+\w+[^{\n]*?\bimplements\s+([^{\n]+)")], types=[r":\s*([A-Z]\w*)(?=\s*[;,)={\n])"], fields_of=("class",),
    ),
    "csharp": Rules(
        heads=[
            ("class", rf"^[ \t]*{_MODS}(?:class|record)\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_MODS}interface\s+(?P<name>\w+)"), ("struct", rf"^[ \t]*{_MODS}struct\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_MODS}enum\s+(?P<name>\w+)"), ("type", rf"^[ \t]*{_MODS}delegate\s+{_TYPE}\s+(?P<name>\w+)"),
            ("function", rf"^[ \t]*{_MODS}(?!return\b|new\b|else\b|await\b|throw\b){_TYPE}\s+(?P<name>\w+)\s*(?:<[^>\n]*>)?\([^;{{]*\)\s*(?:where[^{{]+)?(?:\{{|=>|;)"), ("function", rf"^[ \t]*(?:public|private|protected|internal)\s+(?P<name>\w+)\s*\([^;{{]*\)\s*(?::\s*(?:base|this)\([^)]*\)\s*)?\{{"), ("property", rf"^[ \t]*{_MODS}(?!return\b|using\b|namespace\b){_TYPE}\s+(?P<name>\w+)\s*(?:\{{\s*(?:get|set|init)|=>)"),
        ],
        imports=[(r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;", "{}")], methods=True, heritage=[("implements", r"\b(?:class|struct|interface|record)\s+\w+(?:<[^>]*>)?\s*:\s*([^{\n]+)")],
    ),
    "java": Rules(
        heads=[
            ("class", rf"^[ \t]*{_MODS}(?:class|record)\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_MODS}@?interface\s+(?P<name>\w+)"), ("enum", rf"^[ \t]*{_MODS}enum\s+(?P<name>\w+)"),
            ("function", rf"^[ \t]*{_MODS}(?!return\b|new\b|else\b|throw\b)(?:<[^>\n]*>\s*)?{_TYPE}\s+(?P<name>\w+)\s*\([^;{{]*\)\s*(?:throws[^{{;]+)?[{{;]"), ("function", rf"^[ \t]*(?:public|private|protected)\s+(?P<name>\w+)\s*\([^;{{]*\)\s*(?:throws[^{{;]+)?\{{"), ("property", rf"^[ \t]*(?:public|private|protected)\s+{_MODS}{_TYPE}\s+(?P<name>\w+)\s*(?:=[^;]*)?;"),
        ],
        imports=[(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "{}")], methods=True, heritage=[("extends", r"\bclass\s+\w+[^{\n]*?\bextends\s+([\w.<>]+)"), ("implements", r"\b(?:class|enum|record)\s+\w+[^{\n]*?\bimplements\s+([^{\n]+)")],
    ),
    "kotlin": Rules(
        heads=[("class", rf"^[ \t]*{_MODS}(?:enum\s+|annotation\s+)?class\s+(?P<name>\w+)"), ("class", rf"^[ \t]*{_MODS}object\s+(?P<name>\w+)"), ("interface", rf"^[ \t]*{_MODS}interface\s+(?P<name>\w+)"), ("function", rf"^[ \t]*{_MODS}fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(?P<name>\w+)"), ("property", rf"^[ \t]*{_MODS}(?:val|var)\s+(?P<name>\w+)")],
        imports=[(r"^\s*import\s+([\w.*]+)", "{}")], new=None, heritage=[("implements", r"\b(?:class|object|interface)\s+\w+(?:\s*(?:<[^>]*>)?\s*(?:\([^)]*\))?)\s*:\s*([^{\n]+)")],
    ),
    "swift": Rules(
        heads=[("class", rf"^[ \t]*{_MODS}(?:class|struct|enum|actor)\s+(?!func\b|var\b)(?P<name>\w+)"), ("interface", rf"^[ \t]*{_MODS}protocol\s+(?P<name>\w+)"), ("function", rf"^[ \t]*{_MODS}(?:class\s+)?func\s+(?P<name>\w+)"), ("property", rf"^[ \t]*{_MODS}(?:let|var)\s+(?P<name>\w+)")],
        imports=[(r"^\s*import\s+([\w.]+)", "{}")], new=None, heritage=[("implements", r"\b(?:class|struct|enum|protocol|extension)\s+\w+(?:<[^>]*>)?\s*:\s*([^{\n]+)")], skip_owners=("super",),
        builtins=frozenset("print debugPrint fatalError precondition preconditionFailure assert min max abs zip stride type String Int Double Float Bool Array Dictionary Set".split()),
    ),
    "rust": Rules(
        heads=[("struct", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+(?P<name>\w+)"), ("enum", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("interface", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"), ("type", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)"), ("const", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z_]\w*)\s*:"), ("function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+|async\s+|unsafe\s+|extern\s+\S*\s*)*fn\s+(?P<name>\w+)")],
        strings=_CHARS, imports=[(r"^\s*(?:pub\s+)?use\s+((?:\w+::)*\w+)\s*;", "{}"), (r"^\s*(?:pub\s+)?use\s+((?:\w+::)*\w+)::\{", "{}")], new=None, joins=r"\.|::", show_owner=False, skip_owners=(), macros=True, call=r"(?:\(|(?<=!)[\[{])", types=[r"[:&>]\s*(?:mut\s+|dyn\s+)?([A-Z]\w*)"],
    ),
    "go": Rules(
        heads=[("method", r"^func\s*\([^)]*\)\s*(?P<name>\w+)"), ("function", r"^func\s+(?P<name>\w+)"), ("type", r"^[ \t]*type\s+(?P<name>\w+)"), ("const", r"^const\s+(?P<name>\w+)")],
        imports=[(r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"", "{}"), (r"^\t(?:\w+\s+)?\"([\w./-]+)\"\s*$", "{}")], new=r"(?<![\w.])&?([A-Z]\w*)\s*\{(?=[^{}]*[:}])", types=[r"\*([A-Z]\w*)\b", r"\w\s+([A-Z]\w*)\s*[,)]"], skip_owners=(),
    ),
    "php": Rules(
        heads=[("module", r"^[ \t]*namespace\s+(?P<name>[\w\\]+)"), ("class", rf"^[ \t]*{_MODS}class\s+(?P<name>\w+)"), ("interface", r"^[ \t]*(?:interface|trait)\s+(?P<name>\w+)"), ("enum", r"^[ \t]*enum\s+(?P<name>\w+)"), ("function", rf"^[ \t]*{_MODS}function\s+&?(?P<name>\w+)"), ("const", rf"^[ \t]*{_MODS}const\s+(?P<name>\w+)\s*="), ("property", rf"^[ \t]*(?:public|private|protected)\s+{_MODS}(?:\??[\w\\|]+\s+)?\$(?P<name>\w+)\s*[;=]")],
        comments=rf"{_C_COMMENT}|{_HASH_COMMENT}", imports=[(r"^use\s+([\w\\]+)", "{}")], methods=True, joins=r"->|::|\?->", heritage=[("extends", r"\bclass\s+\w+[^{\n]*?\bextends\s+(\w+)"), ("implements", r"\b(?:class|enum)\s+\w+[^{\n]*?\bimplements\s+([^{\n]+)")], edges=[("includes", r"^[ \t]+use\s+(\w+)\s*;")],
        builtins=frozenset("echo print isset unset empty count strlen array in_array array_map array_filter array_merge array_keys array_values implode explode sprintf printf is_null is_array json_encode json_decode die exit".split()),
    ),
    "ruby": Rules(
        heads=[("class", r"^[ \t]*class\s+(?P<name>[A-Z]\w*)"), ("module", r"^[ \t]*module\s+(?P<name>[A-Z]\w*)"), ("method", r"^[ \t]*(?:private\s+|protected\s+)?def\s+(?:self\.)?(?P<name>\w+[?!=]?)"), ("property", r"^[ \t]*attr_(?:reader|writer|accessor)\s+:(?P<name>\w+)")],
        comments=_HASH_COMMENT, imports=[(r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "{}")], end_words="class|module|def|if|unless|case|begin|while|until|for", new=None, heritage=[("extends", r"^\s*class\s+\w+\s*<\s*([\w:]+)")],
        edges=[("includes", r"^\s*include\s+([\w:]+)"), ("extends", r"^\s*extend\s+([\w:]+)"), ("calls", r"^[ \t]*(super)\b")], skip_owners=("self",), builtins=frozenset("puts print require require_relative raise p pp attr_reader attr_writer attr_accessor include extend private protected public lambda proc loop format sprintf".split()),
    ),
    "lua": Rules(
        heads=[("function", r"^[ \t]*(?:local\s+)?function\s+(?:[\w.]+[.:])?(?P<name>\w+)"), ("function", r"^[ \t]*(?:local\s+)?(?:[\w.]+\.)?(?P<name>\w+)\s*=\s*function\b")],
        comments=_DASH_COMMENT, imports=[(r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]", "{}")], end_words="if|for|while|repeat", new=None, joins=r"\.|:", skip_owners=(),
        builtins=frozenset("print require type tostring tonumber pairs ipairs next select error assert pcall xpcall setmetatable getmetatable rawget rawset unpack".split()),
    ),
    "bash": Rules(
        heads=[("function", r"^[ \t]*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)"), ("function", r"^[ \t]*function\s+(?P<name>[\w-]+)\s*\{")], comments=r"(?:(?<=\s)|^)#[^\n]*", imports=[(r"^\s*(?:source|\.)\s+(\S+)", "{}")], new=None, calls=False,
        edges=[("calls", r"^[ \t]*(?!(?:if|then|else|elif|fi|for|while|until|do|done|case|esac|function|local|return|export|source|echo|printf|read|cd|exit|set|unset|shift|test|eval|exec|trap|declare|readonly|true|false|in)\b)([A-Za-z_][\w-]*)(?=\s|$)(?!\s*\(\)|\s*=)")],
    ),
    "c": Rules(
        heads=[("struct", r"^[ \t]*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{"), ("enum", r"^[ \t]*(?:typedef\s+)?enum\s+(?P<name>\w+)\s*\{"), ("type", r"^[ \t]*typedef\s+[^;{]*?(?P<name>\w+)\s*;"), ("type", r"^\}\s*(?P<name>\w+)\s*;"), ("function", r"^(?!return|else)[A-Za-z_][\w \t*]*?[\s*](?P<name>\w+)\s*\([^;{}]*\)\s*\{")],
        strings=_CHARS, imports=[(r"^\s*#include\s*[<\"]([^>\"]+)[>\"]", "{}")], new=None, joins=r"\.|->", show_owner=False, skip_owners=(), calls_in=("function",), builtins=frozenset("printf fprintf sprintf snprintf malloc calloc realloc free memcpy memset memmove strlen strcmp strncmp strcpy strncpy strcat assert exit abort".split()),
    ),
    "cpp": Rules(
        heads=[("module", r"^[ \t]*namespace\s+(?P<name>[\w:]+)"), ("class", r"^[ \t]*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>\w+)(?=[^;]*?\{)"), ("struct", r"^[ \t]*(?:typedef\s+)?struct\s+(?P<name>\w+)(?=[^;()]*?\{)"), ("enum", r"^[ \t]*enum\s+(?:class\s+)?(?P<name>\w+)"), ("type", r"^[ \t]*(?:using\s+(?P<name>\w+)\s*=)"), ("function", r"^[ \t]*(?!return\b|else\b|new\b|delete\b|throw\b|using\b|typedef\b|case\b)(?:[\w:<>,*&~\[\] \t]+?[\s*&])?(?:\w+::)*(?P<name>~?\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?:noexcept\s*)?(?:override\s*)?(?::[^;{}]*)?\{")],
        strings=_CHARS, imports=[(r"^\s*#include\s*[<\"]([^>\"]+)[>\"]", "{}")], joins=r"\.|->|::", show_owner=False, skip_owners=(), calls_in=("function", "method"), heritage=[("extends", r"\b(?:class|struct)\s+\w+\s*(?:final\s*)?:\s*((?:(?:public|private|protected|virtual)\s+)*[\w:<>, ]+?)\s*\{")], builtins=frozenset("printf sizeof static_cast dynamic_cast const_cast reinterpret_cast move forward make_unique make_shared malloc free assert".split()),
    ),
    "protobuf": Rules(
        heads=[("class", r"^[ \t]*message\s+(?P<name>\w+)"), ("enum", r"^[ \t]*enum\s+(?P<name>\w+)"), ("interface", r"^[ \t]*service\s+(?P<name>\w+)"), ("method", r"^[ \t]*rpc\s+(?P<name>\w+)"), ("const", r"^[ \t]+(?P<name>[A-Z][A-Z0-9_]*)\s*=\s*\d+"), ("property", r"^[ \t]+(?:repeated\s+|optional\s+|required\s+)?(?:map\s*<[^>]*>|[\w.]+)\s+(?P<name>\w+)\s*=\s*\d+")],
        imports=[(r"^\s*import\s+(?:public\s+|weak\s+)?\"([^\"]+)\"", "{}")], new=None, calls=False,
        edges=[("references_type", r"^[ \t]+(?:repeated\s+|optional\s+|required\s+)?(?:\w+\.)*([A-Z]\w*)\s+\w+\s*=\s*\d"), ("references_type", r"\brpc\s+\w+\s*\(\s*(?:stream\s+)?(?:\w+\.)*(\w+)"), ("references_type", r"\breturns\s*\(\s*(?:stream\s+)?(?:\w+\.)*(\w+)")],
    ),
    "sql": Rules(
        heads=[("class", r"^[ \t]*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.]+)"), ("function", r"^[ \t]*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(?P<name>[\w.]+)"), ("property", r"^[ \t]+(?!primary\b|foreign\b|unique\b|check\b|constraint\b|select\b|from\b|join\b|where\b|group\b|order\b|return|begin|end)(?P<name>\w+)\s+(?:serial|bigserial|smallint|integer|int|bigint|decimal|numeric|real|double|float|text|varchar|char|boolean|bool|date|time|timestamp|timestamptz|uuid|json|jsonb|bytea|blob)\b")],
        comments=r"--[^\n]*|/\*.*?\*/", strings=r"'(?:''|[^'])*'", flags=re.M | re.I, new=None, joins="", builtins=frozenset("sum count avg min max coalesce now current_timestamp table returns select from values insert into create check primary key unique references foreign varchar decimal numeric char".split()),
        edges=[("references_type", r"\breferences\s+([\w.]+)"), ("references_type", r"\bfrom\s+(?!\()([\w.]+)"), ("references_type", r"\bjoin\s+([\w.]+)")],
    ),
}

register("python", extract_python)
for _language, _rules in RULES.items():
    register(_language, scan(_language, _rules))

ROWS = "what string, ordinal long, id string, name string, kind string, file_path string, line_start int, line_end int, signature string, docstring string, parent_id string, language string, metadata string, from_id string, to_id string"
_KINDS = [pa.int64() if c.split()[1] == "long" else pa.int32() if c.split()[1] == "int" else pa.string() for c in ROWS.split(", ")]
_NAMES = [c.split()[0] for c in ROWS.split(", ")]


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, language, content in zip(*(b.column(c).to_pylist() for c in ("file_path", "language", "content")), strict=True):
            text = (content or b"").decode("utf-8", "replace")
            found = REGISTRY[language](path, text) if language in REGISTRY else Found()
            rows = [{"what": "symbol", "ordinal": i, **s} for i, s in enumerate(found.symbols)]
            rows += [{"what": "edge", "ordinal": i, "from_id": scope or f"{path}::{MODULE}::{'class' if kind in ('extends', 'implements') else 'function'}", "to_id": to, "kind": kind, "file_path": path, "line_start": line, "language": language} for i, (scope, to, kind, line) in enumerate(found.edges)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) of files (file_path, language, content). Both come from one table of rows; save that one to parse once."""
    return split_rows(extracted_rows(files))


def extracted_rows(files: DataFrame) -> DataFrame:
    return files.select("file_path", "language", "content").mapInArrow(extract_batches, ROWS)


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    symbols = rows.where("what = 'symbol'").select("id", "name", "kind", "file_path", "line_start", "line_end", "signature", "docstring", "parent_id", "language", "metadata")
    edges = rows.where("what = 'edge'").select("from_id", "to_id", "kind", "file_path", F.col("line_start").alias("line"), "ordinal")
    return symbols.dropDuplicates(["id"]), first_wins(edges, "ordinal")


def merge_partial_classes(symbols: DataFrame) -> DataFrame:
    """Partial classes of one name as one: the first by id stays, children of the others are its own."""
    from pyspark.sql import Window

    partial = symbols.where((F.col("kind") == "class") & F.coalesce(F.get_json_object("metadata", "$.is_partial") == "true", F.lit(False)))
    first = partial.select("id", F.min("id").over(Window.partitionBy("name")).alias("_first"))
    gone = first.where("id <> _first")
    moved = symbols.join(gone.select(F.col("id").alias("parent_id"), "_first"), "parent_id", "left").withColumn("parent_id", F.coalesce("_first", "parent_id"))
    return moved.join(gone.select("id"), "id", "left_anti").select(*symbols.columns)
