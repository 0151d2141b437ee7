"""Chunkers of code as table functions: rows of definitions and chunks for each text, used by lateral joins in DataFrames and SQL.

A definition is found by a stack of brackets (by indentation in Python) over a text's tokens,
strings and comments apart.  No syntax tree is built: what counts is where named blocks begin
and end, and which block holds which.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:.*?)(?:"""|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|[{};]|\n|[^"\'`/{};\n]+|.', re.S)
_TYPE = re.compile(r"\b(class|interface|enum|record|struct|trait|object|namespace)\s+([A-Za-z_$][\w$]*)")
_NAMED = re.compile(r"\b(?:function|func|fn|fun)\b\s*\*?\s*(?:\([^()]*\)\s*)?([A-Za-z_$][\w$]*)")
_CALLED = re.compile(r"([A-Za-z_$~][\w$]*)\s*(?:<[^<>()]*>)?\s*\((?:[^()]|\([^()]*\))*\)\s*(?:const\b|throws\s+[\w.,\s]+|(?::|->)\s*[^(){};=]+)?\s*$")
_ARROW = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=]+)?=>\s*$")
#: Words before brackets that name no function.
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "synchronized", "using", "with", "when", "match", "foreach", "lock", "sizeof", "await", "throw", "elseif"}
_PYTHON = re.compile(r"([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z_]\w*)")
INDENTED = {"python", "py"}


@dataclass
class Definition:
    kind: str
    name: str
    start: int
    end: int = 0
    parents: list[str] = field(default_factory=list)
    signature: str = ""


def _header(text: str, in_type: bool) -> tuple[str, str] | None:
    if found := _TYPE.search(text):
        return found[1], found[2]
    if found := _NAMED.search(text) or _ARROW.search(text):
        return ("method" if in_type else "function"), found[1]
    if (found := _CALLED.search(text)) and found[1] not in _CONTROL and "=" not in text[: found.start()]:
        return ("method" if in_type else "function"), found[1]
    return None


def bracketed(text: str) -> list[Definition]:
    out, open_, head, line, head_line, literal = [], [], "", 1, 0, 0
    for token in _TOKEN.findall(text):
        if token == "{" and (literal or (head.count("(") > head.count(")") and head.rstrip()[-1:] in {"=", "(", ",", ":", "["})):
            literal += 1  # a value in brackets, such as a default, ends no header
        elif literal:
            literal -= token == "}"
        elif token == "{":
            named = [d for d in open_ if d]
            found = _header(head, bool(named) and named[-1].kind not in ("function", "method"))
            open_.append(Definition(found[0], found[1], head_line, parents=[d.name for d in named], signature=" ".join(head.split())) if found else None)
            head, head_line = "", 0
        elif token == "}":
            if open_ and (d := open_.pop()):
                d.end = line
                out.append(d)
            head, head_line = "", 0
        elif token == ";":
            head, head_line = "", 0
        elif token[:2] not in ("//", "/*"):
            if token.strip() and not head_line:
                head_line = line
            head += " " if token == "\n" else '""' if token[0] in "\"'`" and len(token) > 1 else token
        line += token.count("\n")
    for d in open_:  # never closed
        if d:
            d.end = line
            out.append(d)
    return sorted(out, key=lambda d: (d.start, -d.end))


def indented(text: str) -> list[Definition]:
    out, open_, last, depth, quote, decorated = [], [], 0, 0, "", 0
    lines = text.split("\n")
    for number, raw in enumerate(lines, 1):
        began = quote or depth > 0
        bare, at = [], 0
        while at < len(raw):
            if quote:
                end = raw.find(quote, at)
                at, quote = (len(raw), quote) if end < 0 else (end + 3, "")
            elif raw.startswith(('"""', "'''"), at):
                quote, at = raw[at : at + 3], at + 3
            elif raw[at] in "\"'":
                end = re.compile(r"(?:\\.|[^\\" + raw[at] + r"])*" + raw[at]).match(raw, at + 1)
                at = end.end() if end else len(raw)
            elif raw[at] == "#":
                break
            else:
                bare.append(raw[at])
                depth += (raw[at] in "([{") - (raw[at] in ")]}")
                at += 1
        depth = max(depth, 0)
        if not raw.strip() or (not began and raw.lstrip().startswith("#")):
            continue
        if not began:
            indent = len(raw.expandtabs()) - len(raw.expandtabs().lstrip())
            while open_ and indent <= open_[-1][0]:
                _, d = open_.pop()
                d.end = last
                out.append(d)
            if raw.lstrip().startswith("@"):
                decorated = decorated or number
            elif found := _PYTHON.match("".join(bare)):
                named = [d for _, d in open_]
                kind = "class" if found[2] == "class" else "method" if named and named[-1].kind == "class" else "function"
                open_.append((indent, Definition(kind, found[3], decorated or number, parents=[d.name for d in named], signature=" ".join(raw.split()))))
                decorated = 0
            else:
                decorated = 0
        last = number
    for _, d in open_:
        d.end = last
        out.append(d)
    return sorted(out, key=lambda d: (d.start, -d.end))


def definitions(text: str | None, language: str | None) -> list[Definition]:
    return [] if not text else indented(text) if (language or "").lower() in INDENTED else bracketed(text)


def chunks(text: str | None, language: str | None, most: int) -> Iterator[tuple]:
    """(chunk, kind, name, parent, start, end, content): every line of the text once, in order.

    A definition of ``most`` characters at most is a chunk; of a longer one its inner definitions
    are, and what stands between them; lines that no definition holds, and long stretches of a
    definition, are cut in groups of lines within ``most`` (a longer line is alone).
    """
    if not text:
        return
    lines = text.split("\n")
    size = [0]
    for x in lines:
        size.append(size[-1] + len(x) + 1)
    found = definitions(text, language)
    number, at = 0, 1

    def cut(kind: str, name: str, parent: str, first: int, last: int) -> Iterator[tuple]:
        nonlocal number
        while first <= last:
            end = first
            while end < last and size[end + 1] - size[first - 1] <= most:
                end += 1
            yield number, kind, name, parent, first, end, "\n".join(lines[first - 1 : end])
            number, first = number + 1, end + 1

    def walk(first: int, last: int, owner: Definition | None, inner: list[Definition]) -> Iterator[tuple]:
        nonlocal at
        mine = ("module", "", "") if owner is None else (owner.kind, owner.name, ".".join(owner.parents))
        while inner:
            d = inner[0]
            below = [x for x in inner[1:] if x.start <= d.end]
            inner = inner[1 + len(below) :]
            start, end = max(d.start, first), min(d.end, last)
            if start > end:
                continue  # it shares its line with the one before
            yield from cut(*mine, first, start - 1)
            if size[end] - size[start - 1] <= most or not below:
                yield from cut(d.kind, d.name, ".".join(d.parents), start, end)
            else:
                yield from walk(start, end, d, below)
            first = end + 1
        yield from cut(*mine, first, last)

    yield from walk(1, len(lines), None, found)


_DEFINITION = "kind string, name string, parent string, start_line int, end_line int, signature string"


@udtf(returnType=_DEFINITION, useArrow=True)
class Definitions:
    """definitions(text, language): the named blocks of a text, by where they begin."""

    def eval(self, text: str, language: str):
        for d in definitions(text, language):
            yield d.kind, d.name, ".".join(d.parents), d.start, d.end, d.signature


@udtf
class CodeChunks:
    """code_chunks(text, language, most[, signatures]): chunks of a text; with a third constant true, a column for the first line too."""

    @staticmethod
    def analyze(text: AnalyzeArgument, language: AnalyzeArgument, most: AnalyzeArgument, first_line: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not most.isConstantExpression or not isinstance(most.value, int) or most.value < 1:
            raise ValueError("code_chunks: the size must be a constant of 1 at least")
        schema = StructType().add("chunk", IntegerType())
        for name, kind in (("kind", StringType()), ("name", StringType()), ("parent", StringType()), ("start_line", IntegerType()), ("end_line", IntegerType()), ("content", StringType())):
            schema = schema.add(name, kind)
        return AnalyzeResult(schema.add("first_line", StringType()) if first_line and first_line.value else schema)

    def eval(self, text: str, language: str, most: int, first_line: bool = False):
        for row in chunks(text, language, most):
            yield (*row, row[-1].partition("\n")[0].strip()) if first_line else row


def register(spark: SparkSession) -> None:
    """Makes ``definitions`` and ``code_chunks`` known to SQL."""
    spark.udtf.register("definitions", Definitions)
    spark.udtf.register("code_chunks", CodeChunks)
