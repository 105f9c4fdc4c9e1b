"""From file rows to symbol rows: a table function that runs where the files are read.

Python files are read with the standard library's syntax tree; the other languages by the declarations that one pass
over their tokens meets (:mod:`symbolith.operators.declarations`). A Python text that is no valid one is read by its
declaration patterns and indentation. Texts with errors keep the symbols that can be made out; their number of errors
is told beside them.
"""

from __future__ import annotations

import ast
import hashlib
import inspect
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolith.operators.declarations import TOKENS, declarations

NAME = r"[^\W\d][\w$]*"
_PYTHON_BLANK = re.compile(r"#[^\n]*|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*+\"?|'(?:[^'\\\n]|\\[\s\S])*+'?")
_DOCSTRING = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\r?\n)*[ \t]*[rRuU]?(\"\"\"|'''|\"|')((?:\\[\s\S]|(?!\1)[^\\])*+)\1")
#: Languages whose nested names are joined by ``::``.
COLONS = ("rust", "go", "c", "cpp")
#: Extensions of headers, which are C or C++.
HEADERS = (".h",)
COLUMNS = "repo string, file string, id string, name string, qualified_name string, kind string, signature string, language string, line int, end_line int, byte_offset long, byte_length long, docstring string, parent string, decorators array<string>, content_hash string, symbol_seq long"
STATUS = "repo string, file string, language string, parse_status string, parse_errors long, symbols long"


def signature_of(text: str) -> str:
    return re.sub(r"\s*\{?\s*$", "", re.sub(r"\s+", " ", text).strip())


def by_declarations(text: str, language: str) -> tuple[list[tuple], int]:
    """(name, kind, start, end, signature, docstring, decorators, place of the container around it) in order of start, and the number of errors."""
    found, source = declarations(text, language)
    comments: dict[int, list[tuple[int, int]]] = {}
    for before, start, end in source.comments:
        comments.setdefault(before, []).append((start, end))
    rows = []
    for d in found:
        said: list[str] = []
        for at, end in reversed(comments.get(d.before, [])):
            # comments that share their line with code speak of that code
            line = text[text.rfind("\n", 0, at) + 1 : at]
            if line.strip():
                break
            said.append(text[at:end].rstrip())
        rows.append((d.name, d.kind, d.start, d.end, signature_of(text[d.start : d.head_end]), "\n".join(reversed(said)), d.decorators, d.inside))
    return rows, source.errors


def by_tree(text: str) -> list[tuple]:
    """As ``by_patterns``, of all definitions, those in functions and in branches of any statement included."""
    rows: list[tuple] = []
    raw = text.encode()
    starts = [0, *(m.end() for m in re.finditer(rb"\n", raw))]
    # places in bytes are those in characters unless the line has others than ASCII
    chars = [0]
    for a, b in zip(starts, [*starts[1:], len(raw)]):
        chars.append(chars[-1] + len(raw[a:b].decode()))
    at = lambda line, column: chars[line - 1] + len(raw[starts[line - 1] : starts[line - 1] + column].decode())
    waiting: list[ast.AST] = [ast.parse(text)]
    while waiting:
        node = waiting.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            column = node.col_offset
            start, end = at(first, column), at(node.end_lineno, node.end_col_offset)
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            if node.decorator_list:
                # the reference names the outer node: its first line is the signature, and it has no body to look for a string in
                marks = [text[at(d.lineno, d.col_offset) : at(d.end_lineno, d.end_col_offset)] for d in node.decorator_list]
                rows.append((node.name, kind, start, end, text[start:end].split("\n")[0].strip(), "", ["@" + m for m in marks]))
            else:
                head = text[start : at(node.body[0].lineno, 0)].split(":\n")[0]
                rows.append((node.name, kind, start, end, signature_of(head).rstrip(":"), (ast.get_docstring(node) or "").strip(), []))
            if node.decorator_list and not isinstance(node, ast.ClassDef):
                continue  # the reference doesn't go into decorated functions
        waiting += [x for x in ast.iter_child_nodes(node) if isinstance(x, (ast.stmt, ast.excepthandler, ast.match_case))]
    return rows


def by_indentation(text: str) -> list[tuple]:
    """As ``by_tree``, of a Python text that is no valid one: a definition ends before the next line that isn't indented deeper.

    Text in strings and comments declares nothing. A string that never ends counts to the end of its line.
    """
    code = _PYTHON_BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    lines = [(m.start(), m.end(), len(m.group(1).expandtabs())) for m in re.finditer(r"^([ \t\f]*)(?=\S).*", code, re.M)]
    place = {start: i for i, (start, _, _) in enumerate(lines)}
    rows: list[tuple] = []
    decorated_until = -1
    for m in re.finditer(rf"^([ \t\f]*)((?:async[ \t]+)?def|class)[ \t]+({NAME})", code, re.M):
        if m.start() < decorated_until:
            continue
        first = at = place[m.start()]
        indent = lines[at][2]
        while first and lines[first - 1][2] == indent and code[lines[first - 1][0] : lines[first - 1][1]].lstrip().startswith("@"):
            first -= 1
        head_end = head_of(code, m.end())
        inside = at + 1
        while inside < len(lines) and (lines[inside][2] > indent or lines[inside][0] < head_end):
            inside += 1
        start = lines[first][0] + len(m.group(1))
        # the last line of the body may be a string, which is blank in the code
        limit = lines[inside][0] if inside < len(lines) else len(text)
        end = max(m.end(), start + len(text[start : ends_at(text, lines[inside - 1][1], limit, indent)].rstrip()))
        doc = _DOCSTRING.match(text, head_end + 1) if code[head_end : head_end + 1] == ":" else None
        kind = "class" if m.group(2) == "class" else "function"
        if first < at:
            marks = [text[a:b].strip() for a, b, _ in lines[first:at]]
            rows.append((m.group(3), kind, start, end, text[start:end].split("\n")[0].strip(), "", marks))
        else:
            rows.append((m.group(3), kind, start, end, signature_of(text[m.start(2) : head_end]), inspect.cleandoc(doc.group(2).replace("\r\n", "\n")).strip() if doc else "", []))
        if kind == "function" and first < at:
            decorated_until = end
    return rows


def head_of(code: str, at: int) -> int:
    """Where the head of a definition ends: at the colon outside brackets, or at the end of a line that can't go on."""
    depth = 0
    for m in re.compile(r"[()\[\]{}:]|\n(?=[ \t]*(?:(?:async[ \t]+)?def|class|return|@\w+)\b)|\n[ \t\r]*(?=\n)").finditer(code, at):
        mark = m.group()[0]
        if mark == "\n" or (mark == ":" and depth <= 0):
            return m.start()
        depth += (mark in "([{") - (mark in ")]}")
    return len(code)


def ends_at(text: str, end: int, limit: int, indent: int) -> int:
    """``end``, or the end of the strings indented deeper behind it."""
    for m in re.compile(r"^([ \t\f]*)(?=[rRbBuUfF]*[\"'])", re.M).finditer(text, end, limit):
        if len(m.group(1).expandtabs()) > indent:
            string = _PYTHON_BLANK.search(text, m.end(), limit)
            end = string.end() if string else end
    return end


def symbols_of(path: str, text: str, language: str) -> tuple[list[dict], int]:
    """The symbols of a file, children after their parents, and the number of errors met.

    Of a text with errors the symbols are those that can be made out. A header whose C reading meets errors is read as
    C++ if that meets fewer.
    """
    errors = 0
    if language == "python":
        try:
            found = by_tree(text)
        except (SyntaxError, ValueError, RecursionError, IndexError, MemoryError):
            found, errors = by_indentation(text), 1
    elif language in TOKENS:
        found, errors = by_declarations(text, language)
        if errors and path.lower().endswith(HEADERS):
            other, fewer = by_declarations(text, "cpp")
            if fewer < errors:
                found, errors = other, fewer
    else:
        return [], 0
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    ascii_only = text.isascii()
    places = sorted({x for f in found for x in f[2:4]})
    offsets, last, count = {}, 0, 0
    for place in places:
        count += place - last if ascii_only else len(text[last:place].encode("utf-8", "surrogatepass"))
        offsets[place], last = count, place
    separator = "::" if language in COLONS else "."
    out: list[dict] = []
    scopes: list[list[str]] = []
    open_: list[tuple[int, int]] = []
    for n, (name, kind, start, end, signature, docstring, decorators, *inside) in enumerate(found if language != "python" else sorted(found, key=lambda f: (f[2], -f[3]))):
        if inside:
            around = inside[0]
        else:
            while open_ and open_[-1][0] <= start:
                open_.pop()
            around = open_[-1][1] if open_ else None
            if kind == "class":
                open_.append((end, n))
        scope = [*scopes[around], out[around]["name"]] if around is not None else []
        scopes.append(scope)
        qualified = separator.join([*scope, name])
        source = text[start:end]
        out.append(
            {
                "id": f"{path}::{qualified}#{kind}", "name": name, "qualified_name": qualified, "kind": kind, "signature": signature, "line": bisect_right(lines, start),
                "end_line": bisect_right(lines, max(start, end - 1)), "byte_offset": offsets[start], "byte_length": offsets[end] - offsets[start], "docstring": docstring,
                "parent": out[around]["id"] if around is not None else None, "decorators": decorators, "content_hash": hashlib.sha256(source.encode("utf-8", "surrogatepass")).hexdigest(),
            }
        )
    same: dict[str, int] = {}
    for row in out:
        same[row["id"]] = same.get(row["id"], 0) + 1
    number: dict[str, int] = {}
    for row in out:
        base = row["id"]
        if same[base] > 1:
            number[base] = number.get(base, 0) + 1
            row["id"] = f"{base}~{number[base]}"
    return out, errors


def parsed(files: DataFrame) -> DataFrame:
    """Symbol rows of (repo, path, language, content, file_seq); rows of one file keep their order in symbol_seq."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            rows = []
            for repo, path, language, content in zip(batch["repo"], batch["path"], batch["language"], batch["content"]):
                if content is None or language is None:
                    continue
                rows += [{"repo": repo, "file": path, "language": language, "symbol_seq": i, **row} for i, row in enumerate(symbols_of(path, content, language)[0])]
            yield pd.DataFrame(rows, columns=names)

    return files.select("repo", "path", "language", "content").mapInPandas(run, COLUMNS).where(F.col("id").isNotNull())


def parse_status(files: DataFrame) -> DataFrame:
    """(repo, file, language, parse_status, parse_errors, symbols) per file: ``ok``, ``errors``, or ``unread`` for a null text or no language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATUS.split(", ")]
        for batch in batches:
            rows = []
            for repo, path, language, content in zip(batch["repo"], batch["path"], batch["language"], batch["content"]):
                if content is None or language is None:
                    rows.append((repo, path, language, "unread", 0, 0))
                    continue
                found, errors = symbols_of(path, content, language)
                rows.append((repo, path, language, "errors" if errors else "ok", errors, len(found)))
            yield pd.DataFrame(rows, columns=names)

    return files.select("repo", "path", "language", "content").mapInPandas(run, STATUS)
