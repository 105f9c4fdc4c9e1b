"""Column functions on paths, languages, byte ranges, hashes and summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file extension.
LANGUAGE_BY_EXTENSION = {
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".php": "php", ".dart": "dart", ".swift": "swift", ".cs": "csharp", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp",
}
#: Fixed value: bytes that stand for one token in savings estimates.
BYTES_PER_TOKEN = 4


def glob_to_regex(pattern: str, anchored: bool) -> str:
    """``*`` stands for any characters (``/`` too), ``?`` for one; everything else is literal."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) if not c.isalnum() and c != "_" else c for c in re.sub(r"\*+", "*", pattern))
    return f"^{body}$" if anchored else body


def plain_path(path: Column) -> Column:
    """Relative path with ``/`` between parts, no ``./``, no doubled or leading slashes."""
    slashed = F.regexp_replace(F.trim(path), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(slashed, r"/(\./|/)*", "/"), r"^(\./+|/)+", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The extension with its dot, in lower case; empty for hidden files without another dot."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    """The language of a path by its extension; null for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.try_element_at(table, extension(path))


def byte_slice(content: Column, offset: Column, length: Column) -> Column:
    """The bytes of a text from a zero-based offset, as binary."""
    return F.substring(F.encode(content, "UTF-8"), (offset + 1).cast("int"), length.cast("int"))


def byte_text(content: Column, offset: Column, length: Column) -> Column:
    """The same as text; bytes of a character that was cut through become U+FFFD."""
    return F.make_valid_utf8(byte_slice(content, offset, length).cast("string"))


def symbol_id(file: Column, qualified_name: Column, kind: Column) -> Column:
    return F.concat(file, F.lit("::"), qualified_name, F.lit("#"), kind)


def docstring_summary(docstring: Column) -> Column:
    """First line without comment marks, up to its first full stop, at most 120 characters; null if ten or fewer."""
    line = F.trim(F.regexp_replace(F.split_part(F.trim(docstring), F.lit("\n"), F.lit(1)), r"^[/*#\s]+", ""))
    stop = F.instr(line, ".")
    cut = F.when(stop > 1, F.substring(line, F.lit(1), stop)).otherwise(line)
    return F.when(F.length(cut) > 10, F.substring(cut, 1, 120))


def signature_summary(kind: Column, name: Column, signature: Column) -> Column:
    return F.concat(F.initcap(kind), F.lit(" '"), name, F.lit("': "), F.substring(signature, 1, 80))


#: Fixed value: what a summarizer is asked.
PROMPT_HEAD = "For each numbered code symbol below, write ONE short sentence (max 15 words) describing what it does. Focus on behavior, not implementation. Reply with ONLY numbered lines matching the input order."


def prompt_item(number: Column, kind: Column, qualified_name: Column, signature: Column, docstring: Column) -> Column:
    """What a prompt says of one symbol; its documentation to 200 characters, if it has any."""
    told = F.when(F.coalesce(docstring, F.lit("")) != "", F.concat(F.lit("Docstring: "), F.substring(docstring, 1, 200))).otherwise("")
    return F.concat(number.cast("string"), F.lit(". ["), kind, F.lit("] "), qualified_name, F.lit("\n   Signature: "), signature, F.lit("\n   "), told)


def prompt_line(number: Column, kind: Column, signature: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(". "), kind, F.lit(": "), F.substring(signature, 1, 200))


def numbered_answers(response: Column, count: Column | None = None) -> Column:
    """The answers of a numbered list, in order; numbers before leading blanks stay. With ``count`` exactly so many, empty ones at the end."""
    lines = F.filter(F.split(response, "\n"), lambda x: x.rlike(r"^\s*\d+\."))
    found = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\d+\.\s*", "")))
    if count is None:
        return found
    return F.slice(F.concat(found, F.array_repeat(F.lit(""), F.greatest(count - F.size(found), F.lit(0)).cast("int"))), F.lit(1), count.cast("int"))


def tokens_saved(raw_bytes: Column, response_bytes: Column) -> Column:
    return F.floor(F.greatest(F.lit(0), raw_bytes - response_bytes) / BYTES_PER_TOKEN).cast("long")


def repository_of(url: Column) -> Column:
    """``owner/name`` of a repository's address in any of its spellings; null without two parts."""
    path = F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?:[a-zA-Z+]+://)?(?:[^/@]*@)?(?:www\.)?github\.com[:/]", ""), r"(?:\.git)?/*$", "")
    return F.when(path.rlike(r"^[\w.-]+/[\w.-]+"), F.regexp_extract(path, r"^([\w.-]+/[\w.-]+)", 1))
