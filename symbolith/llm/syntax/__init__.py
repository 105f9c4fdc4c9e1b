"""Parsers of the eight languages of the corpus, found by a file's extension."""

from __future__ import annotations

import sys
from collections.abc import Callable

from symbolith.llm.syntax import c, csharp, go, java, javascript, python, rust

Check = Callable[[str, str], list[tuple[int, str]]]

#: Extension to language and parser.
BY_EXTENSION: dict[str, tuple[str, Check]] = {
    "py": ("python", python.check),
    "pyi": ("python", python.check),
    **{e: ("javascript", javascript.check) for e in ("js", "mjs", "cjs", "jsx")},
    **{e: ("typescript", javascript.check) for e in ("ts", "mts", "cts", "tsx")},
    "go": ("go", go.check),
    "java": ("java", java.check),
    "rs": ("rust", rust.check),
    "cs": ("csharp", csharp.check),
    "c": ("c", c.check),
    "h": ("c", c.check),
}
LANGUAGES = {extension: language for extension, (language, _) in BY_EXTENSION.items()}
#: Frames that a text may take, which is some 20,000 nested brackets. Frames of Python functions lie on the heap.
DEEPEST = 400_000


def allow_nesting() -> None:
    """Lets grammars and parsers recurse as deep as DEEPEST."""
    if sys.getrecursionlimit() < DEEPEST:
        sys.setrecursionlimit(DEEPEST)


def check(text: str, extension: str) -> list[tuple[int, str]] | None:
    """All syntax errors (offset, message) of ``text``; blank text has none.

    None for an unknown extension, and for a text nested too deep to be read (DEEPEST), of which nothing can be said.
    """
    known = BY_EXTENSION.get(extension)
    if known is None:
        return None
    if not text.strip():
        return []
    allow_nesting()
    text = text.removeprefix("﻿")
    try:
        return known[1](text, extension)
    except RecursionError:
        return None
