"""Shared parts of the recursive-descent parsers: tokens, panic-mode recovery, precedence climbing."""

from __future__ import annotations

import re
from bisect import bisect_right

OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = {v: k for k, v in OPEN.items()}


class Problem(Exception):
    """A syntax error at a token."""

    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at = at
        self.message = message


class Tokens:
    """Parallel lists of kinds, starts and ends; a keyword or sign is its own kind, else ``id``, ``num``, ``str``, ``bad``."""

    __slots__ = ("kinds", "starts", "ends", "errors")

    def __init__(self) -> None:
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.errors: list[tuple[int, str]] = []

    def add(self, kind: str, start: int, end: int) -> None:
        self.kinds.append(kind)
        self.starts.append(start)
        self.ends.append(end)


def scan(text: str, pattern: re.Pattern, keywords: frozenset[str]) -> Tokens:
    """Tokens by one alternation with the groups id, op, num, str, skip and bad; white space matches none of them."""
    out = Tokens()
    kinds, starts, ends = out.kinds, out.starts, out.ends
    for m in pattern.finditer(text):
        group = m.lastgroup
        if group == "skip":
            continue
        if group == "op":
            kind = m.group()
        elif group == "id":
            kind = m.group()
            if kind not in keywords:
                kind = "id"
        else:
            kind = group
            if group == "bad":
                out.errors.append((m.start(), "character or quote that starts no token"))
        kinds.append(kind)
        starts.append(m.start())
        ends.append(m.end())
    return out


class Parser:
    """Recursive descent over :class:`Tokens`; subclasses give ``unit`` and ``statement``."""

    #: Binary operators by binding power; higher binds tighter.
    BINARY: dict[str, int] = {}

    def __init__(self, text: str, tokens: Tokens):
        self.text = text
        self.K = tokens.kinds
        self.S = tokens.starts
        self.E = tokens.ends
        self.n = len(self.K)
        self.errors: list[tuple[int, str]] = list(tokens.errors)
        self.K += ["eof"] * 4
        self.S += [len(text)] * 4
        self.E += [len(text)] * 4
        self.i = 0
        self.partner = self._partners()

    def _partners(self) -> dict[int, int]:
        """Index of the closing bracket of each opening one, where brackets nest."""
        stack: list[int] = []
        partner: dict[int, int] = {}
        K = self.K
        for i in range(self.n):
            k = K[i]
            if k in OPEN:
                stack.append(i)
            elif k in CLOSE:
                if stack and K[stack[-1]] == CLOSE[k]:
                    partner[stack.pop()] = i
                else:
                    while stack and K[stack[-1]] != CLOSE[k]:
                        stack.pop()
                    if stack:
                        partner[stack.pop()] = i
        return partner

    # -- moving

    def fail(self, message: str = "") -> Problem:
        k = self.K[self.i]
        return Problem(self.i, message or f"unexpected {self.word() if k != 'eof' else 'end of file'}")

    def word(self, ahead: int = 0) -> str:
        i = self.i + ahead
        return self.text[self.S[i] : self.E[i]]

    def at(self, *kinds: str) -> bool:
        return self.K[self.i] in kinds

    def take(self, kind: str) -> bool:
        if self.K[self.i] == kind:
            self.i += 1
            return True
        return False

    def need(self, kind: str) -> None:
        if self.K[self.i] != kind:
            k = self.K[self.i]
            raise Problem(self.i, f"expected {kind}, found {'end of file' if k == 'eof' else self.word()[:40]}")
        self.i += 1

    def need_any(self, *kinds: str) -> None:
        if self.K[self.i] not in kinds:
            raise self.fail()
        self.i += 1

    def is_word(self, *words: str) -> bool:
        return self.K[self.i] == "id" and self.word() in words

    def attempt(self, rule, *args) -> bool:
        """Whether ``rule`` parses here; if not, nothing is consumed."""
        at = self.i
        try:
            # a call with unpacked arguments would lie on the stack of C, which is short
            rule(*args) if args else rule()
            return True
        except Problem:
            self.i = at
            return False

    def newline_before(self) -> bool:
        i = self.i
        return i == 0 or self.K[i] == "eof" or "\n" in self.text[self.E[i - 1] : self.S[i]]

    # -- recovery

    def recover(self, start: int) -> None:
        """Panic mode: skip to behind the next ``;`` or to a closing brace of this level, whole bracket groups at once."""
        if self.i <= start:
            self.i = start
        while True:
            k = self.K[self.i]
            if k == "eof" or (k == "}" and self.i > start):
                return
            if k in OPEN and self.i in self.partner:
                self.i = self.partner[self.i]
                if k == "{":
                    self.i += 1
                    return
            self.i += 1
            if k == ";":
                return

    def guarded(self, rule) -> None:
        """``rule``, with an error recorded and skipped instead of raised."""
        start = self.i
        try:
            rule()
        except Problem as p:
            self.errors.append((self.S[min(p.at, self.n)], p.message))
            self.i = max(self.i, p.at)
            self.recover(start)
            if self.i == start:
                self.i += 1

    def statements_until(self, end: str, rule) -> None:
        """Guarded ``rule`` up to the sign ``end``, which is consumed."""
        K = self.K
        while K[self.i] != end:
            if K[self.i] == "eof":
                raise self.fail(f"expected {end}, found end of file")
            self.guarded(rule)
        self.i += 1

    def run(self) -> list[tuple[int, str]]:
        """All errors as (offset, message), in order."""
        while self.K[self.i] != "eof":
            self.guarded(self.unit)
        return sorted(set(self.errors))

    def unit(self) -> None:
        raise NotImplementedError

    # -- expressions

    def binary(self, least: int = 0) -> None:
        """Precedence climbing over the operators of ``BINARY``."""
        self.unary()
        K, power = self.K, self.BINARY
        while True:
            p = power.get(K[self.i], -1)
            if p < least:
                return
            self.i += 1
            self.binary(p + 1)

    def unary(self) -> None:
        raise NotImplementedError

    def separated(self, rule, end: str, trailing: bool = True) -> None:
        """``rule`` separated by commas up to ``end``, which is consumed."""
        if self.take(end):
            return
        while True:
            rule()
            if self.take(end):
                return
            self.need(",")
            if trailing and self.take(end):
                return


def line_of(text: str) -> list[int]:
    """Starts of the lines, for :func:`line_at`."""
    return [0, *(m.end() for m in re.finditer("\n", text))]


def line_at(starts: list[int], offset: int) -> int:
    return bisect_right(starts, offset)
