"""Parsing expression grammars with packrat memory.

A grammar is text: ``Name <- expression`` per rule. An expression knows sequence, ordered choice ``/``, ``*``, ``+``,
``?``, predicates ``&`` and ``!``, groups, rule names, ``"literals"``, regular expressions between backticks, and
captures ``name:item``. Matching gives the end and the captures with their source offsets. A rule's semantic action
replaces what it captured.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Captures = tuple[tuple, ...]
Match = tuple[int, Captures] | None
Matcher = Callable[[str, int, dict], Match]
Action = Callable[[str, int, int, Captures], Captures]

_SCAN = re.compile(r"\s*(?:(?P<arrow><-)|(?P<label>\w+):|(?P<name>\w+)|\"(?P<literal>(?:[^\"\\]|\\.)*)\"|`(?P<regex>[^`]*)`|(?P<sign>[/*+?&!()]))")


class Grammar:
    def __init__(self, text: str, actions: dict[str, Action] | None = None):
        self.rules: dict[str, Matcher] = {}
        self.actions = actions or {}
        self.source: list[tuple[str, str]] = []
        text = re.sub(r"^\s*#.*$", "", text, flags=re.M)
        at = 0
        while m := _SCAN.match(text, at):
            self.source.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        if text[at:].strip():
            raise ValueError(f"grammar: {text[at:at + 40]!r}")
        self.at = 0
        first = None
        while self.at < len(self.source):
            name = self._take("name")
            self._take("arrow")
            self.rules[name] = self._remembered(name, self._choice())
            first = first or name
        self.first = first

    def _peek(self) -> tuple[str, str]:
        if self.at + 1 < len(self.source) and self.source[self.at + 1][0] == "arrow":
            return "end", ""
        return self.source[self.at] if self.at < len(self.source) else ("end", "")

    def _take(self, kind: str) -> str:
        found, value = self.source[self.at]
        if found != kind:
            raise ValueError(f"grammar: expected {kind}, found {value}")
        self.at += 1
        return value

    def _choice(self) -> Matcher:
        options = [self._sequence()]
        while self._peek() == ("sign", "/"):
            self.at += 1
            options.append(self._sequence())
        return options[0] if len(options) == 1 else choice(options)

    def _sequence(self) -> Matcher:
        items = []
        while self._peek()[0] != "end" and self._peek() not in (("sign", "/"), ("sign", ")")):
            items.append(self._item())
        return items[0] if len(items) == 1 else sequence(items)

    def _item(self) -> Matcher:
        kind, value = self._peek()
        self.at += 1
        if kind == "label":
            return labelled(value, self._item())
        if kind == "sign" and value in "&!":
            return predicate(self._item(), value == "&")
        if kind == "literal":
            item = terminal(re.escape(value.replace('\\"', '"').replace("\\\\", "\\")))
        elif kind == "regex":
            item = terminal(value)
        elif kind == "sign" and value == "(":
            item = self._choice()
            if self._peek() != ("sign", ")"):
                raise ValueError("grammar: expected )")
            self.at += 1
        elif kind == "name":
            item = self._reference(value)
        else:
            raise ValueError(f"grammar: unexpected {value}")
        while self._peek() in (("sign", "*"), ("sign", "+"), ("sign", "?")):
            item = repeated(item, self._peek()[1])
            self.at += 1
        return item

    def _reference(self, name: str) -> Matcher:
        rules = self.rules
        return lambda text, at, memory: rules[name](text, at, memory)

    def _remembered(self, name: str, inner: Matcher) -> Matcher:
        action = self.actions.get(name)

        def rule(text: str, at: int, memory: dict) -> Match:
            key = (name, at)
            if key in memory:
                return memory[key]
            found = inner(text, at, memory)
            if found is not None and action is not None:
                found = (found[0], action(text, at, found[0], found[1]))
            memory[key] = found
            return found

        return rule

    def parse(self, text: str) -> Match:
        """The match of the first rule at the start of ``text``."""
        return self.rules[self.first](text, 0, {})


def terminal(pattern: str) -> Matcher:
    match = re.compile(pattern).match

    def matcher(text: str, at: int, memory: dict) -> Match:
        m = match(text, at)
        return None if m is None else (m.end(), ())

    return matcher


def sequence(items: list[Matcher]) -> Matcher:
    def matcher(text: str, at: int, memory: dict) -> Match:
        captures: Captures = ()
        for item in items:
            found = item(text, at, memory)
            if found is None:
                return None
            at = found[0]
            if found[1]:
                captures += found[1]
        return at, captures

    return matcher


def choice(options: list[Matcher]) -> Matcher:
    def matcher(text: str, at: int, memory: dict) -> Match:
        for option in options:
            found = option(text, at, memory)
            if found is not None:
                return found
        return None

    return matcher


def repeated(item: Matcher, sign: str) -> Matcher:
    def matcher(text: str, at: int, memory: dict) -> Match:
        captures: list[tuple] = []
        count = 0
        while True:
            found = item(text, at, memory)
            if found is None:
                break
            count += 1
            captures += found[1]
            if sign == "?" or found[0] == at:
                at = found[0]
                break
            at = found[0]
        return None if sign == "+" and not count else (at, tuple(captures))

    return matcher


def predicate(item: Matcher, wanted: bool) -> Matcher:
    return lambda text, at, memory: (at, ()) if (item(text, at, memory) is not None) == wanted else None


def labelled(name: str, item: Matcher) -> Matcher:
    def matcher(text: str, at: int, memory: dict) -> Match:
        found = item(text, at, memory)
        return None if found is None else (found[0], ((name, at, found[0]), *found[1]))

    return matcher
