"""Python 3."""

from __future__ import annotations

import re

from symbolith.llm.syntax.core import CLOSE, OPEN, Parser, Tokens

TOKEN = re.compile(
    r"""(?P<nl>\r?\n|\r)|(?P<skip>\#[^\n]*|\\\r?\n|[ \t\f﻿]+)
    |(?P<prefix>(?:[rR][bBfFtT]?|[bBfFtT][rR]?|[uU])?(?P<quote>\"\"\"|'''|"|'))
    |(?P<num>0[xX](?:_?[\da-fA-F])+(?!\w)|0[bB](?:_?[01])+(?!\w)|0[oO](?:_?[0-7])+(?!\w)
        |(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?(?=\b|\W|$)(?!\w))
    |(?P<id>[^\W\d]\w*)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|==|<=|>=|:=|->|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[{}()\[\]:;,.@=+\-*/%&|^~<>])
    |(?P<bad>.)""",
    re.X,
)
#: Reserved words of the language.
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
ENDING = {q: re.compile(rf"(?:[^\\{q[0]}\n]|\\[\s\S])*{q}" if len(q) == 1 else rf"(?:[^\\]|\\[\s\S])*?{q}") for q in ('"', "'", '"""', "'''")}
LEADING_ZERO = re.compile(r"0[\d_]*[1-9]")


def tokens(text: str) -> Tokens:
    """Tokens with ``newline``, ``indent`` and ``dedent``."""
    out = Tokens()
    depth: list[tuple[str, int]] = []
    levels = [""]
    pos, size, fresh = 0, len(text), True
    blank = re.compile(r"[ \t\f]*(?:#[^\n]*)?(?:\r?\n|\r|$)")
    indentation = re.compile(r"[ \t\f]*")
    continued = False
    while pos < size:
        if fresh and not depth and not continued:
            b = blank.match(text, pos)
            if b and b.end() > pos:
                pos = b.end()
                continue
            i = indentation.match(text, pos)
            pos, level = i.end(), i.group().replace("\f", "")
            if level != levels[-1]:
                wide = len(level.expandtabs())
                if wide > len(levels[-1].expandtabs()):
                    if not level.startswith(levels[-1]):
                        out.errors.append((pos, "inconsistent use of tabs and spaces"))
                    levels.append(level)
                    out.add("indent", pos, pos)
                else:
                    while len(levels[-1].expandtabs()) > wide:
                        levels.pop()
                        out.add("dedent", pos, pos)
                    if levels[-1] != level:
                        out.errors.append((pos, "unindent matches no outer level" if len(levels[-1].expandtabs()) != wide else "inconsistent use of tabs and spaces"))
                        if len(levels[-1].expandtabs()) != wide:
                            levels.append(level)
                            out.add("indent", pos, pos)
            fresh = False
        m = TOKEN.match(text, pos)
        if not m:
            break
        group, start, pos = m.lastgroup, m.start(), m.end()
        if group == "quote":
            group = "prefix"
        continued = False
        if group == "skip":
            continued = m.group()[0] == "\\"
            fresh = fresh and not continued
            continue
        if group == "nl":
            if not depth:
                out.add("newline", start, start)
                fresh = True
            continue
        if group == "prefix":
            quote = m.group("quote")
            kinds = m.group().lower()
            formatted = "f" in kinds or "t" in kinds
            if formatted:
                pos = formatted_end(text, pos, quote, "r" in kinds, start, out)
                out.add("str", start, pos)
                continue
            end = ENDING[quote].match(text, pos)
            if not end:
                out.errors.append((start, "string without an end"))
                pos = size if len(quote) == 3 else (text.find("\n", pos) if "\n" in text[pos:] else size)
            else:
                pos = end.end()
            kind = "bytes" if "b" in kinds else "str"
            out.add(kind, start, pos)
            continue
        kind = group
        if group == "op":
            kind = m.group()
            if kind in OPEN:
                depth.append((kind, start))
            elif kind in CLOSE:
                if not depth:
                    out.errors.append((start, f"unmatched {kind}"))
                elif depth.pop()[0] != CLOSE[kind]:
                    out.errors.append((start, f"closing {kind} does not match"))
        elif group == "id":
            kind = m.group() if m.group() in KEYWORDS else "id"
        elif group == "num":
            if LEADING_ZERO.fullmatch(m.group()):
                out.errors.append((start, "leading zeros in a number"))
        elif group == "bad":
            out.errors.append((start, "character or quote that starts no token"))
        out.add(kind, start, pos)
    if depth:
        out.errors.append((depth[-1][1], f"{depth[-1][0]} was never closed"))
    if out.kinds and out.kinds[-1] != "newline":
        out.add("newline", size, size)
    for _ in levels[1:]:
        out.add("dedent", size, size)
    return out


def formatted_end(text: str, pos: int, quote: str, raw: bool, start: int, out: Tokens) -> int:
    """End of a formatted string; errors of its fields go to ``out``."""
    size = len(text)
    while pos < size:
        c = text[pos]
        if c == "\\" and not raw:
            pos += 2
        elif c == "\\":
            pos += 2 if text[pos + 1 : pos + 2] not in "{}" else 1
        elif text.startswith(quote, pos):
            return pos + len(quote)
        elif c == "\n" and len(quote) == 1:
            break
        elif c == "{":
            if text.startswith("{{", pos):
                pos += 2
                continue
            pos = field(text, pos + 1, quote, raw, out)
            if pos < 0:
                break
        elif c == "}":
            if not text.startswith("}}", pos):
                out.errors.append((pos, "single } in a formatted string"))
            pos += 2 if text.startswith("}}", pos) else 1
        else:
            pos += 1
    out.errors.append((start, "string without an end"))
    return size if len(quote) == 3 or pos < 0 or pos >= size else pos


def field(text: str, pos: int, quote: str, raw: bool, out: Tokens) -> int:
    """Behind the field that starts at ``pos``; -1 if it does not end."""
    begin, size, depth = pos, len(text), []
    while pos < size:
        c = text[pos]
        if not depth and (c in ":}=!" or text.startswith(quote, pos)):
            if c == "!" and text.startswith("!=", pos):
                pos += 2
                continue
            if c == "=" and (text[pos + 1 : pos + 2] == "=" or text[pos - 1] in "=<>!"):
                pos += 2 if text[pos + 1 : pos + 2] == "=" else 1
                continue
            if c == ":" and re.search(r"\blambda\b", text[begin:pos]):
                pos += 1
                continue
            break
        if c in "([{":
            depth.append(c)
        elif c in ")]}":
            if not depth or CLOSE[c] != depth.pop():
                out.errors.append((pos, "brackets of a field do not match"))
                return -1
        elif c in "\"'":
            q = c * 3 if text.startswith(c * 3, pos) else c
            end = ENDING[q].match(text, pos + len(q))
            if not end:
                return -1
            pos = end.end()
            continue
        elif c == "\n" and len(quote) == 1 and not depth:
            return -1
        pos += 1
    if pos >= size or text.startswith(quote, pos):
        return -1
    piece = text[begin:pos]
    if not piece.strip():
        out.errors.append((begin, "empty field in a formatted string"))
    else:
        inner = Python("(" + piece.strip() + "\n)")
        for at, message in inner.run():
            out.errors.append((min(begin + max(at - 1, 0), size), message))
    if text[pos] == "=":
        pos += 1
        while text[pos : pos + 1] == " ":
            pos += 1
    if text[pos : pos + 1] == "!":
        m = re.compile(r"![rsa]\s*(?=[:}])").match(text, pos)
        if not m:
            out.errors.append((pos, "invalid conversion"))
            return -1
        pos = m.end()
    if text[pos : pos + 1] == ":":
        pos += 1
        while pos < size and text[pos] != "}":
            if text.startswith(quote, pos) or (text[pos] == "\n" and len(quote) == 1):
                return -1
            if text[pos] == "{":
                pos = field(text, pos + 1, quote, raw, out)
                if pos < 0:
                    return -1
            else:
                pos += 1
    if text[pos : pos + 1] != "}":
        out.errors.append((min(pos, size), "field without an end"))
        return -1
    return pos + 1


AUGMENTED = frozenset("+= -= *= /= //= %= **= >>= <<= &= |= ^= @=".split())
TARGET_ENDS = frozenset(("id", ")", "]"))


class Python(Parser):
    BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
    COMPARE = frozenset(("<", ">", "==", ">=", "<=", "!=", "in", "is"))

    def __init__(self, text: str):
        super().__init__(text, tokens(text))

    def recover(self, start: int) -> None:
        """Panic mode: to behind the end of the line, with the deeper block that follows it."""
        self.i = max(self.i, start)
        while not self.at("newline", "eof"):
            self.i += 1
        self.take("newline")
        if self.at("indent"):
            depth = 0
            while not self.at("eof"):
                depth += {"indent": 1, "dedent": -1}.get(self.K[self.i], 0)
                self.i += 1
                if depth == 0:
                    return

    def unit(self) -> None:
        if self.at("indent"):
            raise self.fail("unexpected indent")
        if self.take("dedent") or self.take("newline"):
            return
        self.statement()

    def suite(self) -> None:
        self.need(":")
        if not self.take("newline"):
            self.simple_line()
            return
        if not self.at("indent"):
            raise self.fail("expected an indented block")
        self.i += 1
        while not self.take("dedent"):
            if self.at("eof"):
                return
            self.guarded(self.inner)

    def inner(self) -> None:
        if self.at("indent"):
            raise self.fail("unexpected indent")
        self.statement()

    def statement(self) -> None:
        k = self.K[self.i]
        if k == "if":
            self.i += 1
            self.named()
            self.suite()
            while self.take("elif"):
                self.named()
                self.suite()
            if self.take("else"):
                self.suite()
        elif k == "while":
            self.i += 1
            self.named()
            self.suite()
            if self.take("else"):
                self.suite()
        elif k == "for":
            self.for_()
        elif k == "try":
            self.try_()
        elif k == "with":
            self.with_()
        elif k == "def":
            self.function()
        elif k == "class":
            self.i += 1
            self.need("id")
            self.type_parameters()
            if self.take("("):
                self.arguments()
            self.suite()
        elif k == "@":
            while self.take("@"):
                self.named()
                self.need("newline")
            if self.at("async") and self.K[self.i + 1] == "def":
                self.i += 1
            if not self.at("def", "class"):
                raise self.fail()
            self.statement()
        elif k == "async":
            self.i += 1
            if not self.at("def", "for", "with"):
                raise self.fail()
            self.statement()
        elif k == "id" and self.word() == "match" and self.K[self.i + 1] not in ("=", ".", ",", ")", ":", "newline") and self.attempt(self.match_head):
            self.match_body()
        else:
            self.simple_line()

    def for_(self) -> None:
        self.i += 1
        self.targets()
        self.need("in")
        self.star_expressions()
        self.suite()
        if self.take("else"):
            self.suite()

    def targets(self) -> None:
        while True:
            self.take("*")
            self.binary(1)
            if self.K[self.i - 1] not in TARGET_ENDS:
                raise self.fail("cannot assign to this")
            if not self.take(","):
                return
            if self.at("in"):
                return

    def try_(self) -> None:
        self.i += 1
        self.suite()
        caught = False
        while self.take("except"):
            caught = True
            self.take("*")
            if not self.at(":"):
                self.expression()
                while self.take(","):
                    self.expression()
                if self.take("as"):
                    self.need("id")
            self.suite()
        if caught and self.take("else"):
            self.suite()
        if self.take("finally"):
            self.suite()
        elif not caught:
            raise self.fail("expected except or finally")

    def with_(self) -> None:
        self.i += 1
        if self.at("(") and self.K[self.partner.get(self.i, self.i) + 1] == ":" and self.attempt(self.grouped_items):
            self.suite()
            return
        self.item()
        while self.take(","):
            self.item()
        self.suite()

    def grouped_items(self) -> None:
        self.need("(")
        self.separated(self.item, ")")

    def item(self) -> None:
        self.expression()
        if self.take("as"):
            self.take("*")
            self.binary(1)

    def type_parameters(self) -> None:
        if not self.take("["):
            return

        def one() -> None:
            self.take("*") or self.take("**")
            self.need("id")
            if self.take(":"):
                self.expression()
            if self.take("="):
                self.expression()

        self.separated(one, "]")

    def function(self) -> None:
        self.need("def")
        self.need("id")
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        if self.take("->"):
            self.star_expressions()
        self.suite()

    def parameters(self, end: str, typed: bool) -> None:
        defaulted, starred = False, False
        while not self.take(end):
            if self.take("/"):
                pass
            elif self.take("**"):
                self.need("id")
                if typed and self.take(":"):
                    self.expression()
                self.take(",")
                self.need(end)
                return
            elif self.take("*"):
                starred = True
                if self.take("id"):
                    if typed and self.take(":"):
                        self.take("*")
                        self.expression()
                elif not self.at(","):
                    raise self.fail()
            else:
                self.need("id")
                if typed and self.take(":"):
                    self.expression()
                if self.take("="):
                    defaulted = True
                    self.expression()
                elif defaulted and not starred:
                    raise self.fail("parameter without a default after one with")
            if not self.at(end):
                self.need(",")

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.take(";"):
                break
            if self.at("newline"):
                break
        if not self.take("newline"):
            raise self.fail()

    def simple(self) -> None:
        k = self.K[self.i]
        if k in ("pass", "break", "continue"):
            self.i += 1
        elif k == "return":
            self.i += 1
            if not self.at("newline", ";"):
                self.star_expressions()
        elif k == "raise":
            self.i += 1
            if not self.at("newline", ";"):
                self.expression()
                if self.take("from"):
                    self.expression()
        elif k in ("global", "nonlocal"):
            self.i += 1
            self.need("id")
            while self.take(","):
                self.need("id")
        elif k == "del":
            self.i += 1
            self.star_expressions()
        elif k == "assert":
            self.i += 1
            self.expression()
            if self.take(","):
                self.expression()
        elif k == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.take("as"):
                    self.need("id")
                if not self.take(","):
                    break
        elif k == "from":
            self.i += 1
            dots = False
            while self.at(".", "..."):
                dots = True
                self.i += 1
            if not (dots and self.at("import")):
                self.dotted()
            self.need("import")
            if self.take("*"):
                return
            if self.take("("):
                if self.at(")"):
                    raise self.fail()
                self.separated(self.imported, ")")
            else:
                self.imported()
                while self.take(","):
                    self.imported()
        elif k == "id" and self.word() == "type" and self.K[self.i + 1] == "id":
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.expression()
        else:
            self.assignment()

    def dotted(self) -> None:
        self.need("id")
        while self.take("."):
            self.need("id")

    def imported(self) -> None:
        self.need("id")
        if self.take("as"):
            self.need("id")

    def assignment(self) -> None:
        start = self.i
        if self.at("yield"):
            self.yield_()
        else:
            self.star_expressions()
        k = self.K[self.i]
        if k == ":":
            self.target_check(start)
            self.i += 1
            self.expression()
            if self.take("="):
                self.yield_() if self.at("yield") else self.star_expressions()
        elif k in AUGMENTED:
            self.target_check(start)
            self.i += 1
            self.yield_() if self.at("yield") else self.star_expressions()
        else:
            while self.at("="):
                self.target_check(start)
                self.i += 1
                start = self.i
                self.yield_() if self.at("yield") else self.star_expressions()

    def target_check(self, start: int) -> None:
        """The tokens read since ``start`` may stand before an equals sign: no literals, calls or operators outside brackets."""
        i, last = start, ""
        while i < self.i:
            k = self.K[i]
            if k in OPEN and i in self.partner:
                call = last in ("id", ")", "]")
                i = self.partner[i]
                if k == "{" or (k == "(" and call and self.K[i + 1] not in (".", "[")):
                    raise self.fail("cannot assign to this")
                last = self.K[i]
            elif k in ("id", ".", ",", "*"):
                last = k
            elif k in ("str", "bytes", "num") and self.K[i + 1] == ".":
                last = "id"
            else:
                raise self.fail("cannot assign to this")
            i += 1

    def yield_(self) -> None:
        self.need("yield")
        if self.take("from"):
            self.expression()
        elif not self.at(")", "newline", ";", "=", "]", "}"):
            self.star_expressions()

    def match_head(self) -> None:
        self.i += 1
        self.star_expressions()
        self.need(":")
        self.need("newline")
        self.need("indent")
        if not self.is_word("case"):
            raise self.fail()

    def match_body(self) -> None:
        while not self.take("dedent"):
            if not self.is_word("case"):
                raise self.fail()
            self.i += 1
            self.pattern()
            while self.take(","):
                if self.at(":", "if"):
                    break
                self.pattern()
            if self.take("if"):
                self.named()
            self.suite()

    def pattern(self) -> None:
        self.take("*")
        self.pattern_item()
        while self.take("|"):
            self.pattern_item()
        if self.take("as"):
            self.need("id")

    def pattern_item(self) -> None:
        k = self.K[self.i]
        if k in ("num", "-"):
            self.take("-")
            self.need("num")
            if self.at("+", "-"):
                self.i += 1
                self.need("num")
        elif k in ("str", "bytes"):
            while self.at("str", "bytes"):
                self.i += 1
        elif k in ("None", "True", "False"):
            self.i += 1
        elif k in ("(", "["):
            self.i += 1
            self.separated(self.pattern, ")" if k == "(" else "]")
        elif k == "{":
            self.i += 1

            def pair() -> None:
                if self.take("**"):
                    self.need("id")
                    return
                self.pattern_item()
                self.need(":")
                self.pattern()

            self.separated(pair, "}")
        else:
            self.dotted()
            if self.take("("):

                def argument() -> None:
                    if self.K[self.i] == "id" and self.K[self.i + 1] == "=":
                        self.i += 2
                    self.pattern()

                self.separated(argument, ")")

    # -- expressions

    def star_expressions(self) -> None:
        while True:
            if self.take("*"):
                self.binary(1)
            else:
                self.named()
            if not self.take(","):
                return
            if self.K[self.i] in ("newline", "=", ")", ":", ";", "eof") or self.K[self.i] in AUGMENTED:
                return

    def named(self) -> None:
        if self.K[self.i] == "id" and self.K[self.i + 1] == ":=":
            self.i += 2
        self.expression()

    def expression(self) -> None:
        if self.take("lambda"):
            self.parameters(":", False)
            self.expression()
            return
        self.disjunction()
        if self.take("if"):
            self.disjunction()
            self.need("else")
            self.expression()

    def disjunction(self) -> None:
        while True:
            while self.take("not"):
                pass
            self.comparison()
            if not (self.take("or") or self.take("and")):
                return

    def comparison(self) -> None:
        self.binary(1)
        while True:
            k = self.K[self.i]
            if k in self.COMPARE:
                self.i += 1
                if k == "is":
                    self.take("not")
            elif k == "not" and self.K[self.i + 1] == "in":
                self.i += 2
            else:
                return
            self.binary(1)

    def unary(self) -> None:
        while self.K[self.i] in ("+", "-", "~"):
            self.i += 1
        self.power()

    def power(self) -> None:
        self.take("await")
        self.primary()
        if self.take("**"):
            self.unary()

    def primary(self) -> None:
        k = self.K[self.i]
        if k == "id" or k == "num" or k in ("None", "True", "False", "..."):
            self.i += 1
        elif k in ("str", "bytes"):
            while self.K[self.i] == k:
                self.i += 1
            if self.at("str", "bytes"):
                raise self.fail("cannot mix bytes and nonbytes literals")
        elif k == "(":
            self.i += 1
            if self.at("yield"):
                self.yield_()
                self.need(")")
            else:
                self.elements(")")
        elif k == "[":
            self.i += 1
            self.elements("]")
        elif k == "{":
            self.i += 1
            self.braces()
        else:
            raise self.fail()
        while True:
            k = self.K[self.i]
            if k == ".":
                self.i += 1
                self.need("id")
            elif k == "(":
                self.i += 1
                self.arguments()
            elif k == "[":
                self.i += 1
                self.subscript()
            else:
                return

    def elements(self, end: str) -> None:
        first = True
        while not self.take(end):
            if self.K[self.i] in ("num", "str") and self.K[self.i + 1] in (",", end):
                self.i += 1
            elif self.take("*"):
                self.binary(1)
            else:
                self.named()
                if first and self.at("for", "async"):
                    self.clauses()
                    self.need(end)
                    return
            first = False
            if not self.at(end):
                self.need(",")

    def braces(self) -> None:
        first, pairs = True, None
        while not self.take("}"):
            if self.take("**"):
                pair = True
                self.binary(1)
            elif self.take("*"):
                pair = False
                self.binary(1)
            else:
                self.named()
                pair = self.take(":")
                if pair:
                    self.expression()
                if first and self.at("for", "async"):
                    self.clauses()
                    self.need("}")
                    return
            if pairs not in (None, pair):
                raise self.fail("pairs and single values mixed")
            first, pairs = False, pair
            if not self.at("}"):
                self.need(",")

    def clauses(self) -> None:
        while self.at("for", "async"):
            self.take("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.disjunction()
            if self.at("if") is False and self.at("else"):
                raise self.fail()
            while self.take("if"):
                if self.at("lambda"):
                    self.expression()
                elif self.K[self.i] == "id" and self.K[self.i + 1] == ":=":
                    self.i += 2
                    self.disjunction()
                else:
                    self.disjunction()

    def arguments(self) -> None:
        keyword = False
        while not self.take(")"):
            if self.take("**"):
                keyword = True
                self.expression()
            elif self.take("*"):
                self.expression()
            elif self.K[self.i] == "id" and self.K[self.i + 1] == "=":
                keyword = True
                self.i += 2
                self.expression()
            else:
                self.named()
                if self.at("for", "async"):
                    self.clauses()
                elif keyword:
                    raise self.fail("positional argument after a keyword argument")
            if not self.at(")"):
                self.need(",")

    def subscript(self) -> None:
        if self.at("]"):
            raise self.fail()

        def one() -> None:
            if self.take("*"):
                self.binary(1)
                return
            if not self.at(":"):
                self.named()
            for _ in range(2):
                if self.take(":") and not self.at(":", ",", "]"):
                    self.expression()

        self.separated(one, "]")


def check(text: str, extension: str) -> list[tuple[int, str]]:
    if "\x00" in text:
        return [(text.index("\x00"), "null character")]
    return Python(text).run()
