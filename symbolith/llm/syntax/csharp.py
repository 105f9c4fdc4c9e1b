"""C#."""

from __future__ import annotations

import re

from symbolith.llm.syntax.c import NUMBER, OPERATORS
from symbolith.llm.syntax.core import CLOSE, OPEN, Parser, Problem, Tokens, scan

TOKEN = re.compile(
    rf"""(?P<skip>//[^\n]*|/\*[\s\S]*?\*/|^[ \t]*\#[ \t]*(?:if|elif|else|endif|region|endregion|define|undef|pragma|nullable|warning|error|line)\b[^\n]*)|{NUMBER}
    |(?P<str>\"\"\"+[\s\S]*?\"\"\"+|@"(?:[^"]|"")*"|"(?:[^"\\\n]|\\.)*"(?:u8)?|'(?:[^'\\\n]|\\[ux][\da-fA-F]+|\\.)')
    |(?P<dollar>(?:\$+@?|@\$)"(?:"")?)
    |(?P<id>@?[^\W\d]\w*)|{OPERATORS}|(?P<bad>\S)""",
    re.X | re.M,
)
#: Reserved words of the language.
KEYWORDS = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)
PREDEFINED = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())
MODIFIERS = frozenset("abstract const extern internal new override private protected public readonly ref sealed static unsafe virtual volatile event fixed".split())
CONTEXTUAL = frozenset("partial async required file".split())


def interpolated(text: str, m: re.Match) -> tuple[int, list[tuple[int, int]], str]:
    """End of an interpolated string, its holes, and an error or nothing."""
    opening = m.group()
    verbatim, raw = "@" in opening, opening.endswith('"""')
    pos, holes, size = m.end(), [], len(text)
    while pos < size:
        c = text[pos]
        if c == '"':
            if raw:
                if text.startswith('"""', pos):
                    return pos + 3, holes, ""
                pos += 1
            elif verbatim and text.startswith('""', pos):
                pos += 2
            else:
                return pos + 1, holes, ""
        elif c == "\\" and not verbatim and not raw:
            pos += 2
        elif c == "\n" and not verbatim and not raw:
            return pos, holes, "string without an end"
        elif c == "{":
            if text.startswith("{{", pos):
                pos += 2
                continue
            depth, start = 1, pos + 1
            pos += 1
            while pos < size and depth:
                c = text[pos]
                if c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth -= 1
                elif c == '"':
                    end = re.compile(r'"(?:[^"\\\n]|\\.)*"').match(text, pos)
                    if not end:
                        return pos, holes, "string without an end"
                    pos = end.end() - 1
                elif c == "\n" and not verbatim and not raw:
                    return pos, holes, "string without an end"
                pos += 1
            holes.append((start, pos - 1))
        elif c == "}":
            if not text.startswith("}}", pos):
                return pos + 1, holes, "unexpected } in a string"
            pos += 2
        else:
            pos += 1
    return size, holes, "string without an end"


def tokens(text: str) -> tuple[Tokens, list[tuple[int, int]]]:
    """Tokens with interpolated strings as ``str``, and the holes of those."""
    pieces: list[tuple[int, int]] = []
    holes: list[tuple[int, int]] = []
    errors: list[tuple[int, str]] = []
    pos = 0
    while True:
        m = TOKEN.search(text, pos)
        if not m:
            break
        if m.lastgroup == "dollar":
            end, inner, error = interpolated(text, m)
            pieces.append((m.start(), end))
            holes += inner
            if error:
                errors.append((m.start(), error))
            pos = max(end, m.end())
        else:
            pos = m.end()
    if not pieces:
        return scan(text, TOKEN, KEYWORDS), holes
    plain, last = [], 0
    for a, b in pieces:
        plain += [text[last:a], '"', re.sub(r"[^\n]", "x", text[a + 1 : b - 1]).replace("\n", "x"), '"']
        last = b
    out = scan("".join(plain) + text[last:], TOKEN, KEYWORDS)
    out.errors += errors
    return out, holes


class CSharp(Parser):
    BINARY = {
        "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "is": 8, "as": 8, "<<": 9, ">>": 9,
        "+": 10, "-": 10, "*": 11, "/": 11, "%": 11,
    }
    ASSIGN = frozenset("= += -= *= /= %= <<= >>= &= |= ^= ??=".split())

    def __init__(self, text: str):
        found, holes = tokens(text)
        super().__init__(text, found)
        self.types: list[str] = []
        self.tuple_types: dict[int, tuple[int, str | None]] = {}
        for a, b in holes:
            piece = text[a:b]
            part = Hole(piece)
            self.errors += [(a + at, message) for at, message in part.run()]

    def unit(self) -> None:
        k = self.K[self.i]
        if k == ";":
            self.i += 1
        elif k == "using" and self.K[self.i + 1] != "(" and not (self.K[self.i + 1] == "id" and self.K[self.i + 2] == "id"):
            self.i += 1
            self.take("static")
            if self.at("id") and self.K[self.i + 1] == "=":
                self.i += 2
            self.type_()
            self.need(";")
        elif self.is_word("global") and self.K[self.i + 1] == "using":
            self.i += 1
        elif self.is_word("extern") and self.K[self.i + 1] == "id":
            self.i += 2
            self.need("id")
            self.need(";")
        elif k == "namespace":
            self.i += 1
            self.name()
            if not self.take(";"):
                self.need("{")
                self.statements_until("}", self.unit)
        else:
            at = self.i
            self.sections()
            self.modifiers()
            if self.type_declaration():
                return
            self.i = at
            self.statement()

    def name(self) -> None:
        self.need("id")
        while self.at(".", "::"):
            self.i += 1
            self.need("id")

    def sections(self) -> None:
        while self.at("[") and self.K[self.i + 1] in ("id", "return", "event"):
            self.i += 1
            if self.K[self.i + 1] == ":":
                self.i += 2

            def one() -> None:
                self.name()
                if self.at("<"):
                    self.type_arguments()
                if self.at("("):
                    self.arguments()

            self.separated(one, "]")

    def modifiers(self) -> None:
        while self.K[self.i] in MODIFIERS and not (self.K[self.i] == "new" and self.K[self.i + 1] in ("(", "[", "{")) or (
            self.K[self.i] == "id" and self.word() in CONTEXTUAL and self.K[self.i + 1] not in ("(", "=", ";", ".", ",", ")", "[", "=>", "{")
        ):
            self.i += 1

    def type_declaration(self) -> bool:
        k = self.K[self.i]
        if k == "id" and self.word() == "record" and self.K[self.i + 1] in ("id", "class", "struct"):
            self.i += 1
            self.take("class") or self.take("struct")
        elif k in ("class", "struct", "interface", "enum"):
            self.i += 1
        elif k == "delegate" and self.K[self.i + 1] not in ("(", "{"):
            self.i += 1
            self.type_()
            self.need("id")
            self.type_parameters()
            self.parameters("(", ")")
            self.constraints()
            self.need(";")
            return True
        else:
            return False
        name = self.word()
        self.need("id")
        self.type_parameters()
        if self.at("("):
            self.parameters("(", ")")
        if self.take(":"):
            self.type_()
            if self.at("("):
                self.arguments()
            while self.take(","):
                self.type_()
        self.constraints()
        if self.take(";"):
            return True
        self.types.append(name)
        try:
            self.need("{")
            if k == "enum":

                def entry() -> None:
                    self.sections()
                    self.need("id")
                    if self.take("="):
                        self.expression()

                self.separated(entry, "}")
            else:
                self.statements_until("}", self.member)
            self.take(";")
        finally:
            self.types.pop()
        return True

    def constraints(self) -> None:
        while self.is_word("where") and self.K[self.i + 1] == "id":
            self.i += 2
            self.need(":")
            while True:
                if self.take("new"):
                    self.need("(")
                    self.need(")")
                elif not (self.take("class") or self.take("struct") or self.take("default")):
                    self.type_()
                else:
                    self.take("?")
                if not self.take(","):
                    break

    def member(self) -> None:
        if self.take(";"):
            return
        self.sections()
        self.modifiers()
        if self.type_declaration():
            return
        if self.take("~"):
            self.need("id")
            self.parameters("(", ")")
            self.method_body()
            return
        if self.at("implicit", "explicit"):
            self.i += 1
            self.need("operator")
            self.type_()
            self.parameters("(", ")")
            self.method_body()
            return
        if self.at("id") and self.K[self.i + 1] == "(":
            if self.word() != (self.types[-1] if self.types else None):
                raise self.fail("method without a type")
            self.i += 1
            self.parameters("(", ")")
            if self.take(":"):
                self.take("base") or self.need("this")
                self.arguments()
            self.method_body()
            return
        self.type_()
        if self.take("operator"):
            while not self.at("("):
                self.i += 1
                if self.at("eof", "{", ";"):
                    raise self.fail()
            self.parameters("(", ")")
            self.method_body()
            return
        if self.take("this"):
            self.parameters("[", "]")
            self.property_body()
            return
        self.need("id")
        if self.at("<") and self.K[self.i + 1] != "(":
            self.type_arguments()
        while self.take("."):
            if self.take("this"):
                self.parameters("[", "]")
                self.property_body()
                return
            self.need("id")
            if self.at("<"):
                self.type_arguments()
        if self.at("("):
            self.parameters("(", ")")
            self.constraints()
            self.method_body()
        elif self.at("{", "=>"):
            self.property_body()
        else:
            self.declarators()
            self.need(";")

    def method_body(self) -> None:
        if self.take("=>"):
            self.expression()
            self.need(";")
        elif not self.take(";"):
            self.block()

    def property_body(self) -> None:
        if self.take("=>"):
            self.expression()
            self.need(";")
            return
        self.need("{")
        while not self.take("}"):
            self.sections()
            self.modifiers()
            if not self.is_word("get", "set", "init", "add", "remove"):
                raise self.fail()
            self.i += 1
            self.method_body()
        if self.take("="):
            self.value()
            self.need(";")

    def declarators(self) -> None:
        while True:
            if self.take("="):
                self.value()
            if not self.take(","):
                return
            self.need("id")

    def value(self) -> None:
        if self.at("{"):
            self.initializer()
        else:
            self.take("ref")
            self.expression()

    def initializer(self) -> None:
        self.need("{")

        def one() -> None:
            if self.K[self.i] in ("num", "str") and self.K[self.i + 1] in (",", "}"):
                self.i += 1
            elif self.at("{"):
                self.initializer()
            elif self.at("["):
                self.i += 1
                self.expression()
                self.need("]")
                self.need("=")
                self.value()
            else:
                self.binary_or_lambda()
                if self.take("="):
                    self.value()

        self.separated(one, "}")

    def parameters(self, start: str, end: str) -> None:
        self.need(start)

        def one() -> None:
            self.sections()
            while self.at("ref", "out", "in", "params", "this", "readonly") or (self.is_word("scoped") and self.K[self.i + 1] != ","):
                self.i += 1
            self.type_()
            self.need("id")
            if self.take("="):
                self.expression()

        self.separated(one, end, False)

    def type_parameters(self) -> None:
        if not self.take("<"):
            return

        def one() -> None:
            self.sections()
            self.take("in") or self.take("out")
            self.need("id")

        self.separated(one, ">", False)

    def type_arguments(self) -> None:
        self.need("<")
        while self.take(","):
            pass
        if not self.take(">"):
            self.separated(self.type_, ">", False)

    def type_(self) -> None:
        self.take("ref")
        k = self.K[self.i]
        if k == "(":
            self.tuple_type()
        elif k in PREDEFINED:
            self.i += 1
        else:
            while True:
                self.need("id")
                if self.at("<"):
                    self.type_arguments()
                if not (self.take(".") or self.take("::")):
                    break
        while True:
            if self.at("?") or self.at("*"):
                self.i += 1
            elif self.at("[") and self.K[self.i + 1] in ("]", ","):
                self.i += 1
                while self.take(","):
                    pass
                self.need("]")
            else:
                return

    def tuple_type(self) -> None:
        """Remembered by place, as each bracket of a nest may be asked for anew from every one around it."""
        at = self.i
        known = self.tuple_types.get(at)
        if known is None:
            self.i += 1
            try:
                self.separated(self.tuple_part, ")", False)
            except Problem as p:
                self.tuple_types[at] = (p.at, p.message)
                raise
            self.tuple_types[at] = (self.i, None)
        elif known[1] is not None:
            raise Problem(*known)
        else:
            self.i = known[0]

    def tuple_part(self) -> None:
        self.type_()
        self.take("id")

    # -- statements

    def block(self) -> None:
        self.need("{")
        self.statements_until("}", self.statement)

    def declares(self) -> None:
        self.type_()
        self.need("id")
        if not self.at("=", ";", ",", "in"):
            raise self.fail()

    def local_function(self) -> None:
        self.sections()
        self.modifiers()
        self.type_()
        self.need("id")
        self.type_parameters()
        self.parameters("(", ")")
        self.constraints()
        if not self.at("{", "=>"):
            raise self.fail()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        k = self.K[self.i]
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
        elif k in ("while", "lock", "fixed"):
            self.i += 1
            if k == "fixed":
                self.need("(")
                self.declares()
                self.declarators()
                self.need(")")
            else:
                self.condition()
            self.statement()
        elif k == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif k == "for":
            self.i += 1
            self.need("(")
            if self.attempt(self.declares):
                self.declarators()
            elif not self.at(";"):
                self.expression()
                while self.take(","):
                    self.expression()
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
                while self.take(","):
                    self.expression()
            self.need(")")
            self.statement()
        elif k == "foreach" or (self.is_word("await") and self.K[self.i + 1] == "foreach"):
            self.i += 1 if k == "foreach" else 2
            self.need("(")
            self.type_()
            if self.at("(", "id"):
                if self.at("("):
                    self.primary()
                else:
                    self.i += 1
            self.need("in")
            self.expression()
            self.need(")")
            self.statement()
        elif k == "switch":
            self.switch()
        elif k == "try":
            self.i += 1
            self.block()
            caught = False
            while self.take("catch"):
                caught = True
                if self.take("("):
                    self.type_()
                    self.take("id")
                    self.need(")")
                if self.is_word("when"):
                    self.i += 1
                    self.condition()
                self.block()
            if self.take("finally"):
                self.block()
            elif not caught:
                raise self.fail("try without catch or finally")
        elif k in ("return", "throw"):
            self.i += 1
            if not self.at(";"):
                self.take("ref")
                self.expression()
            self.need(";")
        elif k in ("break", "continue"):
            self.i += 1
            self.need(";")
        elif k == "goto":
            self.i += 1
            if self.take("case"):
                self.expression()
            else:
                self.take("default") or self.need("id")
            self.need(";")
        elif k in ("checked", "unchecked", "unsafe") and self.K[self.i + 1] == "{":
            self.i += 1
            self.block()
        elif k == "using" or (self.is_word("await") and self.K[self.i + 1] == "using"):
            self.i += 1 if k == "using" else 2
            if self.take("("):
                if self.attempt(self.declares):
                    self.declarators()
                else:
                    self.expression()
                self.need(")")
                self.statement()
            else:
                self.declares()
                self.declarators()
                self.need(";")
        elif k == "const":
            self.i += 1
            self.declares()
            self.declarators()
            self.need(";")
        elif self.is_word("yield") and self.K[self.i + 1] in ("return", "break"):
            self.i += 1
            self.statement()
        elif k == "id" and self.K[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif (k == "id" and self.K[self.i + 1] not in ("(", "=", ";") or k in PREDEFINED or k in ("(", "ref")) and self.attempt(self.declares):
            self.declarators()
            self.need(";")
        elif (k in PREDEFINED or k in ("static", "unsafe", "[", "(") or (k == "id" and self.K[self.i + 1] in ("id", "<", "?", "[", "."))) and self.attempt(self.local_function):
            if self.take("=>"):
                self.expression()
                self.need(";")
            else:
                self.block()
        else:
            start = self.i
            self.assigned_at = -1
            self.expression()
            last = self.K[self.i - 1]
            if not (last in (")", "++", "--") or k in ("++", "--") or self.assigned_at > start or (k == "new" and last in (")", "}")) or self.text[self.S[start] : self.E[start]] == "await"):
                raise self.fail("not a statement")
            self.need(";")

    assigned_at = -1

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.pattern()
                if self.is_word("when"):
                    self.i += 1
                    self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "}") and not (self.at("default") and self.K[self.i + 1] == ":"):
                if self.at("eof"):
                    raise self.fail()
                self.guarded(self.statement)

    # -- patterns

    def pattern(self) -> None:
        self.pattern_item()
        while self.is_word("or", "and"):
            self.i += 1
            self.pattern_item()

    def pattern_item(self) -> None:
        if self.is_word("not"):
            self.i += 1
            self.pattern_item()
        elif self.at("<", ">", "<=", ">="):
            self.i += 1
            self.shift()
        elif self.take("("):
            self.separated(self.pattern, ")", False)
            self.take("id")
        elif self.take("["):

            def one() -> None:
                if self.take("."):
                    self.need(".")
                    if self.at(",", "]"):
                        return
                self.pattern()

            self.separated(one, "]")
        elif self.at("{"):
            self.property_pattern()
        elif not self.attempt(self.declaration_pattern):
            self.shift()

    def shift(self) -> None:
        self.climb(9)

    def property_pattern(self) -> None:
        self.need("{")

        def one() -> None:
            self.name()
            self.need(":")
            self.pattern()

        self.separated(one, "}")
        self.take("id")

    def declaration_pattern(self) -> None:
        self.type_()
        if self.at("{"):
            self.property_pattern()
        elif self.at("id") and not self.is_word("or", "and", "when"):
            self.i += 1
        elif not self.at(")", ":", "=>", "&&", "||", ",", ";", "}", "?", "]") and not self.is_word("or", "and", "when"):
            raise self.fail()

    # -- expressions

    def expression(self) -> None:
        self.binary_or_lambda()
        step = 0
        if self.at(">") and self.K[self.i + 1] == ">=":
            step = 1
        if self.K[self.i + step] in self.ASSIGN or step:
            if self.K[self.i - 1] not in ("id", "]", ")", "this"):
                raise self.fail("invalid target of an assignment")
            self.i += 1 + step
            self.value() if self.at("{") else self.expression()
            self.assigned_at = self.i

    def binary_or_lambda(self) -> None:
        if self.lambda_():
            return
        if self.is_word("from") and self.K[self.i + 1] == "id" and self.K[self.i + 2] in ("in", "id"):
            self.query()
            return
        if self.take("throw"):
            self.expression()
            return
        self.climb(0)
        if self.take("?"):
            self.take("ref")
            self.binary_or_lambda()
            self.need(":")
            self.take("ref")
            self.binary_or_lambda()

    def query(self) -> None:
        """Clauses of a query expression up to its select or group."""
        while True:
            if self.is_word("from"):
                self.i += 1
                if self.K[self.i + 1] != "in":
                    self.type_()
                self.need("id")
                self.need("in")
                self.expression()
            elif self.is_word("where"):
                self.i += 1
                self.expression()
            elif self.is_word("let"):
                self.i += 1
                self.need("id")
                self.need("=")
                self.expression()
            elif self.is_word("orderby"):
                self.i += 1
                while True:
                    self.expression()
                    if self.is_word("ascending", "descending"):
                        self.i += 1
                    if not self.take(","):
                        break
            elif self.is_word("join"):
                self.i += 1
                self.need("id")
                self.need("in")
                self.expression()
                for word in ("on", "equals"):
                    if not self.is_word(word):
                        raise self.fail()
                    self.i += 1
                    self.expression()
                if self.is_word("into"):
                    self.i += 1
                    self.need("id")
            elif self.is_word("select", "group"):
                group = self.is_word("group")
                self.i += 1
                self.expression()
                if group:
                    if not self.is_word("by"):
                        raise self.fail()
                    self.i += 1
                    self.expression()
                if not self.is_word("into"):
                    return
                self.i += 1
                self.need("id")
            else:
                raise self.fail()

    def lambda_(self) -> bool:
        at = self.i
        self.take("static")
        if self.is_word("async") and self.K[self.i + 1] in ("id", "("):
            self.i += 1
        if self.at("delegate"):
            self.i += 1
            if self.at("("):
                self.parameters("(", ")")
            self.block()
            return True
        if self.at("id") and self.K[self.i + 1] == "=>":
            self.i += 2
        elif self.at("(") and self.K[self.partner.get(self.i, self.i) + 1] == "=>":
            end = self.partner[self.i]
            if not self.attempt(self.parameters, "(", ")") or self.i != end + 1:
                self.i = at if self.K[at] == "(" else self.i
                self.need("(")
                while self.i < end:
                    self.need("id")
                    if self.i < end:
                        self.need(",")
                self.i = end + 1
            self.need("=>")
        else:
            self.i = at
            return False
        if self.at("{"):
            self.block()
        else:
            self.expression()
        return True

    def climb(self, least: int) -> None:
        self.unary()
        K = self.K
        while True:
            k = K[self.i]
            step = 1
            if k == ">" and K[self.i + 1] == ">" and self.S[self.i + 1] == self.S[self.i] + 1:
                k, step = ">>", 2
            if k == "switch" and K[self.i + 1] == "{":
                self.i += 2

                def arm() -> None:
                    self.pattern()
                    if self.is_word("when"):
                        self.i += 1
                        self.expression()
                    self.need("=>")
                    self.expression()

                self.separated(arm, "}")
                continue
            if k == "." and K[self.i + 1] == ".":
                self.i += 2
                if not self.at("]", ")", ",", ";"):
                    self.unary()
                continue
            p = self.BINARY.get(k, -1)
            if p < least:
                return
            self.i += step
            if k == "is":
                self.pattern()
            elif k == "as":
                self.type_()
            elif k == "??":
                self.binary_or_lambda()
            else:
                self.climb(p + 1)

    def unary(self) -> None:
        while self.K[self.i] in ("+", "-", "!", "~", "++", "--", "&", "*", "^") or (
            self.is_word("await") and self.K[self.i + 1] in ("id", "new", "this", "base", "(")
        ):
            if self.is_word("await") and self.K[self.i + 1] == "(":
                break
            self.i += 1
        if self.at("(") and self.cast():
            return
        self.postfix()

    def cast_type(self) -> None:
        self.need("(")
        self.type_()
        self.need(")")

    def cast(self) -> bool:
        at = self.i
        known = self.K[at + 1] in PREDEFINED
        if not known and self.K[at + 1] not in ("id", "("):
            return False
        if not self.attempt(self.cast_type):
            return False
        if (known and not self.at(".")) or self.at("id", "num", "str", "(", "!", "~", "this", "base", "new", "true", "false", "null", "typeof", "default", "sizeof"):
            self.unary()
            return True
        self.i = at
        return False

    def postfix(self) -> None:
        self.primary()
        while True:
            k = self.K[self.i]
            if k in (".", "->", "::"):
                if k == "." and self.K[self.i + 1] == ".":
                    return
                self.i += 1
                self.need("id")
            elif k == "?" and self.K[self.i + 1] in (".", "["):
                if self.K[self.i + 1] == "[" and not self.attempt(self.null_index):
                    return
                if self.K[self.i] == "?":
                    self.i += 1
            elif k == "(":
                self.arguments()
            elif k == "[":
                self.i += 1
                self.separated(self.argument, "]", False)
            elif k in ("++", "--"):
                self.i += 1
            elif k == "!" and self.K[self.i + 1] in (".", ";", ")", ",", "[", "]"):
                self.i += 1
            elif k == "<" and self.K[self.i - 1] == "id" and self.attempt(self.generic_name):
                continue
            elif k == "{" and self.K[self.i - 1] == "with":
                self.initializer()
            elif k == "id" and self.word() == "with" and self.K[self.i + 1] == "{":
                self.i += 1
                self.initializer()
            else:
                return

    def null_index(self) -> None:
        self.need("?")
        self.need("[")
        self.separated(self.argument, "]", False)
        if self.at(":"):
            raise self.fail()

    def generic_name(self) -> None:
        self.type_arguments()
        if not self.at("(", ")", "]", "}", ":", ";", ",", ".", "?", "==", "!="):
            raise self.fail()

    def argument(self) -> None:
        if self.at("id") and self.K[self.i + 1] == ":" and self.K[self.i + 2] != ":":
            self.i += 2
        if self.at("out", "ref", "in"):
            self.i += 1
            if self.attempt(self.out_declaration):
                return
        self.expression()

    def out_declaration(self) -> None:
        self.type_()
        self.need("id")
        if not self.at(",", ")"):
            raise self.fail()

    def arguments(self) -> None:
        self.need("(")
        self.separated(self.argument, ")", False)

    def primary(self) -> None:
        k = self.K[self.i]
        if k in ("id", "num", "str", "this", "base", "true", "false", "null"):
            self.i += 1
        elif k == "(":
            self.i += 1
            self.separated(self.tuple_item, ")", False)
        elif k == "new":
            self.i += 1
            if self.at("("):
                self.arguments()
            elif self.at("[") and self.K[self.i + 1] in ("]", ","):
                self.i += 1
                while self.take(","):
                    pass
                self.need("]")
            elif not self.at("{"):
                self.type_()
                if self.at("["):
                    self.i += 1
                    self.separated(self.expression, "]", False)
                    while self.at("[") and self.K[self.i + 1] in ("]", ","):
                        self.i += 1
                        while self.take(","):
                            pass
                        self.need("]")
                elif self.at("("):
                    self.arguments()
                elif not (self.at("{") or self.K[self.i - 1] == "]"):
                    raise self.fail()
            if self.at("{"):
                self.initializer()
        elif k in ("typeof", "sizeof"):
            self.i += 1
            self.cast_type()
        elif k in ("checked", "unchecked"):
            self.i += 1
            self.condition()
        elif k == "default":
            self.i += 1
            if self.at("("):
                self.cast_type()
        elif k == "stackalloc":
            self.i += 1
            self.type_()
            if self.at("["):
                self.i += 1
                self.expression()
                self.need("]")
            if self.at("{"):
                self.initializer()
        elif k in PREDEFINED:
            self.i += 1
            self.need(".")
            self.need("id")
        elif k == "[":
            self.i += 1

            def one() -> None:
                if self.take("."):
                    self.need(".")
                self.expression()

            self.separated(one, "]")
        elif k == "." and self.K[self.i + 1] == ".":
            self.i += 2
            if not self.at("]", ")", ","):
                self.unary()
        else:
            raise self.fail()

    def tuple_item(self) -> None:
        if self.at("id") and self.K[self.i + 1] == ":":
            self.i += 2
        if self.at("id", *PREDEFINED) and self.K[self.i + 1] == "id" and self.K[self.i + 2] in (",", ")"):
            self.i += 2
            return
        self.expression()


class Hole(CSharp):
    """The expression in a hole of an interpolated string, with alignment and format left out."""

    def __init__(self, text: str):
        cut = re.match(r"(?:[^:\"(\[?]|\"[^\"]*\"|\([^()]*\)|\[[^\]]*\]|\?[^:]*:|::)*", text)
        super().__init__(text[: cut.end()] if cut else text)

    def unit(self) -> None:
        self.expression()
        if self.take(","):
            self.expression()
        if not self.at("eof"):
            raise self.fail()

    def run(self) -> list[tuple[int, str]]:
        if self.at("eof"):
            return [(0, "empty hole in a string")]
        return super().run()


def check(text: str, extension: str) -> list[tuple[int, str]]:
    return CSharp(text).run()


__all__ = ["CLOSE", "OPEN", "check"]
