"""Go."""

from __future__ import annotations

import re

from symbolith.llm.syntax.core import Parser, Tokens

TOKEN = re.compile(
    r"""(?P<nl>\n)|(?P<skip>//[^\n]*|/\*[\s\S]*?\*/)
    |(?P<num>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))
    |(?P<str>"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\[xuU]?[\da-fA-F]+|\\.)')
    |(?P<id>[^\W\d]\w*)
    |(?P<op>&\^=|<<=|>>=|\.\.\.|&\^|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[{}()\[\];,<>+\-*/%&|^!~:=.])
    |(?P<bad>\S)""",
    re.X,
)
#: Reserved words of the language.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ENDS = frozenset(("id", "num", "str", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))


def tokens(text: str) -> Tokens:
    """Tokens with the semicolons that line ends stand for."""
    out = Tokens()
    kinds = out.kinds
    for m in TOKEN.finditer(text):
        group = m.lastgroup
        if group == "nl" or group == "skip":
            if kinds and kinds[-1] in ENDS and (group == "nl" or "\n" in m.group()):
                out.add(";", m.start(), m.start())
            continue
        kind = group
        if group == "op":
            kind = m.group()
        elif group == "id":
            kind = m.group() if m.group() in KEYWORDS else "id"
        elif group == "bad":
            out.errors.append((m.start(), "character or quote that starts no token"))
        out.add(kind, m.start(), m.end())
    if kinds and kinds[-1] in ENDS:
        out.add(";", len(text), len(text))
    return out


class Go(Parser):
    BINARY = {
        "||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5,
    }
    ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())

    def __init__(self, text: str):
        super().__init__(text, tokens(text))
        self.control = False
        self.stage = 0

    def semi(self) -> None:
        if not self.at(")", "}"):
            self.need(";")

    def unit(self) -> None:
        if self.stage == 0:
            self.stage = 1
            self.need("package")
            self.need("id")
            self.need(";")
            return
        k = self.K[self.i]
        if k == ";":
            self.i += 1
            return
        if k == "import":
            if self.stage > 1:
                raise self.fail("import after other declarations")
            self.i += 1
            self.specs(self.import_spec)
        elif k == "func":
            self.stage = 2
            self.i += 1
            if self.at("("):
                self.parameters()
            self.need("id")
            self.type_parameters()
            self.signature()
            if self.at("{"):
                self.block()
        elif k in ("var", "const", "type"):
            self.stage = 2
            self.declaration()
        else:
            raise self.fail(f"unexpected {self.word()[:40]} outside functions")
        if not self.at("eof"):
            self.need(";")

    def declaration(self) -> None:
        k = self.K[self.i]
        self.i += 1
        self.specs({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[k])

    def specs(self, rule) -> None:
        if self.take("("):
            while not self.take(")"):
                rule()
                self.semi()
        else:
            rule()

    def import_spec(self) -> None:
        self.take("id") or self.take(".")
        self.need("str")

    def names(self) -> None:
        self.need("id")
        while self.take(","):
            self.need("id")

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type_()
        if self.take("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type_()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("id")
        if self.at("[") and self.K[self.i + 1] == "id" and self.K[self.i + 2] not in ("]",):
            self.attempt(self.type_parameters)
        self.take("=")
        self.type_()

    def type_parameters(self) -> None:
        if not self.take("["):
            return

        def one() -> None:
            self.need("id")
            if not self.at(",", "]"):
                self.constraint()

        self.separated(one, "]")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type_()
            if not self.take("|"):
                return

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        elif self.at("id", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type_()

    def parameters(self) -> None:
        self.need("(")

        def one() -> None:
            if self.take("..."):
                self.type_()
                return
            self.type_()
            if self.take("..."):
                self.type_()
            elif not self.at(",", ")", ";"):
                if self.K[self.i - 1] != "id":
                    raise self.fail()
                self.type_()

        self.separated(one, ")")

    def type_(self) -> None:
        k = self.K[self.i]
        if k == "id":
            self.i += 1
            if self.take("."):
                self.need("id")
            if self.at("[") and self.K[self.i + 1] not in ("]", "num") and self.partner.get(self.i) and self.K[self.partner[self.i] + 1] not in ("id", "*", "["):
                self.attempt(self.type_arguments)
        elif k == "*":
            self.i += 1
            self.type_()
        elif k == "(":
            self.i += 1
            self.type_()
            self.need(")")
        elif k == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    kept, self.control = self.control, False
                    self.expression()
                    self.control = kept
                self.need("]")
            self.type_()
        elif k == "map":
            self.i += 1
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif k == "chan":
            self.i += 1
            self.take("<-")
            self.type_()
        elif k == "<-":
            self.i += 1
            self.need("chan")
            self.type_()
        elif k == "func":
            self.i += 1
            self.signature()
        elif k == "struct":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                if self.at("*") or (self.at("id") and self.K[self.i + 1] in (";", "}", ".", "str")):
                    self.take("*")
                    self.type_()
                else:
                    self.names()
                    self.type_()
                self.take("str")
                self.semi()
        elif k == "interface":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                if self.at("id") and self.K[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.semi()
        else:
            raise self.fail()

    def type_arguments(self) -> None:
        self.need("[")
        self.separated(self.type_, "]")

    # -- statements

    def block(self) -> None:
        self.need("{")
        kept, self.control = self.control, False
        self.list("}")
        self.control = kept
        self.need("}")

    def list(self, *ends: str) -> None:
        while not self.at(*ends):
            if self.at("eof"):
                raise self.fail()
            self.guarded(self.line)

    def line(self) -> None:
        if self.take(";"):
            return
        self.statement()
        if not self.at("}", ")") and not (self.at("case", "default") and self.K[self.i - 1] == ";"):
            self.need(";")

    def statement(self) -> None:
        k = self.K[self.i]
        if k in ("var", "const", "type"):
            self.declaration()
        elif k == "{":
            self.block()
        elif k == "if":
            self.if_()
        elif k == "for":
            self.for_()
        elif k == "switch":
            self.switch()
        elif k == "select":
            self.i += 1
            self.need("{")
            self.cases()
        elif k == "return":
            self.i += 1
            if not self.at(";", "}"):
                self.expressions()
        elif k in ("go", "defer"):
            self.i += 1
            self.expression()
            if self.K[self.i - 1] != ")":
                raise self.fail("expected a call")
        elif k in ("break", "continue"):
            self.i += 1
            self.take("id")
        elif k == "goto":
            self.i += 1
            self.need("id")
        elif k == "fallthrough":
            self.i += 1
        elif k == "id" and self.K[self.i + 1] == ":":
            self.i += 2
            if not self.at("}"):
                self.statement() if not self.at(";") else None
        else:
            self.simple()

    def simple(self) -> None:
        start = self.i
        self.expressions()
        k = self.K[self.i]
        if k in self.ASSIGN:
            if k == ":=" and any(x not in ("id", ",") for x in self.K[start : self.i]):
                raise self.fail("name expected before :=")
            self.i += 1
            self.take("range")
            self.expressions()
        elif k in ("++", "--"):
            self.i += 1
        elif k == "<-":
            self.i += 1
            self.expression()

    def header(self) -> None:
        """Optional simple statement and condition before a block."""
        kept, self.control = self.control, True
        if not self.at("{"):
            if not self.at(";"):
                self.simple()
            if self.take(";") and not self.at("{"):
                self.simple()
        self.control = kept

    def if_(self) -> None:
        self.i += 1
        if self.at("{"):
            raise self.fail("missing condition")
        self.header()
        self.block()
        if self.take("else"):
            if self.at("if"):
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.i += 1
        kept, self.control = self.control, True
        if not self.at("{"):
            if self.take("range"):
                self.expression()
            else:
                if not self.at(";"):
                    self.simple()
                if self.take(";"):
                    if not self.at(";"):
                        self.expression()
                    self.need(";")
                    if not self.at("{"):
                        self.simple()
        self.control = kept
        self.block()

    def switch(self) -> None:
        self.i += 1
        self.header()
        self.need("{")
        self.cases()

    def cases(self) -> None:
        kept, self.control = self.control, False
        while not self.take("}"):
            if self.take("case"):

                def one() -> None:
                    if self.at("[", "map", "chan", "struct", "interface", "func", "*"):
                        if self.attempt(self.type_) and self.at(",", ":"):
                            return
                    self.expression()

                one()
                while self.take(","):
                    one()
                if self.at("=", ":="):
                    self.i += 1
                    self.expression()
                elif self.take("<-"):
                    self.expression()
            else:
                self.need("default")
            self.need(":")
            self.list("case", "default", "}")
        self.control = kept

    # -- expressions

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        self.binary()

    def unary(self) -> None:
        while self.K[self.i] in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            if self.K[self.i] == "<-" and self.K[self.i + 1] == "chan":
                break
            self.i += 1
        self.primary()

    def primary(self) -> None:
        k = self.K[self.i]
        literal = False
        if k in ("num", "str"):
            self.i += 1
        elif k == "id":
            self.i += 1
            literal = True
        elif k == "(":
            self.i += 1
            kept, self.control = self.control, False
            if not (self.attempt(self.expression) and self.at(")")):
                self.i = self.i if self.at("*") else self.i
                self.type_()
            self.control = kept
            self.need(")")
        elif k == "func":
            self.i += 1
            self.signature()
            if self.at("{"):
                self.block()
        elif k in ("[", "map", "struct", "chan", "interface", "<-"):
            self.type_()
            literal = True
            if self.at("{"):
                self.composite()
        else:
            raise self.fail()
        while True:
            k = self.K[self.i]
            if k == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type_()
                    self.need(")")
                else:
                    self.need("id")
            elif k == "(":
                self.i += 1
                kept, self.control = self.control, False

                def one() -> None:
                    if self.at("[", "map", "chan", "struct", "interface", "func"):
                        at = self.i
                        if self.attempt(self.type_) and self.at(",", ")"):
                            return
                        self.i = at
                    self.expression()
                    self.take("...")

                self.separated(one, ")")
                self.control = kept
                literal = False
            elif k == "[":
                self.i += 1
                kept, self.control = self.control, False
                if not self.at(":"):
                    at = self.i
                    if not (self.attempt(self.expressions) and self.at("]", ":")):
                        self.i = at
                        self.type_()
                        while self.take(","):
                            self.type_()
                while self.take(":"):
                    if not self.at("]", ":"):
                        self.expression()
                self.control = kept
                self.need("]")
            elif k == "{" and literal and not self.control:
                self.composite()
                literal = False
            else:
                return

    def composite(self) -> None:
        self.need("{")
        kept, self.control = self.control, False

        def value() -> None:
            if self.at("{"):
                self.composite()
            else:
                self.expression()

        def one() -> None:
            if self.K[self.i] in ("num", "str") and self.K[self.i + 1] in (",", "}"):
                self.i += 1
                return
            value()
            if self.take(":"):
                value()

        self.separated(one, "}")
        self.control = kept


def check(text: str, extension: str) -> list[tuple[int, str]]:
    return Go(text).run()
