"""Java."""

from __future__ import annotations

import re

from symbolith.llm.syntax.c import NUMBER, OPERATORS
from symbolith.llm.syntax.core import Parser, scan

TOKEN = re.compile(
    rf"""(?P<skip>//[^\n]*|/\*[\s\S]*?\*/)|{NUMBER}
    |(?P<str>\"\"\"[ \t]*\r?\n(?:[^\\]|\\[\s\S])*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\u+[\da-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)')
    |(?P<id>[^\W\d]\w*(?:\$\w*)*|\$\w+)|{OPERATORS}|(?P<bad>\S)""",
    re.X,
)
#: Reserved words of the language.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
PRIMITIVE = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("abstract default final native private protected public static strictfp synchronized transient volatile".split())


class Java(Parser):
    BINARY = {
        "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8,
        "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
    }
    ASSIGN = frozenset("= += -= *= /= %= <<= >>= >>>= &= |= ^=".split())

    def __init__(self, text: str):
        super().__init__(text, scan(text, TOKEN, KEYWORDS))
        self.types: list[str] = []
        self.seen_type = False

    def unit(self) -> None:
        k = self.K[self.i]
        if k == ";":
            self.i += 1
        elif k == "package":
            if self.seen_type:
                raise self.fail("package after other declarations")
            self.i += 1
            self.name()
            self.need(";")
            self.seen_type = True
        elif k == "import":
            self.i += 1
            self.take("static")
            self.need("id")
            while self.take("."):
                if self.take("*"):
                    break
                self.need("id")
            self.need(";")
            self.seen_type = True
        else:
            self.seen_type = True
            self.modifiers()
            if self.at("package"):
                self.i += 1
                self.name()
                self.need(";")
            elif not self.type_declaration():
                raise self.fail()

    def name(self) -> None:
        self.need("id")
        while self.take("."):
            self.need("id")

    def modifiers(self) -> None:
        while True:
            k = self.K[self.i]
            if k in MODIFIERS and not (k == "default" and self.K[self.i + 1] in (":", "->")):
                self.i += 1
            elif k == "@" and self.K[self.i + 1] != "interface":
                self.annotation()
            elif k == "id" and self.word() in ("sealed",) and self.K[self.i + 1] in ("class", "interface", "abstract", "public"):
                self.i += 1
            elif k == "id" and self.word() == "non" and self.K[self.i + 1] == "-":
                self.i += 3
            else:
                return

    def annotation(self) -> None:
        self.need("@")
        self.name()
        if self.take("("):
            self.separated(self.element, ")", False)

    def element(self) -> None:
        if self.at("id") and self.K[self.i + 1] == "=":
            self.i += 2
        self.element_value()

    def element_value(self) -> None:
        if self.at("@"):
            self.annotation()
        elif self.take("{"):
            self.separated(self.element_value, "}")
        else:
            self.conditional()

    def type_declaration(self) -> bool:
        k = self.K[self.i]
        if k in ("class", "interface", "enum"):
            self.i += 1
        elif k == "@" and self.K[self.i + 1] == "interface":
            self.i += 2
        elif k == "id" and self.word() == "record" and self.K[self.i + 1] == "id" and self.K[self.i + 2] in ("(", "<"):
            self.i += 1
            k = "record"
        else:
            return False
        name = self.word()
        self.need("id")
        self.type_parameters()
        if k == "record":
            self.parameters()
        if self.take("extends"):
            self.type_list()
        if self.take("implements"):
            self.type_list()
        if self.is_word("permits"):
            self.i += 1
            self.type_list()
        self.types.append(name)
        try:
            self.body(k == "enum")
        finally:
            self.types.pop()
        return True

    def body(self, enum: bool = False) -> None:
        self.need("{")
        if enum:
            while not self.at(";", "}"):
                while self.at("@"):
                    self.annotation()
                self.need("id")
                if self.at("("):
                    self.arguments()
                if self.at("{"):
                    self.body()
                if not self.take(","):
                    break
            if self.take("}"):
                return
            self.need(";")
        self.statements_until("}", self.member)

    def member(self) -> None:
        if self.take(";"):
            return
        if self.at("{"):
            self.block()
            return
        if self.at("static") and self.K[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        if self.at("id") and self.K[self.i + 1] in ("(", "{"):
            if self.word() != (self.types[-1] if self.types else None):
                raise self.fail("method without a type")
            self.i += 1
            if self.at("("):
                self.parameters()
                self.throws()
            self.block()
            return
        if not self.take("void"):
            self.type_()
        elif not (self.at("id") and self.K[self.i + 1] == "("):
            raise self.fail()
        self.need("id")
        if self.at("("):
            self.parameters()
            self.dims()
            self.throws()
            if self.take("default"):
                self.element_value()
            if not self.take(";"):
                self.block()
            return
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.type_list()

    def type_list(self) -> None:
        self.type_()
        while self.take(","):
            self.type_()

    def dims(self) -> None:
        while self.at("[") and self.K[self.i + 1] == "]":
            self.i += 2

    def parameters(self) -> None:
        self.need("(")

        def one() -> None:
            self.modifiers()
            self.type_()
            self.take("...")
            if self.take("this"):
                return
            self.need("id")
            self.dims()

        self.separated(one, ")", False)

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.need("id")

    def initializer(self) -> None:
        if self.take("{"):
            self.separated(self.initializer, "}")
        elif self.K[self.i] in ("num", "str") and self.K[self.i + 1] in (",", "}"):
            self.i += 1
        else:
            self.expression()

    def type_parameters(self) -> None:
        if not self.take("<"):
            return

        def one() -> None:
            while self.at("@"):
                self.annotation()
            self.need("id")
            if self.take("extends"):
                self.type_()
                while self.take("&"):
                    self.type_()

        self.separated(one, ">", False)

    def type_(self) -> None:
        while self.at("@"):
            self.annotation()
        if self.K[self.i] in PRIMITIVE:
            self.i += 1
        else:
            self.need("id")
            self.type_arguments()
            while self.at(".") and self.K[self.i + 1] in ("id", "@"):
                self.i += 1
                self.need("id")
                self.type_arguments()
        self.dims()

    def type_arguments(self) -> None:
        if not self.take("<"):
            return
        if self.take(">"):
            return

        def one() -> None:
            if self.take("?"):
                if self.take("extends") or self.take("super"):
                    self.type_()
            else:
                self.type_()

        self.separated(one, ">", False)

    # -- statements

    def block(self) -> None:
        self.need("{")
        self.statements_until("}", self.block_statement)

    def declares(self) -> None:
        """A type, and the name that makes it a local declaration."""
        self.modifiers()
        self.type_()
        self.need("id")
        if not self.at("=", ";", ",", "[", ":"):
            raise self.fail()

    def block_statement(self) -> None:
        k = self.K[self.i]
        if k in ("final", "abstract", "static", "@", "class", "interface", "enum") or self.is_word("record", "sealed"):
            at = self.i
            self.modifiers()
            if self.type_declaration():
                return
            self.i = at
        if (k in PRIMITIVE or k in ("id", "final", "@")) and not (k == "id" and self.K[self.i + 1] in ("(", "=", "++")) and self.attempt(self.declares):
            self.declarators()
            self.need(";")
            return
        self.statement()

    def statement(self) -> None:
        k = self.K[self.i]
        if k == "{":
            self.block()
        elif k == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.take("else"):
                self.statement()
        elif k == "while":
            self.i += 1
            self.condition()
            self.statement()
        elif k == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif k == "for":
            self.for_()
        elif k == "switch":
            self.switch()
        elif k == "try":
            self.try_()
        elif k == "synchronized":
            self.i += 1
            self.condition()
            self.block()
        elif k in ("return", "throw"):
            self.i += 1
            if k == "throw" or not self.at(";"):
                self.expression()
            self.need(";")
        elif k in ("break", "continue"):
            self.i += 1
            self.take("id")
            self.need(";")
        elif k == "assert":
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";")
        elif k == ";":
            self.i += 1
        elif k == "id" and self.K[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif k == "id" and self.word() == "yield" and self.K[self.i + 1] not in ("=", ".", "(", "++", "--"):
            self.i += 1
            self.expression()
            self.need(";")
        else:
            self.effect()
            self.need(";")

    def effect(self) -> None:
        """An expression that may stand as a statement."""
        first = self.K[self.i]
        self.plain = True
        start = self.i
        self.expression()
        last = self.K[self.i - 1]
        if first in ("++", "--") or last in ("++", "--") or self.assigned_at >= start:
            return
        if last == ")" and first != "(" or first == "new" and last in (")", "}") or (last == ")" and self.K[self.i - 2] == "("):
            return
        if last == ")" and first == "(":
            return
        raise self.fail("not a statement")

    assigned_at = -1

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def for_(self) -> None:
        self.i += 1
        self.need("(")
        if self.attempt(self.declares):
            if self.take(":"):
                self.expression()
                self.need(")")
                self.statement()
                return
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

    def switch(self) -> None:
        self.need("switch")
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                while True:
                    if not self.take("default"):
                        if not self.attempt(self.pattern):
                            self.conditional()
                    if not self.take(","):
                        break
                if self.is_word("when"):
                    self.i += 1
                    self.expression()
            else:
                self.need("default")
            if self.take("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
                continue
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.at("eof"):
                    raise self.fail()
                self.guarded(self.block_statement)

    def pattern(self) -> None:
        self.modifiers()
        self.type_()
        if self.take("("):
            self.separated(self.pattern, ")", False)
            self.take("id")
        else:
            self.need("id")
        if not self.at(":", "->", ",", ")", "id", "&&", "||", "?", ";"):
            raise self.fail()

    def try_(self) -> None:
        self.i += 1
        resources = self.take("(")
        if resources:
            while not self.take(")"):
                if self.attempt(self.declares):
                    self.declarators()
                else:
                    self.expression()
                if not self.at(")"):
                    self.need(";")
        self.block()
        caught = False
        while self.take("catch"):
            caught = True
            self.need("(")
            self.modifiers()
            self.type_()
            while self.take("|"):
                self.type_()
            self.need("id")
            self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught and not resources:
            raise self.fail("try without catch or finally")

    # -- expressions

    def expression(self) -> None:
        self.conditional()
        if self.K[self.i] in self.ASSIGN or (self.at(">") and self.K[self.i + 1] in (">=", ">")):
            while self.at(">"):
                self.i += 1
            if self.at(">="):
                self.i += 1
            elif self.K[self.i] in self.ASSIGN:
                if self.K[self.i - 1] not in ("id", "]", ")"):
                    raise self.fail("invalid target of an assignment")
                self.i += 1
            self.assigned_at = self.i
            self.expression()
            self.assigned_at = self.i

    def conditional(self) -> None:
        if self.lambda_():
            return
        self.binary()
        if self.take("?"):
            self.expression_or_lambda()
            self.need(":")
            self.expression_or_lambda()

    def expression_or_lambda(self) -> None:
        self.conditional()

    def lambda_(self) -> bool:
        if self.at("id") and self.K[self.i + 1] == "->":
            self.i += 2
        elif self.at("(") and self.K[self.partner.get(self.i, self.i) + 1] == "->":
            end = self.partner[self.i]
            self.i += 1
            if self.K[self.i] == "id" and self.K[self.i + 1] in (",", ")"):
                while self.i < end:
                    self.need("id")
                    if self.i < end:
                        self.need(",")
                self.i += 1
            else:
                self.i -= 1
                self.parameters()
            self.i = end + 1
            self.need("->")
        else:
            return False
        if self.at("{"):
            self.block()
        else:
            self.expression()
        return True

    def binary(self, least: int = 0) -> None:
        self.unary()
        K = self.K
        while True:
            k = K[self.i]
            step = 1
            if k == ">":
                while K[self.i + step] == ">" and self.S[self.i + step] == self.S[self.i] + step and step < 3:
                    step += 1
                if K[self.i + step] == ">=" and self.S[self.i + step] == self.S[self.i] + step:
                    return
                k = ">" * step
            p = self.BINARY.get(k, -1)
            if p < least:
                return
            self.i += step
            if k == "instanceof":
                if not self.attempt(self.pattern):
                    self.modifiers()
                    self.type_()
            else:
                self.binary(p + 1)

    def unary(self) -> None:
        while self.K[self.i] in ("+", "-", "!", "~", "++", "--"):
            self.i += 1
        if self.at("(") and self.cast():
            return
        if self.at("switch"):
            self.switch()
            return
        self.postfix()

    def cast_type(self) -> None:
        self.need("(")
        self.type_()
        while self.take("&"):
            self.type_()
        self.need(")")

    def cast(self) -> bool:
        at = self.i
        primitive = self.K[at + 1] in PRIMITIVE
        if not primitive and self.K[at + 1] not in ("id", "@"):
            return False
        if not self.attempt(self.cast_type):
            return False
        if primitive or self.at("id", "num", "str", "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch"):
            if not self.lambda_():
                self.unary()
            return True
        self.i = at
        return False

    def postfix(self) -> None:
        self.primary()
        while True:
            k = self.K[self.i]
            if k == ".":
                self.i += 1
                self.type_arguments()
                if self.take("new"):
                    self.creator()
                elif not (self.take("this") or self.take("class") or self.take("super")):
                    self.need("id")
            elif k == "(":
                if self.K[self.i - 1] not in ("id", "this", "super"):
                    raise self.fail()
                self.arguments()
            elif k == "[":
                self.i += 1
                if self.take("]"):
                    self.dims()
                    if self.take("::"):
                        self.need("new")
                    else:
                        self.need(".")
                        self.need("class")
                    return
                self.expression()
                self.need("]")
            elif k == "::":
                self.i += 1
                self.take("new") or self.need("id")
            elif k in ("++", "--"):
                self.i += 1
            elif k == "<" and self.K[self.i - 1] == "id" and self.attempt(self.generic_reference):
                continue
            else:
                return

    def generic_reference(self) -> None:
        self.type_arguments()
        self.dims()
        self.need("::")
        self.take("new") or self.need("id")

    def arguments(self) -> None:
        self.need("(")
        self.separated(self.expression, ")", False)

    def creator(self) -> None:
        self.type_arguments()
        while self.at("@"):
            self.annotation()
        if self.K[self.i] in PRIMITIVE:
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.take("."):
                self.need("id")
                self.type_arguments()
        if self.at("["):
            empty = False
            while self.at("["):
                self.i += 1
                if self.take("]"):
                    empty = True
                else:
                    self.expression()
                    self.need("]")
            if empty and self.at("{"):
                self.initializer()
            return
        self.arguments()
        if self.at("{"):
            self.types.append("")
            self.body()
            self.types.pop()

    def primary(self) -> None:
        k = self.K[self.i]
        if k in ("id", "num", "str", "this", "super", "true", "false", "null"):
            self.i += 1
        elif k == "(":
            self.condition()
        elif k == "new":
            self.i += 1
            self.creator()
        elif k in PRIMITIVE or k == "void":
            self.i += 1
            self.dims()
            if self.take("::"):
                self.need("new")
            else:
                self.need(".")
                self.need("class")
        else:
            raise self.fail()


def check(text: str, extension: str) -> list[tuple[int, str]]:
    return Java(text).run()
