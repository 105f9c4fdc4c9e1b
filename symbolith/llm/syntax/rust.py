"""Rust."""

from __future__ import annotations

import re

from symbolith.llm.syntax.core import Parser, Problem, Tokens

TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*)|(?P<block>/\*)
    |(?P<num>(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iuf](?:8|16|32|64|128|size))?(?!\w))
    |(?P<raw>(?:br|cr|r)(?P<hash>\#*)")
    |(?P<str>[bc]?"(?:[^"\\]|\\[\s\S])*"|b?'(?:[^'\\\n]|\\u\{[\da-fA-F_]+\}|\\x[\da-fA-F]{2}|\\.)')
    |(?P<life>'[^\W\d]\w*)
    |(?P<id>r\#[^\W\d]\w*|[^\W\d]\w*)
    |(?P<op><<=|>>=|\.\.\.|\.\.=|->|=>|::|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\.\.|[{}()\[\];,<>+\-*/%&|^!?:=.@\#$~])
    |(?P<bad>\S)""",
    re.X,
)
#: Reserved words of the language.
KEYWORDS = frozenset(
    "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()
)
NAMES = frozenset(("id", "self", "Self", "super", "crate"))


def tokens(text: str) -> Tokens:
    out = Tokens()
    kinds, size, pos = out.kinds, len(text), 0
    nest = re.compile(r"/\*|\*/")
    while True:
        m = TOKEN.search(text, pos)
        if not m:
            break
        group, start, pos = m.lastgroup, m.start(), m.end()
        if group == "hash":
            group = "raw"
        if group == "skip":
            continue
        if group == "block":
            depth = 1
            while depth:
                n = nest.search(text, pos)
                if not n:
                    out.errors.append((start, "comment without an end"))
                    pos = size
                    break
                depth += 1 if n.group() == "/*" else -1
                pos = n.end()
            continue
        if group == "raw":
            end = text.find('"' + m.group("hash"), pos)
            if end < 0:
                out.errors.append((start, "string without an end"))
            pos = size if end < 0 else end + 1 + len(m.group("hash"))
            kind = "str"
        elif group == "op":
            kind = m.group()
        elif group == "id":
            kind = m.group() if m.group() in KEYWORDS else "id"
        else:
            kind = group
            if group == "bad":
                out.errors.append((start, "character or quote that starts no token"))
        kinds.append(kind)
        out.starts.append(start)
        out.ends.append(pos)
    return out


class Rust(Parser):
    BINARY = {
        "..": 1, "..=": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9,
        "*": 10, "/": 10, "%": 10,
    }
    ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())

    def __init__(self, text: str):
        super().__init__(text, tokens(text))
        self.no_struct = False

    def unit(self) -> None:
        self.item(True)

    def group(self) -> None:
        if self.K[self.i] not in ("(", "[", "{") or self.i not in self.partner:
            raise self.fail("bracket without a partner")
        self.i = self.partner[self.i] + 1

    def attributes(self) -> None:
        while self.at("#"):
            self.i += 1
            self.take("!")
            if not self.at("["):
                raise self.fail()
            self.group()

    def visibility(self) -> None:
        if self.take("pub") and self.at("(") and self.K[self.i + 1] in ("crate", "self", "super", "in"):
            self.group()

    def item(self, needed: bool) -> bool:
        """An item; False if there is none and none is needed."""
        if self.take(";"):
            return True
        start = self.i
        self.attributes()
        if self.at("eof") and start != self.i:
            return True
        self.visibility()
        k = self.K[self.i]
        j = self.i
        while self.K[j] in ("const", "async", "unsafe", "extern", "str") or (self.K[j] == "id" and self.text[self.S[j] : self.E[j]] in ("default", "safe") and self.K[j + 1] in ("fn", "unsafe", "async", "const")):
            j += 1
        if self.K[j] == "fn":
            self.i = j + 1
            self.function()
        elif k == "struct" or (k == "id" and self.word() == "union" and self.K[self.i + 1] == "id" and self.K[self.i + 2] in ("{", "<")):
            self.i += 1
            self.need("id")
            self.generics()
            if self.at("("):
                self.tuple_fields()
                self.where()
                self.need(";")
            else:
                self.where()
                if not self.take(";"):
                    self.fields()
        elif k == "enum":
            self.i += 1
            self.need("id")
            self.generics()
            self.where()
            self.need("{")

            def variant() -> None:
                self.attributes()
                self.visibility()
                self.need("id")
                if self.at("("):
                    self.tuple_fields()
                elif self.at("{"):
                    self.fields()
                if self.take("="):
                    self.expression()

            self.separated(variant, "}")
        elif k in ("impl", "trait") or (k == "unsafe" and self.K[self.i + 1] in ("impl", "trait")):
            self.take("unsafe")
            if self.take("impl"):
                self.generics()
                self.take("!")
                self.type_()
                if self.take("for"):
                    self.type_()
            else:
                self.i += 1
                self.need("id")
                self.generics()
                if self.take(":"):
                    self.bounds()
            self.where()
            self.need("{")
            self.statements_until("}", lambda: self.item(True))
        elif k == "mod":
            self.i += 1
            self.need("id")
            if not self.take(";"):
                self.need("{")
                self.statements_until("}", lambda: self.item(True))
        elif k == "use":
            self.i += 1
            self.use_tree()
            self.need(";")
        elif k in ("const", "static") and self.K[self.i + 1] in ("id", "mut") and not (k == "static" and self.K[self.i + 1] in ("|", "||", "move")):
            self.i += 1
            self.take("mut")
            self.need("id")
            if self.take(":"):
                self.type_()
            if self.take("="):
                self.expression()
            self.need(";")
        elif k == "type":
            self.i += 1
            self.need("id")
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.type_()
            self.need(";")
        elif k == "extern" and self.K[self.i + 1] == "crate":
            self.i += 2
            self.need_any("id", "self")
            if self.take("as"):
                self.need("id")
            self.need(";")
        elif k == "extern":
            self.i += 1
            self.take("str")
            self.need("{")
            self.statements_until("}", lambda: self.item(True))
        elif k == "id" and self.word() == "macro_rules" and self.K[self.i + 1] == "!":
            self.i += 2
            self.need("id")
            brace = self.at("{")
            self.group()
            if not brace:
                self.need(";")
        elif needed and k in NAMES and self.K[self.i + 1] in ("!", "::"):
            self.path(False)
            self.need("!")
            brace = self.at("{")
            self.group()
            if not brace:
                self.need(";")
        elif needed:
            raise self.fail()
        else:
            self.i = start
            return False
        return True

    def use_tree(self) -> None:
        self.take("::")
        while True:
            if self.take("*"):
                return
            if self.take("{"):
                self.separated(self.use_tree, "}")
                return
            self.need_any(*NAMES)
            if not self.take("::"):
                break
        if self.take("as"):
            self.need("id")

    def tuple_fields(self) -> None:
        self.need("(")

        def one() -> None:
            self.attributes()
            self.visibility()
            self.type_()

        self.separated(one, ")")

    def fields(self) -> None:
        self.need("{")

        def one() -> None:
            self.attributes()
            self.visibility()
            self.need("id")
            self.need(":")
            self.type_()

        self.separated(one, "}")

    def function(self) -> None:
        self.need("id")
        self.generics()
        self.need("(")

        def one() -> None:
            self.attributes()
            if self.take("..."):
                return
            if self.attempt(self.receiver):
                return
            self.pattern()
            self.need(":")
            self.type_()

        self.separated(one, ")")
        if self.take("->"):
            self.type_()
        self.where()
        if not self.take(";"):
            self.block()

    def receiver(self) -> None:
        if self.take("&"):
            self.take("life")
        self.take("mut")
        self.need("self")
        if self.take(":"):
            self.type_()

    def generics(self) -> None:
        if not self.take("<"):
            return

        def one() -> None:
            self.attributes()
            if self.take("life"):
                if self.take(":"):
                    self.bounds()
                return
            if self.take("const"):
                self.need("id")
                self.need(":")
                self.type_()
                if self.take("="):
                    self.literal_or_block()
                return
            self.need("id")
            if self.take(":"):
                self.bounds()
            if self.take("="):
                self.type_()

        self.separated(one, ">")

    def literal_or_block(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.take("-")
            self.need_any("num", "str", "true", "false", "id")

    def where(self) -> None:
        if not self.take("where"):
            return
        while not self.at("{", ";", "="):
            if not self.take("life"):
                self.for_lifetimes()
                self.type_()
            self.need(":")
            self.bounds()
            if not self.take(","):
                break

    def for_lifetimes(self) -> None:
        if self.at("for") and self.K[self.i + 1] == "<":
            self.i += 1
            self.generics()

    def bounds(self) -> None:
        while True:
            if self.take("("):
                self.bounds()
                self.need(")")
            elif not self.take("life"):
                if self.at("~"):
                    self.i += 1
                    self.need("const")
                self.take("?")
                self.for_lifetimes()
                if not self.at("id", "crate", "self", "super", "Self", "::", "<"):
                    return
                self.path(False)
            if not self.take("+"):
                return

    def type_(self) -> None:
        k = self.K[self.i]
        if k in ("&", "&&"):
            self.i += 1
            self.take("life")
            self.take("mut")
            self.type_()
        elif k == "*":
            self.i += 1
            self.take("const") or self.need("mut")
            self.type_()
        elif k == "[":
            self.i += 1
            self.type_()
            if self.take(";"):
                self.expression()
            self.need("]")
        elif k == "(":
            self.i += 1
            self.separated(self.type_, ")")
        elif k == "!":
            self.i += 1
        elif k in ("dyn", "impl"):
            self.i += 1
            self.bounds()
        elif k in ("fn", "unsafe", "extern") or (k == "for" and self.K[self.i + 1] == "<"):
            self.for_lifetimes()
            self.take("unsafe")
            if self.take("extern"):
                self.take("str")
            if not self.take("fn"):
                self.path(False)
                return
            self.need("(")

            def one() -> None:
                if self.K[self.i] == "id" and self.K[self.i + 1] == ":":
                    self.i += 2
                if not self.take("..."):
                    self.type_()

            self.separated(one, ")")
            if self.take("->"):
                self.type_()
        elif k == "id" and self.word() == "_":
            self.i += 1
        else:
            self.path(False)
            if self.at("!"):
                self.i += 1
                self.group()

    def type_arguments(self) -> None:
        if self.at("<<"):
            raise self.fail()
        self.need("<")

        def one() -> None:
            if self.take("life"):
                return
            if self.K[self.i] == "id" and self.K[self.i + 1] in ("=", ":"):
                self.i += 1
                if self.take("="):
                    self.type_()
                else:
                    self.i += 1
                    self.bounds()
                return
            if self.at("num", "str", "{", "-", "true", "false"):
                self.literal_or_block()
                return
            self.type_()

        self.separated(one, ">")

    def path(self, value: bool) -> None:
        if self.take("<"):
            self.type_()
            if self.take("as"):
                self.type_()
            self.need(">")
            self.need("::")
        else:
            self.take("::")
        while True:
            self.need_any(*NAMES)
            if self.at("<") and not value:
                self.type_arguments()
            elif self.at("(") and not value and self.K[self.i - 1] == "id" and self.text[self.S[self.i - 1] : self.E[self.i - 1]] in ("Fn", "FnMut", "FnOnce"):
                self.i += 1
                self.separated(self.type_, ")")
                if self.take("->"):
                    self.type_()
            if not self.at("::"):
                return
            if self.K[self.i + 1] == "<":
                self.i += 1
                self.type_arguments()
                if not self.take("::"):
                    return
            elif self.K[self.i + 1] in NAMES:
                self.i += 1
            else:
                raise self.fail()

    # -- patterns

    def pattern(self) -> None:
        self.take("|")
        self.pattern_item()
        while self.take("|"):
            self.pattern_item()

    def pattern_item(self) -> None:
        k = self.K[self.i]
        if k in ("&", "&&"):
            self.i += 1
            self.take("mut")
            self.pattern_item()
        elif k in ("(", "["):
            self.i += 1
            self.separated(self.pattern, ")" if k == "(" else "]")
        elif k in ("ref", "mut"):
            self.i += 1
            self.take("mut")
            self.need("id")
            if self.take("@"):
                self.pattern_item()
        elif k in ("num", "str", "-", "true", "false"):
            self.take("-")
            self.i += 1
            self.range_end()
        elif k in ("..", "..="):
            self.i += 1
            if self.at("num", "str", "-", "id"):
                self.take("-")
                self.i += 1
        else:
            single = k == "id"
            start = self.i
            self.path(True)
            if self.at("!"):
                self.i += 1
                self.group()
            elif self.take("("):
                self.separated(self.pattern, ")")
            elif self.take("{"):

                def one() -> None:
                    self.attributes()
                    if self.take(".."):
                        return
                    self.take("ref")
                    self.take("mut")
                    self.need_any("id", "num")
                    if self.take(":"):
                        self.pattern()

                self.separated(one, "}")
            elif single and self.i == start + 1 and self.take("@"):
                self.pattern_item()
            else:
                self.range_end()

    def range_end(self) -> None:
        if self.at("..", "..=", "..."):
            self.i += 1
            if self.at("num", "str", "-"):
                self.take("-")
                self.i += 1
            elif self.at(*NAMES):
                self.path(True)

    # -- statements

    def block(self) -> None:
        self.need("{")
        kept, self.no_struct = self.no_struct, False
        self.statements_until("}", self.statement)
        self.no_struct = kept

    def statement(self) -> None:
        if self.take(";"):
            return
        if self.item(False):
            return
        self.attributes()
        if self.at("let"):
            self.i += 1
            self.pattern()
            if self.take(":"):
                self.type_()
            if self.take("="):
                self.expression()
                if self.take("else"):
                    self.block()
            self.need(";")
            return
        start = self.i
        k = self.K[self.i]
        if k == "life" and self.K[self.i + 1] == ":":
            self.i += 2
            k = self.K[self.i]
        if k in ("if", "match", "while", "for", "loop", "{") or (k in ("unsafe", "async", "const") and self.K[self.i + 1] in ("{", "move")):
            self.blocklike()
            if not self.at(".", "?"):
                self.take(";")
                return
            self.postfix_tail()
            self.rest()
        elif k in NAMES and self.attempt(self.brace_macro):
            return
        else:
            self.i = start
            self.expression()
        if not self.take(";") and not self.at("}"):
            self.need(";")

    def rest(self) -> None:
        """Operators after an operand already read."""
        while True:
            k = self.K[self.i]
            if k in self.BINARY:
                self.i += 1
                self.binary(self.BINARY[k] + 1)
            elif k in self.ASSIGN:
                self.i += 1
                self.expression()
            else:
                return

    def brace_macro(self) -> None:
        self.path(True)
        self.need("!")
        if not self.at("{"):
            raise self.fail()
        self.group()

    def blocklike(self) -> None:
        k = self.K[self.i]
        if k in ("unsafe", "async", "const"):
            self.i += 1
            self.take("move")
            self.block()
        elif k == "{":
            self.block()
        elif k == "if":
            self.i += 1
            self.condition()
            self.block()
            if self.take("else"):
                if self.at("if"):
                    self.blocklike()
                else:
                    self.block()
        elif k == "while":
            self.i += 1
            self.condition()
            self.block()
        elif k == "for":
            self.i += 1
            self.pattern()
            self.need("in")
            self.condition()
            self.block()
        elif k == "loop":
            self.i += 1
            self.block()
        else:
            self.need("match")
            self.condition()
            self.need("{")
            kept, self.no_struct = self.no_struct, False
            while not self.take("}"):
                if self.at("eof"):
                    raise self.fail()
                self.attributes()
                self.pattern()
                if self.take("if"):
                    self.expression()
                self.need("=>")
                brace = self.at("{")
                if brace:
                    self.block()
                    if self.at(".", "?"):
                        self.postfix_tail()
                        self.rest()
                else:
                    self.expression()
                if not self.take(",") and not self.at("}") and not (brace and self.K[self.i - 1] == "}"):
                    self.need(",")
            self.no_struct = kept

    def condition(self) -> None:
        kept, self.no_struct = self.no_struct, True
        self.expression()
        self.no_struct = kept

    # -- expressions

    def expression(self) -> None:
        k = self.K[self.i]
        if k == "return" or k == "break":
            self.i += 1
            if k == "break":
                self.take("life")
            if not self.at(";", "}", ")", ",", "]", "=>"):
                self.expression()
            return
        self.binary()
        if self.K[self.i] in self.ASSIGN or (self.at(">") and self.K[self.i + 1] == ">="):
            self.i += 1
            self.take(">=")
            self.expression()

    def binary(self, least: int = 0) -> None:
        if self.at("..", "..="):
            self.i += 1
            if not self.at(")", "]", "}", ",", ";", "{", "=>"):
                self.binary(2)
        else:
            self.unary()
        K = self.K
        while True:
            k = K[self.i]
            if k == "as":
                self.i += 1
                self.type_()
                continue
            step = 1
            if k == ">" and K[self.i + 1] == ">" and self.S[self.i + 1] == self.S[self.i] + 1:
                k, step = ">>", 2
            p = self.BINARY.get(k, -1)
            if p < least:
                return
            self.i += step
            if p == 1 and (self.at(")", "]", "}", ",", ";", "=>") or (self.at("{") and self.no_struct)):
                continue
            self.binary(p + 1)

    def unary(self) -> None:
        while True:
            k = self.K[self.i]
            if k in ("-", "!", "*"):
                self.i += 1
            elif k in ("&", "&&"):
                self.i += 1
                if self.is_word("raw") and self.K[self.i + 1] in ("const", "mut"):
                    self.i += 2
                self.take("mut")
            else:
                break
        if self.at("let"):
            self.i += 1
            self.pattern()
            self.need("=")
            self.binary(4)
            return
        self.primary()
        self.postfix_tail()

    def postfix_tail(self) -> None:
        while True:
            k = self.K[self.i]
            if k == "?":
                self.i += 1
            elif k == ".":
                self.i += 1
                if self.take("num") or self.take("await"):
                    continue
                self.need("id")
                if self.at("::"):
                    self.i += 1
                    self.type_arguments()
            elif k == "(":
                self.i += 1
                self.inside(")")
            elif k == "[":
                self.i += 1
                self.inside("]")
            else:
                return

    def inside(self, end: str) -> None:
        kept, self.no_struct = self.no_struct, False

        def one() -> None:
            if self.K[self.i] in ("num", "str") and self.K[self.i + 1] in (",", end):
                self.i += 1
                return
            self.attributes()
            self.expression()

        self.separated(one, end)
        self.no_struct = kept

    def primary(self) -> None:
        k = self.K[self.i]
        if k in ("num", "str", "true", "false"):
            self.i += 1
        elif k in NAMES or k in ("::", "<"):
            self.path(True)
            if self.at("!") and self.K[self.i + 1] in ("(", "[", "{"):
                self.i += 1
                self.group()
            elif self.at("{") and not self.no_struct:
                self.struct_literal()
        elif k == "(":
            self.i += 1
            self.inside(")")
        elif k == "[":
            self.i += 1
            kept, self.no_struct = self.no_struct, False
            if not self.at("]"):
                self.expression()
                if self.take(";"):
                    self.expression()
                    self.need("]")
                elif not self.take("]"):
                    self.need(",")
                    self.inside("]")
            else:
                self.i += 1
            self.no_struct = kept
        elif k in ("|", "||", "move", "static") or (k == "async" and self.K[self.i + 1] in ("|", "||", "move") and self.K[self.i + 2] != "{"):
            self.closure()
        elif k == "life":
            self.i += 1
            self.need(":")
            self.blocklike()
        elif k in ("if", "match", "while", "for", "loop", "{", "unsafe", "async", "const"):
            self.blocklike()
        elif k in ("return", "break"):
            self.expression()
        elif k == "continue":
            self.i += 1
            self.take("life")
        else:
            raise self.fail()

    def struct_literal(self) -> None:
        at = self.i
        self.need("{")

        def one() -> None:
            self.attributes()
            if self.take(".."):
                if not self.at("}"):
                    self.expression()
                return
            self.need_any("id", "num")
            if self.take(":"):
                self.expression()

        try:
            self.separated(one, "}")
        except Problem:
            self.i = at
            raise

    def closure(self) -> None:
        self.take("static")
        self.take("async")
        self.take("move")
        if not self.take("||"):
            self.need("|")

            def one() -> None:
                self.attributes()
                self.pattern_item()
                if self.take(":"):
                    self.type_()

            self.separated(one, "|")
        if self.take("->"):
            self.type_()
            self.block()
        else:
            self.expression()


def check(text: str, extension: str) -> list[tuple[int, str]]:
    if text.startswith("#!") and not text.startswith("#!["):
        text = "//" + text[2:]
    return Rust(text).run()
