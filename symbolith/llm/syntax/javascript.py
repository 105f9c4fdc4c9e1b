"""JavaScript (modules, JSX) and TypeScript."""

from __future__ import annotations

import re

from symbolith.llm.syntax.core import Parser, Problem, Tokens

#: Reserved words of the language.
KEYWORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*[\s\S]*?\*/|<!--[^\n]*(?!))
    |(?P<num>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?![\w$]))
    |(?P<id>(?:[^\W\d]|[$]|\\u[\da-fA-F]{4})(?:[\w$‌‍]|\\u[\da-fA-F]{4})*|\#[^\W\d][\w$]*)
    |(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@])
    |(?P<tick>`)
    |(?P<bad>\S)""",
    re.X,
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
#: After these a slash or an angle bracket begins a value.
VALUE_ENDS = frozenset(("id", "num", "str", "regex", "template)", "jsx)", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"))
TAG = re.compile(r"\s*([\w$.:-]*)")
ATTRIBUTE = re.compile(r"\s*([\w$:-]+)(\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?=\{)))?")


def tokens(text: str, jsx: bool) -> Tokens:
    out = Tokens()
    end = code(text, 2 if text.startswith("#!") and "\n" in text else 0, out, jsx, False) if not text.startswith("#!") else code(text, (text + "\n").find("\n"), out, jsx, False)
    if end < len(text):
        out.errors.append((end, "unexpected }"))
    return out


def code(text: str, pos: int, out: Tokens, jsx: bool, inside: bool) -> int:
    """Tokens from ``pos``; inside a template or JSX up to the closing brace, whose offset is returned."""
    depth, size, kinds = 0, len(text), out.kinds
    match = TOKEN.search
    while pos < size:
        m = match(text, pos)
        if not m:
            return size
        start, group = m.start(), m.lastgroup
        if group == "skip":
            pos = m.end()
            continue
        if group == "tick":
            pos = template(text, start, out, jsx)
            continue
        kind = m.group()
        if group == "op":
            c = kind[0]
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if inside and depth < 0:
                    return start
            elif (c == "/" or (c == "<" and jsx)) and not (kinds and kinds[-1] in VALUE_ENDS):
                if c == "/":
                    r = REGEX.match(text, start)
                    if r:
                        out.add("regex", start, r.end())
                        pos = r.end()
                        continue
                elif re.match(r"<\s*(?:[A-Za-z_$]|>)", text[start : start + 40]):
                    pos = element(text, start, out)
                    continue
        elif group == "id":
            if kind not in KEYWORDS or (kinds and kinds[-1] in (".", "?.")):
                kind = "id"
        else:
            kind = group
            if group == "bad":
                out.errors.append((start, "character or quote that starts no token"))
        out.add(kind, start, m.end())
        pos = m.end()
    return size


def template(text: str, start: int, out: Tokens, jsx: bool) -> int:
    out.add("template(", start, start + 1)
    pos, size = start + 1, len(text)
    while pos < size:
        c = text[pos]
        if c == "\\":
            pos += 2
        elif c == "`":
            out.add("template)", pos, pos + 1)
            return pos + 1
        elif c == "$" and text.startswith("${", pos):
            out.add("${", pos, pos + 2)
            pos = code(text, pos + 2, out, jsx, True)
            if pos < size:
                out.add("$}", pos, pos + 1)
            pos += 1
        else:
            nxt = re.compile(r"[\\`$]").search(text, pos + 1)
            pos = nxt.start() if nxt else size
    out.errors.append((start, "template without an end"))
    return size


def element(text: str, start: int, out: Tokens) -> int:
    """A JSX element: its embedded expressions become tokens, tags must match."""
    size = len(text)
    out.add("jsx(", start, start + 1)

    def expression(at: int) -> int:
        out.add("${", at, at + 1)
        end = code(text, at + 1, out, True, True)
        out.add("$}", end, end + 1)
        return end + 1

    def fail(at: int, message: str) -> int:
        out.errors.append((at, message))
        out.add("jsx)", at, at)
        return max(at, start + 1)

    stack: list[str] = []
    pos = start
    while True:
        m = TAG.match(text, pos + 1)
        name, pos = m.group(1), m.end()
        while True:
            pos = re.compile(r"\s*").match(text, pos).end()
            if text.startswith("{", pos):
                pos = expression(pos)
            elif text.startswith("/>", pos) or text.startswith(">", pos):
                break
            else:
                a = ATTRIBUTE.match(text, pos)
                if not a:
                    return fail(pos, "expected an attribute or the end of a tag")
                pos = a.end()
                if a.group(2) and text.startswith("{", pos):
                    pos = expression(pos)
        if text.startswith(">", pos):
            stack.append(name)
            pos += 1
        else:
            pos += 2
        while stack:
            brace = re.compile(r"[<{>}]").search(text, pos)
            if not brace:
                return fail(size, f"element <{stack[-1]}> without an end")
            pos = brace.start()
            if text[pos] == "{":
                pos = expression(pos)
            elif text[pos] in ">}":
                return fail(pos, f"unexpected {text[pos]} in an element")
            elif close := re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(text, pos):
                if close.group(1) != stack.pop():
                    return fail(pos, f"unexpected closing tag {close.group(1)}")
                pos = close.end()
            elif re.compile(r"<\s*(?:[A-Za-z_$]|>)").match(text, pos):
                break
            else:
                return fail(pos, "unexpected < in an element")
        if not stack:
            out.add("jsx)", pos - 1, pos)
            return pos


ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
MODIFIERS = frozenset("public private protected readonly static abstract declare override async accessor".split())


class Script(Parser):
    BINARY = {
        "??": 1, "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "===": 6, "!==": 6, "<": 7, ">": 7, "<=": 7, ">=": 7,
        "instanceof": 7, "in": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "**": 11,
    }

    def __init__(self, text: str, typed: bool, jsx: bool):
        super().__init__(text, tokens(text, jsx))
        self.typed = typed
        self.no_in = False

    def unit(self) -> None:
        self.statement()

    def end(self) -> None:
        if not self.take(";") and not self.at("}") and not self.newline_before():
            raise self.fail()

    # -- statements

    def block(self) -> None:
        self.need("{")
        self.statements_until("}", self.statement)

    def statement(self) -> None:
        k = self.K[self.i]
        method = self.STATEMENTS.get(k)
        if method:
            method(self)
            return
        if k == "id":
            word, nxt = self.word(), self.K[self.i + 1]
            if nxt == ":":
                self.i += 2
                self.statement()
                return
            if word == "async" and nxt == "function" and not self.line_break_after():
                self.i += 1
                self.function(True)
                return
            if word == "let" and nxt in ("id", "[", "{"):
                self.variables()
                return
            if self.typed and self.typed_statement(word, nxt):
                return
        elif k == "@":
            while self.at("@"):
                self.decorator()
            if not (self.at("class", "export") or self.is_word("abstract")):
                raise self.fail("expected a class after a decorator")
            self.statement()
            return
        elif k == "import" and self.K[self.i + 1] not in ("(", "."):
            self.import_()
            return
        self.expression()
        self.end()

    def line_break_after(self) -> bool:
        return "\n" in self.text[self.E[self.i] : self.S[self.i + 1]]

    def typed_statement(self, word: str, nxt: str) -> bool:
        if self.line_break_after():
            return False
        if word == "interface" and nxt == "id":
            self.i += 2
            self.type_parameters()
            if self.take("extends"):
                self.type_()
                while self.take(","):
                    self.type_()
            self.object_type()
        elif word == "type" and nxt == "id":
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.type_()
            self.end()
        elif word in ("namespace", "module") and nxt in ("id", "str"):
            self.i += 2
            while self.take("."):
                self.need("id")
            if self.at("{"):
                self.block()
            else:
                self.end()
        elif word == "declare" and nxt in ("id", "function", "class", "const", "var", "enum", "import"):
            self.i += 1
            if self.is_word("global"):
                self.i += 1
                self.block()
            elif self.at("const", "var") and self.K[self.i + 1] != "enum":
                self.variables(False)
            else:
                self.statement()
        elif word == "abstract" and nxt == "class":
            self.i += 1
            self.class_(True)
        else:
            return False
        return True

    def variables(self, strict: bool = True) -> None:
        constant = self.K[self.i] == "const"
        self.i += 1
        if constant and self.typed and self.at("enum"):
            self.enum()
            return
        while True:
            pattern = self.at("[", "{")
            self.target()
            if self.typed:
                self.take("!")
                if self.take(":"):
                    self.type_()
            if self.take("="):
                self.assignment()
            elif strict and (constant or pattern) and not (self.at("in") or self.is_word("of")):
                raise self.fail("declaration without a value")
            if not self.take(","):
                break
        if not self.no_in:
            self.end()

    def target(self) -> None:
        k = self.K[self.i]
        if k == "id":
            self.i += 1
        elif k == "[":
            self.i += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.target()
                if self.take("="):
                    self.assignment()
                if not self.at("]"):
                    self.need(",")
        elif k == "{":
            self.i += 1
            while not self.take("}"):
                if self.take("..."):
                    self.target()
                else:
                    name = self.at("id")
                    self.property_name()
                    if self.take(":"):
                        self.target()
                    elif not name:
                        raise self.fail()
                    if self.take("="):
                        self.assignment()
                if not self.at("}"):
                    self.need(",")
        else:
            raise self.fail()

    def if_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def while_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def with_(self) -> None:
        self.while_()

    def do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.take(";")

    def for_(self) -> None:
        self.i += 1
        if self.is_word("await"):
            self.i += 1
        self.need("(")
        self.no_in = True
        try:
            if self.at("var", "const") or (self.is_word("let") and self.K[self.i + 1] in ("id", "[", "{")):
                self.variables()
            elif not self.at(";"):
                self.expression()
        finally:
            self.no_in = False
        if self.take("in"):
            self.expression()
        elif self.is_word("of"):
            self.i += 1
            self.assignment()
        else:
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
        self.need(")")
        self.statement()

    def switch(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                if self.at("eof"):
                    raise self.fail()
                self.guarded(self.statement)

    def try_(self) -> None:
        self.i += 1
        self.block()
        if self.take("catch"):
            if self.take("("):
                self.target()
                if self.typed and self.take(":"):
                    self.type_()
                self.need(")")
            self.block()
            if self.take("finally"):
                self.block()
        else:
            self.need("finally")
            self.block()

    def throw(self) -> None:
        self.i += 1
        if self.newline_before():
            raise self.fail()
        self.expression()
        self.end()

    def return_(self) -> None:
        self.i += 1
        if not (self.at(";", "}") or self.newline_before()):
            self.expression()
        self.end()

    def jump(self) -> None:
        self.i += 1
        if self.at("id") and not self.newline_before():
            self.i += 1
        self.end()

    def empty(self) -> None:
        self.i += 1

    def function(self, named: bool) -> None:
        self.need("function")
        self.take("*")
        if self.at("id"):
            self.i += 1
        elif named:
            raise self.fail()
        self.signature()
        if self.typed and not self.at("{"):
            self.end()
        else:
            self.block()

    def function_statement(self) -> None:
        self.function(True)

    def signature(self) -> None:
        if self.typed:
            self.type_parameters()
        self.need("(")
        self.separated(self.parameter, ")")
        if self.typed and self.take(":"):
            self.return_type()

    def parameter(self) -> None:
        while self.at("@"):
            self.decorator()
        if self.typed:
            while self.K[self.i] == "id" and self.word() in MODIFIERS and self.K[self.i + 1] in ("id", "{", "["):
                self.i += 1
        self.take("...")
        if self.typed and self.at("this"):
            self.i += 1
        else:
            self.target()
        if self.typed:
            self.take("?")
            if self.take(":"):
                self.type_()
        if self.take("="):
            self.assignment()

    def decorator(self) -> None:
        self.need("@")
        if self.at("("):
            self.condition()
        else:
            self.need("id")
            while self.take("."):
                self.need("id")
            if self.at("("):
                self.i += 1
                self.separated(self.argument, ")")

    def class_statement(self) -> None:
        self.class_(True)

    def class_(self, named: bool) -> None:
        self.need("class")
        if self.at("id") and not (self.word() == "implements" and not named):
            self.i += 1
        elif named:
            raise self.fail()
        if self.typed:
            self.type_parameters()
        if self.take("extends"):
            self.unary()
            if self.typed and self.at("<"):
                self.type_arguments()
        if self.typed and self.is_word("implements"):
            self.i += 1
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        self.statements_until("}", self.member)

    def member(self) -> None:
        if self.take(";"):
            return
        while self.at("@"):
            self.decorator()
        if self.is_word("static") and self.K[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        words = MODIFIERS if self.typed else ("static", "async", "accessor")
        while self.K[self.i] == "id" and self.word() in words and self.K[self.i + 1] not in ("(", "=", ";", "}", ":", "?", "!", "<", ","):
            self.i += 1
        if self.typed and self.at("[") and self.K[self.i + 1] == "id" and self.K[self.i + 2] == ":":
            self.i += 3
            self.type_()
            self.need("]")
            self.need(":")
            self.type_()
            self.end()
            return
        self.take("*")
        if self.is_word("get", "set") and self.K[self.i + 1] not in ("(", "=", ";", "}", ":", "?", "!", "<"):
            self.i += 1
        self.property_name()
        if self.typed:
            self.take("?") or self.take("!")
        if self.at("(", "<"):
            self.signature()
            if self.typed and not self.at("{"):
                self.end()
            else:
                self.block()
            return
        if self.typed and self.take(":"):
            self.type_()
        if self.take("="):
            self.assignment()
        self.end()

    def property_name(self) -> None:
        k = self.K[self.i]
        if k == "[":
            self.i += 1
            self.assignment()
            self.need("]")
        elif k in ("id", "str", "num") or (k.isalpha() and k != "eof" and k not in ("bad", "regex")):
            self.i += 1
        else:
            raise self.fail()

    def enum(self) -> None:
        if not self.typed:
            raise self.fail()
        self.need("enum")
        self.need("id")
        self.need("{")

        def entry() -> None:
            self.property_name()
            if self.take("="):
                self.assignment()

        self.separated(entry, "}")

    def import_(self) -> None:
        self.i += 1
        if self.take("str"):
            self.attributes()
            self.end()
            return
        if self.is_word("type") and self.K[self.i + 1] in ("id", "{", "*") and not (self.K[self.i + 1] == "id" and self.word(1) == "from" and self.K[self.i + 2] == "str"):
            self.i += 1
        if self.at("id"):
            self.i += 1
            if self.typed and self.take("="):
                self.expression()
                self.end()
                return
            if self.at("{", "*"):
                raise self.fail()
            self.take(",")
        if self.take("*"):
            if not self.is_word("as"):
                raise self.fail()
            self.i += 1
            self.need("id")
        elif self.take("{"):
            self.names()
        if not self.is_word("from"):
            raise self.fail()
        self.i += 1
        self.need("str")
        self.attributes()
        self.end()

    def attributes(self) -> None:
        if self.at("with") or self.is_word("assert"):
            self.i += 1
            self.primary()

    def names(self) -> None:
        def name() -> None:
            if self.is_word("type") and self.K[self.i + 1] == "id" and self.word(1) != "as":
                self.i += 1
            self.property_name()
            if self.is_word("as"):
                self.i += 1
                self.property_name()

        self.separated(name, "}")

    def export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.at("function"):
                self.function(False)
            elif self.at("class"):
                self.class_(False)
            elif self.is_word("async") and self.K[self.i + 1] == "function":
                self.i += 1
                self.function(False)
            elif self.typed and self.is_word("abstract", "interface"):
                self.statement()
            else:
                self.assignment()
                self.end()
            return
        if self.typed and self.is_word("type") and self.K[self.i + 1] in ("{", "*"):
            self.i += 1
        if self.take("*"):
            if self.is_word("as"):
                self.i += 1
                self.property_name()
            if not self.is_word("from"):
                raise self.fail()
            self.i += 1
            self.need("str")
            self.end()
        elif self.take("{"):
            self.names()
            if self.is_word("from"):
                self.i += 1
                self.need("str")
                self.attributes()
            self.end()
        elif self.typed and self.take("="):
            self.expression()
            self.end()
        elif self.at("var", "const", "function", "class", "@", "enum", "import") or self.is_word("let", "async", "type", "interface", "namespace", "abstract", "declare", "module"):
            self.statement()
        else:
            raise self.fail()

    STATEMENTS = {
        "{": block, ";": empty, "var": variables, "const": variables, "if": if_, "for": for_, "while": while_, "do": do, "switch": switch, "try": try_,
        "throw": throw, "return": return_, "break": jump, "continue": jump, "debugger": jump, "function": function_statement, "class": class_statement,
        "enum": enum, "export": export, "with": with_,
    }

    # -- expressions

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def argument(self) -> None:
        self.take("...")
        self.assignment()

    def assignment(self) -> None:
        K, i = self.K, self.i
        k = K[i]
        if k in ("num", "str") and K[i + 1] in (",", "]", ")", "}", ";"):
            self.i = i + 1
            return
        if k == "id":
            word = self.word()
            if K[i + 1] == "=>":
                self.i += 2
                self.arrow_body()
                return
            if word == "async" and not self.line_break_after():
                if K[i + 1] == "id" and K[i + 2] == "=>":
                    self.i += 3
                    self.arrow_body()
                    return
                if K[i + 1] in ("(", "<") and self.attempt(self.arrow, i + 1):
                    self.arrow_body()
                    return
            if word == "yield":
                self.i += 1
                self.take("*")
                if not (self.at(")", "]", "}", ",", ";", ":", "$}") or self.newline_before()):
                    self.assignment()
                return
        elif k == "(":
            p = self.partner.get(i)
            if p is not None and (K[p + 1] == "=>" or (self.typed and K[p + 1] == ":")) and (K[p + 1] == "=>" or self.attempt(self.arrow, i)):
                if self.i == i:
                    self.arrow(i)
                self.arrow_body()
                return
        elif k == "<" and self.typed and self.attempt(self.arrow, i):
            self.arrow_body()
            return
        self.conditional()
        if self.K[self.i] in ASSIGN:
            last = self.K[self.i - 1]
            if last not in ("id", "]", ")", "}", "!"):
                raise self.fail("invalid target of an assignment")
            self.i += 1
            self.assignment()

    def arrow(self, at: int) -> None:
        self.i = at
        self.signature()
        self.need("=>")

    def arrow_body(self) -> None:
        kept, self.no_in = self.no_in, False
        if self.at("{"):
            self.block()
        else:
            self.assignment()
        self.no_in = kept

    def conditional(self) -> None:
        self.binary()
        if self.take("?"):
            kept, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = kept
            self.need(":")
            self.assignment()

    def binary(self, least: int = 0) -> None:
        self.unary()
        K, S = self.K, self.S
        while True:
            k = K[self.i]
            p = self.BINARY.get(k, -1)
            if p < 0:
                if self.typed and k == "id" and self.word() in ("as", "satisfies") and not self.newline_before():
                    self.i += 1
                    if not self.take("const"):
                        self.type_()
                    continue
                return
            if k == "in" and self.no_in:
                return
            if k == ">":
                while K[self.i + 1] == ">" and S[self.i + 1] == S[self.i] + 1:
                    self.i += 1
                    p = 8
                if p == 8 and K[self.i + 1] in (">=", "=") and S[self.i + 1] == S[self.i] + 1:
                    self.i += 1
            if p < least:
                return
            self.i += 1
            self.binary(p if k == "**" else p + 1)

    PREFIX = frozenset(("!", "~", "+", "-", "typeof", "void", "delete", "++", "--"))

    def unary(self) -> None:
        K = self.K
        while True:
            k = K[self.i]
            if k in self.PREFIX:
                self.i += 1
            elif k == "id" and K[self.i + 1] in ("id", "num", "str", "(", "this", "new", "[", "function", "template(", "super", "import", "null") and self.word() == "await":
                if K[self.i + 1] in ("(", "["):
                    break
                self.i += 1
            elif k == "<" and self.typed:
                self.type_arguments()
            else:
                break
        self.postfix()
        if self.at("++", "--") and not self.newline_before():
            if self.K[self.i - 1] not in ("id", "]", ")", "!"):
                raise self.fail("invalid operand")
            self.i += 1

    def postfix(self) -> None:
        self.primary()
        K = self.K
        while True:
            k = K[self.i]
            if k == "." or k == "?.":
                self.i += 1
                if k == "?." and self.at("(", "[", "template("):
                    continue
                self.need("id")
            elif k == "(":
                self.i += 1
                self.separated(self.argument, ")")
            elif k == "[":
                self.i += 1
                kept, self.no_in = self.no_in, False
                self.expression()
                self.no_in = kept
                self.need("]")
            elif k == "template(":
                self.template()
            elif k == "!" and self.typed and not self.newline_before() and K[self.i + 1] != "=":
                self.i += 1
            elif k == "<" and self.typed and self.attempt(self.generic_call):
                continue
            else:
                return

    def generic_call(self) -> None:
        self.type_arguments()
        if not self.at("(", "template("):
            raise self.fail()

    def template(self) -> None:
        self.i += 1
        while not self.take("template)"):
            self.need("${")
            self.expression()
            self.need("$}")

    def primary(self) -> None:
        k = self.K[self.i]
        if k in ("id", "num", "str", "regex", "this", "super", "null", "true", "false"):
            self.i += 1
        elif k == "(":
            self.i += 1
            kept, self.no_in = self.no_in, False
            self.expression()
            self.no_in = kept
            self.need(")")
        elif k == "[":
            self.i += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.argument()
                if not self.at("]"):
                    self.need(",")
        elif k == "{":
            self.i += 1
            self.separated(self.property, "}")
        elif k == "function":
            self.function(False)
        elif k == "class":
            self.class_(False)
        elif k == "new":
            self.i += 1
            if self.take("."):
                self.need("id")
                return
            self.primary()
            while self.at(".", "["):
                if self.take("."):
                    self.need("id")
                else:
                    self.i += 1
                    self.expression()
                    self.need("]")
            if self.typed and self.at("<"):
                self.attempt(self.type_arguments)
            if self.take("("):
                self.separated(self.argument, ")")
        elif k == "template(":
            self.template()
        elif k == "jsx(":
            self.i += 1
            while not self.take("jsx)"):
                self.need("${")
                if not self.at("$}"):
                    self.argument()
                self.need("$}")
        elif k == "import":
            self.i += 1
            if self.take("."):
                self.need("id")
            else:
                self.need("(")
                self.separated(self.assignment, ")")
        else:
            raise self.fail()
        if k == "id" and self.K[self.i] == "function" and self.text[self.S[self.i - 1] : self.E[self.i - 1]] == "async":
            self.function(False)

    def property(self) -> None:
        if self.take("..."):
            self.assignment()
            return
        simple = self.at("id")
        special = simple and self.word() in ("get", "set", "async") and self.K[self.i + 1] not in (",", ":", "(", "}", "=")
        if special:
            self.i += 1
        star = self.take("*")
        self.property_name()
        if self.at("(") or (self.typed and self.at("<")):
            self.signature()
            self.block()
        elif special or star:
            raise self.fail()
        elif self.take(":"):
            self.assignment()
        elif not simple:
            raise self.fail()
        elif self.take("="):
            self.assignment()

    # -- types

    def type_parameters(self) -> None:
        if not self.take("<"):
            return
        while True:
            while self.at("const", "in") or (self.is_word("out") and self.K[self.i + 1] == "id"):
                self.i += 1
            self.need("id")
            if self.take("extends"):
                self.type_()
            if self.take("="):
                self.type_()
            if self.take(">"):
                return
            self.need(",")
            if self.take(">"):
                return

    def type_arguments(self) -> None:
        self.need("<")
        self.separated(self.type_, ">", False)

    def return_type(self) -> None:
        if self.is_word("asserts") and self.K[self.i + 1] in ("id", "this"):
            self.i += 1
        if self.K[self.i] in ("id", "this") and self.K[self.i + 1] == "id" and self.word(1) == "is":
            self.i += 2
        self.type_()

    def type_(self) -> None:
        if self.at("(", "<", "new") or (self.is_word("abstract") and self.K[self.i + 1] == "new"):
            if self.attempt(self.function_type):
                return
        self.take("|") or self.take("&")
        self.type_postfix()
        while self.at("|", "&"):
            self.i += 1
            self.type_postfix()
        if self.at("extends") and self.attempt(self.conditional_type):
            return

    def conditional_type(self) -> None:
        self.need("extends")
        self.type_()
        self.need("?")
        self.type_()
        self.need(":")
        self.type_()

    def function_type(self) -> None:
        if self.is_word("abstract"):
            self.i += 1
        self.take("new")
        self.type_parameters()
        self.need("(")
        self.separated(self.parameter, ")")
        self.need("=>")
        self.return_type()

    def type_postfix(self) -> None:
        while self.is_word("keyof", "unique", "readonly", "infer") and self.K[self.i + 1] in ("id", "(", "typeof", "this", "[", "{"):
            self.i += 1
        k = self.K[self.i]
        if k == "id":
            self.i += 1
            while self.take("."):
                self.need("id")
            if self.at("<"):
                self.type_arguments()
        elif k in ("str", "num", "null", "void", "this", "true", "false"):
            self.i += 1
        elif k == "-":
            self.i += 1
            self.need("num")
        elif k == "(":
            self.i += 1
            self.type_()
            self.need(")")
        elif k == "[":
            self.i += 1

            def item() -> None:
                self.take("...")
                if self.K[self.i] == "id" and self.K[self.i + 1] in (":", "?") and not (self.K[self.i + 1] == "?" and self.K[self.i + 2] != ":"):
                    self.i += 1
                    self.take("?")
                    self.need(":")
                self.type_()
                self.take("?")

            self.separated(item, "]")
        elif k == "{":
            self.object_type()
        elif k == "typeof":
            self.i += 1
            self.need("id")
            while self.take("."):
                self.need("id")
        elif k == "template(":
            self.i += 1
            while not self.take("template)"):
                self.need("${")
                self.type_()
                self.need("$}")
        elif k == "import":
            self.i += 1
            self.need("(")
            self.need("str")
            self.need(")")
            while self.take("."):
                self.need("id")
        else:
            raise self.fail()
        while self.at("[") and not self.newline_before():
            self.i += 1
            if not self.take("]"):
                self.type_()
                self.need("]")

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            while self.is_word("readonly", "get", "set") and self.K[self.i + 1] in ("id", "[", "str"):
                self.i += 1
            if self.at("+", "-"):
                self.i += 1
                self.need("id")
            if self.at("(", "<"):
                self.signature()
            elif self.at("new") and self.K[self.i + 1] in ("(", "<"):
                self.i += 1
                self.signature()
            elif self.at("[") and self.K[self.i + 1] == "id" and (self.K[self.i + 2] in (":", "in")):
                self.i += 3
                self.type_()
                if self.is_word("as"):
                    self.i += 1
                    self.type_()
                self.need("]")
                self.take("+") or self.take("-")
                self.take("?")
                if self.take(":"):
                    self.type_()
            else:
                self.property_name()
                self.take("?")
                if self.at("(", "<"):
                    self.signature()
                elif self.take(":"):
                    self.type_()
            if not (self.take(";") or self.take(",") or self.at("}") or self.newline_before()):
                raise self.fail()


def check(text: str, extension: str) -> list[tuple[int, str]]:
    typed = extension in ("ts", "mts", "cts", "tsx")
    return Script(text, typed, not typed or extension == "tsx").run()


__all__ = ["Problem", "check"]
