"""C with its preprocessor; also what Java and C# share with it."""

from __future__ import annotations

import re

from symbolith.llm.syntax.core import Parser, scan

NUMBER = r"""(?P<num>0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?[uUlLfF]*(?![\w])|0[bB][01_]+[uUlL]*(?![\w])|(?:\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[uUlLfFdDmM]*(?![\w]))"""
OPERATORS = r"""(?P<op>>>>=|<<=|>>=|\.\.\.|->|=>|::|\?\?=|\?\?|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@\#])"""
TOKEN = re.compile(
    rf"""(?P<skip>//(?:[^\n\\]|\\[\s\S])*|/\*[\s\S]*?\*/)|{NUMBER}
    |(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\[\s\S])*"|[uUL]?'(?:[^'\\\n]|\\[\s\S])+')
    |(?P<id>[^\W\d]\w*)|{OPERATORS}|(?P<bad>\S)""",
    re.X,
)
#: Reserved words of the language.
KEYWORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Alignas _Alignof _Static_assert _Thread_local _Noreturn _Atomic".split()
)
BASE_TYPES = frozenset("char double float int long short signed unsigned void _Bool".split())
QUALIFIERS = frozenset("const volatile restrict static extern inline register auto typedef _Thread_local _Noreturn _Atomic".split())
DIRECTIVE = re.compile(r"^[ \t]*\#[ \t]*(\w*)((?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*[\s\S]*?\*/)*)", re.M)
NEUTRAL = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|^[ \t]*\#[ \t]*\w*(?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*[\s\S]*?\*/)*", re.M)
#: Directives of the preprocessor.
DIRECTIVES = frozenset("include define undef if ifdef ifndef elif elifdef elifndef else endif error warning pragma line embed ident import include_next".split()) | {""}


def preprocess(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text with directives and the groups that don't count blanked (first branch taken, ``#if 0`` not), and errors."""
    errors: list[tuple[int, str]] = []
    stack: list[list] = []  # [start offset, a branch was taken, this branch counts]
    parts: list[str] = []
    last = 0
    blank = lambda s: re.sub(r"[^\n]", " ", s)

    def upto(end: int) -> None:
        piece = text[last:end]
        parts.append(piece if all(s[2] for s in stack) else blank(piece))

    for m in NEUTRAL.finditer(text):
        piece = m.group().lstrip()
        if not piece.startswith("#"):
            continue
        upto(m.start())
        last = m.end()
        parts.append(blank(m.group()))
        d = DIRECTIVE.match(m.group())
        word, rest = (d.group(1), d.group(2).strip()) if d else ("", "")
        if word in ("if", "ifdef", "ifndef"):
            counts = not (word == "if" and re.fullmatch(r"0+|\(\s*0\s*\)", re.sub(r"/\*.*?\*/|//.*", "", rest).strip() or "x"))
            if not rest and all(s[2] for s in stack):
                errors.append((m.start(), f"#{word} without a condition"))
            stack.append([m.start(), counts, counts])
        elif word in ("elif", "else", "elifdef", "elifndef"):
            if not stack:
                errors.append((m.start(), f"#{word} without #if"))
            else:
                stack[-1][2] = not stack[-1][1]
                stack[-1][1] = True
        elif word == "endif":
            if not stack:
                errors.append((m.start(), "#endif without #if"))
            else:
                stack.pop()
        elif all(s[2] for s in stack):
            if word not in DIRECTIVES:
                errors.append((m.start(), f"unknown directive #{word}"))
            elif word == "include" and not re.match(r'<[^>\n]+>|"[^"\n]+"|\w', rest):
                errors.append((m.start(), "#include without a file"))
            elif word in ("define", "undef") and not re.match(r"[^\W\d]", rest):
                errors.append((m.start(), f"#{word} without a name"))
    upto(len(text))
    errors += [(s[0], "#if without #endif") for s in stack]
    return "".join(parts), errors


class C(Parser):
    BINARY = {
        "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10,
    }
    ASSIGN = frozenset("= += -= *= /= %= <<= >>= &= |= ^=".split())

    def __init__(self, text: str):
        plain, errors = preprocess(text)
        super().__init__(plain, scan(plain, TOKEN, KEYWORDS))
        self.errors += errors

    def unit(self) -> None:
        if self.take(";"):
            return
        if self.at("extern") and self.K[self.i + 1] == "str":
            self.i += 2
            if self.take("{"):
                self.statements_until("}", self.unit)
                return
        self.declaration(True)

    # -- declarations

    def static_assert(self) -> bool:
        if self.at("_Static_assert") or (self.is_word("static_assert") and self.K[self.i + 1] == "("):
            self.i += 1
            self.arguments()
            self.need(";")
            return True
        return False

    def specifiers(self) -> bool:
        """Declaration specifiers; whether they name a type."""
        typed = False
        while True:
            k = self.K[self.i]
            if k in QUALIFIERS:
                self.i += 1
            elif k in BASE_TYPES:
                typed = True
                self.i += 1
            elif k in ("struct", "union"):
                typed = True
                self.i += 1
                self.attributes()
                named = self.take("id")
                if self.take("{"):
                    self.statements_until("}", self.field)
                elif not named:
                    raise self.fail()
            elif k == "enum":
                typed = True
                self.i += 1
                named = self.take("id")
                if self.take("{"):
                    self.separated(self.enumerator, "}")
                elif not named:
                    raise self.fail()
            elif k == "id" and self.word() in ("__attribute__", "__declspec", "_Alignas", "alignas", "__extension__", "__inline", "__inline__", "typeof", "__typeof__"):
                typed = typed or "typeof" in self.word()
                self.i += 1
                if self.at("("):
                    self.group()
            elif k == "id" and not typed and (self.K[self.i + 1] in ("id", "*", *BASE_TYPES, *QUALIFIERS) or (self.K[self.i + 1] == "(" and self.K[self.i + 2] == "*")):
                typed = True
                self.i += 1
            elif k == "id" and not typed and self.K[self.i + 1] in (")", ",", "[") and self.K[self.i - 1] in ("(", ",", "const", "volatile"):
                typed = True
                self.i += 1
            else:
                return typed

    def group(self) -> None:
        """A bracketed group, unread."""
        if self.i not in self.partner:
            raise self.fail("bracket without a partner")
        self.i = self.partner[self.i] + 1

    def attributes(self) -> None:
        while self.is_word("__attribute__", "__declspec", "__asm__", "asm") or (self.at("[") and self.K[self.i + 1] == "["):
            if self.at("["):
                self.group()
            else:
                self.i += 1
                self.group()

    def enumerator(self) -> None:
        self.need("id")
        if self.take("="):
            self.conditional()

    def field(self) -> None:
        if self.take(";") or self.static_assert():
            return
        if not self.specifiers():
            raise self.fail()
        if not self.take(";"):
            while True:
                if not self.at(":"):
                    self.declarator(False)
                if self.take(":"):
                    self.conditional()
                if self.take(";"):
                    return
                self.need(",")

    def declaration(self, outer: bool) -> None:
        if self.static_assert():
            return
        self.attributes()
        if outer and self.at("id") and self.K[self.i + 1] == "(" and self.partner.get(self.i + 1) and self.K[self.partner[self.i + 1] + 1] in (";", "{"):
            # a macro call, or a function without a type
            self.i += 1
            self.group()
            if not self.take(";"):
                self.block()
            return
        if not self.specifiers():
            raise self.fail()
        if self.take(";"):
            return
        while True:
            function = self.declarator(False)
            self.attributes()
            if outer and function and self.at("{"):
                self.block()
                return
            if self.take("="):
                self.initializer()
            if self.take(";"):
                return
            self.need(",")

    def declarator(self, abstract: bool) -> bool:
        """Whether it declares a function."""
        while self.at("*", "const", "volatile", "restrict") or self.is_word("__restrict"):
            self.i += 1
        self.attributes()
        if self.at("(") and (not abstract or self.K[self.i + 1] in ("*", "(")):
            self.i += 1
            self.declarator(abstract)
            self.need(")")
        elif self.at("id"):
            self.i += 1
        elif not abstract:
            raise self.fail()
        function = False
        while True:
            if self.take("["):
                while self.at("static", "const", "restrict", "volatile"):
                    self.i += 1
                if not self.at("]"):
                    if not (self.at("*") and self.K[self.i + 1] == "]"):
                        self.assignment()
                    else:
                        self.i += 1
                self.need("]")
            elif self.take("("):
                self.parameters()
                function = True
            else:
                return function

    def parameters(self) -> None:
        def one() -> None:
            if self.take("..."):
                return
            if not self.specifiers():
                if self.at("id") and self.K[self.i + 1] in (",", ")"):
                    self.i += 1
                    return
                raise self.fail()
            self.declarator(True)
            self.attributes()

        self.separated(one, ")", False)

    def initializer(self) -> None:
        if not self.take("{"):
            self.assignment()
            return

        def item() -> None:
            if self.K[self.i] in ("num", "str") and self.K[self.i + 1] in (",", "}"):
                self.i += 1
                return
            while self.at("[", ".") and not (self.at("[") and self.K[self.i + 1] == "["):
                if self.take("."):
                    self.need("id")
                else:
                    self.i += 1
                    self.conditional()
                    if self.take("..."):
                        self.conditional()
                    self.need("]")
                if self.at("="):
                    self.i += 1
                    break
            self.initializer()

        self.separated(item, "}")

    def type_name(self) -> None:
        if not self.specifiers():
            raise self.fail()
        self.declarator(True)

    # -- statements

    def block(self) -> None:
        self.need("{")
        self.statements_until("}", self.statement)

    def starts_declaration(self) -> bool:
        k = self.K[self.i]
        if k in BASE_TYPES or k in QUALIFIERS or k in ("struct", "union", "enum", "_Static_assert"):
            return True
        if k != "id":
            return False
        j = self.i + 1
        if self.K[j] == "id":
            return True
        if self.K[j] == "*":
            while self.K[j] in ("*", "const"):
                j += 1
            return self.K[j] == "id" and self.K[j + 1] in ("=", ";", ",", "[")
        return self.K[j] in ("const", "volatile")

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
        elif k in ("while", "switch"):
            self.i += 1
            self.condition()
            self.statement()
        elif k == "for":
            self.i += 1
            self.need("(")
            if self.starts_declaration():
                self.declaration(False)
            else:
                if not self.at(";"):
                    self.expression()
                self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
            self.need(")")
            self.statement()
        elif k == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif k == "case":
            self.i += 1
            self.conditional()
            if self.take("..."):
                self.conditional()
            self.need(":")
            self.labelled()
        elif k == "default":
            self.i += 1
            self.need(":")
            self.labelled()
        elif k == "goto":
            self.i += 1
            if self.take("*"):
                self.expression()
            else:
                self.need("id")
            self.need(";")
        elif k in ("break", "continue"):
            self.i += 1
            self.need(";")
        elif k == "return":
            self.i += 1
            if not self.at(";"):
                self.expression()
            self.need(";")
        elif k == ";":
            self.i += 1
        elif k == "id" and self.K[self.i + 1] == ":":
            self.i += 2
            self.labelled()
        elif self.is_word("asm", "__asm__"):
            self.i += 1
            while self.at("volatile", "goto") or self.is_word("__volatile__"):
                self.i += 1
            self.group()
            self.need(";")
        elif self.starts_declaration():
            self.declaration(False)
        else:
            self.expression()
            self.need(";")

    def labelled(self) -> None:
        if not self.at("}"):
            self.statement()

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    # -- expressions

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        self.conditional()
        if self.K[self.i] in self.ASSIGN:
            self.i += 1
            self.assignment()

    def conditional(self) -> None:
        self.binary()
        if self.take("?"):
            if not self.at(":"):
                self.expression()
            self.need(":")
            self.conditional()

    def binary(self, least: int = 0) -> None:
        self.unary()
        K = self.K
        while True:
            k = K[self.i]
            step = 1
            if k == ">" and K[self.i + 1] == ">" and self.S[self.i + 1] == self.S[self.i] + 1:
                k, step = ">>", 2
            p = self.BINARY.get(k, -1)
            if p < least:
                return
            self.i += step
            self.binary(p + 1)

    def unary(self) -> None:
        K = self.K
        while K[self.i] in ("+", "-", "!", "~", "*", "&", "++", "--", "&&"):
            self.i += 1
        if K[self.i] == "sizeof" or K[self.i] == "_Alignof":
            self.i += 1
            if self.at("(") and self.attempt(self.parenthesised_type):
                if self.at("{"):
                    self.initializer()
                return
            self.unary()
            return
        if K[self.i] == "(" and self.cast():
            return
        self.postfix()

    def parenthesised_type(self) -> None:
        self.need("(")
        self.type_name()
        self.need(")")

    def cast(self) -> bool:
        at = self.i
        known = self.K[at + 1] in BASE_TYPES or self.K[at + 1] in QUALIFIERS or self.K[at + 1] in ("struct", "union", "enum")
        if self.K[at + 1] != "id" and not known:
            return False
        if not self.attempt(self.parenthesised_type):
            return False
        if self.at("{"):
            self.initializer()
            self.postfix_tail()
            return True
        if known or self.at("id", "num", "str", "(", "!", "~", "sizeof") or (self.at("&", "*", "-") and self.K[self.i - 2] == "*"):
            self.unary()
            return True
        self.i = at
        return False

    def postfix(self) -> None:
        self.primary()
        self.postfix_tail()

    def postfix_tail(self) -> None:
        while True:
            k = self.K[self.i]
            if k == "(":
                self.arguments()
            elif k == "[":
                self.i += 1
                self.expression()
                self.need("]")
            elif k in (".", "->"):
                self.i += 1
                self.need("id")
            elif k in ("++", "--"):
                self.i += 1
            else:
                return

    def arguments(self) -> None:
        self.need("(")

        def one() -> None:
            if self.at(*BASE_TYPES, "struct", "const", "unsigned"):
                self.type_name()
            else:
                self.assignment()

        self.separated(one, ")", False)

    def primary(self) -> None:
        k = self.K[self.i]
        if k in ("id", "num"):
            self.i += 1
            if k == "id" and self.at("str"):
                self.strings()
        elif k == "str":
            self.strings()
        elif k == "(":
            self.i += 1
            if self.at("{"):
                self.block()
            else:
                self.expression()
            self.need(")")
        elif k == "bad":
            raise self.fail()
        else:
            raise self.fail()

    def strings(self) -> None:
        while self.at("str") or (self.at("id") and self.K[self.i - 1] == "str"):
            self.i += 1


def check(text: str, extension: str) -> list[tuple[int, str]]:
    return C(text).run()
