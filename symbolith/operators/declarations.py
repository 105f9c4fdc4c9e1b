"""The declarations of a text in the languages with braces: one pass over tokens with their brackets matched.

The pass keeps the open brackets with the place where the current statement began in each. A declaration is known by a
keyword and a name, or by a name before parentheses in a place where members stand; its head is what lies between the
begin of the statement and its body. Nothing is looked at twice, however deep the brackets nest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

NAME = r"[^\W\d][\w$]*"
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?:[^*]|\*(?!/))*+(?:\*/)?"
_DOUBLE, _SINGLE = r"\"(?:[^\"\\\n]|\\[\s\S])*+\"?", r"'(?:[^'\\\n]|\\[\s\S])*+'?"
_TRIPLE = r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+(?:\"\"\")?"
_BACKTICK = r"`(?:[^`\\]|\\[\s\S])*+`?"
_PATTERN = r"(?<=[(,=:\[!&|?{};+\-*%~^<>])\s*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*"


#: Lines that mark a merge conflict; what lies between them is read on.
_CONFLICT = r"(?m:^)(?:<{7}|={7}|>{7}|\|{7})(?!\S)[^\n]*"


def _tokens(comments: str, strings: str) -> re.Pattern:
    return re.compile(rf"(?P<conflict>{_CONFLICT})|(?P<comment>{comments})|(?P<string>{strings})|(?P<word>{NAME}|\${NAME})|(?P<num>\d[\w.]*)|(?P<sign>=>|->|::|\S)")


#: What tokens look like, by language.
TOKENS = {
    "javascript": _tokens(f"{_LINE}|{_BLOCK}", f"{_DOUBLE}|{_SINGLE}|{_BACKTICK}|{_PATTERN}"),
    "go": _tokens(f"{_LINE}|{_BLOCK}", rf"{_DOUBLE}|{_SINGLE}|`[^`]*+`?"),
    "rust": _tokens(f"{_LINE}|{_BLOCK}", rf"r(?P<hashes>\#+)\"[\s\S]*?(?:\"(?P=hashes)|\Z)|r\"[^\"]*+\"?|\"(?:[^\"\\]|\\[\s\S])*+\"?|'(?:[^'\\\n]|\\(?:u\{{\w+\}}|x\w\w|.))'"),
    "java": _tokens(f"{_LINE}|{_BLOCK}", f"{_TRIPLE}|{_DOUBLE}|{_SINGLE}"),
    "csharp": _tokens(f"{_LINE}|{_BLOCK}|(?m:^)[ \\t]*\\#[^\\n]*", rf"\$*\"\"\"+[\s\S]*?(?:\"\"\"+|\Z)|(?:@\$|\$@|@)\"(?:[^\"]|\"\")*+\"?|\$?{_DOUBLE}|{_SINGLE}"),
    "c": _tokens(rf"{_LINE}|{_BLOCK}|(?m:^)[ \t]*\#(?:[^\n\\]|\\[\s\S])*+", f"{_DOUBLE}|{_SINGLE}"),
    "php": _tokens(rf"{_LINE}|{_BLOCK}|\#(?!\[)[^\n]*", rf"\"(?:[^\"\\]|\\[\s\S])*+\"?|'(?:[^'\\]|\\[\s\S])*+'?"),
    "dart": _tokens(f"{_LINE}|{_BLOCK}", rf"r?{_TRIPLE}|r?'''[\s\S]*?(?:'''|\Z)|{_DOUBLE}|{_SINGLE}"),
    "swift": _tokens(f"{_LINE}|{_BLOCK}", f"{_TRIPLE}|{_DOUBLE}"),
}
for _like, _same in (("typescript", "javascript"), ("tsx", "javascript"), ("cpp", "c")):
    TOKENS[_like] = TOKENS[_same]

#: What declares a type or function by its keyword, by language: keyword to kind.
KEYWORDS: dict[str, dict[str, str]] = {
    "javascript": {"class": "class", "function": "function"},
    "typescript": {"class": "class", "function": "function", "interface": "interface", "enum": "class", "type": "type"},
    "go": {"func": "function", "type": "type"},
    "rust": {"fn": "function", "struct": "type", "enum": "type", "type": "type", "trait": "interface", "impl": "class"},
    "java": {"class": "class", "enum": "class", "interface": "interface"},
    "php": {"class": "class", "trait": "class", "interface": "interface", "function": "function"},
    "dart": {"class": "class", "mixin": "class", "enum": "type"},
    "swift": {"class": "class", "struct": "class", "enum": "class", "extension": "class", "actor": "class", "protocol": "interface", "func": "function", "init": "function"},
    "csharp": {"class": "class", "enum": "class", "record": "class", "interface": "interface", "struct": "type", "delegate": "type"},
    "c": {"struct": "type", "enum": "type", "typedef": "type"},
    "cpp": {"class": "class", "namespace": "class", "struct": "type", "typedef": "type"},
}
KEYWORDS["tsx"] = KEYWORDS["typescript"]
#: Keywords whose symbols hold the names of what they declare.
CONTAINERS: dict[str, tuple[str, ...]] = {
    "javascript": ("class",), "typescript": ("class", "interface", "enum"), "tsx": ("class", "interface", "enum"), "go": (), "rust": ("impl", "trait"), "java": ("class", "interface", "enum"),
    "php": ("class", "interface", "trait"), "dart": ("class", "mixin"), "swift": ("class", "struct", "enum", "extension", "actor", "protocol"), "csharp": ("class", "interface", "struct", "record"),
    "c": ("struct",), "cpp": ("class", "struct", "namespace"),
}
#: Words before parentheses that name no function.
NOT_NAMES = frozenset(
    "if for while switch catch with return function else do try new await typeof foreach lock using fixed sizeof throw yield in of instanceof delete case when match guard super this base assert synchronized nameof default defer go select not and or elseif "
    "import require unset isset empty array list echo print static_assert decltype alignas alignof __attribute__ __declspec".split()
)
MODIFIERS = frozenset("public private protected internal static final abstract sealed partial virtual override async readonly unsafe extern new get set declare accessor native synchronized strictfp default transient external factory const inline".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


@dataclass
class Declaration:
    name: str
    kind: str
    start: int
    end: int
    #: Where the body or the rest behind the head begins.
    head_end: int
    container: bool
    decorators: list[str] = field(default_factory=list)
    #: The innermost container around it, by its place in the list of declarations.
    inside: int | None = None
    #: The comments of the statement, by the place of the last token before.
    before: int = -1


class Source:
    """Tokens of a text, comments apart, with the partners of their brackets and the number of errors met."""

    def __init__(self, text: str, language: str):
        self.text = text
        self.words: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.comments: list[tuple[int, int, int]] = []
        self.errors = 0
        for m in TOKENS[language].finditer(text):
            group = m.lastgroup if m.lastgroup != "hashes" else "string"
            if group == "conflict":
                self.errors += 1
                continue
            if group == "comment":
                if not m.group().lstrip().startswith("#") or language == "php":
                    self.comments.append((len(self.words), m.start(), m.end()))
                self.errors += m.group().startswith("/*") and not m.group().endswith("*/")
                continue
            word = m.group()
            if group == "string":
                self.errors += len(word) < 2 or word[-1] not in "\"'`/" and not word[-1].isalnum()
                word = '"'
            elif group == "num":
                word = "0"
            self.words.append(word)
            self.starts.append(m.start())
            self.ends.append(m.end())
        self.partner: dict[int, int] = {}
        open_: list[int] = []
        for i, word in enumerate(self.words):
            if word in OPEN:
                open_.append(i)
            elif word in CLOSE:
                if open_ and self.words[open_[-1]] == CLOSE[word]:
                    self.partner[open_.pop()] = i
                    continue
                self.errors += 1
                if word == "}" and any(self.words[j] == "{" for j in open_[-4:]):
                    while self.words[open_[-1]] != "{":
                        open_.pop()
                    self.partner[open_.pop()] = i
        self.errors += len(open_)
        self.bodies: dict[str, dict[int, int]] = {}
        self.words += [""] * 3
        self.starts += [len(text)] * 3
        self.ends += [len(text)] * 3

    def end(self, i: int) -> int:
        """End of the bracket group that begins at ``i``, or of the text if it never ends."""
        return self.ends[self.partner[i]] if i in self.partner else len(self.text)

    def behind(self, i: int) -> int:
        """The token behind the bracket group at ``i``."""
        return self.partner[i] + 1 if i in self.partner else len(self.words) - 3


def _name_before(s: Source, i: int, begin: int) -> int:
    """The token of the name before the parenthesis ``i``, type parameters passed over; -1 if there is none."""
    j = i - 1
    if j >= begin and s.words[j] == ">":
        depth = 0
        while j >= begin and i - j < 100:
            depth += (s.words[j] == ">") - (s.words[j] == "<")
            j -= 1
            if depth == 0:
                break
    return j if j >= begin and (s.words[j][0].isalpha() or s.words[j][0] in "_$") else -1


def _body(s: Source, i: int, stops: str = ";") -> int:
    """The first brace from ``i`` on, other brackets passed over; -1 if the statement ends before.

    Remembered for every token passed, so that no text is looked at twice.
    """
    known, passed = s.bodies.setdefault(stops, {}), []
    while i not in known:
        passed.append(i)
        word = s.words[i]
        if word == "{":
            known[i] = i
        elif not word or word in stops or word == "}":
            known[i] = -1
        else:
            i = s.behind(i) if word in "([" else i + 1
    for at in passed:
        known[at] = known[i]
    return known[i]


def _statement_end(s: Source, i: int) -> int:
    """End of a statement without a body of its own; remembered as in :func:`_body`."""
    known, passed = s.bodies.setdefault("end", {}), []
    while i not in known:
        passed.append(i)
        if not s.words[i] or s.words[i] in (";", "}"):
            known[i] = s.ends[i] if s.words[i] == ";" else s.ends[i - 1]
        else:
            i = s.behind(i) if s.words[i] in OPEN else i + 1
    for at in passed:
        known[at] = known[i]
    return known[i]


def _decorated(s: Source, begin: int, language: str) -> tuple[int, list[str]]:
    """(first token behind the decorators, annotations or attributes, their texts)."""
    found = []
    i = begin
    while True:
        at = i
        if s.words[i] == "@" and s.words[i + 1] and s.words[i + 1] != "interface":
            i += 2
            while s.words[i] == ".":
                i += 2
            if s.words[i] == "(":
                i = s.behind(i)
        elif language == "rust" and s.words[i] == "#" and s.words[i + 1] == "[" or language == "php" and s.words[i] == "#":
            i = s.behind(i + 1)
        elif language == "csharp" and s.words[i] == "[":
            i = s.behind(i)
        else:
            return at, found
        found.append(s.text[s.starts[at] : s.ends[i - 1]])


def _callable(s: Source, language: str, head: list[str], name: str, after: int, where: tuple) -> tuple[str, int] | None:
    """(kind, token of the body, or of the end of the head) of a function known by its parentheses; None if it is none."""
    place, owner = where
    words = s.words
    if language in ("javascript", "typescript", "tsx"):
        if any(w not in MODIFIERS and w not in "*#" for w in head):
            return None
        if words[after] == ":":
            after += 1
            if words[after] == "{":
                after = s.behind(after)
            while words[after] and words[after] not in "{;})=":
                after = s.behind(after) if words[after] in "([" else after + 1
                if words[after] == "{" and words[after - 1] in ("|", "&", "=>", "<", ","):
                    after = s.behind(after)
        return ("method", after) if words[after] == "{" else None
    if language in ("java", "csharp", "dart"):
        # methods at the top are those of a text whose beginning was lost
        if place not in ("type", "top") or (place == "top" and language != "dart" and "(" in head) or "=" in head or "." in head[-1:] or "=>" in head:
            return None
        rest = [w for w in head if w not in MODIFIERS]
        if any(w in NOT_NAMES or w in ("class", "operator") for w in rest):
            return None
        while words[after] and words[after] not in "{;}=" and words[after] != "=>":
            if words[after] in ("throws", "where", ":", "async", "sync", "default") or words[after - 1] != ")" or words[after] in "[":
                after = s.behind(after) if words[after] in "([" else after + 1
            else:
                return None
        if words[after] not in ("{", ";", "=>", "=") or (words[after] == "=" and language != "dart"):
            return None
        if not rest:
            if name != owner or (language != "dart" and words[after] == ";"):
                return None
            return ("function", after) if language != "dart" else None
        return ("function" if language == "dart" else "method"), after
    if language in ("c", "cpp"):
        if place not in (("top",) if language == "c" else ("top", "type")) or "=" in head or any(w in NOT_NAMES or w == "typedef" for w in head):
            return None
        if not head and not (language == "cpp" and name == owner) and s.words[after] != "{":
            return None
        body = _body(s, after, ";,=") if language == "c" else _body(s, after, ";=")
        if language == "cpp" and body > 0 and words[after] == ":":
            while words[body - 1] not in (")", "}") and body > 0:
                body = _body(s, s.behind(body))
        return ("function", body) if body > 0 else None
    return None


def declarations(text: str, language: str) -> tuple[list[Declaration], Source]:
    """The declarations in the order of their starts, and the tokens they were read from."""
    s = Source(text, language)
    words, starts, ends = s.words, s.starts, s.ends
    script = language in ("javascript", "typescript", "tsx")
    keywords, containers = KEYWORDS[language], CONTAINERS[language]
    out: list[Declaration] = []
    #: Braces that open a type or a function known already: what they are and the declaration they belong to.
    bodies: dict[int, tuple[str, str, int | None]] = {}
    # (place, name of the type, innermost container, begin of the statement, its bracket, begin of the last statement with an equals sign)
    stack: list[list] = [["top", "", None, 0, -1, -1]]
    opener = {b: a for a, b in s.partner.items()}
    i = 0

    def add(name: str, kind: str, head_end: int, end: int, container: bool, begin: int) -> int:
        decorators = _decorated(s, begin, language)[1]
        out.append(Declaration(name, kind, starts[begin], max(end, head_end), head_end, container, decorators, stack[-1][2], begin))
        return len(out) - 1

    def opened(brace: int, place: str, name: str, at: int | None) -> None:
        bodies[brace] = (place, name, at)

    def by_keyword(word: str, begin: int) -> bool:
        """Whether a declaration is known by the keyword at ``i``."""
        kind, j = keywords[word], i + 1
        before = words[i - 1] if i else ""
        if before in (".", "->", "::") or (script and word == "function" and before in ("(", ",", "=", ":", "?", "=>", "&", "|", "return", "[", "!", "new")):
            return False
        if script and word in ("type", "interface", "enum") and i > begin and before not in ("export", "declare", "default", "const"):
            return False
        if language == "go":
            if word == "type":
                grouped = words[j] == "("
                stop = s.partner.get(j, j) if grouped else j + 1
                j = j + 1 if grouped else j
                while j < stop and words[j]:
                    first = begin if not grouped else j
                    name, k = words[j], j + 1
                    if words[k] == "[" and words[s.behind(k)] in ("struct", "interface"):
                        k = s.behind(k)
                    body = k + 1 if words[k] in ("struct", "interface") and words[k + 1] == "{" else -1
                    line_end = text.find("\n", starts[k])
                    end = s.end(body) if body > 0 else (line_end if line_end >= 0 else len(text))
                    if words[k] != "=" and name[:1].isidentifier():
                        add(name, {"struct": "class", "interface": "interface"}.get(words[k], "type"), starts[body] if body > 0 else end, end, False, first)
                    j = s.behind(body) if body > 0 else k + 1
                    while grouped and j < stop and starts[j] < end:
                        j += 1
                return True
            if before and before not in (";", "}", ")") and "\n" not in text[ends[i - 1] : starts[i]]:
                return False
            if words[j] == "(":
                kind, j = "method", s.behind(j)
            if not words[j][:1].isidentifier() or words[j + 1] not in ("(", "["):
                return False
            name, k = words[j], j + 1
            while words[k] in ("(", "["):
                k = s.behind(k)
            while words[k] and words[k] not in ("{", ";") and "\n" not in text[ends[k - 1] : starts[k]]:
                k = s.behind(k) if words[k] in ("(", "[") or (words[k] == "{" and words[k - 1] in ("struct", "interface")) else k + 1
                if words[k] == "{" and words[k - 1] in ("struct", "interface"):
                    k = s.behind(k)
            body = k if words[k] == "{" else -1
            add(name, kind, starts[body] if body > 0 else ends[k - 1], s.end(body) if body > 0 else ends[k - 1], False, begin)
            if body > 0:
                opened(body, "block", "", None)
            return True
        if language == "rust" and word == "impl":
            if before in ("->", ":", "(", ",", "<", "=", "&"):
                return False
            body = _body(s, j)
            if body < 0:
                return False
            depth = 0
            if words[j] == "<":
                while j < body:
                    depth += (words[j] == "<") - (words[j] == ">")
                    j += 1
                    if depth == 0:
                        break
            stops = [k for k in range(j, body) if words[k] == "where"] or [body]
            typed = [k for k in range(j, stops[0]) if words[k] == "for"]
            j = typed[-1] + 1 if typed else j
            name = re.sub(r"\s+", " ", text[starts[j] : ends[stops[0] - 1]]) if j < stops[0] else "impl"
        elif word == "typedef":
            end = i
            while words[end] and words[end] != ";":
                end = s.behind(end) if words[end] in OPEN else end + 1
            inner = [k for k in range(max(i, end - 8), end) if words[k][:1].isidentifier()]
            pointer = re.search(r"\(\s*\*\s*(\w+)\s*\)", text[starts[i] : ends[end]])
            name = pointer.group(1) if pointer and "{" not in text[starts[i] : ends[end]] else words[inner[-1]] if inner else ""
            if name:
                add(name, kind, ends[end], ends[end], False, begin)
            return False
        elif word == "delegate":
            paren = i
            while words[paren] and words[paren] not in ("(", ";", "{"):
                paren += 1
            j = _name_before(s, paren, i + 1)
            if words[paren] != "(" or j < 0:
                return False
            end = _statement_end(s, paren)
            add(words[j], kind, end, end, False, begin)
            return True
        elif word == "init":
            j += words[j] in ("?", "!")
            if words[j] not in ("(", "<") or before == ".":
                return False
            name = "init"
        else:
            if word == "record" and words[j] in ("class", "struct"):
                j += 1
            if word == "enum" and words[j] in ("class", "struct"):
                j += 1
            if script and word == "function" and words[j] == "*":
                j += 1
            if language == "php" and word == "function" and words[j] == "&":
                j += 1
            name = words[j]
            if name in keywords or not name[:1].isidentifier() and not name.startswith("$"):
                return False
            if language == "cpp" and word == "namespace":
                while words[j + 1] == "::":
                    name, j = name + "::" + words[j + 2], j + 2
        after = j + 1
        if word in ("function", "fn", "func", "init"):
            if word == "function" and words[after] not in ("(", "<"):
                return False
            if word == "function" and language == "php" and stack[-1][0] == "type":
                kind = "method"
            protocol = language == "swift" and stack[-1][0] == "protocol"
            body = _signature_body(s, after, script, language, protocol)
            if body < 0:
                if protocol and word == "func":
                    stop = text.find("\n", ends[j])
                    add(name, "method", stop if stop >= 0 else len(text), stop if stop >= 0 else len(text), False, begin)
                    return True
                if language == "php" and stack[-1][0] == "type":
                    end = _statement_end(s, after)
                    add(name, kind, end, end, False, begin)
                    return True
                return False
            add(name, kind, starts[body], s.end(body), False, begin)
            opened(body, "block", "", None)
            return True
        if word == "type" and script:
            if words[after] == "<":
                depth = 0
                while words[after]:
                    depth += (words[after] == "<") - (words[after] == ">")
                    after += 1
                    if depth == 0:
                        break
            if words[after] != "=":
                return False
            end = _alias_end(s, after + 1)
            add(name, kind, end, end, False, begin)
            return True
        if word == "type" and language == "rust":
            end = _statement_end(s, after)
            if stack[-1][0] != "type":
                add(name, kind, end, end, False, begin)
                return True
            return False
        if language == "c" and word in ("struct", "enum") and words[after] != "{":
            return False
        body = _body(s, after, ";=" if language not in ("rust", "swift", "csharp", "dart") else ";")
        if language in ("c", "cpp") and word in ("struct", "enum") and body != after and not (language == "cpp" and body > 0 and words[after] in (":", "final")):
            return False
        if body < 0:
            if word in ("class", "interface", "protocol", "trait", "namespace") or (word in ("struct", "record") and language not in ("rust", "csharp")) or (language == "rust" and word in ("enum", "impl", "trait")):
                return False
            end = _statement_end(s, after)
            if text[end - 1 : end] != ";":
                return False
            add(name, kind, end, end, False, begin)
            return True
        if script and word == "class" and before not in ("", ";", "}", "{", "export", "default", "abstract", "declare", ")") and "\n" not in text[ends[i - 1] : starts[i]] and i != begin:
            opened(body, "type", name, stack[-1][2])
            return False
        holds = word in containers
        end = s.end(body)
        if language in ("c", "cpp") and word != "namespace" and words[s.behind(body)] == ";":
            end = ends[s.behind(body)]
        at = add(name, kind, starts[body], end, holds, begin)
        place = "protocol" if word == "protocol" else "top" if word == "namespace" else "enum" if word == "enum" and language in ("c", "cpp", "dart", "csharp") else "type"
        opened(body, place, name, at if holds else stack[-1][2])
        return True

    while words[i]:
        word = words[i]
        top = stack[-1]
        if word in keywords:
            known = by_keyword(word, top[3])
            if known and (word in ("type", "delegate", "typedef") and not script):
                top[5] = top[3]
                i += 1
                continue
        if word in ("=", "=>"):
            top[5] = top[3]
        if word == "(" and top[5] != top[3] and i - top[3] < 400:
            begin = top[3]
            j = _name_before(s, i, begin)
            if j >= 0 and words[j] not in NOT_NAMES and i in s.partner and (j == begin or words[j - 1] not in (".", "new", "->", "@", "?")):
                first, _ = _decorated(s, begin, language)
                if first <= j:
                    qualified = language == "cpp" and words[j - 1] in ("::", "~")
                    low = j
                    while qualified and low > first and words[low - 1] in ("::", "~"):
                        low -= 2 if words[low - 1] == "::" else 1
                    found = _callable(s, language, words[first : max(first, low)], words[j], s.behind(i), (top[0], top[1]))
                    if found:
                        top[5] = begin
                        kind, body = found
                        name = "".join(words[max(first, low) : j + 1])
                        if words[body] == "{":
                            add(name, kind, starts[body], s.end(body), False, begin)
                            opened(body, "block", "", None)
                        else:
                            end = _statement_end(s, body)
                            add(name, kind, starts[body] if words[body] == "=>" else end, end, False, begin)
        elif script and word in ("const", "let", "var") and words[i + 1][:1].isidentifier():
            _variable(s, i, top[3], add, opened)
        if word in OPEN and i not in s.partner:
            stack[-1][3] = i + 1
        elif word in OPEN:
            if word == "{" and i in bodies:
                place, name, at = bodies[i]
                stack.append([place, name, top[2] if place == "block" else at, i + 1, i, -1])
            elif word == "{":
                anonymous = language == "java" and (
                    (words[i - 1] == ")" and "new" in words[max(top[3], i - 400) : i]) or (top[0] == "type" and words[i - 1] != "static" and (words[i - 1] == ")" or words[i - 1][:1].isidentifier()))
                )
                top_like = language in ("c", "cpp") and i and words[i - 1] == '"'
                module = language == "csharp" and "namespace" in words[top[3] : min(i, top[3] + 12)]
                stack.append(["type" if anonymous else "top" if top_like or module else "block", "", top[2], i + 1, i, -1])
            else:
                stack.append(["paren", "", top[2], i + 1, i, -1])
        elif word in CLOSE:
            while i in opener and len(stack) > 1 and stack[-1][4] >= opener[i]:
                stack.pop()
            if word == "}":
                stack[-1][3] = i + 1
        elif word == ";" or (word == "," and (top[0] in ("paren", "enum") or script)) or (word == ":" and top[0] == "block" and words[i - 1] in ("default", "0", '"')):
            stack[-1][3] = i + 1
        elif "\n" in text[ends[i] : starts[i + 1]] and language in ("go", "swift", "javascript", "typescript", "tsx") and _ends_line(s, i):
            stack[-1][3] = i + 1
        i += 1
    order = sorted(range(len(out)), key=lambda k: (out[k].start, -out[k].end))
    moved = {k: n for n, k in enumerate(order)}
    for d in out:
        d.inside = moved[d.inside] if d.inside is not None else None
    return [out[k] for k in order], s


def _ends_line(s: Source, i: int) -> bool:
    """Whether a statement may end with the token ``i`` at the end of a line, judged by it and the next."""
    word, after = s.words[i], s.words[i + 1]
    if s.words[i + 1] in (".", "?", ":", "=", "=>", "+", "-", "*", "/", "&", "|", "{", ")", "]", ",", "<", ">", "%", "^"):
        return False
    decorator = s.words[i - 1] == "@" or word == ")"
    return (word[0].isalnum() or word[0] in "_$\"0)]}") and word not in MODIFIERS and word not in ("export", "return", "extends", "implements", "function", "class", "in", "of") and not (decorator and after and _decorates(s, i))


def _decorates(s: Source, i: int) -> bool:
    """Whether the token ``i`` ends a decorator, looked for in its own line."""
    line = s.text.rfind("\n", 0, s.starts[i]) + 1
    return s.text[line : s.ends[i]].lstrip().startswith("@")


def _signature_body(s: Source, i: int, script: bool, language: str, protocol: bool) -> int:
    """The brace of a function's body from its type or value parameters on; -1 if there is none."""
    words = s.words
    while words[i] and words[i] != "(":
        if words[i] in (";", "{", "}", "fn", "func", "function"):
            return -1
        i += 1
    i = s.behind(i)
    if script and words[i] == ":":
        i += 1
        if words[i] == "{":
            i = s.behind(i)
    while words[i]:
        if words[i] == "{":
            if script and words[i - 1] in ("|", "&", "=>", "<", ",", "is"):
                i = s.behind(i)
                continue
            return i
        if words[i] in (";", "}") or (protocol and words[i] in ("func", "var", "init", "static", "mutating", "associatedtype")):
            return -1
        if script and words[i] in (")", ",", "="):
            return -1
        i = s.behind(i) if words[i] in ("(", "[") else i + 1
    return -1


def _alias_end(s: Source, i: int) -> int:
    """End of a type alias: a semicolon, or the end of a line behind which the type can't go on."""
    words = s.words
    while words[i] and words[i] != ";":
        i = s.behind(i) if words[i] in OPEN else i + 1
        if "\n" in s.text[s.ends[i - 1] : s.starts[i]] and words[i] not in ("|", "&", "=", "?", ":", ">", "=>", ".", "extends") and words[i - 1] not in ("|", "&", "=", "?", ":", "<", "=>", ","):
            return s.ends[i - 1]
    return s.ends[i] if words[i] == ";" else s.ends[i - 1]


def _variable(s: Source, i: int, begin: int, add, opened) -> None:
    """A function given to the variable declared at ``i``."""
    words = s.words
    name, j = words[i + 1], i + 2
    if words[j] == "!":
        j += 1
    if words[j] == ":":
        while words[j] and words[j] not in (";", "}") and not (words[j] == "="):
            j = s.behind(j) if words[j] in OPEN else j + 1
    if words[j] != "=":
        return
    j += 1
    if words[j] == "async":
        j += 1
    if words[j] == "function":
        body = _signature_body(s, j + 1, True, "javascript", False)
        if body > 0:
            add(name, "function", s.starts[body], s.end(body), False, begin)
            opened(body, "block", "", None)
        return
    if words[j] == "<":
        depth = 0
        while words[j]:
            depth += (words[j] == "<") - (words[j] == ">")
            j += 1
            if depth == 0:
                break
    if words[j] == "(":
        j = s.behind(j)
        if words[j] == ":":
            j += 1
            if words[j] == "{":
                j = s.behind(j)
            while words[j] and words[j] not in ("=>", ";", "}", ")", "="):
                j = s.behind(j) if words[j] in OPEN else j + 1
    elif words[j][:1].isidentifier():
        j += 1
    if words[j] != "=>":
        return
    body = j + 1
    if words[body] == "{":
        after = s.behind(body)
        add(name, "function", s.starts[body], s.ends[after] if words[after] == ";" else s.end(body), False, begin)
        opened(body, "block", "", None)
        return
    end = body
    while words[end] and words[end] not in (";", ",", "}", ")"):
        end = s.behind(end) if words[end] in OPEN else end + 1
        if "\n" in s.text[s.ends[end - 1] : s.starts[end]] and _ends_line(s, end - 1):
            break
    add(name, "function", s.starts[body], s.ends[end - 1], False, begin)
