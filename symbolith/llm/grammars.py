"""Island grammars of the corpus' languages: documentation followed by a function, everything else passed over.

``doc``, ``head`` and ``name`` are captured; the action of ``Pair`` makes them one pair.
"""

from __future__ import annotations

from symbolith.llm.peg import Captures, Grammar

#: Shared by the languages with braces. ``Head``, ``Mark`` (annotations), ``Odd`` (literals of the language) differ.
#: ``Bare`` lines have no character that begins a comment, a literal or a directive.
BRACES = r"""
Unit     <- (Bare / Pair / Line)*
Bare     <- `(?:[^"'/\x60\#\n]*\n)+`
Pair     <- BOL doc:Doc Gap Mark* head:Head
BOL      <- `(?m:^)[ \t]*`
Gap      <- `[ \t]*\r?\n[ \t]*`
Doc      <- LineDoc (Gap LineDoc)* / Block
LineDoc  <- `//[^\r\n]*`
Block    <- `/\*(?:[^*]|\*(?!/))*\*/`
Line     <- BOL? (Odd / String / Block / LineDoc / Plain)* `\r?\n` / (Odd / String / Block / LineDoc / Plain)+ / `[\s\S]`
String   <- `"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*'`
Space    <- (`\s+` / Block / LineDoc)*
Round    <- "(" (Odd / String / Block / LineDoc / Round / `[^()"'/$@\x60\#\n]++(?!/)|[^()"'/]` / `/`)* ")"
Square   <- "[" (Odd / String / Block / LineDoc / Square / `[^\[\]"'/$@\x60\#\n]++(?!/)|[^\[\]"'/]` / `/`)* "]"
Angle    <- "<" (String / Angle / Round / `=>|->` / `[^<>"'();{}]`)* ">"
"""

JAVASCRIPT = (
    BRACES
    + r"""
Mark     <- "@" `[\w$.]+` Round? `\s*`
Odd      <- Template / `[\w$)\]]\s*/(?![/*])` / Pattern
Pattern  <- `/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*`
Template <- `\x60` (`(?:[^\x60\\$]|\\[\s\S]|\$(?!\{))+` / "${" Hole "}")* `\x60`
Hole     <- (Odd / String / Block / LineDoc / "{" Hole "}" / `[^{}"'/\x60]` / `/`)*
Plain    <- `[^"'\x60/\r\n]+|/|\r(?!\n)`
Head     <- Export (Function / Constant) / Method
Export   <- (`export\b\s*(?:default\b\s*)?` / `declare\b\s*`)*
Function <- `(?:async\b\s*)?function\b\s*\*?\s*` name:Name Space Angle? Space Round
Constant <- `const\b\s*` name:Name Space Typed? `=\s*` (`(?:async\b\s*)?function\b` / `(?:async\b\s*)?` Angle? Space (Round Space Typed? / Name Space) "=>")
Typed    <- ":" Space Curly? (Round / Square / Angle / `[|&]\s*` Curly / String / `=>(?=[^\n]*=>)` / `[^=()\[\]<>{}"'/;]`)+
Curly    <- "{" (String / Curly / Block / LineDoc / `[^{}"'/]` / `/`)* "}"
Method   <- Modifier* !Reserved name:`\#?[^\W\d][\w$]*|\[[^\]\n]*\]|"[^"\n]*"|'[^'\n]*'` Space `\??` Angle? Round Space Typed? (&"{" / &`;` &Signed)
Modifier <- `(?:public|private|protected|static|readonly|override|abstract|async|get|set|accessor)\b(?!\s*[(=;:<?])\s*` / `\*\s*`
Signed   <- `;`
Reserved <- `(?:if|for|while|switch|catch|with|function|return|new|typeof|await|do|else|throw|super|this|import|void|delete|yield)\b`
Name     <- `[^\W\d][\w$]*|\$[\w$]*`
"""
)

JAVA = (
    BRACES
    + r"""
Mark     <- "@" !`interface\b` `[\w.]+` Space Round? `\s*`
Odd      <- `\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"`
Plain    <- `[^"'/\r\n]+|/|\r(?!\n)`
Head     <- Modifier* (Angle Space)? Type name:Name Space Round Space Dims Throws (&`[{;]` / &`default\b`) / Modifier* name:Name Space Round Space Throws &"{"
Modifier <- `(?:public|protected|private|static|final|abstract|native|synchronized|strictfp|default|transient)\b\s*` / Mark
Type     <- !Reserved `[^\W\d][\w$.]*` Space Angle? (`\s*\.\s*[\w$]+` Angle?)* `(?:\s*\[\s*\])*` `\s+`? !`\(`
Dims     <- `(?:\[\s*\]\s*)*`
Throws   <- (`throws\b[^{;]*`)?
Reserved <- `(?:return|new|throw|else|assert|yield|case|if|for|while|switch|catch|do|try|synchronized|import|package|class|interface|enum|record)\b`
Name     <- !Reserved `[^\W\d][\w$]*`
"""
)

CSHARP = (
    BRACES
    + r"""
Mark     <- Square `\s*`
Odd      <- `\$*\"\"\"+[\s\S]*?\"\"\"+` / `(?:@\$|\$@)"(?:[^"]|"")*"` / `@"(?:[^"]|"")*"` / `\$"(?:[^"\\\n{]|\\.|\{\{|\{(?:[^{}"\n]|"(?:[^"\\\n]|\\.)*")*\})*"`
Plain    <- `[^"'/\r\n@$]+|[/@$]|\r(?!\n)`
Head     <- Modifier* Type name:Name Space Angle? Space Round Space Where (&`\{` / &`=>` / &`;`) / Modifier* name:Name Space Round Space (`:\s*(?:base|this)\b\s*` Round Space)? (&`\{` / &`=>`)
Modifier <- `(?:public|protected|private|internal|static|sealed|abstract|virtual|override|async|extern|new|unsafe|partial|readonly)\b(?!\s*[(\[])\s*` / Mark
Type     <- !Reserved (Round / `[^\W\d][\w.:]*`) Angle? `(?:\s*(?:\?|\*|\[[\s,]*\]))*\s+`
Where    <- (`where\b[^{;=]*(?:=(?!>)[^{;=]*)*`)?
Reserved <- `(?:return|new|throw|else|yield|case|if|for|foreach|while|switch|catch|do|try|using|lock|await|namespace|class|interface|struct|enum|record|delegate|goto|in|is|as)\b`
Name     <- !Reserved `[^\W\d]\w*` (Angle? `\.` `[^\W\d]\w*`)*
"""
)

GO = (
    BRACES
    + r"""
Mark     <- `(?!)`
Odd      <- `\x60[^\x60]*\x60`
Plain    <- `[^"'/\r\n\x60]+|/|\r(?!\n)`
Head     <- `func\b\s*` (Round `\s*`)? name:`[^\W\d]\w*` Space Square? Round (`[ \t]*` Round / `[^{\n]*`)
"""
)

RUST = (
    BRACES.replace("`[^()\"'/$@\\x60\\#\\n]++(?!/)|[^()\"'/]`", "`[^()\"/]`").replace("`[^\\[\\]\"'/$@\\x60\\#\\n]++(?!/)|[^\\[\\]\"'/]`", "`[^\\[\\]\"/]`").replace("`[^<>\"'();{}]`", "`[^<>\"();{}]`").replace(r"`/\*(?:[^*]|\*(?!/))*\*/`", r'"/*" (`(?:[^*/]|\*(?!/)|/(?!\*))+` / Block)* "*/"').replace(
        r"""|'(?:[^'\\\n]|\\[\s\S])*'`""", r"""|'(?:[^'\\\n]|\\(?:u\{\w+\}|x\w\w|.))'`"""
    )
    + r"""
Mark     <- `\#!?` Square `\s*`
Odd      <- `r(\#+)"[\s\S]*?"\1` / `r"[^"]*"`
Plain    <- `[^"'/\r\nr]+|'|/|r|\r(?!\n)`
Head     <- (Mark / `pub\b(?:\s*\([^)]*\))?\s*` / `(?:default|const|async|unsafe|safe)\b\s*` / `extern\b\s*(?:"[^"]*"\s*)?`)* `fn\b\s*` name:`(?:r\#)?[^\W\d]\w*` Space Angle? Space Round Space (`->` (Angle / Round / Square / `->` / `[^{;<(\[]`)*)? (`where\b[^{;]*`)?
"""
)

C = (
    BRACES
    + r"""
Mark     <- `__attribute__\s*|__declspec\s*` Round `\s*` / `\[\[[^\]\n]*\]\]\s*`
Odd      <- `(?m:^)[ \t]*\#(?:[^\n\\]|\\[\s\S])*`
Plain    <- `[^"'/\r\n]+|/|\r(?!\n)`
Head     <- (Mark / `(?:static|inline|extern|const|volatile|register|_Noreturn|__inline|__inline__)\b\s*`)* Type name:Name Space Round Space Mark* &"{"
Type     <- !Reserved `(?:(?:struct|union|enum)\s+)?[^\W\d]\w*` (`\s+` !(Name Space "(") !Reserved `[^\W\d]\w*`)* `(?:\s*\*(?:\s*(?:const|restrict)\b)?)*\s*`
Reserved <- `(?:return|else|case|if|for|while|switch|do|goto|sizeof|typedef)\b`
Name     <- !Reserved `[^\W\d]\w*`
"""
)

PYTHON = r"""
Unit     <- (Bare / Pair / Head / Token)*
Bare     <- `(?:(?![^"'\#\n]*\bdef\b)[^"'\#\n]*\n)+`
Pair     <- head:(Head) Start doc:Doc &End
Head     <- `\b(?:async\b[ \t]*)?def\b[ \t]*` name:`[^\W\d]\w*` Blank (Square Blank)? Round Blank (`->` (Round / Square / Curly / String / `[^:()\[\]{}"'\n]`)+)? ":"
Start    <- `[ \t]*` (`(?:\#[^\n]*)?\r?\n[ \t\f]*`)*
Doc      <- Words (Blank Words)*
Words    <- `[rRuU]?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?''')` / `[rRuU]?(?:"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')`
End      <- `[ \t]*(?:\#[^\n]*)?(?:\r?\n|;|$)`
Blank    <- `(?:[ \t]|\\\r?\n)*`
Round    <- "(" Inside* ")"
Square   <- "[" Inside* "]"
Curly    <- "{" Inside* "}"
Inside   <- String / Round / Square / Curly / Comment / `[^()\[\]{}"'\#]+`
String   <- `[A-Za-z]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')`
Comment  <- `\#[^\n]*`
Token    <- `(?:(?!\b(?:async|def)\b)[^"'\#])+` / String / Comment / `[^\W\d]\w*` / `[\s\S]`
"""


def pair(text: str, start: int, end: int, captures: Captures) -> Captures:
    """One documentation-function pair: offsets of the documentation, the head and the name."""
    found = {name: (a, b) for name, a, b in reversed(captures)}
    return (("pair", found["doc"], found["head"], found["name"]),)


def grammar(text: str) -> Grammar:
    return Grammar(text, {"Pair": pair})


BY_LANGUAGE = {
    "javascript": grammar(JAVASCRIPT),
    "typescript": grammar(JAVASCRIPT),
    "java": grammar(JAVA),
    "csharp": grammar(CSHARP),
    "go": grammar(GO),
    "rust": grammar(RUST),
    "c": grammar(C),
    "python": grammar(PYTHON),
}


def pairs(text: str, language: str) -> list[tuple[tuple[int, int], tuple[int, int], tuple[int, int]]]:
    """(documentation, head, name) offsets of every documented function, in order."""
    found = BY_LANGUAGE[language].parse(text)
    return [c[1:] for c in (found[1] if found else ()) if c[0] == "pair"]
