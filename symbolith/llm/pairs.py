"""Functions paired with their documentation (problem 1).

A packrat grammar per language finds documentation that ends right above a function (in Python: the first string of
its body); its semantic action emits the pair with source offsets, and only then the description is judged. Texts are
parsed where they are read; nothing but the pairs is shuffled.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolith.llm import syntax
from symbolith.llm.grammars import pairs
from symbolith.llm.syntax.core import line_at, line_of
from symbolith.llm.validity import extension_of, language_of
from symbolith.sources.tables import table

PAIRS = T.ArrayType(
    T.StructType(
        [
            T.StructField("line", T.IntegerType()),
            *[T.StructField(c, T.StringType()) for c in ("name", "kind", "signature", "docstring", "description")],
            T.StructField("informative", T.BooleanType()),
        ]
    )
)

_STRING = re.compile(r"(?:^|\s)[rRuU]?(\"\"\"|'''|\"|')((?:[^\\]|\\[\s\S])*?)\1")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_RULE = re.compile(r"[-=*#~_+/\\.<>|\s]*")
_HEADING = re.compile(r"^\s*([-=*#~_+])\1{2,}.*?([-=*#~_+])\2{2,}\s*$")
#: Comments that speak to tools, not readers.
_DIRECTIVE = re.compile(
    r"^\s*(?:(?:eslint|tslint|jslint|jshint|prettier|stylelint|biome|rustfmt|clippy|istanbul|webpack|clang-format|checkstyle|cspell|sonar|resharper|v8 ignore|c8)[-\s:]\S.*"
    r"|@ts-\S+.*|(?:type|pylint|flake8|mypy|pyright|ruff|isort|yapf|fmt|black|pragma|nosec|noinspection|nolint|lint|go)\s*:\s*\S.*|noqa\b.*|nosec\b.*|nolint\b.*|noinspection\b.*|NOSONAR\b.*|CHECKSTYLE\b.*|fallthrough"
    r"|#?\s*(?:end)?region\b.*|\+build\b.*|global\s+\w+|use strict|<editor-fold.*|</editor-fold.*)\s*$",
    re.I,
)
_LEGAL = re.compile(r"copyright|\(c\)\s*\d{4}|©|SPDX-License|licen[sc]ed? under|all rights reserved|licen[sc]e found in|see (?:the )?LICEN[SC]E", re.I)
_TODO = re.compile(r"^\s*(?:TODO|FIXME|XXX|HACK|BUG|TBD|WIP|OPTIMIZE|NB)\b.*$", re.I)
_PLACEHOLDER = re.compile(
    r"^\W*(?:(?:a |the |add |insert |write |missing |no |your )*(?:description|documentation|docs?|docstring|summary|comment)s?(?: goes| here| to come| needed| missing| tbd| pending| for \S+)*|see (?:above|below|there|also|[\w.#()]+)|(?:same )?as above|ditto|wip|tbd|tba|n/?a|none|null|nothing|undocumented"
    r"|self[- ]explanatory|placeholder|lorem ipsum.*|to be (?:done|written|documented|determined)|(?:\{@)?inherit[- ]?doc\}?|deprecated|internal|private|public|override|overrides?|generated|auto-?generated|stub|temp|test|foo|bar|blah)\W*$",
    re.I,
)
_SECTION = re.compile(r"^\s*(?:args?|arguments?|params?|parameters?|returns?|raises?|throws?|yields?|examples?|notes?|see also|todo)\s*:?\s*$", re.I)
_FIELD = re.compile(r"^\s*(?:[@\\:](?:param|arg|argument|parameter|type|rtype|returns?|raises?|throws|exception|see|since|author|version|deprecated|override|private|public|internal|ignore|async|static|api|memberof|example|template|tparam)\b:?)(.*)$", re.I)
_CODE = re.compile(
    r"^\s*(?:[\w.$\[\]]+(?:\s+[\w$]+)?\s*[-+*/%|&^]?=(?!=)\s*.*(?:[;{(]|\w\(.*\))|(?:return|break|continue|throw|if|for|while|else|switch|case|var|let|const|import|from|def|del)\b.*[;{})]|[\w.$]+\(.*\)\s*[;{]|[{}()\[\];]+)\s*$"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
#: Words that say nothing of their own.
_EMPTY_WORDS = frozenset(
    "a an the this that these those it its is are be been was were of to in on for by with from and or as at into do does did function functions func method methods fn def procedure routine helper here goes see todo fixme xxx arg args argument param parameter return returns returned value values given used use uses".split()
)


def plain_documentation(doc: str, language: str) -> str:
    """The words of a comment or documentation string without the marks around them."""
    if language == "python":
        return "".join(m.group(2) for m in _STRING.finditer(doc))
    lines = []
    for line in doc.splitlines():
        line = re.sub(r"^\s*(?://[/!]?|/\*[*!]*|\*(?!/))", "", line)
        lines.append(re.sub(r"\*+/\s*$", "", line))
    return "\n".join(lines)


def stem(word: str) -> str:
    word = word.lower()
    for ending in ("ies", "ing", "ed", "es", "s", "e", "y"):
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            return word[: -len(ending)]
    return word


def informative(text: str, name: str) -> bool:
    """Whether a documentation's words say more than the function's name, apart from tool comments and placeholders."""
    if _LEGAL.search(text):
        return False
    known = {stem(w) for w in _CAMEL.findall(name)} | {stem(name)}
    left = 0
    text = re.sub(r"\{@(?:link|code|literal)\s+([^}]*)\}|\{@\w+[^}]*\}", r" \1 ", _TAG.sub(" ", text))
    for line in text.splitlines():
        if _RULE.fullmatch(line) or _HEADING.match(line) or _DIRECTIVE.match(line) or _TODO.match(line) or _PLACEHOLDER.match(line) or _CODE.match(line) or _SECTION.match(line):
            continue
        field = _FIELD.match(line)
        if field:
            line = re.sub(r"^\s*(?:\{[^}]*\}\s*)?\[?\w+\]?\s*[-:]?", "", field.group(1))
        else:
            line = re.sub(r"^\s*\w+\s*(?:\([^)]*\))?\s*:\s*$", "", line)
        words = [w for w in _WORD.findall(line) if len(w) > 1]
        left += len([w for w in words if w.lower() not in _EMPTY_WORDS and not {stem(x) for x in _CAMEL.findall(w)} <= known])
        left += len(_WIDE.findall(line)) // 3
    return left >= 2


def kind_of(language: str, head: str, name: str) -> str:
    if language in ("java", "csharp"):
        return "method"
    if language == "go":
        return "method" if re.match(r"func\s*\(", head) else "function"
    if language in ("javascript", "typescript"):
        return "function" if re.match(r"(?:export\s+|default\s+|declare\s+|async\s+)*(?:function|const)\b", head) else "method"
    return "function"


def documented(text: str, extension: str) -> list[dict]:
    """Every function of ``text`` with documentation; none for a text that does not parse, or is nested too deep to be read."""
    language = syntax.LANGUAGES.get(extension)
    if language is None:
        return []
    syntax.allow_nesting()
    try:
        found = pairs(text, language)
    except RecursionError:
        return []
    starts, out = line_of(text), []
    for doc, head, name in found:
        raw = text[doc[0] : doc[1]]
        plain = plain_documentation(raw, language)
        label = text[name[0] : name[1]]
        signature = re.sub(r"\s+", " ", text[head[0] : head[1]]).strip()
        signature = re.sub(r"\s*(?:=>|[:{;])$", "", signature)
        out.append(
            {
                "line": line_at(starts, name[0]),
                "name": label,
                "kind": kind_of(language, text[head[0] : head[1]], label),
                "signature": signature,
                "docstring": raw,
                "description": "\n".join(x.strip() for x in plain.strip().splitlines()),
                "informative": informative(plain, label),
            }
        )
    if out and syntax.check(text, extension):
        return []
    return out


@F.pandas_udf(PAIRS)
def documented_functions(texts: pd.Series, extensions: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None else documented(t, e or "") for t, e in zip(texts, extensions)], dtype=object)


def code_description_pairs(source_files: DataFrame) -> DataFrame:
    """(file_id, repo, language, line, name, kind, signature, docstring, description) of the documented functions.

    Left out are missing and trivial documentation, files that do not parse, null texts, other extensions and rows
    without file_id. Rows of a file fetched twice differ in ``fetched_at`` only and give one result.
    """
    read = source_files.select("file_id", "repo", "fetched_at", "rel_path", "content").where("file_id IS NOT NULL")
    found = read.select(
        "file_id", "repo", "fetched_at", "rel_path", language_of(F.col("rel_path")).alias("language"), documented_functions.asNondeterministic()("content", extension_of(F.col("rel_path"))).alias("pairs")
    )
    last = found.groupBy("file_id").agg(F.max_by(F.struct("repo", "language", "pairs"), F.struct("fetched_at", "rel_path")).alias("f"))
    rows = last.select("file_id", "f.repo", "f.language", F.explode("f.pairs").alias("p")).where("p.informative")
    return rows.select("file_id", "repo", "language", *[F.col(f"p.{c}").alias(c) for c in ("line", "name", "kind", "signature", "docstring", "description")])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return code_description_pairs(table(spark, folder, "source_files")).select("file_id", "line").distinct()


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return code_description_pairs(table(spark, folder, "source_files"))
