"""Source files that do not parse (problem 4).

Every text is parsed once, by the recursive-descent parser of the language its path names; files fetched twice share
one text. All errors, the first cause and the verdict per language are kept, rates follow by aggregation.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolith.llm import syntax
from symbolith.llm.syntax.core import line_at, line_of
from symbolith.sources.tables import table

ERRORS = T.ArrayType(
    T.StructType([T.StructField("line", T.IntegerType()), T.StructField("offset", T.IntegerType()), T.StructField("message", T.StringType())])
)


def extension_of(path: Column) -> Column:
    """The extension of the last part of a path in either notation, in lower case without the dot; empty if none."""
    return F.lower(F.regexp_extract(F.trim(path), r"[^/\\.][^/\\]*\.([^./\\]+)$", 1))


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in syntax.LANGUAGES.items() for x in pair])
    return F.try_element_at(known, extension_of(path))


@F.pandas_udf(ERRORS)
def syntax_errors(texts: pd.Series, extensions: pd.Series) -> pd.Series:
    """All syntax errors of each text; null for a null text or an unknown extension."""
    out = []
    for text, extension in zip(texts, extensions):
        found = None if text is None else syntax.check(text, extension or "")
        if found:
            starts = line_of(text)
            found = [{"line": line_at(starts, at), "offset": at, "message": message} for at, message in found]
        out.append(found)
    return pd.Series(out, dtype=object)


def parsed(source_files: DataFrame) -> DataFrame:
    """(file_id, repo, language, errors, first_error, valid) per file.

    Files fetched twice differ in ``fetched_at`` only, so each row is parsed where it is read and only the verdicts
    meet by file_id. ``errors`` is null where nothing was parsed (null text, other extension): such files count as
    neither valid nor invalid. An empty file is valid. Extra columns are ignored.
    """
    read = source_files.select("file_id", "repo", "fetched_at", "rel_path", extension_of(F.col("rel_path")).alias("extension"), "content").where(
        "file_id IS NOT NULL"
    )
    judged = read.select("file_id", "repo", "fetched_at", "rel_path", language_of(F.col("rel_path")).alias("language"), syntax_errors("content", "extension").alias("errors"))
    last = judged.groupBy("file_id").agg(F.max_by(F.struct("repo", "language", "errors"), F.struct("fetched_at", "rel_path")).alias("f"))
    return last.select(
        "file_id", "f.repo", "f.language", "f.errors", F.try_element_at("f.errors", F.lit(1))["message"].alias("first_error"), (F.size("f.errors") == 0).alias("valid")
    )


def rates(verdicts: DataFrame) -> DataFrame:
    """Files, invalid files and their rate per repo and language, with totals per language (null repo) and overall."""
    judged = verdicts.where("valid IS NOT NULL")
    return judged.rollup("language", "repo").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.round(F.count_if(~F.col("valid")) / F.count(F.lit(1)), 6).alias("rate"),
        F.grouping_id().alias("level"),
    )


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(table(spark, folder, "source_files")).where("NOT valid").select("file_id")


def p4_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Every error of every invalid file."""
    found = parsed(table(spark, folder, "source_files")).where("NOT valid")
    return found.select("file_id", "repo", "language", "first_error", F.posexplode("errors").alias("n", "e")).select(
        "file_id", "repo", "language", "first_error", "n", "e.line", "e.offset", "e.message"
    )


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return rates(parsed(table(spark, folder, "source_files")))

