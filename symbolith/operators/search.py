"""Ranked symbol search and line search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolith.functions.text import glob_to_regex
from symbolith.operators.index import lines

#: Points of a match by where it is found.
POINTS = {"exact": 20, "prefix": 15, "name": 10, "qualified": 8, "signature": 6, "summary": 5, "keyword": 3, "docstring": 1}


def score(query: str) -> Column:
    """Points of the best place in which the query is found, without regard to case; an empty query is a prefix of all."""
    q = F.lit(query.lower())
    holds = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), q)
    name = F.lower(F.coalesce("name", F.lit("")))
    return (
        F.when(name == q, POINTS["exact"])
        .when(F.startswith(name, q), POINTS["prefix"])
        .when(F.contains(name, q), POINTS["name"])
        .when(holds("qualified_name"), POINTS["qualified"])
        .when(holds("signature"), POINTS["signature"])
        .when(holds("summary"), POINTS["summary"])
        .when(F.coalesce(F.exists("keywords", lambda k: F.contains(F.lower(k), q)), F.lit(False)), POINTS["keyword"])
        .when(holds("docstring"), POINTS["docstring"])
        .otherwise(0)
    )


def search_symbols(symbols: DataFrame, query: str, kind: str | None = None, language: str | None = None, file_pattern: str | None = None, limit: int = 50) -> DataFrame:
    """The best ``limit`` (1 to 100) symbols by score, then name."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    found = symbols
    if kind:
        found = found.where(F.col("kind") == kind)
    if language:
        found = found.where(F.col("language") == language)
    if file_pattern:
        found = found.where(F.col("file").rlike(glob_to_regex(file_pattern, False)))
    ranked = found.withColumn("score", score(query)).where("score > 0")
    return ranked.orderBy(F.desc("score"), "name", "repo", "id").limit(limit)


def matching_lines(current: DataFrame, query: str, file_pattern: str | None = None) -> DataFrame:
    """Every line that holds the query without regard to case; patterns prune files before their lines are made."""
    if file_pattern:
        current = current.where(F.col("path").rlike(glob_to_regex(file_pattern, False)))
    current = current.where(F.contains(F.lower("content"), F.lit(query.lower())))
    return lines(current).where(F.contains(F.lower("text"), F.lit(query.lower())))


def search_text(current: DataFrame, query: str, file_pattern: str | None = None, limit: int = 100) -> DataFrame:
    """The first ``limit`` (1 to 200) matching lines in the order of files and lines."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    found = matching_lines(current, query, file_pattern).orderBy("file_seq", "path", "line").limit(limit)
    return found.select("repo", "path", "line", F.substring("text", 1, 200).alias("text"), "file_seq")


def opened_files(current: DataFrame, file_pattern: str | None = None, last=None) -> DataFrame:
    """The files that a search in order looks into: all that the pattern leaves, or those up to the file of its ``last`` match."""
    if file_pattern:
        current = current.where(F.col("path").rlike(glob_to_regex(file_pattern, False)))
    if last is None:
        return current
    return current.where((F.col("file_seq") < last["file_seq"]) | ((F.col("file_seq") == last["file_seq"]) & (F.col("path") <= last["path"])))


def grouped_matches(found: DataFrame) -> DataFrame:
    """One row per file with its matches in order."""
    return found.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("matches"))
