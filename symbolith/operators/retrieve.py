"""Symbols with their source: point, batch, context, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolith.functions.text import byte_slice, byte_text


def with_source(symbols: DataFrame, current: DataFrame) -> DataFrame:
    """Adds the bytes of each symbol's range in the current text of its file, and whether they still hash alike."""
    texts = current.select("repo", F.col("path").alias("file"), "content")
    joined = symbols.join(texts, ["repo", "file"])
    bytes_ = byte_slice(F.col("content"), F.col("byte_offset"), F.col("byte_length"))
    return joined.withColumn("source", byte_text(F.col("content"), F.col("byte_offset"), F.col("byte_length"))).withColumn("source_hash", F.sha2(bytes_, 256)).withColumn(
        "content_verified", F.when((F.col("content_hash") != "") & (F.length(bytes_) > 0), F.col("source_hash") == F.lower("content_hash"))
    )


def with_context(symbols: DataFrame, current: DataFrame, context_lines: int) -> DataFrame:
    """Adds up to ``context_lines`` (0 to 50) lines before and after each symbol.

    A symbol whose lines lie outside its file, or whose file has no text, has empty context there.
    """
    k = max(0, min(context_lines, 50))
    texts = current.select("repo", F.col("path").alias("file"), F.split("content", "\n").alias("_lines"))
    joined = symbols.join(texts, ["repo", "file"], "left")
    count = F.coalesce(F.size("_lines"), F.lit(0))
    first = F.least(F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)), count + 1)
    last = F.greatest(F.least(F.coalesce("end_line", "line", F.lit(1)), count), first - 1)
    start = F.greatest(F.lit(1), first - k)
    before = F.slice(F.coalesce("_lines", F.array().cast("array<string>")), start, first - start)
    after = F.slice(F.coalesce("_lines", F.array().cast("array<string>")), last + 1, k)
    return joined.withColumn("context_before", F.array_join(before, "\n")).withColumn("context_after", F.array_join(after, "\n")).drop("_lines")


def read_bytes(symbols: DataFrame, current: DataFrame) -> DataFrame:
    """(repo, files, raw_bytes, symbol_bytes): the files that symbols lie in, each once, their bytes, and those of the symbols."""
    held = symbols.groupBy("repo", "file").agg(F.sum("byte_length").alias("_b"))
    sizes = current.select("repo", F.col("path").alias("file"), "size_bytes")
    return held.join(sizes, ["repo", "file"]).groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("raw_bytes"), F.sum("_b").alias("symbol_bytes"))


def lookup(symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (repo, pos, symbol_id) left joined to the symbols: duplicates kept, misses with a null id."""
    return requests.join(symbols, (requests["repo"] == symbols["repo"]) & (requests["symbol_id"] == symbols["id"]), "left").select(requests["repo"], "pos", "symbol_id", *[symbols[c] for c in symbols.columns if c != "repo"])
