"""File tree, repository overview, catalog."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolith.functions.text import basename
from symbolith.operators import hierarchy
from symbolith.sources.tables import latest, ship

#: Files with more symbols than this are resolved by contraction instead of in one task.
TOGETHER = 50_000


def file_tree(current: DataFrame, symbols: DataFrame, prefix: str = "") -> DataFrame:
    """(repo, path, parent, name, type, depth, language, symbol_count) of files and folders below a path prefix."""
    counts = symbols.groupBy("repo", F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("symbol_count"))
    rows = current.select("repo", "path", "language")
    prefix = prefix.strip("/")
    if prefix:
        rows = rows.where((F.col("path") == prefix) | F.startswith("path", F.lit(prefix + "/")))
    leaves = rows.join(counts, ["repo", "path"], "left").select("repo", "path", F.lit("file").alias("type"), "language", F.coalesce("symbol_count", F.lit(0)).cast("long").alias("symbol_count"))
    parts = F.split("path", "/")
    above = rows.where(F.contains("path", F.lit("/"))).select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    if prefix:
        above = above.where((F.col("path") == prefix) | F.startswith("path", F.lit(prefix + "/")))
    folders = above.select("repo", "path", F.lit("dir").alias("type"), F.lit(None).cast("string").alias("language"), F.lit(0).cast("long").alias("symbol_count"))
    nodes = leaves.unionByName(folders)
    has_parent = F.contains("path", F.lit("/"))
    return nodes.select(
        "repo", "path", F.when(has_parent, F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).alias("parent"), basename(F.col("path")).alias("name"), "type",
        (F.size(F.split("path", "/")) - 1).cast("long").alias("depth"), "language", "symbol_count",
    )


def tree_order(tree: DataFrame) -> DataFrame:
    """Adds ``sort_key``, by which the rows of a repo are in the order of a walk: in every folder its folders first, then its files, each by name."""
    parts = F.split("path", "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.concat(F.lit("0"), x))
    last = F.concat(F.when(F.col("type") == "dir", "0").otherwise("1"), "name")
    return tree.withColumn("sort_key", F.array_join(F.concat(folders, F.array(last)), "\u0001"))


PLACES = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("root", T.StringType()), T.StructField("depth", T.LongType()), T.StructField("preorder", T.LongType())]))


def places_of(rows: list[tuple]) -> list[dict]:
    """Root, depth and place in preorder of (seq, id, parent) rows; what is caught in a loop has none."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    known = {i for _, i, _ in rows}
    below: dict = {}
    for _, i, parent in rows:
        below.setdefault(parent if parent in known else None, []).append(i)
    out, waiting = [], [(i, i, 0) for i in reversed(below.get(None, []))]
    while waiting:
        i, root, depth = waiting.pop()
        out.append({"id": i, "root": root, "depth": depth, "preorder": len(out)})
        waiting += [(x, root, depth + 1) for x in reversed(below.get(i, []))]
    return out


@F.pandas_udf(PLACES)
def file_places(seqs: pd.Series, ids: pd.Series, parents: pd.Series) -> pd.Series:
    return pd.Series([places_of(list(zip(s, i, p))) for s, i, p in zip(seqs, ids, parents)], dtype=object)


def file_forest(symbols: DataFrame) -> DataFrame:
    """(repo, file, id, root, depth, preorder) of symbols (repo, file, id, parent, symbol_seq), parents in the same file only.

    A file is resolved in one pass; files with more than TOGETHER symbols by contraction, without ``preorder``. Symbols
    caught in loops are left out, as are rows without file or id.
    """
    ship(symbols.sparkSession)
    rows = symbols.where("file IS NOT NULL AND id IS NOT NULL").select("repo", "file", "id", "parent", "symbol_seq")
    sizes = rows.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > TOGETHER).select("repo", "file")
    # a flag
    some = not large.isEmpty()
    few = rows.join(large, ["repo", "file"], "left_anti") if some else rows
    held = few.groupBy("repo", "file").agg(F.collect_list(F.struct("symbol_seq", "id", "parent")).alias("r"))
    placed = held.select("repo", "file", F.explode(file_places.asNondeterministic()("r.symbol_seq", "r.id", "r.parent")).alias("p")).select("repo", "file", "p.*")
    if some:
        contracted = hierarchy.hierarchy(rows.join(large, ["repo", "file"], "left_semi"), ["repo", "file"], "id", "parent")
        rest = contracted.where("depth IS NOT NULL").select("repo", "file", "id", "root", "depth", F.lit(None).cast("long").alias("preorder"))
        placed = placed.unionByName(rest)
    return placed


def top_folders(current: DataFrame, top: int = 20) -> DataFrame:
    """The folders at the root of each repo with the most files."""
    folder = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(".")
    counts = current.groupBy("repo", folder.alias("dir")).agg(F.count(F.lit(1)).alias("file_count"))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("file_count"), "dir"))
    return counts.withColumn("_n", rank).where(F.col("_n") <= top).drop("_n")


def catalog(repos: DataFrame, current: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each repo with its highest version and its numbers of files and symbols."""
    rows = latest(repos.where("repo IS NOT NULL").select("repo", "version"), ["repo"], ["version"])
    held = current.groupBy("repo").agg(F.count(F.lit(1)).alias("file_count"))
    named = symbols.groupBy("repo").agg(F.count(F.lit(1)).alias("symbol_count"))
    joined = rows.join(held, "repo", "left").join(named, "repo", "left")
    return joined.select("repo", "version", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"))


def short_names(repos: DataFrame) -> DataFrame:
    """(short_name, repo, candidates): what a name without owner stands for; ``repo`` is null where several have it."""
    named = repos.where("repo IS NOT NULL").select("repo", F.split_part("repo", F.lit("/"), F.lit(-1)).alias("short_name")).distinct()
    return named.groupBy("short_name").agg(F.count(F.lit(1)).alias("candidates"), F.min("repo").alias("_r")).select("short_name", F.when(F.col("candidates") == 1, F.col("_r")).alias("repo"), "candidates")
