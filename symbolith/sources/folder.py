"""Source trees as file rows: local or shared folders, and repository trees as a hosting interface lists them."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolith.functions import security
from symbolith.functions.text import basename, language
from symbolith.sources.tables import ship

#: What a hosting interface says of a tree's entries.
TREE = "path string, sha string, size long, url string, type string"


#: Bytes in one line of a delivered body.
BODY_LINE = 60
BODY = "path string, encoding string, content string"


@F.pandas_udf(T.StructType([T.StructField("link", T.BooleanType()), T.StructField("escapes", T.BooleanType())]))
def link_of(paths: pd.Series, root: pd.Series) -> pd.DataFrame:
    """Whether a local path goes through a symbolic link below its root, and whether it ends outside of it."""
    homes: dict[str, str] = {}
    rows = []
    for path, base in zip(paths, root):
        if base not in homes:
            homes[base] = os.path.realpath(base)
        real = os.path.realpath(path)
        straight = os.path.join(homes[base], os.path.relpath(path, base))
        rows.append((real != straight, real != homes[base] and not real.startswith(homes[base].rstrip("/") + "/")))
    return pd.DataFrame(rows, columns=["link", "escapes"])


def folder_files(spark: SparkSession, root: str, repo: str, follow_symlinks: bool = False) -> DataFrame:
    """(repo, path, content, size_bytes, is_symlink) of all files below ``root``; invalid UTF-8 becomes U+FFFD.

    ``is_symlink`` tells what discovery leaves out: every path through a link, or, if links are followed, those that end
    outside the root. Only local file systems have links.
    """
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    local = root.startswith(("/", "file:"))
    folder = re.sub(r"^[a-z]+:/*(?=/)", "", root.rstrip("/"))
    whole = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z]+:/*(?=/)", "")
    named = found.withColumn("whole", whole).withColumn("path", F.substring(F.col("whole"), F.lit(len(folder) + 2), F.lit(100_000)))
    link = link_of("whole", F.lit(folder))["escapes" if follow_symlinks else "link"] if local else F.lit(False)
    raw = F.col("content")
    return named.select(
        F.lit(repo).alias("repo"), "path", F.when(~security.binary_content(raw), F.make_valid_utf8(raw.cast("string"))).alias("content"), F.col("length").alias("size_bytes"), link.alias("is_symlink"),
    )


def ignore_patterns(spark: SparkSession, root: str) -> list[str]:
    """The lines of the root's ignore file; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/.gitignore")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    # Spark's readers pass hidden files over
    stream = fs.open(path)
    try:
        return str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).splitlines()
    finally:
        stream.close()


def discover(files: DataFrame, patterns: list[str] | None = None, max_files: int | None = None, max_bytes: int = security.MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The files to index with language and place, and the counts of those passed over, by reason.

    With ``max_files`` only so many are kept, those of the priority folders first.
    """
    judged = files.withColumn("reason", security.skip_reason(F.col("path"), F.col("is_symlink"), F.col("size_bytes"), F.col("content"), patterns or [], max_bytes))
    kept = judged.where("reason IS NULL").drop("reason").withColumn("language", language(F.col("path"))).withColumn("priority", security.priority(F.col("path")))
    if max_files is not None:
        kept = kept.orderBy(F.desc("priority"), "path").limit(max_files)
    counts = judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("files"))
    return kept, counts


def limits(spark: SparkSession) -> tuple[int, int]:
    """(most files of a repo, most bytes of a file) from the session's ``spark.symbolith.max.files`` and ``.max.file.bytes``."""
    found = []
    for key, default in (("spark.symbolith.max.files", security.MAX_FILES), ("spark.symbolith.max.file.bytes", security.MAX_FILE_BYTES)):
        value = spark.conf.get(key, str(default))
        if not value.isdigit() or int(value) < 1:
            raise ValueError(f"{key} must be a positive number, not {value!r}")
        found.append(int(value))
    return found[0], found[1]


def tree_entries(pages: DataFrame) -> DataFrame:
    """(repo, path, sha, size, url, type) of the pages (repo, value) that a hosting interface lists trees in, as JSON.

    A page that is no JSON, or has no tree, gives no rows.
    """
    read = F.from_json("value", f"truncated boolean, tree array<struct<{TREE}>>")
    return pages.select("repo", F.explode(read["tree"]).alias("e")).select("repo", "e.*")


def listed_tree(entries: DataFrame, max_bytes: int = security.MAX_FILE_BYTES, max_files: int | None = None) -> DataFrame:
    """The source files among a repository tree's entries (TREE), by path, name, language and size.

    ``priority`` tells the files of the folders that come first; with ``max_files`` only so many are kept of each repo
    (of all entries, where they have no repo).
    """
    path = F.col("path")
    parts = F.exists(F.split(path, "/"), lambda p: p.isin("node_modules", "vendor", ".git", "dist", "build", "__pycache__", ".cache", "target", "coverage", ".nyc_output", ".next", ".nuxt"))
    skip = parts | security.any_glob(basename(path), security.SKIPPED_FILES)
    kept = entries.where((F.col("type") == "blob") & ~skip & ~security.secret_file(path) & ~security.binary_extension(path) & (F.col("size") <= max_bytes)).withColumn("language", language(path)).where("language IS NOT NULL")
    kept = kept.withColumn("priority", security.priority(path))
    if max_files is None:
        return kept
    if "repo" not in entries.columns:
        return kept.orderBy(F.desc("priority"), "path").limit(max_files)
    # ranked within shares of a repo first, so that none meets in one task whole
    order = [F.desc("priority"), "path"]
    share = kept.withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(64)))
    ahead = share.withColumn("_n", F.row_number().over(Window.partitionBy("repo", "_part").orderBy(*order))).where(F.col("_n") <= max_files)
    return ahead.withColumn("_n", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).where(F.col("_n") <= max_files).drop("_n", "_part")


def body_address(repo: Column, path: Column) -> Column:
    """Where a hosting interface keeps a file's body: every part of the path encoded by itself."""
    parts = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(F.url_encode(x), r"\+", "%20"))
    return F.concat(F.lit("repos/"), repo, F.lit("/contents/"), F.array_join(parts, "/"))


def fetched(bodies: DataFrame) -> DataFrame:
    """(path, content, fetch_status) of fetched bodies (path, encoded): base64 with line breaks; empty and failed ones are told apart."""
    raw = F.try_to_binary(F.regexp_replace("encoded", r"\s", ""), F.lit("base64"))
    more = [c for c in bodies.columns if c not in ("path", "encoded")]
    return bodies.select(*more, "path", F.make_valid_utf8(raw.cast("string")).alias("content"), F.when(raw.isNull(), "failed").when(F.length(raw) == 0, "empty").otherwise("ok").alias("fetch_status"))


def fetched_bodies(responses: DataFrame) -> DataFrame:
    """(repo, path, content, fetch_status) of responses (repo, path, value), each the JSON of one body."""
    body = F.from_json("value", BODY)
    return fetched(responses.select("repo", "path", F.when(body["encoding"] == "base64", body["content"]).alias("encoded")))


def fetched_files(responses: DataFrame) -> DataFrame:
    """The files of all bodies that came whole; failed and empty ones are left out."""
    return fetched_bodies(responses).where("fetch_status = 'ok'").drop("fetch_status")


def watch_excludes(spark: SparkSession, path: str | None = None) -> list[str]:
    """Folders that are not watched: those of every walk and the lines of the user's list, comments and blanks left out."""
    names = list(security.SKIPPED_ENTRIES)
    if path is not None:
        # a list that a user wrote
        names += [r["value"] for r in excluded_lines(spark.read.text(path)).collect()]
    return sorted(set(names))


def excluded_lines(lines: DataFrame) -> DataFrame:
    """(value) the names in the lines of an exclude list, each once."""
    return lines.select(F.trim(F.regexp_replace("value", r"\s*#.*$", "")).alias("value")).where("value <> ''").distinct()
