"""The index on disk: Parquet tables written aside, made current by one marker.

A commit writes ``data/<table>/commit=<id>/repo=<repo>`` and ``heads/commit=<id>`` and at last the empty marker
``log/<id>``; what has no marker doesn't exist. Ids grow with time, and of several commits of a repo the last counts. A
job that dies between its writes leaves the index as it was.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolith.sources.tables import latest

VERSION = 2
FILES = "path string, language string, content_hash string, size_bytes long, content string, file_seq long, repo string"
SYMBOLS = "file string, id string, name string, qualified_name string, kind string, signature string, language string, line int, end_line int, byte_offset long, byte_length long, docstring string, summary string, parent string, decorators array<string>, keywords array<string>, content_hash string, symbol_seq long, repo string"
SCHEMAS = {"files": FILES, "symbols": SYMBOLS, "repos": "repo string, version int, indexed_at timestamp, git_head string", "savings": "ts timestamp, tool string, repo string, tokens_saved long"}
HEADS = "repo string, version int, indexed_at timestamp, git_head string, gone boolean"


def checked_repo(repo: str) -> str:
    """``owner/name``; everything else is refused."""
    if not re.fullmatch(r"[\w.-]+/[\w.-]+", repo) or ".." in repo:
        raise ValueError(f"not a repository: {repo!r}")
    return repo


def column_names(table: str) -> list[str]:
    return [x.strip().split()[0] for x in SCHEMAS[table].split(", ")]


class Store:
    """The tables below a folder of any file system Spark can write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[str]:
        """The ids of what was committed, in order; one file each."""
        path, fs = self._path(f"{self.folder}/log")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _mark(self, commit: str) -> None:
        path, fs = self._path(f"{self.folder}/log/{commit}")
        if not fs.createNewFile(path):
            raise OSError(f"{commit} was committed before")

    def heads(self) -> DataFrame:
        """(repo, version, indexed_at, git_head, commit) of the repos that are indexed."""
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], HEADS + ", commit string").drop("gone")
        rows = self.spark.read.schema(HEADS).parquet(*[f"{self.folder}/heads/commit={c}" for c in commits])
        rows = rows.withColumn("commit", F.regexp_extract(F.col("_metadata.file_path"), r"/commit=([^/]+)/", 1))
        return latest(rows, ["repo"], ["commit"]).where("NOT gone").drop("gone")

    def read(self, table: str, repo: str | None = None) -> DataFrame:
        """A table's current rows, of one repo if given; empty where nothing was written."""
        heads = self.heads()
        if repo:
            heads = heads.where(F.col("repo") == repo)
        if table == "repos":
            return heads.drop("commit")
        where = f"{self.folder}/data/{table}"
        path, fs = self._path(where)
        if not fs.exists(path) or not any(s.isDirectory() for s in fs.listStatus(path)):
            return self.spark.createDataFrame([], SCHEMAS[table])
        rows = self.spark.read.schema(SCHEMAS[table] + ", commit string").option("basePath", where).parquet(where)
        if table == "savings":
            return rows.where(F.col("repo") == repo).drop("commit") if repo else rows.drop("commit")
        if repo:
            # one row; literals prune to the folder of the repo's last commit
            head = heads.select("commit").first()
            rows = rows.where((F.col("repo") == repo) & (F.col("commit") == (head["commit"] if head else "")))
            return rows.drop("commit")
        return rows.join(heads.select("repo", "commit"), ["repo", "commit"], "left_semi").drop("commit")

    def commit(self, heads: DataFrame, tables: dict[str, DataFrame]) -> str:
        """All rows of the repos in ``heads`` (repo, and git_head if known) anew, of any number of repos at once.

        A repo without rows in a table has none from now on.
        """
        commit = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        for table, rows in tables.items():
            names = column_names(table)
            rows.select(*names).write.partitionBy("repo").parquet(f"{self.folder}/data/{table}/commit={commit}")
        head = F.col("git_head") if "git_head" in heads.columns else F.lit(None).cast("string")
        gone = F.col("gone") if "gone" in heads.columns else F.lit(False)
        rows = heads.select("repo", F.lit(VERSION).alias("version"), F.current_timestamp().alias("indexed_at"), head.alias("git_head"), gone.alias("gone"))
        rows.write.parquet(f"{self.folder}/heads/commit={commit}")
        self._mark(commit)
        return commit

    def append(self, table: str, rows: DataFrame) -> None:
        """Rows beside those of before."""
        rows.select(*column_names(table)).write.partitionBy("repo").parquet(f"{self.folder}/data/{table}/commit={time.time_ns():020d}-{uuid.uuid4().hex[:8]}")

    def delete(self, repo: str) -> None:
        """The repo is indexed no more; its rows stay on disk until :meth:`vacuum`."""
        checked_repo(repo)
        self.commit(self.spark.createDataFrame([(repo, True)], "repo string, gone boolean"), {})

    def vacuum(self) -> int:
        """Removes the data of commits that no repo's head names any more, and of those never marked; gives their number.

        Not to be run beside a commit or a reader of an older state.
        """
        # as many rows as commits are in use
        used = {r["commit"] for r in self.heads().select("commit").distinct().collect()}
        removed = 0
        for table in ("files", "symbols"):
            path, fs = self._path(f"{self.folder}/data/{table}")
            for status in fs.listStatus(path) if fs.exists(path) else []:
                name = status.getPath().getName()
                if name.startswith("commit=") and name.removeprefix("commit=") not in used:
                    removed += bool(fs.delete(status.getPath(), True))
        return removed

    def ready(self, repo: str) -> bool:
        """Whether the repo is indexed in this version."""
        return not self.read("repos", repo).where(F.col("version") == VERSION).isEmpty()

    # -- one repo as a document

    def persist(self, repo: str | None, where: str) -> str:
        """A snapshot of a repo's index, or of all, as JSON lines below ``where``, in a folder named after the repo; gives its path."""
        path = f"{where.rstrip('/')}/{snapshot_name(checked_repo(repo)) if repo else 'all'}"
        for table in ("files", "symbols"):
            rows = self.read(table, repo)
            rows.select(F.to_json(F.struct(*column_names(table)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/{table}")
        return path

    def restore(self, repo: str | None, where: str) -> None:
        """The index of a snapshot that :meth:`persist` wrote, as a new commit; rows of other repos in it are left out."""
        path = f"{where.rstrip('/')}/{snapshot_name(checked_repo(repo)) if repo else 'all'}"
        tables = {t: self.spark.read.text(f"{path}/{t}").select(F.from_json("value", SCHEMAS[t]).alias("r")).select("r.*").where("repo IS NOT NULL") for t in ("files", "symbols")}
        if repo:
            tables = {t: rows.where(F.col("repo") == repo) for t, rows in tables.items()}
        heads = self.spark.createDataFrame([(repo,)], "repo string") if repo else tables["files"].select("repo").union(tables["symbols"].select("repo")).distinct()
        self.commit(heads, tables)


def snapshot_name(path: str) -> str:
    """The name of a snapshot: the path with dashes between its parts."""
    return path.replace("/", "-")
