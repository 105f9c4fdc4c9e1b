"""The index as an object that reads and writes it by DataFrames; :mod:`symbolith.tools` answers in small dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolith.functions import security, text
from symbolith.operators import index, outline, parse, retrieve, search
from symbolith.sources import folder as folders
from symbolith.sources.store import VERSION, Store, checked_repo
from symbolith.sources.tables import materialise, ship, small_enough

#: Answers for a batch of prompts; none by default.
Summarizer = Callable[[list[str]], list[str]]


class NotIndexed(LookupError):
    """The repository, file or symbol isn't in the index."""


class Engine:
    def __init__(self, spark: SparkSession, store: str, summarizer: Summarizer | None = None):
        ship(spark)
        self.spark = spark
        self.store = Store(spark, store)
        self.summarizer = summarizer

    # -- writing

    def index_folder(self, root: str, repo: str | None = None, extra_ignore: list[str] | None = None, incremental: bool = True, summaries: bool = False, max_files: int | None = None, follow_symlinks: bool = False) -> dict:
        """Index a folder; incrementally only what changed since is parsed.

        Links are left out, or followed as long as they end inside the folder. ``max_files`` and the largest file come
        from the session's configuration unless given.
        """
        name = checked_repo(repo or "local/" + root.rstrip("/").rsplit("/", 1)[-1])
        patterns = [*folders.ignore_patterns(self.spark, root), *(extra_ignore or [])]
        most, largest = folders.limits(self.spark)
        most = max_files or most
        kept, skipped = folders.discover(folders.folder_files(self.spark, root, name, follow_symlinks), patterns, most, largest)
        done = self.index_files(name, kept, incremental, summaries)
        warnings = [f"only the first {most} files are indexed"] if done["files"] >= most else []
        counts = dict.fromkeys(security.SKIP_REASONS, 0) | {r["reason"]: r["files"] for r in skipped.collect()}
        return done | {"skip_counts": counts, "warnings": warnings}

    def index_repo(self, url: str, pages: DataFrame, responses: DataFrame, incremental: bool = True, summaries: bool = False, git_head: str | None = None) -> dict:
        """Index a hosted repository from what its hosting interface delivered.

        ``pages`` (repo, value) holds the pages of its tree and ``responses`` (repo, path, value) the bodies of its files,
        both as JSON, read from wherever a fetcher put them. Bodies that failed or are empty are left out.
        """
        found = self.spark.createDataFrame([(url,)], "url string").select(text.repository_of(F.col("url")).alias("repo")).first()["repo"]
        if found is None:
            raise ValueError(f"not a repository's address: {url!r}")
        name = checked_repo(found)
        most, largest = folders.limits(self.spark)
        own = F.col("repo") == name
        tree = folders.listed_tree(folders.tree_entries(pages.where(own)), largest, most)
        if tree.isEmpty():
            raise NotIndexed(f"{name}: no source files")
        files = tree.select("repo", "path", "language").join(folders.fetched_files(responses.where(own)), ["repo", "path"])
        return self.index_files(name, files, incremental, summaries, git_head)

    def index_files(self, repo: str, files: DataFrame, incremental: bool = True, summaries: bool = False, git_head: str | None = None) -> dict:
        """Index file rows (repo, path, language, content) of one repo, from wherever they were read."""
        return self.index_corpus(files, self.spark.createDataFrame([(checked_repo(repo), git_head)], "repo string, git_head string"), incremental, summaries) | {"repo": repo}

    def index_corpus(self, files: DataFrame, repos: DataFrame | None = None, incremental: bool = True, summaries: bool = False) -> dict:
        """Index the file rows of any number of repos in one commit.

        ``repos`` (repo, and git_head if known) names the repos that ``files`` holds whole, those without any files now
        included; by default those that occur. Incrementally, only files that changed since are parsed, unless the last
        run found files but no symbols.
        """
        found = files.where("content IS NOT NULL").select(
            "repo", "path", "language", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"), "content", (~security.priority(F.col("path"))).cast("long").alias("file_seq")
        )
        new = materialise(found, "files")
        repos = materialise(repos if repos is not None else new.select("repo").distinct(), "repos")
        return self._commit(new, repos, None, incremental, summaries)

    def apply_changes(self, changed: DataFrame, deleted: DataFrame) -> dict:
        """Index only what a burst of changes touched: ``changed`` file rows and ``deleted`` (repo, path); all else stays as it is."""
        rows = materialise(changed.where("content IS NOT NULL").select("repo", "path", "language", "content"), "changed")
        gone = materialise(deleted.select("repo", "path").distinct(), "deleted")
        repos = materialise(rows.select("repo").union(gone.select("repo")).distinct(), "repos")
        found = rows.select(
            "repo", "path", "language", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"), "content", (~security.priority(F.col("path"))).cast("long").alias("file_seq")
        )
        return self._commit(materialise(found, "files"), repos, gone, True, False)

    def _commit(self, new: DataFrame, repos: DataFrame, gone: DataFrame | None, incremental: bool, summaries: bool) -> dict:
        """``gone`` is None where ``new`` holds the repos whole; else ``new`` and ``gone`` are all that may have changed."""
        within = lambda df: df.join(F.broadcast(repos.select("repo")) if few else repos.select("repo"), "repo", "left_semi")
        few = small_enough(repos) is not None
        stored, known = within(self.store.read("files")), within(self.store.read("symbols"))
        if incremental:
            # of a repo with files but no symbols the last run failed
            failed = stored.select("repo").distinct().join(known.select("repo").distinct(), "repo", "left_anti")
            old = stored.join(failed, "repo", "left_anti") if gone is None else stored
        else:
            old = stored.limit(0)
        hashes = old.select("repo", "path", F.col("content_hash").alias("digest"))
        if gone is not None:
            touched = new.select("repo", "path").union(gone).distinct()
            hashes = hashes.join(touched, ["repo", "path"], "left_semi")
        changes = materialise(index.detect_changes(hashes, new.select("repo", "path", F.col("content_hash").alias("digest"))), "changes")
        counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        incremental = incremental and not old.isEmpty()
        out = {"success": True, "incremental": incremental, "changes": counts}
        if incremental and not counts:
            return out | {"message": "nothing changed", "files": stored.count(), "symbols": known.count(), "files_processed": 0, "languages": {}}
        work = materialise(index.files_to_process(new, changes), "work")
        fresh = parse.parsed(work)
        full = fresh.withColumn("summary", F.lit("")).withColumn("keywords", F.array().cast("array<string>"))
        if summaries:
            full = self.summarized(full)
        merged = materialise(index.merge_symbols((known if incremental else known.limit(0)).select(*full.columns), full, changes), "symbols")
        if gone is None:
            files = new
        else:
            files = stored.select(*new.columns).join(changes.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(work.select(*new.columns))
            files = materialise(files, "files")
        self.store.commit(repos, {"files": files, "symbols": merged})
        languages = {r["language"]: r["count"] for r in work.groupBy("language").count().collect()}
        return out | {"files": files.count(), "symbols": merged.count(), "files_processed": sum(languages.values()), "languages": languages}

    def summarized(self, rows: DataFrame) -> DataFrame:
        """Fills empty summaries: from the docstring, then the given summarizer in batches of twenty, then the signature.

        The summarizer gets one text for each symbol of a batch and may answer with fewer; what it leaves out, or an
        error of its own, falls to the signature.
        """
        told = text.docstring_summary(F.col("docstring"))
        filled = rows.withColumn("summary", F.when(F.col("summary") != "", F.col("summary")).otherwise(F.coalesce(told, F.lit(""))))
        ask = self.summarizer
        if ask is not None:
            name = F.col("qualified_name") if "qualified_name" in rows.columns else F.col("name")
            asked = filled.withColumn("_prompt", text.prompt_item(F.lit(""), F.col("kind"), name, F.coalesce("signature", F.lit("")), F.col("docstring")))

            def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    open_ = batch.index[batch["summary"] == ""]
                    for at in range(0, len(open_), 20):
                        part = open_[at : at + 20]
                        try:
                            told = ask([f"{n + 1}{batch.at[i, '_prompt']}" for n, i in enumerate(part)])
                        except Exception:  # noqa: BLE001
                            told = []
                        for i, value in zip(part, told):
                            batch.at[i, "summary"] = value or ""
                    yield batch.drop(columns=["_prompt"])

            filled = asked.mapInPandas(answer, filled.schema)
        made = text.signature_summary(F.col("kind"), F.col("name"), F.col("signature"))
        return filled.withColumn("summary", F.when(F.col("summary") == "", made).otherwise(F.col("summary")))

    def invalidate(self, repo: str) -> None:
        self.store.delete(self.resolve(repo, missing_ok=True))

    # -- reading

    def resolve(self, repo: str, missing_ok: bool = False) -> str:
        """The full name of a repo given in full or by its last part alone."""
        if "/" in repo:
            return checked_repo(repo)
        rows = outline.short_names(self.store.read("repos")).where(F.col("short_name") == repo).collect()
        if not rows or rows[0]["repo"] is None:
            if missing_ok and not rows:
                return checked_repo(f"local/{repo}")
            raise NotIndexed(f"{repo}: {'several repositories' if rows else 'no repository'} of this name")
        return rows[0]["repo"]

    def _open(self, repo: str) -> tuple[str, DataFrame, DataFrame]:
        name = self.resolve(repo)
        if not self.store.ready(name):
            raise NotIndexed(name)
        return name, self.store.read("files", name), self.store.read("symbols", name)

    def list_repos(self) -> DataFrame:
        return outline.catalog(self.store.read("repos").where(F.col("version") == VERSION), self.store.read("files"), self.store.read("symbols"))

    def file_tree(self, repo: str, path_prefix: str = "") -> DataFrame:
        _, files, symbols = self._open(repo)
        return outline.tree_order(outline.file_tree(files, symbols, path_prefix)).orderBy("sort_key")

    def file_outline(self, repo: str, path: str) -> DataFrame:
        """The symbols of a file with depth, root and place in preorder, in this order."""
        name, files, symbols = self._open(repo)
        if files.where(F.col("path") == path).isEmpty():
            raise NotIndexed(f"{name}: {path}")
        own = symbols.where(F.col("file") == path)
        placed = outline.file_forest(own).drop("repo", "file")
        return own.join(placed, "id").orderBy("preorder", "byte_offset")

    def repo_outline(self, repo: str) -> dict[str, DataFrame]:
        _, files, symbols = self._open(repo)
        by = lambda c: symbols.groupBy(c).agg(F.count(F.lit(1)).alias("symbols"))
        return {"languages": by("language"), "kinds": by("kind"), "top_folders": outline.top_folders(files)}

    def get_symbol(self, repo: str, symbol_id: str, context_lines: int = 0) -> DataFrame:
        name, files, symbols = self._open(repo)
        own = symbols.where(F.col("id") == symbol_id)
        if own.isEmpty():
            raise NotIndexed(f"{name}: {symbol_id}")
        found = retrieve.with_source(own, files).drop("content")
        return retrieve.with_context(found, files, context_lines).drop("content") if context_lines else found

    def get_symbols(self, repo: str, symbol_ids: list[str]) -> DataFrame:
        """In the order asked for, duplicates kept; unknown ids have a null ``id``."""
        name, files, symbols = self._open(repo)
        asked = self.spark.createDataFrame([(name, n, i) for n, i in enumerate(symbol_ids)], "repo string, pos int, symbol_id string")
        sourced = retrieve.with_source(symbols.join(asked.select(F.col("symbol_id").alias("id")).distinct(), "id", "left_semi"), files).drop("content")
        return retrieve.lookup(sourced, asked).orderBy("pos")

    def search_symbols(self, repo: str, query: str, **options) -> DataFrame:
        return search.search_symbols(self._open(repo)[2], query, **options)

    def search_text(self, repo: str, query: str, file_pattern: str | None = None, limit: int = 100) -> DataFrame:
        return search.search_text(self._open(repo)[1], query, file_pattern, limit).drop("file_seq")

    # -- savings

    def record_savings(self, tool: str, repo: str, raw_bytes: int, response_bytes: int) -> None:
        """Appends to the ledger what an answer saved against reading everything; nothing where nothing was saved."""
        row = self.spark.createDataFrame([(tool, repo)], "tool string, repo string").select(
            F.current_timestamp().alias("ts"), "tool", "repo", text.tokens_saved(F.lit(raw_bytes), F.lit(response_bytes)).alias("tokens_saved")
        )
        self.store.append("savings", row.where("tokens_saved > 0"))

    def total_saved(self) -> int:
        return self.store.read("savings").agg(F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("n")).first()["n"]
