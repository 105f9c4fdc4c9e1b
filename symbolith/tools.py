"""The eleven tools over an :class:`~symbolith.engine.Engine`, each answering with a dictionary of bounded size.

Searches hold at most their limit of rows, an outline one file, a batch what was asked for; trees and listings stay
DataFrames. Errors are exceptions; ids of a batch that nothing is known of are told in the answer.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolith.engine import Engine
from symbolith.functions import text
from symbolith.operators import search

#: Columns of a search result, of a symbol in an outline, and of a single symbol.
RESULT = ["id", "kind", "name", "qualified_name", "file", "line", "end_line", "signature", "language", "docstring", "summary", "decorators"]
OUTLINE = ["id", "kind", "name", "qualified_name", "line", "end_line", "signature", "docstring", "summary", "decorators"]
SYMBOL = ["id", "file", "name", "qualified_name", "kind", "signature", "language", "line", "end_line", "docstring", "summary", "decorators", "source"]


def payload_bytes(rows: DataFrame) -> int:
    """Bytes of rows as JSON."""
    return rows.select(F.octet_length(F.to_json(F.struct(*rows.columns))).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


class Tools:
    def __init__(self, engine: Engine):
        self.engine = engine

    def index_folder(self, folder_path: str, generate_summaries: bool = False, extra_ignore: list[str] | None = None, follow_symlinks: bool = False, incremental: bool = True) -> dict:
        done = self.engine.index_folder(folder_path, None, extra_ignore, incremental, generate_summaries, None, follow_symlinks)
        return done | {"file_count": done["files"], "symbol_count": done["symbols"]}

    def index_repo(self, repo_url: str, pages: DataFrame, responses: DataFrame, generate_summaries: bool = False, incremental: bool = True) -> dict:
        done = self.engine.index_repo(repo_url, pages, responses, incremental, generate_summaries)
        return done | {"file_count": done["files"], "symbol_count": done["symbols"]}

    def list_repos(self) -> DataFrame:
        return self.engine.list_repos()

    def get_file_tree(self, repo: str, path_prefix: str = "") -> dict[str, Any]:
        name, files, _ = self.engine._open(repo)
        return {"repo": name, "path_prefix": path_prefix or "/", "file_count": files.count(), "tree": self.engine.file_tree(repo, path_prefix)}

    def get_file_outline(self, repo: str, file_path: str) -> dict[str, Any]:
        """The symbols of a file, nested."""
        rows = [r.asDict() for r in self.engine.file_outline(repo, file_path).collect()]
        top: list[dict] = []
        open_: list[tuple[int, dict]] = []
        for row in rows:
            node = {c: row[c] for c in OUTLINE} | {"children": []}
            while open_ and open_[-1][0] >= row["depth"]:
                open_.pop()
            (open_[-1][1]["children"] if open_ else top).append(node)
            open_.append((row["depth"], node))
        return {"file": file_path, "repo": self.engine.resolve(repo), "language": rows[0]["language"] if rows else None, "symbol_count": len(rows), "symbols": top}

    def get_repo_outline(self, repo: str) -> dict[str, Any]:
        name, files, symbols = self.engine._open(repo)
        head = self.engine.store.read("repos", name).first()
        found = self.engine.repo_outline(repo)
        count = lambda df, key: {r[key]: r["symbols"] for r in df.collect()}
        folders = [{"dir": r["dir"], "file_count": r["file_count"]} for r in found["top_folders"].orderBy(F.desc("file_count"), "dir").collect()]
        return {
            "repo": name, "indexed_at": head["indexed_at"], "git_head": head["git_head"], "file_count": files.count(), "symbol_count": symbols.count(),
            "languages": count(found["languages"], "language"), "symbol_kinds": count(found["kinds"], "kind"), "top_directories": folders,
        }

    def get_symbol(self, repo: str, symbol_id: str, verify: bool = False, context_lines: int = 0) -> dict[str, Any]:
        row = self.engine.get_symbol(repo, symbol_id, context_lines).first().asDict()
        out = {c: row[c] for c in SYMBOL} | {c: row[c] for c in ("context_before", "context_after") if row.get(c)}
        return out | ({"content_verified": row["content_verified"]} if verify and row["source"] else {})

    def get_symbols(self, repo: str, symbol_ids: list[str]) -> dict[str, Any]:
        """Symbols in the order asked for, errors for those unknown, and what reading their files, each once, would have cost."""
        rows = [r.asDict() for r in self.engine.get_symbols(repo, symbol_ids).collect()]
        known = [{c: r[c] for c in SYMBOL} for r in rows if r["id"] is not None]
        paths = sorted({r["file"] for r in known})
        raw = self.engine._open(repo)[1].where(F.col("path").isin(paths)).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n")).first()["n"] if paths else 0
        read = sum(r["byte_length"] for r in rows if r["id"] is not None)
        return {
            "symbols": known, "errors": [{"id": r["symbol_id"], "error": "not found"} for r in rows if r["id"] is None], "symbol_count": len(known), "raw_bytes": raw,
            "tokens_saved": max(0, raw - read) // text.BYTES_PER_TOKEN,
        }

    def search_symbols(self, repo: str, query: str, kind: str | None = None, file_pattern: str | None = None, language: str | None = None, limit: int = 50) -> dict[str, Any]:
        _, files, symbols = self.engine._open(repo)
        found = search.search_symbols(symbols, query, kind, language, file_pattern, limit)
        rows = [{c: r[c] for c in RESULT} for r in found.collect()]
        raw = files.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n")).first()["n"]
        return {"results": rows, "count": len(rows), "truncated": len(rows) >= limit, "total_indexed": symbols.count(), "raw_bytes": raw}

    def search_text(self, repo: str, query: str, file_pattern: str | None = None, limit: int = 100) -> dict[str, Any]:
        """Matches by file, in order, and how many files were looked into until the limit was met."""
        files = self.engine._open(repo)[1]
        rows = search.search_text(files, query, file_pattern, limit).collect()
        by: dict[str, list[dict]] = {}
        for r in rows:
            by.setdefault(r["path"], []).append({"line": r["line"], "text": r["text"]})
        full = len(rows) >= limit
        opened = search.opened_files(files, file_pattern, rows[-1] if full else None).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).first()
        return {"matches": by, "total_matches": len(rows), "truncated": full, "files_searched": opened["n"], "raw_bytes": opened["b"]}

    def invalidate_cache(self, repo: str) -> dict[str, Any]:
        self.engine.invalidate(repo)
        return {"success": True, "repo": repo, "message": "no longer indexed"}

