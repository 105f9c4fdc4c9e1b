"""The registered queries of the core and, where SQL can say the same, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolith.engine import Engine
from symbolith.functions import security, text
from symbolith.operators import hierarchy, index, outline, parse, retrieve, search, snapshots
from symbolith.plans.oracles import ORACLES
from symbolith.sources import folder as folders
from symbolith.sources.store import FILES
from symbolith.sources.tables import materialise, shared_folder, table
from symbolith.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the queries; the SQL has the same ones.
IGNORE = ["modules/", "*.jsx", "!core/*.jsx", "/api/**/chunk*"]
MAX_BYTES = 4096
PER_REPO = 50
SESSION = "10 MINUTES"


def files(s: SparkSession, d: str) -> DataFrame:
    return index.files(s, d)


def language_of_file(s, d):
    return files(s, d).select("repo", "path", text.extension(F.col("path")).alias("extension"), "language")


def exclude_reason(s, d):
    reason = security.exclude_reason(F.col("path"), F.col("is_symlink"), F.col("size_bytes"), F.col("content"), MAX_BYTES)
    return files(s, d).select("repo", "path", reason.alias("reason"))


def skipped(s, d):
    reason = security.skip_reason(F.col("path"), F.col("is_symlink"), F.col("size_bytes"), F.col("content"), IGNORE, MAX_BYTES)
    return files(s, d).withColumn("reason", reason)


def skip_counts(s, d):
    reasons = s.createDataFrame([(r,) for r in security.SKIP_REASONS], "reason string")
    counts = skipped(s, d).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return reasons.join(counts, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).cast("long").alias("files"))


def discover_priority_cap(s, d):
    found = skipped(s, d).where("reason IS NULL").withColumn("priority", security.priority(F.col("path")))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("priority"), "path"))
    return found.withColumn("place", rank.cast("long")).where(F.col("place") <= PER_REPO).select("repo", "path", "priority", "place")


def binary_content(s, d):
    found = files(s, d).select(security.binary_content(F.encode("content", "UTF-8")).alias("binary"))
    return found.groupBy("binary").agg(F.count(F.lit(1)).alias("files"))


def new_hashes(s, d):
    return files(s, d).where("content IS NOT NULL").select("repo", "path", F.col("content_hash").alias("digest"))


def detect_changes(s, d):
    return index.detect_changes(index.stored_hashes(s, d, newest=False), new_hashes(s, d))


def files_to_process(s, d):
    return index.files_to_process(files(s, d), detect_changes(s, d)).select("repo", "path", "size_bytes")


def merge_symbols(s, d):
    """Symbols as first seen, with those of the files that changed since as last seen."""
    first = index.symbols(s, d, ["file"], newest=False).select("repo", "file", "id", F.lit("first").alias("seen"))
    last = index.symbols(s, d, ["file"]).select("repo", "file", "id", F.lit("last").alias("seen"))
    return index.merge_symbols(first, last, materialise(detect_changes(s, d), "changes"))


def processed_languages(s, d):
    """How many files of each language a run has to parse."""
    work = index.files_to_process(files(s, d), detect_changes(s, d))
    return work.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"))


def failed_runs(s, d):
    """Repos with files but no symbols, whose last run failed."""
    held = files(s, d).where("content IS NOT NULL").select("repo").distinct()
    return held.join(index.symbols(s, d, []).select("repo").distinct(), "repo", "left_anti")


def merge_file_hashes(s, d):
    return index.merge_hashes(index.stored_hashes(s, d, newest=False), new_hashes(s, d))


def disambiguate_overloads(s, d):
    rows = index.symbols(s, d, ["file", "qualified_name", "kind"])
    return index.disambiguated(rows).select("repo", "id", "base_id", "own_id", F.col("n_same").cast("long").alias("n_same"))


def line_offsets(s, d):
    return index.line_offsets(index.lines(files(s, d))).select("repo", "path", F.col("line").cast("long").alias("line"), "byte_offset", F.octet_length("text").cast("long").alias("bytes"))


def ranged(s, d):
    columns = ["file", "byte_offset", "byte_length", "content_hash"]
    return retrieve.with_source(index.symbols(s, d, columns).where("byte_offset >= 0 AND byte_length >= 0"), files(s, d).where("content IS NOT NULL"))


def symbol_source_bytes(s, d):
    return ranged(s, d).select("repo", "id", "source_hash")


def verify_hash(s, d):
    return ranged(s, d).groupBy("repo", "content_verified").agg(F.count(F.lit(1)).alias("symbols"))


SEARCHED = ["file", "name", "qualified_name", "kind", "signature", "summary", "docstring", "language", "keywords"]


def symbol_search(query: str, **options) -> Query:
    def run(s, d):
        found = search.search_symbols(index.symbols(s, d, SEARCHED), query, **options)
        return found.select("repo", "id", "name", "kind", F.col("score").cast("long").alias("score"))

    return run


def search_text(s, d):
    return search.search_text(files(s, d), "retention LIMIT").select("repo", "path", F.col("line").cast("long").alias("line"), "text")


def search_text_glob(s, d):
    return search.search_text(files(s, d), "return", "core/*.go", 200).select("repo", "path", F.col("line").cast("long").alias("line"), "text")


def search_text_all(s, d):
    found = search.matching_lines(files(s, d), "todo")
    return found.select("repo", "path", F.col("line").cast("long").alias("line"), "text")


def search_text_grouped(s, d):
    grouped = search.grouped_matches(search.matching_lines(files(s, d), "fixme"))
    return grouped.select("repo", "path", F.size("matches").cast("long").alias("matches"), F.array_join(F.transform("matches", lambda m: m["line"].cast("string")), ",").alias("lines"))


def files_searched(s, d):
    """How many files a search that stops at its limit has opened: those up to the last match."""
    current = files(s, d)
    # one row
    last = search.search_text(current, "retention LIMIT").agg(F.max("file_seq").alias("last"), F.count(F.lit(1)).alias("n")).first()
    full = last["n"] >= 100
    opened = current.select("file_seq").where(F.col("file_seq") <= last["last"]) if full else current.select("file_seq")
    return opened.agg(F.count(F.lit(1)).alias("files_searched")).withColumn("truncated", F.lit(full))


def requests(s, d):
    rows = index.symbols(s, d, ["parent"]).where("parent IS NOT NULL")
    return rows.select("repo", F.col("symbol_seq").alias("pos"), F.col("parent").alias("symbol_id"))


def get_symbols_batch(s, d):
    found = retrieve.lookup(index.symbols(s, d, ["name", "kind"]).drop("symbol_seq"), requests(s, d))
    return found.where("id IS NOT NULL").select("repo", "pos", "symbol_id", "name", "kind")


def get_symbols_errors(s, d):
    return retrieve.lookup(index.symbols(s, d, ["name"]).drop("symbol_seq"), requests(s, d)).where("id IS NULL").select("repo", "pos", "symbol_id")


def get_symbol_context(s, d):
    rows = index.symbols(s, d, ["file", "line", "end_line"])
    return retrieve.with_context(rows, files(s, d).where("content IS NOT NULL"), 2).select("repo", "id", "context_before", "context_after")


def file_tree(s, d):
    return outline.file_tree(files(s, d), index.symbols(s, d, ["file"]))


def file_tree_prefix(s, d):
    return outline.file_tree(files(s, d), index.symbols(s, d, ["file"]), "src").select("repo", "path", "type", "depth")


def file_tree_order(s, d):
    """The tree in the order of a walk: folders first, each by name."""
    tree = outline.file_tree(files(s, d), index.symbols(s, d, ["file"]))
    return outline.tree_order(tree).select("repo", "path", "type", "sort_key")


def file_outline(s, d):
    """The symbols of every file as a forest in preorder: parents of the same file only."""
    return outline.file_forest(index.symbols(s, d, ["file", "parent"]))


def repo_languages(s, d):
    return index.symbols(s, d, ["language"]).groupBy("repo", F.lower("language").alias("language")).agg(F.count(F.lit(1)).alias("symbols"))


def repo_kinds(s, d):
    return index.symbols(s, d, ["kind"]).groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("symbols"))


def repo_top_dirs(s, d):
    return outline.top_folders(files(s, d))


def file_languages(s, d):
    """Symbols per file and the language its last symbol has."""
    rows = index.symbols(s, d, ["file", "language"])
    return rows.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("symbols"), F.max_by("language", F.struct("symbol_seq", "id")).alias("language"))


def list_repos(s, d):
    return outline.catalog(table(s, d, "repos"), files(s, d), index.symbols(s, d, []))


def resolve_short_name(s, d):
    return outline.short_names(table(s, d, "repos"))


def docstring_summary(s, d):
    return index.symbols(s, d, ["docstring"]).select("repo", "id", text.docstring_summary(F.col("docstring")).alias("summary"))


def signature_summary(s, d):
    rows = index.symbols(s, d, ["kind", "name", "signature"])
    return rows.select("repo", "id", text.signature_summary(F.col("kind"), F.col("name"), F.col("signature")).alias("summary"))


def summary_tiers(s, d):
    rows = index.symbols(s, d, ["summary", "docstring", "kind", "name", "signature"])
    given, told = F.when(F.trim("summary") != "", F.col("summary")), text.docstring_summary(F.col("docstring"))
    tier = F.when(given.isNotNull(), "given").when(told.isNotNull(), "docstring").otherwise("signature")
    return rows.select("repo", "id", tier.alias("tier"), F.coalesce(given, told, text.signature_summary(F.col("kind"), F.col("name"), F.col("signature"))).alias("summary"))


def summary_prompts(s, d):
    """The prompts for the symbols of a file in batches of twenty."""
    rows = index.symbols(s, d, ["file", "kind", "qualified_name", "signature", "docstring"])
    at = F.row_number().over(Window.partitionBy("repo", "file").orderBy("symbol_seq", "id")) - 1
    numbered = rows.withColumn("at", at).withColumn("batch", F.floor(F.col("at") / 20).cast("long")).withColumn("number", F.pmod("at", F.lit(20)) + 1)
    item = text.prompt_item(F.col("number"), F.col("kind"), F.col("qualified_name"), F.coalesce("signature", F.lit("")), F.col("docstring"))
    made = numbered.select("repo", "file", "batch", "number", item.alias("item")).groupBy("repo", "file", "batch").agg(F.array_sort(F.collect_list(F.struct("number", "item"))).alias("x"))
    items = F.array_join(F.transform("x", lambda v: F.coalesce(v["item"], F.lit(""))), "\n\n")
    return made.select("repo", "file", "batch", F.concat(F.lit(text.PROMPT_HEAD + "\n\n"), items).alias("prompt"))


def parse_numbered_response(s, d):
    rows = table(s, d, "documents").select("doc_id", text.numbered_answers(F.regexp_replace("text", "\n- ", "\n12. ")).alias("answers"))
    return rows.select("doc_id", F.posexplode("answers").alias("pos", "answer")).select("doc_id", (F.col("pos") + 1).cast("long").alias("n"), "answer")


def padded_answers(s, d):
    """Numbered answers brought to the count that was asked for."""
    asked = F.col("doc_id") % 5 + 1
    rows = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", text.numbered_answers(F.regexp_replace("text", "\n- ", "\n12. "), asked).alias("answers"))
    return rows.select("doc_id", F.posexplode("answers").alias("pos", "answer")).select("doc_id", (F.col("pos") + 1).cast("long").alias("n"), "answer")


def batch_bytes(s, d):
    """What a batch of all requested parents reads: its files, each once, their bytes and those of the symbols."""
    wanted = index.symbols(s, d, ["file", "byte_length"]).join(requests(s, d).select("repo", F.col("symbol_id").alias("id")).distinct(), ["repo", "id"], "left_semi")
    return retrieve.read_bytes(wanted, files(s, d))


def raw_bytes(s, d):
    """Bytes of all files of a repo, and of those that a search met."""
    current = files(s, d)
    met = search.matching_lines(current, "todo").select("repo", "path").distinct().withColumn("met", F.lit(True))
    both = current.select("repo", "path", "size_bytes").join(met, ["repo", "path"], "left")
    return both.groupBy("repo").agg(F.sum("size_bytes").alias("all_bytes"), F.coalesce(F.sum(F.when(F.col("met"), F.col("size_bytes"))), F.lit(0)).alias("met_bytes"), F.count("met").alias("met_files"))


def search_response(s, d):
    """What a symbol search tells beside its results, by kind of the symbols searched."""
    rows = index.symbols(s, d, SEARCHED)
    found = rows.withColumn("score", search.score("merge")).where("score > 0").groupBy("kind").agg(F.count(F.lit(1)).alias("matches"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("total_indexed")).join(found, "kind", "left").select(
        "kind", "total_indexed", F.least(F.coalesce("matches", F.lit(0)), F.lit(50)).cast("long").alias("count"), (F.coalesce("matches", F.lit(0)) >= 50).alias("truncated")
    )


def payload_bytes(s, d):
    """Bytes of every symbol as the JSON of an answer."""
    rows = index.symbols(s, d, ["name", "kind", "line"]).select("repo", "id", F.struct("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("line", F.lit(0)).alias("line")).alias("x"))
    return rows.select("repo", "id", F.octet_length(F.to_json("x")).cast("long").alias("bytes"))


def tokens_saved(s, d):
    """What a look at one symbol saves against reading its file."""
    sizes = files(s, d).select("repo", F.col("path").alias("file"), "size_bytes")
    rows = index.symbols(s, d, ["file", "byte_length"]).join(sizes, ["repo", "file"])
    return rows.groupBy("repo", "file").agg(F.sum(text.tokens_saved(F.col("size_bytes"), F.col("byte_length"))).alias("tokens_saved"))


def savings_running_total(s, d):
    """The ledger of positive savings by user, in order of time; days are summed first, so that no user's rows meet in one task."""
    saved = F.floor(F.col("value") * 4).cast("long")
    rows = table(s, d, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), saved.alias("saved")).where("saved > 0")
    days = rows.groupBy("user_id", "day").agg(F.sum("saved").alias("held"))
    ahead = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("user_id", "day", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("start"))
    so_far = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("within", F.sum("saved").over(so_far))
    return within.join(starts, ["user_id", "day"]).select("event_id", "user_id", "saved", (F.col("start") + F.col("within")).alias("total"))


def debounce_sessions(s, d):
    """Bursts of events of a user, ended by a quiet time; events of one minute meet before the shuffle."""
    events = table(s, d, "events").select("user_id", "ts", F.date_trunc("minute", "ts").alias("minute"))
    minutes = events.groupBy("user_id", "minute").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("events"))
    order = Window.partitionBy("user_id").orderBy("minute")
    fresh = F.coalesce(F.col("first") >= F.lag("last").over(order) + F.expr(f"INTERVAL {SESSION}"), F.lit(True))
    burst = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = minutes.withColumn("fresh", fresh.cast("int")).withColumn("burst", burst)
    bursts = numbered.groupBy("user_id", "burst").agg(F.min("first").cast("timestamp").alias("first"), F.max("last").cast("timestamp").alias("last"), F.sum("events").alias("events"))
    return bursts.select("user_id", F.unix_micros("first").alias("start_us"), F.unix_micros("last").alias("last_us"), "events")


def duplicate_content(s, d):
    rows = files(s, d).where("content <> ''").groupBy("content_hash").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("repo").alias("repos"), F.min("path").alias("first_path"))
    return rows.where("files > 1")


def repository_urls(s, d):
    rows = table(s, d, "repos").select("repo").where("repo IS NOT NULL").distinct()
    forms = F.array(*[F.format_string(f, F.col("repo")) for f in ("https://github.com/%s", "https://github.com/%s.git", "git@github.com:%s.git", "github.com/%s/", "%s")])
    return rows.select("repo", F.explode(forms).alias("url")).select("repo", "url", text.repository_of(F.col("url")).alias("parsed"))


def delivered_bodies(s, d):
    """The files as a hosting interface delivers their bodies: one JSON document a file, base64 in lines."""
    lined = F.regexp_replace(F.regexp_replace(F.base64(F.encode("content", "UTF-8")), r"\s", ""), f"(.{{{folders.BODY_LINE}}})", "$1\n")
    body = F.to_json(F.struct("path", F.lit("base64").alias("encoding"), lined.alias("content")))
    return materialise(files(s, d).where("content IS NOT NULL").select("repo", "path", body.alias("value")), "bodies")


def fetched_content(s, d):
    """The files read back from delivered bodies."""
    return folders.fetched_bodies(delivered_bodies(s, d)).select("repo", "path", "fetch_status", F.sha2("content", 256).alias("content_hash"))


def body_addresses(s, d):
    return files(s, d).select("repo", "path", folders.body_address(F.col("repo"), F.col("path")).alias("address"))


def delivered_trees(s, d):
    """The files of every repo as pages of the JSON that a hosting interface lists trees in, some 500 entries each."""
    rows = files(s, d).select("repo", F.struct("path", F.col("content_hash").alias("sha"), F.col("size_bytes").alias("size"), folders.body_address(F.col("repo"), F.col("path")).alias("url"), F.lit("blob").alias("type")).alias("e"))
    counts = rows.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / 500).alias("pages"))
    paged = rows.join(counts, "repo").groupBy("repo", F.pmod(F.xxhash64("e.path"), "pages").alias("page")).agg(F.collect_list("e").alias("tree"))
    return materialise(paged.select("repo", F.to_json(F.struct(F.lit(False).alias("truncated"), "tree")).alias("value")), "trees")


def repo_tree(s, d):
    """The source files that the pages of a hosted tree list, those of the first folders first, to a cap a repo."""
    listed = folders.listed_tree(folders.tree_entries(delivered_trees(s, d)), max_files=PER_REPO)
    return listed.select("repo", "path", "language", "size", "priority")


def new_store(s):
    return Engine(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}")


def indexed_files(s, d):
    """The files of all repos after they went through discovery into a store, and were read from it."""
    engine = new_store(s)
    engine.index_corpus(skipped(s, d).where("reason IS NULL").select("repo", "path", "language", "content"))
    return engine.store.read("files").select("repo", "path", "language", "content_hash", "size_bytes")


def snapshot_round_trip(s, d):
    """The current symbols of all repos after a commit, a snapshot as JSON, and a commit of what was read from it."""
    store = new_store(s).store
    rows = index.symbols(s, d, ["file", "name", "qualified_name", "kind", "signature", "language", "line", "end_line", "byte_offset", "byte_length", "docstring", "summary", "parent", "decorators", "keywords", "content_hash"])
    store.commit(rows.select("repo").distinct(), {"symbols": rows, "files": s.createDataFrame([], FILES)})
    where = f"{store.folder}/snapshots"
    store.persist(None, where)
    other = new_store(s).store
    other.restore(None, where)
    return other.read("symbols").select("repo", "id", "name", "kind", "line", "docstring", "parent", F.size("decorators").cast("long").alias("decorators"), "content_hash")


def streamed_files(s, d):
    """The files of all repos after their rows came as a stream: of each path the row fetched last."""
    engine = new_store(s)
    path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/source_files.parquet")
    folder = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source = {"folder": f"{d}/source_files.parquet"} if folder else {"folder": d, "pattern": "source_files.parquet"}
    prepare = lambda rows: rows.select("repo", text.plain_path(F.col("rel_path")).alias("path"), "content", F.struct("fetched_at", "file_id").alias("at"))
    schema = table(s, d, "source_files").schema
    watch.watch_files(engine, None, checkpoint=f"{engine.store.folder}/checkpoint", schema=schema, prepare=prepare, **source).awaitTermination()
    return engine.store.read("files").select("repo", "path", "language", "content_hash")


def watched_without(s, d):
    """The folders to watch beside those of an exclude list: here the top folders that begin with a letter up to c, read from a text with comments."""
    top = F.split_part("path", F.lit("/"), F.lit(1))
    lines = files(s, d).where(F.contains("path", F.lit("/")) & (F.lower(F.substring(top, 1, 1)) <= "c")).select(F.concat(F.lit("  "), top, F.lit("  # left out")).alias("value")).distinct()
    written = materialise(lines.unionByName(s.createDataFrame([("# folders",), ("",)], "value string")), "excludes")
    named = folders.excluded_lines(written)
    rows = watched_folders(s, d).withColumn("part", F.explode(F.split("folder", "/")))
    out = rows.join(named.select(F.col("value").alias("part")), "part", "left_semi").select("repo", "folder").distinct()
    return rows.select("repo", "folder").distinct().join(out, ["repo", "folder"], "left_anti")


def watched_folders(s, d):
    """The folders to watch: every folder that holds files and lies in none that is passed over."""
    rows = files(s, d).where(F.contains("path", F.lit("/")) & ~security.skipped_entry(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    return rows.select("repo", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()


def parsed_symbols(s, d):
    rows = parse.parsed(files(s, d).where("content IS NOT NULL"))
    return rows.select("repo", "file", "id", "name", "qualified_name", "kind", "signature", "line", "end_line", "byte_offset", "byte_length", "docstring", "parent", "content_hash")


def parsed_confirmed(s, d):
    """The parsed symbols at the places where the table has one whose hash is that of the file's bytes there."""
    current = files(s, d).where("content IS NOT NULL")
    rows = index.symbols(s, d, ["file", "name", "kind", "byte_offset", "byte_length", "content_hash"]).where("byte_offset >= 0 AND byte_length > 0")
    right = retrieve.with_source(rows, current).where("content_verified").select("repo", "file", "byte_offset", "name", "kind").distinct()
    return parse.parsed(current).join(right, ["repo", "file", "byte_offset", "name", "kind"], "left_semi").select("repo", "file", "name", "kind", "line", "end_line", "byte_offset")


def parse_status(s, d):
    """Files by language and whether they were read without errors."""
    found = parse.parse_status(files(s, d))
    return found.groupBy("language", "parse_status").agg(F.count(F.lit(1)).alias("files"), F.sum("parse_errors").alias("errors"), F.sum("symbols").alias("symbols"))


def incremental_index(s, d):
    """Symbols after an incremental run: those of unchanged files as indexed, the others parsed anew."""
    changes = materialise(detect_changes(s, d), "changes")
    old = index.symbols(s, d, ["file", "qualified_name", "kind"]).select("repo", "file", "id", "qualified_name", "kind")
    fresh = parse.parsed(index.files_to_process(files(s, d).where("content IS NOT NULL"), changes)).select("repo", "file", "id", "qualified_name", "kind")
    return index.merge_symbols(old, fresh, changes)


QUERIES: dict[str, Query] = {
    "p3_found": hierarchy.p3_found,
    "p3_paths": hierarchy.p3_paths,
    "p3_descendants": hierarchy.p3_descendants,
    "p6_found": snapshots.p6_found,
    "p6_intervals": snapshots.p6_intervals,
    "search_symbols_exact": symbol_search("ColdSlice"),
    "search_symbols_prefix": symbol_search("merge"),
    "search_symbols_substring": symbol_search("Ledger", limit=100),
    "search_symbols_kind": symbol_search("file", kind="class"),
    "search_symbols_language": symbol_search("load", language="python"),
    "search_symbols_glob": symbol_search("e", file_pattern="src/*.ts"),
    "search_symbols_empty": symbol_search("", limit=100),
    **{
        f.__name__: f
        for f in (
            language_of_file, exclude_reason, skip_counts, discover_priority_cap, binary_content, detect_changes, files_to_process, merge_symbols, merge_file_hashes, disambiguate_overloads,
            line_offsets, symbol_source_bytes, verify_hash, search_text, search_text_glob, search_text_all, search_text_grouped, files_searched, get_symbols_batch, get_symbols_errors,
            get_symbol_context, file_tree, file_tree_prefix, file_outline, repo_languages, repo_kinds, repo_top_dirs, file_languages, list_repos, resolve_short_name, docstring_summary,
            signature_summary, summary_tiers, summary_prompts, parse_numbered_response, tokens_saved, savings_running_total, debounce_sessions, duplicate_content, repository_urls,
            fetched_content, watched_folders, parsed_symbols, incremental_index, processed_languages, failed_runs, file_tree_order, padded_answers, batch_bytes, raw_bytes, search_response, payload_bytes,
            body_addresses, repo_tree, indexed_files, snapshot_round_trip, streamed_files, watched_without, parsed_confirmed, parse_status,
        )
    },
}


def oracles() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
