"""The index as DataFrames: files, symbols, their changes and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolith.functions.text import language, plain_path, symbol_id
from symbolith.operators.snapshots import file_states
from symbolith.sources.tables import latest, table


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(repo, path, language, content_hash, size_bytes, content, file_seq, is_symlink): the last fetch of each path."""
    rows = table(spark, folder, "source_files").where("repo IS NOT NULL AND rel_path IS NOT NULL").select("repo", plain_path(F.col("rel_path")).alias("path"), "content", "is_symlink", "file_id", "fetched_at")
    last = latest(rows, ["repo", "path"], ["fetched_at", "file_id"])
    return last.select(
        "repo", "path", language(F.col("path")).alias("language"), F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"),
        "content", F.col("file_id").alias("file_seq"), "is_symlink",
    )


def symbols(spark: SparkSession, folder: str, columns: list[str], newest: bool = True) -> DataFrame:
    """The current rows of the symbols, or those seen first, with ``columns`` besides repo, id and symbol_seq."""
    need = list(dict.fromkeys(["repo", "id", *columns, "seen_at", "symbol_seq"]))
    rows = table(spark, folder, "code_symbols").where("repo IS NOT NULL AND id IS NOT NULL").select(*need)
    if newest:
        return latest(rows, ["repo", "id"], ["seen_at", "symbol_seq"]).drop("seen_at")
    early = rows.withColumn("_age", -F.unix_micros(F.col("seen_at").cast("timestamp"))).withColumn("_back", -F.col("symbol_seq"))
    return latest(early, ["repo", "id"], ["_age", "_back"]).drop("seen_at", "_age", "_back")


def stored_hashes(spark: SparkSession, folder: str, newest: bool = True) -> DataFrame:
    """(repo, path, digest) of the last, or first, complete snapshot of each repo."""
    states = file_states(table(spark, folder, "index_snapshots")).select("repo", "snapshot_no", "record_key", F.lower(F.hex("digest")).alias("digest"))
    last = table(spark, folder, "index_snapshots").where("complete").groupBy("repo").agg((F.max if newest else F.min)("snapshot_no").alias("snapshot_no"))
    return states.join(last, ["repo", "snapshot_no"], "left_semi").groupBy("repo", F.col("record_key").alias("path")).agg(F.max("digest").alias("digest"))


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, path, change) between two tables of (repo, path, digest): added, changed or deleted."""
    joined = old.withColumnRenamed("digest", "_old").join(new.withColumnRenamed("digest", "_new"), ["repo", "path"], "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed")
    return joined.select("repo", "path", change.alias("change")).where("change IS NOT NULL")


def files_to_process(current: DataFrame, changes: DataFrame) -> DataFrame:
    return current.join(changes.where("change <> 'deleted'"), ["repo", "path"], "left_semi")


def merge_symbols(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """``old`` without the symbols of changed and deleted files, and ``new`` of the changed and added ones."""
    gone = changes.where("change <> 'added'").select("repo", F.col("path").alias("file"))
    come = changes.where("change <> 'deleted'").select("repo", F.col("path").alias("file"))
    return old.join(gone, ["repo", "file"], "left_anti").unionByName(new.join(come, ["repo", "file"], "left_semi"))


def merge_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hashes of the files that still exist: the new digest where there is one."""
    return new.join(old.select("repo", "path", F.col("digest").alias("_old")), ["repo", "path"], "left").select("repo", "path", "digest", F.coalesce(F.col("_old") == F.col("digest"), F.lit(False)).alias("kept"))


def disambiguated(rows: DataFrame) -> DataFrame:
    """Adds ``own_id``: ids that several symbols of a file share get ~1, ~2 and so on in the order of symbol_seq."""
    base = rows.withColumn("base_id", symbol_id(F.col("file"), F.col("qualified_name"), F.col("kind")))
    same = Window.partitionBy("repo", "file", "base_id")
    number = F.row_number().over(same.orderBy("symbol_seq", "id"))
    return base.withColumn("n_same", F.count(F.lit(1)).over(same)).withColumn("own_id", F.when(F.col("n_same") > 1, F.concat("base_id", F.lit("~"), number.cast("string"))).otherwise(F.col("base_id")))


def lines(current: DataFrame) -> DataFrame:
    """(repo, path, file_seq, line, text) of every line; lines end at line feeds, carriage returns stay."""
    return current.select("repo", "path", "file_seq", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select("repo", "path", "file_seq", (F.col("pos") + 1).alias("line"), "text")


def line_offsets(rows: DataFrame) -> DataFrame:
    """Adds the byte offset of each line in its file."""
    before = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("byte_offset", F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)).cast("long"))
