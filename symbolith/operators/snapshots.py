"""What changed between full snapshots (problem 6): gaps and islands over key and row hash.

Every key's states are laid along the snapshots of its repo. A run of consecutive snapshots with one hash is an island,
that is, a validity interval; its start, its end and its adjacency to the next island are the change events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolith.functions.text import plain_path
from symbolith.sources.tables import materialise, small_enough, table

#: Hot repos are spread over this many join keys when their states meet their snapshot numbers.
SALTS = 16


def plain_digest(digest: Column) -> Column:
    """The digest's bytes, without the name of the algorithm before them; what isn't hexadecimal counts as written."""
    bare = F.regexp_replace(F.trim(digest), r"^(?i)sha-?256[:=\-]", "")
    return F.coalesce(F.unhex(bare), F.encode(F.lower(bare), "UTF-8"))


def file_states(snapshots: DataFrame) -> DataFrame:
    """(repo, snapshot_no, record_key, digest) of the files in complete deliveries.

    Per (repo, snapshot_no, shard) the complete delivery that came last counts; ties fall to the larger delivery_id.
    Rows with a null repo, snapshot number or map, and null paths, have no state; a null shard is a shard of its own.
    A path written in two notations in one map counts once, with the larger digest.
    """
    kept = (
        snapshots.where("complete AND repo IS NOT NULL AND snapshot_no IS NOT NULL")
        .groupBy("repo", "snapshot_no", "shard")
        .agg(F.max_by("file_hashes", F.struct("delivered_at", "delivery_id")).alias("hashes"), F.max("delivered_at").alias("delivered_at"))
    )
    return kept.select("repo", "snapshot_no", "delivered_at", F.explode("hashes").alias("path", "digest")).select(
        "repo", "snapshot_no", plain_path(F.col("path")).alias("record_key"), plain_digest(F.col("digest")).alias("digest"), "delivered_at"
    )


def symbol_states(snapshots: DataFrame) -> DataFrame:
    """(repo, snapshot_no, record_key, digest, delivered_at) of the symbols; rows without repo, number or id are left out."""
    return snapshots.where("repo IS NOT NULL AND snapshot_no IS NOT NULL AND id IS NOT NULL").select(
        "repo", "snapshot_no", F.col("id").alias("record_key"), plain_digest(F.col("content_hash")).alias("digest"), "delivered_at"
    )


def snapshot_numbers(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, snapshot_no, ordinal, next_no, last): the snapshots of each repo that either table has, in order."""
    numbers = files.select("repo", "snapshot_no").union(symbols.select("repo", "snapshot_no")).dropna().distinct()
    w = Window.partitionBy("repo").orderBy("snapshot_no")
    return numbers.select("repo", "snapshot_no", F.row_number().over(w).alias("ordinal"), F.lead("snapshot_no").over(w).alias("next_no"))


def validity_intervals(states: DataFrame, numbers: DataFrame) -> DataFrame:
    """One row per island: (record_type, repo, record_key, digest, first/last ordinal and number, next_no, order flags).

    ``states`` has (record_type, repo, snapshot_no, record_key, digest, delivered_at). One shuffle by key serves the
    choice of the last delivery, the islands and their neighbours.
    """
    key = ["record_type", "repo", "record_key"]
    numbers = materialise(numbers, "numbers")
    small = small_enough(numbers)
    if small is not None:
        placed = states.join(small, ["repo", "snapshot_no"])
    else:
        salted = numbers.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = states.withColumn("_salt", F.pmod(F.xxhash64("record_key"), F.lit(SALTS)).cast("int")).join(salted, ["repo", "snapshot_no", "_salt"])
    once = (
        placed.repartition(*key)
        .groupBy(*key, "ordinal", "snapshot_no", "next_no")
        .agg(F.max_by(F.coalesce("digest", F.lit(b"")), F.struct("delivered_at", "digest")).alias("digest"))
    )
    w = Window.partitionBy(*key).orderBy("ordinal")
    starts = once.withColumn("_begins", F.coalesce((F.lag("ordinal").over(w) != F.col("ordinal") - 1) | (F.lag("digest").over(w) != F.col("digest")), F.lit(True)))
    islands = starts.withColumn("island", F.sum(F.col("_begins").cast("int")).over(w))
    return islands.groupBy(*key, "island").agg(
        F.first("digest").alias("digest"),
        F.min("ordinal").alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"),
        F.min("snapshot_no").alias("valid_from"),
        F.max("snapshot_no").alias("valid_to"),
        F.max_by("next_no", "ordinal").alias("next_no"),
    )


def change_events(intervals: DataFrame) -> DataFrame:
    """(repo, snapshot_no, record_type, record_key, change_type) from the ends and adjacencies of validity intervals.

    An island that begins right after another of its key is a change, any other beginning an addition (the first
    snapshot has none), an end that no island follows at once a removal at the next snapshot.
    """
    w = Window.partitionBy("record_type", "repo", "record_key").orderBy("first_ordinal")
    joined = F.coalesce(F.lag("last_ordinal").over(w) == F.col("first_ordinal") - 1, F.lit(False))
    followed = F.coalesce(F.lead("first_ordinal").over(w) == F.col("last_ordinal") + 1, F.lit(False))
    begin = F.when(F.col("first_ordinal") > 1, F.struct(F.col("valid_from").alias("snapshot_no"), F.when(joined, "changed").otherwise("added").alias("change_type")))
    end = F.when(F.col("next_no").isNotNull() & ~followed, F.struct(F.col("next_no").alias("snapshot_no"), F.lit("removed").alias("change_type")))
    ends = intervals.select("repo", "record_type", "record_key", F.array_compact(F.array(begin, end)).alias("ends"))
    events = ends.select("repo", "record_type", "record_key", F.explode("ends").alias("e"))
    return events.select("repo", "e.snapshot_no", "record_type", "record_key", "e.change_type")


def snapshot_intervals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    states = (
        file_states(files).withColumn("record_type", F.lit("file")).unionByName(symbol_states(symbols).withColumn("record_type", F.lit("symbol")))
    )
    return validity_intervals(states, snapshot_numbers(files, symbols))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return change_events(snapshot_intervals(table(spark, folder, "index_snapshots"), table(spark, folder, "symbol_snapshots")))


def p6_intervals(spark: SparkSession, folder: str) -> DataFrame:
    intervals = snapshot_intervals(table(spark, folder, "index_snapshots"), table(spark, folder, "symbol_snapshots"))
    return intervals.select("repo", "record_type", "record_key", F.lower(F.hex("digest")).alias("digest"), "valid_from", "valid_to")
