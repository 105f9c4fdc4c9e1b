"""Index upkeep as streams: changed files by micro-batch, bursts of events by session, savings as running sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from symbolith.engine import Engine
from symbolith.functions import security
from symbolith.functions.text import language
from symbolith.sources.tables import ship

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def watch_files(engine: Engine, repo: str | None, folder: str, checkpoint: str, schema: str | StructType = "repo string, path string, content string", excludes: list[str] | None = None, pattern: str | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
    """Index file rows that arrive as Parquet below ``folder``, of one repo or of all; a path's later row replaces its earlier one.

    Rows may carry ``at``, the time of the change, and ``deleted``; without a time the later file counts, and in it the
    later row is unknown, so the larger one is taken. Every micro-batch changes only the paths that it names, through the
    same change detection as a batch run, so that one that is run again after a failure changes nothing. Files in
    folders of ``excludes`` and without a language aren't watched. ``prepare`` brings rows of another schema into this one.
    """
    ship(engine.spark)
    out = list(excludes if excludes is not None else security.SKIPPED_ENTRIES)

    def upsert(batch: DataFrame, number: int) -> None:
        rows = batch.where(F.col("repo").isNotNull() & F.col("path").isNotNull())
        if repo is not None:
            rows = rows.where(F.col("repo") == repo)
        folder_ = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
        hidden = F.exists(F.split(folder_, "/"), lambda x: x.isin(*out) | (x.startswith(".") & (x != ".github")))
        rows = rows.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~hidden)
        gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        at = F.col("at") if "at" in batch.columns else F.col("_come")
        last = rows.withColumn("_gone", gone | F.col("content").isNull()).groupBy("repo", "path").agg(F.max_by(F.struct("content", "language", "_gone"), F.struct(at, "_gone", "content")).alias("r"))
        last = last.select("repo", "path", "r.*")
        engine.apply_changes(last.where("NOT _gone"), last.where("_gone"))

    reader = engine.spark.readStream.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    raw = reader.parquet(folder).select("*", F.col("_metadata.file_modification_time").alias("_come"))
    made = prepare(raw)
    rows = made if "at" in made.columns or "_come" in made.columns else made.withColumn("at", F.lit(None).cast("timestamp"))
    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bursts(events: DataFrame, gap: str = "500 milliseconds", late: str = "1 minute") -> DataFrame:
    """Bursts of events per user, closed by a quiet ``gap``: the event-time form of a debounce."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", "w.start", "w.end", "events")


def running_savings(events: DataFrame) -> DataFrame:
    """Tokens saved so far per user."""
    return events.where("value > 0").groupBy("user_id").agg(F.sum(F.floor(F.col("value") * 4).cast("long")).alias("tokens_saved"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(folder)
