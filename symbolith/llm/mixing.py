"""Mixing sources to target weights (problem 8): a low-discrepancy source schedule.

Golden-ratio points mapped through the cumulative weights give every slot its source; slots are ranked per source and
meet the source's documents, shuffled and laid into blocks of equal tokens. Ranks and running sums are made in two
levels, so that a source with a third of all documents is no hot group.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolith.llm.tokens import token_count
from symbolith.sources.tables import materialise, table

#: Tokens of a block: a training sequence, less where that would make fewer slots than SLOTS.
BLOCK, LEAST_BLOCK, SLOTS = 4096, 16, 50_000
#: Slots, and documents, that are ranked together.
TOGETHER = 50_000
GOLDEN = (math.sqrt(5) - 1) / 2


def plain_source(column: str):
    return F.lower(F.trim(F.col(column)))


def sized(documents: DataFrame, sources: list[str]) -> DataFrame:
    """(doc_id, source, tokens) of the documents of the sources; null or empty texts have nothing to give."""
    known = documents.select("doc_id", plain_source("source").alias("source"), "text").where(F.col("source").isin(sources) & F.col("doc_id").isNotNull())
    return known.select("doc_id", "source", token_count("text").alias("tokens")).where("tokens > 0")


def laid_out(items: DataFrame, totals: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds ``before``: the tokens ahead of each document in its source's shuffled order."""
    spark = items.sparkSession
    parts = spark.createDataFrame([(s, max(1, -(-n // TOGETHER))) for s, (_, n) in totals.items()], "source string, parts int")
    mixed = items.join(F.broadcast(parts), "source").withColumn("shuffle", F.xxhash64("doc_id", F.lit("mix"))).withColumn("part", F.pmod("shuffle", "parts"))
    sums = mixed.groupBy("source", "part").agg(F.sum("tokens").alias("held"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("start"))
    own = Window.partitionBy("source", "part").orderBy("shuffle", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = mixed.withColumn("within", F.coalesce(F.sum("tokens").over(own), F.lit(0)))
    return within.join(starts, ["source", "part"]).select("doc_id", "source", "tokens", (F.col("start") + F.col("within")).alias("before"))


def schedule(spark: SparkSession, slots: int, weights: list[tuple[str, float]]) -> DataFrame:
    """(slot, source, turn): golden-ratio points through the cumulative weights; ``turn`` ranks the slots of a source."""
    point = F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0))
    source, reached = None, 0.0
    for name, weight in weights[:-1]:
        reached += weight
        source = F.when(point < reached, name) if source is None else source.when(point < reached, name)
    source = F.lit(weights[-1][0]) if source is None else source.otherwise(weights[-1][0])
    drawn = spark.range(slots).select(F.col("id").alias("slot"), source.alias("source"), F.floor(F.col("id") / TOGETHER).alias("part"))
    counts = drawn.groupBy("source", "part").agg(F.count(F.lit(1)).alias("held"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("start"))
    own = Window.partitionBy("source", "part").orderBy("slot")
    return drawn.withColumn("within", F.row_number().over(own) - 1).join(starts, ["source", "part"]).select("slot", "source", (F.col("start") + F.col("within")).alias("turn"))


def mixed(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(slot, source, doc_id, repeat, tokens): the drawn documents in the order of the schedule.

    The total is the largest at which every source has its share within its repeats. Sources without a target, and
    targets without documents, draw nothing; the shares of the others are scaled to 1. ``repeat`` counts from 1.
    """
    spark = documents.sparkSession
    goals: dict[str, list] = {}
    # one row per source
    for row in targets.select(plain_source("source").alias("source"), "target_share", "max_repeats").where("target_share > 0 AND max_repeats > 0").orderBy("source").collect():
        goals.setdefault(row["source"], [row["target_share"], row["max_repeats"]])
    items = materialise(sized(documents, sorted(goals)), "sized")
    totals = {r["source"]: (r["tokens"], r["n"]) for r in items.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    goals = {s: g for s, g in goals.items() if s in totals}
    empty = spark.createDataFrame([], "slot long, source string, doc_id long, repeat int, tokens long")
    if not goals:
        return empty
    whole = sum(share for share, _ in goals.values())
    total = min(totals[s][0] * repeats / (share / whole) for s, (share, repeats) in goals.items())
    block = min(BLOCK, max(LEAST_BLOCK, total / SLOTS))
    blocks = {s: max(1, round(totals[s][0] / block)) for s in goals}
    length = {s: totals[s][0] / blocks[s] for s in goals}
    pace = {s: share / whole / length[s] for s, (share, _) in goals.items()}
    slots = int(total * sum(pace.values()))
    order = sorted(goals)
    plan = schedule(spark, slots, [(s, pace[s] / sum(pace.values())) for s in order])
    facts = spark.createDataFrame([(s, blocks[s], length[s], goals[s][1]) for s in order], "source string, blocks long, length double, max_repeats int")
    facts = F.broadcast(facts)
    turns = plan.join(facts, "source").select(
        "slot", "source", F.pmod("turn", "blocks").alias("block"), (F.floor(F.col("turn") / F.col("blocks")) + 1).cast("int").alias("repeat"), "max_repeats"
    ).where("repeat <= max_repeats").drop("max_repeats")
    held = laid_out(items, totals).join(facts, "source").withColumn("block", F.least(F.floor(F.col("before") / F.col("length")), F.col("blocks") - 1))
    return turns.join(held.select("source", "block", "doc_id", "tokens"), ["source", "block"]).select("slot", "source", "doc_id", "repeat", "tokens")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, draws, most_repeats, max_repeats) per target."""
    by = drawn.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("draws"), F.max("repeat").alias("most_repeats"))
    # one number
    every = by.agg(F.sum("tokens").alias("n")).first()["n"] or 1
    goals = targets.select(plain_source("source").alias("source"), "target_share", "max_repeats")
    joined = goals.join(by, "source", "left")
    return joined.select(
        "source", "target_share", F.round(F.coalesce("tokens", F.lit(0)) / F.lit(every), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("draws", F.lit(0)).alias("draws"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats",
    )


def p8_drawn(spark: SparkSession, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return shares(materialise(p8_drawn(spark, folder), "drawn"), targets)


def p8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Each source that a target names and documents have: whether no document is drawn more often than allowed, and none twice in one turn."""
    drawn = materialise(p8_drawn(spark, folder), "drawn")
    twice = drawn.groupBy("source", "doc_id", "repeat").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("most"), F.max("repeat").alias("repeats"))
    limits = table(spark, folder, "mix_targets").groupBy(plain_source("source").alias("source")).agg(F.min("max_repeats").alias("allowed"))
    return twice.join(limits, "source").select("source", (F.col("repeats") <= F.col("allowed")).alias("within"), (F.col("most") == 1).alias("once_a_turn"))
