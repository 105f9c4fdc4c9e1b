"""Filling fixed-capacity containers (problem 7): hierarchical multi-length packing.

Documents go to the tier of the smallest window that holds them. Tiers are packed from the longest window down, the
gaps of long windows filled from the shorter tiers. All of this is decided on the histogram of sizes, which is as long
as the longest window and no longer, whatever the number of documents; the plan says which ranks of a size go into
which containers, and a join puts the documents there.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolith.llm.tokens import token_count
from symbolith.sources.tables import materialise, table

#: Containers in a step group.
GROUP = 8
#: At most so many documents of one size are ranked by one task.
RANKED_TOGETHER = 50_000
PLAN = "window_name string, capacity int, size int, rank_from long, rank_to long, each int, first_container long, containers long, fill int, groups long"


class Bins:
    """Containers under way: equal ones are kept once, with their number."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.free: list[int] = []
        self.held: dict[int, list[list]] = {}

    def put(self, left: int, content: tuple, number: int) -> None:
        if left not in self.held:
            self.held[left] = []
            insort(self.free, left)
        self.held[left].append([content, number])

    def take(self, size: int) -> tuple[int, tuple, int] | None:
        """The containers with the least room that still holds ``size``."""
        at = bisect_left(self.free, size)
        if at == len(self.free):
            return None
        left = self.free[at]
        content, number = self.held[left].pop()
        if not self.held[left]:
            del self.held[left]
            del self.free[at]
        return left, content, number

    def fit(self, size: int, count: int, opening: bool) -> int:
        """Best fit for ``count`` items of ``size``; returns how many found no place."""
        while count:
            found = self.take(size)
            if found is None:
                if not opening:
                    return count
                found = (self.capacity, (), max(1, count // (self.capacity // size)))
            left, content, number = found
            each = min(left // size, max(1, count // number))
            full = min(number, count // each)
            if full < number:
                if content or left < self.capacity:
                    self.put(left, content, number - full)
            if full:
                self.put(left - each * size, (*content, (size, each)), full)
                count -= each * full
        return 0


def plan(histogram: dict[int, int], windows: list[tuple[str, int]]) -> list[tuple]:
    """Rows of PLAN for the counts of sizes and the windows (name, capacity); sizes fit the longest window."""
    windows = sorted(windows, key=lambda w: (w[1], w[0]))
    left = dict(histogram)
    ranks = dict.fromkeys(histogram, 0)
    rows: list[tuple] = []
    for tier in range(len(windows) - 1, -1, -1):
        name, capacity = windows[tier]
        below = windows[tier - 1][1] if tier else 0
        bins = Bins(capacity)
        for size in sorted((s for s, n in left.items() if n and s <= capacity), reverse=True):
            left[size] = bins.fit(size, left[size], opening=size > below)
        packed = sorted(((capacity - free, content, number) for free, held in bins.held.items() for content, number in held), key=lambda x: (-x[0], x[1]))
        total, first = sum(n for _, _, n in packed), 0
        groups = max(1, -(-total // GROUP))
        for fill, content, number in packed:
            for size, each in content:
                rows.append((name, capacity, size, ranks[size], ranks[size] + each * number, each, first, number, fill, groups))
                ranks[size] += each * number
            first += number
    return rows


def pieces(documents: DataFrame, longest: int) -> DataFrame:
    """(doc_id, piece, tokens, size): documents beyond the longest window in pieces, all but the last of its length.

    Null texts are left out; an empty text takes the room of one token.
    """
    sized = documents.select("doc_id", token_count("text").alias("whole")).where("whole IS NOT NULL AND doc_id IS NOT NULL")
    number = F.greatest(F.lit(1), F.ceil(F.col("whole") / longest).cast("int"))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), number - 1)))
    tokens = F.least(F.lit(longest), F.col("whole") - F.col("piece") * longest).cast("int")
    return cut.select("doc_id", "piece", tokens.alias("tokens"), F.greatest(F.lit(1), tokens).alias("size"))


def ranked(items: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds the rank of each item among those of its size; sizes that many items have are ranked in parts."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / RANKED_TOGETHER).cast("int"))
    spread = items.join(F.broadcast(counts), "size").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), parts))
    offsets = spread.groupBy("size", "part").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = offsets.select("size", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("size", "part").orderBy("doc_id", "piece")
    return spread.withColumn("within", F.row_number().over(own) - 1).join(starts, ["size", "part"]).withColumn("rank", F.col("start") + F.col("within"))


def packed(documents: DataFrame, windows: list[tuple[str, int]]) -> DataFrame:
    """(window_name, capacity, container, step_group, fill, doc_id, piece, tokens) of every document.

    Step groups hold eight containers of a window each and are dealt to and fro in the order of fill, so that their
    loads are alike.
    """
    if not windows:
        raise ValueError("no windows")
    spark = documents.sparkSession
    items = materialise(pieces(documents, max(c for _, c in windows)), "pieces")
    counts = materialise(items.groupBy("size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # at most as many rows as the longest window has tokens
    rows = plan({r["size"]: r["n"] for r in counts.collect()}, windows)
    places = F.broadcast(spark.createDataFrame(rows, PLAN))
    placed = ranked(items, counts).join(places, ["size"]).where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("each"))
    return placed.withColumn("container", container).select("window_name", "capacity", "container", step_group().alias("step_group"), "fill", "doc_id", "piece", "tokens")


def step_group():
    """Containers in order of fill are dealt to the groups and back again."""
    turn, place = F.floor(F.col("container") / F.col("groups")), F.pmod(F.col("container"), F.col("groups"))
    return F.when(F.pmod(turn, F.lit(2)) == 0, place).otherwise(F.col("groups") - 1 - place)


def containers(placed: DataFrame) -> DataFrame:
    """One row per container with its documents (at most as many as it has tokens), tokens and share filled."""
    held = placed.groupBy("window_name", "capacity", "container", "step_group").agg(
        F.sum("tokens").cast("long").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.array_sort(F.collect_list(F.struct("doc_id", "piece", "tokens"))).alias("contents")
    )
    return held.withColumn("filled", F.round(F.col("tokens") / F.col("capacity"), 6))


def windows_of(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    rows = table(spark, folder, "context_windows").where("capacity_tokens > 0").select("window_name", "capacity_tokens").distinct().orderBy("capacity_tokens", "window_name").collect()
    return [(r["window_name"], r["capacity_tokens"]) for r in rows]


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document once, in containers of all windows."""
    return containers(packed(table(spark, folder, "documents").select("doc_id", "text"), windows_of(spark, folder)))


def p7_each_window(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed anew for each window by itself."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    out = None
    for window in windows_of(spark, folder):
        one = containers(packed(documents, [window]))
        out = one if out is None else out.unionByName(one)
    return out


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and share filled per window, and the spread of step group loads."""
    held = p7_packed(spark, folder)
    groups = held.groupBy("window_name", "capacity", "step_group").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    return groups.groupBy("window_name", "capacity").agg(
        F.sum("n").alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.sum("n") * F.col("capacity")), 6).alias("filled"),
        F.min("tokens").alias("least_group"), F.max("tokens").alias("most_group"),
    )


def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that was packed: how often each of its pieces lies in a container, and whether all those containers hold at most their capacity."""
    windows = windows_of(spark, folder)
    placed = materialise(packed(table(spark, folder, "documents").select("doc_id", "text"), windows), "placed")
    over = placed.groupBy("window_name", "container").agg((F.sum("tokens") <= F.max("capacity")).alias("fits"))
    held = placed.join(over, ["window_name", "container"])
    times = held.groupBy("doc_id", "piece").agg(F.count(F.lit(1)).alias("times"), F.min("fits").alias("fits"))
    return times.groupBy("doc_id").agg(F.max("times").alias("times"), F.min("fits").alias("fits"))
