"""Parent-child links to full hierarchies (problem 3) by tree contraction.

Every round rakes all leaves and splices an independent set of nodes out of unary chains; both are recorded with the
parent they had. Reversing the records gives root, depth, path and descendants. A round without a leaf has met a core
that never ends: exactly the loops. Rounds are logarithmic in the depth, and every round is three shuffles of what is
still alive. A spliced node is sought by its only child, never a child by its parent, so a parent with a third of all
rows as children is met only where they are counted, which combines before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolith.sources.tables import current_symbols, materialise

#: Languages whose qualified names are joined by ``::``; all others use a dot.
COLON_LANGUAGES = ("rust", "rs", "go", "golang", "c", "c99", "cpp")


def node_key(*parts: Column) -> Column:
    """128-bit key of a node; null if any part is null."""
    present = parts[0].isNotNull()
    for part in parts[1:]:
        present = present & part.isNotNull()
    return F.when(present, F.unhex(F.md5(F.concat_ws("\u0000", *parts))))


@dataclass
class Contraction:
    """The recorded rounds in order, and the core (v) that never ends.

    A round has (v, p, d, seg, w, x, to, between, child, kind): ``w`` the nodes known to lie in v's subtree, v included,
    ``x`` those spliced out between v and ``to``, which gets them when v is raked, and ``between`` the same as the round
    began.
    """

    rounds: list[DataFrame]
    core: DataFrame


def contract(links: DataFrame) -> Contraction:
    """Contract the forest of ``links`` (v, p, d, seg): each v once, p its parent, d the steps between, seg the names.

    A p without a row of its own is a root. ``seg`` may be null throughout where no paths are wanted.
    """
    live = links.select("v", "p", "d", "seg", F.lit(1).cast("long").alias("w"), F.lit(0).cast("long").alias("x"))
    raked = None
    rounds: list[DataFrame] = []
    while True:
        below = live.select(F.col("p").alias("v"), F.col("v").alias("child"), F.lit(None).cast("long").alias("add"))
        if raked is not None:
            below = below.unionByName(raked.select(F.col("to").alias("v"), F.lit(None).cast("binary").alias("child"), (F.col("w") + F.col("x")).alias("add")))
        children = below.groupBy("v").agg(F.count("child").alias("n"), F.max("child").alias("child"), F.coalesce(F.sum("add"), F.lit(0)).alias("add"))
        nodes = live.join(children, "v", "left").withColumn("w", F.col("w") + F.coalesce("add", F.lit(0)))
        turn = F.lit(len(rounds))
        high = lambda c: F.xxhash64(c, turn)
        splice = (F.col("n") == 1) & (high(F.col("v")) > high(F.col("child"))) & (high(F.col("v")) > high(F.col("p")))
        kind = F.when(F.coalesce("n", F.lit(0)) == 0, "rake").when(splice, "splice").otherwise("live")
        marked = nodes.select("v", "p", "d", "seg", "w", "x", "child", kind.alias("kind"))
        gone = marked.where("kind = 'splice'").select(F.col("child").alias("v"), F.col("p").alias("up"), F.col("d").alias("up_d"), F.col("seg").alias("up_seg"), (F.col("w") + F.col("x")).alias("up_x"))
        moved = marked.join(gone, "v", "left")
        under = F.col("up").isNotNull()
        through = under & (F.col("kind") == "live")
        state = materialise(
            moved.select(
                "v",
                F.when(through, F.col("up")).otherwise(F.col("p")).alias("p"),
                F.when(through, F.col("d") + F.col("up_d")).otherwise(F.col("d")).alias("d"),
                F.when(through, F.concat("up_seg", "seg")).otherwise(F.col("seg")).alias("seg"),
                "w",
                (F.col("x") + F.coalesce("up_x", F.lit(0))).alias("x"),
                F.when(under, F.col("up")).otherwise(F.col("p")).alias("to"),
                F.col("x").alias("between"),
                "child",
                "kind",
            ),
            f"contract{len(rounds)}",
        )
        counts = {r["kind"]: r["count"] for r in state.groupBy("kind").count().collect()}
        if "rake" not in counts:
            return Contraction(rounds, state.select("v"))
        rounds.append(state)
        if "live" not in counts:
            return Contraction(rounds, state.where("kind = 'live'").select("v"))
        live, raked = state.where("kind = 'live'").select("v", "p", "d", "seg", "w", "x"), state.where("kind = 'rake'")


def sizes(done: Contraction) -> DataFrame:
    """(v, size): the nodes of v's subtree, v included, for every node that no loop holds; roots count without themselves."""
    known = None
    for state in reversed(done.rounds):
        found = state.where("kind = 'rake'").select("v", F.col("w").alias("size"))
        known = found if known is None else known.unionByName(found)
        own = state.where("kind = 'splice'").select("v", "w", "child")
        within = own.join(state.select(F.col("v").alias("child"), "between"), "child").join(known.select(F.col("v").alias("child"), F.col("size").alias("_below")), "child")
        known = materialise(known.unionByName(within.select("v", (F.col("w") + F.col("between") + F.col("_below")).alias("size"))), "sizes")
    under = None
    for state in done.rounds:
        part = state.where("kind = 'rake'").groupBy(F.col("to").alias("v")).agg(F.sum(F.col("w") + F.col("x")).alias("size"))
        under = part if under is None else under.unionByName(part)
    if known is None or under is None:
        return done.core.select("v", F.lit(0).cast("long").alias("size")).limit(0)
    roots = under.groupBy("v").agg(F.sum("size").alias("size")).join(known.select("v"), "v", "left_anti").join(done.core, "v", "left_anti")
    return known.unionByName(roots)


def loops(done: Contraction) -> DataFrame:
    """(v, place) of the nodes whose ancestors never end: ``on`` a loop, or ``below`` one."""
    known = done.core.select("v", F.lit("on").alias("place"))
    for state in reversed(done.rounds):
        for kind in ("splice", "rake"):
            found = state.where(F.col("kind") == kind).select("v", "p", "child").join(known.select(F.col("v").alias("p")), "p", "left_semi")
            on = known.where("place = 'on'").select(F.col("v").alias("child"), F.lit(True).alias("_on"))
            found = found.join(on, "child", "left") if kind == "splice" else found.withColumn("_on", F.lit(None).cast("boolean"))
            known = known.unionByName(found.select("v", F.when(F.col("_on"), "on").otherwise("below").alias("place")))
        known = materialise(known, "loops")
    return known


def lineages(done: Contraction) -> DataFrame:
    """(v, root, depth, path) of every node with a parent whose ancestors end; ``path`` runs from below the root to v."""
    known = None
    for state in reversed(done.rounds):
        for kind in ("splice", "rake"):
            step = state.where(F.col("kind") == kind).select("v", "p", "d", "seg")
            if known is None:
                found = step.select("v", F.col("p").alias("root"), F.col("d").alias("depth"), F.col("seg").alias("path"))
            else:
                over = known.select(F.col("v").alias("p"), "root", F.col("depth").alias("_d"), F.col("path").alias("_path"))
                found = step.join(over, "p", "left").select(
                    "v",
                    F.coalesce("root", "p").alias("root"),
                    (F.col("d") + F.coalesce("_d", F.lit(0))).alias("depth"),
                    F.coalesce(F.concat("_path", "seg"), F.col("seg")).alias("path"),
                )
            known = found if known is None else known.unionByName(found)
        known = materialise(known, "lineages")
    return known


def parent_links(nodes: DataFrame, scope: list[str], node: str, parent: str, segment: Column | None = None) -> DataFrame:
    """The links (v, p, d, seg) of ``nodes`` to the parents that exist in the same scope.

    Rows with a null scope or id are no nodes; a null parent, or one that no row has as its id, makes a root.
    """
    keyed = nodes.select(
        node_key(*[F.col(c) for c in scope], F.col(node)).alias("v"),
        node_key(*[F.col(c) for c in scope], F.col(parent)).alias("p"),
        (F.array(segment) if segment is not None else F.lit(None).cast("array<string>")).alias("seg"),
    ).where("v IS NOT NULL")
    existing = keyed.select(F.col("v").alias("p"))
    return keyed.where("p IS NOT NULL").join(existing, "p", "left_semi").select("v", "p", F.lit(1).cast("long").alias("d"), "seg")


def hierarchy(nodes: DataFrame, scope: list[str], node: str, parent: str, label: str | None = None, count: bool = False) -> DataFrame:
    """For each node (unique per scope and ``node``): scope, node, root, depth, path, place, and with ``count`` its descendants.

    ``path`` runs from the root to the node by their ids, or by their ``label`` (empty where null). ``place`` is
    ``root``, ``inner`` (has a parent, ends at a root), ``on`` or ``below`` a loop; in loops root, depth, path and
    descendants are null. Columns of ``nodes`` beyond the named ones are ignored; an empty table gives an empty result.
    """
    cols = [F.col(c) for c in scope]
    labelled = F.col(node) if label is None else F.coalesce(F.col(label), F.lit(""))
    nodes = nodes.select(*scope, node, parent, labelled.alias("_label"))
    done = contract(materialise(parent_links(nodes, scope, node, parent, F.col("_label")), "links"))
    named = nodes.select(node_key(*cols, F.col(node)).alias("v"), *scope, node, "_label").where("v IS NOT NULL")
    placed = named.join(lineages_and_loops(done), "v", "left")
    if count:
        placed = placed.join(sizes(done).withColumnRenamed("size", "_size"), "v", "left")
    looped = F.col("_place").isNotNull()
    full = F.when(~looped, F.coalesce(F.concat(F.array("_root_label"), F.col("_path")), F.array("_label")))
    roots = named.select(F.col("v").alias("_root"), F.col(node).alias("_root_id"), F.col("_label").alias("_root_label"))
    out = placed.join(roots, "_root", "left")
    below = F.when(~looped, F.when(F.col("_depth").isNull(), F.coalesce("_size", F.lit(0))).otherwise(F.col("_size") - 1)) if count else None
    return out.select(
        *scope,
        node,
        F.when(~looped, F.coalesce("_root_id", node)).alias("root"),
        F.when(~looped, F.coalesce("_depth", F.lit(0)).cast("long")).alias("depth"),
        full.alias("path"),
        F.coalesce("_place", F.when(F.col("_depth").isNull(), "root").otherwise("inner")).alias("place"),
        *([below.alias("descendants")] if count else []),
    )


def lineages_and_loops(done: Contraction) -> DataFrame:
    """Both results keyed by v; what leads into a loop has its place only."""
    looped = loops(done)
    none = F.lit(None)
    ended = lineages(done).join(looped.select("v"), "v", "left_anti") if done.rounds else None
    marks = looped.select("v", none.cast("binary").alias("_root"), none.cast("long").alias("_depth"), none.cast("array<string>").alias("_path"), F.col("place").alias("_place"))
    if ended is None:
        return marks
    return marks.unionByName(ended.select("v", F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("path").alias("_path"), none.cast("string").alias("_place")))


def descendants(placed: DataFrame, scope: list[str], node: str) -> DataFrame:
    """(scope, node, descendant, distance) from the paths of :func:`hierarchy`: each node with every node below it."""
    up = placed.where("depth > 0").select(*scope, F.col(node).alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("_at", node))
    return up.select(*scope, node, "descendant", (F.col("depth") - F.col("_at")).alias("distance"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_symbols(spark, folder, ["parent"]).where("repo IS NOT NULL AND id IS NOT NULL")
    symbols = materialise(rows.select("repo", "id", "parent"), "symbols")
    place = loops(contract(materialise(parent_links(symbols, ["repo"], "id", "parent"), "links")))
    return symbols.withColumn("v", node_key(F.col("repo"), F.col("id"))).join(place, "v").select("repo", "id", "place")


def p3_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Each symbol with its path of names, comparable with ``qualified_name``, its depth, root and number of descendants."""
    columns = ["parent", "name", "language", "qualified_name"]
    symbols = materialise(current_symbols(spark, folder, columns).where("repo IS NOT NULL AND id IS NOT NULL"), "symbols")
    placed = hierarchy(symbols, ["repo"], "id", "parent", "name", count=True)
    separator = F.when(F.lower("language").isin(*COLON_LANGUAGES), "::").otherwise(".")
    joined = placed.join(symbols.select("repo", "id", separator.alias("_sep"), "qualified_name"), ["repo", "id"])
    path = F.replace(F.array_join("path", "\u0001"), F.lit("\u0001"), F.col("_sep"))
    return joined.select("repo", "id", "root", "depth", "place", path.alias("path"), "qualified_name", "descendants")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every (symbol, symbol below it) pair with their distance."""
    symbols = materialise(current_symbols(spark, folder, ["parent"]).where("repo IS NOT NULL AND id IS NOT NULL"), "symbols")
    return descendants(materialise(hierarchy(symbols, ["repo"], "id", "parent"), "placed"), ["repo"], "id")
