"""Reachability over edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.storage import BROADCAST_ROWS, shuffled, stored


def dedupe_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def out_degree(edges: DataFrame) -> DataFrame:
    return dedupe_edges(edges.select("src", "dst")).groupBy("src").agg(F.count("*").alias("out_degree"))


#: A level pulls if its frontier has more than one in so many of the edges that still lead to something new.
SHARE = 14
#: Levels that are kept apart before they are written together.
LEVELS = 8


def _small(df: DataFrame) -> DataFrame:
    """A stored table, with a broadcast hint if it is proven small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_set, node): what each root set reaches over (src, dst), roots included.

    ``roots`` is (root_set, node), so several sets share one loop. A level whose frontier is small pushes: the frontier is
    broadcast over the edges, and neither side is shuffled. A large frontier pushes by a shuffle join, or, if its edges are more than
    one in `SHARE` of those left, pulls: edges that lead to nothing unvisited are dropped for good, and what is unvisited looks for a
    predecessor in the frontier. Levels are stored, and `LEVELS` of them written together. Repeated edges change nothing.
    """
    edges = stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL"))
    frontier = stored(roots.select("root_set", "node").where("node IS NOT NULL").distinct())
    levels, degrees, left, reached = [frontier], None, None, 0
    keys = ["root_set", "node"]
    while size := frontier.count():
        small, pull, reached = size <= BROADCAST_ROWS, False, reached + size
        if not small:
            degrees, left = degrees or stored(edges.groupBy("src").agg(F.count("*").alias("out_degree"))), left or edges.count()
            out = frontier.join(degrees, F.col("node") == F.col("src")).agg(F.sum("out_degree")).first()[0] or 0
            pull = out * SHARE > left
        visited = levels[0]
        for level in levels[1:]:
            visited = visited.union(level)
        if len(levels) >= LEVELS or pull:
            visited = stored(visited)
            levels = [visited]
        if pull:
            nodes, sets = edges.select(F.col("dst").alias("node")).distinct(), roots.select("root_set").distinct().count()
            full = visited.groupBy("node").agg(F.count("*").alias("sets")).where(F.col("sets") >= sets).select("node")
            edges = stored(edges.join(nodes.join(full, "node", "left_anti"), F.col("dst") == F.col("node"), "left_semi"))
            left = edges.count()
        source = F.broadcast(frontier) if small else frontier
        near = edges.join(source, F.col("node") == F.col("src")).select("root_set", F.col("dst").alias("node")).distinct()
        frontier = stored(near.join(visited if reached <= BROADCAST_ROWS else shuffled(visited), keys, "left_anti"))
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


#: Root sets that are written out beside each other.
ROOT_SETS = 500


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root_set, node) of the nodes that a root set doesn't reach; `ROOT_SETS` sets or so are taken at once, one batch after the other."""
    sets = stored(roots.select("root_set").where("root_set IS NOT NULL").distinct())
    found, nodes = reachable(edges, roots), stored(nodes.select("node").distinct())
    batches = max(1, -(-sets.count() // ROOT_SETS))
    batch = lambda c: F.pmod(F.xxhash64(c), F.lit(batches))
    out = None
    for i in range(batches):
        some = [r["root_set"] for r in sets.where(batch("root_set") == i).collect()]  # about ROOT_SETS of them
        asked = nodes.select(F.explode(F.array(*map(F.lit, some)) if some else F.array().cast("array<string>")).alias("root_set"), "node")
        part = asked.join(found.where(batch("root_set") == i), ["root_set", "node"], "left_anti")
        out = part if out is None else out.unionByName(part)
    return out


def only_reached_by(edges: DataFrame, roots: DataFrame, more: str, fewer: str) -> DataFrame:
    """(node) that the root set ``more`` reaches and ``fewer`` doesn't (used by tests only, say)."""
    found = reachable(edges, roots)
    return found.where(F.col("root_set") == more).select("node").join(found.where(F.col("root_set") == fewer).select("node"), "node", "left_anti")


def closure(pairs: DataFrame) -> DataFrame:
    """(name, ancestor): the transitive closure of (name, parent), safe against cycles; a name is no ancestor of itself
    unless it lies on one. Few pairs are broadcast to each level; levels are written together now and then, as in `reachable`."""
    edges = stored(pairs.select("name", "parent").where("parent IS NOT NULL").distinct())
    up = _small(edges).select(F.col("name").alias("ancestor"), "parent")
    frontier = edges.select("name", F.col("parent").alias("ancestor"))
    levels = [frontier]
    while frontier.count():
        found = levels[0]
        for level in levels[1:]:
            found = found.union(level)
        if len(levels) >= LEVELS:
            found = stored(found)
            levels = [found]
        near = frontier.join(up, "ancestor").select("name", F.col("parent").alias("ancestor")).distinct()
        frontier = stored(near.join(found, ["name", "ancestor"], "left_anti"))
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out


#: Trees are climbed so far without a look at cycles.
DEPTH = 24


def ancestors(tree: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of a parent-pointer tree (node, parent): depth 1 is the parent.

    On a cycle each ancestor counts once, at its least depth. A table that doesn't end within `DEPTH` levels has a cycle or is very
    deep; only it is climbed again with a look at what has been found.
    """
    tree = stored(tree.select("node", "parent").where("parent IS NOT NULL"))
    found = _climbed(tree, guarded=False)
    return _climbed(tree, guarded=True) if found is None else found


def _climbed(tree: DataFrame, guarded: bool) -> DataFrame | None:
    level = tree.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    up, found, depth = _small(tree).select(F.col("node").alias("ancestor"), "parent"), level, 1
    while level.limit(1).count():
        if depth >= DEPTH and not guarded:
            return None
        depth += 1
        above = level.join(up, "ancestor").select("node", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"))
        level = stored(above.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti") if guarded else above)
        found = found.union(level)
    return found


def effective_rank(levels: DataFrame, chain: DataFrame) -> DataFrame:
    """(node, rank): the least rank of a node (node, rank) and of all of its ancestors."""
    up = chain.join(levels.select(F.col("node").alias("ancestor"), F.col("rank").alias("above")), "ancestor").groupBy("node").agg(F.min("above").alias("above"))
    return levels.join(up, "node", "left").select("node", F.least("rank", F.coalesce("above", "rank")).alias("rank"))
