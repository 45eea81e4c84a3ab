"""Connected components by joins: contraction to least neighbours, stored between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.llm.common import BROADCAST_ROWS
from taproot.llm.common import Counted as Stored

#: Labels that are broadcast, at most; a round's joins may hold four such tables at once.
FEW = BROADCAST_ROWS // 4


def _up(labels: DataFrame, of: DataFrame, hint: str | None) -> DataFrame:
    """``labels`` with each label replaced by its own label in ``of``, where it has one."""
    return labels.join(_hinted(of.select(F.col("node").alias("label"), F.col("label").alias("up")), hint), "label", "left").select("node", F.coalesce("up", "label").alias("label"))


def _hinted(df: DataFrame, hint: str | None) -> DataFrame:
    return df.hint(hint) if hint else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Null ends and loops give nothing. Each round points every node at its least neighbour (a minimum by node, no
    join), follows the pointers twice, and keeps the edges between what is left, which shrink fast. A node with very
    many edges is a skewed join side, which adaptive execution splits, and never a list in one task. A round that is
    counted to have few labels broadcasts them, which spares most of its shuffles and the table between its two steps.
    Tables are counted as they are written, and read no more often than need be: each query, and each scan, stage and
    broadcast in it, costs the driver memory.
    """
    e = Stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found: DataFrame | None = None
    while True:
        own = e.read()
        both = own.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        parent = Stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
        hint = "broadcast" if parent.rows <= FEW else None
        first, between = parent.read(), None
        if hint:
            twice = _up(_up(_up(first, first, hint), first, hint), first, hint)  # one broadcast serves all
        else:
            between = Stored(_up(first, first, hint))
            once = between.read()
            twice = _up(once, once, hint)
        labels = Stored(twice).read()
        found = labels if found is None else _up(found, labels, hint)
        at = lambda end, label: _hinted(labels.select(F.col("node").alias(end), F.col("label").alias(label)), hint)  # noqa: B023, E731
        moved = own.join(at("a", "la"), "a").join(at("b", "lb"), "b").select("la", "lb")
        ends = labels.select(F.col("label").alias("l"))  # labels are nodes themselves
        rest = (ends if hint else ends.distinct()).join(at("l", "lb"), "l").select(F.col("l").alias("la"), "lb")
        left = moved.union(rest).where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        following = Stored(left)
        for t in (e, parent, between):
            if t:
                t.drop()
        e = following
        if not e.rows:
            return found.withColumnRenamed("label", "component")
