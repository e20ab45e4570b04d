"""Recursive walks over forests: up to the root, and down to all descendants.

Walks up use jump pointers: after round k every start has its ancestors up to 2^(k+1) - 1 away, so a chain of length n
takes log2(n) joins, each one keyed and shuffled. Walks down go level by level, which suits broad trees. Rounds are
tables in the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CHAIN_CAP
from ..session import discard, materialise


class ChainDepthExceeded(ValueError):
    """A chain is longer than the cap, or has a cycle."""


def _longest(links: DataFrame, cap: int | None) -> int:
    """The cap; without one, the number of links, which no chain without a cycle exceeds."""
    return links.where("parent IS NOT NULL").count() + 1 if cap is None else cap


def ascend(links: DataFrame, starts: DataFrame, cap: int | None = CHAIN_CAP) -> DataFrame:
    """links: id, parent (null at a root). starts: start (an id). Returns start, id, distance, start itself first.

    cap: of links; None for walks of any length, on which a cycle is an error all the same. A parent without a row of its own is on the walk too (its own parent is unknown), so that callers can tell it.
    """
    cap = _longest(links, cap)
    jump = links.where("parent IS NOT NULL").select("id", F.col("parent").alias("to"))
    walk = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("distance")).distinct()
    step = 1
    while True:
        before = jump
        if step > 1:
            jump = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to")
        jump = materialise(jump, "jump")
        discard(before)
        if jump.isEmpty():
            return walk
        if step >= cap:
            # nothing may be further away than the cap
            if not walk.join(jump, "id", "left_semi").isEmpty():
                raise ChainDepthExceeded(f"more than {cap} links")
            return walk
        shorter = walk
        walk = walk.unionByName(walk.join(jump, "id").select("start", F.col("to").alias("id"), (F.col("distance") + step).alias("distance")))
        walk = materialise(walk, "walk")
        discard(shorter)
        step *= 2


def descend(links: DataFrame, starts: DataFrame, keys: list[str], most_levels: int | None = None) -> DataFrame:
    """links: keys and parent, keyed within the first key. starts: the same keys. Returns keys and root (the start's last
    key) and level of every descendant, the starts at level 0. keys: scope column and id column. Trees may have any depth,
    at a round for each level; a cycle is an error."""
    most_levels = _longest(links, most_levels)
    scope, node = keys
    level = starts.select(scope, F.col(node), F.col(node).alias("root"), F.lit(0).alias("level")).distinct()
    level = materialise(level, "level")
    found, n = level, 0
    children = links.where("parent IS NOT NULL").select(scope, F.col("parent").alias("_parent"), F.col(node).alias("_child"))
    while True:
        n += 1
        if n > most_levels:
            raise ChainDepthExceeded(f"more than {most_levels} levels")
        level = level.withColumnRenamed(node, "_parent").join(children, [scope, "_parent"]).select(scope, F.col("_child").alias(node), "root", F.lit(n).alias("level"))
        level = materialise(level, "level")
        if level.isEmpty():
            return found
        found = found.unionByName(level)
