"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens.session import checkpointed


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())


TASK_LINKS = 1 << 16


def _bundled(links: DataFrame, most: int) -> DataFrame:
    """``links``, which are there already and at most so many, read by as few tasks as that takes: each task leaves files of its own on disk."""
    return links.coalesce(max(1, -(-most // TASK_LINKS)))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``links`` (u, v) reaches; nodes without links are left out.

    Large-star and small-star steps in turn: every node hands its neighbours to the least one it knows, until nothing
    changes. The number of links never grows, rounds are logarithmic, and a hub is a count-like minimum (merged before
    the shuffle) joined back, never a list. Both steps of a round are cut off, so that a plan stays small. The driver sees three numbers a round. Null ends, loops and repeated links
    are ignored.
    """
    now = checkpointed(links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    now = _bundled(now, state[0])
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _bundled(checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()), state[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = _bundled(checkpointed(small.union(least.select("u", F.col("m").alias("v"))).distinct()), state[0])
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
