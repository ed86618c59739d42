"""Modularity communities of an undirected weighted graph.

Nodes move to the neighbouring community that gains most, a hash-chosen half of
them per round; then every community becomes a node and the moves start again,
as long as modularity rises. All steps are joins and sums over edge rows; the
driver reads one modularity value per round.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens.session import checkpointed

GAIN = 1e-9
# a hub's edges, and a large community's members, meet what they look up in so many tasks
SLOTS = 16


def communities(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, community, community_size); a community is named after its smallest member.

    ``nodes`` (id, ...) keeps isolated ones; ``edges`` (src, dst, weight). Rounds go on until both halves of the nodes
    have had a turn and nothing moved, levels until modularity no longer rises; each accepted round raises it, so
    both end. ``max_rounds`` may limit the rounds of a level, and raises an error when it is reached.
    """
    ids = checkpointed(nodes.select("id").distinct())
    one_way = edges.select("src", "dst", F.col("weight").alias("w"))
    links = checkpointed(
        one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        .groupBy("src", "dst").agg(F.sum("w").alias("w")))
    whole = links.agg(F.sum("w")).first()[0]
    member = ids.select("id", F.col("id").alias("comm"))
    best = None
    while whole:
        moved, q = _move_nodes(links, float(whole), max_rounds)
        if best is not None and q <= best + GAIN:
            break
        best = q
        member = checkpointed(
            member.join(moved.select(F.col("id").alias("comm"), F.col("comm").alias("to")), "comm", "left")
            .select("id", F.coalesce("to", "comm").alias("comm")))
        links = checkpointed(_relabel(links, moved).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    named = member.groupBy("comm").agg(F.min("id").alias("community"), F.count(F.lit(1)).alias("community_size"))
    return member.join(named, "comm").select("id", "community", "community_size")


def _look_up(rows: DataFrame, key: str, by: str, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``table`` for their ``key``; rows of one key are spread by ``by`` over slots."""
    every = table.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    return rows.withColumn("_slot", F.pmod(F.xxhash64(by), F.lit(SLOTS)).cast("int")).join(every, [key, "_slot"]).drop("_slot")


def _relabel(links: DataFrame, member: DataFrame) -> DataFrame:
    src = member.select(F.col("id").alias("src"), F.col("comm").alias("a"))
    dst = member.select(F.col("id").alias("dst"), F.col("comm").alias("b"))
    both = _look_up(_look_up(links, "src", "dst", src), "dst", "src", dst)
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def _move_nodes(links: DataFrame, whole: float, max_rounds: int | None) -> tuple[DataFrame, float]:
    """Best assignment found over the rounds and its modularity."""
    degree = checkpointed(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    member = degree.select("id", "k", F.col("id").alias("comm"))
    best, best_q = member, modularity(links, member, whole)
    idle = round_no = 0
    while idle < 2:  # the two halves take turns
        if max_rounds is not None and round_no >= max_rounds:
            raise RuntimeError(f"communities still move after {max_rounds} rounds")
        member = checkpointed(_round(links, member, whole, round_no))
        q = modularity(links, member, whole)
        if q > best_q + GAIN:
            best, best_q, idle = member, q, 0
        else:
            member, idle = best, idle + 1
        round_no += 1
    return best.select("id", "comm"), best_q


def _round(links: DataFrame, member: DataFrame, whole: float, round_no: int) -> DataFrame:
    of_dst = member.select(F.col("id").alias("dst"), F.col("comm").alias("d"))
    # weight from each node to each neighbouring community; its own always takes part
    toward = (
        _look_up(links.filter("src != dst"), "dst", "src", of_dst).select(F.col("src").alias("id"), "d", "w")
        .unionByName(member.select("id", F.col("comm").alias("d"), F.lit(0.0).alias("w")))
        .groupBy("id", "d").agg(F.sum("w").alias("w"))
    )
    totals = member.groupBy(F.col("comm").alias("d")).agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("size"))
    own = member.select("id", "k", "comm")
    own_size = totals.select(F.col("d").alias("comm"), F.col("size").alias("own_size"))
    stays = F.col("d") == F.col("comm")
    rest = F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)
    # of two lone nodes only the one with the larger label moves, or they would swap for ever
    allowed = stays | (F.col("size") > 1) | (F.col("own_size") > 1) | (F.col("d") < F.col("comm"))
    scored = (
        _look_up(_look_up(toward.join(own, "id"), "d", "id", totals), "comm", "id", own_size).filter(allowed)
        .select("id", "k", "comm", "d", (F.col("w") - F.col("k") * rest / F.lit(whole)).alias("gain"))
    )
    pick = scored.groupBy("id", "k", "comm").agg(
        F.min_by("d", F.struct((-F.round("gain", 12)).alias("g"), "d")).alias("to"), F.max("gain").alias("top"),
        F.max(F.when(F.col("d") == F.col("comm"), F.col("gain"))).alias("now"))
    turn = F.pmod(F.xxhash64("id", F.lit(round_no // 2)), F.lit(2)) == round_no % 2
    go = turn & (F.col("top") > F.col("now") + GAIN)
    return pick.select("id", "k", F.when(go, F.col("to")).otherwise(F.col("comm")).alias("comm"))


def modularity(links: DataFrame, member: DataFrame, whole: float) -> float:
    inside = _relabel(links, member).filter("src = dst").agg(F.coalesce(F.sum("w"), F.lit(0.0)))
    spread = member.groupBy("comm").agg(F.sum("k").alias("t")).agg(F.sum((F.col("t") / whole) * (F.col("t") / whole)).alias("s"))
    row = spread.select("s", inside.scalar().alias("inside")).first()
    return row["inside"] / whole - row["s"]


def community_table(member: DataFrame, sizes: DataFrame) -> DataFrame:
    """(community, group, items, community_size) by community, then items descending."""
    return member.join(sizes, "id").select(
        "community", F.col("id").alias("group"), "items", "community_size",
    ).orderBy("community", F.col("items").desc(), "group")
