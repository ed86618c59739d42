"""PageRank over an undirected weighted graph."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlens.functions.values import split_node_id
from itemlens.session import checkpointed

# a node with more edges than this has its edges cut into slots, each its own join key
SLOT_EDGES = 100_000
# while the edges are laid out, a node's edges meet its numbers in so many tasks
SALTS = 16


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, alpha: float = 0.85, max_iter: int = 200,
             tol: float = 1e-10, stride: int = 10, slot_edges: int = SLOT_EDGES) -> DataFrame:
    """(id, rank); ranks sum to 1. ``edges`` (src, dst, weight); ``nodes`` (id) may add isolated ones.

    Weight 0 or missing counts as 1. The edges are laid out once by (sender, slot), each with its share of its sender's
    rank; a step sends the ranks to the slots and sums what arrives, in the same plan whatever the size of the graph.
    ``stride`` steps run between checks; the only number read back is the L1 change of the last of them. Isolated nodes
    neither send nor receive, so all of them share one rank, a plain number.
    """
    links = checkpointed(_links(edges, slot_edges).repartition("src", "slot"))
    linked = checkpointed(links.groupBy(F.col("dst").alias("id")).agg(F.max("dst_slots").alias("slots")))
    n_linked = linked.count()
    lone = nodes.select("id").distinct().join(linked, "id", "left_anti") if nodes is not None else None
    n_lone = lone.count() if lone is not None else 0
    n = n_linked + n_lone
    if n == 0:
        return linked.select("id", F.lit(None).cast("double").alias("rank"))

    ranks = linked.select("id", "slots", F.lit(1.0 / n).alias("rank"))
    lone_rank, done = 1.0 / n, 0
    while n_linked and done < max_iter:
        steps = min(stride, max_iter - done)
        for _ in range(steps):
            lone_before = lone_rank
            lone_rank = (1 - alpha) / n + alpha * n_lone * lone_before / n
            ranks = _step(ranks, links, lone_rank, alpha)
        ranks = checkpointed(ranks)
        done += steps
        moved = ranks.agg(F.expr("sum(abs(rank - old))")).first()[0]
        if moved + n_lone * abs(lone_rank - lone_before) < tol:
            break
    out = ranks.select("id", "rank")
    return out.unionByName(lone.select("id", F.lit(lone_rank).alias("rank"))) if n_lone else out


def _links(edges: DataFrame, slot_edges: int) -> DataFrame:
    """Every edge in both directions: (src, slot, dst, dst_slots, share)."""
    weight = F.coalesce(F.nullif(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1.0))
    one_way = edges.select("src", "dst", weight.alias("w"))
    both = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    both = checkpointed(both.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    slots = F.ceil(F.count(F.lit(1)) / F.lit(slot_edges)).cast("int")
    hubs = both.groupBy("src").agg(F.sum("w").alias("out"), slots.alias("slots"))
    every = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lambda by: F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    sized = both.withColumn("salt", salted("dst")).join(every, ["src", "salt"]).withColumn("salt", salted("src")).join(
        every.select(F.col("src").alias("dst"), "salt", F.col("slots").alias("dst_slots")), ["dst", "salt"])
    slot = F.pmod(F.xxhash64("dst"), F.col("slots")).cast("int").alias("slot")
    sends = sized.select("src", slot, "dst", "dst_slots", (F.col("w") / F.col("out")).alias("share"))
    # a row from each node to itself brings its last rank along, without a second join
    own = hubs.select("src", F.lit(0).alias("slot"), F.col("src").alias("dst"), F.col("slots").alias("dst_slots"),
                      F.lit(None).cast("double").alias("share"))
    return sends.unionByName(own)


def _step(ranks: DataFrame, links: DataFrame, base: float, alpha: float) -> DataFrame:
    # SQL text, not column calls: the loop builds hundreds of these plans. A hub's rank is copied to each of its slots
    met = links.join(ranks.selectExpr("id AS src", "rank", "explode(sequence(0, slots - 1)) AS slot"), ["src", "slot"])
    # every linked node receives something, so the sum alone gives the new ranks
    got = met.groupBy("dst").agg(
        F.expr("sum(share * rank) AS got"), F.expr("max(dst_slots) AS slots"),
        F.expr("max(CASE WHEN share IS NULL THEN rank END) AS old"))
    return got.selectExpr("dst AS id", "slots", f"{base!r}D + {alpha!r}D * got AS rank", "old")


def pagerank_report(ranks: DataFrame, digits: int = 6) -> DataFrame:
    """(node, type, label, pagerank) with the node id split and the rank rounded."""
    return ranks.select(F.col("id").alias("node"), split_node_id(F.col("id")).alias("s"),
                        F.round("rank", digits).alias("pagerank")).select("node", "s.*", "pagerank")
