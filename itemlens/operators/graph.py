"""Property graph, co-occurrence, joint askers and similarity."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemlens import constants as K
from itemlens.functions.values import node_id
from itemlens.operators.counting import count_by, first_by, last_by, lift_of_cells
from itemlens.operators.pairs import block_pairs, pair_counts, top_pair_counts, with_key_size
from itemlens.session import checkpointed

# node kinds and the prefix of their ids
KINDS = {"party": "Party", "ministry": "Ministry", "state": "State", "mp": "MP", "topic": "Topic"}


def asker_profile(items: DataFrame, order: list[str], asker: str = "member") -> DataFrame:
    """Group, region and chamber of an asker's last item."""
    return last_by(items, asker, ["party", "state", "chamber"], order)


def graph_cells(items: DataFrame, order: list[str]) -> DataFrame:
    """(member, party, state, ministry, n, first): all that nodes and edges need from the items.

    Checkpointed, so the items are read once for the whole graph; ``first`` is the
    place and chamber of the earliest item of the cell.
    """
    first = F.min(F.struct(F.struct(*order).alias("at"), F.col("chamber").alias("chamber"))).alias("first")
    return checkpointed(items.groupBy("member", "party", "state", "ministry").agg(F.count(F.lit(1)).alias("n"), first))


def graph_nodes(cells: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, type, label, party, state, chamber); asker attributes come from the first item."""
    blank = [F.lit(None).cast("string").alias(c) for c in ("party", "state", "chamber")]

    def plain(df, prefix, col):
        return df.select(col).distinct().select(
            node_id(prefix, F.col(col)).alias("id"), F.lit(KINDS[prefix]).alias("type"), F.col(col).alias("label"), *blank)

    seen = cells.withColumn("chamber", F.col("first.chamber"))
    askers = first_by(seen, "member", ["party", "state", "chamber"], ["first"]).select(
        node_id("mp", F.col("member")).alias("id"), F.lit(KINDS["mp"]).alias("type"), F.col("member").alias("label"),
        "party", "state", "chamber")
    return (
        plain(cells, "party", "party").unionByName(plain(cells, "ministry", "ministry"))
        .unionByName(plain(cells, "state", "state")).unionByName(askers).unionByName(plain(topics, "topic", "term"))
    )


def graph_edges(cells: DataFrame, topics: DataFrame) -> DataFrame:
    """(src, dst, type, weight): membership and region edges unweighted, the rest counted."""
    def edges(a, a_col, b, b_col, kind, weighted=True):
        counted = cells.groupBy(a_col, b_col).agg(F.sum("n").alias("n"))
        weight = F.col("n") if weighted else F.lit(None).cast("long")
        return counted.select(node_id(a, F.col(a_col)).alias("src"), node_id(b, F.col(b_col)).alias("dst"),
                              F.lit(kind).alias("type"), weight.alias("weight"))

    topic_edges = topics.select(
        node_id("party", F.col("party")).alias("src"), node_id("topic", F.col("term")).alias("dst"),
        F.lit("FOCUSES_ON_TOPIC").alias("type"), F.col("count").cast("long").alias("weight"))
    return (
        edges("mp", "member", "party", "party", "MEMBER_OF", False)
        .unionByName(edges("mp", "member", "state", "state", "REPRESENTS", False))
        .unionByName(edges("mp", "member", "ministry", "ministry", "ASKED"))
        .unionByName(edges("party", "party", "ministry", "ministry", "FOCUSES_ON"))
        .unionByName(topic_edges)
    )


def focus_edges(items: DataFrame, topics: DataFrame, group: str = "party", target: str = "ministry") -> DataFrame:
    """Weighted group-target and group-topic edges, the graph PageRank runs on."""
    asked = count_by(items, group, target, out="n").select(
        node_id(group, F.col(group)).alias("src"), node_id(target, F.col(target)).alias("dst"), F.col("n").alias("weight"))
    named = topics.select(
        node_id(group, F.col(group)).alias("src"), node_id("topic", F.col("term")).alias("dst"),
        F.col("count").cast("long").alias("weight"))
    return asked.unionByName(named)


def cooccurring_targets(items: DataFrame, asker: str = "member", target: str = "ministry",
                        out: str = "shared_askers") -> DataFrame:
    """Pairs of targets (a < b) and the number of askers who asked both."""
    return pair_counts(items, asker, target, out, "target_a", "target_b")


def top_cooccurring_targets(items: DataFrame, asker: str = "member", target: str = "ministry",
                            out: str = "shared_askers", k: int = K.TOP_COOCCURRENCE) -> DataFrame:
    """The ``k`` pairs of targets that most askers asked both of; pairs that cannot be among them are not made."""
    return top_pair_counts(items, asker, target, k, out, "target_a", "target_b")


def last_joint_item(items: DataFrame, keys: list[str], order: list[str], askers: str = "askers") -> DataFrame:
    """One asker list per item key, the last by ``order``; lists of one are left out first."""
    joint = items.filter(F.size(askers) > 1)
    return joint.groupBy(*keys).agg(F.max_by(askers, F.struct(*order)).alias(askers))


def joint_asker_pairs(joint: DataFrame, keys: list[str], asker: str, out: str = "joint_items") -> DataFrame:
    """Pairs of askers (a < b) and the number of joint items both signed; ``joint`` has a row per signature."""
    keyed = joint.select(F.struct(*keys).alias("key"), F.col(asker).alias("asker"))
    return pair_counts(keyed, "key", "asker", out, "asker_a", "asker_b")


def cross_group_bridges(pairs: DataFrame, groups: DataFrame, asker: str, group: str) -> DataFrame:
    """Pairs whose askers belong to different groups; no known group means Unknown."""
    side = lambda s: groups.select(F.col(asker).alias(f"asker_{s}"), F.col(group).alias(f"group_{s}"))
    both = pairs.join(side("a"), "asker_a", "left").join(side("b"), "asker_b", "left")
    return both.withColumns({
        "group_a": F.coalesce("group_a", F.lit(K.UNKNOWN)), "group_b": F.coalesce("group_b", F.lit(K.UNKNOWN)),
    }).filter(F.col("group_a") != F.col("group_b")).select(
        "asker_a", "group_a", "asker_b", "group_b", *[c for c in pairs.columns if c not in ("asker_a", "asker_b")])


def cosine_similarity(vectors: DataFrame, group: str, key: str, value: str,
                      threshold: float = K.MIN_SIMILARITY) -> DataFrame:
    """(a, b, similarity) of sparse vectors given as (group, key, value) rows, above ``threshold``, which is not negative.

    Values are scaled to unit length. Keys have one order, those of most groups first, and a vector's first keys are left out of the search as
    long as all of them together cannot bring any partner over the threshold: each is at most the key's greatest value there. The last key
    that two similar vectors share is then a key of both that is left in, and what comes up to it bounds their product: by the lengths of
    both beginnings and by the greatest values. Pairs that these rule out are not made. A key most groups share is cut into blocks.
    """
    pairs = candidate_pairs(unit := checkpointed(unit_vectors(vectors, group, key, value)), threshold)
    side = lambda s: unit.select(F.col("g").alias(s), "k", F.col("v").alias(f"v_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), ["b", "k"]).groupBy("a", "b").agg(
        F.sum(F.col("v_a") * F.col("v_b")).alias("similarity")).filter(F.col("similarity") > threshold)


def unit_vectors(vectors: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(g, k, v): the vectors scaled to unit length, zero ones left out."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(group)))
    return vectors.withColumn("_norm", norm).filter("_norm > 0").select(
        F.col(group).alias("g"), F.col(key).alias("k"), (F.col(value) / F.col("_norm")).alias("v"))


def candidate_pairs(unit: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: the pairs of unit vectors (g, k, v) that may have a product above ``threshold``; none that has is missing."""
    least = threshold * (1 - 1e-9)  # so that rounding can only add pairs
    keys = unit.groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.max(F.abs("v")).alias("_max"))
    so_far = Window.partitionBy("g").orderBy(F.col("_n").desc(), "k")
    placed = unit.join(keys, "k").select("g", "k", F.sum(F.abs("v") * F.col("_max")).over(so_far).alias("most"),
                                         F.sqrt(F.sum(F.col("v") * F.col("v")).over(so_far)).alias("length"))
    pairs = block_pairs(with_key_size(placed.filter(F.col("most") > least), "k", "g"), "k", "g", ["most", "length"])
    possible = (F.least("most_a", "most_b") > least) & (F.col("length_a") * F.col("length_b") > least)
    return pairs.filter(possible).select("a", "b").distinct()


def similarity_graph(items: DataFrame, group: str = "party", target: str = "ministry",
                     least: int = K.MIN_COMMUNITY_ITEMS, threshold: float = K.MIN_SIMILARITY, weight: str | None = None):
    """(nodes, edges) over groups with enough items, joined by the cosine of their lift vectors."""
    cells = count_by(items, group, target, out="n", weight=weight)
    lifts = lift_of_cells(cells, group, target, "n")
    kept = lifts.filter(F.col(f"{group}_total") >= least)
    nodes = kept.groupBy(F.col(group).alias("id")).agg(F.max(f"{group}_total").alias("items"))
    edges = cosine_similarity(kept, group, target, "lift", threshold)
    return nodes, edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("similarity").alias("weight"))


def graph_stats(nodes: DataFrame, edges: DataFrame, bridges: DataFrame, min_groups: DataFrame) -> DataFrame:
    """One row: nodes, edges, groups with enough items, targets, askers, cross-group pairs."""
    kinds = nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("type") == "Ministry").alias("targets"),
        F.count_if(F.col("type") == "MP").alias("askers"))
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return kinds.select("nodes", size(edges).alias("edges"), size(min_groups).alias("groups"), "targets", "askers",
                        size(bridges).alias("bridge_pairs"))
