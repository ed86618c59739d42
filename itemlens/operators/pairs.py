"""Counting pairs that share a key, exactly and without a hot key in one task.

Keys with few members become short sorted lists: equal lists merge into one with
a multiplicity, then each list gives its pairs in place. Keys with many members
are cut into blocks; every pair of blocks is its own join key, so the work of one
big key is spread over many tasks and no list of it is ever built.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemlens.session import checkpointed, shuffled

SHORT_LIST = 64
BLOCK = 512
SLOTS = 16


def pair_counts(df: DataFrame, key: str, item: str, out: str = "n",
                a: str = "a", b: str = "b", short: int = SHORT_LIST) -> DataFrame:
    """(a, b, n) with a < b: the number of keys both items occur under."""
    members = df.select(F.col(key).alias("k"), F.col(item).alias("i")).distinct()
    sized = checkpointed(with_key_size(members, "k"))  # read by both ways below
    lists = (
        sized.filter((F.col("_size") > 1) & (F.col("_size") <= short))
        .groupBy("k").agg(F.sort_array(F.collect_list("i")).alias("items"))
        .groupBy("items").agg(F.count(F.lit(1)).alias("m"))
    )
    small = lists.select(F.explode(list_pairs(F.col("items"))).alias("p"), "m").select("p.a", "p.b", "m")
    big = block_pairs(sized.filter(F.col("_size") > short), "k", "i", []).select(
        "a", "b", F.lit(1).cast("long").alias("m"))
    return (
        small.unionByName(big).groupBy("a", "b").agg(F.sum("m").alias(out))
        .withColumnsRenamed({"a": a, "b": b})
    )


def top_pair_counts(df: DataFrame, key: str, item: str, k: int, out: str = "n", a: str = "a", b: str = "b") -> DataFrame:
    """The ``k`` pairs of ``pair_counts`` with the greatest numbers, ties to the smaller pair, without making all pairs.

    A pair occurs at most as often as the rarer of its items. The pairs of the few most frequent items give a bound from below for the k-th
    number; items that occur less often than that are in no pair of the result, so the second round, if one is needed at all, counts the
    pairs of the others only. The driver reads two numbers.
    """
    members = checkpointed(df.select(F.col(key).alias("k"), F.col(item).alias("i")).distinct())
    seen = checkpointed(members.groupBy("i").agg(F.count(F.lit(1)).alias("f")))
    some = 2
    while some * (some - 1) < 4 * k:
        some += 1
    least = seen.orderBy(F.col("f").desc(), "i").limit(some).agg(F.min("f")).first()[0] or 1

    def counted(bound: int) -> DataFrame:
        often = seen.filter(F.col("f") >= bound).select("i")
        return checkpointed(pair_counts(members.join(often, "i", "left_semi"), "k", "i", "n").orderBy(F.col("n").desc(), "a", "b").limit(k))

    top = counted(least)
    found = top.agg(F.count(F.lit(1)), F.min("n")).first()
    safe = found[1] if found[0] == k else 1
    if safe < least:
        top = counted(safe)
    return top.withColumnsRenamed({"n": out, "a": a, "b": b}).orderBy(F.col(out).desc(), a, b)


def with_key_size(members: DataFrame, key: str, item: str = "i", slots: int = SLOTS) -> DataFrame:
    """Members with the size of their key. Counts come per slot of a key, and members meet them slot by slot, so a key
    with very many members is never in one task."""
    placed = members.withColumn("_slot", F.pmod(F.xxhash64(item), F.lit(slots)).cast("int"))
    per_slot = placed.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    sizes = per_slot.groupBy(key).agg(F.sum("_n").alias("_size"))
    return placed.join(per_slot.join(sizes, key).drop("_n"), [key, "_slot"]).drop("_slot")


def list_pairs(items: Column) -> Column:
    """All (a, b), a before b, of a short sorted list."""
    rest = lambda i: F.slice(items, i + 2, F.size(items))
    return F.flatten(F.transform(
        items, lambda x, i: F.transform(rest(i), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def block_pairs(sized: DataFrame, key: str, item: str, carry: list[str], block: int = BLOCK) -> DataFrame:
    """Pairs of items sharing a key, as an equi-join on (key, block, block).

    ``carry`` columns come out twice, with suffixes _a and _b. An item goes to one
    row per block of its key, so a key of s members costs s * s / block rows
    spread over (s / block)^2 / 2 join keys.
    """
    blocks = F.ceil(F.col("_size") / F.lit(block)).cast("int")
    placed = sized.withColumn("_blocks", blocks).withColumn(
        "_own", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    every = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    lo, hi = F.least("_own", "_other"), F.greatest("_own", "_other")
    keyed = every.select(key, item, *carry, "_own", "_other", lo.alias("_lo"), hi.alias("_hi"))
    # a tile (lo, hi) meets rows of block lo on the left and of block hi on the right
    left = keyed.filter(F.col("_own") == F.col("_lo")).select(
        key, "_lo", "_hi", F.col(item).alias("_l"), *[F.col(c).alias(f"{c}_l") for c in carry])
    right = keyed.filter(F.col("_own") == F.col("_hi")).select(
        key, "_lo", "_hi", F.col(item).alias("_r"), *[F.col(c).alias(f"{c}_r") for c in carry])
    same_tile = F.col("_lo") == F.col("_hi")
    joined = shuffled(left).join(right, [key, "_lo", "_hi"]).filter(
        F.when(same_tile, F.col("_l") < F.col("_r")).otherwise(F.col("_l") != F.col("_r")))
    ordered = F.col("_l") < F.col("_r")

    def side(l_first, r_first):
        return F.when(ordered, F.col(l_first)).otherwise(F.col(r_first))

    cols = [side("_l", "_r").alias("a"), side("_r", "_l").alias("b")]
    for c in carry:
        cols += [side(f"{c}_l", f"{c}_r").alias(f"{c}_a"), side(f"{c}_r", f"{c}_l").alias(f"{c}_b")]
    return joined.select(key, *cols)
